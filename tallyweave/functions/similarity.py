"""String similarity in Arrow batches (indel ratios, rounded to whole percents), and digit agreement in Catalyst.

A batch of pairs is compared at once: bit vectors of longest common subsequences, one per pair (and
per window of the longer string), advance together in numpy a character a step. Pairs whose shorter
string has more than 64 characters go one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType


def _common(a: str, b: str) -> int:
    """Length of a longest common subsequence, by bit vectors."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & at.get(c, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def ratio(a: str, b: str) -> int:
    """100 times twice the common subsequence over both lengths, half up."""
    both = len(a) + len(b)
    return (400 * _common(a, b) + both) // (2 * both) if both else 100


def token_set_ratio(a: str, b: str) -> int:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    same = " ".join(sorted(x & y))
    left, right = (" ".join(filter(None, (same, " ".join(sorted(s))))) for s in (x - y, y - x))
    if same and (left == same or right == same):
        return 100
    return max(ratio(left, right), *((ratio(same, left), ratio(same, right)) if same else (0,)))


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter string with any equally long part of the longer, ends included."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)) if b[max(0, i) : i + n])


def partial_token_set_ratio(a: str, b: str) -> int:
    """100 as soon as a word is shared, else the best part of the words each has alone."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0
    return 100 if x & y else partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)))


def weighted_ratio(a: str, b: str) -> int:
    """The best of the plain, sorted and set ratios, weighed down; of their partial forms when the lengths lie far apart."""
    if not a or not b:
        return 0
    apart, order = max(len(a), len(b)) / min(len(a), len(b)), lambda s: " ".join(sorted(s.split()))
    if apart < 1.5:
        scores = [ratio(a, b), ratio(order(a), order(b)) * 0.95, token_set_ratio(a, b) * 0.95]
    else:
        weight = 0.6 if apart > 8 else 0.9
        scores = [ratio(a, b), partial_ratio(a, b) * weight, partial_ratio(order(a), order(b)) * 0.95 * weight, partial_token_set_ratio(a, b) * 0.95 * weight]
    return int(max(scores) + 0.5)


COMPARATORS = {"ratio": ratio, "token_set_ratio": token_set_ratio, "partial_ratio": partial_ratio, "token_sort_ratio": lambda a, b: ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), "partial_token_set_ratio": partial_token_set_ratio, "WRatio": weighted_ratio}

#: Characters of a bit vector, and pairs that advance together.
_BITS, _TOGETHER = 64, 2048
_PAD_SHORT, _PAD_LONG = 0xFFFFFFFE, 0xFFFFFFFF


def _points(texts: list[str], pad: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), max(width, int(size.max(initial=1)))), pad, np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


def _matches(short: list[str], long_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per pair and character of the longer string, the bits of the shorter one's places that hold it; and both lengths."""
    a, n = _points(short, _PAD_SHORT, _BITS)
    b, m = _points(long_, _PAD_LONG, 1)
    bits = np.empty(b.shape, np.uint64)
    for j in range(b.shape[1]):
        bits[:, j] = np.packbits(a == b[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return bits, n, m


def _full(n: np.ndarray) -> np.ndarray:
    return np.where(n >= _BITS, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(n, _BITS - 1).astype(np.uint64)) - np.uint64(1))


def _percent(common: np.ndarray, both: np.ndarray) -> np.ndarray:
    return np.where(both > 0, (400 * common + both) // np.maximum(2 * both, 1), 100)


def _batched(one: Callable[[list[str], list[str]], np.ndarray], scalar: Callable[[str, str], int]) -> Callable[[list[str], list[str]], np.ndarray]:
    """one over chunks of pairs, the shorter string first; scalar for pairs of two long strings."""

    def run(left: list[str], right: list[str]) -> np.ndarray:
        out = np.zeros(len(left), np.int64)
        fits = [k for k, (a, b) in enumerate(zip(left, right, strict=True)) if min(len(a), len(b)) <= _BITS]
        for k in set(range(len(left))).difference(fits) if len(fits) < len(left) else ():
            out[k] = scalar(left[k], right[k])
        fits.sort(key=lambda k: max(len(left[k]), len(right[k])))  # alike in length, so little is padded
        for at in range(0, len(fits), _TOGETHER):
            own = fits[at : at + _TOGETHER]
            pairs = [(left[k], right[k]) if len(left[k]) <= len(right[k]) else (right[k], left[k]) for k in own]
            out[own] = one([p[0] for p in pairs], [p[1] for p in pairs])
        return out

    return run


def _ratio_chunk(short: list[str], long_: list[str]) -> np.ndarray:
    bits, n, m = _matches(short, long_)
    full = _full(n)
    rest = full.copy()
    for j in range(bits.shape[1]):
        hit = rest & bits[:, j]
        rest = ((rest + hit) | (rest - hit)) & full
    return _percent(n - np.bitwise_count(rest).astype(np.int64), n + m)


def _partial_chunk(short: list[str], long_: list[str]) -> np.ndarray:
    bits, n, m = _matches(short, long_)
    most, wide = int(n.max(initial=0)), bits.shape[1]
    if not most:
        return np.zeros(len(short), np.int64)
    starts = np.arange(1 - most, wide)
    full = _full(n)[:, None]
    rest = np.repeat(full, len(starts), axis=1)
    padded = np.concatenate([np.zeros((len(short), most), np.uint64), bits, np.zeros((len(short), most), np.uint64)], axis=1)
    for t in range(most):
        hit = rest & np.where(t < n[:, None], padded[:, 1 + t : 1 + t + len(starts)], np.uint64(0))
        rest = ((rest + hit) | (rest - hit)) & full
    size = np.minimum(starts + n[:, None], m[:, None]) - np.maximum(starts, 0)
    score = _percent(n[:, None] - np.bitwise_count(rest).astype(np.int64), n[:, None] + np.maximum(size, 0))
    return np.where((n > 0) & (size > 0).any(axis=1), np.where(size > 0, score, 0).max(axis=1), 0)


ratios, partial_ratios = _batched(_ratio_chunk, ratio), _batched(_partial_chunk, partial_ratio)


def token_set_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """token_set_ratio of each pair: the sets are split in Python, the up to three ratios of all pairs compared together."""
    out = np.zeros(len(left), np.int64)
    at, a, b = [], [], []
    for k, (p, q) in enumerate(zip(left, right, strict=True)):
        x, y = set(p.split()), set(q.split())
        if not x or not y:
            continue
        same = " ".join(sorted(x & y))
        first, second = (" ".join(filter(None, (same, " ".join(sorted(s))))) for s in (x - y, y - x))
        if same and (first == same or second == same):
            out[k] = 100
            continue
        pairs = [(first, second), (same, first), (same, second)] if same else [(first, second)]
        at += [k] * len(pairs)
        a += [p for p, _ in pairs]
        b += [q for _, q in pairs]
    np.maximum.at(out, at, ratios(a, b)) if at else None
    return out


#: Comparators that take a batch at once.
BATCHED = {"ratio": ratios, "partial_ratio": partial_ratios, "token_set_ratio": token_set_ratios}


def compare(name: str, a: Column, b: Column) -> Column:
    """0 to 1: 0 if either is empty, 1 if equal; Python sees only the pairs that are neither."""
    score = BATCHED.get(name) or (lambda x, y: np.array([COMPARATORS[name](p, q) for p, q in zip(x, y, strict=True)]))

    @F.arrow_udf(DoubleType())
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        known = pa.compute.and_(x.is_valid(), y.is_valid())
        out = np.zeros(len(x))
        out[known.to_numpy(zero_copy_only=False)] = score(x.filter(known).to_pylist(), y.filter(known).to_pylist()) / 100
        return pa.array(out, pa.float64(), mask=~known.to_numpy(zero_copy_only=False))

    open_ = (a != "") & (b != "") & (a != b)
    some = lambda c: F.when(open_, c)
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(run(some(a), some(b)))


def agreement(a: str, b: str, least: int = 4) -> float:
    """digit_agreement of two values in Python."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = sorted((a.lstrip("0"), b.lstrip("0")), key=len)
    if len(x) < least:
        return 0.0
    return 1.0 if x == y else len(x) / len(y) if y.startswith(x) or y.endswith(x) else 0.0


#: Weights of tokens and digits, the floor of tokens, and from where and how much digits carry a reference alone.
TOKEN_WEIGHT, DIGIT_WEIGHT, TOKEN_FLOOR, CARRY_FROM, CARRIED = 0.6, 0.4, 0.6, 0.6, 0.9


_MATCH = StructType([StructField("score", DoubleType()), StructField("observed", DoubleType()), StructField("exact", BooleanType()), StructField("carried", BooleanType()), StructField("a", IntegerType()), StructField("b", IntegerType())])


@F.arrow_udf(_MATCH)
def reference_match(a: pa.Array, a_digits: pa.Array, b: pa.Array, b_digits: pa.Array) -> pa.Array:
    """Of each row the best pair of two sets of references: its score, token similarity, whether equal, whether its digits carry it, and both places.

    A pair scores the better of weighted token and digit similarity, and of digits that carry it alone.
    Of equally scored pairs an equal one wins, then the first. Without any pair the row is null.
    """
    rows = [[(i, j, x or "", y or "", p or "", q or "") for i, (x, p) in enumerate(zip(u or (), v or ())) for j, (y, q) in enumerate(zip(s or (), t or ()))] for u, v, s, t in zip(*(c.to_pylist() for c in (a, a_digits, b, b_digits)), strict=True)]
    observed = (token_set_ratios([x for row in rows for _, _, x, *_ in row], [y for row in rows for _, _, _, y, *_ in row]) / 100).tolist()
    out, at = [], 0
    for row in rows:
        best = None
        for i, j, x, y, p, q in row:
            seen, digits = 1.0 if x == y and x else observed[at], agreement(p, q)
            at += 1
            score = max(TOKEN_WEIGHT * ((seen - TOKEN_FLOOR) / (1 - TOKEN_FLOOR) if seen >= TOKEN_FLOOR else 0.0) + DIGIT_WEIGHT * digits, CARRIED * digits if digits >= CARRY_FROM else 0.0)
            if best is None or score > best["score"] or score == best["score"] and x == y and not best["exact"]:
                best = {"score": min(score, 1.0), "observed": seen, "exact": x == y, "carried": digits >= CARRY_FROM, "a": i, "b": j}
        out.append(best)
    return pa.array(out, pa.struct([("score", pa.float64()), ("observed", pa.float64()), ("exact", pa.bool_()), ("carried", pa.bool_()), ("a", pa.int32()), ("b", pa.int32())]))


@F.arrow_udf(DoubleType())
def _alike(x: pa.Array, y: pa.Array) -> pa.Array:
    known = pa.compute.and_(x.is_valid(), y.is_valid()).to_numpy(zero_copy_only=False)
    a, b = (c.filter(pa.array(known)).to_pylist() for c in (x, y))
    fused = [["".join(t.split()) for t in side] for side in (a, b)]
    score = np.maximum(token_set_ratios(a, b), ratios(*fused)) / 100
    weak = np.flatnonzero(score < 0.9)
    if len(weak):
        score[weak] = np.maximum(score[weak], 0.9 * partial_ratios([fused[0][k] for k in weak], [fused[1][k] for k in weak]) / 100)
    out = np.zeros(len(x))
    out[known] = score
    return pa.array(out, pa.float64(), mask=~known)


def names_alike(x: Column, y: Column) -> Column:
    """0 to 1: the best of three views of two names: words, fused words, and one name inside the other (0.9). Blank names are like none."""
    some = lambda c: F.when((x != "") & (y != "") & (x != y), c)
    return F.when((x == "") | (y == "") | x.isNull() | y.isNull(), 0.0).when(x == y, 1.0).otherwise(_alike(some(x), some(y)))


def rescaled(score: Column, floor: float) -> Column:
    return F.when(score < floor, 0.0).otherwise((score - floor) / (1 - floor))


def bare_digits(c: Column) -> Column:
    return F.ltrim(c, F.lit("0"))


def digit_agreement(a: Column, b: Column, least: int = 4, bare: tuple[Column, Column] | None = None) -> Column:
    """1 if the digit strings agree but for leading zeros, the length ratio if one begins or ends the other, else 0.

    bare: bare_digits of both, where they are columns already.
    """
    x, y = bare or (bare_digits(a), bare_digits(b))
    inside = lambda short, long_: F.when(F.startswith(long_, short) | F.endswith(long_, short), F.length(short) / F.length(long_)).otherwise(0.0)
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when((F.length(x) < least) | (F.length(y) < least), 0.0)
        .when(x == y, 1.0)
        .when(F.length(x) <= F.length(y), inside(x, y))
        .otherwise(inside(y, x))
    )

"""All pairs that can still be among a document's best, by bounds on their scores.

Each document has a bar: the composite of its last candidate so far. Pairs whose digits agree meet in an
equi join on digits, prefixes and suffixes (agreeing_pairs). Of any other pair the references add at most
SEEN to the composite, so money and date alone say which payments can reach the bar: those of an interval
of amounts, wider for the ones within the window. Payments lie in cells by amount; a document goes to the
cells that its interval touches. In a cell pairs are bounded in numpy, all at once and in three steps: by
money and date, then by the references, then by the names, each bound as the scorer's own score or above
it. What stays is scored by the scorer; nothing is cut off by a count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.reference_data import WINDOW_DAYS
from tallyweave.functions.similarity import CARRIED, CARRY_FROM, DIGIT_WEIGHT, TOKEN_FLOOR, TOKEN_WEIGHT, bare_digits
from tallyweave.operators.nearest import AMOUNT, DATE, NO_DAY, _date_score
from tallyweave.sources.ledger import cut, shuffled

REFERENCE, VENDOR, NAME_FLOOR = 0.4, 0.15, 0.55
#: The most that references add whose digits don't agree.
SEEN = REFERENCE * TOKEN_WEIGHT
#: Payments of a cell, documents that one task asks a cell for, and pairs that are bounded together.
CELL, ASKED, TOGETHER = 1 << 17, 60_000, 1 << 16
#: Characters and words of a text that is bounded by its characters; longer ones may be alike to any.
_LONG, _WORDS = 64, 8
_SLACK = 1e-9


# --- texts of a cell -------------------------------------------------------------------------


class Texts:
    """Distinct texts as arrays: the sorted words of each, its fused form, and which characters belong to which word."""

    def __init__(self, texts: list[str], words: dict[str, int], letters: dict[str, int]):
        n = len(texts)
        sets = [sorted(set(t.split())) for t in texts]
        joined, fused = [" ".join(s) for s in sets], ["".join(t.split()) for t in texts]
        self.long = np.fromiter((len(j) > _LONG or len(f) > _LONG or len(s) > _WORDS for j, f, s in zip(joined, fused, sets, strict=True)), bool, n)
        for k in np.flatnonzero(self.long).tolist():
            sets[k], joined[k], fused[k] = [], "", ""
        self.size, self.fused_size, self.count = (np.fromiter(map(len, x), np.int32, n) for x in (joined, fused, sets))
        most = int(self.count.max(initial=1)) or 1
        self.word, self.word_size = np.full((most, n), -1, np.int32), np.zeros((most, n), np.int32)
        inside = np.arange(most)[:, None] < self.count
        flat = [w for own in sets for w in own]
        self.word.T[inside.T] = np.fromiter((words.setdefault(w, len(words)) for w in flat), np.int32, len(flat))
        self.word_size.T[inside.T] = np.fromiter(map(len, flat), np.int32, len(flat))
        self.codes, self.fused = _codes(joined, self.size, letters), _codes(fused, self.fused_size, letters)
        self.slot = np.cumsum(self.codes == letters.get(" ", -1), axis=0).astype(np.uint8)  # a space belongs to the word after it


def _codes(texts: list[str], size: np.ndarray, letters: dict[str, int]) -> np.ndarray:
    """Letters' numbers, a row a place and a column a text; 0 is none."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, of = np.unique(points, return_inverse=True)
    numbers = np.array([letters.setdefault(chr(c), len(letters) + 1) for c in kinds.tolist()], np.uint16 if len(kinds) < 60_000 else np.uint32)
    out = np.zeros((int(size.max(initial=1)) or 1, len(texts)), numbers.dtype)
    out.T[(np.arange(len(out))[:, None] < size).T] = numbers[of]
    return out


def _bits(codes: np.ndarray, letters: int) -> np.ndarray:
    """Per text and letter the places that hold it, one row a text."""
    table = np.zeros((codes.shape[1], letters + 1), np.uint64)
    own = np.arange(codes.shape[1])
    for j, row in enumerate(codes):
        table[own, row] |= np.uint64(1 << j)
    table[:, 0] = 0
    return table


def _row(codes: np.ndarray, letters: int) -> np.ndarray:
    """_bits of one text."""
    table: dict[int, int] = {}
    for j, c in enumerate(codes.tolist()):
        table[c] = table.get(c, 0) | 1 << j
    table.pop(0, None)
    out = np.zeros(letters + 1, np.uint64)
    out[list(table)] = np.array(list(table.values()), np.uint64)
    return out


def _step(rest: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """rest after one more letter, whose places are hit."""
    hit &= rest
    more = rest + hit
    np.bitwise_xor(rest, hit, out=rest)
    return np.bitwise_or(more, rest, out=more)


def _common(codes_a: np.ndarray, letters: int, a: np.ndarray, sizes: np.ndarray, codes: np.ndarray, b: np.ndarray, own: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Longest common subsequences of the texts a and b, pair by pair.

    own: of each pair the places of a that count, b's words that don't, and the words of b's places.
    """
    if len(a) and (a == a[0]).all():
        bits, at = _row(codes_a[:, a[0]], letters), 0
    else:
        texts, at = np.unique(a, return_inverse=True)
        bits, at = _bits(codes_a[:, texts], letters).ravel(), at.astype(np.int64) * (letters + 1)
    full = np.where(sizes >= _LONG, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(sizes, _LONG - 1).astype(np.uint64)) - np.uint64(1))
    rest = full.copy()
    for j, row in enumerate(codes):
        code = row[b]
        if not code.any():
            continue
        hit = bits[at + code]
        if own is not None:
            hit &= own[0]
            hit[(own[1] >> own[2][j][b]) & 1 == 1] = 0
        rest = _step(rest, hit)
    return np.bitwise_count(~rest & full).astype(np.int64)


def _percent(common: np.ndarray, both: np.ndarray) -> np.ndarray:
    return (400 * common + both) // np.maximum(2 * both, 1)


class Letters:
    """Which letters a text has, and how often, in 64 bits; letters beyond them are only counted."""

    def __init__(self, left: np.ndarray, right: np.ndarray, letters: int):
        often = np.bincount(right.ravel(), minlength=letters + 1)
        often[0] = 0
        known = np.argsort(-often, kind="stable")[: _LONG]
        number = np.full(letters + 1, len(known))
        number[known] = np.arange(len(known))
        number[0] = len(known)  # no letter
        counts = [self._counts(number[x], len(known)) for x in (left, right)]
        levels = sorted((-int((counts[1][:, k] >= n).sum()), n, k) for k in range(len(known)) for n in range(1, 5))[:_LONG]
        self.mask: list[np.ndarray] = []
        self.beyond: list[np.ndarray] = []
        for x, own in zip((left, right), counts, strict=True):
            mask = np.zeros(x.shape[1], np.uint64)
            for bit, (_, n, k) in enumerate(levels):
                mask |= np.where(own[:, k] >= n, np.uint64(1 << bit), np.uint64(0))
            self.mask.append(mask)
            self.beyond.append((x > 0).sum(axis=0) - np.bitwise_count(mask))

    @staticmethod
    def _counts(numbers: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((numbers.shape[1], n + 1), np.uint8)
        own = np.arange(numbers.shape[1])
        for row in numbers:
            out[own, row] += 1
        return out[:, :n]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters the texts have in common at most, in whatever order."""
        return np.bitwise_count(self.mask[0][i] & self.mask[1][j]).astype(np.int64) + np.minimum(self.beyond[0][i], self.beyond[1][j])


class Alike:
    """Bounds on the similarity of pairs of two lists of texts, in whole percents.

    Where the letters alone keep a pair below least, their bound stands; else longest common subsequences are counted.
    """

    def __init__(self, left: list[str], right: list[str], fused: bool = False):
        words: dict[str, int] = {}
        letters: dict[str, int] = {" ": 1}
        self.a, self.b = Texts(left, words, letters), Texts(right, words, letters)
        self.letters = len(letters)
        place = {t: k for k, t in enumerate(right)}
        self.twin = np.array([place.get(t, -1) if t else -1 for t in left], np.int64)
        self.blank = tuple(np.array([bool(t) and not t.split() for t in x], bool) for x in (left, right))
        self.joined = Letters(self.a.codes, self.b.codes, self.letters)
        self.fused = Letters(self.a.fused, self.b.fused, self.letters) if fused else None
        self.places = np.zeros((len(self.a.word), len(left)), np.uint64)
        for j in range(len(self.a.slot)):
            inside = np.flatnonzero(self.a.codes[j] > 0)
            self.places[self.a.slot[j][inside], inside] |= np.uint64(1 << j)

    def sets(self, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
        """token_set_ratio of pairs or above: what both have in common counts whole, the rest by its longest common subsequence."""
        a, b = self.a, self.b
        out = np.full(len(i), 100)
        open_ = ~(a.long[i] | b.long[j]) & (self.twin[i] != j)
        none = open_ & ((a.count[i] == 0) | (b.count[j] == 0))
        out[none] = 0
        at = np.flatnonzero(open_ & ~none)
        i, j, least = i[at], j[at], least[at]
        shared_a, shared_b, same, n = (np.zeros(len(at), np.int64) for _ in range(4))
        theirs = [b.word[t][j] for t in range(len(b.word))]
        for s in range(len(a.word)):
            own = a.word[s][i]
            for t, word in enumerate(theirs):
                hit = np.flatnonzero((own == word) & (own >= 0))
                if len(hit):
                    shared_a[hit] |= 1 << s
                    shared_b[hit] |= 1 << t
                    same[hit] += a.word_size[s][i[hit]]
                    n[hit] += 1
        x, y = a.size[i].astype(np.int64), b.size[j].astype(np.int64)
        same += np.maximum(n - 1, 0)
        whole = (n == a.count[i]) | (n == b.count[j])
        ends = np.where(n > 0, np.maximum(_percent(same, same + x), _percent(same, same + y)), 0)
        bound = np.where(whole, 100, np.maximum(ends, np.minimum(100, _percent(self.joined.common(i, j), x + y))))
        alone = np.flatnonzero((n == 0) & (bound >= least))
        bound[alone] = _percent(_common(a.codes, self.letters, i[alone], x[alone], b.codes, j[alone]), (x + y)[alone])
        some = np.flatnonzero((n > 0) & ~whole & (bound >= least))
        if len(some):
            i, j, x, y, same, shared = i[some], j[some], x[some], y[some], same[some], shared_a[some]
            gone = np.zeros(len(some), np.uint64)
            for s in range(len(a.word)):
                gone |= np.where((shared >> s) & 1, self.places[s][i], np.uint64(0))
            common = same + 1 + _common(a.codes, self.letters, i, x, b.codes, j, (~gone, shared_b[some], b.slot))
            bound[some] = np.minimum(100, np.maximum(_percent(common, x + y), ends[some]))
        out[at] = bound
        return out

    def names(self, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
        """names_alike of pairs or above, 0 to 1: words, fused words, and one name inside the other, at most as far as they have letters in common."""
        x, y = self.a.fused_size[i].astype(np.int64), self.b.fused_size[j].astype(np.int64)
        out = self.sets(i, j, np.floor(100 * least)) / 100
        out[self.blank[0][i] & self.blank[1][j]] = 1.0  # nothing but spaces of other kinds
        at = np.flatnonzero(~(self.a.long[i] | self.b.long[j]) & (x > 0) & (y > 0) & (out < least))
        i, j, x, y, least = i[at], j[at], x[at], y[at], least[at]
        views = lambda common, x, y: np.maximum(_percent(common, x + y), 0.9 * _percent(common, np.minimum(x, y) + common)) / 100
        bound = views(self.fused.common(i, j), x, y)
        open_ = np.flatnonzero(bound >= least - _SLACK)
        bound[open_] = views(_common(self.a.fused, self.letters, i[open_], x[open_], self.b.fused, j[open_]), x[open_], y[open_])
        out[at] = np.maximum(out[at], bound)
        return out


class Slide:
    """References of payments in a fixed order, beside which one text at a time slides."""

    def __init__(self, alike: Alike, numbers: np.ndarray):
        """numbers: of each payment its reference's, -1 for none."""
        b = alike.b
        self.alike, self.numbers = alike, numbers
        at = np.where(numbers >= 0, numbers, 0)
        self.there = numbers >= 0
        some = len(b.size) > 0
        kind = np.uint8 if alike.letters < 255 else b.codes.dtype
        self.codes = np.where(self.there, b.codes[:, at], 0).astype(kind) if some else np.zeros((1, len(at)), kind)
        self.size = np.where(self.there, b.size[at], 0) if some else np.zeros(len(at), np.int32)
        self.words = np.where(self.there, b.word[:, at], -1) if some else np.zeros((0, len(at)), np.int32)
        self.odd = self.there & (b.long[at] | (b.count[at] == 0)) if some else np.zeros(len(at), bool)
        self.mask = np.where(self.there, alike.joined.mask[1][at], np.uint64(0)) if some else np.zeros(len(at), np.uint64)
        self.beyond = np.where(self.there, alike.joined.beyond[1][at], 0) if some else np.zeros(len(at), np.int64)
        self.most = int(self.size.max(initial=0))
        #: The letters that are left without a word, in order; for texts of few words.
        self.rests: list[np.ndarray] = []
        if some and len(self.words) <= 4:
            for t in range(len(self.words)):
                left = np.where(b.slot[:, at] == t, 0, self.codes).astype(kind)
                if t == 0:  # of the words after it the first has no space before it
                    left[(np.cumsum(left > 0, axis=0) == 1) & (left == 1)] = 0
                left = np.take_along_axis(left, np.argsort(left == 0, axis=0, kind="stable"), axis=0)
                self.rests.append(left[: max(1, int((left > 0).sum(axis=0).max(initial=0)))])

    def best(self, text: int, s: int, e: int, least: np.ndarray) -> np.ndarray:
        """alike.sets of the text and the references from s to e, in percents; 0 where there is none."""
        a, alike = self.alike.a, self.alike
        out = np.zeros(e - s, np.int64)
        apart = self.odd[s:e].copy()
        known = not a.long[text] and a.count[text] > 0
        if not known:
            apart = self.there[s:e]
        else:
            same, n = np.zeros(e - s, np.int32), np.zeros(e - s, np.int8)
            hits: list[tuple[int, int, np.ndarray]] = []
            for k in range(int(a.count[text])):
                for t, own in enumerate(self.words):
                    hit = own[s:e] == a.word[k, text]
                    same += hit * a.word_size[k, text]
                    n += hit
                    hits.append((k, t, hit))
            apart |= n > 0
            size = int(a.size[text])
            kind = np.uint16 if size <= 16 else np.uint32 if size <= 32 else np.uint64
            table = _row(a.codes[:, text], alike.letters).astype(kind)
            full = kind((1 << size) - 1)
            rest = np.full(e - s, full, kind)
            for row in self.codes[: self.most]:
                rest = _step(rest, table[row[s:e]])
            percents = _percent(*np.meshgrid(np.arange(size + 1), size + np.arange(self.most + 1), indexing="ij"))
            out = np.where(self.there[s:e], percents[np.bitwise_count(~rest & full), self.size[s:e]], 0)
        at = np.flatnonzero(apart & (least <= 100))
        out[apart] = 0
        if known:  # pairs that share words: first by their letters and the words themselves
            both = size + self.size[s:e][at].astype(np.int64)
            shared = (same[at] + np.maximum(n[at] - 1, 0)).astype(np.int64)
            letters = np.bitwise_count(alike.joined.mask[0][text] & self.mask[s:e][at]).astype(np.int64) + np.minimum(alike.joined.beyond[0][text], self.beyond[s:e][at])
            bound = np.maximum(_percent(letters, both), _percent(shared, shared + np.minimum(size, both - size)))
            open_ = np.flatnonzero((bound >= least[at]) | self.odd[s:e][at])
            at, both, shared = at[open_], both[open_], shared[open_]
            ends = _percent(shared, shared + np.minimum(size, both - size))
            one = (n[at] == 1) & ~self.odd[s:e][at] & (ends < 100) & bool(self.rests)
            for k, t, hit in hits if one.any() else ():
                own = np.flatnonzero(one & hit[at])
                if not len(own):
                    continue
                table = _row(np.where(a.slot[:, text] == k, 0, a.codes[:, text]), alike.letters).astype(kind)
                left, rest = full & ~kind(alike.places[k, text]), np.full(len(own), full, kind)
                for row in self.rests[t]:
                    rest = _step(rest, table[row[s:e][at[own]]])
                common = shared[own] + 1 + np.bitwise_count(~rest & left).astype(np.int64)
                out[at[own]] = np.minimum(100, np.maximum(_percent(common, both[own]), ends[own]))
            at = at[~one]
        if len(at):
            out[at] = alike.sets(np.full(len(at), text), self.numbers[s:e][at], least[at])
        return out


# --- pairs of a cell -------------------------------------------------------------------------


def _interval(gross: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The amounts whose amount score is least or more, a little wider; the first above the last where there are none."""
    size = np.abs(gross)
    near = np.maximum(50_000, np.floor(size * 0.12 + 0.5))
    zero = np.maximum(near, np.floor(size * 0.5 + 0.5))

    def far(a: np.ndarray) -> np.ndarray:
        d = np.where(a >= 0.55, (1 - a) / 0.45 * near, np.maximum(near, zero - a / 0.55 * (zero - near)))
        return np.where(a > 1 + _SLACK, -1.0, np.where(a <= _SLACK, 2.0**62, np.maximum(d, 0) + 2))

    below, above = far(least), far(least / 0.6)
    edge = lambda x: np.clip(x, -(2.0**62), 2.0**62).astype(np.int64)
    return edge(np.where(below < 0, 2.0**62, np.floor(gross - below))), edge(np.where(below < 0, -(2.0**62), np.where(above < 0, gross, np.ceil(gross + above))))


def _slots(lists: list[list[str]], known: dict[str, int]) -> np.ndarray:
    """Numbers of each row's texts, a row a place and a column a list; -1 is none."""
    out = np.full((max(map(len, lists), default=0), len(lists)), -1, np.int64)
    for k, own in enumerate(lists):
        for s, t in enumerate(own):
            out[s, k] = known.setdefault(t, len(known))
    return out


def reaching(ask: dict, pay: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ask, rows of pay) of the pairs whose composite may reach the asking row's bar without agreement of digits.

    Both have day, refs, name (canonical) and vendor; ask has gross and bar, pay has amount. Null days are NO_DAY.
    """
    order = np.argsort(pay["amount"], kind="stable")
    amount, day = pay["amount"][order], pay["day"][order]
    stretch = np.where(day == NO_DAY, NO_DAY, day // WINDOW_DAYS)
    kinds, kind = np.unique(stretch, return_inverse=True)
    n = len(order)
    dated = np.argsort(kind, kind="stable")
    keys = kind[dated].astype(np.int64) * (n + 1) + dated
    refs_known: tuple[dict, dict] = ({}, {})
    ask_refs = _slots(ask["refs"], refs_known[0])
    pay_refs = _slots(pay["refs"], refs_known[1])[:, order]
    refs = Alike(list(refs_known[0]), list(refs_known[1]))
    names_known: tuple[dict, dict] = ({}, {})
    ask_name = np.array([names_known[0].setdefault(x or "", len(names_known[0])) for x in ask["name"]], np.int64)
    pay_name = np.array([names_known[1].setdefault(x or "", len(names_known[1])) for x in pay["name"]], np.int64)[order]
    names = Alike(list(names_known[0]), list(names_known[1]), fused=True)
    vendors: dict[str, int] = {}
    number = lambda x, none: none if x is None else vendors.setdefault(x, len(vendors))
    ask_vendor = np.array([number(x, -1) for x in ask["vendor"]], np.int64)
    pay_vendor = np.array([number(x, -2) for x in pay["vendor"]], np.int64)[order]

    gross, own_day, bar = ask["gross"], ask["day"], ask["bar"] - _SLACK
    by_refs = np.where((ask_refs >= 0).any(axis=0), SEEN, 0.0) if len(pay_refs) and len(ask_refs) else np.zeros(len(gross))
    need = bar - by_refs - VENDOR
    parts = []
    for near, floor in ((False, need), (True, need - DATE)):
        low, high = _interval(gross, floor / AMOUNT)
        first, last = np.searchsorted(amount, low, "left"), np.searchsorted(amount, high, "right")
        if not near:
            parts.append((near, first, np.maximum(last, first)))
            continue
        for step in (-1, 0, 1):
            place = np.searchsorted(kinds, own_day // WINDOW_DAYS + step)
            there = (own_day != NO_DAY) & (place < len(kinds)) & (kinds[np.minimum(place, len(kinds) - 1)] == own_day // WINDOW_DAYS + step)
            begin, end = (np.searchsorted(keys, place * (n + 1) + x) for x in (first, last))
            parts.append((near, begin, np.where(there, np.maximum(end, begin), begin)))
    slides = {near: [Slide(refs, row[at]) for row in pay_refs] for near, at in ((False, np.arange(n)), (True, dated))}
    settled = {False: amount.astype(float), True: amount[dated].astype(float)}
    size = np.abs(gross).astype(float)
    near_band = np.maximum(50_000, np.floor(size * 0.12 + 0.5))
    zero_band = np.maximum(near_band, np.floor(size * 0.5 + 0.5))
    dated_day = day[dated]

    def bounded(k: int, near: bool, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Places from s to e whose money, date and references leave it to the names whether row k's bar is reached, and those scores."""
        paid, g, inner, outer = settled[near][s:e], float(gross[k]), near_band[k], zero_band[k]
        d = np.abs(paid - g)
        score = np.where(d <= inner, 1 - 0.45 / inner * d, np.maximum(0.55 / max(outer - inner, 1) * (outer - d), 0))
        score *= np.where(paid > g, 0.6 * AMOUNT, AMOUNT)
        if near:
            gap = dated_day[s:e] - own_day[k]
            score += DATE * _date_score(gap)
            score[np.abs(gap) > WINDOW_DAYS] = -1
        least = np.where(score < need[k], 101, np.ceil(100 * (TOKEN_FLOOR + (1 - TOKEN_FLOOR) / SEEN * (bar[k] - VENDOR - score)) - 1e-6))
        best = np.zeros(e - s, np.int64)
        for text in ask_refs[:, k]:
            for slide in slides[near]:
                if text >= 0:
                    best = np.maximum(best, slide.best(int(text), s, e, least))
        score += SEEN / (1 - TOKEN_FLOOR) * np.maximum(best / 100 - TOKEN_FLOOR, 0)
        at = np.flatnonzero(score >= bar[k] - VENDOR)
        return at + s, score[at]

    def named(held: list[tuple[int, bool, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        d = np.repeat([k for k, *_ in held], [len(at) for _, _, at, _ in held])
        p = np.concatenate([dated[at] if near else at for _, near, at, _ in held])
        score = np.concatenate([x for *_, x in held])
        alike = np.where(ask_vendor[d] == pay_vendor[p], 1.0, 0.0)
        open_ = np.flatnonzero((alike < 1) & (score < bar[d]))
        least = NAME_FLOOR + (1 - NAME_FLOOR) / VENDOR * (bar[d[open_]] - score[open_]) - _SLACK
        alike[open_] = names.names(ask_name[d[open_]], pay_name[p[open_]], least)
        keep = score + VENDOR / (1 - NAME_FLOOR) * np.maximum(alike - NAME_FLOOR, 0) >= bar[d] - _SLACK
        return d[keep], order[p[keep]]

    held: list[tuple[int, bool, np.ndarray, np.ndarray]] = []
    count = 0
    for k in range(len(gross)):
        for near, begin, end in parts:
            for s in range(int(begin[k]), int(end[k]), TOGETHER):
                at, score = bounded(k, near, s, min(s + TOGETHER, int(end[k])))
                if len(at):
                    held.append((k, near, at, score))
                    count += len(at)
                if count >= TOGETHER:
                    yield named(held)
                    held, count = [], 0
    if held:
        yield named(held)


_MET = pa.schema([("id", pa.string()), ("payment_id", pa.string())])


def _in_cell(asked: pa.Table, paid: pa.Table) -> pa.Table:
    if not asked.num_rows or not paid.num_rows:
        return _MET.empty_table()
    numbers = lambda t, c, kind=np.int64: t.column(c).to_numpy(zero_copy_only=False).astype(kind)
    lists = lambda t: {"refs": [x or [] for x in t.column("refs").to_pylist()], "name": t.column("name").to_pylist(), "vendor": t.column("vendor").to_pylist(), "day": numbers(t, "day")}
    asked = asked.sort_by("gross")
    ids, payment_ids = asked.column("id").combine_chunks(), paid.column("payment_id").combine_chunks()
    found = list(reaching(lists(asked) | {"gross": numbers(asked, "gross"), "bar": numbers(asked, "bar", float)}, lists(paid) | {"amount": numbers(paid, "amount")}))
    a, p = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
    return pa.Table.from_arrays([ids.take(pa.array(a)), payment_ids.take(pa.array(p))], schema=_MET)


def _cells_to_ask(bounds: list[tuple[int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches of documents: each beside every cell in which money and date may reach its bar."""
    cells, lows, highs = (np.array([b[k] for b in bounds], np.int64) for k in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            gross, bar = (table.column(c).to_numpy(zero_copy_only=False) for c in ("gross", "bar"))
            refs = np.array([bool(x) for x in table.column("refs").to_pylist()], bool)
            need = bar - _SLACK - np.where(refs, SEEN, 0.0) - VENDOR - np.where(table.column("day").to_numpy(zero_copy_only=False) != NO_DAY, DATE, 0.0)
            low, high = _interval(gross, need / AMOUNT)
            for at in range(0, len(gross), max(1, (1 << 22) // len(cells))):
                part = slice(at, at + max(1, (1 << 22) // len(cells)))
                row, cell = np.nonzero((low[part, None] <= highs) & (high[part, None] >= lows))
                for k in range(0, len(row), 1 << 14):
                    out = table.take(pa.array(row[k : k + (1 << 14)] + at)).append_column("cell", pa.array(cells[cell[k : k + (1 << 14)]].astype(np.int32)))
                    yield from out.combine_chunks().to_batches()

    return run


def reaching_pairs(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """id, payment_id of every pair that may reach its document's bar without agreement of digits, and few others.

    docs has id, gross, day, bar, refs (values), name, vendor; lines payment_id, amount, day, refs, name, vendor.
    """
    cells = max(1, math.ceil(lines.count() / CELL))
    placed = cut(lines.repartitionByRange(cells, "amount", "payment_id").withColumn("cell", F.spark_partition_id()))
    # a row per CELL payments
    bounds = sorted(tuple(r) for r in placed.groupBy("cell").agg(F.min("amount"), F.max("amount")).collect())
    if not bounds or not docs.limit(1).count():
        return docs.sparkSession.createDataFrame([], "id string, payment_id string")
    spark = docs.sparkSession
    kind = "id string, gross long, day int, bar double, refs array<string>, name string, vendor string"
    asks = docs.select(*[c.split()[0] for c in kind.split(", ")]).mapInArrow(_cells_to_ask(bounds), f"{kind}, cell int")
    counts = asks.groupBy("cell").count().collect()  # a row a cell
    at_most = min(ASKED, max(1_000, math.ceil(sum(r["count"] for r in counts) / (4 * spark.sparkContext.defaultParallelism))))
    parts = {r["cell"]: math.ceil(r["count"] / at_most) for r in counts}
    n = max(1, sum(parts.values()))
    # a task a group: labels whose hashes fall on different partitions, which Spark neither mixes nor merges as the number is given
    labels = {r["at"]: r["id"] for r in spark.range(40 * n).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("at")).groupBy("at").agg(F.min("id").alias("id")).collect()}
    free = iter([labels.get(k, 40 * n + k) for k in range(n)])
    loads = F.broadcast(spark.createDataFrame([(c, [next(free) for _ in range(k)]) for c, k in parts.items()], "of_cell int, labels array<int>"))
    of_cell = F.col("cell") == F.col("of_cell")
    asks = asks.join(loads, of_cell).withColumn("task", F.get("labels", F.pmod(F.hash("id"), F.size("labels")))).drop("of_cell", "labels")
    pays = placed.join(loads, of_cell).withColumn("task", F.explode("labels")).drop("of_cell", "labels")
    return asks.repartition(n, "task").groupBy("task").cogroup(pays.repartition(n, "task").groupBy("task")).applyInArrow(_in_cell, "id string, payment_id string")


# --- pairs whose digits agree ----------------------------------------------------------------


def _digit_keys(digits: Column, least: int, whole: str, parts: str) -> Column:
    """Structs (key, size) of the digits as they are, and without leading zeros whole and by their beginnings and ends.

    Rows of both sides that share a key have digits that agree: the same, or one at an end of the other.
    """
    bare = bare_digits(digits)
    size = F.length(bare)
    struct = lambda kind, text: F.struct(F.concat(F.lit(kind), text).alias("key"), size.alias("size"))
    lengths = F.filter(F.sequence(F.lit(least), F.greatest(size - 1, F.lit(least))), lambda n: n < size)
    cuts = F.array_distinct(F.concat(F.transform(lengths, lambda n: F.substr(bare, F.lit(1), n)), F.transform(lengths, lambda n: F.substr(bare, size - n + 1, n))))
    enough = size >= least
    none = F.array().cast("array<struct<key:string,size:int>>")
    own = F.when(digits != "", F.array(F.struct(F.concat(F.lit("="), digits).alias("key"), size.alias("size")))).otherwise(none)
    same = F.when(enough, F.array(struct(whole, bare), struct(parts, bare))).otherwise(none)
    return F.concat(own, same, F.when(enough, F.transform(cuts, lambda t: struct(parts, t))).otherwise(none))


def agreeing_pairs(docs: DataFrame, lines: DataFrame, near: Callable[[Column, Column], Column], close: Callable[[Column], Column], least: int = 4) -> DataFrame:
    """id, payment_id of pairs whose digits agree and may reach the document's bar; rows have digits, an array.

    near and close: the scores of amounts (gross, amount) and of a gap in days.
    """
    keys = lambda rows, whole, parts, *own: rows.select(*own, F.explode(F.array_distinct(F.flatten(F.transform("digits", lambda d: _digit_keys(d, least, whole, parts))))).alias("k")).select(*own, "k.*")
    asked = keys(docs, "a", "b", "id", "gross", "day", "bar")
    paid = keys(lines, "b", "a", "payment_id", "amount", "day").withColumnsRenamed({"day": "paid_day", "size": "paid_size"})
    met = asked.join(shuffled(paid), "key")
    shorter, longer = F.least("size", "paid_size"), F.greatest("size", "paid_size")
    share = F.when(F.startswith("key", F.lit("=")) | (longer == 0), 1.0).otherwise(shorter / longer)
    most = F.greatest(TOKEN_WEIGHT + DIGIT_WEIGHT * share, F.when(share >= CARRY_FROM, CARRIED * share).otherwise(0.0))
    date = F.when((F.col("day") != NO_DAY) & (F.col("paid_day") != NO_DAY), close(F.col("paid_day") - F.col("day"))).otherwise(0.0)
    bound = AMOUNT * near(F.col("gross"), F.col("amount")) + DATE * date + REFERENCE * most + VENDOR
    return met.where(bound >= F.col("bar") - _SLACK).select("id", "payment_id").distinct()

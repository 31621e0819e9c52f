"""Helpers that the operators share: word hashes of Arrow text columns, and places for checkpoints.

Words are hashed in numpy over the raw UTF-8 buffer of a whole Arrow batch, in blocks of about
BLOCK bytes, so that memory stays bounded by a block (or one word) however long a text is.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

BLOCK = 2_000_000
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64

#: Byte classes. 0 separates words; a word is a run of one class.
_SPACE = [0x20, *range(0x09, 0x0E)]
WORDS = np.ones(256, np.uint8)
WORDS[_SPACE] = 0
#: Letters, digits, "_" and all non-ASCII bytes are class 1, ASCII punctuation is class 2.
WORDS_AND_MARKS = np.full(256, 2, np.uint8)
WORDS_AND_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
WORDS_AND_MARKS[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_ODD))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a text column; null counts as empty."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def word_hashes(column: pa.Array, classes: np.ndarray = WORDS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the n + 1 offsets of each text's words.

    Equal words have equal hashes in every batch and task. lower folds A-Z only.
    """
    data, at = utf8(column)
    hashes, starts = [], []
    edges, begin = [0], 0
    while begin < len(data):
        end = min(begin + BLOCK, len(data))
        if end < len(data):  # to the next separator or text, whichever comes first
            stop = int(at[np.searchsorted(at, end)])
            for look in range(end, stop, 1 << 16):
                free = np.flatnonzero(classes[data[look : min(look + (1 << 16), stop)]] == 0)
                if len(free):
                    stop = look + int(free[0])
                    break
            end = stop
        edges.append(end)
        begin = end
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = data[a:b]
        kind = classes[part]
        fresh = np.empty(len(part), bool)
        fresh[0] = True
        np.not_equal(kind[1:], kind[:-1], out=fresh[1:])
        own = at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a
        fresh[own] = True
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(part))
        word = kind[first] > 0
        first, last = first[word], last[word]
        up, down = _powers(1 << max(21, int(len(part)).bit_length()))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[_LOWER[part] if lower else part] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
        starts.append(first + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(starts, at)


def chain(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words inside each text, with offsets; a text of fewer words has none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    keep = len(hashes) - n + 1
    out = hashes[:keep]
    for k in range(1, n):
        out = mix(out * _U(_ODD) + hashes[k : keep + k] + _U(k))
    counts = np.diff(offsets)
    inside = np.maximum(counts - n + 1, 0)
    mask = np.zeros(keep + 1, np.int64)
    some = inside > 0
    np.add.at(mask, offsets[:-1][some], 1)
    np.add.at(mask, offsets[:-1][some] + inside[some], -1)
    return out[np.cumsum(mask[:-1]) > 0], np.append(0, np.cumsum(inside))


def pieces(column: pa.Array, most: int = 2 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of a text column with about most bytes each, one text at least."""
    size = pa.compute.fill_null(pa.compute.binary_length(column.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(column)]
    return zip(edges[:-1], edges[1:], strict=True)


def checkpoints(spark: SparkSession) -> None:
    """Makes checkpoint() usable: the session's own spark.checkpoint.dir, else (on one machine, as in tests) a folder of ours."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and read from there."""
    checkpoints(df.sparkSession)
    return df.checkpoint()

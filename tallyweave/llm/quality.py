"""Quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Features are the words, runs of marks, pairs of neighbours and a sign for a word right after itself,
hashed to WIDTH slots; a document's vector has the square roots of its counts, scaled to length 1.
The bounded labelled sample is dealt over up to SHARES shares by a hash of doc_id and sorted in each,
so that models depend neither on the input's partitions nor on the number of tasks. Each share trains
by FTRL-proximal updates, one document at a time; the weights are averaged by rows, and a second
round starts from that average. Scores are sparse dot products, put on the scale of a chance by
logistic regression on spare labelled rows that no share trains on. Weights have a fixed width, so the model that is broadcast is 4 MB whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.labelled import BOUND, CHUNK, fold, labelled_texts, logistic, summed
from tallyweave.llm.textblocks import WORDS_AND_MARKS, cut, mix, pieces, word_hashes

BITS = 20
WIDTH = 1 << BITS
ROUNDS = 2
#: Shares of the labelled sample that train apart, at most, and the labels that each has at least; up to BOUND / SHARES, about.
SHARES, PER_SHARE = 16, 4096
#: FTRL-proximal: learning rate, its offset, and the two regularisers.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-4
THRESHOLD = 0.3
#: Of five folds by crc32 of doc_id, the one whose labels are never read.
FOLDS, HELD_OUT = 5, 0
_U = np.uint64


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and values of all documents' vectors one after another, and the n + 1 offsets. Slot 0 is the constant 1."""
    words, at = word_hashes(text, WORDS_AND_MARKS, lower=False)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    same_doc = doc[1:] == doc[:-1]
    left, right = words[:-1][same_doc], words[1:][same_doc]
    pair = np.where(left == right, mix(np.full(len(left), 5, np.uint64)), mix(left * _U(3) + right))
    slot = np.concatenate([words, pair]) >> _U(64 - BITS)
    key = np.concatenate([doc, doc[1:][same_doc]]) << BITS | np.maximum(slot.astype(np.int64), 1)
    key, count = np.unique(key, return_counts=True)
    of, value = key >> BITS, np.sqrt(count)
    value /= np.sqrt(np.bincount(of, weights=count, minlength=n))[of]
    key, value = np.append(key, np.arange(n) << BITS), np.append(value, np.ones(n))
    by = np.argsort(key, kind="stable")
    return key[by] & (WIDTH - 1), value[by], np.searchsorted(key[by] >> BITS, np.arange(n + 1))


class Ftrl:
    """FTRL-proximal state: z and n per slot, starting from given weights."""

    def __init__(self, start: np.ndarray):
        self.n = np.zeros(WIDTH)
        self.z = -start.astype(np.float64) * (BETA / ALPHA + L2) - np.sign(start) * L1

    def weights(self, slots: np.ndarray | slice) -> np.ndarray:
        z = self.z[slots]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(self.n[slots])) / ALPHA + L2)

    def update(self, slots: np.ndarray, values: np.ndarray, y: float) -> None:
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        g = (p - y) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


def products(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    """The sparse dot product of each text's vector with the weights."""
    out = np.zeros(len(text))
    for a, b in pieces(text):
        slots, values, at = features(text[a:b])
        total = np.append(0, np.cumsum(weights[slots] * values))
        out[a:b] = total[at[1:]] - total[at[:-1]]
    return out


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> tuple[np.ndarray, float, float]:
    """Weights, offset and slope from the labelled documents outside the held-out fold; about bound of them at most."""
    keep = fold(F.col("doc_id"), FOLDS) != HELD_OUT
    shares = max(1, min(SHARES, min(labels.where(keep & F.col("quality").isNotNull()).count(), bound) // PER_SHARE))
    rows = labelled_texts(docs, labels, "quality", keep, bound)
    turn = F.xxhash64(F.lit(13), "doc_id")
    rows = rows.select("text", "y", F.pmod(turn, F.lit(shares)).cast("int").alias("part"), turn.alias("turn"), "doc_id", "spare")
    both = cut(rows.repartition(shares, "part").sortWithinPartitions("part", "turn", "doc_id", "text").select("text", "y", "part", "spare"))
    rows = both.where("NOT spare").select("text", "y", "part")
    context, weights = docs.sparkSession.sparkContext, np.zeros(WIDTH, np.float32)
    for _ in range(ROUNDS):
        sent = context.broadcast(weights)

        def train(batches: Iterator[pa.RecordBatch], sent=sent) -> list[np.ndarray]:
            total, share = np.zeros(WIDTH), np.zeros(CHUNK)
            model, part, seen = None, None, 0

            def finish() -> None:
                if seen:
                    total[:] += model.weights(slice(None)) * seen
                    share[0] += seen

            for batch in batches:
                for a, b in pieces(batch.column(0)):
                    slots, values, at = features(batch.column(0)[a:b])
                    for i, (y, own) in enumerate(zip(batch.column(1)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist(), strict=True)):
                        if own != part:  # a task may hold several shares
                            finish()
                            model, part, seen = Ftrl(sent.value), own, 0
                        model.update(slots[at[i] : at[i + 1]], values[at[i] : at[i + 1]], float(y))
                        seen += 1
            finish()
            return [total.astype(np.float32), share] if share[0] else []

        total, share = summed(rows, train, [(WIDTH, np.float32), (CHUNK, np.float32)])
        weights = (total / max(share[0], 1)).astype(np.float32)
    sent = context.broadcast(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(products(batch.column(0), sent.value)), batch.column(1)], names=["x", "y"])

    measured = both.where("spare").select("text", "y").mapInArrow(measure, "x double, y int").toPandas()  # an eighth of bound
    if measured["y"].nunique() < 2:
        return weights, 0.0, 1.0
    return weights, *logistic(measured["x"].to_numpy(), measured["y"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts have the constant feature alone. Without any label all scores are 0.5; spare
    rows of one class leave the product's own scale.
    Repeated rows each give a row; other columns are not read. An empty table gives an empty result.
    """
    weights, offset, slope = fit(docs, labels, bound)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(offset + slope * products(text, sent.value), -30, 30))))

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

"""Toxicity by two class-conditional Kneser-Ney models of expressions.

An expression is a word with its left neighbour. Both classes' models predict a word from the group
of its text (h) and back off to one shared distribution:

    p_class(w | h) = max(c_class(h, w) - D_class(h), 0) / c_class(h) + mass * p_shared(w)

c counts a word's left neighbours in the class's texts of that group or, if fewer, those texts: a
passage that many texts copy counts like one. p_shared is Kneser-Ney's continuation distribution, a
word's distinct left neighbours, summed over both classes and all groups, discounted by n1 / (n1 + 2 n2);
what that frees is spread over the vocabulary and one unknown word. The absolute discount D of each
class and group is the one that frees the same mass in all of them. So an expression that is rare in
both classes has the shared probability in both and cancels exactly, as do unknown words; only words
counted more often than D differ. Groups are of like spelling (at most GROUPS, spherical k-means of
letter pair frequencies, labels unseen); they keep the classes' shares of languages out of the score.

The score is the difference of the log-likelihoods of a text's distinct expressions by their number
(and some neutral ones, so that a short text isn't judged by one chance word), put on the scale of a
chance by logistic regression on spare labelled rows, which also choose the mass and the number of
neutral expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.labelled import BOUND, fold, labelled_texts, logistic
from tallyweave.llm.textblocks import WORDS_AND_MARKS, cut, mix, pieces, utf8, word_hashes

#: Groups of texts at most, texts that they are found on (about, at most), slots of letter pairs, cosine from which two are one group.
GROUPS, SAMPLE, PAIRS, ALIKE = 6, 4096, 512, 0.85
#: Shares of the probability that may go to the shared distribution, least first.
MASSES = (0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
#: Numbers of neutral expressions that each text may be taken to have beside its own.
CALMS = (8, 16, 32, 64, 128, 256)
#: Texts worked on at once at most.
TEXTS = 4096
THRESHOLD = 0.3
#: Of four folds by crc32 of doc_id, the one whose labels are never read.
FOLDS, HELD_OUT = 4, 2
SLOTS = 2 * GROUPS
#: Letters, digits and "_" make words; marks and white space part them.
_LETTERS = np.where(WORDS_AND_MARKS == 1, 1, 0).astype(np.uint8)
_START = np.uint64(7)
_U = np.uint64


def _ranges(text: pa.Array) -> Iterator[tuple[int, int]]:
    for a, b in pieces(text):
        for x in range(a, b, TEXTS):
            yield x, min(b, x + TEXTS)


def expressions(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct expressions of each text: their text's place, the left neighbour's and the word's hash (of 48 bits, to move less)."""
    words, at = word_hashes(text, _LETTERS)
    words = words & _U((1 << 48) - 1)
    left = np.roll(words, 1)
    if len(words):
        left[at[:-1][np.diff(at) > 0]] = _START
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    _, first = np.unique(mix(mix(left * _U(3) + words) + doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), return_index=True)
    first.sort()
    return doc[first], left[first], words[first]


def letter_pairs(text: pa.Array) -> np.ndarray:
    """A row per text: square roots of the counts of its letter pairs (two bytes of words, or one and a gap), hashed."""
    data, at = utf8(text)
    n = len(at) - 1
    if len(data) < 2:
        return np.zeros((n, PAIRS), np.float32)
    plain = np.where(_LETTERS[data] > 0, data | np.uint8(0x20), np.uint8(0)).astype(np.int64)
    pair = plain[:-1] * 257 + plain[1:]
    keep = pair > 0
    inside = np.ones(len(data), bool)
    inside[at[(at > 0) & (at < len(data))]] = False  # no pair across two texts
    keep &= inside[1:]
    doc = np.repeat(np.arange(n), np.diff(at))[:-1]
    slot = ((pair * 2654435761) >> 13) % PAIRS
    return np.sqrt(np.bincount((doc * PAIRS + slot)[keep], minlength=n * PAIRS)).reshape(n, PAIRS).astype(np.float32)


def group_centres(vectors: np.ndarray, most: int = GROUPS, rounds: int = 12) -> np.ndarray:
    """Centres of at most so many groups of unit vectors, from far ones on; those alike become one. Depends on the order of rows only by ties."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    vectors = unit(vectors[np.linalg.norm(vectors, axis=1) > 0])
    if not len(vectors):
        return np.zeros((1, PAIRS), np.float32)
    centres = vectors[[int(np.argmin(vectors @ unit(vectors.mean(axis=0))))]]
    while len(centres) < min(most, len(vectors)):
        near = (vectors @ centres.T).max(axis=1)  # the farthest fiftieth may be odd ones out
        centres = np.concatenate([centres, vectors[[int(np.argsort(near, kind="stable")[len(near) // 50])]]])

    def settled(centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            own = (vectors @ centres.T).argmax(axis=1)
            centres = np.stack([unit(vectors[own == k].mean(axis=0)) if (own == k).any() else centres[k] for k in range(len(centres))])
        return centres, np.bincount((vectors @ centres.T).argmax(axis=1), minlength=len(centres))

    centres, sizes = settled(centres)
    kept: list[int] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        if not kept or (centres[kept] @ centres[k]).max() < ALIKE:
            kept.append(k)
    return settled(centres[sorted(kept)])[0].astype(np.float32)


def groups_of(text: pa.Array, centres: np.ndarray) -> np.ndarray:
    own = [(letter_pairs(text[a:b]) @ centres.T).argmax(axis=1) for a, b in pieces(text, 1 << 19)] if len(text) else []
    return np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64)


def _centres(rows: DataFrame, n: int) -> np.ndarray:
    """Centres from about SAMPLE of rows (text, doc_id), chosen by a hash of doc_id."""
    turn = F.pmod(F.xxhash64(F.lit(14), "doc_id"), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _ranges(batch.column(1)):
                vectors = letter_pairs(batch.column(1)[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([x.tobytes() for x in vectors], pa.binary())], names=["turn", "vector"])

    some = rows.select(turn.alias("turn"), "text").where(F.col("turn") < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    got = sorted((r["turn"], bytes(r["vector"])) for r in some.mapInArrow(run, "turn long, vector binary").collect())
    return group_centres(np.frombuffer(b"".join(v for _, v in got), np.float32).reshape(-1, PAIRS))


def word_counts(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """word, shared (its distinct left neighbours, of all slots together), counts (per slot, 2 * group + class) of rows (text, y).

    Expressions meet by both their words, so no word is hot; then a word's are few sums.
    """
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _ranges(batch.column(0)):
                text, toxic = batch.column(0)[a:b], batch.column(1)[a:b].to_numpy(zero_copy_only=False).astype(np.int64)
                slot = 2 * groups_of(text, sent.value) + toxic
                doc, left, word = expressions(text)
                _, once = np.unique(mix(word + doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), return_index=True)
                texts = np.zeros(len(word), np.int32)
                texts[once] = 1  # one of a word's expressions in a text counts the text
                own = slot[doc]
                _, first, of = np.unique(mix(mix(left * _U(3) + word) + own.astype(np.uint64)), return_index=True, return_inverse=True)
                near = (left[first] >> _U(21)).astype(np.int64) & ((1 << 27) - 1)
                columns = word[first].view(np.int64), (near << 4 | own[first]).astype(np.int32), np.bincount(of, weights=texts, minlength=len(first)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "left", "texts"])

    # left has 27 bits of the left neighbour's hash and the slot
    met = rows.mapInArrow(run, "word long, left int, texts int").groupBy("word", "left").agg(F.sum("texts").alias("texts"))
    own = [F.col("left").bitwiseAND(F.lit(15)) == k for k in range(SLOTS)]
    lefts = [F.count_if(own[k]).alias(f"lefts{k}") for k in range(SLOTS)]
    texts = [F.sum(F.when(own[k], F.col("texts")).otherwise(0)).alias(f"texts{k}") for k in range(SLOTS)]
    sums = met.groupBy("word").agg(F.count("*").alias("shared"), *lefts, *texts)
    return sums.select("word", "shared", F.array(*[F.least(f"lefts{k}", f"texts{k}") for k in range(SLOTS)]).alias("counts"))


def discount(counts: np.ndarray, times: np.ndarray, mass: float) -> float:
    """D with sum(min(c, D)) = mass * sum(c), of counts c in rising order, each so many times."""
    below = np.append(0, np.cumsum(counts * times))  # sum over the smaller ones
    above = times.sum() - np.append(0, np.cumsum(times))
    goal = mass * below[-1]
    k = int(np.searchsorted(below[:-1] + counts * above[:-1], goal))
    return float((goal - below[k]) / above[k]) if above[k] else float(counts[-1])


@dataclass
class Model:
    """The words whose count passes a discount, and what both distributions need; then the scale of the chance."""

    centres: np.ndarray
    words: np.ndarray  # sorted hashes
    shared: np.ndarray  # their continuation counts
    counts: np.ndarray  # words x slots
    totals: np.ndarray  # c(h) of each slot
    discounts: np.ndarray  # masses x slots
    continuation: tuple[float, float, float]  # sum of all continuation counts, words, discount
    mass: int = 1
    calm: int = CALMS[0]
    low: float = -np.inf
    high: float = np.inf
    offset: float = 0.0
    slope: float = 0.0
    loss: float = np.inf  # of the spare rows
    _ratios: dict[int, np.ndarray] = field(default_factory=dict)

    def p_shared(self, shared: np.ndarray | float) -> np.ndarray:
        """The shared probability of words by their continuation counts; 0 stands for the unknown word."""
        total, words, less = self.continuation
        return np.maximum(np.asarray(shared, float) - less, 0) / max(total, 1) + (less * words / max(total, 1) if words else 1.0) / (words + 1)

    def probability(self, slot: int, shared: np.ndarray, counts: np.ndarray, mass: int) -> np.ndarray:
        """p(word | group) in the class of a slot, of words by their continuation counts and their counts in the slot."""
        if not self.totals[slot]:
            return self.p_shared(shared)
        return np.maximum(counts - self.discounts[mass, slot], 0) / self.totals[slot] + MASSES[mass] * self.p_shared(shared)

    def ratios(self, mass: int) -> np.ndarray:
        """log p(word | toxic, group) - log p(word | ordinary, group): words x groups. A group that lacks a class tells nothing."""
        if mass not in self._ratios:
            out = np.zeros((len(self.words), GROUPS))
            for g in range(GROUPS):
                if self.totals[2 * g] and self.totals[2 * g + 1]:
                    ordinary, toxic = (self.probability(2 * g + c, self.shared, self.counts[:, 2 * g + c], mass) for c in (0, 1))
                    out[:, g] = np.log(toxic) - np.log(ordinary)
            self._ratios[mass] = out
        return self._ratios[mass]

    def likelihoods(self, text: pa.Array, masses: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood, toxic less ordinary, of each text under each mass, 0 without words; the number of its expressions."""
        out, numbers = np.zeros((len(text), len(masses))), np.zeros(len(text), np.int64)
        for a, b in _ranges(text) if len(self.words) else ():
            group = groups_of(text[a:b], self.centres)
            doc, _, word = expressions(text[a:b])
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            known = self.words[at] == word
            numbers[a:b] = np.bincount(doc, minlength=b - a)
            for j, mass in enumerate(masses):
                each = np.where(known, self.ratios(mass)[at, group[doc]], 0.0)
                out[a:b, j] = np.bincount(doc, weights=each, minlength=b - a)
        return out, numbers

    def chance(self, text: pa.Array) -> np.ndarray:
        found, numbers = self.likelihoods(text, [self.mass])
        x = np.clip(found[:, 0] / (numbers + self.calm), self.low, self.high)
        return 1 / (1 + np.exp(-(self.offset + self.slope * x)))


def _counted(rows: DataFrame, centres: np.ndarray) -> Model:
    """The model of rows (text, y), not yet on a scale. Counts stay on the executors but for words that pass a discount."""
    counts = cut(word_counts(rows, centres))
    each = counts.select(F.posexplode(F.concat(F.col("counts"), F.array("shared"))).alias("slot", "c")).where("c > 0")
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    frequencies = each.groupBy("slot", "c").agg(F.count("*").alias("times")).toPandas()  # distinct counts per slot
    for slot, own in frequencies.sort_values("c").groupby("slot"):
        tables[int(slot)] = own["c"].to_numpy(np.float64), own["times"].to_numpy(np.float64)
    totals, discounts = np.zeros(SLOTS), np.full((len(MASSES), SLOTS), np.inf)
    for slot in range(SLOTS):
        if slot in tables:
            totals[slot] = tables[slot][0] @ tables[slot][1]
            discounts[:, slot] = [discount(*tables[slot], mass) for mass in MASSES]
    c, times = tables.get(SLOTS, (np.zeros(0), np.zeros(0)))
    once, twice = (float(times[c == k].sum()) for k in (1, 2))
    continuation = float(c @ times), float(times.sum()), once / (once + 2 * twice) if once else 0.5
    least = discounts[0]  # the smallest mass has the smallest discounts
    passes = F.greatest(*[F.get("counts", F.lit(k)) > float(least[k]) for k in range(SLOTS)])
    borne = counts.where(passes).toPandas().sort_values("word")  # MASSES[0] * c(h) / D of each slot at most
    words = borne["word"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(words)
    table = np.array(borne["counts"].tolist(), np.float64).reshape(-1, SLOTS)
    return Model(centres, words[by], borne["shared"].to_numpy(np.float64)[by], table[by], totals, discounts, continuation)


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    """A model from the labelled documents outside the held-out fold; about bound of them at most."""
    rows = cut(labelled_texts(docs, labels, "toxic", fold(F.col("doc_id"), FOLDS) != HELD_OUT, bound))
    own = rows.where("NOT spare")
    model = _counted(own.select("text", F.when(F.col("y") == 1, 1).otherwise(0).alias("y")), _centres(own, own.count()))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, numbers = sent.value.likelihoods(batch.column(0), list(range(len(MASSES))))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(numbers), *[pa.array(found[:, j]) for j in range(len(MASSES))]], names=["y", "number", *[f"x{j}" for j in range(len(MASSES))]])

    measured = rows.where("spare").select("text", "y").mapInArrow(measure, "y int, number long, " + ", ".join(f"x{j} double" for j in range(len(MASSES)))).toPandas()  # an eighth of bound
    y, best = (measured["y"].to_numpy() == 1).astype(float), None
    for j, calm in product(range(len(MASSES)), CALMS):
        x = measured[f"x{j}"].to_numpy(float) / (measured["number"].to_numpy(float) + calm)
        low, high = (float(v) for v in np.quantile(x, [0.01, 0.99])) if len(x) else (0.0, 0.0)
        x = np.clip(x, low, high)
        offset, slope = logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-(offset + slope * x))), 1e-6, 1 - 1e-6)
        loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean()) if len(y) else 0.0
        if best is None or loss < best[0] - 1e-9:
            best = loss, j, calm, low, high, offset, slope
    model.loss, model.mass, model.calm, model.low, model.high, model.offset, model.slope = best
    return model


def chance(model: Model, df: DataFrame, text: Column) -> Column:
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.chance(text))

    return run(text.cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts score as a text without expressions. Without any label every score is near
    0, with labels of one class it is that class's share. Repeated rows each give a row; other
    columns are not read. An empty table gives an empty result.
    """
    model = fit(docs, labels, bound)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), chance(model, docs, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all its columns, without the rows predicted toxic. No row moves to another task.

    Null and empty texts stay or go as a text without expressions; repeated rows share one fate; an
    empty table stays empty. Without labels all rows stay.
    """
    return docs.where(chance(fit(docs, labels), docs, F.col("text")) < THRESHOLD)

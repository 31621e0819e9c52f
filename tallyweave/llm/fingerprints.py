"""SimHash fingerprints of documents, and search within a Hamming radius by permuted block tables.

A document's terms are its 5-word shingles (A-Z lower-cased; a shorter text is one term). Each term's
128-bit hash votes on every bit with weight 1 + log2 of the term's count, rounded down; a bit is set
where the votes are positive. Texts without words have no bit set.

For radius r a fingerprint is cut into r + 1 blocks; two within r agree in one block at least. Each
table holds the fingerprints keyed by one block (that block permuted to the front); equal keys meet,
and the distance of the whole decides. Equal fingerprints are one entry, so copies cost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.textblocks import BLOCK, chain, cut, mix, pieces, word_hashes

BITS, SHINGLE = 128, 5
#: Documents of one run of neighbouring ids, and runs at most (so many bounds are broadcast).
PER_RUN, RUNS = 4096, 20_000
_U = np.uint64
_VOTES = 1 << 15


def simhash(text: pa.Array) -> np.ndarray:
    """Fingerprints as rows of 16 bytes."""
    words, at = word_hashes(text)
    terms, to = chain(words, at, SHINGLE)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(to))
    few = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < SHINGLE))
    if len(few):
        whole = np.array([int(np.bitwise_xor.reduce(mix(words[at[i] : at[i + 1]] + np.arange(1, at[i + 1] - at[i] + 1).astype(np.uint64)))) for i in few], np.uint64)
        terms, doc = np.append(terms, whole), np.append(doc, few)
    out = np.zeros((n, BITS // 8), np.uint8)
    if not len(terms):
        return out
    key, count = np.unique(doc.astype(np.uint64) << _U(44) | terms >> _U(20), return_counts=True)  # a batch has far fewer than 2**20 texts
    doc, weight = (key >> _U(44)).astype(np.int64), (1 + np.log2(count)).astype(np.uint8)
    term = mix(key & _U((1 << 44) - 1))
    total = np.zeros((n, BITS), np.int64)
    for a in range(0, len(key), _VOTES):
        part = slice(a, a + _VOTES)
        hashes = np.stack([mix(term[part] + _U(1)), mix(term[part] + _U(2))], axis=1)
        bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8), axis=1) * weight[part, None]
        first = np.flatnonzero(np.diff(doc[part], prepend=-1))
        total[doc[part][first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    sums = np.bincount(doc, weights=weight, minlength=n).astype(np.int64)
    return np.packbits(2 * total > sums[:, None], axis=1)


def fingerprint(text: Column) -> Column:
    """16 bytes of a text column; null counts as empty."""

    @F.arrow_udf("binary")
    def run(text: pa.Array) -> pa.Array:
        out = []
        for a, b in pieces(text, BLOCK):
            out += [x.tobytes() for x in simhash(text[a:b])]
        return pa.array(out, pa.binary())

    return run(text.cast("string"))


def _half(fp: Column, k: int) -> Column:
    return F.conv(F.substring(F.hex(fp), 16 * k + 1, 16), 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(_half(a, 0).bitwiseXOR(_half(b, 0))) + F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1)))


def likeness(a: Column, b: Column) -> Column:
    """The cosine of term vectors that the distance speaks for, 0 at least."""
    return F.greatest(F.lit(0.0), F.cos(hamming(a, b) * (math.pi / BITS)))


def within_radius(entries: DataFrame, queries: DataFrame, radius: int) -> DataFrame:
    """query, entry, distance of all pairs of distinct fingerprints (column fp) no more than radius apart.

    Pairs are between fingerprints, each once, itself included; documents join back by fp. Null
    fingerprints match nothing.
    """
    blocks = min(radius, BITS) + 1  # one more than bits may differ, so one block is equal in any pair within the radius
    edges = [k * BITS // blocks for k in range(blocks + 1)]
    bits = lambda fp, k: F.substring(F.concat(*[F.lpad(F.conv(F.substring(F.hex(fp), 8 * i + 1, 8), 16, 2), 32, "0") for i in range(4)]), edges[k] + 1, edges[k + 1] - edges[k])

    def table(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(k).alias("block"), bits(F.col("fp"), k).alias("value")) for k in range(blocks)])
        return df.select("fp").where("fp IS NOT NULL").distinct().select(F.col("fp").alias(name), F.explode(keys).alias("key"))

    met = table(queries, "query").join(table(entries, "entry"), "key").withColumn("distance", hamming(F.col("query"), F.col("entry")))
    return met.where(F.col("distance") <= radius).select("query", "entry", "distance").distinct()


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp, next_text, next_fp, next being the document that follows in descending doc_id (the first follows the last).

    Ids alone are sorted first, for the bounds of runs of neighbours; then each text moves once, to
    its run, and the head of a run also to the run before it. Null ids come last; documents of one
    id follow by their texts.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    n = max(docs.count(), 1)
    runs = min(RUNS, math.ceil(n / PER_RUN))
    ranged = cut(docs.select(key.alias("key")).repartitionByRange(runs, F.col("key").desc()).select("key", F.spark_partition_id().alias("run")))
    heads = np.array(sorted((r["head"] for r in ranged.groupBy("run").agg(F.max("key").alias("head")).collect()), reverse=True), np.int64)  # RUNS at most
    sent = docs.sparkSession.sparkContext.broadcast(heads)

    @F.arrow_udf("array<int>")
    def places(keys: pa.Array) -> pa.Array:
        heads, keys = sent.value, keys.to_numpy(zero_copy_only=False)
        run = len(heads) - np.searchsorted(heads[::-1], keys, "left") - 1
        return pa.array([[r, (r - 1) % len(heads)] if head else [r] for r, head in zip(run.tolist(), heads[run] == keys, strict=True)], pa.list_(pa.int32()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    rows = rows.select("doc_id", "text", "key", fingerprint(F.col("text")).alias("fp"), F.posexplode(places("key")).alias("guard", "run"))
    order = Window.partitionBy("run").orderBy("guard", F.col("key").desc(), "text")
    return rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fp", F.lead("fp").over(order)).where("guard = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has the last third (rounded down, in code points) replaced by as many from the
    start of the next document. Null counts as empty; repeated rows each give a row; a single
    document follows itself; an empty table gives an empty result. Other columns are not read.
    """
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "next_fp", fingerprint(F.col("edited")).alias("edited_fp"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fp")).alias("fingerprint"),
        F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )

"""What the two classifiers share: labelled rows, and summing wide count or weight tables over tasks.

A bounded share of the labels (BOUND rows or a little more, chosen by a hash of doc_id) is broadcast,
so texts never move to meet their labels. Tables are sent as narrow sparse chunks and summed a chunk
at a time; their width is fixed, so what the driver gets has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most, about.
BOUND = 200_000
#: Slots of a table that travel together.
CHUNK = 1 << 15


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal id, modulo parts; null ids are in fold 1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)), F.lit(1))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int = BOUND) -> DataFrame:
    """text, y, spare, doc_id of the documents with a label and keep(doc_id) true; every eighth of them, by hash, is spare.

    Null ids and null labels don't count; an id labelled more than once has its largest label.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(keep)
    share = bound / max(known.count(), 1)
    if share < 1:
        known = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumnRenamed("doc_id", "labelled_id")
    spare = F.pmod(F.xxhash64(F.lit(12), "labelled_id"), F.lit(8)) == 0
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(known), F.col("doc_id") == F.col("labelled_id")).select("text", "y", spare.alias("spare"), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Offset and slope of y on x by Newton steps with a small ridge; the share of y alone if x can't tell."""
    if not len(y) or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4))
        return float(np.log(rate / (1 - rate))), 0.0
    mean, spread = float(x.mean()), float(x.std()) or 1.0
    z, beta = np.c_[np.ones(len(x)), (x - mean) / spread], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (p - y) + 0.01 * beta
        beta -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2), gradient)
    return float(beta[0] - beta[1] * mean / spread), float(beta[1] / spread)


def summed_chunks(rows: DataFrame, gather: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray]], tables: list[tuple[int, type]]) -> DataFrame:
    """chunk, values (packed float32): the sums over all tasks of the tables that gather makes of a task's batches, in one pass.

    tables gives each one's width (a multiple of CHUNK) and kind of number; their chunks are numbered in that order.
    """
    edges = np.append(0, np.cumsum([width for width, _ in tables])) // CHUNK

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, table in enumerate(gather(batches)):
            for k, part in enumerate(table.reshape(-1, CHUNK)):
                at = np.flatnonzero(part)
                if len(at):
                    values = part[at]
                    small = values.astype(np.uint16) if values.dtype.kind in "iu" and values.max() < 1 << 16 else values.astype(np.float32 if values.dtype.kind == "f" else np.int64)
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([int(edges[t]) + k], pa.int32()), "kind": [small.dtype.str], "at": [at.astype(np.uint16).tobytes()], "values": [small.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in batch.to_pylist():
                part = total.setdefault(x["chunk"], np.zeros(CHUNK, np.float64))
                part[np.frombuffer(x["at"], np.uint16)] += np.frombuffer(x["values"], x["kind"])
        for chunk, part in total.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "values": [part.astype(np.float32).tobytes()]})

    packed = rows.mapInArrow(pack, "chunk int, kind string, at binary, values binary")
    return packed.repartition("chunk").mapInArrow(add, "chunk int, values binary")


def summed(rows: DataFrame, gather: Callable[[Iterator[pa.RecordBatch]], list[np.ndarray]], tables: list[tuple[int, type]]) -> list[np.ndarray]:
    """The tables of summed_chunks, whole, on the driver."""
    edges = np.append(0, np.cumsum([width for width, _ in tables])) // CHUNK
    out = [np.zeros(width, kind) for width, kind in tables]
    for row in summed_chunks(rows, gather, tables).toLocalIterator():
        t = int(np.searchsorted(edges, row["chunk"], "right") - 1)
        k = row["chunk"] - edges[t]
        out[t][k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(row["values"], np.float32)
    return out

"""Canonical JSON, the chained journal over restarts, and settlements of streams against batches."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions.canonical_json import canonical, sealed
from tallyweave.streaming import journal

KIND = T.StructType([
    T.StructField("z", T.LongType()), T.StructField("a", T.StringType()), T.StructField("é", T.BooleanType()),
    T.StructField("m", T.MapType(T.StringType(), T.DoubleType())), T.StructField("l", T.ArrayType(T.StructType([T.StructField("y", T.DoubleType()), T.StructField("B", T.ArrayType(T.StringType()))]))),
])


def some_value(rng):
    text = lambda: rng.choice([None, "", "plain", 'quo"te', "back\\slash", "tab\tnew\nline\r\b\f", "\x00\x01\x1f", "é▁😀/", "\x7f"])
    number = lambda: rng.choice([None, 0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 1.5e-5, 123456.789, 1e7, 1.25e7, 12345678.5, 1e15, 1e16, 1.7e22, -3e-9, 1e100, 9007199254740993.0])
    inner = lambda: None if rng.random() < 0.2 else (number(), None if rng.random() < 0.2 else [text() for _ in range(rng.randrange(3))])
    keys = rng.sample(["b", "a", "Z", "é", "k\n"], rng.randrange(5))
    return (rng.choice([None, 0, -5, 2**62]), text(), rng.choice([None, True, False]), None if rng.random() < 0.2 else {k: number() for k in keys}, None if rng.random() < 0.2 else [inner() for _ in range(rng.randrange(3))])


def test_canonical_json_equals_the_library(spark):
    rng = random.Random(4)
    rows = [some_value(rng) for _ in range(300)]
    got = [r["t"] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], T.StructType([T.StructField("i", T.LongType()), T.StructField("x", KIND)])).select("i", canonical(F.col("x"), KIND).alias("t")).orderBy("i").collect()]
    plain = lambda v: {"z": v[0], "a": v[1], "é": v[2], "m": v[3], "l": None if v[4] is None else [None if x is None else {"y": x[0], "B": x[1]} for x in v[4]]}
    want = [json.dumps(plain(r), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in rows]
    assert [(g, w) for g, w in zip(got, want) if g != w][:1] == []
    seal = spark.createDataFrame([(rows[0],)], T.StructType([T.StructField("x", KIND)])).select(sealed(F.col("x"), KIND).alias("s")).first()["s"]
    assert seal["sha256"] == hashlib.sha256(want[0].encode()).hexdigest() and seal["bytes"] == len(want[0].encode())
    assert spark.sql("SELECT CAST('NaN' AS DOUBLE) AS x").select(canonical(F.col("x"), T.DoubleType()).alias("t")).first()["t"] == "null"


CHANGES = "change_id string, run_id string, case_id string, made_at timestamp, made_by string, kind string, detail string"


def changes(spark, ids):
    rows = [(f"TC-{k}", "RUN-1", None if k % 3 else f"CASE-{k}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k % 7), f"u{k % 4}", "days", f'{{"v":"{k}"}}') for k in ids]
    return spark.createDataFrame(rows, CHANGES)


def test_changes_are_appended_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(journal, "STRETCH", 5)
    where = str(tmp_path / "journal")
    read = lambda name: spark.read.parquet(f"{where}/{name}")
    stream = lambda: spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes(spark, [*range(12), 3]).coalesce(1).write.parquet(str(tmp_path / "in"))
    journal.append_changes(stream(), where, str(tmp_path / "mark")).awaitTermination()
    changes(spark, range(9, 17)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # three come again
    journal.append_changes(stream(), where, str(tmp_path / "mark")).awaitTermination()
    entries = read("entries").drop("batch")
    first = sorted(map(tuple, entries.collect()))
    assert [r[0] for r in first] == list(range(1, 18)) and read("changes").count() == 17 and read("decisions").count() == 17
    assert journal.broken_entries(entries).count() == 0
    for row, before in zip(first, [None, *first]):
        payload = dict(zip(journal.PAYLOAD, row)) | {"prev_hash": before[-1] if before else None}
        assert row[-1] == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    for number in (1, 0, 1):  # batches that come again after a restart
        journal.write_changes(changes(spark, [*range(12), 3] if number == 0 else range(9, 17)), number, where)
        assert sorted(map(tuple, read("entries").drop("batch").collect())) == first and read("changes").count() == 17
    journal.append_changes(stream(), where, str(tmp_path / "mark")).awaitTermination()
    assert read("entries").count() == 17
    bad = read("entries").drop("batch").withColumn("detail", F.when(F.col("sequence") == 4, "x").otherwise(F.col("detail"))).where("sequence <> 9")
    assert {(r["sequence"], r["problem"]) for r in journal.broken_entries(bad).collect()} == {(4, "hash"), (10, "gap")}


def test_an_empty_batch_leaves_the_tail(spark, tmp_path):
    journal.write_changes(changes(spark, [1, 2]), 0, str(tmp_path))
    journal.write_changes(changes(spark, []), 1, str(tmp_path))
    journal.write_changes(changes(spark, [5]), 2, str(tmp_path))
    assert journal.broken_entries(spark.read.parquet(f"{tmp_path}/entries")).count() == 0
    assert spark.read.parquet(f"{tmp_path}/entries").agg(F.max("sequence")).first()[0] == 3


def test_settlements_of_streams_equal_batches(spark, tmp_path):
    rng, day = random.Random(9), dt.datetime(2024, 1, 1)
    inv = [(f"I{k}", k % 40, day + dt.timedelta(days=rng.randrange(120))) for k in range(60)] + [("end", -1, day + dt.timedelta(days=900))]
    pay = [(f"P{k}", rng.choice([k % 50, None]), day + dt.timedelta(days=rng.randrange(300))) for k in range(80)] + [("end", -2, day + dt.timedelta(days=900))]
    kinds = {"inv": "id string, number long, issued_at timestamp", "pay": "payment_id string, number long, paid_at timestamp"}
    for name, rows in (("inv", inv), ("pay", pay)):
        spark.createDataFrame(rows, kinds[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    tables = [spark.read.parquet(f"{tmp_path}/{n}") for n in ("inv", "pay")]
    want = {tuple(r) for r in journal.settlements(*tables).collect()}
    streams = [spark.readStream.schema(kinds[n]).parquet(f"{tmp_path}/{n}") for n in ("inv", "pay")]
    run = journal.settlements(*streams).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {tuple(r) for r in spark.table("settled").collect()}
    assert got - {("end", None, None)} == want - {("end", None, None)}
    assert {p for p, i, _ in want if i} and {p for p, i, _ in want if i is None}
    by = {(p, i) for p, n, t in pay for i, m, s in inv if n == m and abs((t - s).days) <= 45}
    assert {(p, i) for p, i, _ in want if i} == by

"""What the step that all queries by digits share costs: numbers worked out once, pairs scored by methods that Java compiles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import similarity
from tallyweave.operators import normalise, scoring
from tallyweave.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def still(spark):
    """Plans as they are made at first, so that their text and code can be read."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", before)


def test_methods_of_scored_pairs_are_short_enough_to_be_compiled(still):
    ranked = scoring.ranked(catalogue._digit_scored(still, FOLDER))
    debug = getattr(still._jvm.org.apache.spark.sql.execution, "debug").__getattr__("package")
    found = debug.codegenStringSeq(ranked._jdf.queryExecution().executedPlan())
    sizes = [found.apply(k)._3().maxMethodCodeSize() for k in range(found.size())]
    assert 0 < max(sizes) < 8000  # bytes of a method above which Java leaves it interpreted


def test_numbers_are_worked_out_once_a_row(still):
    rows = still.createDataFrame([("a", "INV 1234"), ("b", None), ("c", "none")], "id string, text string")
    sides = [rows.select(F.col("id").alias(name), normalise.reference_numbers(F.col("text")).alias("numbers")) for name in ("id", "payment_id")]
    pairs = normalise.quoted_pairs(*sides)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?i:inv)") == 2 and "size(array_distinct" not in plan
    assert [tuple(r) for r in pairs.collect()] == [("a", "a")]


def plain_numbers(text, least):
    low = text.lower()
    runs = [t for t in re.findall("[0-9]+", low) if len(t) >= least and not re.fullmatch("(19|20)[0-9]{2}", t)]
    return {re.sub("^0+([0-9])", r"\1", t) for t in runs + re.findall("inv(?:19|20)[0-9]{2}([0-9]{4,})", low)}


def test_reference_numbers_equal_brute_force(spark):
    rng = random.Random(8)
    parts = ["0", "00", "1", "19", "20", "1999", "2024", "12", "345", "0000", "7", "inv", "Inv", "INV", "İNV", "/", "-", " ", "x", "٣"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["inv20240000042", "INV/2024/0000042", "0000", "00001999", "11999", "19991", "", "INV201900000"]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for least in (3, 4, 5):
        got = frame.select("t", normalise.reference_numbers(F.col("t"), least).alias("n")).collect()
        assert all(r.n is None if r.t is None else len(r.n) == len(set(r.n)) and set(r.n) == plain_numbers(r.t, least) for r in got)


def test_scores_of_columns_equal_those_written_out(spark):
    rng = random.Random(9)
    digits = lambda: "".join(rng.choice("0012") for _ in range(rng.randrange(9)))
    rows = [(digits(), digits(), rng.choice([0, -1, 1]) * rng.randrange(1, 10**7), rng.randrange(1, 10**7)) for _ in range(3000)] + [(None, "1234", 5, 5), ("1234", None, None, 5)]
    frame = spark.createDataFrame(rows, "a string, b string, gross long, paid long")
    near, zero = scoring.amount_bands(F.col("gross"))
    frame = frame.withColumns({"x": similarity.bare_digits(F.col("a")), "y": similarity.bare_digits(F.col("b")), "near": near, "zero": zero})
    plain = [similarity.digit_agreement(F.col("a"), F.col("b")), scoring.amount_score(F.col("gross"), F.col("paid"))]
    ready = [similarity.digit_agreement(F.col("a"), F.col("b"), bare=(F.col("x"), F.col("y"))), scoring.amount_score(F.col("gross"), F.col("paid"), (F.col("near"), F.col("zero")))]
    got = frame.select("a", "b", *[c.alias(n) for c, n in zip(plain + ready, "pqrs", strict=True)]).collect()
    assert all(r.p == r.r and r.q == r.s and (r.p == 0 if r.a is None or r.b is None else r.p == similarity.agreement(r.a, r.b)) for r in got)

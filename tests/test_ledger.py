"""Every ledger query against its oracle, and the operators that SQL can't express against hand-made rows."""

import datetime as dt
import itertools
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import similarity
from tallyweave.operators import cardinality, holds, narration, normalise, review, scoring, workflow
from tallyweave.plans import catalogue, record_queries, workflow_queries  # noqa: F401
from tallyweave.sources import datasets, ledger

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ledger.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(df):
    columns = sorted(df.columns)
    return columns, sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    assert plain(catalogue.QUERIES[name](spark, FOLDER).toPandas()) == plain(duck.sql(catalogue.ORACLES[name]).df())


def test_profiles(spark):
    rows = spark.createDataFrame([("INV/2024/0042",), ("inv0042",), ("Bill No. 7-A",), ("INV",), ("",), (None,), ("Ré-Ｆ 009",)], "x string")
    got = [r[0] for r in rows.select(normalise.normalise(F.col("x"), "reference.v2")).collect()]
    assert got == ["2024 42", "42", "7 a", "inv", "", None, "re f 9"]
    rule = rows.select(normalise.changed_steps(F.col("x"), "reference.v2")).first()[0]
    assert rule == "reference.v2:case_fold+punctuation_strip+reference_prefix_strip+leading_zero_strip"
    names = spark.createDataFrame([("M/s Sundar Engg & Tech Pvt. Ltd.",)], "x string")
    assert names.select(normalise.normalise(F.col("x"), "vendor.v1")).first()[0] == "m s sundar engineering technologies"


def test_similarity_ratios(spark):
    assert similarity.ratio("abcd", "abxd") == 75 and similarity.ratio("", "") == 100
    assert similarity.token_set_ratio("a b", "b a c") == 100 and similarity.token_set_ratio("", "a") == 0
    assert similarity.partial_ratio("bcd", "abcde") == 100
    rows = spark.createDataFrame([("a b", "a b"), ("", "x"), ("42", "0042"), (None, "a")], "a string, b string")
    assert [r[0] for r in rows.select(similarity.compare("ratio", F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.67, 0.0]
    digits = [("1234", "1234"), ("001234", "1234"), ("2024001234", "1234"), ("12", "0012"), ("1234", "5678")]
    frame = spark.createDataFrame(digits, "a string, b string")
    assert [round(r[0], 3) for r in frame.select(similarity.digit_agreement(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.4, 0.0, 0.0]


def test_lcs_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(2))
        best = max(n for n in range(len(a) + 1) if any(_inside(c, b) for c in itertools.combinations(a, n)))
        assert similarity._common(a, b) == best


def _inside(part, whole):
    it = iter(whole)
    return all(c in it for c in part)


def test_subset_sum_equals_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        values, target = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))], rng.randrange(1, 90)
        sums = [sum(v for i, v in enumerate(values) if m >> i & 1) for m in range(1 << len(values))]
        masks, best = holds.subset_sum(values, target)
        exact = sum(s == target for s in sums[1:])
        assert len(masks) == min(2, exact) and all(sums[m] == target for m in masks)
        assert best == max(s for s in sums if s <= target)


def test_cardinality_findings(spark):
    pool = "array<struct<part:string,amount:bigint>>"
    rows = [("unique", 100, [("a", 60), ("b", 40), ("c", 7)]), ("tied", 100, [("a", 60), ("b", 40), ("c", 60), ("d", 40)]), ("singles", 100, [("a", 100), ("b", 100)]), ("part", 100, [("a", 30), ("b", 50)]), ("none", 100, [("a", 30)]), ("big", 9, [(f"p{i}", 1) for i in range(41)])]
    got = cardinality._searched(spark.createDataFrame(rows, f"id string, goal long, pool {pool}")).collect()
    assert {r["id"]: (r["finding"], r["payment_ids"], r["residual_paise"]) for r in got} == {
        "unique": ("settled", "a+b", 0), "tied": ("contested_settlement", "", 100), "singles": ("singles", "", 100), "part": ("partial_settlement", "a+b", 20), "none": ("none", "", 100), "big": ("pool_exceeds_bound", "", 9),
    }


def test_narration_references():
    assert narration.references("NEFT UTR100000042 INV/2024/0042") == ["inv 2024 0042"]
    assert narration.references("PAID 12345, 67890") == ["12345", "67890"]
    assert narration.references("") == [] and narration.references(None) == []
    assert [b for _, b in narration.bonds("a-b c, d")] == ["break", "tight", "space", "break"]


def test_acceptance_needs_a_reference(spark):
    """Why pairs without a shared number or amount can't clear: everything but the reference adds up to less than the bar."""
    assert sum(w for k, w in scoring.WEIGHTS.items() if k != "reference") < scoring.ACCEPT


def test_scores_fall_with_distance(spark):
    rows = spark.range(0, 900_000, 10_000).select(scoring.amount_score(F.lit(1_000_000), 1_000_000 - F.col("id")).alias("s"), "id").orderBy("id").collect()
    assert all(a["s"] >= b["s"] for a, b in zip(rows, rows[1:])) and rows[0]["s"] == 1.0
    days = spark.range(0, 60).select(scoring.date_score(F.lit(dt.date(2024, 1, 1)), F.date_add(F.lit(dt.date(2024, 1, 1)), F.col("id").cast("int"))).alias("s"), "id").orderBy("id").collect()
    assert all(a["s"] >= b["s"] for a, b in zip(days, days[1:])) and days[-1]["s"] == 0.0


def test_boundary_nominations(spark):
    inv = spark.createDataFrame([("INV-1", "INV/2024/0042", 125000, dt.date(2024, 4, 1)), ("INV-2", "INV/2024/0043", 990000, dt.date(2024, 4, 2))], "id string, reference string, gross_paise long, invoice_date date")
    pay = spark.createDataFrame([("PAY-B", 990000, "RTGS INV/2024/0043 SUNDAR", dt.date(2024, 4, 7)), ("PAY-C", 4321, "UPI MISC ZZ9", dt.date(2024, 11, 30))], "payment_id string, amount_paise long, narration_raw string, value_date date")
    nominations = spark.createDataFrame([("a", "INV-1", ["PAY-C"]), ("b", "INV-2", ["PAY-B"]), ("c", "INV-2", ["PAY-B", "PAY-X"]), ("d", "INV-1", [])], "nomination_id string, invoice_id string, payment_ids array<string>")
    score = similarity.digit_agreement(normalise.digits_of(F.col("reference")), normalise.digits_of(F.col("narration_raw")))
    got = {r["nomination_id"]: r["verdict"] for r in workflow.admitted(nominations, inv, pay, score).collect()}
    assert got == {"a": "below_accept_min", "b": "admitted", "c": "unknown_record", "d": "empty_set"}


def test_appended_chain_verifies(spark):
    drafts = spark.createDataFrame([(i, f"e{i}") for i in range(20)], "draft long, event string")
    journal = workflow.appended((7, "root"), drafts)
    rows = journal.orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == list(range(8, 28)) and rows[0]["prev_hash"] == "root"
    assert review.broken_links(journal).count() == 0 and review.journal_gaps(journal).count() == 0
    bad = journal.withColumn("prev_hash", F.when(F.col("sequence") == 15, "x").otherwise(F.col("prev_hash")))
    assert [r[0] for r in review.broken_links(bad).collect()] == [15]


def test_datasets(spark, tmp_path):
    row = {"id": "I1", "vendor_id": "V", "reference": "R", "invoice_date": "2024-01-31", "received_date": "2024-02-01", "gross_paise": "118", "net_paise": 100, "period": "2024-01"}
    (tmp_path / "a.json").write_text(json.dumps([row, row | {"id": "I2", "gross_paise": "1.5"}, row | {"id": "I3", "invoice_date": "2024-02-31"}]))
    (tmp_path / "b.json").write_text(json.dumps({"data": [row]}))
    good, bad = datasets.read_rows(spark, f"{tmp_path}/a.json", datasets.INVOICE)
    assert [r["gross_paise"] for r in good.collect()] == [118] and {r["id"]: r["problem"] for r in bad.collect()} == {"I2": "gross_paise", "I3": "invoice_date"}
    assert datasets.read_rows(spark, f"{tmp_path}/b.json", datasets.INVOICE)[0].count() == 1
    before = datasets.tree_hash(spark, str(tmp_path)).first()["root"]
    (tmp_path / "MANIFEST").write_text("x")
    assert datasets.tree_hash(spark, str(tmp_path)).first()["root"] == before
    assert datasets.sealed({"b": 1, "a": None})["bytes"] == len('{"a":null,"b":1}')


def test_trees_tell_folders_apart(spark, tmp_path):
    roots = []
    for swap in (False, True):
        base = tmp_path / str(swap)
        for folder, text in (("a", "1"), ("b", "2")):
            (base / folder).mkdir(parents=True)
            (base / folder / "same.json").write_text({"1": "2", "2": "1"}[text] if swap else text)
        roots.append(datasets.tree_hash(spark, str(base)).first())
    assert roots[0]["files"] == 2 and roots[0]["root"] != roots[1]["root"]


def test_manifest_mix_and_report(spark, tmp_path):
    (tmp_path / "MANIFEST").write_text("# dataset: holdout\n# seed: 7\nother: x\n# seed: 8\n")
    assert {r["field"]: r["value"] for r in datasets.manifest_fields(spark, str(tmp_path / "MANIFEST")).collect()} == {"dataset": "holdout", "seed": "7"}
    for text in ('{"clean": 0.4}', '{"declared": {"clean": 0.4}}'):
        (tmp_path / "mix.json").write_text(text)
        assert {r["stratum"]: r["declared"] for r in datasets.declared_mix(spark, str(tmp_path / "mix.json"), {"clean": 0.5, "period": 0.1}).collect()} == {"clean": 0.4, "period": 0.1}
    seal = datasets.write_report({"totals": spark.range(2)}, str(tmp_path / "report.json"))
    assert json.loads((tmp_path / "report.json").read_text()) == {"totals": [{"id": 0}, {"id": 1}]} and len(seal["sha256"]) == 64
    with pytest.raises(ValueError):
        datasets.write_report({"many": spark.range(20_000)}, str(tmp_path / "r.json"))


def test_comparators_of_words():
    assert similarity.partial_token_set_ratio("acme ltd", "ltd zebra") == 100 and similarity.partial_token_set_ratio("", "a") == 0
    assert similarity.weighted_ratio("acme ltd", "acme ltd") == 100 and similarity.weighted_ratio("", "x") == 0
    assert similarity.weighted_ratio("acme", "the acme trading company") == 90
    assert similarity.weighted_ratio("b a", "a b") == 95

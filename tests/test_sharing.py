"""Tables that queries share are made once; pairs meet once; scores round as the SQL's do."""

import duckdb
from pyspark.sql import functions as F

from tallyweave.operators import cardinality, holds, normalise, records, review, scoring
from tallyweave.sources import ledger


def test_kept_rows_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = lambda: spark.range(100).mapInArrow(count, "id long").groupBy((F.col("id") % 7).alias("k")).count()
    assert ledger.kept(spark, "/nowhere", "counted", rows).count() == 7
    assert seen.value == 100


def test_scores_round_as_the_oracle_does(spark):
    values = [k / 1e6 + 0.0000005 for k in range(0, 1_000_000, 997)] + [0.0, 1.0, 0.1234565, 1 / 3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(scoring.rounded(F.col("v"), 6)).collect()]
    want = [duckdb.sql(f"SELECT round(CAST('{v!r}' AS DOUBLE), 6)").fetchall()[0][0] for v in values]
    assert got == want
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS v").select(scoring.rounded(F.col("v"), 6)).first()[0] is None


def test_a_pair_of_several_shared_numbers_meets_once(spark):
    numbers = normalise.reference_numbers(F.col("text")).alias("numbers")
    docs = spark.createDataFrame([("a", "1234 and 5678"), ("b", "5678"), ("c", None), ("d", "77")], "id string, text string").select("id", numbers)
    lines = spark.createDataFrame([("p", "5678/001234"), ("q", "x1234"), ("r", "")], "payment_id string, text string").select("payment_id", numbers)
    got = sorted(map(tuple, normalise.quoted_pairs(docs, lines).collect()))
    assert got == [("a", "p"), ("a", "q"), ("b", "p")]


def test_pools_of_one_part(spark):
    rows = [("even", 500, 500), ("short", 500, 400), ("over", 500, 600), ("zero", 0, 0), ("below", -5, -5)]
    pools = spark.createDataFrame([(i, g, [("p", a)]) for i, g, a in rows], "id string, goal long, pool array<struct<part:string,amount:long>>")
    got = {r["id"]: (r["finding"], r["payment_ids"], r["settled_paise"], r["residual_paise"], r["contested"]) for r in cardinality._searched(pools).collect()}
    assert got == {"even": ("settled", "p", 500, 0, False), "short": ("none", "", 0, 500, False), "over": ("none", "", 0, 500, False), "zero": ("settled", "p", 0, 0, False), "below": ("settled", "p", -5, 0, False)}


def _joins(rows):
    """Of collected rows, how the plan that ran joined."""
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return {name for name in ("BroadcastHashJoin", "SortMergeJoin") if name in plan}


def test_rows_that_explode_adds_are_never_broadcast(spark, monkeypatch):
    """A name has dozens of q-grams, of which Spark knows nothing when it takes the names for small enough to be sent to the driver."""
    monkeypatch.setattr(scoring, "cut", lambda rows: rows)
    names = spark.createDataFrame([("northgate packaging",), ("lotus traders",)], "vendor_value string")
    links = scoring.name_links(names, spark.createDataFrame([("nrthgate packaging",), ("lotustraders",)], "vendor_value string"))
    assert _joins(links) == {"SortMergeJoin"}
    assert {(r["vendor_value"], r["payer_value"]) for r in links.collect()} == {("northgate packaging", "nrthgate packaging"), ("lotus traders", "lotustraders")}


def test_decisions_meet_their_candidates_in_shuffles(spark):
    rows = lambda kind, *values: spark.createDataFrame(values, kind)
    invoices = rows("id string", ("a",), ("b",), ("c",))
    ranked = rows("id string, payment_id string, composite double, rank int", ("a", "p", 0.9, 1), ("b", "q", 0.5, 1))
    decided = holds.decisions(invoices, ranked, rows("invoice_id string, hold_type string", ("c", "tax_variance")))
    assert {r["invoice_id"]: r["action"] for r in decided.collect()} == {"a": "auto_clear", "b": "unmatched", "c": "hold"}
    plan = decided.groupBy("action").count()
    assert "SortMergeJoin" in _joins(plan)
    diff = review.run_diff(rows("invoice_id string, action string", ("a", "hold")), rows("invoice_id string, action string", ("a", "auto_clear")))
    assert _joins(diff) == {"SortMergeJoin"}


def test_ranks_work_scores_out_once(spark):
    """The bar of the composite isn't pushed into the scores' own step, where a filter would evaluate them anew."""
    values = [(f"d{i % 7}", f"p{i:02d}", "0" * (i % 3) + "1" * (i % 11)) for i in range(60)]
    scored = spark.createDataFrame(values, "id string, payment_id string, text string").select("id", "payment_id", (F.length(F.regexp_replace("text", "^0+", "")) / 20).alias("composite"), *[F.lit(0.0).alias(f"{k}_score") for k in ("reference", "amount", "vendor")], *[F.lit(None).cast("date").alias(c) for c in ("value_date", "invoice_date")])
    ranked = scoring.ranked(scored)
    filters = [x for x in ranked._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("regexp_replace" in x for x in filters)
    want = set()
    for d in range(7):
        own = sorted((-len(t.lstrip("0")) / 20, p) for i, p, t in values if i == f"d{d}" and len(t.lstrip("0")) / 20 >= scoring.CONSIDER)
        want |= {(f"d{d}", p, turn) for turn, (_, p) in enumerate(own[: scoring.TOP], 1)}
    assert {(r["id"], r["payment_id"], r["rank"]) for r in ranked.collect()} == want


def _documents(spark):
    kind = "id string, reference string, gross_paise long, invoice_date string, is_credit_note boolean"
    docs = [("a", "INV 1111", 500, "2024-01-01", False), ("b", "INV 2222", 500, "2024-01-01", False), ("c", "INV 2222", 300, "2024-01-01", False), ("d", "INV 3333", 900, "2024-01-01", False), ("e", "INV 4444", 700, "2024-01-01", False), ("f", "INV 5555", 100, "2024-01-01", True)]
    lines = [("p", "1111", 500, "2024-01-05"), ("q", "2222", 800, "2024-01-05"), ("r", "3333", 400, "2024-01-05"), ("s", "3333", 500, "2024-01-06"), ("t", "4444", 700, "2024-06-01"), ("u", "5555", 100, "2024-01-05")]
    day = lambda c: F.col(c).cast("date")
    return spark.createDataFrame(docs, kind).withColumn("invoice_date", day("invoice_date")), spark.createDataFrame(lines, "payment_id string, narration_raw string, amount_paise long, value_date string").withColumn("value_date", day("value_date"))


def test_findings_search_only_what_needs_it(spark, monkeypatch):
    """One line alone is decided without Python; a set is looked for once; growing tables meet in shuffles."""
    searched = []
    whole = cardinality._searched
    monkeypatch.setattr(cardinality, "_searched", lambda pools: searched.extend((r["id"], len(r["pool"])) for r in pools.collect()) or whole(pools))
    invoices, payments = _documents(spark)
    found = cardinality.findings(invoices, payments)
    assert "SortMergeJoin" in _joins(found) and "BroadcastHashJoin" not in _joins(found)
    assert {r["invoice_id"]: (r["finding"], r["payment_ids"], r["days_outside"]) for r in found.collect()} == {
        "a": ("settled", "p", 0), "b": ("settled_in_bulk", "", 0), "c": ("settled_in_bulk", "", 0), "d": ("settled", "r+s", 0), "e": ("advice_outside_window", "", 152),
    }
    assert sorted(searched) == [("d", 2), ("q", 2)]


def test_queues_and_bundles_meet_in_shuffles(spark):
    rows = lambda kind, *values: spark.createDataFrame(values, kind)
    held, ranked = rows("invoice_id string, hold_type string", ("a", "tax_variance")), rows("id string, payment_id string, composite double, rank int", ("a", "p", 0.9, 1))
    decided = rows("case_id string, decision_id string, action string, reviewer string, decided_at string", ("k", "d1", "approve", "z", "2024"))
    queue = records.hydrated(rows("invoice_id string, case_id string", ("a", "k")), held, ranked, decided)
    assert [(r["hold_types"], r["payment_id"], r["decision_id"]) for r in queue.collect()] == [("tax_variance", "p", "d1")]
    invoices = rows("id string, case_id string, vendor_id string, gross_paise long, invoice_date string", ("a", "k", "v", 5, "2024-01-01"), ("b", "k", "v", 5, "2024-01-04"))
    bundles = records.case_bundles(invoices.withColumn("invoice_date", F.col("invoice_date").cast("date")), held, ranked, decided, rows("affected_ids array<string>", (["a", "c"],)))
    assert [(r["invoice_id"], r["holds"], r["candidates"], r["changes"], r["alike"], r["day_gap"]) for r in bundles.collect()] == [("a", 1, 1, 1, 1, 3)]
    for plan, broadcasts in ((queue, 1), (bundles, 1)):  # the decisions of 3,000 cases
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert text.count("SortMergeJoin") >= 2 and text.count("BroadcastHashJoin") <= broadcasts

"""Prepared references, vendors' names, the search by money and date, and candidates against nested loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import similarity
from tallyweave.operators import conflicts, narration, nearest, normalise, scoring
from tallyweave.plans import catalogue
from tallyweave.sources import ledger

INV = "id string, vendor_id string, vendor_name string, reference string, gross_paise long, invoice_date date"
PAY = "payment_id string, amount_paise long, value_date date, narration_raw string"


def batches(rng):
    text = lambda: "".join(rng.choice("abcdé 1") for _ in range(rng.choice([0, 1, 3, 9, 20, 63, 64, 65, 90])))
    return [text() for _ in range(600)], [text() for _ in range(600)]


@pytest.mark.parametrize("name", sorted(similarity.BATCHED))
def test_batched_similarity_equals_one_by_one(name):
    left, right = batches(random.Random(1))
    assert similarity.BATCHED[name](left, right).tolist() == [similarity.COMPARATORS[name](a, b) for a, b in zip(left, right)]
    assert similarity.BATCHED[name]([], []).tolist() == []


def test_digit_agreement_in_python_equals_catalyst(spark):
    rng = random.Random(2)
    number = lambda: "".join(rng.choice("012") for _ in range(rng.choice([0, 1, 3, 4, 5, 6])))
    rows = [(number(), number()) for _ in range(400)] + [("001234", "1234"), ("0", "00"), ("2024001234", "1234")]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.digit_agreement(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(similarity.agreement(r["a"], r["b"])) for r in got)


def ledger_of(rng, n=40):
    names = ["Aria Sundar Engg Pvt Ltd", "Boreal Traders", "Cobalt Packaging LLP", "Dune Logistics", None, ""]
    day = lambda: rng.choice([None, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(160))] + [dt.date(2024, 2, 1) + dt.timedelta(days=rng.randrange(60))] * 5)
    money = lambda: rng.choice([100_000, 118_000, rng.randrange(50_000, 400_000)])
    inv = [(f"I{k:03}", f"V{k % 4}", names[k % 6], rng.choice([f"INV/2024/{k:04}", f"INV {k}", "", None, f"BILL-{k % 7}"]), money(), day()) for k in range(n)]
    text = lambda k: rng.choice([f"NEFT UTR10000{k} INV/2024/{k:04}", f"IMPS/INV2024{k:06}/AP RUN", "RTGS CLEARING", None, f"PAID {k}, {k + 1}00", f"BILL {k % 7} {k}"])
    payer = lambda k: rng.choice(["", " ARIA SUNDAR ENGINEERING", " boral trders", " CobaltPackaging", " DUNE LOGISTICS"])
    pay = [(f"P{k:03}", money() if k else None, day(), None if (t := text(k)) is None else t + payer(k)) for k in range(n)]
    return inv, pay


def canonical(spark, values, profile):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", normalise.normalise(F.col("v"), profile).alias("c")).collect()
    return {r["v"]: r["c"] for r in rows}


def test_scores_equal_a_nested_loop(spark):
    """Every pair's best reference, vendor score and composite, from the plain functions."""
    inv, pay = ledger_of(random.Random(3), 48)
    left = ledger.cut(scoring.prepared_invoices(spark.createDataFrame(inv, INV)))
    right = ledger.cut(scoring.prepared_payments(spark.createDataFrame(pay, PAY), spark.createDataFrame(inv, INV).select("vendor_id", "vendor_name").distinct()))
    payers = {r["payment_id"]: (r["vendor_value"], r["payer_id"]) for r in right.collect()}
    quoted = {p[0]: narration.references(p[3].lower() if p[3] else None) for p in pay}
    refs = canonical(spark, {i[3] for i in inv} | {x for q in quoted.values() for x in q}, "reference.v2")
    names = canonical(spark, {i[2] for i in inv}, "vendor.v1")
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    above = lambda s, floor: (s - floor) / (1 - floor) if s >= floor else 0.0

    def reference(a, b):
        best = (0.0, False)
        for x in [a] if refs.get(a) else []:
            for y in (y for y in b if refs[y]):
                seen = 1.0 if refs[x] == refs[y] else similarity.token_set_ratio(refs[x], refs[y]) / 100
                d = similarity.agreement(digits(x), digits(y))
                best = max(best, (max(0.6 * above(seen, 0.6) + 0.4 * d, 0.9 * d if d >= 0.6 else 0.0), refs[x] == refs[y]))
        return best

    def vendor(own, name, payer, payer_id):
        if own == payer_id:
            return 1.0
        if not name or not payer:
            return 0.0
        a, b = name.replace(" ", ""), payer.replace(" ", "")
        views = [similarity.token_set_ratio(name, payer), similarity.ratio(a, b), 0.9 * similarity.partial_ratio(a, b)]
        return above(1.0 if name == payer else max(views) / 100, 0.55)

    got = scoring.scored_pairs(scoring.exhaustive_pairs(left, right.where("amount_paise IS NOT NULL")), left, right).collect()
    assert len(got) == len(inv) * (len(pay) - 1)
    by_id, lines = {i[0]: i for i in inv}, {p[0]: p for p in pay}
    for r in got:
        i, p = by_id[r["id"]], lines[r["payment_id"]]
        score, exact = reference(i[3], quoted[p[0]])
        assert (r["reference_score"], r["reference_exact"]) == (pytest.approx(score), exact)
        assert r["vendor_score"] == pytest.approx(vendor(i[1], names[i[2]], *payers[p[0]]))
        whole = 0.35 * r["amount_score"] + 0.4 * score + 0.1 * r["date_score"] + 0.15 * r["vendor_score"]
        assert r["composite"] == pytest.approx(min(1.0, max(0.0, whole)))
    assert {r["vendor_score"] for r in got} > {0.0, 1.0} and any(r["reference_exact"] for r in got)


@pytest.mark.parametrize("cell", [4, 4096])
def test_search_equals_brute_force(spark, monkeypatch, cell):
    """Cells of a few payments, hot amounts and dates, ties, and documents without dates."""
    monkeypatch.setattr(nearest, "CELL", cell)
    monkeypatch.setattr(nearest, "ASKED", 40)
    rng = random.Random(6)
    day = lambda: rng.choice([nearest.NO_DAY, 19_000 + rng.randrange(200), 19_050])
    money = lambda: rng.choice([100_000, rng.randrange(80_000, 130_000), rng.randrange(10_000, 900_000)])
    paid = [(rng.choice([0, 0, 7]), f"P{k:04}", money(), day()) for k in range(300)]
    asked = [(rng.choice([0, 0, 7, 9]), money(), day()) for _ in range(60)]
    got = nearest.nearest_payments(spark.createDataFrame(asked, "class long, gross long, day int"), spark.createDataFrame(paid, "class long, payment_id string, amount long, day int")).collect()
    found = {}
    for r in got:
        found.setdefault((r["class"], r["gross"], r["day"]), set()).add(r["payment_id"])
    for c, gross, d in set(asked):
        rows = []
        for own, p, amount, when in paid:
            gap = when - d if nearest.NO_DAY not in (when, d) else 1 << 40
            a = float(nearest._amount_score(np.array([gross]), np.array([amount]))[0])
            score = 0.35 * a + (0.1 * float(nearest._date_score(np.array([gap]))[0]) if abs(gap) <= 45 else 0.0)
            if own == c and score >= nearest.LEAST:
                rows.append((-score, -a, abs(gap), p))
        assert found.get((c, gross, d), set()) == {p for *_, p in sorted(rows)[: nearest.K]}


def test_search_scores_as_the_scorer_does(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(-10, 10**6), rng.randrange(-10, 10**6), rng.randrange(-60, 60)) for _ in range(300)]
    day = dt.date(2024, 1, 1)
    frame = spark.createDataFrame([(g, a, day, day + dt.timedelta(days=n)) for g, a, n in rows], "g long, a long, d date, v date")
    got = frame.select(scoring.amount_score(F.col("g"), F.col("a")).alias("a"), scoring.date_score(F.col("d"), F.col("v")).alias("d")).collect()
    g, a, n = (np.array(x) for x in zip(*rows))
    assert [nearest._possible(*r[:2]) for r in rows] == nearest._amount_score(g, a).tolist()
    assert [r["a"] for r in got] == pytest.approx(nearest._amount_score(g, a).tolist()) and [r["d"] for r in got] == pytest.approx(nearest._date_score(n).tolist())


def test_candidates_against_all_pairs(spark):
    """Of all pairs' top five: those without evidence but money and date, and those that could clear, are all found, with the same score."""
    folder = "/root/testdata/sf0.001"
    left, right, _ = catalogue._prepared(spark, folder)
    asked = left.where("j % 6 = 1")  # any document's candidates stand alone
    every = scoring.ranked(scoring.scored_pairs(scoring.exhaustive_pairs(asked, right), asked, right)).select("id", "payment_id", "composite", "reference_score", "vendor_score", "rank").collect()
    own = {(r["id"], r["payment_id"]): r for r in catalogue._candidates(spark, folder).collect()}
    bare = [r for r in every if r["reference_score"] == 0 and r["vendor_score"] == 0]
    clear = [r for r in every if r["composite"] >= scoring.ACCEPT]
    first = [r for r in every if r["rank"] == 1]
    assert len(bare) > 50 and len(clear) > 100
    assert all((r["id"], r["payment_id"]) in own for r in bare + clear)
    assert all(own[r["id"], r["payment_id"]]["composite"] == pytest.approx(r["composite"]) for r in every if (r["id"], r["payment_id"]) in own)
    assert sum((r["id"], r["payment_id"]) in own for r in first) >= 0.93 * len(first)


def test_drifted_and_short_numbers_meet(spark):
    day = dt.date(2024, 3, 1)
    inv = [("I1", "V", None, "INV/2024/12345", 500_000, day), ("I2", "V", None, "INV 42", 90_000_000, day), ("I3", "V", None, "INV/2024/1999", 500_000, day)]
    pay = [("A", 300_000, day, "NEFT INV/2024/12435"), ("B", 300_000, day, "NEFT INV/2024/1245"), ("C", 10, day, "BILL NO 0042"), ("D", 1, day, "REF 2024-1999"), ("E", 300_000, day, "NEFT INV/2024/54321")]
    left, right = scoring.prepared_invoices(spark.createDataFrame(inv, INV)), scoring.prepared_payments(spark.createDataFrame(pay, PAY))
    met = {(r["id"], r["payment_id"]) for r in scoring.candidate_pairs(left, right).collect()}
    assert {("I1", "B"), ("I2", "C"), ("I3", "D")} <= met
    drifted = {(r["id"], r["payment_id"]) for r in scoring._drifted_pairs(left.select("id", F.col("gross_paise").alias("gross"), scoring._days(F.col("invoice_date")).alias("day"), "refs"), right.select("payment_id", F.col("amount_paise").alias("amount"), scoring._days(F.col("value_date")).alias("day"), "refs")).collect()}
    assert ("I1", "B") in drifted and ("I1", "E") not in drifted and ("I2", "C") not in drifted


def test_conflicts(spark):
    rows = spark.createDataFrame([("a:blocking+b:advisory",), ("",), (None,), ("b:advisory+a:blocking+b:advisory",)], "text string")
    got = rows.select(conflicts.distinct(conflicts.parsed(F.col("text"))).alias("c"), conflicts.worst(conflicts.parsed(F.col("text"))).alias("w")).collect()
    assert [[x["code"] for x in r["c"]] if r["c"] is not None else None for r in got] == [["a", "b"], [], None, ["b", "a"]]
    assert [r["w"] for r in got] == ["blocking", "material", None, "blocking"]
    for code in conflicts.CONFLICTS:
        assert spark.range(1).select(conflicts.conflict(code).alias("c")).first()["c"]["code"] == code


def test_empty_ledgers(spark):
    left, right = scoring.prepared_invoices(spark.createDataFrame([], INV)), scoring.prepared_payments(spark.createDataFrame([], PAY))
    one = scoring.prepared_invoices(spark.createDataFrame([("I", "V", "n", "INV 1", 100, None)], INV))
    for a in (left, one):
        assert scoring.ranked(scoring.scored_pairs(scoring.candidate_pairs(a, right), a, right, top=5)).count() == 0

"""Bounds of pairs against the plain functions, and candidates against all pairs: none is lost to a count."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.functions import similarity
from tallyweave.operators import completion, scoring
from tallyweave.plans import catalogue

INV = "id string, vendor_id string, vendor_name string, reference string, gross_paise long, invoice_date date"
PAY = "payment_id string, amount_paise long, value_date date, narration_raw string"


def texts(rng, n=150):
    years = lambda: f"{rng.choice([1998, 1999, 2000])} {rng.randrange(2000)}"
    words = lambda: " ".join(rng.choice(["a", "ab", "sub", "12", "é1", " ", "lotus", "x" * 30, "2000"]) for _ in range(rng.randrange(11)))
    return list(dict.fromkeys(rng.choice([years, years, words])() for _ in range(n)))


@pytest.mark.parametrize("least", [0, 60, 90])
def test_bounds_are_never_below_the_scores(least):
    rng = random.Random(11)
    left, right = texts(rng), texts(rng)
    alike = completion.Alike(left, right, fused=True)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij"))
    want = np.array([100 if left[a] and left[a] == right[b] else similarity.token_set_ratio(left[a], right[b]) for a, b in zip(i, j)])
    got = alike.sets(i, j, np.full(len(i), least))
    assert ((got >= want) | (want < least)).all() and (got - want).mean() < (4 if least == 0 else 100)
    numbers = np.append(np.arange(len(right)), -1)
    slide = completion.Slide(alike, numbers)
    rows = np.concatenate([slide.best(a, 0, len(numbers), np.full(len(numbers), least))[:-1] for a in range(len(left))])
    wrong = np.flatnonzero((rows < want) & (want >= least))
    assert not len(wrong), [(left[i[k]], right[j[k]], rows[k], want[k]) for k in wrong[:5]]
    views = lambda a, b: 0.0 if not a or not b else 1.0 if a == b else max(similarity.token_set_ratio(a, b) / 100, similarity.ratio("".join(a.split()), "".join(b.split())) / 100, 0.9 * similarity.partial_ratio("".join(a.split()), "".join(b.split())) / 100)
    some = np.array(rng.sample(range(len(i)), 3000))
    names, exact = alike.names(i[some], j[some], np.full(len(some), least / 100)), np.array([views(left[i[k]], right[j[k]]) for k in some])
    wrong = np.flatnonzero((names < exact - 1e-9) & (names < least / 100))
    assert not len(wrong), [(left[i[some[k]]], right[j[some[k]]], names[k], exact[k]) for k in wrong[:5]]


def test_candidates_are_those_of_all_pairs(spark):
    """The same five with the same ranks and scores as if every pair was scored."""
    folder = "/root/testdata/sf0.001"
    left, right, _ = catalogue._prepared(spark, folder)
    asked = left.where("j % 31 IN (1, 9)")  # credit notes too, which no amount meets
    columns = ("id", "payment_id", "composite", "rank", "tied")
    every = scoring.ranked(scoring.scored_pairs(scoring.exhaustive_pairs(asked, right), asked, right, top=scoring.TOP)).select(*columns)
    own = catalogue._candidates(spark, folder).join(asked.select("id"), "id", "left_semi").select(*columns)
    want = {tuple(r) for r in every.collect()}
    got = {tuple(r) for r in own.collect()}
    assert len(want) > 200 and not want ^ got


def test_odd_rows_lose_no_candidate(spark, monkeypatch):
    """Long, blank and foreign texts, digits that agree at an end, rows without dates; cells and groups of a few rows."""
    monkeypatch.setattr(completion, "CELL", 16)
    rng = random.Random(12)
    day = lambda: rng.choice([None, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(200))])
    money = lambda: rng.choice([0, -70_000, 100_000, rng.randrange(50_000, 400_000), None])
    quoted = lambda: rng.choice(["", None, " ", f"INV/2024/{rng.randrange(90):05}", f"{rng.randrange(900)}", "INV 2024", "é" * 70 + "7", " ".join(f"{k}x" for k in range(12)), f"2024{rng.randrange(90):05}"])
    name = lambda: rng.choice([None, "", "Zürich Traders", "lotus " * 14, "Lotus Packaging 77x", "Northgate Engg Pvt Ltd", "北京 商贸"])
    inv = [(f"I{k:02}", rng.choice([None, "V1", "V2"]), name(), quoted(), money(), day()) for k in range(50)]
    pay = [(f"P{k:02}", money(), day(), rng.choice([None, f"NEFT {quoted()} {name()}"])) for k in range(70)]
    rows = spark.createDataFrame(inv, INV)
    left = scoring.prepared_invoices(rows).localCheckpoint()
    right = scoring.prepared_payments(spark.createDataFrame(pay, PAY), rows.where("vendor_id IS NOT NULL").select("vendor_id", "vendor_name").distinct()).localCheckpoint()
    best = lambda pairs: {(r["id"], r["payment_id"], r["rank"]) for r in scoring.ranked(scoring.scored_pairs(pairs, left, right)).collect()}
    want = best(scoring.exhaustive_pairs(left.where("gross_paise IS NOT NULL"), right.where("amount_paise IS NOT NULL")))
    assert len(want) > 100 and best(scoring.candidate_pairs(left, right, scoring.name_links(left, right))) == want

"""The evaluation queries judge the decisions that are registered."""

import pytest

from tallyweave.operators import scoring
from tallyweave.plans import catalogue, workflow_queries  # noqa: F401
from tallyweave.sources import ledger

FOLDER = "/root/testdata/sf0.001"


def test_evaluation_judges_the_decisions(spark, tmp_path):
    """Each query over the run against a count in Python over rows of decisions and candidates."""
    spark.read.parquet(f"{FOLDER}/orders.parquet").orderBy("o_orderkey").limit(90).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    rows = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    run, inv = {r["invoice_id"]: r for r in rows("decisions")}, {r["id"]: r for r in ledger.invoices(spark, str(tmp_path)).collect()}
    paid = {}
    for p in ledger.payments(spark, str(tmp_path)).collect():
        paid.setdefault(p["settles"], []).append(p["payment_id"])
    first = {r["id"]: r for r in rows("rank_candidates") if r["rank"] == 1}
    assert run.keys() == inv.keys() and {r["id"] for r in rows("candidates") if r["rank"] == 1} == first.keys()
    cleared = {i for i, r in run.items() if r["action"] == "auto_clear"}
    wrong = {i for i in cleared if paid.get(i) != [run[i]["payment_id"]]}
    tolerance = {i for i, r in inv.items() if r["copy"] in (0, 3) and r["j"] % 10 in (1, 2, 3) and not r["is_credit_note"] and i in paid}
    assert tolerance and not tolerance & cleared and any("price_variance" in (run[i]["hold_types"] or "") for i in tolerance)
    (totals,) = rows("eval_totals")
    assert (totals["total"], totals["auto_cleared"], totals["held"], totals["false_clears"]) == (len(run), len(cleared), sum(r["action"] == "hold" for r in run.values()), len(wrong))
    decided = sum(not r["requires_human"] for r in run.values())
    assert totals["decided"] == decided and {r["floor"]: r["observed"] for r in rows("floors")}["coverage_eval"] == round(decided / len(run), 9)
    strata = {r["stratum"]: r for r in rows("eval_strata")}
    assert sum(r["total"] for r in strata.values()) == len(run) and sum(r["decided"] for r in strata.values()) == decided
    proposed = {}
    for r in run.values():
        for h in (r["hold_types"] or "").split("+"):
            proposed[h] = proposed.get(h, 0) + 1
    got = {r["hold_type"]: r["proposed"] for r in rows("eval_hold_types")}
    assert got["price_variance"] > 0 and all(n == proposed.get(h, 0) for h, n in got.items())
    least, quoted = {}, {}
    for p in ledger.payments(spark, str(tmp_path)).collect():
        least[p["amount_paise"]] = min(least.get(p["amount_paise"], p["payment_id"]), p["payment_id"])
        if p["reference_extracted"]:
            quoted[p["reference_extracted"]] = min(quoted.get(p["reference_extracted"], p["payment_id"]), p["payment_id"])
    naive = {i: quoted.get(r["reference"], least.get(r["gross_paise"])) for i, r in inv.items()}
    before = {i: "auto_clear" if p else "unmatched" for i, p in naive.items()}
    assert {(r["invoice_id"], r["before"], r["after"]) for r in rows("run_diff")} == {(i, before[i], r["action"]) for i, r in run.items() if r["action"] != before[i]}
    files = {r["invoice_id"]: (r["hold_types"], r["payment_id"]) for r in rows("dossiers")}
    assert files == {i: (r["hold_types"], first[i]["payment_id"] if i in first else None) for i, r in run.items() if r["hold_types"]}
    claims = {}
    for i, r in first.items():
        if r["composite"] >= scoring.ACCEPT:
            claims.setdefault(r["payment_id"], []).append(i)
    assert {r["payment_id"]: r["invoice_ids"] for r in rows("contested_payments")} == {p: "+".join(sorted(x)) for p, x in claims.items() if len(x) > 1}
    naive_wrong = [i for i, p in naive.items() if p and paid.get(i) != [p]]
    held = {}
    for r in rows("case_conflicts"):
        held.setdefault(r["invoice_id"], []).append((r["turn"], r["code"], r["severity"], r["case_severity"]))
    assert held.keys() == {i for i, r in run.items() if r["action"] == "hold"}  # none is held without a conflict
    for i, found in held.items():
        assert [c["code"] for c in run[i]["conflicts"]] == [code for _, code, *_ in sorted(found)] and len(set(run[i]["conflicts"])) == len(found)
        assert {x[3] for x in found} == {max((s for _, _, s, _ in found), key=["advisory", "material", "blocking"].index)} == {run[i]["severity"]}
    rate = len(wrong) / max(len(cleared), 1) - len(naive_wrong) / max(sum(x == "auto_clear" for x in before.values()), 1)
    assert rows("regression_gate")[0]["rate_change"] == pytest.approx(rate, abs=1e-8)
    (whole,) = rows("run_totals")
    right = {i for i in cleared if i not in wrong}
    leads = {r["hold_type"]: r for r in rows("run_hold_types")}
    assert (whole["invoices_total"], whole["auto_cleared"], whole["false_clears"], whole["correct_clears"], whole["decided"]) == (len(run), len(cleared), len(wrong), len(right), decided)
    assert whole["match_recall"] == round(len(right) / len(paid.keys() & run.keys()), 9) and whole["held_without_conflict"] == 0
    assert whole["conflicts"] == sum(len(r["conflicts"]) for r in run.values()) and whole["at_risk_paise"] == sum(inv[i]["gross_paise"] for i in wrong)
    assert whole["holds_by_type"] == {t: r["applied"] for t, r in leads.items()} and sum(whole["holds_by_type"].values()) == whole["held"]
    assert sum(r["auto_released"] for r in leads.values()) == sum(r["action"] == "hold" and not r["requires_human"] for r in run.values())
    floors = {r["floor"]: r for r in rows("run_floors")}
    assert len(floors) == 6 + sum(r["expected"] > 0 for r in leads.values()) and floors["held_invoices_without_conflict"]["met"]
    assert all(floors[f"per_hold_type_recall_min.{t}"]["met"] == (r["recall"] >= 0.7) for t, r in leads.items() if r["expected"])

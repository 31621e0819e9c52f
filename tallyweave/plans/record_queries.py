"""Registered queries over reviewers' records, their mutations, evidence rows and constraints.

The records are derived from the whole events table by plain SQL that Spark and DuckDB run alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.reference_data import HOLD_POLICIES, REACH, STRATA, TOLERANCE_KINDS, UNREACHED, WINDOW_DAYS
from tallyweave.operators import cardinality, holds, narration, normalise, records, review, scoring, workflow
from tallyweave.plans import catalogue as c
from tallyweave.plans.catalogue import query
from tallyweave.sources import ledger

_ID = "CAST({} AS VARCHAR(12))"
_E, _U = _ID.format("event_id"), _ID.format("user_id")
RECORDS = {
    "decision": f"""SELECT 'DEC-' || {_E} AS decision_id, 'RUN-' || {_ID.format('user_id % 5')} AS run_id, 'CASE-' || {_ID.format('event_id % 3000')} AS case_id, {_U} AS reviewer, ts AS decided_at,
      CASE event_id % 5 WHEN 0 THEN 'release_hold' WHEN 1 THEN 'route' WHEN 2 THEN 'confirm' WHEN 3 THEN 'change_tolerance' ELSE 'reject' END AS action,
      CASE WHEN event_id % 5 = 0 AND event_id % 35 <> 0 THEN 'H-' || {_ID.format('event_id % 700')} END AS hold_id, CASE WHEN event_id % 5 = 1 AND event_id % 7 <> 1 THEN 're_application' END AS resolution_path FROM events WHERE event_type IN ('click', 'view')""",
    "change": f"""SELECT 'TC-' || {_E} AS change_id, 'RUN-' || {_ID.format('user_id % 5')} AS run_id, ts AS made_at, CASE event_id % 4 WHEN 0 THEN 'global' WHEN 1 THEN 'vendor' WHEN 2 THEN 'hold_type' ELSE 'invoice' END AS scope_kind,
      CASE event_id % 4 WHEN 1 THEN 'VEN-' || {_U} WHEN 2 THEN 'tax_variance' WHEN 3 THEN 'INV-' || {_E} END AS scope_value, {c._CHANGE.format('event_id')} AS kind, CASE WHEN user_id % 3 > event_id % 3 THEN 'widened' WHEN user_id % 3 = event_id % 3 THEN 'unchanged' ELSE 'narrowed' END AS direction,
      CASE WHEN event_id % 5 = 1 OR event_id % 50 = 3 THEN user_id END AS value_paise, CASE WHEN event_id % 5 IN (2, 4) THEN value END AS value_ratio, CASE WHEN event_id % 5 = 3 THEN user_id END AS value_days,
      'INV-' || lpad({_E}, 9, '0') AS touched, 'INV-' || lpad({_ID.format('event_id + 1')}, 9, '0') AS also FROM events WHERE event_type = 'purchase'""",
    "run": f"""SELECT 'RUN-' || {_E} AS id, CASE WHEN event_id % 3 = 0 THEN 'rerun' ELSE 'batch' END AS kind, CASE WHEN event_id % 3 = 0 AND event_id % 7 <> 0 THEN 'RUN-' || {_ID.format('event_id - 1')} END AS parent_run_id,
      CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status, ts AS started_at, CASE WHEN event_id % 4 < 2 AND event_id % 11 <> 0 THEN ts END AS finished_at, CASE WHEN event_id % 2 = 0 THEN user_id END AS totals_total,
      CASE WHEN event_id % 2 = 0 AND event_id % 13 <> 0 THEN value END AS totals_coverage, 'K-' || {_ID.format('user_id * 7 + event_id % 7')} AS key, {_ID.format('user_id % 3 + event_id % 2')} AS argument FROM events WHERE event_type = 'signup'""",
    "rule": f"""SELECT 'FR-' || {_E} AS rule_id, ts AS created_at, CASE event_id % 3 WHEN 0 THEN 'vendor_alias' WHEN 1 THEN 'reference_pattern' ELSE 'duplicate_exemption' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'name ' || {_U} END AS raw_value,
      CASE WHEN event_id % 3 = 0 AND event_id % 33 <> 0 THEN 'VEN-' || {_E} END AS canonical_vendor_id, CASE WHEN event_id % 3 = 1 OR event_id % 66 = 2 THEN 'P' || {_U} END AS pattern, event_id % 4 <> 0 AS active, CASE WHEN event_id % 4 = 0 THEN {_U} END AS deactivated_by FROM events WHERE event_type = 'error'""",
}


def _records(spark, sf_dir: str, name: str) -> DataFrame:
    c.ledger.tables(spark, sf_dir, "events")
    return spark.sql(RECORDS[name])


def _sql(body: str, *names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({RECORDS[n]})" for n in names) + body


def _led(body: str, *more: str, names: tuple[str, ...] = ()) -> str:
    return c._with(body, *more, *[f"{n} AS ({RECORDS[n]})" for n in names])


# --- lists -----------------------------------------------------------------------------------


@query("decision_list", _sql(" SELECT decision_id, case_id, reviewer, action FROM decision WHERE run_id = 'RUN-2' AND action = 'route'", "decision"))
def decision_list(spark, sf_dir):
    return records.listed(_records(spark, sf_dir, "decision"), run_id="RUN-2", case_id=None, action="route").select("decision_id", "case_id", "reviewer", "action")


@query("feedback_list", _sql(" SELECT rule_id, kind FROM rule WHERE active", "rule"))
def feedback_list(spark, sf_dir):
    return records.listed(_records(spark, sf_dir, "rule"), active=True).select("rule_id", "kind")


@query("evidence_order", _sql(""" SELECT change_id, turn FROM (SELECT change_id, row_number() OVER (ORDER BY direction = 'widened' DESC, CASE scope_kind WHEN 'global' THEN 3 WHEN 'vendor' THEN 2 WHEN 'hold_type' THEN 1 ELSE 0 END DESC, made_at DESC, change_id) AS turn FROM change WHERE run_id = 'RUN-1') WHERE turn <= 100""", "change"))
def evidence_order(spark, sf_dir):
    rows = records.listed(_records(spark, sf_dir, "change"), run_id="RUN-1")
    return records.first_rows(rows, records.evidence_order(), 100).select("change_id", "turn")


@query("latest_runs", _sql(" SELECT id, turn FROM (SELECT id, row_number() OVER (ORDER BY started_at DESC, id) AS turn FROM run) WHERE turn <= 20", "run"))
def latest_runs(spark, sf_dir):
    return records.first_rows(_records(spark, sf_dir, "run"), [F.col("started_at").desc(), F.col("id").asc()], 20).select("id", "turn")


@query("latest_decisions", _sql(" SELECT case_id, arg_max(decision_id, (decided_at, decision_id)) AS decision_id, arg_max(action, (decided_at, decision_id)) AS action, arg_max(reviewer, (decided_at, decision_id)) AS reviewer, count(*) AS decisions FROM decision GROUP BY 1", "decision"))
def latest_decisions(spark, sf_dir):
    return records.latest_decisions(_records(spark, sf_dir, "decision"))


_SCOPE = "CASE scope_kind WHEN 'global' THEN 'every invoice in the run' WHEN 'vendor' THEN 'vendor ' || scope_value WHEN 'hold_type' THEN 'hold type ' || scope_value ELSE 'invoice ' || scope_value END"
_TOLERANCE = "CASE kind WHEN 'exact' THEN 'exact (no band)' WHEN 'absolute_paise' THEN v || ' paise' WHEN 'percentage' THEN v || ' of the compared quantity' WHEN 'days' THEN v || ' day(s)' ELSE 'similarity floor ' || v END"


@query("change_clauses", _sql(f" SELECT change_id, {_SCOPE} AS scope_clause, {_TOLERANCE} AS tolerance_clause FROM (SELECT *, CAST(length(change_id) AS VARCHAR) AS v FROM change)", "change"))
def change_clauses(spark, sf_dir):
    rows = _records(spark, sf_dir, "change")
    return rows.select("change_id", records.scope_clause(F.col("scope_kind"), F.col("scope_value")).alias("scope_clause"), records.tolerance_clause(F.col("kind"), F.length("change_id")).alias("tolerance_clause"))


@query("page_offsets", "SELECT event_id, floor(user_id / 25) + 1 AS page, (greatest(user_id % 9, 1) - 1) * 25 AS start FROM (SELECT event_id, CAST(user_id AS BIGINT) AS user_id FROM events)".replace("floor(user_id / 25) + 1", "CAST(floor(user_id / 25.0) AS BIGINT) + 1"))
def page_offsets(spark, sf_dir):
    rows = c._read(spark, sf_dir, "events")
    return rows.select("event_id", records.page_of(F.col("user_id"), F.lit(25)).alias("page"), records.offset_of(F.col("user_id") % 9, F.lit(25)).cast("long").alias("start"))


@query("touching_changes", _sql(" SELECT change_id FROM change WHERE touched IN (SELECT 'INV-' || lpad(CAST(o_orderkey AS VARCHAR(12)), 9, '0') FROM orders WHERE o_orderkey % 3 = 0) OR also IN (SELECT 'INV-' || lpad(CAST(o_orderkey AS VARCHAR(12)), 9, '0') FROM orders WHERE o_orderkey % 3 = 0)", "change"))
def touching_changes(spark, sf_dir):
    ids = c._read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("INV-"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("id"))
    return records.touching(_changes(spark, sf_dir), ids).select("change_id")


def _changes(spark, sf_dir) -> DataFrame:
    return _records(spark, sf_dir, "change").withColumn("affected_ids", F.array("touched", "also"))


# --- the queue and its cases -----------------------------------------------------------------

_CASE = "'CASE-' || CAST(i.j % 3000 AS VARCHAR(12))"
_CASES = f"""cases AS (SELECT q.*, {_CASE} AS case_id FROM queue q JOIN inv i ON i.id = q.invoice_id),
last AS (SELECT case_id, arg_max(decision_id, (decided_at, decision_id)) AS decision_id, arg_max(action, (decided_at, decision_id)) AS action, count(*) AS decisions FROM decision GROUP BY 1)"""


def _cases(spark, sf_dir) -> DataFrame:
    own = ledger.invoices(spark, sf_dir).select(F.col("id").alias("invoice_id"), F.concat(F.lit("CASE-"), (F.col("j") % 3000).cast("string")).alias("case_id"))
    return c._queue(spark, sf_dir).join(ledger.shuffled(own), "invoice_id")


@query("undecided_cases", _led(" SELECT invoice_id, money_at_risk_paise FROM cases WHERE case_id NOT IN (SELECT case_id FROM decision)", c._HOLDS, c._QUEUE, f"decision AS ({RECORDS['decision']})", _CASES))
def undecided_cases(spark, sf_dir):
    return records.undecided(_cases(spark, sf_dir), _records(spark, sf_dir, "decision")).select("invoice_id", "money_at_risk_paise")


@query("queue_by_age", _led(" SELECT invoice_id, turn FROM (SELECT invoice_id, row_number() OVER (ORDER BY money_at_risk_paise DESC, held_since, invoice_id) AS turn FROM queue) WHERE turn BETWEEN 26 AND 75", c._HOLDS, c._QUEUE))
def queue_by_age(spark, sf_dir):
    return records.first_rows(c._queue(spark, sf_dir), [F.col("money_at_risk_paise").desc(), F.col("held_since").asc(), F.col("invoice_id").asc()], 50, 25).select("invoice_id", "turn")


@query("largest_cases", _led(" SELECT invoice_id, money_at_risk_paise, turn FROM (SELECT *, row_number() OVER (ORDER BY money_at_risk_paise DESC, invoice_id) AS turn FROM queue) WHERE turn <= 5", c._HOLDS, c._QUEUE))
def largest_cases(spark, sf_dir):
    return records.first_rows(c._queue(spark, sf_dir), [F.col("money_at_risk_paise").desc(), F.col("invoice_id").asc()], 5).select("invoice_id", "money_at_risk_paise", "turn")


@query("hold_mix_order", _led(" SELECT hold_type, open, turn FROM (SELECT *, row_number() OVER (ORDER BY open DESC, hold_type) AS turn FROM (SELECT hold_type, count(*) FILTER (j % 3 <> 0) AS open FROM hold JOIN inv ON id = invoice_id GROUP BY 1))", c._HOLDS))
def hold_mix_order(spark, sf_dir):
    return records.first_rows(c.hold_mix(spark, sf_dir), [F.col("open").desc(), F.col("hold_type").asc()], len(HOLD_POLICIES)).select("hold_type", "open", "turn")


@query("hydrated_queue", _led(" SELECT q.invoice_id, q.case_id, hold_types, k.payment_id, k.composite, l.decision_id, l.action FROM cases q JOIN (SELECT invoice_id, string_agg(DISTINCT hold_type, '+' ORDER BY hold_type) AS hold_types FROM hold GROUP BY 1) h USING (invoice_id) LEFT JOIN cand k ON k.id = q.invoice_id AND k.rank = 1 LEFT JOIN last l ON l.case_id = q.case_id", c._PAIRS, c._AGREE, c._RANKED, c._HOLDS, c._QUEUE, f"decision AS ({RECORDS['decision']})", _CASES))
def hydrated_queue(spark, sf_dir):
    rows = records.hydrated(_cases(spark, sf_dir), c._holds(spark, sf_dir), c._digit_ranked(spark, sf_dir), _records(spark, sf_dir, "decision"))
    return rows.select("invoice_id", "case_id", "hold_types", "payment_id", "composite", "decision_id", "action")


@query(
    "case_bundles",
    _led(
        f""" SELECT {_CASE} AS case_id, i.id AS invoice_id, h.n AS holds, coalesce(k.n, 0) AS candidates, coalesce(decisions, 0) AS decisions, coalesce(t.n, 0) AS changes, action, alike - 1 AS alike, coalesce(least(invoice_date - before, after - invoice_date), -1) AS day_gap
        FROM (SELECT *, count(*) OVER (PARTITION BY vendor_id, gross_paise) AS alike, lag(invoice_date) OVER (PARTITION BY vendor_id, gross_paise ORDER BY invoice_date, id) AS before, lead(invoice_date) OVER (PARTITION BY vendor_id, gross_paise ORDER BY invoice_date, id) AS after FROM inv) i
        JOIN (SELECT invoice_id, count(*) AS n FROM hold GROUP BY 1) h ON h.invoice_id = i.id LEFT JOIN (SELECT id, count(*) AS n FROM cand GROUP BY 1) k ON k.id = i.id LEFT JOIN last l ON l.case_id = {_CASE}
        LEFT JOIN (SELECT t AS id, count(*) AS n FROM (SELECT unnest([touched, also]) AS t FROM change) GROUP BY 1) t ON t.id = i.id""",
        c._PAIRS, c._AGREE, c._RANKED, c._HOLDS, c._QUEUE, f"decision AS ({RECORDS['decision']})", f"change AS ({RECORDS['change']})", _CASES,
    ),
)
def case_bundles(spark, sf_dir):
    inv = ledger.invoices(spark, sf_dir).withColumn("case_id", F.concat(F.lit("CASE-"), (F.col("j") % 3000).cast("string")))
    return records.case_bundles(inv, c._holds(spark, sf_dir), c._digit_ranked(spark, sf_dir), _records(spark, sf_dir, "decision"), _changes(spark, sf_dir)).withColumn("day_gap", F.col("day_gap").cast("long"))


@query("severity_counts", _led(f" SELECT severity, count(invoice_id) AS cases FROM {c._values([('advisory',), ('material',), ('blocking',)], 'severity')} LEFT JOIN (SELECT invoice_id, arg_max(default_severity, severity_rank) AS severity FROM hold JOIN policy USING (hold_type) GROUP BY 1) USING (severity) GROUP BY 1", c._HOLDS))
def severity_counts(spark, sf_dir):
    worst = holds.principal_holds(c._holds(spark, sf_dir)).groupBy("severity").agg(F.count("*").alias("cases"))
    return spark.createDataFrame([("advisory",), ("material",), ("blocking",)], "severity string").join(worst, "severity", "left").fillna(0)


# --- mutations -------------------------------------------------------------------------------


@query("run_requests", _sql(""" , known AS (SELECT key, min(id) AS id, arg_min(argument, id) AS argument FROM run WHERE length(id) < 8 GROUP BY 1)
    SELECT r.id AS request_id, CASE WHEN k.id IS NULL THEN 'created' WHEN k.argument = r.argument THEN 'replayed' ELSE 'conflict' END AS verdict, CASE WHEN k.argument = r.argument THEN k.id END AS run_id FROM run r LEFT JOIN known k USING (key) WHERE length(r.id) >= 8""", "run"))
def run_requests(spark, sf_dir):
    runs = _records(spark, sf_dir, "run").select("id", "key", "argument")
    return records.run_requests(runs.where("length(id) >= 8").withColumnRenamed("id", "request_id"), runs.where("length(id) < 8"))


@query("decided_actions", _sql(" SELECT decision_id, CASE action WHEN 'release_hold' THEN 'redirect_release' WHEN 'change_tolerance' THEN 'redirect_tolerance' ELSE CASE WHEN length(reviewer) > 1 THEN 'recorded' ELSE 'preview' END END AS result FROM decision", "decision"))
def decided_actions(spark, sf_dir):
    return records.decided_actions(_records(spark, sf_dir, "decision"), F.length("reviewer") > 1)


_STATUS = "CASE {} % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'partially_applied' WHEN 2 THEN 'unapplied' ELSE 'unidentified' END"


@query("status_snapshot", _led(f" SELECT payment_id, coalesce(now, 'unapplied') AS status FROM pay LEFT JOIN (SELECT settles, arg_max(status, (ts, status)) AS now FROM (SELECT 'INV-' || lpad({_E}, 9, '0') AS settles, ts, {_STATUS.format('user_id')} AS status FROM events UNION ALL SELECT 'INV-' || lpad({_ID.format('event_id + 2')}, 9, '0'), ts, {_STATUS.format('event_id')} FROM events) GROUP BY 1) USING (settles)"))
def status_snapshot(spark, sf_dir):
    pay, events = ledger.payments(spark, sf_dir), c._read(spark, sf_dir, "events")
    of = lambda shift, by: events.select(F.concat(F.lit("INV-"), F.lpad((F.col("event_id") + shift).cast("string"), 9, "0")).alias("settles"), F.col("ts").alias("at"), F.expr(_STATUS.format(by)).alias("status"))
    changes = of(0, "user_id").unionByName(of(2, "event_id")).join(pay.select("payment_id", "settles"), "settles").drop("settles")
    return records.status_snapshot(pay.select("payment_id", F.lit("unapplied").alias("status")), changes)


@query("deactivated_rules", _sql(" SELECT rule_id, active AND d.by IS NULL AS active, CASE WHEN active THEN d.by ELSE deactivated_by END AS deactivated_by FROM rule LEFT JOIN (SELECT 'FR-' || CAST(event_id % 1000 AS VARCHAR(12)) AS rule_id, min(CAST(user_id AS VARCHAR(12))) AS by FROM events WHERE event_type = 'click' GROUP BY 1) d USING (rule_id)", "rule"))
def deactivated_rules(spark, sf_dir):
    orders = c._read(spark, sf_dir, "events").where("event_type = 'click'").select(F.concat(F.lit("FR-"), (F.col("event_id") % 1000).cast("string")).alias("rule_id"), F.col("user_id").cast("string").alias("reviewer"))
    return records.deactivated(_records(spark, sf_dir, "rule"), orders)


@query("ruled_aliases", _sql(" SELECT key, coalesce(ruled, vendor_id) AS vendor_id FROM (SELECT DISTINCT 'name ' || CAST(c_custkey % 200 AS VARCHAR(12)) AS key, 'CUS-' || CAST(c_custkey % 200 AS VARCHAR(12)) AS vendor_id FROM customer) b FULL JOIN (SELECT raw_value AS key, arg_max(canonical_vendor_id, (created_at, rule_id)) AS ruled FROM rule WHERE active AND kind = 'vendor_alias' AND canonical_vendor_id IS NOT NULL GROUP BY 1) USING (key)", "rule"))
def ruled_aliases(spark, sf_dir):
    base = c._read(spark, sf_dir, "customer").select(F.expr("'name ' || CAST(c_custkey % 200 AS VARCHAR(12))").alias("key"), F.expr("'CUS-' || CAST(c_custkey % 200 AS VARCHAR(12))").alias("vendor_id")).distinct()
    return records.aliases_of_rules(_records(spark, sf_dir, "rule").where("canonical_vendor_id IS NOT NULL"), base)


@query("change_effects", _led(""" SELECT change_id, count(*) FILTER (outcome = 'released') AS released, count(*) FILTER (outcome = 'requires_named_release') AS named, count(*) FILTER (outcome = 'withheld') AS withheld, CAST(coalesce(sum(gross_paise) FILTER (outcome = 'released'), 0) AS BIGINT) AS released_paise,
    CAST(coalesce(sum(gross_paise) FILTER (outcome = 'requires_named_release'), 0) AS BIGINT) AS awaiting_paise FROM assessed JOIN inv ON id = invoice_id GROUP BY 1""", c._HOLDS, c._ASSESSED))
def change_effects(spark, sf_dir):
    return records.change_effects(c._assessed(spark, sf_dir), ledger.invoices(spark, sf_dir))


@query(
    "reach_matrix",
    _led(
        f""" SELECT k.kind, p.hold_type, coalesce(r.basis, 'none') AS basis, p.hold_type IN {c._in(UNREACHED)} AS unreached,
        (SELECT count(*) FROM hold h WHERE h.hold_type = p.hold_type) AS holds, (SELECT count(*) FROM change WHERE change.kind = k.kind) AS changes
        FROM {c._values([(k,) for k in TOLERANCE_KINDS], 'kind')} k CROSS JOIN policy p LEFT JOIN {c._values(REACH, 'kind, hold_type, basis')} r ON r.kind = k.kind AND r.hold_type = p.hold_type""",
        c._HOLDS, names=("change",),
    ),
)
def reach_matrix(spark, sf_dir):
    return review.reach_matrix(c._holds(spark, sf_dir), _records(spark, sf_dir, "change"))


@query(
    "release_types",
    _led(
        f""" SELECT kind, string_agg(hold_type, '+' ORDER BY hold_type) AS governed, coalesce(string_agg(hold_type, '+' ORDER BY hold_type) FILTER (basis = 'declared' AND auto_releasable), '') AS releasable,
        CAST(coalesce(sum(n), 0) AS BIGINT) AS governed_holds, CAST(coalesce(sum(n) FILTER (basis = 'declared' AND auto_releasable), 0) AS BIGINT) AS releasable_holds
        FROM {c._values(REACH, 'kind, hold_type, basis')} JOIN policy USING (hold_type) LEFT JOIN (SELECT hold_type, count(*) AS n FROM hold GROUP BY 1) USING (hold_type) GROUP BY 1""",
        c._HOLDS,
    ),
)
def release_types(spark, sf_dir):
    return records.release_types(c._holds(spark, sf_dir))


@query(
    "rule_canonical_forms",
    _sql(
        """, known AS (SELECT 'VEN-' || CAST(event_id AS VARCHAR(12)) AS vendor_id, 'grantor ' || CAST(event_id AS VARCHAR(12)) AS canonical FROM events WHERE event_id % 2 = 0),
        form AS (SELECT kind, raw_value AS key, canonical, vendor_id, rule_id, created_at FROM rule JOIN known ON vendor_id = canonical_vendor_id WHERE active AND kind = 'vendor_alias'
          UNION ALL SELECT kind, 'p ' || substr(pattern, 2), substr(pattern, 2), NULL, rule_id, created_at FROM rule WHERE active AND kind = 'reference_pattern' AND pattern IS NOT NULL)
        SELECT kind, key, arg_max(canonical, (created_at, rule_id)) AS canonical, arg_max_null(vendor_id, (created_at, rule_id)) AS vendor_id, arg_max(rule_id, (created_at, rule_id)) AS rule_id FROM form GROUP BY 1, 2""",
        "rule",
    ),
)
def rule_canonical_forms(spark, sf_dir):
    """What reviewers' rules make of names and references; a reference P17 reads as INV 17."""
    rules = _records(spark, sf_dir, "rule").withColumn("canonical_form", F.concat(F.lit("INV "), F.substring("pattern", 2, 20)))
    vendors = c._read(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.concat(F.lit("VEN-"), F.col("event_id").cast("string")).alias("vendor_id"), F.concat(F.lit("Grantor "), F.col("event_id").cast("string"), F.lit(" Ltd")).alias("vendor_name"))
    return records.canonical_forms(rules, vendors)


_SETS = f"""named AS (SELECT id AS invoice_id, any_value(j) AS j, any_value(gross_paise) AS gross_paise, any_value(invoice_date) AS invoice_date, list_sort(list(payment_id)) AS payment_ids,
    sum(amount_paise) AS amount_paise, max(value_date) AS value_date, max(round(agreement, 9)) AS re FROM agreed GROUP BY id),
  judged_sets AS (SELECT *, round({c._AMOUNT}, 9) AS am, round({c._DATE}, 9) AS da FROM named WHERE j % 13 <> 0),
  ranked_sets AS (SELECT *, round(greatest(0.0, least(1.0, CAST(0.35 AS DOUBLE) * am + CAST(0.4 AS DOUBLE) * re + CAST(0.1 AS DOUBLE) * da)), 6) AS composite FROM judged_sets)"""


@query(
    "reverified_sets",
    _led(
        f""" SELECT 'N-' || invoice_id AS nomination_id, invoice_id, array_to_string(payment_ids, '+') AS payment_ids, composite, CAST(amount_paise - gross_paise AS BIGINT) AS residual_paise, 'feedback_rule' AS proposed_by,
        row_number() OVER (ORDER BY composite DESC, re DESC, am DESC, abs({c._GAP}), array_to_string(payment_ids, '+'), invoice_id) AS rank FROM ranked_sets""",
        c._PAIRS, c._AGREE, _SETS,
    ),
)
def reverified_sets(spark, sf_dir):
    """All payments that quote a document, nominated as one set; every 13th document's set names a payment that isn't there and goes as a whole."""
    pairs = c._digit_scored(spark, sf_dir)
    unknown = F.when(F.max("j") % 13 == 0, F.array(F.lit("PAY-unknown"))).otherwise(F.array().cast("array<string>"))
    sets = pairs.groupBy(F.col("id").alias("invoice_id")).agg(F.concat(F.collect_list("payment_id"), unknown).alias("payment_ids"))
    nominations = sets.select(F.concat(F.lit("N-"), "invoice_id").alias("nomination_id"), "invoice_id", "payment_ids", F.lit("feedback_rule").alias("proposed_by"))
    return workflow.reverified(nominations, pairs, 6).withColumn("payment_ids", F.array_join("payment_ids", "+"))


_PREVIEWED = [("P1", "percentage", None), ("P2", "absolute_paise", "VEN-0000007"), ("P3", "similarity", None)]


@query("tolerance_preview", _led(f""" SELECT p.change_id, count(invoice_id) AS holds, count(DISTINCT invoice_id) AS documents, CAST(coalesce(sum(gross_paise), 0) AS BIGINT) AS money_paise FROM (SELECT * FROM (VALUES ('P1', 'percentage', NULL), ('P2', 'absolute_paise', 'VEN-0000007'), ('P3', 'similarity', NULL)) AS v(change_id, kind, own)) p
    LEFT JOIN (SELECT r.kind, h.invoice_id, i.vendor_id, i.gross_paise FROM hold h JOIN inv i ON i.id = h.invoice_id JOIN {c._values(REACH, 'kind, hold_type, basis')} r ON r.hold_type = h.hold_type WHERE i.j % 3 <> 0) m ON m.kind = p.kind AND (own IS NULL OR own = m.vendor_id) GROUP BY 1""", c._HOLDS))
def tolerance_preview(spark, sf_dir):
    inv = ledger.invoices(spark, sf_dir)
    open_ = c._holds(spark, sf_dir).join(inv.where("j % 3 <> 0").select(F.col("id").alias("invoice_id")), "invoice_id", "left_semi")
    return records.tolerance_preview(spark.createDataFrame(_PREVIEWED, "change_id string, kind string, vendor_id string"), open_, inv)


# --- outcomes and reviewers ------------------------------------------------------------------


@query("outcome_mix_by_digits", _led(" SELECT action, count(*) AS documents, CAST(sum(abs(gross_paise)) AS BIGINT) AS money_paise FROM decided d JOIN inv i ON i.id = d.invoice_id GROUP BY 1", c._PAIRS, c._AGREE, c._RANKED, c._HOLDS, c._DECIDED))
def outcome_mix_by_digits(spark, sf_dir):
    rows = c._decided_by_digits(spark, sf_dir).join(ledger.shuffled(ledger.invoices(spark, sf_dir).select(F.col("id").alias("invoice_id"), "gross_paise")), "invoice_id")
    return rows.groupBy("action").agg(F.count("*").alias("documents"), F.sum(F.abs("gross_paise")).alias("money_paise"))


@query("reviewer_activity", _sql(" SELECT run_id, count(*) AS decisions, count(DISTINCT reviewer) AS reviewers, count(DISTINCT case_id) AS cases FROM decision GROUP BY 1", "decision"))
def reviewer_activity(spark, sf_dir):
    return _records(spark, sf_dir, "decision").groupBy("run_id").agg(F.count("*").alias("decisions"), F.countDistinct("reviewer").alias("reviewers"), F.countDistinct("case_id").alias("cases"))


@query(
    "run_diff_totals",
    _led(
        """ SELECT n.action AS before, d.action AS after, count(*) AS documents, CAST(sum(gross_paise) AS BIGINT) AS money_paise
        FROM decided d JOIN inv i ON i.id = d.invoice_id JOIN naive n ON n.invoice_id = d.invoice_id WHERE n.action <> d.action GROUP BY 1, 2""",
        c._PAIRS, c._AGREE, c._RANKED, c._HOLDS, c._DECIDED, c._NAIVE,
    ),
)
def run_diff_totals(spark, sf_dir):
    rows = c.run_diff_by_digits(spark, sf_dir).join(ledger.shuffled(ledger.invoices(spark, sf_dir).select(F.col("id").alias("invoice_id"), "gross_paise")), "invoice_id")
    return rows.groupBy("before", "after").agg(F.count("*").alias("documents"), F.sum("gross_paise").alias("money_paise"))


_DECLARED = {"clean": 0.5, "duplicate": 0.1, "tolerance": 0.15, "cardinality": 0.1, "reference": 0.1, "period": 0.05}


@query("strata_mix_by_digits", _led(f""" SELECT stratum, declared, round(coalesce(total, 0) / CAST((SELECT count(*) FROM judged) AS DOUBLE), 9) AS realised, coalesce(total, 0) AS total, coalesce(decided, 0) AS decided, coalesce(coverage, 0) AS coverage, coalesce(false_clears, 0) AS false_clears, coalesce(at_risk_paise, 0) AS at_risk_paise
    FROM {c._values([(s, _DECLARED[s]) for s in STRATA], 'stratum, d')} LEFT JOIN (SELECT stratum, count(*) AS total, count(*) FILTER (decided) AS decided, count(*) FILTER (cleared AND NOT "right") AS false_clears, CAST(coalesce(sum(abs(gross_paise)) FILTER (cleared AND NOT "right"), 0) AS BIGINT) AS at_risk_paise,
    round(count(*) FILTER (decided) / CAST(count(*) AS DOUBLE), 9) AS coverage FROM judged GROUP BY 1) USING (stratum)""".replace("stratum, declared, round", "stratum, CAST(d AS DOUBLE) AS declared, round"), *c._JUDGED))
def strata_mix_by_digits(spark, sf_dir):
    return records.stratified(c._judged(spark, sf_dir, c._decided_by_digits), _DECLARED)


@query("orphan_truth", _led(" SELECT (SELECT count(*) FROM t WHERE invoice_id NOT IN (SELECT id FROM inv)) AS orphan_truth, (SELECT count(*) FROM inv WHERE id NOT IN (SELECT invoice_id FROM t)) AS missing_truth", "t AS (SELECT CASE WHEN j % 9 = 0 THEN 'X-' || id ELSE id END AS invoice_id FROM inv)"))
def orphan_truth(spark, sf_dir):
    inv = ledger.invoices(spark, sf_dir)
    return records.orphans(inv, inv.select(F.when(F.col("j") % 9 == 0, F.concat(F.lit("X-"), "id")).otherwise(F.col("id")).alias("invoice_id")))


# --- evidence and wire forms -----------------------------------------------------------------


@query("nomination_keys", _led(""" SELECT invoice_id, invoice_id || '|' || ids AS pairing_key, 'MC:R1:' || invoice_id || '|' || ids AS candidate_id, CASE WHEN n > 1 THEN 'one_to_many' ELSE 'one_to_one' END AS cardinality, CAST(gross_paise - settled AS BIGINT) AS residual_paise
    FROM (SELECT settles AS invoice_id, string_agg(payment_id, '+' ORDER BY payment_id) AS ids, count(*) AS n, sum(amount_paise) AS settled FROM pay GROUP BY 1) JOIN inv ON id = invoice_id"""))
def nomination_keys(spark, sf_dir):
    inv, pay = ledger.invoices(spark, sf_dir), ledger.payments(spark, sf_dir)
    sets = pay.groupBy(F.col("settles").alias("invoice_id")).agg(F.collect_list("payment_id").alias("payment_ids"))
    return records.nomination_keys(sets, inv, pay, "R1")


@query(
    "evidence_rows",
    _led(
        f""" SELECT id, payment_id, e.field, e.a AS invoice_value, e.b AS payment_value, CAST(e.d AS BIGINT) AS delta, e.w AS within FROM (SELECT id, payment_id, unnest([
        {{'field': 'amount', 'a': CAST(gross_paise AS VARCHAR), 'b': CAST(amount_paise AS VARCHAR), 'd': amount_paise - gross_paise, 'w': abs(amount_paise - gross_paise) <= {c._NEAR}}},
        {{'field': 'date', 'a': CAST(invoice_date AS VARCHAR), 'b': CAST(value_date AS VARCHAR), 'd': {c._GAP}, 'w': abs({c._GAP}) <= 45}},
        {{'field': 'reference', 'a': reference, 'b': narration_raw, 'd': 0, 'w': re > 0}}, {{'field': 'vendor', 'a': vendor_id, 'b': '', 'd': 0, 'w': FALSE}}]) AS e FROM cand)""",
        c._PAIRS, c._AGREE, c._RANKED,
    ),
)
def evidence_rows(spark, sf_dir):
    return records.evidence_rows(scoring.ranked(c._digit_scored(spark, sf_dir)), WINDOW_DAYS)


@query("score_aggregates", _led(" SELECT id, round(max(composite), 6) AS best, round(avg(composite), 6) AS mean, round(min(composite), 6) AS worst FROM comp GROUP BY 1", c._PAIRS, c._AGREE, c._RANKED))
def score_aggregates(spark, sf_dir):
    return c._digit_scored(spark, sf_dir).groupBy("id").agg(F.round(F.max("composite"), 6).alias("best"), F.round(F.avg("composite"), 6).alias("mean"), F.round(F.min("composite"), 6).alias("worst"))


_STRENGTH = ["reference_repeat", "vendor_amount_date", "vendor_amount_near_date"]


@query("ordered_signals", _led(" SELECT id AS invoice_id, prior_id, signal, row_number() OVER (PARTITION BY id ORDER BY CASE signal " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_STRENGTH)) + " END, prior_id) AS turn FROM signal WHERE signal IS NOT NULL", c._SIGNALS))
def ordered_signals(spark, sf_dir):
    return records.ordered_signals(holds.duplicate_signals(ledger.invoices(spark, sf_dir)), _STRENGTH)


@query("exact_ratios", "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 0.0 ELSE CAST(CAST(round(o_totalprice * 100) AS HUGEINT) * 1000000 // (o_custkey % 7 * 1000003) AS DOUBLE) / 1e6 END AS share FROM orders")
def exact_ratios(spark, sf_dir):
    rows = c._read(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("part"), (F.col("o_custkey") % 7 * 1_000_003).alias("whole"))
    return rows.select("o_orderkey", records.exact_ratio(F.col("part"), F.col("whole")).alias("share"))


@query("money_fields", "SELECT o_orderkey, CASE WHEN abs(m) <= 9007199254740991 THEN '\"gross\":' || m ELSE '\"gross_string\":\"' || m || '\"' END AS field FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 5 = 0 THEN 10000000000 ELSE -1 END AS m FROM orders)")
def money_fields(spark, sf_dir):
    rows = c._read(spark, sf_dir, "orders").select("o_orderkey", (F.round(F.col("o_totalprice") * 100).cast("long") * F.when(F.col("o_orderkey") % 5 == 0, 10_000_000_000).otherwise(-1)).alias("m"))
    return rows.select("o_orderkey", records.money_field("gross", F.col("m")).alias("field"))


@query("narration_residue", _led(f" SELECT payment_id, array_to_string(list_filter(tokens, lambda t: t NOT IN {c._in(c.NOISE_TOKENS)} AND NOT regexp_matches(t, '\\p{{N}}')), ' ') AS residue, len(list_filter(tokens, lambda t: regexp_full_match(t, '[0-9]{{2}}[a-z]{{5}}[0-9]{{4}}[a-z][0-9a-z][a-z][0-9a-z]'))) AS identifiers FROM (SELECT payment_id, {c._TOKENS.format('narration_raw')} AS tokens FROM pay)"))
def narration_residue(spark, sf_dir):
    return normalise.residue(ledger.payments(spark, sf_dir), "payment_id", "narration_raw")


@query("sorted_names", f"SELECT c_custkey, array_to_string(list_sort(list_distinct({c._TOKENS.format(f'({c._VENDOR})')})), ' ') AS sorted FROM customer")
def sorted_names(spark, sf_dir):
    return c._read(spark, sf_dir, "customer").select("c_custkey", normalise.token_sort(normalise.normalise(F.expr(c._VENDOR), "scan.v1"), dedupe=True).alias("sorted"))


_LOOKUP = f"array_to_string(list_filter({c._TOKENS.format(f'({c._VENDOR})')}, lambda t: t NOT IN {c._in(c.NOISE_TOKENS)} AND t NOT IN {c._in(c.LEGAL_SUFFIXES)}), ' ')"


@query("resolved_vendors", f"WITH n AS (SELECT c_custkey, {_LOOKUP} AS key FROM customer), a AS (SELECT key, min(CAST(c_custkey AS VARCHAR)) AS vendor_id FROM n WHERE c_custkey % 2 = 0 GROUP BY 1) SELECT c_custkey, vendor_id, CASE WHEN vendor_id IS NOT NULL THEN 'vendors' END AS rule_id FROM n LEFT JOIN a USING (key)")
def resolved_vendors(spark, sf_dir):
    names = c._read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("vendor_id"), normalise.normalise(F.expr(c._VENDOR), "vendor.v1", ["abbreviation_expand"]).alias("canonical"))
    table = narration.aliases_from_vendors(names.where("c_custkey % 2 = 0").select("vendor_id", "canonical"), F.col("canonical")).withColumn("rule_id", F.lit("vendors"))
    return names.select("c_custkey", F.col("canonical").alias("key")).join(table, "key", "left").select("c_custkey", "vendor_id", "rule_id")


# --- constraints -----------------------------------------------------------------------------

_SEEN = {
    "V3_unidentified_has_no_vendor": "p WHERE status = 'unidentified' AND vendor_id IS NOT NULL",
    "V5_rerun_names_parent": "run WHERE (kind = 'rerun') <> (parent_run_id IS NOT NULL)",
    "V6_terminal_is_finished": "run WHERE status IN ('completed', 'failed') AND finished_at IS NULL",
    "V7_totals_all_or_nothing": "run WHERE (totals_total IS NULL) <> (totals_coverage IS NULL)",
    "V8_cleared_is_reverified": "m WHERE cleared AND NOT reverified",
    "V9_one_to_one_has_one_payment": "m WHERE cardinality = 'one_to_one' AND payments <> 1",
    "V11_one_clear_per_invoice": "(SELECT id FROM m WHERE cleared GROUP BY 1 HAVING count(*) > 1)",
    "V13_conflict_shape": "(SELECT invoice_id FROM h WHERE FALSE)",
    "V14_release_triple": "h WHERE j % 3 = 0 AND j % 7 = 0",
    "V15_value_matches_kind": "change WHERE NOT CASE kind WHEN 'exact' THEN value_paise IS NULL AND value_ratio IS NULL AND value_days IS NULL WHEN 'absolute_paise' THEN value_paise IS NOT NULL AND value_ratio IS NULL AND value_days IS NULL WHEN 'days' THEN value_days IS NOT NULL AND value_paise IS NULL AND value_ratio IS NULL ELSE value_ratio IS NOT NULL AND value_paise IS NULL AND value_days IS NULL END",
    "V16_decision_rules": "decision WHERE (action = 'release_hold' AND hold_id IS NULL) OR (action = 'route' AND resolution_path IS NULL)",
    "V17_rule_body": "rule WHERE NOT CASE kind WHEN 'vendor_alias' THEN raw_value IS NOT NULL AND canonical_vendor_id IS NOT NULL AND pattern IS NULL WHEN 'reference_pattern' THEN pattern IS NOT NULL AND raw_value IS NULL AND canonical_vendor_id IS NULL ELSE raw_value IS NULL AND canonical_vendor_id IS NULL AND pattern IS NULL END",
    "V17_one_active_alias": "(SELECT raw_value FROM rule WHERE kind = 'vendor_alias' AND active GROUP BY 1 HAVING count(*) > 1)",
    "V19_held_and_cleared": "decided WHERE action = 'auto_clear' AND invoice_id IN (SELECT invoice_id FROM h WHERE j % 3 <> 0)",
    "V20_journal_shape": "chained WHERE NOT regexp_full_match(payload_hash, '[0-9a-f]{64}') OR (prev_hash IS NOT NULL AND NOT regexp_full_match(prev_hash, '[0-9a-f]{64}')) OR prev_hash IS NOT DISTINCT FROM payload_hash",
}


@query(
    "record_violations",
    _led(
        " " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS breaches FROM {v}" for k, v in _SEEN.items()),
        c._PAIRS, c._AGREE, c._RANKED, c._HOLDS, c._DECIDED, c._JOURNAL, *[f"{n} AS ({RECORDS[n]})" for n in RECORDS],
        f"p AS (SELECT payment_id, {_STATUS.format('j')} AS status, CASE WHEN j % 5 <> 0 THEN settles END AS vendor_id FROM pay JOIN inv ON id = settles)",
        "m AS (SELECT id, composite >= 0.75 AS cleared, rank < 3 AS reverified, CASE WHEN tied THEN 'one_to_many' ELSE 'one_to_one' END AS cardinality, rank AS payments FROM cand)",
        "h AS (SELECT invoice_id, j FROM hold JOIN inv ON id = invoice_id)",
    ),
)
def record_violations(spark, sf_dir):
    inv, pay, ranked = ledger.invoices(spark, sf_dir), ledger.payments(spark, sf_dir), c._digit_ranked(spark, sf_dir)
    j = inv.select(F.col("id").alias("settles"), "j")
    payments = pay.select("payment_id", "settles").join(j, "settles").select("payment_id", F.expr(_STATUS.format("j")).alias("status"), F.when(F.col("j") % 5 != 0, F.col("settles")).alias("vendor_id"))
    candidates = ranked.select("id", (F.col("composite") >= scoring.ACCEPT).alias("cleared"), (F.col("rank") < 3).alias("reverified"), F.when(F.col("tied"), "one_to_many").otherwise("one_to_one").alias("cardinality"), F.array_repeat("payment_id", F.col("rank")).alias("payment_ids"))
    third = F.col("j") % 3 == 0
    held = c._holds(spark, sf_dir).join(inv.select(F.col("id").alias("invoice_id"), "j"), "invoice_id").select("invoice_id", F.lit("residual_unsettled:material").alias("conflicts"), F.when(third, "system").alias("released_by"), F.when(third, "2024-01-01").alias("released_at"), F.when(third & (F.col("j") % 7 != 0), "tolerance").alias("release_reason"))
    cleared = c._decided_by_digits(spark, sf_dir).where("action = 'auto_clear'").select("invoice_id")
    rows = [_records(spark, sf_dir, n) for n in ("run", "change", "decision", "rule")]
    return records.record_violations(rows[0], payments, candidates, held, rows[1], rows[2], rows[3], c._journal(spark, sf_dir), cleared)


@query("distinct_conflicts", c._recursive(" SELECT invoice_id, conflicts, len(string_split(conflicts, '+')) AS conflicts_n FROM residual", c._PAIRS, c._FINDINGS))
def distinct_conflicts(spark, sf_dir):
    """Conflicts named twice teach nothing: each counts once, in the order first seen."""
    rows = cardinality.residual_holds(c.cardinality_findings(spark, sf_dir), ledger.invoices(spark, sf_dir))
    twice = F.array_distinct(F.concat(F.split("conflicts", r"\+"), F.split("conflicts", r"\+")))
    return rows.select("invoice_id", F.array_join(twice, "+").alias("conflicts"), F.size(twice).cast("long").alias("conflicts_n"))


@query("ledger_with_self", _led(" SELECT vendor_id, count(*) AS documents FROM inv GROUP BY 1"))
def ledger_with_self(spark, sf_dir):
    inv = ledger.invoices(spark, sf_dir)
    return records.with_self(inv, inv.where("j % 11 = 0")).groupBy("vendor_id").agg(F.count("*").alias("documents"))


@query("review_evidence", _sql(""" , seen AS (SELECT case_id, count(DISTINCT reviewer) AS reviewers FROM decision GROUP BY 1) SELECT (SELECT count(*) FROM decision) AS decisions, (SELECT count(DISTINCT reviewer) FROM decision) AS reviewers, (SELECT count(*) FROM seen) AS cases, (SELECT count(*) FROM seen WHERE reviewers > 1) AS second_person,
    (SELECT count(*) FROM change WHERE direction = 'widened') AS widened, (SELECT count(*) FROM change) AS changes""", "decision", "change"))
def review_evidence(spark, sf_dir):
    """The one row that heads a review's evidence: who decided how many cases, and how tolerances moved."""
    decisions, changes = _records(spark, sf_dir, "decision"), _records(spark, sf_dir, "change")
    seen = decisions.groupBy("case_id").agg(F.countDistinct("reviewer").alias("by")).agg(F.count("*").alias("cases"), F.count_if(F.col("by") > 1).alias("second_person"))
    acts = decisions.agg(F.count("*").alias("decisions"), F.countDistinct("reviewer").alias("reviewers"))
    moved = changes.agg(F.count_if(F.col("direction") == "widened").alias("widened"), F.count("*").alias("changes"))
    return acts.join(seen, F.lit(True)).join(moved, F.lit(True))

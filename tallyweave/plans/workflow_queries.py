"""More registered queries: narrations, nominations, releases, dossiers, review, text audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyweave.functions.similarity import digit_agreement
from tallyweave.operators import narration, normalise, review, scoring, workflow
from tallyweave.plans import catalogue as c
from tallyweave.plans.catalogue import query
from tallyweave.sources import datasets, ledger


@query("narration_references")
def narration_references(spark, sf_dir):
    return narration.narration_references(ledger.payments(spark, sf_dir), "payment_id", "narration_raw")


@query(
    "vendor_aliases",
    f"""WITH t AS (SELECT c_custkey, {c._TOKENS.format(f'({c._VENDOR})')} AS tokens FROM customer)
    SELECT array_to_string(list_filter(tokens, lambda t: t NOT IN {c._in(c.NOISE_TOKENS)} AND t NOT IN {c._in(c.LEGAL_SUFFIXES)}), ' ') AS key, min(CAST(c_custkey AS VARCHAR)) AS vendor_id FROM t GROUP BY 1""",
)
def vendor_aliases(spark, sf_dir):
    names = c._read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("vendor_id"), F.expr(c._VENDOR).alias("name"))
    rows = names.select("vendor_id", normalise.normalise(F.col("name"), "vendor.v1", ["abbreviation_expand"]).alias("canonical"))
    return narration.aliases_from_vendors(rows, F.col("canonical"))


_NOMINATED = """nominated AS (SELECT 'N-' || id AS nomination_id, id AS invoice_id, payment_id FROM inv LEFT JOIN pay ON settles = id WHERE copy IN (0, 3)
  UNION ALL SELECT 'N-' || id, id, 'PAY-none' FROM inv WHERE copy = 1),
sets AS (SELECT nomination_id, n.invoice_id, count(n.payment_id) AS named, count(amount_paise) AS known, max(gross_paise) AS gross_paise, max(invoice_date) AS invoice_date, CAST(sum(amount_paise) AS BIGINT) AS amount_paise, max(value_date) AS value_date,
  max(CASE WHEN amount_paise IS NOT NULL THEN CASE WHEN b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN length(x) < 4 OR length(y) < 4 THEN 0.0 WHEN x = y THEN 1.0 WHEN length(x) <= length(y) AND (starts_with(y, x) OR ends_with(y, x)) THEN CAST(length(x) AS DOUBLE) / length(y)
    WHEN length(y) < length(x) AND (starts_with(x, y) OR ends_with(x, y)) THEN CAST(length(y) AS DOUBLE) / length(x) ELSE 0.0 END END) AS re
  FROM (SELECT nominated.*, amount_paise, value_date, gross_paise, invoice_date, regexp_replace(reference, '[^0-9]+', '', 'g') AS a, regexp_replace(narration_raw, '[^0-9]+', '', 'g') AS b,
    regexp_replace(regexp_replace(reference, '[^0-9]+', '', 'g'), '^0+', '') AS x, regexp_replace(regexp_replace(narration_raw, '[^0-9]+', '', 'g'), '^0+', '') AS y
    FROM nominated JOIN inv ON inv.id = nominated.invoice_id LEFT JOIN pay ON pay.payment_id = nominated.payment_id) n GROUP BY 1, 2)"""


@query(
    "admission_gate",
    c._with(
        f""", scored AS (SELECT *, round(greatest(0.0, least(1.0, CAST(0.35 AS DOUBLE) * {c._AMOUNT} + CAST(0.4 AS DOUBLE) * re + CAST(0.1 AS DOUBLE) * {c._DATE})), 6) AS composite FROM sets)
    SELECT nomination_id, invoice_id, CASE WHEN named = 0 THEN 'empty_set' WHEN known < named THEN 'unknown_record' WHEN composite IS NULL THEN 'not_reverified' WHEN composite < 0.75 THEN 'below_accept_min' ELSE 'admitted' END AS verdict FROM scored""",
        _NOMINATED,
    ),
)
def admission_gate(spark, sf_dir):
    inv, pay = ledger.invoices(spark, sf_dir), ledger.payments(spark, sf_dir)
    sets = pay.groupBy(F.col("settles").alias("id")).agg(F.collect_list("payment_id").alias("payment_ids"))
    plain = inv.where("copy IN (0, 3)").select("id").join(sets, "id", "left").withColumn("payment_ids", F.coalesce("payment_ids", F.array().cast("array<string>")))
    bogus = inv.where("copy = 1").select("id", F.array(F.lit("PAY-none")).alias("payment_ids"))
    nominations = plain.unionByName(bogus).select(F.concat(F.lit("N-"), "id").alias("nomination_id"), F.col("id").alias("invoice_id"), "payment_ids")
    reference = digit_agreement(normalise.digits_of(F.col("reference")), normalise.digits_of(F.col("narration_raw")))
    return workflow.admitted(nominations, inv, pay, reference).select("nomination_id", "invoice_id", "verdict")


@query(
    "bulk_lines",
    c._with(
        """ SELECT payment_id, count(*) AS documents, CAST(sum(gross_paise) AS BIGINT) - max(amount_paise) AS residual_paise,
        abs(max(amount_paise) - sum(gross_paise)) <= greatest(50000, floor(abs(sum(gross_paise)) * CAST(0.12 AS DOUBLE) + 0.5)) AS within
        FROM met WHERE abs(date_diff('day', invoice_date, value_date)) <= 45 GROUP BY 1 HAVING count(*) >= 2""",
        c._PAIRS,
    ),
)
def bulk_lines(spark, sf_dir):
    inv, pay = ledger.invoices(spark, sf_dir), ledger.payments(spark, sf_dir)
    return workflow.bulk_lines(inv, pay, normalise.reference_keys(inv, "id", "reference"), normalise.reference_keys(pay, "payment_id", "narration_raw"))


@query("released_holds", c._with(" SELECT invoice_id, hold_type, CASE WHEN j % 3 = 0 THEN 'system' WHEN hold_type = 'period_deferral' THEN 'reviewer' END AS released_by FROM hold JOIN inv ON id = invoice_id", c._HOLDS))
def released_holds(spark, sf_dir):
    rows = c._holds(spark, sf_dir).join(ledger.invoices(spark, sf_dir).select(F.col("id").alias("invoice_id"), "j"), "invoice_id").withColumn("released_by", F.when(F.col("j") % 3 == 0, "system"))
    releases = rows.where("hold_type = 'period_deferral'").select("invoice_id", "hold_type", F.lit("reviewer").alias("released_by"))
    return workflow.released_holds(rows, releases)


@query(
    "dossiers_by_digits",
    c._with(
        """ SELECT h.invoice_id, i.vendor_id, h.hold_types, k.payment_id, k.composite, CAST(sum_gross AS BIGINT) AS vendor_gross_paise, alike - 1 AS alike
        FROM (SELECT invoice_id, string_agg(DISTINCT hold_type, '+' ORDER BY hold_type) AS hold_types FROM hold GROUP BY 1) h
        JOIN (SELECT *, sum(gross_paise) OVER (PARTITION BY vendor_id) AS sum_gross, count(*) OVER (PARTITION BY vendor_id, gross_paise) AS alike FROM inv) i ON i.id = h.invoice_id LEFT JOIN cand k ON k.id = h.invoice_id AND k.rank = 1""",
        c._PAIRS, c._AGREE, c._RANKED, c._HOLDS,
    ),
)
def dossiers_by_digits(spark, sf_dir):
    return workflow.dossiers(ledger.invoices(spark, sf_dir), c._holds(spark, sf_dir), c._digit_ranked(spark, sf_dir))


@query("dossiers")
def dossiers(spark, sf_dir):
    inv, ranked, held = c._run(spark, sf_dir)
    return workflow.dossiers(inv, held, ranked.withColumn("composite", F.round("composite", 9)))


@query(
    "review_precision",
    """WITH cases AS (SELECT o_orderkey AS case_id, CAST(round(o_totalprice * 100) AS BIGINT) AS money_paise FROM orders), seen AS (SELECT event_id AS case_id, user_id AS reviewer FROM events WHERE event_type IN ('click', 'purchase') UNION ALL SELECT user_id, event_id FROM events),
    r AS (SELECT case_id, money_paise, count(DISTINCT reviewer) AS n FROM cases LEFT JOIN seen USING (case_id) GROUP BY 1, 2)
    SELECT count(*) AS cases, count(*) FILTER (n > 0) AS reviewed, round(count(*) FILTER (n > 0) / CAST(count(*) AS DOUBLE), 9) AS precision, round(coalesce(sum(money_paise) FILTER (n > 0), 0) / CAST(sum(money_paise) AS DOUBLE), 9) AS precision_by_value,
    (SELECT case_id FROM r WHERE n = 0 ORDER BY money_paise DESC, case_id DESC LIMIT 1) AS largest_unreviewed, count(*) FILTER (n > 1) AS second_person FROM r""",
)
def review_precision(spark, sf_dir):
    cases = c._read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("money_paise"))
    events = c._read(spark, sf_dir, "events")
    acts = events.where("event_type IN ('click', 'purchase')").select(F.col("event_id").alias("case_id"), F.col("user_id").alias("reviewer")).unionByName(events.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("reviewer")))
    return workflow.review_precision(cases, acts)


@query(
    "regression_gate_by_digits",
    c._with(
        """, base AS (SELECT count(*) FILTER (payment_id IS NOT NULL) AS cleared, count(*) FILTER (payment_id IS NOT NULL AND payment_id IS DISTINCT FROM true_payment_ids) AS wrong, count(*) AS total FROM naive JOIN truth USING (invoice_id))
        SELECT NOT (false_clears > wrong AND coverage_strict <= round(cleared / CAST(b.total AS DOUBLE), 9)) AS clears_ok,
        round(coalesce(false_clears / CAST(nullif(auto_cleared, 0) AS DOUBLE), 0) - coalesce(wrong / CAST(nullif(cleared, 0) AS DOUBLE), 0), 9) AS rate_change,
        round(coalesce(false_clears / CAST(nullif(auto_cleared, 0) AS DOUBLE), 0) - coalesce(wrong / CAST(nullif(cleared, 0) AS DOUBLE), 0), 9) <= 0.02 AS rate_ok FROM totals CROSS JOIN base b""",
        *c._JUDGED, c._TOTALS, c._NAIVE,
    ),
)
def regression_gate_by_digits(spark, sf_dir):
    return _gate(spark, sf_dir, c._judged(spark, sf_dir, c._decided_by_digits))


@query("regression_gate")
def regression_gate(spark, sf_dir):
    return _gate(spark, sf_dir, c._judged(spark, sf_dir))


def _gate(spark, sf_dir, judged):
    inv, truth = ledger.invoices(spark, sf_dir), c._truth(spark, sf_dir)
    naive = scoring.naive_exact(inv, ledger.payments(spark, sf_dir)).select("invoice_id", "action", "payment_id", F.lit(None).cast("string").alias("hold_types"), (F.col("action") != "auto_clear").alias("requires_human"))
    base = review.eval_totals(review.scored_outcomes(inv, truth, naive))
    return workflow.regression_gate(base, review.eval_totals(judged))


@query(
    "quoted_numbers",
    r"""SELECT DISTINCT doc_id, number FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)', 1)) AS number FROM documents) WHERE number NOT IN (SELECT CAST(n_chars AS VARCHAR) FROM documents)""",
)
def quoted_numbers(spark, sf_dir):
    docs = c._read(spark, sf_dir, "documents")
    return workflow.quoted_numbers(docs, "doc_id", "text", docs.select(F.col("n_chars").cast("string").alias("number")))


_RULES = {"mail": "[a-z0-9.]+@[a-z0-9.]+", "rights": "(?i)licensed under|all rights reserved", "shout": "!!"}


@query("forbidden_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule, count(*) AS lines FROM l WHERE regexp_matches(line, '{p}') GROUP BY 1" for k, p in _RULES.items()))
def forbidden_lines(spark, sf_dir):
    return workflow.forbidden_lines(c._read(spark, sf_dir, "documents"), "doc_id", "text", _RULES)


@query(
    "parsed_outcomes",
    c._with(
        """ SELECT invoice_id, CASE WHEN action = 'auto_clear' AND payment_id IS NULL THEN 'unmatched' WHEN action = 'auto_clear' AND requires_human THEN 'unmatched' ELSE action END AS action, coalesce(payment_id, '') AS payment_ids, CAST(NULL AS VARCHAR) AS hold_type
        FROM (SELECT i.id AS invoice_id, CASE WHEN i.j % 2 = 0 THEN 'auto_clear' ELSE 'unmatched' END AS action, m.payment_id, i.j % 7 = 0 AS requires_human FROM inv i LEFT JOIN (SELECT settles, min(payment_id) AS payment_id FROM pay GROUP BY 1) m ON settles = i.id)"""
    ),
)
def parsed_outcomes(spark, sf_dir):
    inv = ledger.invoices(spark, sf_dir)
    least = ledger.payments(spark, sf_dir).groupBy(F.col("settles").alias("id")).agg(F.min("payment_id").alias("payment_id"))
    rows = inv.select("id", "j").join(least, "id", "left").select(F.col("id").alias("invoice_id"), F.when(F.col("j") % 2 == 0, "auto_clear").otherwise("unmatched").alias("action"), F.array_compact(F.array("payment_id", "payment_id")).alias("payment_ids"), F.lit(None).cast("string").alias("hold_type"), (F.col("j") % 7 == 0).alias("requires_human"), F.lit(1).alias("ordinal"))
    later = rows.withColumn("ordinal", F.lit(2)).withColumn("action", F.lit("hold"))
    unknown = rows.withColumn("invoice_id", F.concat(F.lit("X"), "invoice_id"))
    return datasets.parsed_outcomes(rows.unionByName(later).unionByName(unknown), inv)

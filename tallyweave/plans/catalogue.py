"""The registered queries over the ledger and the journal, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.reference_data import ABBREVIATIONS, AMOUNT_CAP, HOLD_POLICIES, LEGAL_SUFFIXES, NOISE_TOKENS, REACH, REFERENCE_PREFIXES, ROUTING, TOLERANCE_KINDS, UNREACHED
from tallyweave.functions.similarity import bare_digits, digit_agreement
from tallyweave.operators import cardinality, conflicts, evaluation, holds, normalise, review, scoring
from tallyweave.sources import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its oracle if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _with(body: str, *more: str) -> str:
    return "WITH " + ", ".join([ledger.LEDGER, *more]) + body


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _values(rows, columns: str) -> str:
    lit = lambda x: str(x) if isinstance(x, (int, float, bool)) else f"'{x}'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({columns}))"


# --- canonical forms -------------------------------------------------------------------------

_TOKENS = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')"
_SEGMENTS = "regexp_extract_all(lower({0}), '(\\p{{L}}+|\\p{{N}}+)', 1)"
_NUMBERS = """list_distinct(list_transform(list_concat(
    list_filter(regexp_extract_all(lower({0}), '([0-9]+)', 1), lambda t: length(t) >= 4 AND NOT regexp_full_match(t, '(19|20)[0-9]{{2}}')),
    regexp_extract_all(lower({0}), 'inv(?:19|20)[0-9]{{2}}([0-9]{{4,}})', 1)), lambda t: regexp_replace(t, '^0+([0-9])', '\\1')))"""
_KEYS = f"""inv_key AS (SELECT id, unnest({_NUMBERS.format('reference')}) AS number FROM inv),
pay_key AS (SELECT payment_id, unnest({_NUMBERS.format('narration_raw')}) AS number FROM pay)"""


@query(
    "reference_canonical",
    _with(f""" SELECT id, array_to_string(list_transform(list_filter({_SEGMENTS.format('reference')}, lambda t: t NOT IN {_in(REFERENCE_PREFIXES)}),
      lambda t: regexp_replace(t, '^0+([0-9]+)$', '\\1')), ' ') AS canonical, regexp_replace(reference, '[^0-9]+', '', 'g') AS digits, regexp_replace(upper(reference), '[^A-Z0-9]', '', 'g') AS duplicate_key FROM inv"""),
)
def reference_canonical(spark, sf_dir):
    ref = F.col("reference")
    return ledger.invoices(spark, sf_dir).select("id", normalise.normalise(ref, "reference.v2").alias("canonical"), normalise.digits_of(ref).alias("digits"), normalise.duplicate_key(ref).alias("duplicate_key"))


_VENDOR = "c_name || CASE c_custkey % 4 WHEN 0 THEN ' Engg & Tech Pvt. Ltd.' WHEN 1 THEN ' Svcs  Pvt Ltd' WHEN 2 THEN ' (Mfg) Co., LLP' ELSE ' Intl. Trdg Inc' END"


@query(
    "vendor_canonical",
    f"""WITH t AS (SELECT c_custkey, {_TOKENS.format(f'({_VENDOR})')} AS tokens FROM customer),
    k AS (SELECT c_custkey, list_filter(tokens, lambda t: t NOT IN {_in(NOISE_TOKENS)} AND t NOT IN {_in(LEGAL_SUFFIXES)}) AS tokens FROM t)
    SELECT c_custkey, array_to_string(list_transform(tokens, lambda t: coalesce(MAP {{{', '.join(f"'{a}': '{b}'" for a, b in ABBREVIATIONS.items())}}}[t], t)), ' ') AS canonical FROM k""",
)
def vendor_canonical(spark, sf_dir):
    names = _read(spark, sf_dir, "customer").select("c_custkey", F.expr(_VENDOR).alias("name"))
    return names.select("c_custkey", normalise.normalise(F.col("name"), "vendor.v1").alias("canonical"))


@query(
    "token_class",
    _with(f""" SELECT payment_id, i - 1 AS "index", t AS token, CASE WHEN t IN {_in(NOISE_TOKENS)} THEN 'noise'
      WHEN regexp_full_match(t, '[0-9]{{2}}[A-Za-z]{{5}}[0-9]{{4}}[A-Za-z][0-9A-Za-z][A-Za-z][0-9A-Za-z]') THEN 'identifier' WHEN regexp_full_match(t, '\\p{{N}}+') THEN 'numeric'
      WHEN regexp_matches(t, '\\p{{N}}') AND regexp_matches(t, '\\p{{L}}') THEN 'mixed_alphanumeric' ELSE 'word' END AS klass
      FROM (SELECT payment_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS i FROM (SELECT payment_id, {_TOKENS.format('narration_raw')} AS tokens FROM pay))"""),
)
def token_class(spark, sf_dir):
    return normalise.classified_tokens(ledger.payments(spark, sf_dir), "payment_id", "narration_raw")


@query(
    "displaced_tokens",
    _with(f""" SELECT payment_id, t AS token, CASE WHEN regexp_full_match(t, '\\p{{N}}+') OR regexp_matches(t, '\\p{{N}}') THEN 'reference' END AS belongs_to
      FROM (SELECT payment_id, unnest({_TOKENS.format('narration_raw')}) AS t FROM pay)
      WHERE t NOT IN {_in(NOISE_TOKENS)} AND NOT regexp_full_match(t, '[0-9]{{2}}[A-Za-z]{{5}}[0-9]{{4}}[A-Za-z][0-9A-Za-z][A-Za-z][0-9A-Za-z]')
        AND regexp_matches(t, '\\p{{N}}') AND (NOT regexp_full_match(t, '\\p{{N}}+') OR length(t) >= 3)"""),
)
def displaced_tokens(spark, sf_dir):
    tokens = normalise.classified_tokens(ledger.payments(spark, sf_dir), "payment_id", "narration_raw")
    return normalise.displaced_tokens(tokens, "narration").where("belongs_to = 'reference'").select("payment_id", "token", "belongs_to")


_GSTIN = "'Z' || CAST(1 + c_custkey % 8 AS VARCHAR(2)) || '-A8CDE' || lpad(CAST(c_custkey % 1000 AS VARCHAR(6)), 3, '0') || 'OF1' || 'z' || 'O'"
_KIND = [("ODILZSB", "0011258")] * 2 + [("01258", "OIZSB")] * 5 + [("ODILZSB", "0011258")] * 4 + [("01258", "OIZSB"), None, ("01258", "OIZSB"), None]


@query(
    "identifier_repair",
    "WITH g AS (SELECT c_custkey, regexp_replace(upper(" + _GSTIN + "), '[^0-9A-Z]', '', 'g') AS p FROM customer) SELECT c_custkey, CASE WHEN length(p) = 15 THEN "
    + " || ".join(f"translate(substr(p, {i + 1}, 1), '{k[0]}', '{k[1]}')" if k else f"substr(p, {i + 1}, 1)" for i, k in enumerate(_KIND))
    + " ELSE p END AS identifier FROM g",
)
def identifier_repair(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", normalise.identifier_repair(F.expr(_GSTIN)).alias("identifier"))


@query("rule_string")
def rule_string(spark, sf_dir):
    return ledger.payments(spark, sf_dir).select("payment_id", normalise.changed_steps(F.col("narration_raw"), "narration.v1").alias("rule"))


@query("unicode_fold")
def unicode_fold(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(normalise.unicode_fold(F.col("text")).cast("binary"), 256).alias("folded_sha256"))


# --- pairs and scores ------------------------------------------------------------------------

_EXACT = f"{_KEYS}, exact AS (SELECT DISTINCT i.id AS invoice_id, p.payment_id FROM inv_key ik JOIN inv i USING (id) JOIN pay_key pk ON pk.number = ik.number JOIN pay p ON p.payment_id = pk.payment_id AND p.amount_paise = i.gross_paise)"


@query("exact_pairs", _with(" SELECT * FROM exact", _EXACT))
def exact_pairs(spark, sf_dir):
    return scoring.exact_pairs(ledger.invoices(spark, sf_dir), ledger.payments(spark, sf_dir))


_NAIVE = "naive AS (SELECT id AS invoice_id, CASE WHEN coalesce(r.payment_id, m.payment_id) IS NULL THEN 'unmatched' ELSE 'auto_clear' END AS action, coalesce(r.payment_id, m.payment_id) AS payment_id FROM inv LEFT JOIN (SELECT reference_extracted, min(payment_id) AS payment_id FROM pay WHERE reference_extracted <> '' GROUP BY 1) r ON r.reference_extracted = inv.reference LEFT JOIN (SELECT amount_paise, min(payment_id) AS payment_id FROM pay GROUP BY 1) m ON m.amount_paise = gross_paise)"


@query("naive_exact", _with(" SELECT * FROM naive", _NAIVE))
def naive_exact(spark, sf_dir):
    return scoring.naive_exact(ledger.invoices(spark, sf_dir), ledger.payments(spark, sf_dir))


_PAIRS = f"{_KEYS}, pairs AS (SELECT DISTINCT ik.id, pk.payment_id FROM inv_key ik JOIN pay_key pk USING (number)), met AS (SELECT * FROM pairs JOIN inv USING (id) JOIN pay USING (payment_id))"
_AMOUNT = """(CASE WHEN amount_paise > gross_paise THEN 0.6 ELSE 1 END * CASE WHEN amount_paise = gross_paise THEN 1.0
   WHEN abs(amount_paise - gross_paise) <= {near} THEN 1 - CAST(0.45 AS DOUBLE) * abs(amount_paise - gross_paise) / {near}
   WHEN abs(amount_paise - gross_paise) <= {zero} THEN CAST(0.55 AS DOUBLE) * ({zero} - abs(amount_paise - gross_paise)) / ({zero} - {near}) ELSE 0.0 END)"""
_NEAR = "greatest(50000, floor(abs(gross_paise) * CAST(0.12 AS DOUBLE) + 0.5))"
_ZERO = f"greatest({_NEAR}, floor(abs(gross_paise) * CAST(0.5 AS DOUBLE) + 0.5))"
_AMOUNT = _AMOUNT.format(near=_NEAR, zero=_ZERO)
_GAP = "date_diff('day', invoice_date, value_date)"
_DATE = f"(CASE WHEN {_GAP} < 0 THEN 0.6 ELSE 1 END * CASE WHEN abs({_GAP}) <= 21 THEN 1.0 WHEN abs({_GAP}) <= 45 THEN 1 - CAST(0.8 AS DOUBLE) * (abs({_GAP}) - 21) / 24 ELSE 0.0 END)"


def _met(spark, sf_dir) -> DataFrame:
    """Invoices beside the payments that quote one of their numbers, with the digits of both texts."""
    reference, narration = F.col("reference"), F.col("narration_raw")
    inv = ledger.invoices(spark, sf_dir).withColumns({"numbers": normalise.reference_numbers(reference), "reference_digits": normalise.digits_of(reference)})
    pay = ledger.payments(spark, sf_dir).withColumns({"numbers": normalise.reference_numbers(narration), "narration_digits": normalise.digits_of(narration)})
    return normalise.quoted_pairs(inv, pay)


@query("amount_score", _with(f" SELECT id, payment_id, round({_AMOUNT}, 9) AS amount_score, abs(amount_paise - gross_paise) <= {_NEAR} AS within FROM met", _PAIRS))
def amount_score(spark, sf_dir):
    g, a = F.col("gross_paise"), F.col("amount_paise")
    return _met(spark, sf_dir).select("id", "payment_id", F.round(scoring.amount_score(g, a), 9).alias("amount_score"), scoring.amount_within(g, a).alias("within"))


@query("date_score", _with(f" SELECT id, payment_id, round({_DATE}, 9) AS date_score FROM met", _PAIRS))
def date_score(spark, sf_dir):
    return _met(spark, sf_dir).select("id", "payment_id", F.round(scoring.date_score(F.col("invoice_date"), F.col("value_date")), 9).alias("date_score"))


_RATE = lambda base, r: f"floor(abs({base}) * CAST({r} AS DOUBLE) + 0.5)"
_D = "abs(amount_paise - gross_paise)"
_TDS = " OR ".join(f"abs({_D} - {_RATE('gross_paise', r)}) <= 100" for r in (0.01, 0.02, 0.05, 0.1))


@query(
    "loose_cause",
    _with(f""" SELECT id, payment_id, CASE WHEN amount_paise = gross_paise THEN 'unattributed' WHEN {_D} <= 100 THEN 'rounding' WHEN amount_paise > gross_paise THEN 'unattributed'
      WHEN {_TDS} THEN 'tds_withholding' WHEN {_D} <= 6000 THEN 'bank_charge' WHEN {_D} <= {_RATE('gross_paise', 0.03)} THEN 'early_payment_discount' ELSE 'partial_settlement' END AS cause FROM met""", _PAIRS),
)
def loose_cause(spark, sf_dir):
    return _met(spark, sf_dir).select("id", "payment_id", scoring.loose_cause(F.col("gross_paise"), F.col("amount_paise")).alias("cause"))


_DIG = "regexp_replace({0}, '[^0-9]+', '', 'g')"
_STRIP = "regexp_replace({0}, '^0+', '')"
_AGREE = f"""digits AS (SELECT *, {_DIG.format('reference')} AS a, {_DIG.format('narration_raw')} AS b FROM met),
stripped AS (SELECT *, {_STRIP.format('a')} AS x, {_STRIP.format('b')} AS y FROM digits),
agreed AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN length(x) < 4 OR length(y) < 4 THEN 0.0 WHEN x = y THEN 1.0
  WHEN length(x) <= length(y) AND (starts_with(y, x) OR ends_with(y, x)) THEN CAST(length(x) AS DOUBLE) / length(y)
  WHEN length(y) < length(x) AND (starts_with(x, y) OR ends_with(x, y)) THEN CAST(length(y) AS DOUBLE) / length(x) ELSE 0.0 END AS agreement FROM stripped)"""


@query("digit_agreement", _with(" SELECT id, payment_id, round(agreement, 9) AS agreement FROM agreed", _PAIRS, _AGREE))
def digits_agree(spark, sf_dir):
    a, b = F.col("reference_digits"), F.col("narration_digits")
    return _met(spark, sf_dir).select("id", "payment_id", F.round(digit_agreement(a, b), 9).alias("agreement"))


def _digit_scored(spark, sf_dir) -> DataFrame:
    scores = {
        "amount": scoring.amount_score(F.col("gross_paise"), F.col("amount_paise"), (F.col("near"), F.col("zero"))),
        "reference": digit_agreement(F.col("reference_digits"), F.col("narration_digits"), bare=(F.col("reference_bare"), F.col("narration_bare"))),
        "date": scoring.date_score(F.col("invoice_date"), F.col("value_date")),
        "vendor": F.lit(0.0),
    }
    near, zero = scoring.amount_bands(F.col("gross_paise"))
    bare = {f"{k}_bare": bare_digits(F.col(f"{k}_digits")) for k in ("reference", "narration")}
    rows = _met(spark, sf_dir).withColumns({"near": near, "zero": zero, **bare}).select("*", *[v.alias(f"{k}_score") for k, v in scores.items()]).drop("reference_digits", "narration_digits", "reference_bare", "narration_bare", "near", "zero")
    rows = rows.withColumns({f"{k}_score": scoring.rounded(F.col(f"{k}_score"), 9) for k in scores})
    return rows.withColumn("composite", scoring.rounded(scoring.composite({k: F.col(f"{k}_score") for k in scores}), 6))


def _digit_ranked(spark, sf_dir) -> DataFrame:
    """The candidates by digits, ranked, without their rows' other columns; written once a session."""
    return ledger.kept(spark, sf_dir, "digit_ranked", lambda: scoring.ranked(_digit_scored(spark, sf_dir)).select("id", "payment_id", "composite", "rank", "tied"))


_RANKED = f"""scores AS (SELECT *, round({_AMOUNT}, 9) AS am, round(agreement, 9) AS re, round({_DATE}, 9) AS da FROM agreed),
comp AS (SELECT *, round(greatest(0.0, least(1.0, CAST(0.35 AS DOUBLE) * am + CAST(0.4 AS DOUBLE) * re + CAST(0.1 AS DOUBLE) * da)), 6) AS composite FROM scores),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY composite DESC, re DESC, am DESC, abs({_GAP}), payment_id) AS rank FROM comp WHERE composite >= 0.25),
tops AS (SELECT *, max(composite) OVER (PARTITION BY id) - composite <= 0.02 AS in_tie FROM numbered WHERE rank <= 5),
cand AS (SELECT *, in_tie AND sum(CASE WHEN in_tie THEN 1 ELSE 0 END) OVER (PARTITION BY id) >= 2 AS tied FROM tops)"""


@query("rank_candidates_by_digits", _with(" SELECT id, payment_id, composite, CAST(rank AS INTEGER) AS rank, tied FROM cand", _PAIRS, _AGREE, _RANKED))
def rank_candidates_by_digits(spark, sf_dir):
    return _digit_ranked(spark, sf_dir)


@query("contested_payments_by_digits", _with(" SELECT payment_id, count(*) AS claimants, string_agg(id, '+' ORDER BY id) AS invoice_ids FROM cand WHERE rank = 1 AND composite >= 0.7 GROUP BY 1 HAVING count(*) > 1", _PAIRS, _AGREE, _RANKED))
def contested_payments_by_digits(spark, sf_dir):
    return scoring.contested(_digit_ranked(spark, sf_dir), accept=0.7)


def _prepared(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prepared invoices and payments, and the names of vendors and payers that are alike; written once a session."""
    inv, pay = ledger.invoices(spark, sf_dir), ledger.payments(spark, sf_dir)
    left = ledger.kept(spark, sf_dir, "prepared_invoices", lambda: scoring.prepared_invoices(inv))
    right = ledger.kept(spark, sf_dir, "prepared_payments", lambda: scoring.prepared_payments(pay, inv.select("vendor_id", "vendor_name").distinct()))
    return left, right, ledger.kept(spark, sf_dir, "name_links", lambda: scoring.name_links(left, right))


def _candidates(spark, sf_dir) -> DataFrame:
    """The ranked candidates of each invoice; written once a session."""

    def rows() -> DataFrame:
        left, right, names = _prepared(spark, sf_dir)
        ranked = scoring.ranked(scoring.scored_pairs(scoring.candidate_pairs(left, right, names), left, right, top=scoring.TOP))
        own = [c for c in ledger.invoices(spark, sf_dir).columns if c not in ranked.columns]
        return ranked.join(ledger.shuffled(left.select("id", *own)), "id")

    return ledger.kept(spark, sf_dir, "candidates", rows)


@query("rank_candidates")
def rank_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("id", "payment_id", F.round("composite", 9).alias("composite"), "rank", "tied")


@query("contested_payments")
def contested_payments(spark, sf_dir):
    return scoring.contested(_candidates(spark, sf_dir))


@query("candidates")
def candidates(spark, sf_dir):
    """Ranked candidates with what speaks against each."""
    scores = [F.round(f"{k}_score", 9).alias(f"{k}_score") for k in scoring.WEIGHTS]
    return _candidates(spark, sf_dir).select("id", "payment_id", F.round("composite", 9).alias("composite"), *scores, "rank", "tied", conflicts.pair_conflicts().alias("conflicts"))


# --- holds -----------------------------------------------------------------------------------


def _documents_query(name: str, f, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(ledger.invoices(spark, sf_dir))
    ORACLES[name] = sql


_DIST = "SELECT id AS invoice_id, gross_paise - net_paise - tax_total AS delta_paise FROM inv WHERE gross_paise - net_paise - tax_total <> 0"
_SCHEME = "scheme AS (SELECT id, vendor_id, CASE WHEN (cgst <> 0 OR sgst <> 0) AND igst <> 0 THEN 'mixed' WHEN cgst <> 0 OR sgst <> 0 THEN 'intra' WHEN igst <> 0 THEN 'inter' ELSE 'exempt' END AS scheme FROM inv)"
_ESTABLISHED = _SCHEME + """, others AS (SELECT *, count(*) FILTER (scheme = 'intra') OVER (PARTITION BY vendor_id) - CASE WHEN scheme = 'intra' THEN 1 ELSE 0 END AS a,
   count(*) FILTER (scheme = 'inter') OVER (PARTITION BY vendor_id) - CASE WHEN scheme = 'inter' THEN 1 ELSE 0 END AS b FROM scheme),
established AS (SELECT id AS invoice_id, scheme, CASE WHEN a > 0 AND b = 0 THEN 'intra' WHEN b > 0 AND a = 0 THEN 'inter' END AS established FROM others)"""
_RATES = [f"floor(abs(net_paise) * CAST({r} AS DOUBLE) / 100 + 0.5)" for r in (0, 5, 12, 18, 28)]
_DELTAS = f"""due AS (SELECT *, igst + cgst + sgst + cess - tax_total AS parts_delta, abs(tax_total) AS parts_due, abs(tax_total) - abs(cess) AS d0, list_value({', '.join(_RATES)}) AS rates FROM inv),
near AS (SELECT *, rates[CAST(list_position(list_transform(rates, lambda r: abs(d0 - r)), list_min(list_transform(rates, lambda r: abs(d0 - r)))) AS INTEGER)] AS rate_due FROM due),
deltas AS (SELECT *, CASE WHEN net_paise <> 0 THEN CAST(d0 - rate_due AS BIGINT) ELSE 0 END AS rate_delta FROM near)"""
_TAXV = """taxv AS (SELECT id AS invoice_id, concat_ws('+', CASE WHEN scheme = 'mixed' THEN 'mixed_heads' END, CASE WHEN scheme = 'intra' AND abs(cgst - sgst) > 1 THEN 'uneven_halves' END,
   CASE WHEN scheme = 'inter' AND parts_delta = 0 AND established = 'intra' THEN 'vendor_is_intra' END, CASE WHEN abs(parts_delta) * 10000 > parts_due * 100 THEN 'parts_off_total' END,
   CASE WHEN abs(rate_delta) * 10000 > rate_due * 100 THEN 'total_off_rate' END) AS reasons FROM deltas JOIN established ON invoice_id = id)"""
_RANGE = "SELECT id AS invoice_id, greatest(abs(parts_delta), abs(rate_delta)) AS delta_paise FROM deltas WHERE greatest(abs(parts_delta), abs(rate_delta)) > 10000"
_MONTH = "strftime({0}, '%Y-%m')"
_PERIOD = f"SELECT id AS invoice_id, period, {_MONTH.format('invoice_date')} AS invoice_month, {_MONTH.format('received_date')} <> {_MONTH.format('invoice_date')} AS received_elsewhere FROM inv WHERE period <> {_MONTH.format('invoice_date')}"
_CROSSING = f"SELECT id AS invoice_id, {_MONTH.format('invoice_date')} AS invoice_month, {_MONTH.format('received_date')} AS received_month FROM inv WHERE is_credit_note AND {_MONTH.format('received_date')} <> {_MONTH.format('invoice_date')}"
_SIGNALS = f"""doc AS (SELECT id, vendor_id, regexp_replace(upper(reference), '[^A-Z0-9]', '', 'g') AS ref, gross_paise, invoice_date, received_date, recurrence, period FROM inv WHERE NOT is_credit_note),
signal AS (SELECT s.*, p.id AS prior_id, p.gross_paise AS prior_gross, p.recurrence AS prior_recurrence, p.period AS prior_period,
  CASE WHEN s.ref = p.ref THEN 'reference_repeat' WHEN s.gross_paise <> p.gross_paise THEN NULL WHEN s.invoice_date = p.invoice_date OR s.received_date = p.received_date THEN 'vendor_amount_date'
       WHEN abs(date_diff('day', p.invoice_date, s.invoice_date)) <= 45 THEN 'vendor_amount_near_date' END AS signal
  FROM doc s JOIN doc p ON s.vendor_id = p.vendor_id AND (s.received_date, s.id) > (p.received_date, p.id) AND ((s.ref <> '' AND s.ref = p.ref) OR (s.gross_paise = p.gross_paise AND s.ref <> p.ref)))"""
_SERIES = """steps AS (SELECT *, lag(invoice_date) OVER (PARTITION BY vendor_id, gross_paise, recurrence ORDER BY invoice_date, id) AS before FROM inv WHERE recurrence IS NOT NULL),
ok AS (SELECT *, coalesce(CASE recurrence WHEN 'monthly' THEN year(invoice_date) * 12 + month(invoice_date) - year(before) * 12 - month(before) = 1 AND abs(day(invoice_date) - day(before)) <= 3
   WHEN 'quarterly' THEN year(invoice_date) * 12 + month(invoice_date) - year(before) * 12 - month(before) = 3 AND abs(day(invoice_date) - day(before)) <= 3 ELSE date_diff('day', before, invoice_date) >= 20 END, TRUE) AS fine FROM steps),
series AS (SELECT vendor_id, gross_paise, recurrence, count(*) AS members FROM ok GROUP BY 1, 2, 3
   HAVING count(*) >= 3 AND bool_and(fine) AND count(DISTINCT period) = count(*) AND count(DISTINCT regexp_replace(upper(reference), '[^A-Z0-9]', '', 'g')) = count(*))"""
_DUPLICATES = f"""dups AS (SELECT s.id AS invoice_id, s.prior_id, s.signal, CASE WHEN s.signal = 'reference_repeat' AND s.gross_paise <> s.prior_gross AND s.gross_paise <= {AMOUNT_CAP} THEN 'material' ELSE 'blocking' END AS severity
   FROM signal s LEFT JOIN series r ON r.vendor_id = s.vendor_id AND r.gross_paise = s.gross_paise AND r.recurrence = s.recurrence
   WHERE s.signal IS NOT NULL AND NOT (r.members IS NOT NULL AND s.recurrence IS NOT DISTINCT FROM s.prior_recurrence AND s.period <> s.prior_period AND s.signal <> 'reference_repeat')
     AND (s.signal <> 'vendor_amount_near_date' OR s.gross_paise > {AMOUNT_CAP}))"""

_documents_query("dist_variance", holds.dist_variance, _with(" " + _DIST))
_documents_query("tax_scheme", holds.established_scheme, _with(" SELECT * FROM established", _ESTABLISHED))
_documents_query("tax_variance", holds.tax_variance, _with(" SELECT * FROM taxv WHERE reasons <> ''", _ESTABLISHED, _DELTAS, _TAXV))
_documents_query("tax_amount_range", holds.tax_amount_range, _with(" " + _RANGE, _DELTAS))
_documents_query("period_deferral", holds.period_deferral, _with(" " + _PERIOD))
_documents_query("credit_note_crossing", holds.credit_note_crossing, _with(" " + _CROSSING))
_documents_query("recurring_series", holds.recurring_series, _with(" SELECT * FROM series", _SERIES))
_documents_query("duplicate_candidates", holds.duplicate_candidates, _with(" SELECT * FROM dups", _SIGNALS, _SERIES, _DUPLICATES))
for _signal in ("reference_repeat", "vendor_amount_date", "vendor_amount_near_date"):
    _documents_query(
        f"dup_{_signal}",
        lambda invoices, s=_signal: holds.duplicate_signals(invoices).where(F.col("signal") == s).select(F.col("id").alias("invoice_id"), "prior_id"),
        _with(f" SELECT id AS invoice_id, prior_id FROM signal WHERE signal = '{_signal}'", _SIGNALS),
    )

_HIT = lambda base, rates: "(" + " OR ".join(f"short = floor(CAST({base} AS DOUBLE) * {r} / 10000 + 0.5)" for r in rates) + ")"
_CAUSE = f"""caused AS (SELECT id, payment_id, amount_paise - gross_paise AS delta_paise, CASE WHEN short = 0 THEN 'none' WHEN abs(short) < 100 THEN 'rounding'
   WHEN short > 0 AND short <= 100000 AND fee % 100 = 0 AND floor(fee * CAST(1.18 AS DOUBLE) + 0.5) = short THEN 'bank_charge'
   WHEN short > 0 AND {_HIT('net_paise', (100, 200, 500, 1000))} THEN 'tds_withholding'
   WHEN short > 0 AND value_date < due_date AND {_HIT('gross_paise', (100, 150, 200, 250, 300))} THEN 'early_payment_discount' ELSE 'unattributed' END AS cause
   FROM (SELECT *, gross_paise - amount_paise AS short, CAST(floor(abs(gross_paise - amount_paise) / CAST(1.18 AS DOUBLE) + 0.5) AS BIGINT) AS fee FROM met))"""


@query("delta_cause", _with(" SELECT * FROM caused", _PAIRS, _CAUSE))
def delta_cause(spark, sf_dir):
    cause = holds.delta_cause(F.col("gross_paise"), F.col("net_paise"), F.col("due_date"), F.col("amount_paise"), F.col("value_date"))
    return _met(spark, sf_dir).select("id", "payment_id", (F.col("amount_paise") - F.col("gross_paise")).alias("delta_paise"), cause.alias("cause"))


@query("price_variance")
def price_variance(spark, sf_dir):
    return holds.price_variance(_candidates(spark, sf_dir))


_SUBSETS = """{0}_pool AS (SELECT *, row_number() OVER (PARTITION BY {1} ORDER BY {2}) AS k FROM {0}_pairs),
{0}_sub AS (SELECT {1}, k, {3} AS total, 1 AS n, {2} AS parts FROM {0}_pool UNION ALL SELECT s.{1}, p.k, s.total + p.{3}, s.n + 1, s.parts || '+' || p.{2} FROM {0}_sub s JOIN {0}_pool p ON p.{1} = s.{1} AND p.k > s.k),
{0}_sums AS (SELECT {1}, any_value(goal) AS goal, count(*) FILTER (total = goal) AS exact, count(*) FILTER (total = goal AND n > 1) AS wider, max(parts) FILTER (total = goal) AS parts, max(total) FILTER (total <= goal) AS best
   FROM {0}_sub JOIN (SELECT {1}, any_value({4}) AS goal FROM {0}_pairs GROUP BY 1) USING ({1}) GROUP BY 1),
{0}_best AS (SELECT a.{1}, count(*) AS ways, count(*) FILTER (n > 1) AS wide, max(s.parts) AS parts FROM {0}_sums a JOIN {0}_sub s ON s.{1} = a.{1} AND s.total = a.best WHERE exact = 0 AND best > 0 GROUP BY 1),
{0}_found AS (SELECT a.{1}, goal, CASE WHEN exact > 0 AND NOT (exact > 1 AND wider > 0) AND exact = 1 THEN 'settled' WHEN exact > 1 AND wider = 0 THEN 'singles' WHEN exact > 1 THEN 'contested_settlement' WHEN wide > 0 THEN 'partial_settlement' ELSE 'none' END AS finding,
   CASE WHEN exact = 1 THEN a.parts WHEN exact = 0 AND wide > 0 AND ways = 1 THEN b.parts ELSE '' END AS payment_ids, CASE WHEN exact = 1 THEN goal WHEN exact = 0 AND wide > 0 AND ways = 1 THEN best ELSE 0 END AS settled_paise,
   CASE WHEN exact = 1 THEN 0 WHEN exact = 0 AND wide > 0 THEN goal - best ELSE goal END AS residual_paise, exact > 1 AND wider > 0 OR exact = 0 AND coalesce(wide > 0 AND ways > 1, FALSE) AS contested FROM {0}_sums a LEFT JOIN {0}_best b USING ({1}))"""
_FINDINGS = f"""own_pairs AS (SELECT id, payment_id, gross_paise, amount_paise FROM met WHERE NOT is_credit_note AND gross_paise > 0 AND abs({_GAP}) <= 45),
bulk_pairs AS (SELECT * FROM own_pairs WHERE payment_id IN (SELECT payment_id FROM own_pairs GROUP BY 1 HAVING count(*) > 1)),
{_SUBSETS.format('own', 'id', 'payment_id', 'amount_paise', 'gross_paise')}, {_SUBSETS.format('bulk', 'payment_id', 'id', 'gross_paise', 'amount_paise')},
told AS (SELECT id, bool_or(b.finding = 'settled' AND list_contains(string_split(b.payment_ids, '+'), id)) AS settles, arg_min(CASE WHEN b.finding IN ('none', 'partial_settlement') THEN 'bulk_partial' ELSE b.finding END, payment_id) FILTER (b.finding IN ('none', 'partial_settlement', 'contested_settlement')) AS cause
   FROM bulk_pairs JOIN bulk_found b USING (payment_id) WHERE id IN (SELECT id FROM own_found WHERE finding = 'none') GROUP BY 1),
found AS (SELECT id AS invoice_id, CASE WHEN settles THEN 'settled_in_bulk' ELSE coalesce(cause, finding) END AS finding, payment_ids, CAST(settled_paise AS BIGINT) AS settled_paise, CAST(residual_paise AS BIGINT) AS residual_paise, contested OR coalesce(cause = 'contested_settlement' AND NOT settles, FALSE) AS contested, 0 AS days_outside FROM own_found LEFT JOIN told USING (id)
   UNION ALL SELECT id, 'advice_outside_window', '', 0, any_value(gross_paise), FALSE, CAST(min(abs({_GAP})) AS INTEGER) FROM met WHERE NOT is_credit_note AND gross_paise > 0 AND id NOT IN (SELECT id FROM own_pairs) GROUP BY id),
residual AS (SELECT f.invoice_id, 'cardinality_residual' AS hold_type, finding, concat_ws('+', 'residual_unsettled:material', CASE WHEN contested THEN 'multiple_candidates_tied:blocking' END, CASE WHEN finding = 'advice_outside_window' THEN 'date_outside_window:material' END,
   CASE WHEN gross_paise > {AMOUNT_CAP} THEN 'amount_over_cap:blocking' END) AS conflicts, CASE WHEN contested OR gross_paise > {AMOUNT_CAP} THEN 'blocking' ELSE 'material' END AS severity FROM found f JOIN inv ON id = f.invoice_id WHERE finding NOT IN ('settled', 'singles', 'settled_in_bulk', 'none'))"""


def _recursive(body: str, *more: str) -> str:
    return _with(body, *more).replace("WITH", "WITH RECURSIVE", 1)


@query("cardinality_findings", _recursive(" SELECT * FROM found", _PAIRS, _FINDINGS))
def cardinality_findings(spark, sf_dir):
    return cardinality.findings(ledger.invoices(spark, sf_dir), ledger.payments(spark, sf_dir))


@query("cardinality_residuals", _recursive(" SELECT * FROM residual", _PAIRS, _FINDINGS))
def cardinality_residuals(spark, sf_dir):
    return cardinality.residual_holds(cardinality_findings(spark, sf_dir), ledger.invoices(spark, sf_dir))


@query("unmatched_documents")
def unmatched_documents(spark, sf_dir):
    inv, ranked = ledger.invoices(spark, sf_dir), _candidates(spark, sf_dir)
    return conflicts.unmatched(inv, ranked, _spoken(spark, sf_dir, inv, ranked))


_HOLDS = f"""{_ESTABLISHED}, {_DELTAS}, {_TAXV}, {_SIGNALS}, {_SERIES}, {_DUPLICATES},
hold AS (SELECT DISTINCT invoice_id, 'duplicate_candidate' AS hold_type FROM dups UNION ALL SELECT invoice_id, 'dist_variance' FROM ({_DIST}) UNION ALL SELECT invoice_id, 'tax_variance' FROM taxv WHERE reasons <> ''
  UNION ALL SELECT invoice_id, 'tax_amount_range' FROM ({_RANGE}) UNION ALL SELECT invoice_id, 'period_deferral' FROM ({_PERIOD}) UNION ALL SELECT invoice_id, 'credit_note_crossing' FROM ({_CROSSING})),
policy AS {_values([(*p, {'advisory': 0, 'material': 1, 'blocking': 2}[p[3]]) for p in HOLD_POLICIES], 'hold_type, auto_releasable, blocks_accounting, default_severity, severity_rank')}"""


def _holds(spark, sf_dir) -> DataFrame:
    """The holds of documents alone; written once a session."""
    return ledger.kept(spark, sf_dir, "document_holds", lambda: holds.document_holds(ledger.invoices(spark, sf_dir)))


@query("document_holds", _with(" SELECT invoice_id, hold_type FROM hold", _HOLDS))
def document_holds(spark, sf_dir):
    return _holds(spark, sf_dir)


@query(
    "principal_hold",
    _with(""" SELECT invoice_id, hold_type, default_severity AS severity, blocks_accounting FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id
      ORDER BY severity_rank DESC, blocks_accounting DESC, auto_releasable, hold_type) AS n FROM hold JOIN policy USING (hold_type)) WHERE n = 1""", _HOLDS),
)
def principal_hold(spark, sf_dir):
    return holds.principal_holds(_holds(spark, sf_dir))


_DECIDED = f"""held AS (SELECT invoice_id, bool_or(NOT auto_releasable) AS person, string_agg(DISTINCT hold_type, '+' ORDER BY hold_type) AS hold_types FROM hold JOIN policy USING (hold_type) GROUP BY 1),
decided AS (SELECT i.id AS invoice_id, CASE WHEN hold_types IS NOT NULL THEN 'hold' WHEN c.composite >= 0.75 THEN 'auto_clear' ELSE 'unmatched' END AS action,
  CASE WHEN hold_types IS NULL AND c.composite >= 0.75 THEN c.payment_id END AS payment_id, hold_types, CASE WHEN hold_types IS NOT NULL THEN person ELSE coalesce(c.composite < 0.75, TRUE) END AS requires_human
  FROM inv i LEFT JOIN held h ON h.invoice_id = i.id LEFT JOIN cand c ON c.id = i.id AND c.rank = 1)"""


def _decided_by_digits(spark, sf_dir) -> DataFrame:
    inv = ledger.invoices(spark, sf_dir)
    return holds.decisions(inv, _digit_ranked(spark, sf_dir), _holds(spark, sf_dir))


@query("decisions_by_digits", _with(" SELECT * FROM decided", _PAIRS, _AGREE, _RANKED, _HOLDS, _DECIDED))
def decisions_by_digits(spark, sf_dir):
    return _decided_by_digits(spark, sf_dir)


def _proposals(spark, sf_dir, inv, ranked) -> DataFrame:
    """invoice_id, hold_type, conflicts of all families but the last, which only speaks of documents that no other does."""
    priced = holds.price_variance(ranked).select("invoice_id", F.lit("price_variance").alias("hold_type"))
    own = conflicts.with_family_conflicts(_holds(spark, sf_dir).unionByName(priced))
    parts = cardinality_residuals(spark, sf_dir).select("invoice_id", "hold_type", conflicts.parsed(F.col("conflicts")).alias("conflicts"))
    return own.unionByName(parts)


def _spoken(spark, sf_dir, inv, ranked) -> DataFrame:
    return _proposals(spark, sf_dir, inv, ranked).select("invoice_id", "hold_type").distinct()


def _run(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Invoices, their ranked candidates and the proposals of all families, with conflicts; written once a session."""
    inv, ranked = ledger.invoices(spark, sf_dir), _candidates(spark, sf_dir)
    spoken = ledger.kept(spark, sf_dir, "proposals", lambda: _proposals(spark, sf_dir, inv, ranked))
    rest = ledger.kept(spark, sf_dir, "unmatched", lambda: conflicts.unmatched(inv, ranked, spoken).select("invoice_id", "hold_type", "conflicts"))
    return inv, ranked, spoken.unionByName(rest)


@query("decisions")
def decisions(spark, sf_dir):
    """What the run decides of each document, with the conflicts that it rests on and the worst severity of a hold."""
    inv, ranked, proposals = _run(spark, sf_dir)
    return conflicts.decided_with_conflicts(holds.decisions(inv, ranked, proposals.select("invoice_id", "hold_type").distinct()), ranked, proposals)


@query("case_conflicts")
def case_conflicts(spark, sf_dir):
    """One row per conflict of a held document, in order."""
    cases = conflicts.case_conflicts(_run(spark, sf_dir)[2])
    return cases.select("invoice_id", "severity", F.posexplode("conflicts").alias("turn", "conflict")).select("invoice_id", F.col("severity").alias("case_severity"), "turn", "conflict.*")


# --- evaluation ------------------------------------------------------------------------------

_TRUTH = """truth AS (SELECT i.id AS invoice_id, min(p.payment_id) AS first, string_agg(p.payment_id, '+' ORDER BY p.payment_id) AS true_payment_ids,
   CASE WHEN max(i.copy) IN (1, 2) THEN 'duplicate_candidate' WHEN max(i.j) % 29 = 6 THEN 'dist_variance' WHEN max(i.j) % 13 = 4 THEN 'period_deferral' END AS expected_hold,
   CASE WHEN max(i.copy) IN (1, 2) THEN 'duplicate' WHEN max(i.j) % 10 IN (4, 5) THEN 'cardinality' WHEN max(i.j) % 10 IN (1, 2, 3) THEN 'tolerance' WHEN max(i.j) % 13 = 4 THEN 'period' WHEN max(i.j) % 5 = 4 THEN 'reference' ELSE 'clean' END AS stratum
   FROM inv i LEFT JOIN pay p ON p.settles = i.id GROUP BY i.id),
judged AS (SELECT d.invoice_id, i.gross_paise, stratum, expected_hold, action, coalesce(hold_types, '') AS hold_types, NOT requires_human AS decided, action = 'auto_clear' AS cleared,
   action = 'auto_clear' AND coalesce(d.payment_id = true_payment_ids, FALSE) AS "right" FROM decided d JOIN inv i ON i.id = d.invoice_id LEFT JOIN truth t ON t.invoice_id = d.invoice_id)"""
_JUDGED = (_PAIRS, _AGREE, _RANKED, _HOLDS, _DECIDED, _TRUTH)
_TOTALS = """totals AS (SELECT count(*) AS total, count(*) FILTER (decided) AS decided, count(*) FILTER (cleared) AS auto_cleared, count(*) FILTER (action = 'hold') AS held, count(*) FILTER ("right") AS correct_clears,
   count(*) FILTER (cleared AND NOT "right") AS false_clears, CAST(coalesce(sum(abs(gross_paise)) FILTER (cleared AND NOT "right"), 0) AS BIGINT) AS at_risk_paise,
   round(count(*) FILTER (decided) / CAST(count(*) AS DOUBLE), 9) AS coverage_eval, round(count(*) FILTER (cleared) / CAST(count(*) AS DOUBLE), 9) AS coverage_strict,
   round(coalesce(count(*) FILTER ("right") / CAST(nullif(count(*) FILTER (cleared), 0) AS DOUBLE), 0), 9) AS match_precision FROM judged)"""


def _truth(spark, sf_dir) -> DataFrame:
    inv, pay = ledger.invoices(spark, sf_dir), ledger.payments(spark, sf_dir)
    paid = pay.groupBy(F.col("settles").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("payment_id")), "+").alias("true_payment_ids"))
    j, copy = F.col("j"), F.col("copy").isin(1, 2)
    hold = F.when(copy, "duplicate_candidate").when(j % 29 == 6, "dist_variance").when(j % 13 == 4, "period_deferral")
    stratum = F.when(copy, "duplicate").when((j % 10).isin(4, 5), "cardinality").when((j % 10).isin(1, 2, 3), "tolerance").when(j % 13 == 4, "period").when(j % 5 == 4, "reference").otherwise("clean")
    return inv.join(ledger.shuffled(paid), "id", "left").select(F.col("id").alias("invoice_id"), "true_payment_ids", hold.alias("expected_hold"), stratum.alias("stratum"))


def _judged(spark, sf_dir, decided=decisions) -> DataFrame:
    return review.scored_outcomes(ledger.invoices(spark, sf_dir), _truth(spark, sf_dir), decided(spark, sf_dir))


def _evaluation(name: str, sql: str):
    """Registers a query over the judged run: of the decisions, and by digits alone, which SQL can express."""

    def add(f: Callable[[DataFrame], DataFrame]):
        query(name)(lambda spark, sf_dir: f(_judged(spark, sf_dir)))
        query(f"{name}_by_digits", sql)(lambda spark, sf_dir: f(_judged(spark, sf_dir, _decided_by_digits)))
        return f

    return add


@_evaluation("eval_totals", _with(" SELECT * FROM totals", *_JUDGED, _TOTALS))
def eval_totals(judged):
    return review.eval_totals(judged)


@_evaluation("eval_strata", _with(""" SELECT stratum, count(*) AS total, count(*) FILTER (decided) AS decided, count(*) FILTER (cleared AND NOT "right") AS false_clears,
  CAST(coalesce(sum(abs(gross_paise)) FILTER (cleared AND NOT "right"), 0) AS BIGINT) AS at_risk_paise, round(count(*) FILTER (decided) / CAST(count(*) AS DOUBLE), 9) AS coverage FROM judged GROUP BY 1""", *_JUDGED))
def eval_strata(judged):
    return review.eval_strata(judged)


@_evaluation("eval_hold_types", _with(""" SELECT hold_type, coalesce(expected, 0) AS expected, coalesce(proposed, 0) AS proposed, coalesce(hit, 0) AS hit, round(coalesce(hit / CAST(nullif(expected, 0) AS DOUBLE), 0), 9) AS recall,
  round(coalesce(hit / CAST(nullif(proposed, 0) AS DOUBLE), 0), 9) AS precision FROM policy LEFT JOIN (SELECT expected_hold AS hold_type, count(*) AS expected, count(*) FILTER (list_contains(string_split(hold_types, '+'), expected_hold)) AS hit
  FROM judged WHERE expected_hold IS NOT NULL GROUP BY 1) e USING (hold_type) LEFT JOIN (SELECT hold_type, count(*) AS proposed FROM hold GROUP BY 1) h USING (hold_type)""", *_JUDGED))
def eval_hold_types(judged):
    return review.eval_hold_types(judged)


@_evaluation("floors", _with(" " + " UNION ALL ".join(f"SELECT '{k}' AS floor, CAST({v} AS DOUBLE) AS threshold, CAST({k} AS DOUBLE) AS observed, {k} {sign} {v} AS met FROM totals" for k, (sign, v) in review.FLOORS.items()), *_JUDGED, _TOTALS))
def floors(judged):
    return review.floors(review.eval_totals(judged))


def _run_rows(spark, sf_dir) -> DataFrame:
    """The judged run, with headlines and conflicts; written once a session."""
    inv, _, proposals = _run(spark, sf_dir)
    return ledger.kept(spark, sf_dir, "run_rows", lambda: evaluation.run_rows(inv, _truth(spark, sf_dir), decisions(spark, sf_dir), proposals))


@query("run_totals")
def run_totals(spark, sf_dir):
    return evaluation.run_totals(_run_rows(spark, sf_dir), ledger.payments(spark, sf_dir).count())


@query("run_hold_types")
def run_hold_types(spark, sf_dir):
    return evaluation.run_hold_types(_run_rows(spark, sf_dir))


@query("run_floors")
def run_floors(spark, sf_dir):
    return evaluation.run_floors(run_totals(spark, sf_dir), run_hold_types(spark, sf_dir))


@query("largest_remainder", _with(""", w AS (SELECT vendor_id AS key, count(*) AS weight FROM inv GROUP BY 1), s AS (SELECT key, weight * CAST(1000 AS DOUBLE) / sum(weight) OVER () AS share FROM w),
 r AS (SELECT key, floor(share) AS base, round(share - floor(share), 9) AS rest FROM s), n AS (SELECT *, row_number() OVER (ORDER BY rest DESC, key) AS turn, 1000 - sum(base) OVER () AS spare FROM r)
 SELECT key, CAST(base + CASE WHEN turn <= spare THEN 1 ELSE 0 END AS BIGINT) AS seats FROM n"""))
def largest_remainder(spark, sf_dir):
    weights = ledger.invoices(spark, sf_dir).groupBy(F.col("vendor_id").alias("key")).agg(F.count("*").alias("weight"))
    return review.largest_remainder(weights, 1000)


# --- queue -----------------------------------------------------------------------------------

_QUEUE = "queue AS (SELECT invoice_id, max(abs(gross_paise)) AS money_at_risk_paise, min(received_date) AS held_since, bool_or(blocks_accounting) AS blocks_accounting, count(*) AS holds FROM hold JOIN policy USING (hold_type) JOIN inv ON id = invoice_id GROUP BY 1)"


def _queue(spark, sf_dir) -> DataFrame:
    return review.exception_queue(_holds(spark, sf_dir), ledger.invoices(spark, sf_dir))


@query("exception_queue", _with(" SELECT * REPLACE (CAST(CAST(held_since AS DATE) AS VARCHAR) AS held_since) FROM queue", _HOLDS, _QUEUE))
def exception_queue(spark, sf_dir):
    return _queue(spark, sf_dir).withColumn("held_since", F.col("held_since").cast("string"))


@query("queue_totals", _with(" SELECT count(*) AS cases, CAST(coalesce(sum(money_at_risk_paise), 0) AS BIGINT) AS money_paise FROM queue", _HOLDS, _QUEUE))
def queue_totals(spark, sf_dir):
    return _queue(spark, sf_dir).agg(F.count("*").alias("cases"), F.coalesce(F.sum("money_at_risk_paise"), F.lit(0)).alias("money_paise"))


@query("queue_page", _with(" SELECT q.* REPLACE (CAST(CAST(held_since AS DATE) AS VARCHAR) AS held_since) FROM queue q WHERE blocks_accounting AND EXISTS (SELECT 1 FROM hold h WHERE h.invoice_id = q.invoice_id AND hold_type = 'duplicate_candidate') ORDER BY money_at_risk_paise DESC, invoice_id LIMIT 25 OFFSET 25", _HOLDS, _QUEUE))
def queue_page(spark, sf_dir):
    return review.queue_page(_queue(spark, sf_dir), _holds(spark, sf_dir), "duplicate_candidate", True, 25, 25).withColumn("held_since", F.col("held_since").cast("string"))




@query("hold_mix", _with(" SELECT hold_type, count(*) FILTER (j % 3 <> 0) AS open, count(*) FILTER (j % 3 = 0) AS released FROM hold JOIN inv ON id = invoice_id GROUP BY 1", _HOLDS))
def hold_mix(spark, sf_dir):
    rows = _holds(spark, sf_dir).join(ledger.invoices(spark, sf_dir).select(F.col("id").alias("invoice_id"), "j"), "invoice_id")
    return review.hold_mix(rows, F.col("j") % 3 == 0)


_ROUTES = f"route AS {_values([(i, *r) for i, r in enumerate(ROUTING)], 'precedence, hold_type, owner_role, resolution_path')}"


@query("routing", _with(" SELECT invoice_id, arg_min(hold_type, precedence) AS decided_by, arg_min(owner_role, precedence) AS owner_role, arg_min(resolution_path, precedence) AS resolution_path FROM hold JOIN route USING (hold_type) GROUP BY 1", _HOLDS, _ROUTES))
def routing(spark, sf_dir):
    return review.suggested_routing(_holds(spark, sf_dir))


@query("age_buckets", _with(f""" SELECT age, coalesce(cases, 0) AS cases, coalesce(money_paise, 0) AS money_paise FROM {_values([(a,) for a, _ in review.AGES], 'age')} LEFT JOIN (SELECT CASE WHEN d >= 61 THEN '61+' WHEN d >= 31 THEN '31-60'
  WHEN d >= 8 THEN '8-30' ELSE '0-7' END AS age, count(*) AS cases, CAST(sum(money_at_risk_paise) AS BIGINT) AS money_paise FROM (SELECT *, date_diff('day', held_since, DATE '1998-08-10') AS d FROM queue) GROUP BY 1) USING (age)""", _HOLDS, _QUEUE))
def age_buckets(spark, sf_dir):
    return review.age_buckets(_queue(spark, sf_dir), "1998-08-10")


@query("run_diff_by_digits", _with(" SELECT d.invoice_id, n.action AS before, d.action AS after FROM decided d JOIN naive n ON n.invoice_id = d.invoice_id WHERE d.action <> n.action", _PAIRS, _AGREE, _RANKED, _HOLDS, _DECIDED, _NAIVE))
def run_diff_by_digits(spark, sf_dir):
    return review.run_diff(naive_exact(spark, sf_dir), _decided_by_digits(spark, sf_dir))


@query("run_diff")
def run_diff(spark, sf_dir):
    return review.run_diff(naive_exact(spark, sf_dir), decisions(spark, sf_dir))


@query("vendor_exposure", _with(" SELECT vendor_id, count(*) AS documents, CAST(sum(gross_paise) AS BIGINT) AS gross_paise, CAST(coalesce(sum(abs(gross_paise)) FILTER (id IN (SELECT invoice_id FROM hold)), 0) AS BIGINT) AS held_paise FROM inv GROUP BY 1", _HOLDS))
def vendor_exposure(spark, sf_dir):
    return review.vendor_exposure(ledger.invoices(spark, sf_dir), _holds(spark, sf_dir))


# --- governance ------------------------------------------------------------------------------


_CHANGE = "CASE {0} % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'absolute_paise' WHEN 2 THEN 'percentage' WHEN 3 THEN 'days' ELSE 'similarity' END"


@query("tolerance_direction", f"SELECT event_id, CASE WHEN a <> b THEN 'retyped' WHEN x = y THEN 'unchanged' WHEN (a = 'similarity') <> (y > x) THEN 'widened' ELSE 'narrowed' END AS direction FROM (SELECT event_id, {_CHANGE.format('event_id')} AS a, {_CHANGE.format('(event_id - event_id % 7 % 2)')} AS b, event_id % 3 AS x, user_id % 3 AS y FROM events)")
def tolerance_direction(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("event_id", F.expr(_CHANGE.format("event_id")).alias("a"), F.expr(_CHANGE.format("(event_id - event_id % 7 % 2)")).alias("b"), F.expr("event_id % 3").alias("x"), F.expr("user_id % 3").alias("y"))
    return rows.select("event_id", review.tolerance_direction(F.col("a"), F.col("x"), F.col("b"), F.col("y")).alias("direction"))


_CHANGES = [("C1", "percentage", "widened", None), ("C2", "absolute_paise", "widened", None), ("C3", "percentage", "narrowed", None), ("C4", "similarity", "widened", None)]
_ASSESSED = f"""change AS {_values([c[:3] for c in _CHANGES], 'change_id, kind, direction')}, reach AS {_values(REACH, 'kind, hold_type, basis')},
assessed AS (SELECT change_id, invoice_id, h.hold_type, CASE WHEN i.j % 3 = 0 THEN 'already_released' WHEN r.basis IS NULL THEN 'not_reached' WHEN r.basis <> 'declared' THEN 'withheld' WHEN direction <> 'widened' THEN 'withheld'
   WHEN p.auto_releasable THEN 'released' ELSE 'requires_named_release' END AS outcome FROM hold h JOIN inv i ON i.id = h.invoice_id CROSS JOIN change c JOIN policy p ON p.hold_type = h.hold_type LEFT JOIN reach r ON r.kind = c.kind AND r.hold_type = h.hold_type)"""


def _assessed(spark, sf_dir) -> DataFrame:
    inv = ledger.invoices(spark, sf_dir).select(F.col("id").alias("invoice_id"), "vendor_id", "j")
    changes = spark.createDataFrame(_CHANGES, "change_id string, kind string, direction string, vendor_id string")
    return review.assess_changes(changes, _holds(spark, sf_dir).join(inv, "invoice_id"), F.col("j") % 3 == 0)


@query("tolerance_assess", _with(" SELECT * FROM assessed", _HOLDS, _ASSESSED))
def tolerance_assess(spark, sf_dir):
    return _assessed(spark, sf_dir)


@query("release_reconcile", _with(""" SELECT change_id, invoice_id, hold_type, CASE WHEN outcome = 'requires_named_release' THEN 'named_release' ELSE 'unfounded' END AS verdict FROM assessed
  WHERE substr(invoice_id, 12, 1) = '7'""", _HOLDS, _ASSESSED))
def release_reconcile(spark, sf_dir):
    assessed = _assessed(spark, sf_dir)
    return review.reconcile_releases(assessed, assessed.where("substr(invoice_id, 12, 1) = '7'"))


# --- journal ---------------------------------------------------------------------------------

_JOURNAL = """journal AS (SELECT event_id + CAST(floor(event_id / 53.0) AS BIGINT) AS sequence, ts, user_id AS actor, event_type AS event, sha256(CAST(event_id AS VARCHAR) || '|' || event_type) AS payload_hash FROM events),
chained AS (SELECT *, CASE WHEN sequence % 97 = 0 THEN 'broken' ELSE lag(payload_hash) OVER (ORDER BY sequence) END AS prev_hash FROM journal)"""


def _journal(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select((F.col("event_id") + F.floor(F.col("event_id") / 53.0)).alias("sequence"), F.col("ts").alias("at"), F.col("user_id").alias("actor"), F.col("event_type").alias("event"), F.sha2(F.concat(F.col("event_id").cast("string"), F.lit("|"), F.col("event_type")).cast("binary"), 256).alias("payload_hash"), "event_id")
    before = rows.select((F.col("event_id") + 1).alias("event_id"), F.col("payload_hash").alias("before"))
    return rows.join(before, "event_id", "left").withColumn("prev_hash", F.when(F.col("sequence") % 97 == 0, "broken").otherwise(F.col("before"))).drop("before", "event_id")


@query("journal_gaps", f"WITH {_JOURNAL} SELECT sequence AS after_sequence, next_sequence, next_sequence - sequence - 1 AS missing FROM (SELECT sequence, lead(sequence) OVER (ORDER BY sequence) AS next_sequence FROM journal) WHERE next_sequence > sequence + 1")
def journal_gaps(spark, sf_dir):
    return review.journal_gaps(_journal(spark, sf_dir))


@query("chain_links", f"WITH {_JOURNAL} SELECT sequence FROM (SELECT sequence, prev_hash, lag(sequence) OVER (ORDER BY sequence) AS s, lag(payload_hash) OVER (ORDER BY sequence) AS h FROM chained) WHERE sequence = s + 1 AND prev_hash IS DISTINCT FROM h")
def chain_links(spark, sf_dir):
    return review.broken_links(_journal(spark, sf_dir))


@query("participants", f"WITH {_JOURNAL} SELECT actor, arg_min(sequence, (ts, sequence)) AS first_sequence, arg_max(sequence, (ts, sequence)) AS last_sequence, count(*) AS acts, count(*) FILTER (event = 'purchase') AS review_acts FROM journal GROUP BY 1")
def participants(spark, sf_dir):
    return review.participants(_journal(spark, sf_dir))


@query("audit_actors", f"WITH {_JOURNAL} SELECT event, count(*) AS entries, count(DISTINCT actor) AS actors FROM journal GROUP BY 1")
def audit_actors(spark, sf_dir):
    return review.actor_histogram(_journal(spark, sf_dir))


@query("audit_page", f"WITH {_JOURNAL} SELECT sequence, event, actor FROM journal WHERE sequence > 500 AND event = 'click' ORDER BY sequence LIMIT 100")
def audit_page(spark, sf_dir):
    return _journal(spark, sf_dir).where("sequence > 500 AND event = 'click'").orderBy("sequence").limit(100).select("sequence", "event", "actor")


@query("canonical_hash", _with(""" SELECT id, sha256('{"gross_paise":' || gross_paise || ',"id":"' || id || '","recurrence":' || coalesce('"' || recurrence || '"', 'null') || ',"reference":"' || reference || '"}') AS row_hash FROM inv"""))
def canonical_hash(spark, sf_dir):
    rows = ledger.invoices(spark, sf_dir).select("id", "reference", "gross_paise", "recurrence")
    return rows.select("id", review.canonical_hash(rows).alias("row_hash"))


_VIOLATIONS = {
    "V1_tax_split": "inv WHERE igst + cgst + sgst + cess <> tax_total",
    "V2_period_format": "inv WHERE NOT regexp_full_match(period, '[0-9]{4}-(0[1-9]|1[0-2])')",
    "V4_bank_transaction_unique": "(SELECT bank_transaction_id FROM pay GROUP BY 1 HAVING count(*) > 1)",
    "invoice_id_unique": "(SELECT id FROM inv GROUP BY 1 HAVING count(*) > 1)",
    "V10_rank_unique": "(SELECT id, rank FROM cand GROUP BY 1, 2 HAVING count(*) > 1)",
    "V12_composite_range": "cand WHERE composite < 0 OR composite > 1",
    "V18_payment_exists": "cand WHERE payment_id NOT IN (SELECT payment_id FROM pay)",
}


@query("violations", _with(" " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS breaches FROM {v}" for k, v in _VIOLATIONS.items()), _PAIRS, _AGREE, _RANKED))
def violations(spark, sf_dir):
    return review.violations(ledger.invoices(spark, sf_dir), ledger.payments(spark, sf_dir), _digit_ranked(spark, sf_dir))

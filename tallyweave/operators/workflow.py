"""Nominations and their admission, releases, decisions, the journal's growth, and the evidence of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.reference_data import WINDOW_DAYS
from tallyweave.operators.ordinals import with_ordinals
from tallyweave.operators.review import canonical_hash
from tallyweave.operators.scoring import ACCEPT, amount_score, amount_within, composite, date_score, rounded
from tallyweave.sources.ledger import shuffled


def admitted(nominations: DataFrame, invoices: DataFrame, payments: DataFrame, reference: Column) -> DataFrame:
    """What becomes of nominations (nomination_id, invoice_id, payment_ids): admitted, or why not.

    One unknown id discards a nomination as a whole. A set is scored by its sum, the latest date and
    the best reference (a Column over invoice and payment columns); below the bar it is refused.
    """
    parts = nominations.select("nomination_id", "invoice_id", F.explode_outer("payment_ids").alias("payment_id")).join(payments, "payment_id", "left").join(invoices.withColumnRenamed("id", "invoice_id"), "invoice_id", "left")
    sets = parts.withColumn("reference_score", reference).groupBy("nomination_id", "invoice_id").agg(
        F.count("payment_id").alias("named"),
        F.count("amount_paise").alias("known"),
        F.max("gross_paise").alias("gross_paise"),
        F.max("invoice_date").alias("invoice_date"),
        F.sum("amount_paise").alias("settled"),
        F.max("value_date").alias("value_date"),
        F.max("reference_score").alias("reference_score"),
    )
    score = composite({"amount": amount_score(F.col("gross_paise"), F.col("settled")), "reference": F.col("reference_score"), "date": date_score(F.col("invoice_date"), F.col("value_date")), "vendor": F.lit(0.0)})
    scored = sets.withColumn("composite", F.round(score, 6))
    verdict = F.when(F.col("named") == 0, "empty_set").when(F.col("gross_paise").isNull() | (F.col("known") < F.col("named")), "unknown_record").when(F.col("composite").isNull(), "not_reverified").when(F.col("composite") < ACCEPT, "below_accept_min").otherwise("admitted")
    return scored.select("nomination_id", "invoice_id", verdict.alias("verdict"), "composite")


def reverified(nominations: DataFrame, pairs: DataFrame, places: int = 9) -> DataFrame:
    """rank, nomination_id, invoice_id, payment_ids, composite, residual_paise, proposed_by: a batch of nominated sets, scored anew and ranked among themselves.

    nominations have nomination_id, invoice_id, payment_ids and proposed_by; pairs are scored pairs
    (scoring.scored_pairs) of exactly the nominated documents and payments, and a set that names one
    without a pair is left out as a whole, as is an empty set. A set is scored by its sum, its best
    reference, its best vendor and its latest date. Ranks follow one total order over the batch: composite,
    reference, amount, vendor, nearness of date, then the sorted ids; a payment named twice counts once.
    """
    sets = nominations.select("nomination_id", "invoice_id", "proposed_by", F.array_sort(F.array_distinct("payment_ids")).alias("payment_ids")).where(F.size("payment_ids") > 0)
    parts = sets.select("*", F.explode("payment_ids").alias("payment_id")).join(pairs.withColumnRenamed("id", "invoice_id"), ["invoice_id", "payment_id"], "left")
    found = parts.groupBy("nomination_id", "invoice_id", "proposed_by", "payment_ids").agg(
        F.count("amount_paise").alias("known"),
        F.max("gross_paise").alias("gross_paise"),
        F.max("invoice_date").alias("invoice_date"),
        F.sum("amount_paise").alias("settled"),
        F.max("value_date").alias("value_date"),
        F.max("reference_score").alias("reference_score"),
        F.max("vendor_score").alias("vendor_score"),
    ).where(F.col("known") == F.size("payment_ids"))
    scored = found.withColumns({"amount_score": amount_score(F.col("gross_paise"), F.col("settled")), "date_score": date_score(F.col("invoice_date"), F.col("value_date"))})
    scored = scored.withColumns({k: rounded(F.col(k), 9) for k in ("amount_score", "date_score", "reference_score", "vendor_score")})
    scored = scored.withColumn("composite", rounded(composite({k: F.col(f"{k}_score") for k in ("amount", "reference", "date", "vendor")}), places))
    gap = F.coalesce(F.abs(F.datediff("value_date", "invoice_date")), F.lit(1 << 30))
    order = {"o1": -F.col("composite"), "o2": -F.col("reference_score"), "o3": -F.col("amount_score"), "o4": -F.col("vendor_score"), "o5": gap, "o6": F.array_join("payment_ids", "+")}
    ranked = with_ordinals(scored.withColumns(order), [*order, "invoice_id", "nomination_id"], "rank")
    return ranked.select("rank", "nomination_id", "invoice_id", "payment_ids", "composite", (F.col("settled") - F.col("gross_paise")).alias("residual_paise"), "proposed_by")


def released_holds(holds: DataFrame, releases: DataFrame) -> DataFrame:
    """The next snapshot of holds: those named in releases (invoice_id, hold_type, released_by) and still open are released."""
    new = releases.groupBy("invoice_id", "hold_type").agg(F.min("released_by").alias("now_by"))
    rows = holds.join(new, ["invoice_id", "hold_type"], "left")
    return rows.select("invoice_id", "hold_type", F.coalesce("released_by", "now_by").alias("released_by"))


def appended(journal_tail: tuple[int, str], drafts: DataFrame) -> DataFrame:
    """Drafts numbered after the journal's last entry, each hashed, and linked to the entry before.

    Appending is one writer's work; drafts are one batch of it.
    """
    last, hash_ = journal_tail
    order = Window.orderBy("draft")
    rows = drafts.withColumn("payload_hash", canonical_hash(drafts)).withColumn("sequence", F.row_number().over(order) + F.lit(last))
    return rows.withColumn("prev_hash", F.coalesce(F.lag("payload_hash").over(order), F.lit(hash_)))


def review_precision(cases: DataFrame, acts: DataFrame) -> DataFrame:
    """Of cases (case_id, money_paise) and acts (case_id, reviewer): share reviewed by count and value, largest unreviewed, seen by two."""
    seen = acts.groupBy("case_id").agg(F.countDistinct("reviewer").alias("reviewers"))
    rows = cases.join(seen, "case_id", "left").withColumn("reviewers", F.coalesce("reviewers", F.lit(0)))
    open_ = F.when(F.col("reviewers") == 0, F.struct("money_paise", "case_id"))
    return rows.agg(
        F.count("*").alias("cases"),
        F.count_if(F.col("reviewers") > 0).alias("reviewed"),
        F.round(F.count_if(F.col("reviewers") > 0) / F.count("*"), 9).alias("precision"),
        F.round(F.coalesce(F.sum(F.when(F.col("reviewers") > 0, F.col("money_paise"))), F.lit(0)) / F.sum("money_paise"), 9).alias("precision_by_value"),
        F.max(open_)["case_id"].alias("largest_unreviewed"),
        F.count_if(F.col("reviewers") > 1).alias("second_person"),
    )


def regression_gate(base: DataFrame, now: DataFrame, worst: float = 0.02) -> DataFrame:
    """Whether a run of totals may follow another: no more false clears without more coverage, and no rate worse by worst."""
    rate = lambda p: F.coalesce(F.try_divide(F.col(f"{p}_false_clears").cast("double"), F.col(f"{p}_auto_cleared")), F.lit(0.0))
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("false_clears", "auto_cleared", "coverage_strict")])
    rows = named(base, "base").join(named(now, "now"), F.lit(True))
    worse = (F.col("now_false_clears") > F.col("base_false_clears")) & (F.col("now_coverage_strict") <= F.col("base_coverage_strict"))
    drift = F.round(rate("now") - rate("base"), 9)
    return rows.select((~worse).alias("clears_ok"), drift.alias("rate_change"), (drift <= worst).alias("rate_ok"))


def quoted_numbers(texts: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """key, number: numbers in prose that the known table (number) doesn't have."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), F.lit(1)))).alias("number"))
    return found.join(known.distinct(), "number", "left_anti")


def forbidden_lines(texts: DataFrame, key: str, text: str, rules: dict[str, str]) -> DataFrame:
    """key, rule, lines: how many lines of each text break each rule (a regular expression)."""
    lines = texts.select(key, F.explode(F.split(F.col(text), "\n")).alias("line"))
    marks = F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in rules.items()]))
    return lines.select(key, F.explode(marks).alias("rule")).groupBy(key, "rule").agg(F.count("*").alias("lines"))


def dossiers(invoices: DataFrame, holds: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per held document: its holds, first candidate, vendor's exposure, and like documents of the vendor."""
    held = holds.groupBy("invoice_id").agg(F.array_join(F.array_sort(F.collect_set("hold_type")), "+").alias("hold_types"))
    first = candidates.where("rank = 1").select(F.col("id").alias("invoice_id"), "payment_id", "composite")
    exposure = invoices.groupBy("vendor_id").agg(F.sum("gross_paise").alias("vendor_gross_paise"))
    alike = invoices.groupBy("vendor_id", "gross_paise").agg((F.count("*") - 1).alias("alike"))
    rows = invoices.withColumnRenamed("id", "invoice_id").join(shuffled(held), "invoice_id").join(shuffled(first), "invoice_id", "left").join(shuffled(exposure), "vendor_id").join(shuffled(alike), ["vendor_id", "gross_paise"])
    return rows.select("invoice_id", "vendor_id", "hold_types", "payment_id", "composite", "vendor_gross_paise", "alike")


def bulk_lines(invoices: DataFrame, payments: DataFrame, keys: DataFrame, quoted: DataFrame) -> DataFrame:
    """Lines that quote two documents or more in the window: how many, and whether their grosses sum to the line."""
    rows = keys.join(quoted, "number").select("id", "payment_id").distinct().join(invoices.select("id", "gross_paise", "invoice_date"), "id").join(payments.select("payment_id", "amount_paise", "value_date"), "payment_id")
    near = rows.where(F.abs(F.datediff("value_date", "invoice_date")) <= WINDOW_DAYS)
    sums = near.groupBy("payment_id").agg(F.count("*").alias("documents"), F.max("amount_paise").alias("amount_paise"), F.sum("gross_paise").alias("gross_paise"))
    return sums.where("documents >= 2").select("payment_id", "documents", (F.col("gross_paise") - F.col("amount_paise")).alias("residual_paise"), amount_within(F.col("gross_paise"), F.col("amount_paise")).alias("within"))

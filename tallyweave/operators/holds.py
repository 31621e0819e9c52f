"""Holds: duplicates, variances, bulk and partial settlements, unmatched documents; and the decision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.reference_data import AMOUNT_CAP, HOLD_POLICIES, SEVERITY_RANK, WINDOW_DAYS
from tallyweave.operators.normalise import duplicate_key
from tallyweave.operators.scoring import ACCEPT, amount_within
from tallyweave.sources.ledger import shuffled


def _month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


# --- variances of one document ---------------------------------------------------------------


def dist_variance(invoices: DataFrame) -> DataFrame:
    """gross isn't net plus tax."""
    delta = F.col("gross_paise") - F.col("net_paise") - F.col("tax_total")
    return invoices.select(F.col("id").alias("invoice_id"), delta.alias("delta_paise")).where("delta_paise <> 0")


def tax_scheme() -> Column:
    intra, inter = (F.col("cgst") != 0) | (F.col("sgst") != 0), F.col("igst") != 0
    return F.when(intra & inter, "mixed").when(intra, "intra").when(inter, "inter").otherwise("exempt")


def _with_scheme(invoices: DataFrame) -> DataFrame:
    """invoices with their tax scheme and the one that all other documents of the vendor agree on, if they do."""
    rows = invoices.withColumn("scheme", tax_scheme())
    counts = rows.where("scheme IN ('intra', 'inter')").groupBy("vendor_id").agg(F.count_if(F.col("scheme") == "intra").alias("intra"), F.count_if(F.col("scheme") == "inter").alias("inter"))
    met = rows.join(counts, "vendor_id", "left").fillna(0, ["intra", "inter"])
    intra, inter = F.col("intra") - (F.col("scheme") == "intra").cast("int"), F.col("inter") - (F.col("scheme") == "inter").cast("int")
    return met.withColumn("established", F.when((intra > 0) & (inter == 0), "intra").when((inter > 0) & (intra == 0), "inter")).drop("intra", "inter")


def established_scheme(invoices: DataFrame) -> DataFrame:
    """Each invoice's scheme and the one that all other documents of its vendor agree on, if they do."""
    return _with_scheme(invoices).select(F.col("id").alias("invoice_id"), "scheme", "established")


def with_tax_deltas(invoices: DataFrame) -> DataFrame:
    """invoices with two tax deltas, parts to total and total to the nearest statutory rate of net, and what was due."""
    parts = F.col("igst") + F.col("cgst") + F.col("sgst") + F.col("cess") - F.col("tax_total")
    due = F.abs("tax_total") - F.abs("cess")
    rate = lambda r: F.floor(F.abs("net_paise") * r / 100 + 0.5)
    nearest = F.array_min(F.array(*[F.struct(F.abs(due - rate(r)).alias("gap"), F.lit(i).alias("turn"), rate(r).alias("due")) for i, r in enumerate((0, 5, 12, 18, 28))]))["due"]
    return invoices.select("*", parts.alias("parts_delta"), F.abs("tax_total").alias("parts_due"), nearest.alias("rate_due")).withColumn("rate_delta", F.when(F.col("net_paise") != 0, due - F.col("rate_due")).otherwise(0))


def _tax_reasons() -> Column:
    """What of a document's tax (with_tax_deltas, scheme, established) is off."""
    over = lambda d, due: F.abs(d) * 10_000 > due * 100
    marks = [
        F.when(F.col("scheme") == "mixed", "mixed_heads"),
        F.when((F.col("scheme") == "intra") & (F.abs(F.col("cgst") - F.col("sgst")) > 1), "uneven_halves"),
        F.when((F.col("scheme") == "inter") & (F.col("parts_delta") == 0) & (F.col("established") == "intra"), "vendor_is_intra"),
        F.when(over(F.col("parts_delta"), F.col("parts_due")), "parts_off_total"),
        F.when(over(F.col("rate_delta"), F.col("rate_due")), "total_off_rate"),
    ]
    return F.array_compact(F.array(*marks))


def tax_variance(invoices: DataFrame) -> DataFrame:
    """Percentage breaches: mixed heads, uneven halves, a lone inter-state document, or a delta over 1% of what was due."""
    rows = with_tax_deltas(_with_scheme(invoices))
    return rows.select(F.col("id").alias("invoice_id"), F.array_join(_tax_reasons(), "+").alias("reasons")).where("reasons <> ''")


def tax_amount_range(invoices: DataFrame) -> DataFrame:
    """A tax delta of more than 100 rupees."""
    most = F.greatest(F.abs("parts_delta"), F.abs("rate_delta"))
    return with_tax_deltas(invoices).select(F.col("id").alias("invoice_id"), most.alias("delta_paise")).where("delta_paise > 10000")


def period_deferral(invoices: DataFrame) -> DataFrame:
    rows = invoices.where(F.col("period") != _month(F.col("invoice_date")))
    return rows.select(F.col("id").alias("invoice_id"), "period", _month(F.col("invoice_date")).alias("invoice_month"), (_month(F.col("received_date")) != _month(F.col("invoice_date"))).alias("received_elsewhere"))


def credit_note_crossing(invoices: DataFrame) -> DataFrame:
    rows = invoices.where(F.col("is_credit_note") & (_month(F.col("received_date")) != _month(F.col("invoice_date"))))
    return rows.select(F.col("id").alias("invoice_id"), _month(F.col("invoice_date")).alias("invoice_month"), _month(F.col("received_date")).alias("received_month"))


def delta_cause(gross: Column, net: Column, due_date: Column, amount: Column, paid: Column) -> Column:
    """The exact cause of a settlement's difference: each inverts to the paisa, or it is unattributed."""
    delta, short = amount - gross, gross - amount
    d = F.abs(delta)
    fee = F.floor(d / 1.18 + 0.5)
    charge = (short > 0) & (d <= 100_000) & (F.pmod(fee, F.lit(100)) == 0) & (F.floor(fee * 1.18 + 0.5) == d)
    hits = lambda base, rates: sum(((short == F.floor(base * r / 10_000 + 0.5)).cast("int") for r in rates), F.lit(0)) > 0
    return (
        F.when(delta == 0, "none")
        .when(d < 100, "rounding")
        .when(charge, "bank_charge")
        .when((short > 0) & hits(net, (100, 200, 500, 1000)), "tds_withholding")
        .when((short > 0) & (paid < due_date) & hits(gross, (100, 150, 200, 250, 300)), "early_payment_discount")
        .otherwise("unattributed")
    )


def price_variance(candidates: DataFrame) -> DataFrame:
    """The first candidate settles within 15% of gross but not exactly."""
    best = candidates.where("rank = 1")
    delta = F.col("amount_paise") - F.col("gross_paise")
    cause = delta_cause(F.col("gross_paise"), F.col("net_paise"), F.col("due_date"), F.col("amount_paise"), F.col("value_date"))
    return best.where((delta != 0) & (F.abs(delta) * 10_000 <= F.abs("gross_paise") * 1500)).select(F.col("id").alias("invoice_id"), "payment_id", delta.alias("delta_paise"), cause.alias("cause"))


# --- duplicates ------------------------------------------------------------------------------


def duplicate_signals(invoices: DataFrame) -> DataFrame:
    """Later copies and the earlier documents they repeat, by signal: an equi self-join within vendors.

    reference_repeat needs the same canonical reference; the others the same gross and date, or a
    date no more than the window away. Arrival is by received date, then id.
    """
    rows = invoices.where(~F.col("is_credit_note")).select("id", "vendor_id", duplicate_key(F.col("reference")).alias("ref"), "gross_paise", "invoice_date", "received_date", "recurrence", "period")
    prior = rows.select(*[F.col(c).alias(f"prior_{c}") for c in rows.columns])
    later = F.struct("received_date", "id") > F.struct("prior_received_date", "prior_id")
    same_vendor = F.col("vendor_id") == F.col("prior_vendor_id")
    by_ref = rows.where("ref <> ''").join(shuffled(prior), same_vendor & (F.col("ref") == F.col("prior_ref")) & later).withColumn("signal", F.lit("reference_repeat"))
    same_day = (F.col("invoice_date") == F.col("prior_invoice_date")) | (F.col("received_date") == F.col("prior_received_date"))
    near = F.abs(F.datediff("invoice_date", "prior_invoice_date")) <= WINDOW_DAYS
    by_amount = rows.join(shuffled(prior), same_vendor & (F.col("gross_paise") == F.col("prior_gross_paise")) & later & (F.col("ref") != F.col("prior_ref")))
    by_amount = by_amount.withColumn("signal", F.when(same_day, "vendor_amount_date").when(near, "vendor_amount_near_date")).where("signal IS NOT NULL")
    return by_ref.unionByName(by_amount)


def recurring_series(invoices: DataFrame) -> DataFrame:
    """vendor_id, gross_paise, recurrence, members of the series with an exact cadence, three documents or more."""
    rows = invoices.where("recurrence IS NOT NULL")
    own = Window.partitionBy("vendor_id", "gross_paise", "recurrence").orderBy("invoice_date", "id")
    months = lambda d: F.year(d) * 12 + F.month(d)
    before = F.lag("invoice_date").over(own)
    step, drift = months(F.col("invoice_date")) - months(before), F.abs(F.day("invoice_date") - F.day(before))
    due = F.when(F.col("recurrence") == "monthly", (step == 1) & (drift <= 3)).when(F.col("recurrence") == "quarterly", (step == 3) & (drift <= 3)).otherwise(F.datediff("invoice_date", before) >= 20)
    stepped = rows.withColumn("ok", F.coalesce(due, F.lit(True)))
    groups = stepped.groupBy("vendor_id", "gross_paise", "recurrence").agg(F.count("*").alias("members"), F.bool_and("ok").alias("ok"), F.countDistinct("period").alias("periods"), F.countDistinct(duplicate_key(F.col("reference"))).alias("references"))
    return groups.where("members >= 3 AND ok AND periods = members AND references = members").select("vendor_id", "gross_paise", "recurrence", "members")


def duplicate_candidates(invoices: DataFrame, cap: int = AMOUNT_CAP) -> DataFrame:
    """Live signals: amount signals inside a corroborated series are suppressed, near dates count above the cap alone."""
    series = recurring_series(invoices).select("vendor_id", "gross_paise", "recurrence", F.lit(True).alias("in_series"))
    signals = duplicate_signals(invoices).join(shuffled(series), ["vendor_id", "gross_paise", "recurrence"], "left")
    suppressed = F.coalesce("in_series", F.lit(False)) & F.col("recurrence").eqNullSafe(F.col("prior_recurrence")) & (F.col("period") != F.col("prior_period")) & (F.col("signal") != "reference_repeat")
    live = signals.where(~suppressed & ((F.col("signal") != "vendor_amount_near_date") | (F.col("gross_paise") > cap)))
    severity = F.when((F.col("signal") == "reference_repeat") & (F.col("gross_paise") != F.col("prior_gross_paise")) & (F.col("gross_paise") <= cap), "material").otherwise("blocking")
    return live.select(F.col("id").alias("invoice_id"), "prior_id", "signal", severity.alias("severity"))


# --- settlements of many parts ---------------------------------------------------------------


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = np.zeros(1, np.int64)
    for v in values:
        sums = np.concatenate([sums, sums + v])
    by = np.argsort(sums, kind="stable")
    return sums[by], by


def subset_sum(values: list[int], target: int, limit: int = 2) -> tuple[list[int], int]:
    """Bit masks of up to limit non-empty subsets that sum to target, and the best sum not above it; meet in the middle."""
    half = len(values) // 2
    (left, left_at), (right, right_at) = _halves(np.array(values[:half], np.int64)), _halves(np.array(values[half:], np.int64))
    first, last = np.searchsorted(right, target - left, "left"), np.searchsorted(right, target - left, "right")
    masks = []
    for i in np.flatnonzero(last > first):
        for j in range(first[i], last[i]):
            if mask := int(left_at[i]) | int(right_at[j]) << half:
                masks.append(mask)
            if len(masks) == limit:
                return masks, target
    fits = last > 0
    return masks, int((left[fits] + right[last[fits] - 1]).max()) if fits.any() else 0


# --- the decision ----------------------------------------------------------------------------


def policies(spark) -> DataFrame:
    return spark.createDataFrame([(*p, SEVERITY_RANK[p[3]]) for p in HOLD_POLICIES], "hold_type string, auto_releasable boolean, blocks_accounting boolean, default_severity string, severity_rank int")


def document_holds(invoices: DataFrame) -> DataFrame:
    """invoice_id, hold_type of the families that look at documents alone; one row per document and type.

    What a row and its vendor's counts tell comes from one pass; only copies need the self-join.
    """
    month = _month(F.col("invoice_date"))
    marks = [
        F.when(F.col("gross_paise") - F.col("net_paise") - F.col("tax_total") != 0, "dist_variance"),
        F.when(F.size(_tax_reasons()) > 0, "tax_variance"),
        F.when(F.greatest(F.abs("parts_delta"), F.abs("rate_delta")) > 10_000, "tax_amount_range"),
        F.when(F.col("period") != month, "period_deferral"),
        F.when(F.col("is_credit_note") & (_month(F.col("received_date")) != month), "credit_note_crossing"),
    ]
    own = with_tax_deltas(_with_scheme(invoices)).select(F.col("id").alias("invoice_id"), F.explode(F.array_compact(F.array(*marks))).alias("hold_type"))
    return own.unionByName(duplicate_candidates(invoices).select("invoice_id", F.lit("duplicate_candidate").alias("hold_type"))).distinct()


def principal_holds(holds: DataFrame) -> DataFrame:
    """Each document's headline: severity, then what blocks accounting, what needs a person, then the name."""
    order = Window.partitionBy("invoice_id").orderBy(F.col("severity_rank").desc(), F.col("blocks_accounting").desc(), F.col("auto_releasable"), "hold_type")
    rows = holds.join(F.broadcast(policies(holds.sparkSession)), "hold_type").withColumn("turn", F.row_number().over(order))
    return rows.where("turn = 1").select("invoice_id", "hold_type", F.col("default_severity").alias("severity"), "blocks_accounting")


def decisions(invoices: DataFrame, candidates: DataFrame, holds: DataFrame) -> DataFrame:
    """A hold beats any score; without one the first candidate clears from the acceptance bar on; the rest is unmatched."""
    held = holds.join(F.broadcast(policies(holds.sparkSession)), "hold_type").groupBy("invoice_id").agg(F.bool_or(~F.col("auto_releasable")).alias("person"), F.array_join(F.array_sort(F.collect_set("hold_type")), "+").alias("hold_types"))
    first = candidates.where("rank = 1").select("id", "payment_id", "composite")
    rows = invoices.select("id").join(shuffled(held.withColumnRenamed("invoice_id", "id")), "id", "left").join(shuffled(first), "id", "left")
    clears = F.coalesce(F.col("composite") >= ACCEPT, F.lit(False))
    action = F.when(F.col("hold_types").isNotNull(), "hold").when(clears, "auto_clear").otherwise("unmatched")
    return rows.select(F.col("id").alias("invoice_id"), action.alias("action"), F.when(action == "auto_clear", F.col("payment_id")).alias("payment_id"), "hold_types", F.when(action == "hold", F.col("person")).otherwise(action == "unmatched").alias("requires_human"))

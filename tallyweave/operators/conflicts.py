"""Conflicts as records: what speaks against a pair, against a document, and how families' conflicts add up.

A conflict is a struct of code, field_path, clause and severity. Families' lists are joined in family
order; each conflict counts once, in the order first seen, and the worst severity stands for the case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.reference_data import AMOUNT_CAP, SEVERITY_RANK, WINDOW_DAYS
from tallyweave.operators.scoring import ACCEPT, amount_within
from tallyweave.sources.ledger import shuffled

KIND = "struct<code:string,field_path:string,clause:string,severity:string>"

#: Code, field, severity and clause.
CONFLICTS = {
    "reference_absent": ("invoice.reference", "material", "No usable reference on one side of the pairing."),
    "reference_mismatch": ("invoice.reference", "material", "References do not correspond."),
    "reference_displaced": ("invoice.vendor_name_raw", "advisory", "Reference token was recovered from another field."),
    "amount_over_cap": ("invoice.gross_paise", "blocking", "Invoice exceeds the amount cap; a named human reviews regardless of score."),
    "amount_over_tolerance": ("invoice.gross_paise", "material", "Settled amount differs from the invoice beyond tolerance."),
    "residual_unsettled": ("invoice.gross_paise", "material", "A residual remains after this settlement."),
    "date_outside_window": ("invoice.invoice_date", "material", "Payment date falls outside the settlement window."),
    "vendor_mismatch": ("invoice.vendor_name_raw", "material", "Vendor names do not correspond."),
    "vendor_below_similarity_floor": ("invoice.vendor_name_raw", "advisory", "Vendor similarity is below the declared floor."),
    "multiple_candidates_tied": ("invoice.gross_paise", "material", "Two or more candidates score within the tie window."),
    "no_candidate_found": ("invoice.reference", "material", "No payment scored above the retention floor."),
    "tax_split_mismatch": ("invoice.tax", "material", "Tax heads don't fit the vendor's scheme or each other."),
    "tax_total_mismatch": ("invoice.tax.total_paise", "material", "Tax doesn't fit the total, the heads or the rate."),
    "duplicate_reference": ("invoice.reference", "blocking", "An earlier document of the vendor has this reference."),
    "duplicate_vendor_amount_date": ("invoice.gross_paise", "blocking", "An earlier document of the vendor has this amount and date."),
    "period_mismatch": ("invoice.period", "advisory", "The period isn't the invoice date's month."),
    "credit_note_crosses_period": ("invoice.received_date", "material", "A credit note was received in another month."),
}

#: Hold families in order, and the conflict of a family that looks at documents alone.
FAMILIES = ["duplicate_candidate", "tax_variance", "tax_amount_range", "dist_variance", "price_variance", "period_deferral", "credit_note_crossing", "cardinality_residual", "no_reference", "matching"]
OF_FAMILY = {"duplicate_candidate": "duplicate_reference", "tax_variance": "tax_split_mismatch", "tax_amount_range": "tax_total_mismatch", "dist_variance": "tax_total_mismatch", "price_variance": "residual_unsettled", "period_deferral": "period_mismatch", "credit_note_crossing": "credit_note_crosses_period"}


def conflict(code: str, path: str | None = None, severity: str | None = None) -> Column:
    own, usual, clause = CONFLICTS[code]
    return F.struct(F.lit(code).alias("code"), F.lit(path or own).alias("field_path"), F.lit(clause).alias("clause"), F.lit(severity or usual).alias("severity"))


def listed(*marks: Column) -> Column:
    """The conflicts that are there, in order."""
    return F.array_compact(F.array(*marks)) if marks else F.array().cast(f"array<{KIND}>")


def distinct(conflicts: Column) -> Column:
    """Each conflict once, in the order first seen."""
    return F.array_distinct(conflicts)


def worst(conflicts: Column, least: str = "material") -> Column:
    """The highest severity of a list, never below least; null of null."""
    rank = F.create_map(*[x for name, n in SEVERITY_RANK.items() for x in (F.lit(name), F.lit(n))])
    top = F.aggregate(conflicts, F.lit(SEVERITY_RANK[least]), lambda acc, x: F.greatest(acc, F.coalesce(rank[x["severity"]], F.lit(0))))
    return F.when(conflicts.isNotNull(), F.element_at(F.array(*map(F.lit, SEVERITY_RANK)), top + 1))


def reference_within() -> Column:
    """A pair's references are equal, or alike from the floor on."""
    return F.col("reference_exact") | F.coalesce(F.col("reference_observed") >= 0.6, F.lit(False))


def pair_conflicts() -> Column:
    """What speaks against a scored pair, in a fixed order."""
    gap = F.datediff("value_date", "invoice_date")
    apart = F.coalesce(F.col("vendor_id") != F.col("payer_id"), F.lit(False))
    nameless = (F.coalesce("invoice_vendor", F.lit("")) == "") | (F.coalesce("payment_vendor", F.lit("")) == "")
    return listed(
        F.when(F.col("reference_absent"), conflict("reference_absent")).when(~reference_within() & ~F.col("reference_carried"), conflict("reference_mismatch")),
        F.when(F.col("displaced"), conflict("reference_displaced")),
        F.when(F.abs("gross_paise") > AMOUNT_CAP, conflict("amount_over_cap")),
        F.when(~amount_within(F.col("gross_paise"), F.col("amount_paise")), conflict("amount_over_tolerance")),
        F.when(F.col("amount_paise") != F.col("gross_paise"), conflict("residual_unsettled")),
        F.when(F.coalesce(F.abs(gap) > WINDOW_DAYS, F.lit(True)), conflict("date_outside_window")),
        F.when(apart, conflict("vendor_mismatch")).when(~nameless & (F.col("vendor_score") == 0), conflict("vendor_below_similarity_floor")),
    )


def unmatched(invoices: DataFrame, candidates: DataFrame, spoken: DataFrame) -> DataFrame:
    """invoice_id, hold_type, cause, payment_id, conflicts: documents that nothing clears and of which no other family speaks.

    The cited payment is the first that reconciles the money and names the document, else the first
    that reconciles, else the first of all. A line that reconciles but names nothing, or another
    document, makes a no_reference hold; the rest is matching.
    """
    within, names = amount_within(F.col("gross_paise"), F.col("amount_paise")), reference_within() & F.col("recovered")
    wanted = F.when(within & names, 0).when(within, 1).otherwise(2)
    cited = F.struct(wanted.alias("wanted"), "rank", "payment_id", "recovered", (~within).alias("over"), (~reference_within()).alias("unlike"), F.coalesce(F.abs(F.datediff("value_date", "invoice_date")) > WINDOW_DAYS, F.lit(True)).alias("late"), (F.col("vendor_score") == 0).alias("stranger"))
    best = candidates.groupBy("id").agg(F.max("composite").alias("best"), F.min(cited).alias("cited"))
    rows = invoices.select("id", "gross_paise").join(shuffled(best), "id", "left").where(F.coalesce(F.col("best") < ACCEPT, F.lit(True))).join(shuffled(spoken.select(F.col("invoice_id").alias("id"))), "id", "left_anti")
    of = lambda name: F.col(f"cited.{name}")
    cause = (
        F.when(F.col("best").isNull(), "no_candidate_retained")
        .when(of("wanted") == 2, "nothing_reconciles_the_money")
        .when(of("wanted") == 0, "nothing_reached_the_bar")
        .when(of("recovered"), "settling_line_names_another_document")
        .otherwise("settling_line_carries_no_reference")
    )
    narration = "payment.narration_raw"
    found = listed(
        F.when(F.col("cause") == "settling_line_names_another_document", conflict("reference_mismatch", narration)).when(F.col("cause") == "settling_line_carries_no_reference", conflict("reference_absent", narration)).otherwise(conflict("no_candidate_found")),
        F.when(of("over"), conflict("amount_over_tolerance")),
        F.when(~of("recovered"), conflict("reference_absent", narration)).when(of("unlike"), conflict("reference_mismatch")),
        F.when(of("late"), conflict("date_outside_window", "payment.value_date", "advisory")),
        F.when(of("stranger"), conflict("vendor_below_similarity_floor")),
        F.when(F.abs("gross_paise") > AMOUNT_CAP, conflict("amount_over_cap")),
    )
    type_ = F.when(F.col("cause").startswith("settling_line"), "no_reference").otherwise("matching")
    return rows.withColumn("cause", cause).select(F.col("id").alias("invoice_id"), type_.alias("hold_type"), "cause", of("payment_id").alias("payment_id"), distinct(found).alias("conflicts"))


def with_family_conflicts(holds: DataFrame) -> DataFrame:
    """invoice_id, hold_type of families that look at documents alone, with the family's conflict."""
    codes = F.lit(None).cast(KIND)
    for family, code in OF_FAMILY.items():
        codes = F.when(F.col("hold_type") == family, conflict(code)).otherwise(codes)
    return holds.select("invoice_id", "hold_type", listed(codes).alias("conflicts"))


def parsed(conflicts: Column) -> Column:
    """A list written as code:severity+code:severity, as records."""
    known = F.create_map(*[x for code in CONFLICTS for x in (F.lit(code), conflict(code))])

    def one(text: Column) -> Column:
        code, severity = F.split_part(text, F.lit(":"), F.lit(1)), F.split_part(text, F.lit(":"), F.lit(2))
        return F.struct(code.alias("code"), known[code]["field_path"].alias("field_path"), known[code]["clause"].alias("clause"), severity.alias("severity"))

    return F.transform(F.filter(F.split(conflicts, r"\+"), lambda t: t != ""), one)


def case_conflicts(proposals: DataFrame) -> DataFrame:
    """invoice_id, conflicts, severity of proposals (invoice_id, hold_type, conflicts): all families' conflicts in family order, each once."""
    order = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("hold_type"))
    lists = proposals.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("turn"), "hold_type", "conflicts"))).alias("families"))
    joined = lists.select("invoice_id", distinct(F.flatten(F.transform("families", lambda f: f["conflicts"]))).alias("conflicts"))
    return joined.select("invoice_id", "conflicts", worst(F.col("conflicts"), "advisory").alias("severity"))


def decided_with_conflicts(decisions: DataFrame, candidates: DataFrame, proposals: DataFrame) -> DataFrame:
    """decisions with conflicts: a hold's families', a clear's first candidate's, else that there is no candidate or a tie."""
    first = candidates.where("rank = 1").select(F.col("id").alias("invoice_id"), pair_conflicts().alias("own"), F.col("tied").alias("tie"))
    rows = decisions.join(shuffled(case_conflicts(proposals).withColumnRenamed("conflicts", "held")), "invoice_id", "left").join(shuffled(first), "invoice_id", "left")
    tie = F.when(F.col("tie"), conflict("multiple_candidates_tied"))
    left = listed(F.when(F.col("own").isNull(), conflict("no_candidate_found")), tie)
    found = F.when(F.col("action") == "hold", F.col("held")).when(F.col("action") == "auto_clear", F.concat(F.col("own"), listed(tie))).otherwise(left)
    return rows.withColumn("conflicts", found).drop("held", "own", "tie")

"""What reviewers and auditors read: evaluation, queue, routing, governance, journal, constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions.reference_data import HOLD_POLICIES, REACH, ROUTING, TOLERANCE_KINDS, UNREACHED
from tallyweave.sources.ledger import shuffled

# --- evaluation ------------------------------------------------------------------------------


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def scored_outcomes(invoices: DataFrame, truth: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Invoices with truth (payment_ids or null, expected_hold, stratum) and outcome; what has none was left to a person."""
    rows = invoices.select(F.col("id").alias("invoice_id"), "gross_paise").join(shuffled(truth), "invoice_id", "left").join(shuffled(outcomes), "invoice_id", "left")
    action, person = F.coalesce("action", F.lit("unmatched")), F.coalesce("requires_human", F.lit(True))
    cleared = action == "auto_clear"
    right = cleared & F.coalesce(F.col("payment_id") == F.col("true_payment_ids"), F.lit(False))
    return rows.select("invoice_id", "gross_paise", "stratum", "expected_hold", action.alias("action"), F.coalesce("hold_types", F.lit("")).alias("hold_types"), (~person).alias("decided"), cleared.alias("cleared"), right.alias("right"))


def eval_totals(scored: DataFrame) -> DataFrame:
    wrong = F.col("cleared") & ~F.col("right")
    return scored.agg(
        F.count("*").alias("total"),
        F.count_if("decided").alias("decided"),
        F.count_if("cleared").alias("auto_cleared"),
        F.count_if(F.col("action") == "hold").alias("held"),
        F.count_if("right").alias("correct_clears"),
        F.count_if(wrong).alias("false_clears"),
        F.coalesce(F.sum(F.when(wrong, F.abs("gross_paise"))), F.lit(0)).alias("at_risk_paise"),
        F.round(ratio(F.count_if("decided"), F.count("*")), 9).alias("coverage_eval"),
        F.round(ratio(F.count_if("cleared"), F.count("*")), 9).alias("coverage_strict"),
        F.round(ratio(F.count_if("right"), F.count_if("cleared")), 9).alias("match_precision"),
    )


def eval_strata(scored: DataFrame) -> DataFrame:
    wrong = F.col("cleared") & ~F.col("right")
    return scored.groupBy("stratum").agg(F.count("*").alias("total"), F.count_if("decided").alias("decided"), F.count_if(wrong).alias("false_clears"), F.coalesce(F.sum(F.when(wrong, F.abs("gross_paise"))), F.lit(0)).alias("at_risk_paise"), F.round(ratio(F.count_if("decided"), F.count("*")), 9).alias("coverage"))


def eval_hold_types(scored: DataFrame) -> DataFrame:
    """Expected, proposed and hit counts of all hold types, those that never occur included."""
    spark = scored.sparkSession
    types = spark.createDataFrame([(p[0],) for p in HOLD_POLICIES], "hold_type string")
    expected = scored.where("expected_hold IS NOT NULL").groupBy(F.col("expected_hold").alias("hold_type")).agg(F.count("*").alias("expected"), F.count_if(F.array_contains(F.split("hold_types", r"\+"), F.col("expected_hold"))).alias("hit"))
    proposed = scored.select(F.explode(F.split("hold_types", r"\+")).alias("hold_type")).where("hold_type <> ''").groupBy("hold_type").agg(F.count("*").alias("proposed"))
    rows = types.join(expected, "hold_type", "left").join(proposed, "hold_type", "left").fillna(0)
    return rows.select("hold_type", "expected", "proposed", "hit", F.round(ratio(F.col("hit"), F.col("expected")), 9).alias("recall"), F.round(ratio(F.col("hit"), F.col("proposed")), 9).alias("precision"))


#: The floors a run is held against.
FLOORS = {"coverage_eval": (">=", 0.70), "false_clears": ("<=", 3.0), "match_precision": (">=", 0.98), "at_risk_paise": ("<=", 150_000_000.0)}


def floors(totals: DataFrame) -> DataFrame:
    rows = totals.select(F.explode(F.array(*[F.struct(F.lit(k).alias("floor"), F.lit(limit).alias("threshold"), F.col(k).cast("double").alias("observed"), (F.col(k) >= limit if sign == ">=" else F.col(k) <= limit).alias("met")) for k, (sign, limit) in FLOORS.items()])).alias("x"))
    return rows.select("x.*")


def largest_remainder(weights: DataFrame, n: int) -> DataFrame:
    """key, seats: n shared out by weight; whole shares first, the rest to the largest remainders. Keys are distinct."""
    share = F.col("weight") * n / F.col("total")
    rows = weights.crossJoin(F.broadcast(weights.agg(F.sum("weight").alias("total"))))
    rows = rows.select("key", F.floor(share).alias("base"), F.round(share - F.floor(share), 9).alias("rest"))
    spare = max(n - (rows.agg(F.sum("base")).first()[0] or 0), 0)  # n at most
    more = rows.orderBy(F.col("rest").desc(), "key").limit(spare).select(F.col("key").alias("with_more"), F.lit(1).alias("more"))
    rows = rows.join(F.broadcast(more), F.col("key").eqNullSafe(F.col("with_more")), "left")
    return rows.select("key", (F.col("base") + F.coalesce("more", F.lit(0))).alias("seats"))


# --- queue -----------------------------------------------------------------------------------


def routing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROUTING)], "precedence int, hold_type string, owner_role string, resolution_path string")


def exception_queue(holds: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row per held document: money at risk, since when, what it blocks, how many holds."""
    from tallyweave.operators.holds import policies

    rows = holds.join(F.broadcast(policies(holds.sparkSession)), "hold_type").join(shuffled(invoices.select(F.col("id").alias("invoice_id"), "gross_paise", "received_date")), "invoice_id")
    return rows.groupBy("invoice_id").agg(F.max(F.abs("gross_paise")).alias("money_at_risk_paise"), F.min("received_date").alias("held_since"), F.bool_or("blocks_accounting").alias("blocks_accounting"), F.count("*").alias("holds"))


def queue_page(queue: DataFrame, holds: DataFrame, hold_type: str | None = None, blocks_accounting: bool | None = None, offset: int = 0, limit: int = 25) -> DataFrame:
    """A page of the queue by money at risk, then id."""
    rows = queue if blocks_accounting is None else queue.where(F.col("blocks_accounting") == blocks_accounting)
    if hold_type is not None:
        rows = rows.join(holds.where(F.col("hold_type") == hold_type), "invoice_id", "left_semi")
    return rows.orderBy(F.col("money_at_risk_paise").desc(), "invoice_id").offset(offset).limit(limit)


def suggested_routing(holds: DataFrame) -> DataFrame:
    """The owner and path of the most pressing of each document's holds."""
    rows = holds.join(F.broadcast(routing(holds.sparkSession)), "hold_type")
    return rows.groupBy("invoice_id").agg(F.min_by("hold_type", "precedence").alias("decided_by"), F.min_by("owner_role", "precedence").alias("owner_role"), F.min_by("resolution_path", "precedence").alias("resolution_path"))


def hold_mix(holds: DataFrame, released: Column) -> DataFrame:
    return holds.groupBy("hold_type").agg(F.count_if(~released).alias("open"), F.count_if(released).alias("released"))


#: Age classes of a hold, by the least number of days.
AGES = [("0-7", 0), ("8-30", 8), ("31-60", 31), ("61+", 61)]


def age_buckets(queue: DataFrame, today: str) -> DataFrame:
    """Documents and money by age class; classes without documents too."""
    days = F.datediff(F.lit(today).cast("date"), F.col("held_since"))
    bucket = reduce(lambda c, a: c.when(days >= a[1], a[0]), reversed(AGES[:-1]), F.when(days >= AGES[-1][1], AGES[-1][0])).otherwise(AGES[0][0])
    counts = queue.groupBy(bucket.alias("age")).agg(F.count("*").alias("cases"), F.sum("money_at_risk_paise").alias("money_paise"))
    return queue.sparkSession.createDataFrame([(a,) for a, _ in AGES], "age string").join(counts, "age", "left").fillna(0)


def run_diff(base: DataFrame, other: DataFrame) -> DataFrame:
    """Documents of both runs whose action changed, with both actions."""
    met = base.select("invoice_id", F.col("action").alias("before")).join(shuffled(other.select("invoice_id", F.col("action").alias("after"))), "invoice_id")
    return met.where("before <> after")


def vendor_exposure(invoices: DataFrame, holds: DataFrame) -> DataFrame:
    """Open documents and money of each vendor, and how much of it is held."""
    held = holds.select(F.col("invoice_id").alias("id")).distinct().withColumn("held", F.lit(True))
    rows = invoices.join(shuffled(held), "id", "left")
    return rows.groupBy("vendor_id").agg(F.count("*").alias("documents"), F.sum("gross_paise").alias("gross_paise"), F.coalesce(F.sum(F.when(F.col("held"), F.abs("gross_paise"))), F.lit(0)).alias("held_paise"))


# --- governance ------------------------------------------------------------------------------


def reach(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REACH, "kind string, hold_type string, basis string")


def reach_matrix(holds: DataFrame, changes: DataFrame) -> DataFrame:
    """Every tolerance kind and hold type: declared, admissible or none; with the holds of the type and the changes of the kind."""
    spark = holds.sparkSession
    kinds = spark.createDataFrame([(k,) for k in TOLERANCE_KINDS], "kind string")
    types = spark.createDataFrame([(p[0], p[0] in UNREACHED) for p in HOLD_POLICIES], "hold_type string, unreached boolean")
    counts = {name: rows.groupBy(name).agg(F.count("*").alias(f"n_{name}")) for name, rows in (("hold_type", holds), ("kind", changes))}
    rows = kinds.join(types, F.lit(True)).join(reach(spark), ["kind", "hold_type"], "left").join(counts["hold_type"], "hold_type", "left").join(counts["kind"], "kind", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("kind", "hold_type", F.coalesce("basis", F.lit("none")).alias("basis"), "unreached", number("n_hold_type").alias("holds"), number("n_kind").alias("changes"))


def tolerance_direction(from_kind: Column, from_value: Column, to_kind: Column, to_value: Column) -> Column:
    """A similarity is a floor: raising it narrows."""
    up = to_value > from_value
    return F.when(from_kind != to_kind, "retyped").when(from_value == to_value, "unchanged").when(F.when(from_kind == "similarity", ~up).otherwise(up), "widened").otherwise("narrowed")


def assess_changes(changes: DataFrame, holds: DataFrame, released: Column) -> DataFrame:
    """What a tolerance change may do to each open hold in scope: change_id, invoice_id, hold_type, outcome.

    changes has change_id, kind, direction, vendor_id (null: all). holds has invoice_id, vendor_id,
    hold_type. A change is listed with each hold type and meets its holds by type, and by vendor where it has one.
    """
    from tallyweave.operators.holds import policies

    spark = holds.sparkSession
    types = F.explode(F.array(*[F.lit(p[0]) for p in HOLD_POLICIES])).alias("hold_type")
    # two closed lists: five kinds by eleven types
    listed = changes.withColumnRenamed("vendor_id", "scope").select("*", types).join(F.broadcast(reach(spark)), ["kind", "hold_type"], "left").join(F.broadcast(policies(spark).select("hold_type", "auto_releasable")), "hold_type")
    open_ = holds.withColumn("released", released)
    own = listed.where("scope IS NOT NULL").withColumnRenamed("scope", "vendor_id")
    rows = open_.join(own, ["hold_type", "vendor_id"]).unionByName(open_.join(listed.where("scope IS NULL").drop("scope"), "hold_type"))
    outcome = (
        F.when(F.col("released"), "already_released")
        .when(F.col("basis").isNull(), "not_reached")
        .when(F.col("basis") != "declared", "withheld")
        .when(F.col("direction") != "widened", "withheld")
        .when(F.col("auto_releasable"), "released")
        .otherwise("requires_named_release")
    )
    return rows.select("change_id", "invoice_id", "hold_type", outcome.alias("outcome"))


def reconcile_releases(assessed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded releases (change_id, invoice_id, hold_type) against the rules: agreed, missing, named or unfounded."""
    keys = ["change_id", "invoice_id", "hold_type"]
    rows = assessed.join(recorded.select(*keys, F.lit(True).alias("recorded")), keys, "full").withColumn("recorded", F.coalesce("recorded", F.lit(False)))
    verdict = F.when(F.col("recorded") & (F.col("outcome") == "released"), "agreed").when(F.col("recorded") & (F.col("outcome") == "requires_named_release"), "named_release").when(F.col("recorded"), "unfounded").when(F.col("outcome") == "released", "missing")
    return rows.select(*keys, verdict.alias("verdict")).where("verdict IS NOT NULL")


# --- journal ---------------------------------------------------------------------------------

#: Sequence numbers of one stretch of the journal.
STRETCH = 1 << 16


def _next(journal: DataFrame, columns: list[str]) -> DataFrame:
    """The journal with next_<column> of the entry that follows by sequence: windows in stretches, then one row per stretch."""
    own = Window.partitionBy("stretch").orderBy("sequence")
    rows = journal.withColumn("stretch", F.floor(F.col("sequence") / STRETCH)).select("*", *[F.lead(c).over(own).alias(f"in_{c}") for c in columns])
    heads = rows.groupBy("stretch").agg(*[F.min_by(c, "sequence").alias(f"head_{c}") for c in columns])
    after = Window.orderBy("stretch")  # one row per STRETCH entries
    heads = heads.select("stretch", *[F.lead(f"head_{c}").over(after).alias(f"out_{c}") for c in columns])
    return rows.join(heads, "stretch").select(*journal.columns, *[F.coalesce(f"in_{c}", f"out_{c}").alias(f"next_{c}") for c in columns])


def journal_gaps(journal: DataFrame) -> DataFrame:
    """Runs of missing sequence numbers: after which entry, how many."""
    rows = _next(journal.select("sequence"), ["sequence"]).where(F.col("next_sequence") > F.col("sequence") + 1)
    return rows.select(F.col("sequence").alias("after_sequence"), "next_sequence", (F.col("next_sequence") - F.col("sequence") - 1).alias("missing"))


def broken_links(journal: DataFrame) -> DataFrame:
    """Entries whose prev_hash isn't the payload hash of the entry before, where numbers are contiguous."""
    rows = _next(journal.select("sequence", "payload_hash", "prev_hash"), ["sequence", "prev_hash"])
    return rows.where((F.col("next_sequence") == F.col("sequence") + 1) & ~F.col("next_prev_hash").eqNullSafe(F.col("payload_hash"))).select(F.col("next_sequence").alias("sequence"))


def participants(journal: DataFrame) -> DataFrame:
    """First and last act of each actor, and their number."""
    key = F.struct("at", "sequence")
    return journal.groupBy("actor").agg(F.min_by("sequence", key).alias("first_sequence"), F.max_by("sequence", key).alias("last_sequence"), F.count("*").alias("acts"), F.count_if(F.col("event") == "purchase").alias("review_acts"))


def actor_histogram(journal: DataFrame) -> DataFrame:
    return journal.groupBy("event").agg(F.count("*").alias("entries"), F.countDistinct("actor").alias("actors"))


def canonical_hash(df: DataFrame) -> Column:
    """SHA-256 of the row's JSON with its keys in order and nulls kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


# --- constraints -----------------------------------------------------------------------------


def violations(invoices: DataFrame, payments: DataFrame, candidates: DataFrame) -> DataFrame:
    """rule, breaches: how many rows break each integrity rule; rules without a breach too."""
    counts = [
        ("V1_tax_split", invoices.where("igst + cgst + sgst + cess <> tax_total")),
        ("V2_period_format", invoices.where(~F.col("period").rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"))),
        ("V4_bank_transaction_unique", payments.groupBy("bank_transaction_id").count().where("count > 1")),
        ("invoice_id_unique", invoices.groupBy("id").count().where("count > 1")),
        ("V10_rank_unique", candidates.groupBy("id", "rank").count().where("count > 1")),
        ("V12_composite_range", candidates.where("composite < 0 OR composite > 1")),
        ("V18_payment_exists", candidates.join(payments, "payment_id", "left_anti")),
    ]
    parts = [rows.agg(F.count("*").alias("breaches")).select(F.lit(rule).alias("rule"), "breaches") for rule, rows in counts]
    return reduce(DataFrame.unionByName, parts)

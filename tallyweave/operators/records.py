"""Records that reviewers leave: lists, latest rows, mutations as snapshots, evidence rows, wire forms, constraints.

Tables are never changed in place: a mutation gives the next snapshot or the rows to append.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions.reference_data import HOLD_POLICIES, REACH, STRATA
from tallyweave.operators.normalise import normalise
from tallyweave.sources.ledger import shuffled

# --- wire forms and clauses ------------------------------------------------------------------

#: The largest integer that a double holds exactly.
SAFE = 9_007_199_254_740_991


def exact_ratio(part: Column, whole: Column) -> Column:
    """part / whole cut to six digits in integer arithmetic; 0 of nothing."""
    scaled = (part.cast("decimal(38,0)") * 1_000_000).cast("decimal(38,0)")
    return F.when(whole == 0, 0.0).otherwise(F.call_function("div", scaled, F.when(whole == 0, 1).otherwise(whole).cast("decimal(38,0)")) / 1e6)


def money_field(name: str, amount: Column) -> Column:
    """One JSON field: a number as long as a double holds it, else digits under name_string."""
    return F.when(F.abs(amount) <= SAFE, F.concat(F.lit(f'"{name}":'), amount.cast("string"))).otherwise(F.concat(F.lit(f'"{name}_string":"'), amount.cast("string"), F.lit('"')))


#: Scope kind, breadth, and the clause it reads as (with the scope's value where there is one).
SCOPES = [("global", 3, "every invoice in the run"), ("vendor", 2, "vendor "), ("hold_type", 1, "hold type "), ("invoice", 0, "invoice ")]


def scope_clause(kind: Column, value: Column) -> Column:
    return reduce(lambda c, s: c.when(kind == s[0], F.concat(F.lit(s[2]), F.coalesce(value, F.lit("")))), SCOPES, F.when(F.lit(False), "")).otherwise("unrecognised scope")


def scope_breadth(kind: Column) -> Column:
    return reduce(lambda c, s: c.when(kind == s[0], s[1]), SCOPES, F.when(F.lit(False), 0)).otherwise(0)


def tolerance_clause(kind: Column, value: Column) -> Column:
    """How a tolerance reads."""
    v = value.cast("string")
    return F.when(kind == "exact", "exact (no band)").when(kind == "absolute_paise", F.concat(v, F.lit(" paise"))).when(kind == "percentage", F.concat(v, F.lit(" of the compared quantity"))).when(kind == "days", F.concat(v, F.lit(" day(s)"))).when(kind == "similarity", F.concat(F.lit("similarity floor "), v)).otherwise("unrecognised tolerance")


def page_of(offset: Column, limit: Column) -> Column:
    """The page, from 1, that an offset lies on."""
    return (F.floor(offset / F.greatest(limit, F.lit(1))) + 1).cast("long")


def offset_of(page: Column, limit: Column) -> Column:
    return (F.greatest(page, F.lit(1)) - 1) * F.greatest(limit, F.lit(1))


# --- lists and latest rows -------------------------------------------------------------------


def listed(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have the wanted values; None asks for nothing."""
    return reduce(lambda df, kv: df if kv[1] is None else df.where(F.col(kv[0]) == F.lit(kv[1])), wanted.items(), rows)


def first_rows(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The rows of one page with their turn, from offset + 1 on: a top-k, then numbers over that page alone."""
    page = rows.orderBy(*order).limit(offset + limit)
    return page.withColumn("turn", F.row_number().over(Window.orderBy(*order)).cast("long")).where(F.col("turn") > offset)


def evidence_order() -> list[Column]:
    """Widened changes first, the broadest scope before others, the newest first."""
    return [(F.col("direction") == "widened").desc(), scope_breadth(F.col("scope_kind")).desc(), F.col("made_at").desc(), F.col("change_id").asc()]


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each case by time, then id."""
    last = F.max_by(F.struct("decision_id", "action", "reviewer"), F.struct("decided_at", "decision_id")).alias("last")
    return decisions.groupBy("case_id").agg(last, F.count("*").alias("decisions")).select("case_id", "last.*", "decisions")


def undecided(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    return queue.join(decisions.select("case_id").distinct(), "case_id", "left_anti")


def hydrated(queue: DataFrame, holds: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queue rows (case_id, invoice_id) with the types of their holds, first candidate and last decision."""
    types = holds.groupBy("invoice_id").agg(F.array_join(F.array_sort(F.collect_set("hold_type")), "+").alias("hold_types"))
    first = candidates.where("rank = 1").select(F.col("id").alias("invoice_id"), "payment_id", "composite")
    return queue.join(shuffled(types), "invoice_id", "left").join(shuffled(first), "invoice_id", "left").join(latest_decisions(decisions), "case_id", "left")


def case_bundles(invoices: DataFrame, holds: DataFrame, candidates: DataFrame, decisions: DataFrame, changes: DataFrame) -> DataFrame:
    """All about each held document (case_id, id): counts of holds, candidates, decisions, changes that touch it, and like documents with the least day gap."""
    per = lambda df, key, name: df.groupBy(key).agg(F.count("*").alias(name))
    held = per(holds, "invoice_id", "holds").withColumnRenamed("invoice_id", "id")
    touched = per(changes.select(F.explode("affected_ids").alias("id")), "id", "changes")
    own = Window.partitionBy("vendor_id", "gross_paise").orderBy("invoice_date", "id")
    gap = F.least(F.datediff("invoice_date", F.lag("invoice_date").over(own)), F.datediff(F.lead("invoice_date").over(own), F.col("invoice_date")))
    rows = invoices.withColumn("alike", F.count("*").over(Window.partitionBy("vendor_id", "gross_paise")) - 1).withColumn("day_gap", gap)
    rows = rows.join(shuffled(held), "id").join(shuffled(per(candidates, "id", "candidates")), "id", "left").join(shuffled(touched), "id", "left").join(latest_decisions(decisions), "case_id", "left")
    return rows.select("case_id", F.col("id").alias("invoice_id"), "holds", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "decisions", "changes")], "action", "alike", F.coalesce("day_gap", F.lit(-1)).alias("day_gap"))


def touching(changes: DataFrame, ids: DataFrame) -> DataFrame:
    """Changes that affect one of the ids (column id): the arrays opened, a semi join."""
    met = changes.select("change_id", F.explode("affected_ids").alias("id")).join(ids, "id", "left_semi")
    return changes.join(met.select("change_id").distinct(), "change_id", "left_semi")


# --- mutations -------------------------------------------------------------------------------


def run_requests(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """request_id, verdict, run_id: a new key creates a run, a known one with equal arguments replays the first, with others it conflicts."""
    known = runs.groupBy("key").agg(F.min_by(F.struct("id", "argument"), "id").alias("known"))
    rows = requests.join(known, "key", "left")
    verdict = F.when(F.col("known").isNull(), "created").when(F.col("known.argument").eqNullSafe(F.col("argument")), "replayed").otherwise("conflict")
    return rows.select("request_id", verdict.alias("verdict"), F.when(verdict == "replayed", F.col("known.id")).alias("run_id"))


def decided_actions(decisions: DataFrame, approved: Column) -> DataFrame:
    """What becomes of recorded decisions: some go to other endpoints, the others need approval before they are written."""
    elsewhere = F.when(F.col("action") == "release_hold", "redirect_release").when(F.col("action") == "change_tolerance", "redirect_tolerance").when(F.col("action") == "add_rule", "redirect_rules")
    return decisions.select("decision_id", F.coalesce(elsewhere, F.when(approved, "recorded").otherwise("preview")).alias("result"))


def status_snapshot(current: DataFrame, changes: DataFrame) -> DataFrame:
    """payment_id, status after changes (payment_id, status, at): the last one wins."""
    last = changes.groupBy("payment_id").agg(F.max_by("status", F.struct("at", "status")).alias("now"))
    return current.join(last, "payment_id", "left").select("payment_id", F.coalesce("now", "status").alias("status"))


def deactivated(rules: DataFrame, orders: DataFrame) -> DataFrame:
    """Rules after deactivations (rule_id, reviewer): active ones named go inactive under the least reviewer; the rest stays."""
    named = orders.groupBy("rule_id").agg(F.min("reviewer").alias("by"))
    rows = rules.join(named, "rule_id", "left")
    return rows.select("rule_id", (F.col("active") & F.col("by").isNull()).alias("active"), F.when(F.col("active"), F.col("by")).otherwise(F.col("deactivated_by")).alias("deactivated_by"))


def aliases_of_rules(rules: DataFrame, base: DataFrame) -> DataFrame:
    """key, vendor_id: aliases of base, overruled by active vendor_alias rules, the last rule of a key first."""
    own = rules.where("active AND kind = 'vendor_alias'").groupBy(F.col("raw_value").alias("key")).agg(F.max_by("canonical_vendor_id", F.struct("created_at", "rule_id")).alias("ruled"))
    return base.join(own, "key", "full").select("key", F.coalesce("ruled", "vendor_id").alias("vendor_id"))


def canonical_forms(rules: DataFrame, vendors: DataFrame) -> DataFrame:
    """key, canonical, vendor_id, rule_id: what active rules make of a name or a reference, the last rule of a key winning.

    A vendor_alias rule pins its vendor, and the key reads as that vendor's name; one whose vendor isn't
    known (vendor_id, vendor_name) does nothing. A reference_pattern rule turns one reference into another
    (canonical_form). Keys are the canonical forms of raw values; blank ones do nothing.
    """
    own = rules.where("active AND kind IN ('vendor_alias', 'reference_pattern')").join(vendors.select(F.col("vendor_id").alias("canonical_vendor_id"), "vendor_name"), "canonical_vendor_id", "left")
    alias = F.col("kind") == "vendor_alias"
    key = F.when(alias, normalise(F.col("raw_value"), "vendor.v1")).otherwise(normalise(F.col("pattern"), "reference.v2"))
    form = F.when(alias, normalise(F.col("vendor_name"), "vendor.v1")).otherwise(normalise(F.col("canonical_form"), "reference.v2"))
    forms = own.select("kind", key.alias("key"), form.alias("canonical"), F.when(alias, F.col("canonical_vendor_id")).alias("vendor_id"), "rule_id", "created_at").where("key <> '' AND canonical IS NOT NULL")
    last = F.struct("created_at", "rule_id")
    return forms.groupBy("kind", "key").agg(*[F.max_by(c, last).alias(c) for c in ("canonical", "vendor_id", "rule_id")])


def ruled(rows: DataFrame, value: str, forms: DataFrame, kind: str) -> DataFrame:
    """rows with value replaced by what the rules of a kind make of it, and the rule's id; an equi join on distinct keys."""
    own = forms.where(F.col("kind") == kind).select(F.col("key").alias("of_key"), "canonical", F.col("rule_id").alias("by_rule"))
    met = rows.join(own, F.col(value) == F.col("of_key"), "left")
    return met.withColumn(value, F.coalesce("canonical", value)).drop("of_key", "canonical")


def change_effects(assessed: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per change: holds by outcome and the money they free or wait with, a document counted once per hold."""
    money = invoices.select(F.col("id").alias("invoice_id"), "gross_paise")
    of = lambda outcome: F.coalesce(F.sum(F.when(F.col("outcome") == outcome, F.col("gross_paise"))), F.lit(0))
    count = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return assessed.join(money, "invoice_id").groupBy("change_id").agg(count("released").alias("released"), count("requires_named_release").alias("named"), count("withheld").alias("withheld"), of("released").alias("released_paise"), of("requires_named_release").alias("awaiting_paise"))


def release_types(holds: DataFrame) -> DataFrame:
    """Per tolerance kind the hold types it governs, those it can lift by itself, and how many of the holds (invoice_id, hold_type) are of either."""
    spark = holds.sparkSession
    counts = holds.groupBy("hold_type").agg(F.count("*").alias("n"))
    rows = spark.createDataFrame(REACH, "kind string, hold_type string, basis string").join(spark.createDataFrame([p[:2] for p in HOLD_POLICIES], "hold_type string, auto_releasable boolean"), "hold_type").join(counts, "hold_type", "left")
    lifts = (F.col("basis") == "declared") & F.col("auto_releasable")
    names = lambda which: F.array_join(F.array_sort(F.collect_list(F.when(which, F.col("hold_type")))), "+")
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    return rows.groupBy("kind").agg(names(F.lit(True)).alias("governed"), names(lifts).alias("releasable"), total(F.lit(True)).alias("governed_holds"), total(lifts).alias("releasable_holds"))


def tolerance_preview(changes: DataFrame, holds: DataFrame, invoices: DataFrame) -> DataFrame:
    """Per change (change_id, kind, vendor_id or null): open holds it governs in its scope, and their documents' money.

    Holds are summed by kind and vendor before any change meets them; a document has one vendor, so
    sums of documents over vendors are exact.
    """
    spark = holds.sparkSession
    kinds = F.broadcast(spark.createDataFrame([r[:2] for r in REACH], "kind string, hold_type string"))  # a closed list
    rows = holds.join(invoices.select(F.col("id").alias("invoice_id"), "vendor_id", "gross_paise"), "invoice_id").join(kinds, "hold_type")
    by_vendor = rows.groupBy("kind", "vendor_id").agg(F.count("*").alias("holds"), F.countDistinct("invoice_id").alias("documents"), F.sum("gross_paise").alias("money_paise"))
    sums = ["holds", "documents", "money_paise"]
    by_kind = by_vendor.groupBy("kind").agg(*[F.sum(c).alias(c) for c in sums])
    own = changes.where("vendor_id IS NOT NULL").join(by_vendor, ["kind", "vendor_id"], "left").select("change_id", *sums)
    return own.unionByName(changes.where("vendor_id IS NULL").join(by_kind, "kind", "left").select("change_id", *sums)).fillna(0)


# --- pairs and their evidence ----------------------------------------------------------------


def nomination_keys(nominations: DataFrame, invoices: DataFrame, payments: DataFrame, run_id: str) -> DataFrame:
    """Per nominated set: its key, candidate id, cardinality and what it leaves of the gross."""
    parts = nominations.select("invoice_id", F.explode("payment_ids").alias("payment_id")).join(payments.select("payment_id", "amount_paise"), "payment_id")
    sets = parts.groupBy("invoice_id").agg(F.array_sort(F.collect_list("payment_id")).alias("ids"), F.sum("amount_paise").alias("settled")).join(invoices.select(F.col("id").alias("invoice_id"), "gross_paise"), "invoice_id")
    key = F.concat_ws("|", "invoice_id", F.array_join("ids", "+"))
    return sets.select("invoice_id", key.alias("pairing_key"), F.concat(F.lit(f"MC:{run_id}:"), key).alias("candidate_id"), F.when(F.size("ids") > 1, "one_to_many").otherwise("one_to_one").alias("cardinality"), (F.col("gross_paise") - F.col("settled")).alias("residual_paise"))


def evidence_rows(candidates: DataFrame, window: int) -> DataFrame:
    """Four rows per candidate, one a field: both sides' values, the delta, and whether it is within tolerance."""
    from tallyweave.operators.scoring import amount_within

    gap = F.datediff("value_date", "invoice_date")
    row = lambda field, a, b, delta, within: F.struct(F.lit(field).alias("field"), a.cast("string").alias("invoice_value"), b.cast("string").alias("payment_value"), delta.cast("long").alias("delta"), within.alias("within"))
    rows = [
        row("amount", F.col("gross_paise"), F.col("amount_paise"), F.col("amount_paise") - F.col("gross_paise"), amount_within(F.col("gross_paise"), F.col("amount_paise"))),
        row("date", F.col("invoice_date"), F.col("value_date"), gap, F.abs(gap) <= window),
        row("reference", F.col("reference"), F.col("narration_raw"), F.lit(0), F.col("reference_score") > 0),
        row("vendor", F.col("vendor_id"), F.lit(""), F.lit(0), F.col("vendor_score") > 0),
    ]
    return candidates.select("id", "payment_id", F.explode(F.array(*rows)).alias("evidence")).select("id", "payment_id", "evidence.*")


def ordered_signals(signals: DataFrame, strength: list[str]) -> DataFrame:
    """Each document's duplicate signals in order: the strongest kind first, then the earlier document's id."""
    rank = reduce(lambda c, s: c.when(F.col("signal") == s[1], s[0]), enumerate(strength), F.when(F.lit(False), 0))
    turn = F.row_number().over(Window.partitionBy("id").orderBy(rank, "prior_id"))
    return signals.select(F.col("id").alias("invoice_id"), "prior_id", "signal", turn.cast("long").alias("turn"))


def with_self(ledger: DataFrame, document: DataFrame) -> DataFrame:
    """A ledger that surely holds the document, each id once."""
    return ledger.unionByName(document).dropDuplicates(["id"])


def orphans(invoices: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: truth rows without a document, documents without truth."""
    lost = truth.join(invoices.select(F.col("id").alias("invoice_id")), "invoice_id", "left_anti").agg(F.count("*").alias("orphan_truth"))
    return lost.join(invoices.select(F.col("id").alias("invoice_id")).join(truth, "invoice_id", "left_anti").agg(F.count("*").alias("missing_truth")), F.lit(True))


def stratified(scored: DataFrame, declared: dict[str, float]) -> DataFrame:
    """Every stratum, those without documents too: its declared and realised share, and what was decided of it."""
    from tallyweave.operators.review import eval_strata

    spark = scored.sparkSession
    shares = spark.createDataFrame([(s, float(declared.get(s, 0.0))) for s in STRATA], "stratum string, declared double")
    rows = shares.join(eval_strata(scored), "stratum", "left").fillna(0).join(scored.agg(F.count("*").alias("all")), F.lit(True))
    return rows.select("stratum", "declared", F.round(F.coalesce(F.try_divide(F.col("total").cast("double"), "all"), F.lit(0.0)), 9).alias("realised"), "total", "decided", "coverage", "false_clears", "at_risk_paise")


# --- constraints -----------------------------------------------------------------------------


def _one(*values: Column) -> Column:
    return sum((v.isNotNull().cast("int") for v in values), F.lit(0))


def record_violations(runs: DataFrame, payments: DataFrame, candidates: DataFrame, holds: DataFrame, changes: DataFrame, decisions: DataFrame, rules: DataFrame, journal: DataFrame, cleared: DataFrame) -> DataFrame:
    """rule, breaches of the constraints on records; rules without a breach too."""
    money, rate, days = F.col("value_paise"), F.col("value_ratio"), F.col("value_days")
    fits = F.when(F.col("kind") == "exact", _one(money, rate, days) == 0).when(F.col("kind") == "absolute_paise", money.isNotNull() & (_one(rate, days) == 0)).when(F.col("kind").isin("percentage", "similarity"), rate.isNotNull() & (_one(money, days) == 0)).when(F.col("kind") == "days", days.isNotNull() & (_one(money, rate) == 0)).otherwise(False)
    body = F.when(F.col("kind") == "vendor_alias", F.col("raw_value").isNotNull() & F.col("canonical_vendor_id").isNotNull() & F.col("pattern").isNull()).when(F.col("kind") == "reference_pattern", F.col("pattern").isNotNull() & (_one(F.col("raw_value"), F.col("canonical_vendor_id")) == 0)).otherwise(_one(F.col("raw_value"), F.col("canonical_vendor_id"), F.col("pattern")) == 0)
    sha = lambda c: F.col(c).rlike("^[0-9a-f]{64}$")
    shape = F.exists(F.split("conflicts", r"\+"), lambda x: ~x.rlike("^[a-z_]+:(advisory|material|blocking)$"))
    counts = [
        ("V3_unidentified_has_no_vendor", payments.where("status = 'unidentified' AND vendor_id IS NOT NULL")),
        ("V5_rerun_names_parent", runs.where((F.col("kind") == "rerun") != F.col("parent_run_id").isNotNull())),
        ("V6_terminal_is_finished", runs.where("status IN ('completed', 'failed') AND finished_at IS NULL")),
        ("V7_totals_all_or_nothing", runs.where(F.col("totals_total").isNull() != F.col("totals_coverage").isNull())),
        ("V8_cleared_is_reverified", candidates.where("cleared AND NOT reverified")),
        ("V9_one_to_one_has_one_payment", candidates.where("cardinality = 'one_to_one' AND size(payment_ids) <> 1")),
        ("V11_one_clear_per_invoice", candidates.where("cleared").groupBy("id").count().where("count > 1")),
        ("V13_conflict_shape", holds.where(shape)),
        ("V14_release_triple", holds.where(~_one(F.col("released_by"), F.col("released_at"), F.col("release_reason")).isin(0, 3) | (F.trim("released_by") == ""))),
        ("V15_value_matches_kind", changes.where(~fits)),
        ("V16_decision_rules", decisions.where("(action IN ('apply_hold', 'release_hold') AND hold_id IS NULL) OR (action = 'route' AND resolution_path IS NULL)")),
        ("V17_rule_body", rules.where(~body)),
        ("V17_one_active_alias", rules.where("kind = 'vendor_alias' AND active").groupBy("raw_value").count().where("count > 1")),
        ("V19_held_and_cleared", cleared.join(holds.where("released_at IS NULL").select("invoice_id").distinct(), "invoice_id", "left_semi")),
        ("V20_journal_shape", journal.where(~sha("payload_hash") | (F.col("prev_hash").isNotNull() & ~sha("prev_hash")) | F.col("prev_hash").eqNullSafe(F.col("payload_hash")))),
    ]
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("breaches")).select(F.lit(rule).alias("rule"), "breaches") for rule, rows in counts])

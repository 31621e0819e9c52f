"""Scores of invoice and payment pairs, their ranking, and who contests a payment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.reference_data import WINDOW_DAYS
from tallyweave.functions.similarity import names_alike, reference_match, rescaled
from tallyweave.operators.completion import agreeing_pairs, reaching_pairs
from tallyweave.operators.narration import aliases_from_vendors, quoted_references
from tallyweave.operators.nearest import K, NO_DAY, nearest_payments
from tallyweave.operators.normalise import digits_of, names_in, normalise, reference_keys, unicode_fold
from tallyweave.sources.ledger import cut, shuffled

WEIGHTS = {"amount": 0.35, "reference": 0.4, "date": 0.1, "vendor": 0.15}
CONSIDER, ACCEPT, TIE, TOP = 0.25, 0.75, 0.02, 5


def amount_bands(gross: Column) -> tuple[Column, Column]:
    """The differences at which a settlement of gross stops being near, and at which it counts nothing."""
    near = F.greatest(F.lit(50_000), F.floor(F.abs(gross) * 0.12 + 0.5))
    return near, F.greatest(near, F.floor(F.abs(gross) * 0.5 + 0.5))


def amount_score(gross: Column, settled: Column, bands: tuple[Column, Column] | None = None) -> Column:
    """1 at no difference, falling to 0.55 at the near band and to 0 at half the gross; overpayment counts 0.6.

    bands: amount_bands of gross, where they are columns already. Of pairs they should be: written out, the bands
    stand in the expression many times, and Java compiles no method as long as what Spark makes of that.
    """
    delta = settled - gross
    near, zero = bands or amount_bands(gross)
    d = F.abs(delta)
    base = F.when(delta == 0, 1.0).when(d <= near, 1 - 0.45 * d / near).when(d <= zero, 0.55 * (zero - d) / F.when(zero == near, 1).otherwise(zero - near)).otherwise(0.0)
    return F.when(delta > 0, base * 0.6).otherwise(base)


def amount_within(gross: Column, settled: Column) -> Column:
    return F.abs(settled - gross) <= F.greatest(F.lit(50_000), F.floor(F.abs(gross) * 0.12 + 0.5))


def loose_cause(gross: Column, settled: Column) -> Column:
    """The scorer's tolerant guess at why a payment differs from the gross."""
    delta, d = settled - gross, F.abs(settled - gross)
    tds = F.lit(False)
    for rate in (0.01, 0.02, 0.05, 0.1):
        tds |= F.abs(d - F.floor(F.abs(gross) * rate + 0.5)) <= 100
    return F.when(delta == 0, "unattributed").when(d <= 100, "rounding").when(delta > 0, "unattributed").when(tds, "tds_withholding").when(d <= 6000, "bank_charge").when(d <= F.floor(F.abs(gross) * 0.03 + 0.5), "early_payment_discount").otherwise("partial_settlement")


def date_score(invoice_date: Column, value_date: Column) -> Column:
    return gap_score(F.datediff(value_date, invoice_date))


def gap_score(gap: Column) -> Column:
    """date_score of the days from invoice to payment."""
    d = F.abs(gap)
    base = F.when(d <= 21, 1.0).when(d <= WINDOW_DAYS, 1 - 0.8 * (d - 21) / (WINDOW_DAYS - 21)).otherwise(0.0)
    return F.when(gap.isNull(), 0.0).when(gap < 0, base * 0.6).otherwise(base)


#: What a reference recovered from another field counts, beside one from its own.
DISPLACED = 1.0
#: Where references come from, and which of them the default scorer admits.
ADMITTED = ("reference_field", "narration_token", "displaced_from_vendor")


def _view(source: str, raw: Column, folded: bool = False) -> Column:
    return F.struct(F.lit(source).alias("source"), normalise(raw, "reference.v2", without=["unicode_fold"] if folded else ()).alias("value"), digits_of(raw).alias("digits"), F.lit(source.startswith("displaced")).alias("displaced"))


def _displaced(text: Column) -> Column:
    """Tokens of a vendor's name that belong to a reference: with digits, numbers of three at least."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t.rlike(r"\p{N}") & (t.rlike(r"\p{L}") | (F.length(t) >= 3))))


def admissible(views: Column, sources: tuple[str, ...] = ADMITTED) -> Column:
    """The references of a row that are not blank and come from an admitted source."""
    return F.filter(views, lambda v: (F.coalesce(v["value"], F.lit("")) != "") & v["source"].isin(*sources))


def prepared_invoices(invoices: DataFrame) -> DataFrame:
    """invoices with refs (source, value, digits, displaced), their reference views, and vendor_value, the canonical name.

    Purchase orders count where the column purchase_order exists. Null fields have no view.
    """
    name = F.col("vendor_name") if "vendor_name" in invoices.columns else F.lit(None).cast("string")
    own = [_view("reference_field", F.col("reference"))] + ([_view("purchase_order", F.col("purchase_order"))] if "purchase_order" in invoices.columns else [])
    moved = F.transform(_displaced(F.coalesce(unicode_fold(name), F.lit(""))), lambda t: _view("displaced_from_vendor", t, True))
    return invoices.withColumns({"refs": F.concat(F.array(*own), moved), "vendor_value": F.coalesce(normalise(name, "vendor.v1"), F.lit(""))})


def prepared_payments(payments: DataFrame, vendors: DataFrame | None = None) -> DataFrame:
    """payments with refs, the references that a narration quotes; vendor_value, the canonical words beside them; payer_id, the vendor of exactly that name.

    vendors has vendor_id and vendor_name; of vendors that share a canonical name the least id owns it.
    """
    text = unicode_fold(F.coalesce(F.col("narration_raw"), F.lit("")))
    refs = F.transform(quoted_references(text), lambda t: _view("narration_token", t, True))
    rows = payments.withColumns({"refs": refs, "vendor_value": F.coalesce(normalise(names_in(text), "vendor.v1"), F.lit(""))})
    if vendors is None:
        return rows.withColumn("payer_id", F.lit(None).cast("string"))
    known = aliases_from_vendors(vendors, normalise(F.col("vendor_name"), "vendor.v1")).select("key", F.col("vendor_id").alias("payer_id"))
    return rows.join(shuffled(known), F.nullif("vendor_value", F.lit("")) == F.col("key"), "left").drop("key")


def vendor_score(a_id: Column, b_id: Column, a: Column, b: Column) -> Column:
    """1 for one known vendor, else how alike the canonical names are above a floor; blank names score 0."""
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(a_id == b_id, 1.0).when(blank, 0.0).otherwise(rescaled(names_alike(a, b), 0.55))


def name_links(vendors: DataFrame, payers: DataFrame, grams: int = 5, rare: int = 4, least: float = 0.75) -> DataFrame:
    """vendor_value, payer_value, alike: for each distinct payer's name the most alike vendors' names, from least on; ties stay.

    Names meet that share one of their rarest q-grams of fused text, counted over both sides, so a name
    that is cut, misspelt or run together meets its own, and common words alone bring none together.
    """
    cut_up = lambda rows, own: rows.select(F.col("vendor_value").alias(own)).where(F.col(own) != "").distinct().withColumn("gram", F.explode(_grams(F.col(own), grams)))
    left, right = cut_up(vendors, "vendor_value"), cut_up(payers, "payer_value")
    counts = left.select("gram").unionByName(right.select("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    rarest = lambda rows, own: rows.join(shuffled(counts), "gram").withColumn("turn", F.row_number().over(Window.partitionBy(own).orderBy("n", "gram"))).where(F.col("turn") <= rare).select(own, "gram")
    found = rarest(left, "vendor_value").join(shuffled(rarest(right, "payer_value")), "gram").select("vendor_value", "payer_value").distinct()
    found = cut(found.withColumn("alike", names_alike(F.col("vendor_value"), F.col("payer_value")))).where(F.col("alike") >= least)
    return found.withColumn("best", F.max("alike").over(Window.partitionBy("payer_value"))).where("alike = best").drop("best")


def _grams(name: Column, n: int) -> Column:
    fused = F.regexp_replace(name, r"\s+", "")
    places = F.sequence(F.lit(1), F.greatest(F.length(fused) - n + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substr(fused, i, F.lit(n))))


def composite(scores: dict[str, Column]) -> Column:
    total = sum((scores[k] * w for k, w in list(WEIGHTS.items())[1:]), scores["amount"] * WEIGHTS["amount"])
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def rounded(score: Column, places: int) -> Column:
    """A score of 0 or more to so many places, as SQL engines round doubles: half up of the double times a power of ten.

    round() goes by the shortest decimal digits instead, so it takes 0.1234565 up where the product falls below the half.
    """
    scale = 10.0**places
    scaled = score * scale
    whole = F.floor(scaled)
    return (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / scale


def exact_pairs(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Pairs that quote one number and settle to the paisa: an equi join on (number, amount)."""
    named = reference_keys(invoices, "id", "reference").join(invoices.select("id", F.col("gross_paise").alias("amount")), "id")
    quoted = reference_keys(payments, "payment_id", "narration_raw").join(payments.select("payment_id", F.col("amount_paise").alias("amount")), "payment_id")
    return named.join(quoted, ["number", "amount"]).select(F.col("id").alias("invoice_id"), "payment_id").distinct()


def _numbers(refs: Column) -> Column:
    """The numbers of a row's canonical references, but years before them, and those fused to a year."""
    words = F.flatten(F.transform(refs, lambda r: F.split(F.regexp_replace(r["value"], "(^| )(?:(?:19|20)[0-9]{2} )+", "$1"), " ")))
    plain = F.filter(words, lambda w: w.rlike("^[0-9]+$"))
    fused = F.transform(F.filter(words, lambda w: w.rlike("^(19|20)[0-9]{6,}$")), lambda w: F.regexp_replace(F.substring(w, 5, 99), "^0+([0-9])", "$1"))
    return F.array_distinct(F.concat(plain, fused))


def _drifts(number: Column) -> Column:
    """A number and it without one digit: numbers a wrong, missing or added digit apart share one of these."""
    places = F.sequence(F.lit(1), F.length(number))
    less = F.transform(places, lambda i: F.concat(F.substr(number, F.lit(1), i - 1), F.substr(number, i + 1, F.lit(99))))
    return F.array_distinct(F.concat(F.array(number), less))


def _days(d: Column) -> Column:
    return F.coalesce(F.unix_date(d.cast("date")), F.lit(NO_DAY))


def candidate_pairs(invoices: DataFrame, payments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """id, payment_id, of prepared invoices and payments: every pair that can be in the top of its document, as if all pairs were scored.

    The likely pairs set each document's bar, the composite of its last of TOP (CONSIDER where it has fewer);
    beside the best of them come all pairs that bounds don't keep below the bar (operators/completion.py).
    Documents and payments without an amount have no candidates.
    """
    best = cut(ranked(scored_pairs(likely_pairs(invoices, payments, names), invoices, payments, top=TOP)).select("id", "payment_id", "composite", "rank"))
    bars = best.where(F.col("rank") == TOP).select("id", F.col("composite").alias("bar"))
    parts = lambda name, vendor: (admissible(F.col("refs"))["value"].alias("refs"), admissible(F.col("refs"))["digits"].alias("digits"), F.col("vendor_value").alias(name), F.col(vendor).alias("vendor"))
    docs = invoices.where("gross_paise IS NOT NULL").select("id", F.col("gross_paise").alias("gross"), _days(F.col("invoice_date")).alias("day"), *parts("name", "vendor_id"))
    docs = cut(docs.join(shuffled(bars), "id", "left").withColumn("bar", F.coalesce("bar", F.lit(CONSIDER))))
    lines = payments.where("amount_paise IS NOT NULL").select("payment_id", F.col("amount_paise").alias("amount"), _days(F.col("value_date")).alias("day"), *parts("name", "payer_id"))
    rest = reaching_pairs(docs.drop("digits"), lines.drop("digits")).unionByName(agreeing_pairs(docs.select("id", "gross", "day", "bar", "digits"), lines.select("payment_id", "amount", "day", "digits"), amount_score, gap_score))
    return best.select("id", "payment_id").unionByName(rest).distinct()


def likely_pairs(invoices: DataFrame, payments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """id, payment_id of good candidates: the K best by money and date in each class. They set bars; they aren't all.

    Classes: everything; one quoted number, of any length; one vendor, by exact or similar name
    (name_links). Beside them, numbers a digit apart (four digits or more) whose amounts are within half
    of each other in the window.
    """
    number = lambda rows: F.explode(F.transform(_numbers(F.col("refs")), lambda n: F.xxhash64(F.lit("number"), n)))
    vendor = lambda c: F.xxhash64(F.lit("vendor"), c)
    all_, zero = F.lit(0).cast("long"), F.col("class")
    docs = invoices.select("id", F.col("gross_paise").alias("gross"), _days(F.col("invoice_date")).alias("day"), "refs", "vendor_id", "vendor_value")
    lines = payments.where("amount_paise IS NOT NULL").select("payment_id", F.col("amount_paise").alias("amount"), _days(F.col("value_date")).alias("day"), "refs", "payer_id", "vendor_value")
    doc, line = ("id", "gross", "day"), ("payment_id", "amount", "day")
    asked = docs.select(all_.alias("class"), *doc).unionByName(docs.select(number(docs).alias("class"), *doc))
    paid = lines.select(all_.alias("class"), *line).unionByName(lines.select(number(lines).alias("class"), *line))
    asked = asked.unionByName(docs.where("vendor_id IS NOT NULL").select(vendor(F.col("vendor_id")).alias("class"), *doc))
    paid = paid.unionByName(lines.where("payer_id IS NOT NULL").select(vendor(F.col("payer_id")).alias("class"), *line))
    if names is not None:
        named = docs.select("vendor_value", "vendor_id").where("vendor_id IS NOT NULL").distinct()
        linked = names.join(shuffled(named), "vendor_value").select("payer_value", "vendor_id").distinct()
        paid = paid.unionByName(lines.join(shuffled(linked), F.col("vendor_value") == F.col("payer_value")).select(vendor(F.col("vendor_id")).alias("class"), *line))
    asked = asked.where(zero.isNotNull() & F.col("gross").isNotNull())
    best = nearest_payments(asked.drop("id"), paid)
    met = asked.join(shuffled(best), ["class", "gross", "day"]).select("id", "payment_id")
    return met.unionByName(_drifted_pairs(docs, lines)).distinct()


def _drifted_pairs(docs: DataFrame, lines: DataFrame, least: int = 4) -> DataFrame:
    keys = lambda rows, *own: rows.where(F.col("day") != NO_DAY).select(*own, F.explode(_numbers(F.col("refs"))).alias("number")).where(F.length("number") >= least).withColumn("drift", F.explode(_drifts(F.col("number"))))
    stretch = F.floor(F.col("day") / WINDOW_DAYS).cast("int")
    asked = keys(docs, "id", "gross", "day").withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    paid = keys(lines, "payment_id", "amount", F.col("day")).withColumn("stretch", stretch).withColumnsRenamed({"day": "paid_day", "number": "quoted"})
    near = (F.abs(F.col("paid_day") - F.col("day")) <= WINDOW_DAYS) & (F.abs(F.col("amount") - F.col("gross")) <= F.greatest(F.lit(50_000), F.abs("gross") / 2))
    return asked.join(shuffled(paid), ["drift", "stretch"]).where(near & (F.col("number") != F.col("quoted"))).select("id", "payment_id").distinct()


def exhaustive_pairs(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Every pair; meant as the yardstick on ledgers of a few thousand rows."""
    return invoices.select("id").crossJoin(payments.select("payment_id"))


def _evidence(pairs: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Narrow rows of pairs with the scores of amount, reference and date; vendors still open."""

    def side(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        refs = rows.select(*columns, admissible(F.col("refs")).alias(f"{name}_refs"), F.col("vendor_value").alias(f"{name}_vendor"))
        return refs.withColumns({f"{name}_{part}": F.col(f"{name}_refs")[part] for part in ("value", "digits")})

    left = side(invoices, "invoice", "id", "gross_paise", "invoice_date", "vendor_id")
    right = side(payments, "payment", "payment_id", "amount_paise", "value_date", "payer_id")
    rows = pairs.join(shuffled(right), "payment_id").join(shuffled(left), "id")
    rows = rows.withColumn("match", reference_match("invoice_value", "invoice_digits", "payment_value", "payment_digits"))
    of = lambda side, place, part: F.get(f"{side}_refs", F.col(f"match.{place}"))[part]
    displaced = F.coalesce(of("invoice", "a", "displaced"), F.lit(False)) | F.coalesce(of("payment", "b", "displaced"), F.lit(False))
    return rows.select(
        "id", "payment_id", "gross_paise", "amount_paise", "invoice_date", "value_date", "vendor_id", "payer_id", "invoice_vendor", "payment_vendor",
        F.col("match").isNull().alias("reference_absent"), displaced.alias("displaced"), (F.size("payment_refs") > 0).alias("recovered"),
        F.col("match.observed").alias("reference_observed"), F.coalesce("match.exact", F.lit(False)).alias("reference_exact"), F.coalesce("match.carried", F.lit(False)).alias("reference_carried"),
        of("invoice", "a", "value").alias("invoice_reference"), of("payment", "b", "value").alias("payment_reference"),
        amount_score(F.col("gross_paise"), F.col("amount_paise")).alias("amount_score"),
        (F.coalesce("match.score", F.lit(0.0)) * F.when(displaced, DISPLACED).otherwise(1.0)).alias("reference_score"),
        date_score(F.col("invoice_date"), F.col("value_date")).alias("date_score"),
    )


def scored_pairs(pairs: DataFrame, invoices: DataFrame, payments: DataFrame, top: int | None = None) -> DataFrame:
    """The four scores and the composite of pairs (id, payment_id) of prepared rows, and the best reference pair of each.

    With top, pairs that can't be among the top of their document, whatever their vendors' names, are left out before names are compared.
    """
    rows = _evidence(pairs, invoices, payments)
    scores = {k: F.col(f"{k}_score") for k in ("amount", "reference", "date")}
    if top:
        known = F.coalesce((F.col("vendor_id") == F.col("payer_id")).cast("double"), F.lit(0.0))
        rows = rows.withColumn("surely", composite(scores | {"vendor": known}))
        order = Window.partitionBy("id").orderBy(F.col("surely").desc())
        bar = F.nth_value("surely", top).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        possible = F.col("surely") + F.when(F.col("vendor_id") == F.col("payer_id"), 0.0).otherwise(WEIGHTS["vendor"])
        rows = cut(rows.withColumn("bar", F.coalesce(bar, F.lit(CONSIDER))).where(possible >= F.greatest("bar", F.lit(CONSIDER))).drop("surely", "bar"))
    vendor = vendor_score(F.col("vendor_id"), F.col("payer_id"), F.col("invoice_vendor"), F.col("payment_vendor"))
    rows = rows.withColumn("vendor_score", vendor)
    return rows.withColumn("composite", composite(scores | {"vendor": F.col("vendor_score")}))


def ranked(pairs: DataFrame, consider: float = CONSIDER, top: int = TOP) -> DataFrame:
    """The retained candidates of each invoice under a total order, their rank, and whether the best are tied."""
    gap = F.abs(F.datediff("value_date", "invoice_date"))
    own = Window.partitionBy("id")
    order = own.orderBy(F.col("composite").desc(), F.col("reference_score").desc(), F.col("amount_score").desc(), F.col("vendor_score").desc(), gap.asc_nulls_last(), "payment_id")
    # the composite is the first in order, so the bar may come after the ranks; before them Spark would work scores out in the filter, again and again
    kept = pairs.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= top) & (F.col("composite") >= consider))
    near = F.max("composite").over(own) - F.col("composite") <= TIE
    kept = kept.withColumn("in_tie", near)
    return kept.withColumn("tied", F.col("in_tie") & (F.sum(F.col("in_tie").cast("int")).over(own) >= 2))


def contested(candidates: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Payments that are the acceptable first choice of more than one invoice."""
    first = candidates.where((F.col("rank") == 1) & (F.col("composite") >= accept))
    return first.groupBy("payment_id").agg(F.count("*").alias("claimants"), F.array_join(F.array_sort(F.collect_list("id")), "+").alias("invoice_ids")).where("claimants > 1")


def naive_exact(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """The baseline: the least payment whose extracted reference is exactly the invoice's, else the least of exactly its amount, else nothing.

    Blank and null references equal nothing. Nothing is normalised, and a payment may be taken more than once.
    """
    quoted = payments.where("reference_extracted <> ''").groupBy(F.col("reference_extracted").alias("reference")).agg(F.min("payment_id").alias("quoted"))
    same = payments.groupBy(F.col("amount_paise").alias("gross_paise")).agg(F.min("payment_id").alias("same"))
    out = invoices.select("id", "reference", "gross_paise").join(shuffled(quoted), "reference", "left").join(shuffled(same), "gross_paise", "left").withColumn("payment_id", F.coalesce("quoted", "same"))
    return out.select(F.col("id").alias("invoice_id"), F.when(F.col("payment_id").isNotNull(), "auto_clear").otherwise("unmatched").alias("action"), "payment_id")

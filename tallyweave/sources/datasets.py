"""Datasets on disk: JSON with rejects, outcomes of other systems, tree hashes, sealed documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INVOICE = "id string, vendor_id string, reference string, invoice_date string, received_date string, gross_paise string, net_paise string, period string"
PAYMENT = "id string, value_date string, amount_paise string, narration_raw string"
MONEY = ("gross_paise", "net_paise", "amount_paise")


def whole_money(c: Column) -> Column:
    """An integer or a string of digits as minor units; anything else is null."""
    return F.when(c.rlike("^-?[0-9]+$"), c).try_cast("bigint")


def read_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejects of a JSON array, or of one under invoices, rows or data. Rejects have problem."""
    raw = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<struct<{schema}>>")
    inside = F.from_json("value", f"struct<invoices: array<struct<{schema}>>, rows: array<struct<{schema}>>, data: array<struct<{schema}>>>")
    listed = F.ltrim(F.col("value")).startswith("[")
    rows = raw.select(F.explode(F.when(listed, bare).otherwise(F.coalesce(inside["invoices"], inside["rows"], inside["data"]))).alias("row")).select("row.*")
    problems = [F.when(F.col("id").isNull(), "id")]
    for name in rows.columns:
        if name in MONEY:
            problems.append(F.when(whole_money(F.col(name)).isNull(), name))
        elif name.endswith("_date"):
            problems.append(F.when(F.try_to_date(name, "yyyy-MM-dd").isNull(), name))
    rows = rows.withColumn("problem", F.array_join(F.array_compact(F.array(*problems)), ","))
    good = rows.where("problem = ''").drop("problem")
    for name in good.columns:
        if name in MONEY:
            good = good.withColumn(name, whole_money(F.col(name)))
        elif name.endswith("_date"):
            good = good.withColumn(name, F.try_to_date(name, "yyyy-MM-dd"))
    return good, rows.where("problem <> ''")


def parsed_outcomes(raw: DataFrame, invoices: DataFrame) -> DataFrame:
    """Another system's outcomes (ordinal, invoice_id, action, payment_ids, hold_type, requires_human), made sound.

    Unknown invoices go; an invoice's first row counts; ids lose repeats. A clear of nothing is
    unmatched; a clear that wants a person is a hold if it has a type, else unmatched.
    """
    known = raw.join(invoices.select(F.col("id").alias("invoice_id")), "invoice_id", "left_semi")
    first = known.withColumn("turn", F.row_number().over(Window.partitionBy("invoice_id").orderBy("ordinal"))).where("turn = 1")
    ids = F.array_distinct("payment_ids")
    clear = F.col("action") == "auto_clear"
    action = F.when(clear & (F.coalesce(F.size(ids), F.lit(0)) < 1), "unmatched").when(clear & F.col("requires_human"), F.when(F.col("hold_type").isNotNull(), "hold").otherwise("unmatched")).otherwise(F.col("action"))
    return first.select("invoice_id", action.alias("action"), F.array_join(F.array_sort(ids), "+").alias("payment_ids"), "hold_type")


def tree_hash(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and SHA-256 over the sorted listing 'relative-path hash' of all files below path, MANIFEST left out.

    Hashes are sorted and joined a folder at a time, so that no list holds a whole tree's files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/") + "/"
    relative = F.regexp_replace(F.col("path"), "^[a-z]+:/+", "/")
    listed = files.select(relative.alias("path"), F.sha2("content", 256).alias("hash")).where(~F.col("path").endswith("/MANIFEST"))
    listed = listed.select(F.substring("path", F.lit(len(base) + 1), F.length("path")).alias("path"), "hash")
    folder = F.regexp_extract("path", "^(.*?)[^/]*$", 1)
    folders = listed.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "hash"))), "\n").cast("binary"), 256).alias("hash"))
    return folders.agg(F.sum("files").alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "folder", "hash"))), "\n").cast("binary"), 256).alias("root"))


#: Header fields of a MANIFEST.
MANIFEST_FIELDS = ("dataset", "generator", "seed", "root")


def manifest_fields(spark: SparkSession, path: str) -> DataFrame:
    """field, value of the header lines 'field: value' of a MANIFEST that are known, the first of each."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("turn", "line"))
    parts = lines.select("turn", F.trim(F.regexp_extract("line", r"^#?\s*(\w+)\s*[:=]", 1)).alias("field"), F.trim(F.regexp_extract("line", r"^#?\s*\w+\s*[:=]\s*(.*)$", 1)).alias("value"))
    return parts.where(F.col("field").isin(*MANIFEST_FIELDS)).groupBy("field").agg(F.min_by("value", "turn").alias("value"))


def declared_mix(spark: SparkSession, path: str, fallback: dict[str, float]) -> DataFrame:
    """stratum, declared from a JSON object, flat or under declared; fallback where the file has no number."""
    names = ", ".join(f"{k} double" for k in fallback)
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<declared: struct<{names}>, {names}>").alias("x"))
    pairs = F.array(*[F.struct(F.lit(k).alias("stratum"), F.coalesce(F.col(f"x.declared.{k}"), F.col(f"x.{k}"), F.lit(float(v))).alias("declared")) for k, v in fallback.items()])
    return raw.select(F.explode(pairs).alias("pair")).select("pair.*")


#: Rows of one part of a report at most.
REPORT_ROWS = 10_000


def write_report(parts: dict[str, DataFrame], path: str) -> dict:
    """One pretty JSON document of small tables (aggregates), sealed; each part a list of rows."""
    document = {}
    for name, df in parts.items():
        rows = df.limit(REPORT_ROWS + 1).collect()
        if len(rows) > REPORT_ROWS:
            raise ValueError(f"{name} is no small table: write it as parquet")
        document[name] = [row.asDict(recursive=True) for row in rows]
    with open(path, "w") as file:
        json.dump(document, file, indent=2, sort_keys=True, default=str)
    return sealed(json.loads(json.dumps(document, default=str)))


def sealed(document: dict) -> dict:
    """A small document with the hash and length of its canonical JSON."""
    import hashlib

    text = json.dumps(document, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()
    return {"document": document, "sha256": hashlib.sha256(text).hexdigest(), "bytes": len(text)}

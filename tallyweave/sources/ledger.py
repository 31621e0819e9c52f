"""The ledger that the queries run on: invoices, bank lines and truth derived from the whole orders table.

The derivation is plain SQL that Spark and DuckDB run alike, so an oracle can inline it. Every order
is one invoice of its customer; defects are seeded by the order's number: bank charges, tax withheld,
rounding, split and partial settlements, unpaid documents, copies, tax, distribution and period
defects, credit notes, and monthly series. Money is integer minor units.

Each of a folder's two tables is derived once per session and written as parquet to the shared
checkpoint folder, so that queries scan the columns they need and never derive it anew; so are
prepared rows and ranked candidates, which many queries share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LEDGER = """
ord AS (
  SELECT o_orderkey AS j, o_custkey AS v, CAST(o_orderdate AS DATE) AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders),
plain AS (
  SELECT 'INV-' || lpad(CAST(j AS VARCHAR(12)), 9, '0') AS id, j, v,
         'INV/' || CAST(year(d) AS VARCHAR(4)) || '/' || lpad(CAST(j AS VARCHAR(12)), 7, '0') AS reference,
         d AS invoice_date, d + CAST(j % 7 AS INT) AS received_date, CASE WHEN j % 31 = 9 THEN -amount ELSE amount END AS gross_paise,
         CASE WHEN j % 31 = 9 THEN -CAST(floor(amount / 1.18 + 0.5) AS BIGINT) ELSE CAST(floor(amount / 1.18 + 0.5) AS BIGINT) END AS true_net,
         j % 31 = 9 AS is_credit_note, CAST(NULL AS VARCHAR(12)) AS recurrence, 0 AS copy
  FROM ord),
every_doc AS (
  SELECT * FROM plain
  UNION ALL
  SELECT 'DUP-' || substr(id, 5, 9), j, v, reference, invoice_date, received_date + 9, gross_paise, true_net, is_credit_note, recurrence, 1 FROM plain WHERE j % 17 = 3
  UNION ALL
  SELECT 'DUQ-' || substr(id, 5, 9), j, v, 'BILL-' || substr(reference, 10, 7) || '-A', invoice_date, received_date + 1, gross_paise, true_net, is_credit_note, recurrence, 2 FROM plain WHERE j % 17 = 7
  UNION ALL
  SELECT 'REC-' || lpad(CAST(o.j AS VARCHAR(12)), 9, '0') || '-' || m.m, o.j, o.v + 1000000, 'SUB/' || lpad(CAST(o.j AS VARCHAR(12)), 7, '0') || '/' || m.m,
         CAST('2024-' || m.m || '-05' AS DATE), CAST('2024-' || m.m || '-07' AS DATE), 5000000 + o.j % 1000, CAST(floor((5000000 + o.j % 1000) / 1.18 + 0.5) AS BIGINT), FALSE, 'monthly', 3
  FROM ord o JOIN (SELECT '01' AS m UNION ALL SELECT '02' UNION ALL SELECT '03' UNION ALL SELECT '04') m ON TRUE WHERE o.j % 41 = 0),
taxed AS (
  SELECT *, gross_paise - true_net AS tax, (v % 2 = 0) <> (j % 19 = 4) AS intra FROM every_doc),
inv AS (
  SELECT id, j, 'VEN-' || lpad(CAST(v AS VARCHAR(12)), 7, '0') AS vendor_id,
         translate(CAST(v * 7919 + 1000003 AS VARCHAR(16)), '0123456789', 'korstinlea') || CASE v % 6 WHEN 0 THEN ' Sundar ' WHEN 1 THEN ' Meridian ' WHEN 2 THEN ' Northgate ' WHEN 3 THEN ' Lotus ' WHEN 4 THEN ' Harbour ' ELSE ' Pioneer ' END
           || CASE v % 5 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Traders' WHEN 2 THEN 'Packaging' WHEN 3 THEN 'Logistics' ELSE 'Chemicals' END || CASE v % 3 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' LLP' ELSE '' END AS vendor_name, reference, invoice_date, received_date,
         invoice_date + CAST(30 AS INT) AS due_date,
         CASE WHEN j % 13 = 4 THEN substr(CAST(invoice_date + 31 AS VARCHAR(10)), 1, 7) ELSE substr(CAST(invoice_date AS VARCHAR(10)), 1, 7) END AS period,
         gross_paise, CASE WHEN j % 29 = 6 THEN true_net - 75000 ELSE true_net END AS net_paise, tax AS tax_total,
         CASE WHEN intra THEN CAST(0 AS BIGINT) ELSE tax END AS igst,
         CASE WHEN intra THEN CAST(floor(tax / 2.0) AS BIGINT) + CASE WHEN j % 23 = 5 THEN 30000 ELSE 0 END ELSE CAST(0 AS BIGINT) END AS cgst,
         CASE WHEN intra THEN tax - CAST(floor(tax / 2.0) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS sgst,
         CAST(0 AS BIGINT) AS cess, is_credit_note, recurrence, copy
  FROM taxed),
line AS (
  SELECT i.id AS settles, i.j, i.vendor_id, i.vendor_name, i.reference, i.received_date + CAST(3 + i.j % 40 AS INT) AS value_date, i.gross_paise, i.net_paise, p.part
  FROM inv i JOIN (SELECT 1 AS part UNION ALL SELECT 2) p ON p.part = 1 OR i.j % 10 = 4
  WHERE i.copy IN (0, 3) AND NOT i.is_credit_note AND i.j % 11 <> 10),
pay AS (
  SELECT 'PAY-' || substr(settles, 1, 3) || substr(settles, 5, 13) || '-' || CAST(part AS VARCHAR(2)) AS payment_id, value_date,
         CASE j % 10 WHEN 1 THEN gross_paise - 23600 WHEN 2 THEN gross_paise - CAST(floor(net_paise * 0.10 + 0.5) AS BIGINT) WHEN 3 THEN gross_paise - 47
                     WHEN 4 THEN CASE part WHEN 1 THEN CAST(floor(gross_paise * 0.6) AS BIGINT) ELSE gross_paise - CAST(floor(gross_paise * 0.6) AS BIGINT) END
                     WHEN 5 THEN CAST(floor(gross_paise * 0.7) AS BIGINT) ELSE gross_paise END AS amount_paise,
         CASE j % 5 WHEN 0 THEN 'NEFT UTR' || CAST(100000000 + j AS VARCHAR(12)) || ' ' || reference
                    WHEN 1 THEN 'RTGS CR/' || replace(reference, '/', '-') || '/PYMT'
                    WHEN 2 THEN 'IMPS/' || replace(reference, '/', '') || '/AP RUN'
                    WHEN 3 THEN 'PAYMENT AGAINST INVOICE NO ' || lower(reference)
                    ELSE 'RTGS INWARD CLEARING UTR' || CAST(200000000 + j AS VARCHAR(12)) || CASE WHEN j % 10 = 4 THEN ' ' || reference ELSE '' END END
           || CASE j % 6 WHEN 0 THEN ' ' || upper(vendor_name) WHEN 1 THEN ' ' || substr(upper(vendor_name), 1, 16) WHEN 2 THEN ' ' || replace(lower(vendor_name), 'a', '') WHEN 3 THEN ' ' || replace(vendor_name, ' ', '') ELSE '' END AS narration_raw,
         CASE WHEN j % 5 = 0 OR j % 10 = 4 THEN reference END AS reference_extracted, settles, 'TXN' || substr(settles, 5, 13) || '-' || CAST(part AS VARCHAR(2)) AS bank_transaction_id
  FROM line)
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Registers parquet tables of a folder as temporary views."""
    for name in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _select(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    spread(spark.read.parquet(f"{sf_dir}/orders.parquet")).createOrReplaceTempView("orders")
    return spark.sql(f"WITH {LEDGER} {body}")


#: Written tables by application, folder and name.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine without it, one of our own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table over all cores, if it has fewer input splits than that.

    Meant for a plain scan: asking a plan with shuffles for its partitions would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffled(df: DataFrame) -> DataFrame:
    """The same rows for a join that shuffles them, whatever size Spark takes them for.

    Spark doesn't count the rows that explode() adds, and takes a parquet file's size for its rows', so a table that
    grows with the input can pass for small, and is then gathered on the driver to be broadcast.
    """
    return df.hint("merge")


def kept(spark: SparkSession, sf_dir: str, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
    """Rows of a folder, computed once a session and written to the shared folder."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}-{name}"
        rows().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "inv", lambda: _select(spark, sf_dir, "SELECT * FROM inv"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "pay", lambda: _select(spark, sf_dir, "SELECT * FROM pay"))

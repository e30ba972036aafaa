"""Ledger field mapping, and A17 result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: ledger field names
LEDGER_FIELDS = [
    ("BELNR", "InvoiceNumber"),
    ("BUDAT", "InvoiceDate"),
    ("WAERS", "Currency"),
    ("LIFNR", "Vendor"),
    ("DMBTR", "Amount"),
    ("EBELN", "PONumber"),
    ("KOSTL", "CostCenter"),
]


def ledger_export(df: DataFrame) -> DataFrame:
    cols = []
    for field, src in LEDGER_FIELDS:
        cols.append((F.col(src) if src in df.columns else F.lit(None).cast("string")).alias(field))
    return df.select(*cols)


def _with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("invoice_month", F.coalesce(F.date_format("InvoiceDate", "yyyy-MM"), F.lit("NaT")))


def write_scored(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", months_only: bool = False) -> None:
    """Write the scored table partitioned by invoice month so month / year
    filters prune files. With ``months_only`` an overwrite replaces the months that ``df`` holds and
    leaves the others, so writing the same months again changes nothing."""
    out = _with_month(df).write.mode(mode).partitionBy("invoice_month")
    if months_only:
        out = out.option("partitionOverwriteMode", "dynamic")
    out.format(fmt).save(path)


def save_scored_table(df: DataFrame, table: str, path: str | None = None, buckets: int = 64) -> None:
    """The scored table as a catalog table by month, in ``buckets`` by vendor inside each month.

    Aggregates by vendor (B5, F4, F5) and by vendor and more (B1, B2) read a bucket in one task without an
    exchange. A vendor lies in one bucket: keep to ``write_scored`` where a vendor is too large for a task."""
    out = _with_month(df).write.mode("overwrite").partitionBy("invoice_month").bucketBy(buckets, "Vendor").sortBy("Vendor")
    if path:
        out = out.option("path", path)
    out.saveAsTable(table)


def rewrite_months(df: DataFrame, table: str) -> None:
    """Replace the months that ``df`` holds in a table of ``save_scored_table``; other months stay as they are."""
    from tallyhawk.session import session_conf
    spark = df.sparkSession
    columns = spark.table(table).columns
    with session_conf(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        _with_month(df).select(*columns).write.mode("overwrite").insertInto(table)


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)

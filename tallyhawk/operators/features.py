"""Anomaly-model features and behaviour features.

Vendor statistics are partial aggregates (count / sum / sum of squares per
task, merged per vendor) joined back on Vendor; the vendor table has one row
per vendor and is broadcast by AQE when its runtime size is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.functions.columns import exact_mean, money, num_key

FEATURE_COLS = ["Amount", "VendorAvgAmount", "VendorStdAmount", "VendorTxnCount", "InvoiceDayOfWeek"]
NO_PREVIOUS_DAYS = 999
HIGH_VALUE_FACTOR = 3.0


def vendor_amount_stats(df: DataFrame) -> DataFrame:
    """Mean, sample std (one row → 0) and count of Amount (nulls as 0)."""
    a = F.coalesce(F.col("Amount"), F.lit(0.0))
    return df.groupBy("Vendor").agg(
        (F.sum(money(a)).cast("double") / F.count(a)).alias("VendorAvgAmount"),
        F.coalesce(F.stddev_samp(a), F.lit(0.0)).alias("VendorStdAmount"),
        F.count(a).alias("VendorTxnCount"))


def anomaly_features(df: DataFrame) -> DataFrame:
    """The five-column feature table (nulls → 0; missing weekday → −1)."""
    stats = vendor_amount_stats(df.where(F.col("Vendor").isNotNull()))
    out = df.join(stats, "Vendor", "left")
    return out.select(
        "*",
        F.coalesce(F.weekday("InvoiceDate"), F.lit(-1)).alias("InvoiceDayOfWeek"),
    ).withColumns({
        "Amount_f": F.coalesce(F.col("Amount"), F.lit(0.0)),
        "VendorAvgAmount": F.coalesce("VendorAvgAmount", F.lit(0.0)),
        "VendorStdAmount": F.coalesce("VendorStdAmount", F.lit(0.0)),
        "VendorTxnCount": F.coalesce("VendorTxnCount", F.lit(0)),
    })


def feature_vector(df: DataFrame | None = None) -> F.Column:
    return F.array(F.col("Amount_f").cast("double"), F.col("VendorAvgAmount").cast("double"),
                   F.col("VendorStdAmount").cast("double"), F.col("VendorTxnCount").cast("double"),
                   F.col("InvoiceDayOfWeek").cast("double"))


def behaviour_features(df: DataFrame) -> DataFrame:
    """C2a, C2b, C2d, C2e (C2c is ``days_since_last``)."""
    stats = df.groupBy("Vendor").agg(F.count("InvoiceNumber").alias("VendorInvoiceCount"),
                                     exact_mean("Amount").alias("VendorAvgAmount"))
    out = df.join(stats, "Vendor", "left")
    return out.withColumns({
        "LogAmount": F.when(F.col("Amount") <= 0, F.lit(0.0)).otherwise(F.log(F.col("Amount"))),
        "HasPO": F.col("PONumber").isNotNull() & (F.col("PONumber") != ""),
        "HighValueInvoice": F.coalesce(F.col("Amount") > F.lit(HIGH_VALUE_FACTOR) * F.col("VendorAvgAmount"),
                                       F.lit(False)),
    })


def days_since_last(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Whole days since the vendor's previous invoice in date order
    (nulls last, ties by InvoiceID); first row, a missing date or a missing
    vendor → 999.

    Skew-safe lag: rows are range-partitioned on (Vendor, date, id), so a vendor
    with a third of all rows spans many ranges. Inside a range the previous
    row comes from a window keyed by (range, Vendor); the first row of a vendor
    in a range takes the vendor's last date from the nearest earlier range (a
    table of at most ranges × vendors rows). The ranged table is written once
    so both passes see the same ranges."""
    from tallyhawk.functions.joins import join_null_safe
    from tallyhawk.session import materialize
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["Vendor", "_dnull", "InvoiceDate", "_idn"]
    t = df.withColumn("_dnull", F.col("InvoiceDate").isNull()).withColumn("_idn", num_key("InvoiceID"))
    ranged = materialize(t.repartitionByRange(p, *order).withColumn("_part", F.spark_partition_id()),
                         "days-since-last")
    w = Window.partitionBy("_part", "Vendor").orderBy("_dnull", "InvoiceDate", "_idn")
    local = ranged.withColumn("_prev", F.lag("InvoiceDate").over(w)).withColumn("_rn", F.row_number().over(w))
    last = ranged.groupBy("_part", "Vendor").agg(
        F.max_by("InvoiceDate", F.struct("_dnull", "InvoiceDate", "_idn")).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("Vendor").orderBy("_part"))) \
                .select("_part", "Vendor", "_carry")
    out = join_null_safe(local, carry, ["_part", "Vendor"], "left")
    prev = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    secs = F.unix_timestamp(F.col("InvoiceDate").cast("timestamp")) - F.unix_timestamp(prev.cast("timestamp"))
    days = F.when(F.col("Vendor").isNotNull(), F.floor(secs / 86400))
    return (out.withColumn("DaysSinceLastInvoice", F.coalesce(days, F.lit(NO_PREVIOUS_DAYS)).cast("long"))
               .drop("_dnull", "_idn", "_part", "_prev", "_rn", "_carry"))

"""Scoring of invoices that arrive in batches (Structured Streaming, ``foreachBatch``).

Rules and scores of an invoice depend on its vendor's invoices only. The scored table
is partitioned by a hash of the vendor; a batch reads the partitions of the vendors it
touches, scores their old and new invoices together and replaces just those
partitions. Batches in any order give the table that one scoring of all rows gives.

A batch that runs again after a failure first drops the rows it has left behind, so
every batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

from tallyhawk.operators.risk import score_invoices
from tallyhawk.session import materialize, release_scratch, scratch_tables

BUCKETS = 256


def _written(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def score_batch(batch: DataFrame, batch_id: int, path: str, buckets: int = BUCKETS) -> None:
    """Add the invoices of one batch to the scored table under ``path``.

    ``batch`` has the invoice columns, the same in every batch (InvoiceID included). An empty batch changes nothing.
    ``buckets`` must not change during the life of a table."""
    spark = batch.sparkSession
    held = scratch_tables(spark)
    columns = batch.columns
    place = F.pmod(F.xxhash64("Vendor"), F.lit(buckets)).cast("int")
    fresh = materialize(batch.withColumns({"batch_id": F.lit(batch_id).cast("long"), "vendor_bucket": place}), "stream-batch")
    touched = [r[0] for r in fresh.select("vendor_bucket").distinct().collect()]      # ``buckets`` values at most
    if touched:
        rows = fresh
        if _written(spark, path):
            schema = StructType([*batch.schema.fields]).add("batch_id", LongType()).add("vendor_bucket", IntegerType())
            old = spark.read.schema(schema).parquet(path).where(F.col("vendor_bucket").isin(touched) & (F.col("batch_id") != batch_id))
            rows = old.select(*columns, "batch_id", "vendor_bucket").unionByName(fresh)
        # written apart before the partitions it was read from are replaced
        scored = materialize(score_invoices(rows), "stream-scored")
        (scored.repartition("vendor_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("vendor_bucket").parquet(path))
    release_scratch(spark, [p for p in scratch_tables(spark) if p not in held])


def scored_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The scored invoices of all batches so far."""
    return spark.read.parquet(path).drop("batch_id", "vendor_bucket")


def score_stream(invoices: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, once: bool = False) -> StreamingQuery:
    """Start scoring a stream of invoices (``spark.readStream``...). ``once`` handles what is there and ends."""
    writer = invoices.writeStream.foreachBatch(lambda df, i: score_batch(df, i, path, buckets)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Contiguous 0-based positions over a total order, computed without a
single-partition window.

Plan: range-partition on the order (an explicit partition count, so AQE keeps
the partitioning as is), sort within partitions, tag every row with its
partition and local position, count rows per partition (one small row per
partition), prefix-sum those counts and broadcast them back. No task ever
holds more than its range.

The tagged table is frozen as a written table under the shared
``spark.checkpoint.dir`` before it is read twice: range bounds come from a
sample of the input, and two independently planned copies of the input could
sample different bounds. Writing it also cuts the lineage, so a lost
executor re-reads the written table instead of recomputing the positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.session import materialize

_LOCAL_MASK = (1 << 33) - 1


def with_ordinal(df: DataFrame, order_cols: list, name: str = "ordinal",
                 partitions: int | None = None) -> DataFrame:
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *order_cols)
                .sortWithinPartitions(*order_cols)
                .withColumn("_part", F.spark_partition_id())
                .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_MASK))))
    ranged = materialize(ranged, "ordinal")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # at most `n` rows: one per partition, so a global window here is bounded
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_part")
                  .withColumn(name, F.col("_off") + F.col("_local"))
                  .drop("_part", "_local", "_off"))

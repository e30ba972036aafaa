"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.session import materialize, ship_package

#: A word: a maximal run of anything but space, tab, line feed, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows up to which a counted table may be broadcast (a few MB of narrow rows).
BROADCAST_ROWS = 50_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also makes the package importable on workers."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows it is small, else as it is
    (a shuffle join). ``df`` should be a written table: it is counted here."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def at_least(spark: SparkSession, amount: float, per_partition: float) -> int:
    """Shuffle partitions for ``amount`` of work: the session's number or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               math.ceil(amount / per_partition))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (id, component = smallest id).

    Alternating large-star and small-star rounds; every round is two
    aggregations with map-side combining and two joins, written as a table so
    that lineage stays short. It ends when the edges are stars: every id has
    one edge down, to an id that has none. Only ids that have an edge are returned."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges")
    for round_ in range(max_rounds + 1):
        down = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        centre = e.select(F.col("v").alias("u")).distinct().withColumn("centre", F.lit(True))
        if not down.join(centre, "u", "left").where("n > 1 or centre").limit(1).count():
            break
        if round_ == max_rounds:
            raise RuntimeError(f"components are not found after {max_rounds} rounds")
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: neighbours above u move to the smallest of u's neighbourhood
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its neighbours below u move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small, "edges")
    roots = e.select(F.col("v").alias("id")).distinct()
    return (e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
            .union(roots.join(e.select(F.col("u").alias("id")), "id", "left_anti")
                   .select("id", F.col("id").alias("component"))))

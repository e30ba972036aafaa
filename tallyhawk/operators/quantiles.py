"""Exact order statistics per group, without sending a group to one task.

Plan: a mergeable quantile sketch per group gives a narrow bracket of values around
the wanted ranks; a second pass counts the rows below the bracket and the distinct
values inside it (map-side combine), so the shuffle holds bracket rows only.
Those are range-partitioned on (group, value) with an explicit partition count and
given running counts inside each range plus per-range offsets (a table of at most
partitions x groups rows); the values whose rank interval covers the wanted ranks are
picked. Counts are exact whatever the sketch says: a rank outside its bracket is
noticed, and those groups are done again without one. A hot group is spread over
many ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.functions.joins import bounded_broadcast
from tallyhawk.session import materialize

#: Rank error of the sketch is at most 1 / ACCURACY of a group's rows.
ACCURACY = 1000


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    if not keys:
        return left.crossJoin(F.broadcast(right))  # right is one row
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(names)
    cond = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    return left.join(right, cond, how).drop(*names.values())


def _counted(df: DataFrame, group_cols: list[str], value: str, q: float | None, accuracy: int) -> DataFrame:
    """(group, value, _c, _n): distinct values with their counts and the group's size. With ``q`` only
    values in a bracket around that quantile, after one null value that stands for all rows below."""
    given = df.where(F.col(value).isNotNull()).select(*group_cols, F.col(value).alias("_v"))
    if q is None:
        vc = given.groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c"))
        return vc.withColumn("_n", F.lit(None).cast("long"))
    ends = [max(0.0, q - 2.0 / accuracy), min(1.0, q + 2.0 / accuracy)]
    sketch = given.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_e"))
    sketch = materialize(sketch.select(*group_cols, "_n", F.col("_e")[0].alias("_lo"), F.col("_e")[1].alias("_hi")), "quantile-sketch")
    inside = _null_safe_join(given, bounded_broadcast(sketch) if group_cols else sketch, group_cols).where(F.col("_v") <= F.col("_hi"))
    return (inside.withColumn("_v", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
            .groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n")))


def order_statistics(df: DataFrame, group_cols: list[str], value: str,
                     ranks: dict[str, Callable[[Column], Column]],
                     partitions: int | None = None, near: float | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group: ``_n`` (non-null values) and, for every name in
    ``ranks``, the value at 0-based rank ``ranks[name](_n)`` in ascending order.

    ``near`` is the quantile that all the ranks lie at, if there is one: then only values near it are
    shuffled. The result is a written table of one row per group."""
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vc = _counted(df, group_cols, value, near, accuracy)
    # written once: both passes below must see the same ranges
    ranged = materialize(vc.repartitionByRange(p, *group_cols, F.col("_v").asc_nulls_first())
                         .withColumn("_part", F.spark_partition_id()), "order-statistics")
    w_in = (Window.partitionBy("_part", *group_cols).orderBy(F.col("_v").asc_nulls_first())
                  .rowsBetween(Window.unboundedPreceding, -1))
    ranged = ranged.withColumn("_before", F.coalesce(F.sum("_c").over(w_in), F.lit(0)))
    part_tot = ranged.groupBy("_part", *group_cols).agg(F.sum("_c").alias("_pt"), F.max("_n").alias("_all"))
    w_off = (Window.partitionBy(*group_cols).orderBy("_part")
                   .rowsBetween(Window.unboundedPreceding, -1))
    w_all = Window.partitionBy(*group_cols)
    offs = part_tot.select("_part", *group_cols,
                           F.coalesce(F.sum("_pt").over(w_off), F.lit(0)).alias("_off"),
                           F.coalesce(F.max("_all").over(w_all), F.sum("_pt").over(w_all)).alias("_size"))
    cum = _null_safe_join(ranged.drop("_n"), offs, ["_part", *group_cols])
    lo = F.col("_off") + F.col("_before")
    hi = lo + F.col("_c")
    picks = []
    for name, rank_fn in ranks.items():
        k = rank_fn(F.col("_size"))
        picks.append(F.max(F.when((lo <= k) & (k < hi), F.col("_v"))).alias(name))
    found = materialize(cum.groupBy(*group_cols).agg(F.max("_size").alias("_n"), *picks), "order-picks")
    if near is None:
        return found
    missed = found.where(" or ".join(f"`{name}` is null" for name in ranks))
    if not missed.limit(1).count():
        return found
    if not group_cols:
        return order_statistics(df, group_cols, value, ranks, partitions)
    again = _null_safe_join(df, missed.select(*group_cols), group_cols, "left_semi")
    kept = found.where(" and ".join(f"`{name}` is not null" for name in ranks))
    return kept.union(order_statistics(again, group_cols, value, ranks, partitions).select(*kept.columns))


def group_median(df: DataFrame, group_cols: list[str], value: str,
                 name: str = "median") -> DataFrame:
    """Exact median: mean of the two middle values (one value when odd)."""
    st = order_statistics(df, group_cols, value, {
        "_m1": lambda n: F.floor((n - 1) / 2),
        "_m2": lambda n: F.floor(n / 2),
    }, near=0.5)
    return st.select(*group_cols, ((F.col("_m1") + F.col("_m2")) / 2).alias(name))


def exact_quantile(df: DataFrame, value: str, q: float,
                   group_cols: list[str] | None = None, name: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile: position q*(n-1), lo + frac*(hi-lo)."""
    group_cols = group_cols or []
    pos = lambda n: (n - 1) * F.lit(float(q))
    st = order_statistics(df, group_cols, value, {
        "_lo": lambda n: F.floor(pos(n)),
        "_hi": lambda n: F.ceil(pos(n)),
    }, near=float(q))
    frac = pos(F.col("_n")) - F.floor(pos(F.col("_n")))
    return st.select(*group_cols, F.col("_n"),
                     (F.col("_lo") + frac * (F.col("_hi") - F.col("_lo"))).alias(name))

"""Exact duplicates by content sort.

Texts are normalised (A-Z lower-cased), range-partitioned by sampled splitters
on their first bytes and digest, and sorted externally by full content, which
puts equal texts next to each other. Each row is compared in full with its
neighbour; a run of equals keeps one row.

A first pass over 8-byte hashes finds texts with very many copies. There are
at most ``HOT_GROUPS`` of them at any input size (a group is hot when it holds
more than that part of all rows), so the list may be broadcast; the copies of
a hot text are split by id over several ranges. The representatives of those
pieces, one text for each piece, are then compared in full with one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.llm.common import at_least, lower_ascii
from tallyhawk.session import materialize

HOT_GROUPS = 10_000
#: Copies below which a group is never split.
HOT_ROWS = 500
#: Bytes of the normalised text that lead the range key; the digest follows.
LEAD = 24
#: A range holds about this many rows or bytes of text, whichever is less.
ROWS_PER_RANGE = 20_000
BYTES_PER_RANGE = 24_000_000


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                 hot_rows: int = HOT_ROWS, rows_per_range: int = ROWS_PER_RANGE, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256; with
    ``carry`` also ``row``, a struct of all input columns.

    ``keep`` is "largest" or "smallest" id. Null texts count as empty, and empty
    texts equal one another. Of equal texts with equal ids, one row is kept; a
    null id ranks below all others. An empty table gives an empty result. Very long
    texts are compared whole; ranges are sized by bytes too, so that they hold few of them.
    Other columns of ``docs`` cannot clash: they travel inside ``row``."""
    spark = docs.sparkSession
    payload = F.struct(*[docs[c] for c in docs.columns]) if carry else F.struct(docs[text_col])
    rows = docs.select(docs[id_col].alias("doc_id"), payload.alias("row"))
    norm = lower_ascii(F.coalesce(F.col(f"row.`{text_col}`"), F.lit("")))
    keyed = rows.withColumn("h", F.xxhash64(norm))

    counts = materialize(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(norm).cast("long")).alias("size")), "copies")
    total, size = (x or 0 for x in counts.agg(F.sum("n"), F.sum("size")).first())
    limit = max(hot_rows, total // HOT_GROUPS)
    hot = counts.where(F.col("n") > limit).withColumn("pieces", F.ceil(F.col("n") / limit)).select("h", "pieces")

    salted = (keyed.join(F.broadcast(hot), "h", "left")   # at most HOT_GROUPS rows
              .withColumn("salt", F.when(F.col("pieces").isNull(), 0)
                          .otherwise(F.pmod(F.xxhash64("doc_id", F.lit(7)), "pieces")))
              .withColumn("lead", F.substring(F.encode(norm, "UTF-8"), 1, LEAD)))
    parts = max(at_least(spark, total, rows_per_range), at_least(spark, size, BYTES_PER_RANGE))
    ranged = (salted.repartitionByRange(parts, "lead", "h", "salt")
              .withColumn("norm", norm).withColumn("text_sha256", F.sha2("norm", 256)))
    piece = Window.partitionBy("lead", "h", "salt").orderBy("norm", "doc_id")
    compared = (ranged.withColumn("fresh", F.coalesce(F.col("norm") != F.lag("norm").over(piece), F.lit(True)))
                .withColumn("run", F.sum(F.col("fresh").cast("int"))
                            .over(piece.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("lead_text", F.when(F.col("fresh") & F.col("pieces").isNotNull(), F.col("norm")))
                .select("doc_id", "h", "lead", "salt", "run", "text_sha256", "lead_text",
                        F.col("pieces").isNotNull().alias("hot"), *(["row"] if carry else [])))
    # the range partitioning already holds each run in one task: no further shuffle
    first = F.col("doc_id").desc_nulls_last() if keep == "largest" else F.col("doc_id").asc_nulls_last()
    run = Window.partitionBy("lead", "h", "salt", "run").orderBy(first)
    whole_run = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sorted_runs = materialize(compared.withColumn("nth", F.row_number().over(run))
                              .withColumn("best", F.first("doc_id").over(whole_run))
                              .withColumn("n", F.count(F.lit(1)).over(whole_run)).drop("lead"), "content-runs")

    # a hot text has one run in each of its pieces: compare their texts, merge their ends.
    # A hot group has at most n / limit + 1 pieces, all hot groups together at most
    # 2 * HOT_GROUPS, so the merged table may be broadcast.
    best = F.max if keep == "largest" else F.min
    beside = Window.partitionBy("h").orderBy("norm", "salt")
    pieces = (sorted_runs.where("hot and lead_text is not null")
              .select("h", "salt", "run", "best", "n", F.col("lead_text").alias("norm"))
              .withColumn("differs", F.coalesce(F.col("norm") != F.lag("norm").over(beside), F.lit(True)))
              .withColumn("text_no", F.sum(F.col("differs").cast("int"))
                          .over(beside.rowsBetween(Window.unboundedPreceding, 0))))
    same_text = Window.partitionBy("h", "text_no")
    merged = pieces.select("h", "salt", "run", best("best").over(same_text).alias("all_best"),
                           F.sum("n").over(same_text).alias("all_n"))
    return (sorted_runs.join(F.broadcast(merged), ["h", "salt", "run"], "left")
            .withColumn("keep_id", F.when(F.col("hot"), F.col("all_best")).otherwise(F.col("best")))
            .withColumn("group_size", F.when(F.col("hot"), F.col("all_n")).otherwise(F.col("n")))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1))
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *(["row"] if carry else [])))


def drop_copies(docs: DataFrame, **params) -> DataFrame:
    """``docs`` without exact copies, all columns unchanged."""
    found = exact_groups(docs, carry=True, **params).where("kept")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])

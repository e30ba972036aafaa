"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

Every document gets a random but repeatable key (an MD5 of its id). Inside a
source, documents are range-sorted by that key: the key space is cut into
equal ranges, as many as the source has rows to fill, so a source with a third
of all rows is spread over many tasks. Token counts are summed inside each
range and the range totals (a small table) are summed in order, which gives
every document its position in its source's queue without a global sort.
The budget of a source is its target in whole words: so many whole epochs,
then the first words of the queue up to the exact budget; the last document
reached is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.llm.common import n_words
from tallyhawk.session import materialize

#: Rows that one key range of a source holds on average.
RANGE_ROWS = 4096


def targets(totals: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Each source's share of the total, never above ``max_epochs`` times its size.

    ``totals`` has one row per source: rank (its order), weight, source_size.
    Water-filling in closed form: with sources in order of cap / weight, those
    that fill up are a prefix, and all others get weight times one level."""
    fill = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = Window.orderBy(fill, "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    t = (totals.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
         .withColumn("total", F.sum("source_size").over(everything))
         .withColumn("free", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("weights", F.sum("weight").over(rest))
         .withColumn("full", (F.col("weight") > 0)
                     & (F.col("cap") * F.col("weights") <= F.col("free") * F.col("weight")))
         .withColumn("level", F.when(~F.col("full") & F.coalesce(F.lag("full").over(order), F.lit(True)),
                                     F.try_divide(F.col("free").cast("double"), F.col("weights").cast("double"))))
         .withColumn("level", F.max("level").over(everything)))
    return t.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double"))
                        .otherwise(F.col("weight").cast("double") * F.coalesce("level", F.lit(0.0))))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: DataFrame | None = None, cycle: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3,
        range_rows: int = RANGE_ROWS, carry: bool = False) -> DataFrame:
    """Plan a mix of all ``docs``; one row per input row.

    Without ``weights`` (columns source, weight), sources in code-point order,
    null last, weigh ``cycle`` repeating. Returns doc_id, size, source_size,
    target, epochs (whole copies taken), cut (words of one more, partial copy),
    taken = epochs * size + cut; with ``carry`` also ``row``, a struct of all
    input columns.

    The table of sources is one row per mixture component, as a person would
    weigh it. Null texts and texts without words have size 0 and take 0. A null
    source is a source; a null id sorts by an empty key. Equal rows follow one
    another, so which of them is cut makes no difference. An empty table gives
    an empty plan; a source missing from ``weights`` gets weight 0. Other
    columns of ``docs`` are not looked at and cannot clash."""
    key = F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")))
    sized = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"),
                        n_words(docs[text_col]).alias("size"), key.alias("key"),
                        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []))
    if not carry:   # narrow rows: count the words of a text once
        sized = materialize(sized, "mix-sizes")
    totals = (sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
              .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    if weights is None:
        cycled = F.array(*[F.lit(w) for w in cycle])
        totals = totals.withColumn("weight", F.element_at(cycled, ((F.col("rank") - 1) % len(cycle) + 1).cast("int")))
    else:
        w = weights.select(weights["source"].alias("w_source"), weights["weight"].alias("weight"))
        totals = (totals.join(w, F.col("source").eqNullSafe(F.col("w_source")), "left")
                  .drop("w_source").fillna({"weight": 0}))
    goal = materialize(targets(totals, max_epochs).select("source", "rank", "source_size", "target", "n"), "mix-goal")
    placed = (sized.join(goal.select(F.col("source").alias("g_source"), "rank", "n"),
                         F.col("source").eqNullSafe(F.col("g_source")))
              .withColumn("ranges", F.ceil(F.col("n") / F.lit(range_rows)).cast("long"))
              .withColumn("range", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
                                                * F.col("ranges"), 32))
              .drop("source", "g_source", "n", "ranges"))
    per_range = placed.groupBy("rank", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select("rank", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = (Window.partitionBy("rank", "range").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    queued = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - F.col("epochs") * F.col("source_size") - F.col("start") - F.col("inside")
    return (queued.join(starts, ["rank", "range"])
            .join(goal.select("rank", "source_size", "target"), "rank")
            .withColumn("epochs", whole)
            .withColumn("cut", F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), left)))
            .select("doc_id", "size", "source_size", "target", "epochs", "cut",
                    (F.col("epochs") * F.col("size") + F.col("cut")).alias("taken"),
                    *(["row"] if carry else [])))


def first_words(text, k):
    """``text`` up to the end of its ``k``-th word, white space kept."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), k.cast("int")), "")


def mixed_documents(docs: DataFrame, *, text_col: str = "text", n_chars_col: str = "n_chars", **params) -> DataFrame:
    """The mix itself: every document as often as planned, the last one cut to its words."""
    planned = mix(docs, text_col=text_col, carry=True, **params)
    part = (F.col("cut") > 0) & (F.col("cut") < F.col("size"))
    whole = F.col("epochs") + F.when(F.col("cut") == F.col("size"), 1).otherwise(0)
    copies = F.concat(F.when((whole > 0) & (F.col("size") > 0), F.array_repeat(F.lit(False), whole.cast("int")))
                      .otherwise(F.array().cast("array<boolean>")),
                      F.when(part, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    rows = planned.withColumn("partial", F.explode(copies))
    text = F.when(F.col("partial"), first_words(F.col(f"row.`{text_col}`"), F.col("cut"))) \
            .otherwise(F.col(f"row.`{text_col}`"))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(text.alias(c))
        elif c == n_chars_col:
            out.append(F.when(F.col("partial"), F.char_length(text).cast(docs.schema[c].dataType))
                       .otherwise(F.col(f"row.`{c}`")).alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return rows.select(*out)

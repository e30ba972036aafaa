"""Chat formatting of reply trees.

Messages point to the message they answer. Iterative self-joins with doubling
steps find every message's depth and the score of its path from the root in
log2(depth) rounds; branches (leaves) are ranked by path score, and the chosen
ones are unrolled by the same doubling steps, downwards. Each chosen path is
one conversation in the template

    <|im_start|>role LF text <|im_end|> LF

Inside roles and texts every ``<`` followed by bars gets one bar more
(``<|`` becomes ``<||``), so no text can hold a control string, and removing
one bar restores it. In roles, backslash and line feed become ``\\\\`` and ``\\n``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.session import materialize

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\|+)", r"<$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\|*)\|", r"<$1")


def _role_out(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(c: Column) -> Column:
    # from left to right, each escape once: pieces end behind a backslash pair, outside which \\n is a line feed
    pieces = F.transform(F.split(c, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(pieces, "\\"))


def choose_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Root-to-leaf paths: (tree, leaf, rank, depth, node) for the best ``branches`` leaves of each tree.

    ``messages`` has tree, node, parent (null or unknown: a root) and score
    (null: 0); (tree, node) is unique and not null. A path's score is the sum
    of its messages' scores; ties go to the smaller leaf. Messages on a cycle
    have no root and lie on no path."""
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    state = (nodes.join(known, ["tree", "parent"], "left")
             .select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("anc"),
                     F.lit(0).cast("long").alias("depth"), F.col("score").cast("double").alias("total")))
    jumps = [materialize(state, "reply-jump")]
    limit = math.ceil(math.log2(max(2, jumps[0].count()))) + 1
    while len(jumps) <= limit and jumps[-1].where("anc is not null").limit(1).count():
        state, step = jumps[-1], 2 ** (len(jumps) - 1)
        up = state.select("tree", F.col("node").alias("anc"), F.col("anc").alias("anc2"),
                          F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        nxt = (state.where("anc is not null").join(up, ["tree", "anc"])
               .select("tree", "node", F.col("anc2").alias("anc"),
                       (F.col("depth") + F.lit(step) + F.when(F.col("anc2").isNull(), F.col("depth2"))
                        .otherwise(F.lit(0))).alias("depth"),
                       (F.col("total") + F.col("total2")).alias("total")))
        # ``depth`` of an unfinished message stays 0 until its root is reached
        nxt = nxt.withColumn("depth", F.when(F.col("anc").isNull(), F.col("depth")).otherwise(F.lit(0)))
        jumps.append(materialize(nxt.union(state.where("anc is null")), "reply-jump"))
    done = jumps[-1].where("anc is null")
    leaves = done.join(nodes.select("tree", F.col("parent").alias("node")).where("node is not null").distinct(),
                       ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy(F.col("total").desc(), "node")
    chosen = (leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
              .select("tree", F.col("node").alias("leaf"), "rank", "depth", "node"))
    chosen = materialize(chosen, "reply-leaves")
    # a tree whose only leaf is chosen is that path: no unrolling
    single = chosen.join(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).where("n = 1"), "tree") \
        .select("tree", "leaf", "rank")
    paths = done.join(single, "tree").select("tree", "leaf", "rank", "depth", "node")
    forked = chosen.join(single.select("tree"), "tree", "left_anti")
    if forked.limit(1).count():
        for k in range(len(jumps) - 2, -1, -1):
            hop = jumps[k].where("anc is not null").select("tree", "node", "anc")
            forked = materialize(forked.union(
                forked.join(hop, ["tree", "node"])
                .select("tree", "leaf", "rank", F.col("depth") - F.lit(2 ** k), F.col("anc"))), "reply-paths")
        paths = paths.union(forked)
    return paths


def format_paths(paths: DataFrame, messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per path: tree, leaf, rank, formatted text and loss_spans.

    ``loss_spans`` lists (start, length) in code points of the texts of
    ``loss_role`` inside ``formatted``, as escaped there."""
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"),
                           F.coalesce("text", F.lit("")).alias("text"))
    turn = (paths.join(said, ["tree", "node"])
            .withColumn("head", F.concat(F.lit(START), _role_out(F.col("role")), F.lit("\n")))
            .withColumn("body", escape(F.col("text")))
            .withColumn("size", F.char_length("head") + F.char_length("body") + F.lit(len(END))))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("at", (F.coalesce(F.sum("size").over(before), F.lit(0)) + F.char_length("head")).cast("int"))
    turns = (turn.groupBy("tree", "leaf", "rank")
             .agg(F.array_sort(F.collect_list(F.struct("depth", "head", "body", "at", "role"))).alias("turns")))
    spoken = F.filter("turns", lambda t: t["role"] == F.lit(loss_role))
    return turns.select(
        "tree", "leaf", "rank",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(spoken, lambda t: F.struct(t["at"].alias("start"), F.char_length(t["body"]).alias("length")))
         .alias("loss_spans"))


def chat_format(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """Format reply trees as conversations: tree, leaf, rank, formatted, loss_spans.

    ``messages``: tree, node, parent, role, text, score (see ``choose_paths``).
    Null roles and texts are empty. Texts may be of any length, but one path
    becomes one string. An empty table gives an empty result; other columns
    are not looked at."""
    kept = materialize(messages.select("tree", "node", "parent", "role", "text", "score"), "messages")
    return format_paths(choose_paths(kept, branches), kept, loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: adds ``turns`` (role, text) and ``loss_text``, unescaped."""
    parts = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda p: p != "")
    end = len(END)

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        skip = F.char_length(role) + 1
        return F.struct(_role_in(role).alias("role"),
                        unescape(F.substring(p, skip + 1, F.char_length(p) - skip - end)).alias("text"))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return (formatted.withColumn("turns", F.transform(parts, turn))
            .withColumn("loss_text", F.array_join(masked, "")))


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations (conv_id, turn, role, text): each turn answers the one before.

    The tree key is text, so that a null conv_id is a conversation of its own;
    repeated turns follow one another in order of role and text."""
    tree = F.when(F.col("conv_id").isNull(), "none").otherwise(F.concat(F.lit("id "), F.col("conv_id").cast("string")))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return (conversations.select("conv_id", "turn", "role", "text").withColumn("tree", tree)
            .withColumn("node", F.row_number().over(order).cast("long"))
            .select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                    "role", "text", F.lit(1.0).alias("score")))

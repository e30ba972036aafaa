"""Repair of conversations by iterative-deepening A*.

A repaired conversation's roles read ``(s?(ua)+)?`` by their initials: nothing,
or an optional system turn and then user and assistant turns in alternation. Four
edits lead there: Delete a row, Insert an empty turn, Keep a row, Rerole a
row to user or assistant. The search goes depth first in the order of the edits'
initials (D, I, K, R) under a cost bound that rises to the least cost seen
beyond it. States that failed stay in a table with the cost they are now known
to need, so no state is searched twice for the same remainder. Under the final
bound the first accepting path is the cheapest repair, of equal ones the least in
ASCII order.

Rows are range-partitioned by conversation and turn; a task streams over its
sorted range and repairs the conversations that lie whole in it. A conversation
that is cut by a range, or holds more than ``block`` rows, is searched block by
block: for each state a block may be entered in and each it may be left in, the
search gives the cheapest edits. Those costs (16 and 4 numbers for each block)
are chained over the blocks, which is exact: inserts stand before the next
row, so the edits of one block never begin those of another path through it.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import at_least
from tallyhawk.session import materialize

#: Costs of the edits; a truncated row that stays costs ``TRUNCATED`` more.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLOCK = 512
ROWS_PER_RANGE = 100_000
BLANKS = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 accept.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
END = -1                      # goal: an accepting state after the last row
NEVER = 1 << 60

_COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
BLOCKS = ("conv string, part int, nth long, whole boolean, rows long, blank long, duplicate long, truncated long, illegal long, "
          "turns long, low long, high long, head string, tail string, "
          "paths array<struct<entry:int,leave:int,cost:bigint,audit:string>>, roles array<string>, texts array<string>")


def _needed(new: str) -> str:
    """The role that a new or reroled turn takes in each state."""
    return "a" if new == 2 else "u"


class Search:
    """Cheapest edits of one block to one goal. ``rows`` are (initial, fault) pairs,
    a fault being "b", "d", "t" or "". Goal ``END`` allows turns after the last row."""

    def __init__(self, rows: list, goal: int):
        self.rows, self.goal, self.n = rows, goal, len(rows)
        self.floor = self._floor()
        self.last_system = max((i for i, (initial, fault) in enumerate(rows) if initial == "s" and fault in ("", "t")), default=-1)
        self.known: dict = {}                # failed state -> cost it is known to need at least

    def _floor(self) -> list:
        """What the rows from each place on cost at least.

        Faults cost by themselves. Of two rows that may stay and may not follow one another, one is
        deleted or reroled, or a turn goes between them; pairs that share no row add up."""
        faults, pairs, out = 0, [0, 0], [0] * (self.n + 1)   # pairs: from the next staying row on, and from the one after
        nearest = None
        for i in range(self.n - 1, -1, -1):
            initial, fault = self.rows[i]
            if fault in ("b", "d"):
                faults += DELETE
            else:
                faults += TRUNCATED if fault else 0
                here = pairs[0]
                if nearest is not None and initial + nearest[0] not in LEGAL:
                    # deleting a truncated row costs little more than keeping it
                    here = max(here, pairs[1] + (DELETE - TRUNCATED if fault or nearest[1] else min(INSERT, REROLE, DELETE)))
                pairs, nearest = [here, pairs[0]], (initial, fault)
            out[i] = faults + pairs[0]
        return out

    def _moves(self, state: tuple):
        """(initial, next state, cost) of the edits in a state, in ASCII order."""
        i, role, inserted = state
        stays = i < self.n and self.rows[i][1] not in ("b", "d")
        extra = TRUNCATED if stays and self.rows[i][1] else 0
        if i < self.n:
            yield "D", (i + 1, role, 0), DELETE
        if inserted < 3 and (i < self.n or self.goal == END):   # a fourth would come back to a state of this place
            yield "I", (i, STEP[role, _needed(role)], inserted + 1), INSERT
        if stays:
            kept = STEP.get((role, self.rows[i][0]))
            if kept is not None:
                yield "K", (i + 1, kept, 0), extra
            yield "R", (i + 1, STEP[role, _needed(role)], 0), REROLE + extra

    def _done(self, state: tuple) -> bool:
        return state[0] == self.n and (state[1] in ACCEPT if self.goal == END else state[1] == self.goal)

    def _need(self, state: tuple) -> int:
        i, role, _ = state
        if self.goal in (0, 1) and role > self.goal or self.goal == 1 and role == 0 and i > self.last_system:
            return NEVER                     # no edit leads back to the beginning
        return self.known.get(state, self.floor[i])

    def cheapest(self, entry: int):
        """(cost, edits) from a state before the first row, or None if the goal is out of reach."""
        start = (0, entry, 0)
        while (bound := self._need(start)) < NEVER:
            path = self._under(start, bound)
            if path is not None:
                return bound, path
        return None

    def _under(self, start: tuple, bound: int):
        """The first accepting path of at most ``bound``; without one, what the states need is raised."""
        if self._done(start):
            return ""
        frames = [[start, 0, self._moves(start), NEVER, ""]]   # state, spent, moves left, least need of the moves, edit
        while frames:
            state, spent, moves, _, _ = frame = frames[-1]
            for edit, after, cost in moves:
                if self._done(after) and spent + cost <= bound:
                    return "".join(f[4] for f in frames) + edit
                if spent + cost + self._need(after) <= bound and not self._done(after):
                    frames.append([after, spent + cost, self._moves(after), NEVER, edit])
                    break
                frame[3] = min(frame[3], cost + (0 if self._done(after) else self._need(after)))
            else:
                self.known[state] = frame[3]
                frames.pop()
                if frames:           # the move that led here needs what was found now
                    above = frames[-1]
                    above[3] = min(above[3], spent - above[1] + frame[3])
        return None


def _summary(rows: list) -> dict:
    """Counts of one block of (turn, role, text, fault)."""
    initials = [r[1][:1] for r in rows]
    faults = [r[3] for r in rows]
    turns = [r[0] for r in rows if r[0] is not None]
    return {"rows": len(rows), "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
            "head": initials[0], "tail": initials[-1]}


def _block(conv, part: int, nth: int, rows: list, whole: bool) -> dict:
    pairs = [(r[1][:1], r[3]) for r in rows]
    paths = []
    for goal in (END,) if whole else (END, 0, 1, 2, 3):
        search = Search(pairs, goal)
        for entry in (0,) if whole else range(4):
            got = search.cheapest(entry)
            if got is not None:
                paths.append({"entry": entry, "leave": goal, "cost": got[0], "audit": got[1]})
    return {"conv": conv, "part": part, "nth": nth, "whole": whole, **_summary(rows), "paths": paths,
            "roles": [r[1] for r in rows], "texts": [r[2] for r in rows]}


def _blocks(batches, block: int, schema: pa.Schema):
    """Blocks of the sorted rows of one range. Its first and last conversation may go on in other ranges."""
    out, rows, conv, nth, cut, part = [], [], None, 0, True, None

    def close(more: bool):
        nonlocal rows, nth, cut
        if rows:
            out.append(_block(conv, part, nth, rows, whole=not cut and not more))
            nth += 1
        rows, cut = [], more

    for batch in batches:
        for x in batch.to_pylist():
            if part is None:
                part, conv = x["part"], x["conv"]
            if x["conv"] != conv:
                close(False)
                conv = x["conv"]
            for copy in range(x["copies"]):
                if len(rows) == block:
                    close(True)
                rows.append((x["turn"], x["role"], x["text"], "d" if copy and x["fault"] != "b" else x["fault"]))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()
    cut = True
    close(True)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The way through the blocks of one conversation, and its counts."""
    pdf = pdf.sort_values(["part", "nth"]).reset_index(drop=True)
    n, ahead = len(pdf), []
    edges = [[(p["entry"], p["leave"], p["cost"], p["rank"]) for p in paths] for paths in pdf["paths"]]
    need = {}
    for k in range(n - 1, -1, -1):          # cheapest way to the end from each state before a block
        here = {}
        for entry, leave, cost, _ in edges[k]:
            if (leave == END) == (k == n - 1):
                total = cost + (0 if leave == END else need.get(leave, NEVER))
                here[entry] = min(total, here.get(entry, NEVER))
        ahead.append(need)
        need = here
    ahead.reverse()
    state, chosen, cost = 0, [], need[0]
    left = cost
    for k in range(n):
        _, leave, spent = min((rank, leave, c) for entry, leave, c, rank in edges[k] if entry == state
                              and (leave == END) == (k == n - 1) and c + (0 if leave == END else ahead[k].get(leave, NEVER)) == left)
        chosen.append((state, leave))
        state, left = leave, left - spent
    seams = list(zip(pdf.itertuples(), pdf.iloc[1:].itertuples()))
    last = None
    shared = 0
    for row in pdf.itertuples():            # a turn may lie on both sides of a seam
        if row.turns:
            shared += last is not None and last == row.low
            last = row.high
    first = pdf.index == 0
    lows, highs = pdf["low"].dropna(), pdf["high"].dropna()
    return pd.DataFrame({
        "part": pdf["part"], "nth": pdf["nth"], "entry": [c[0] for c in chosen], "leave": [c[1] for c in chosen], "lead": first,
        "c_cost": cost, "c_blank": pdf["blank"].sum(), "c_duplicate": pdf["duplicate"].sum(), "c_truncated": pdf["truncated"].sum(),
        "c_illegal": pdf["illegal"].sum() + sum(a.tail + b.head not in LEGAL for a, b in seams),
        "c_gaps": int(highs.max()) - int(lows.min()) + 1 - (pdf["turns"].sum() - shared) if len(lows) else 0})


def _edited(batches, schema: pa.Schema):
    """Turns of the repaired blocks."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            i, state, turns = 0, x["entry"], []
            for edit in x["audit"]:
                if edit == "I":
                    role, text = NAMES[_needed(state)], ""
                else:
                    role = NAMES[_needed(state)] if edit == "R" else x["roles"][i]
                    text = x["texts"][i]
                    i += 1
                if edit != "D":
                    state = STEP[state, role[:1]]
                    turns.append({"edit": edit, "role": role, "text": text})
            out.append({**{k: x[k] for k in schema.names if k != "messages"}, "messages": turns})
        yield pa.RecordBatch.from_pylist(out, schema)


def marked_rows(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies and fault of the distinct rows of conversations.

    A fault is "b" (blank), "d" (role and text seen in an earlier turn), "t" (truncated) or
    empty. Equal rows are one row with its number of copies."""
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    distinct = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"))
    first = (distinct.groupBy("conv", "role", "text").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(*[F.col(c).alias(f"f_{c}") for c in ("conv", "role", "text")], "first"))
    same = (F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("text") == F.col("f_text")))
    joined = distinct.join(first, same, "left")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(end == "", "b").when(F.col("first").isNotNull() & (when > F.col("first")), "d")
             .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise(""))
    return joined.select("conv", "turn", "role", "text", "copies", fault.alias("fault"))


def repair(conversations: DataFrame, *, block: int = BLOCK, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row for each conversation of ``conversations`` (conv_id, turn, role, text):
    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and messages, an array of
    (edit, role, text) of the repaired turns.

    Rows are taken by turn, nulls first; rows of one turn by role and text. A null id is a
    conversation of its own; a null role or text is one space, a role whose initial is
    none of s, u, a (an empty one too) must be reroled or deleted. Equal rows are copies of
    one another, all but the first are duplicates. Turns without a number do not count for
    gaps. Very long texts are carried whole, but a repaired conversation must fit a row. An
    empty table gives an empty result; other columns are not looked at."""
    spark = conversations.sparkSession
    marked = materialize(marked_rows(conversations), "turns")
    parts = at_least(spark, marked.count(), rows_per_range)
    order = ["conv", "turn", "role"]
    ranged = (marked.repartitionByRange(parts, *order, F.substring("text", 1, 24)).sortWithinPartitions(*order, "text")
              .withColumn("part", F.spark_partition_id()))
    blocks = spark.createDataFrame([], BLOCKS)
    wide = _arrow(blocks)
    blocks = materialize(ranged.mapInArrow(lambda batches: _blocks(batches, block, wide), BLOCKS), "turn-blocks")

    counts = ["blank", "duplicate", "truncated", "illegal"]
    whole = blocks.where("whole").select(
        "conv", "part", "nth", F.lit(0).alias("entry"), F.col("paths")[0]["audit"].alias("audit"), F.lit(True).alias("lead"),
        F.col("paths")[0]["cost"].alias("c_cost"), *[F.col(c).alias(f"c_{c}") for c in counts],
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("c_gaps"), "roles", "texts")
    # of the paths from one state into one block, the rank by edits; the edits themselves stay behind
    ranked = F.transform("paths", lambda p: F.struct(
        p["entry"].alias("entry"), p["leave"].alias("leave"), p["cost"].alias("cost"),
        F.size(F.filter("paths", lambda q: (q["entry"] == p["entry"]) & (q["audit"] < p["audit"]))).alias("rank")))
    chained = (blocks.where("not whole").drop("roles", "texts").withColumn("paths", ranked).groupBy("conv").applyInPandas(
        _chain, "part int, nth long, entry int, leave int, lead boolean, c_cost long, c_blank long, c_duplicate long, "
        "c_truncated long, c_illegal long, c_gaps long"))
    taken = F.filter("paths", lambda p: (p["entry"] == F.col("entry")) & (p["leave"] == F.col("leave")))[0]["audit"]
    cut = (blocks.where("not whole").select("conv", "part", "nth", "paths", "roles", "texts").join(chained, ["part", "nth"])
           .select("conv", "part", "nth", "entry", taken.alias("audit"), "lead", "c_cost", *[f"c_{c}" for c in counts], "c_gaps", "roles", "texts"))
    schema = ("conv string, part int, nth long, audit string, lead boolean, c_cost long, c_blank long, c_duplicate long, c_truncated long, "
              "c_illegal long, c_gaps long, messages array<struct<edit:string,role:string,text:string>>")
    narrow = _arrow(spark.createDataFrame([], schema))
    run = lambda batches: _edited(batches, narrow)
    names = ["gaps", *counts, "cost"]
    alone = whole.mapInArrow(run, schema).select("conv", *[F.col(f"c_{c}").alias(c) for c in names], "audit", "messages")
    pieces = cut.mapInArrow(run, schema).groupBy("conv").agg(
        *[F.max(F.when(F.col("lead"), F.col(f"c_{c}"))).alias(c) for c in names],
        F.sort_array(F.collect_list(F.struct("part", "nth", "audit", "messages"))).alias("blocks"))
    pieces = pieces.select("conv", *names, F.array_join(F.col("blocks.audit"), "").alias("audit"), F.flatten("blocks.messages").alias("messages"))
    return alone.union(pieces).withColumn("conv", F.col("conv").cast(conversations.schema["conv_id"].dataType)).withColumnRenamed("conv", "conv_id")


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.schema)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the hash of ``conv_id:turn``: 0 drops the row, 1 empties its text, 2 removes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user. Nulls become a space in the hash, in roles and in texts."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def repair_report(repaired: DataFrame, every: DataFrame) -> DataFrame:
    """One row for each id of ``every``: the counts, cost and edits of ``repair`` and a digest of the repaired
    turns; conversations without rows have zeros and empty strings."""
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    got = repaired.select(F.col("conv_id").alias("r_id"), *names, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    ids = every.select("conv_id").distinct()
    return ids.join(got, F.col("conv_id").eqNullSafe(F.col("r_id")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))

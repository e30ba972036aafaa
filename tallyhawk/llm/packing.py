"""Mixture-controlled packing of documents into fixed windows of tokens.

1. Texts become token ids, one written table (ids as binary, lineage cut).
2. With target weights the stream of tokens has phases: all sources that still
   hold tokens are drawn by weight until the first of them is used up, then the
   others go on, and so on; sources without a weight come last. A document lies
   in its source at a place given by a hash of its content, which gives its
   phase and its place there. Without weights the corpus's own mix is the target
   and there is one phase. Phases are cut to lanes of about ``lane_tokens`` tokens.
   Per lane and source a few counts are summed; prefix sums over the lanes give
   each lane its first position in the one stream of tokens and the deficit
   (target minus taken) of each source that the lanes before hand on.
3. Each lane is one group: deficit round-robin over its source queues. In every
   window each source earns its quantum, a share of the window's room; it is
   served what it has earned in whole tokens, and the rest stays as its
   deficit for the next window. Quanta are the shares of what a lane still
   holds, so no queue runs dry early and every window keeps the lane's mix.
   Deficits from other lanes are paid over as many windows as they need, at a rate of
   at most one more quantum a window, so that a window keeps near its mix.
   Windows lie at fixed positions of the whole stream, so the last window of a
   lane is filled by the next lane: only the last window of all is not full.

Which window a token lies in hangs on ids and texts alone, not on how rows were partitioned.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.llm.common import small_side
from tallyhawk.llm.tokens import encoder
from tallyhawk.session import materialize

WINDOW = 2048
LANE_TOKENS = 2_000_000
#: Lanes whose totals are summed in one task (two levels of prefix sums).
LANE_BLOCK = 1024
#: Texts that are encoded at a time.
ENCODE_ROWS = 1000

PIECES = ("doc_id long, no_id boolean, source string, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
_ROW = ["doc_id", "no_id", "source", "digest"]


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int, id_col="doc_id", source_col="source",
             text_col="text") -> DataFrame:
    """doc_id (0 and no_id if null), source, digest of the ids, n tokens, ids; the end id included."""
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches):
        enc = encoder(tokenizer_path)
        for pdf in (b.iloc[at:at + ENCODE_ROWS] for b in batches for at in range(0, len(b), ENCODE_ROWS)):
            ids = [enc.ids(t or "") + end for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "source": pdf["source"],
                                "digest": [hashlib.blake2b(x, digest_size=16).digest() for x in ids],
                                "n": [len(x) // 2 for x in ids], "ids": ids})
    picked = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(0).cast("long")).alias("doc_id"),
                         docs[id_col].isNull().alias("no_id"), docs[source_col].cast("string").alias("source"),
                         docs[text_col].alias("text"))
    return picked.mapInPandas(run, "doc_id long, no_id boolean, source string, digest binary, n long, ids binary")


def _numbered(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``nth``, the number of a row among rows that are equal in all columns.

    Equal rows are one row with a count inside tasks and in the shuffle, and are dealt out from there."""
    again = tokens.groupBy(*_ROW).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = materialize(again.withColumnsRenamed({c: f"a_{c}" for c in _ROW}), "packing-copies")
    if not again.limit(1).count():
        return tokens.withColumn("nth", F.lit(0).cast("long"))
    same = F.col("source").eqNullSafe(F.col("a_source"))
    for c in ("doc_id", "no_id", "digest"):
        same = same & (F.col(c) == F.col(f"a_{c}"))
    found = tokens.join(small_side(again), same, "left").drop(*[f"a_{c}" for c in _ROW])
    once = found.where("copies is null").select(*tokens.columns, F.lit(0).cast("long").alias("nth"))
    more = found.where("copies is not null").groupBy(*_ROW).agg(*[F.first(c).alias(c) for c in ("n", "ids", "copies")])
    return once.union(more.select(*tokens.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("nth")))


def phases(held: dict[str, int], weights: dict[str, float]) -> list[dict]:
    """The phases of a stream that draws sources by weight until each is used up.

    ``held`` has the tokens of the weighted sources. Each phase: low and high (tokens drawn for each unit of
    weight), share (source → part of the phase) and tokens."""
    level = {s: n / weights[s] for s, n in held.items() if n and weights[s] > 0}
    out, low = [], 0.0
    for high in sorted(set(level.values())):
        open_ = [s for s in level if level[s] > low]
        weight = sum(weights[s] for s in open_)
        out.append({"low": low, "high": high, "share": {s: weights[s] / weight for s in open_}, "tokens": (high - low) * weight})
        low = high
    return out


def _phase_of(tokens: DataFrame, weights: dict[str, float] | None) -> tuple[DataFrame, list[dict]]:
    """``tokens`` with phase and place (0 to 1, inside the phase); the weighted phases."""
    at = ((F.pmod(F.xxhash64("doc_id", "no_id", "digest", "nth"), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias("place")
    rows = tokens.select("*", at)
    if not weights:
        return rows.withColumn("phase", F.lit(0)), []
    totals = tokens.where(F.col("source").isin(*weights)).groupBy("source").agg(F.sum("n").alias("n")).collect()   # of the weighted sources
    steps = phases({r["source"]: r["n"] for r in totals}, weights)
    level = {r["source"]: r["n"] / weights[r["source"]] for r in totals if weights[r["source"]] > 0}
    if not steps:
        return rows.withColumn("phase", F.lit(0)), []
    own = F.create_map(*[F.lit(x) for item in level.items() for x in item])[F.col("source")]
    rows = rows.withColumn("drawn", F.col("place") * own)
    ends = F.array(*[F.lit(p["high"]) for p in steps])
    rows = rows.withColumn("phase", F.when(F.col("drawn").isNull(), len(steps)).otherwise(
        F.least(F.size(F.filter(ends, lambda h: h <= F.col("drawn"))), F.lit(len(steps) - 1))))
    low = F.element_at(F.array(*[F.lit(p["low"]) for p in steps], F.lit(0.0)), F.col("phase") + 1)
    wide = F.element_at(F.array(*[F.lit(p["high"] - p["low"]) for p in steps], F.lit(1.0)), F.col("phase") + 1)
    return rows.withColumn("place", F.when(F.col("drawn").isNull(), F.col("place")).otherwise((F.col("drawn") - low) / wide)).drop("drawn"), steps


def _lanes(tokens: DataFrame, lane_tokens: int, weights: dict[str, float] | None) -> tuple[DataFrame, DataFrame]:
    """Tokens with their lane, and one row per lane and source: held, lane_start, carried deficit."""
    spark = tokens.sparkSession
    placed, steps = _phase_of(tokens, weights)
    sizes = {r["phase"]: r["n"] for r in placed.groupBy("phase").agg(F.sum("n").alias("n")).collect()}   # one row per phase
    counts = [max(1, -(-sizes.get(p, 0) // lane_tokens)) for p in range(len(steps) + 1)]
    firsts = np.cumsum([0, *counts])[:-1].tolist()
    per, first = (F.element_at(F.array(*[F.lit(int(x)) for x in xs]), F.col("phase") + 1) for xs in (counts, firsts))
    lane = first + F.least(F.floor(F.col("place") * per).cast("long"), per - 1)
    dealt = placed.withColumn("lane", lane.cast("long")).drop("phase", "place")
    of_phase = spark.createDataFrame([(int(f), int(f + c - 1), p) for p, (f, c) in enumerate(zip(firsts, counts))], "f long, l long, phase int")
    held = materialize(placed.withColumn("lane", lane.cast("long")).groupBy("phase", "lane", "source").agg(F.sum("n").alias("held")), "lane-counts")

    # what the target gives a source up to the start of a phase, and its share from there on; the
    # phase of unweighted sources (or the only one) has the mix it holds
    begun, given, share_rows = 0, {}, []
    for p, step in enumerate(steps):
        for s in sorted(set(given) | set(step["share"])):
            share_rows.append((p, s, float(given.get(s, 0.0)), float(step["share"].get(s, 0.0)), begun))
        for s, x in step["share"].items():
            given[s] = given.get(s, 0.0) + x * sizes.get(p, 0)
        begun += sizes.get(p, 0)
    last = held.where(F.col("phase") == len(steps)).groupBy("source").agg(F.sum("held").alias("own"))
    last = last.select(F.lit(len(steps)).alias("phase"), "source", F.lit(0.0).alias("given"),
                       (F.col("own") / F.lit(max(sizes.get(len(steps), 0), 1))).alias("share"), F.lit(begun).cast("long").alias("begun"))
    share = spark.createDataFrame(share_rows, "phase int, source string, given double, share double, begun long").union(last)

    block = F.floor(F.col("lane") / LANE_BLOCK)

    def before(df, value, keys, name):
        """Sum of ``value`` over earlier lanes inside ``keys``, by blocks of lanes."""
        df = df.withColumn("block", block)
        inner = Window.partitionBy(*keys, "block").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
        outer = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = df.groupBy(*keys, "block").agg(F.sum(value).alias("sum"))
        blocks = blocks.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("block").alias("b_block"),
                               F.coalesce(F.sum("sum").over(outer), F.lit(0)).alias("past"))
        match = F.col("block") == F.col("b_block")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"b_{k}"))
        return (df.withColumn("near", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(blocks, match)
                .withColumn(name, F.col("near") + F.col("past"))
                .drop("near", "past", "block", "b_block", *[f"b_{k}" for k in keys]))
    lane_sums = held.groupBy("lane").agg(F.sum("held").alias("lane_held"))
    starts = before(lane_sums, "lane_held", [], "lane_start").select("lane", "lane_start")
    taken = before(held, "held", ["source"], "taken")   # of lanes that hold the source
    share = share.withColumnsRenamed({"source": "s_source", "phase": "s_phase"})
    plan = (taken.join(starts, "lane")
            .join(share, (F.col("phase") == F.col("s_phase")) & F.col("source").eqNullSafe(F.col("s_source")))
            .select("lane", "source", "held", "lane_start",
                    (F.col("given") + F.col("share") * (F.col("lane_start") - F.col("begun")) - F.col("taken")).alias("deficit")))
    return dealt, plan


def round_robin(held: np.ndarray, deficit: np.ndarray, first_room: int, window: int) -> np.ndarray:
    """Tokens served to each source (columns) in each window (rows)."""
    left = held.astype(np.int64).copy()
    total = int(left.sum())
    credit, rows, room = deficit.astype(float).copy(), [], min(first_room, total)
    while total:
        quantum = room * left / total
        credit = credit + quantum
        # old debts are paid at a bounded rate, so that the window stays near the mix
        serve = np.minimum(np.floor(np.clip(credit, quantum / 2, 2 * quantum) + 1e-9).astype(np.int64), left)
        over = int(serve.sum()) - room
        if over > 0:       # deficits asked for more than the window holds
            cut = np.minimum(serve, np.ceil(serve * over / max(1, serve.sum())).astype(np.int64))
            serve -= cut
        short = room - int(serve.sum())
        while short > 0:   # whole tokens that the floors left over: largest deficit first
            open_ = np.flatnonzero(left > serve)
            # no source goes far over its share while another has room below it
            order = open_[np.lexsort((-(credit - serve)[open_], serve[open_] >= 2 * quantum[open_] + 1))]
            few = min(short, max(1, len(order) // 2)) if short < 4 * len(order) else 0
            if few:
                serve[order[:few]] += 1
                short -= few
            else:          # much room: in the sources' shares of what they still hold
                free = (left - serve).astype(float)
                more = np.minimum(np.floor(short * free / free.sum()).astype(np.int64), left - serve)
                serve += more
                short -= int(more.sum())
        credit = credit - serve
        left -= serve
        total -= int(serve.sum())
        rows.append(serve)
        room = min(window, total)
    return np.array(rows, dtype=np.int64).reshape(-1, len(held))


def _pack_lane(docs: pd.DataFrame, plan: pd.DataFrame, window: int) -> pd.DataFrame:
    cols = ["doc_id", "no_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if docs.empty:
        return pd.DataFrame(columns=cols, dtype=object)
    name = lambda s: s.map(lambda v: (1, "") if v is None or v != v else (0, v))
    plan = plan.assign(k=name(plan["source"])).sort_values("k").reset_index(drop=True)
    docs = docs.assign(k=name(docs["source"])).sort_values(["k", "no_id", "doc_id", "digest", "nth"], kind="stable")
    queue = {k: g for k, g in docs.groupby("k", sort=False)}
    lane_start = int(plan["lane_start"].iloc[0])
    served = round_robin(plan["held"].to_numpy(), plan["deficit"].to_numpy(float),
                         window - lane_start % window, window)
    upto = np.vstack([np.zeros((1, len(plan)), np.int64), np.cumsum(served, axis=0)])
    # inside a window sources follow one another in order
    lead = np.hstack([np.zeros((len(served), 1), np.int64), np.cumsum(served, axis=1)[:, :-1]])
    base = lane_start + np.concatenate([[0], np.cumsum(served.sum(axis=1))[:-1]])
    out = {c: [] for c in cols}
    for j, k in enumerate(plan["k"]):
        g = queue[k]
        n = g["n"].to_numpy()
        ends = np.cumsum(n)
        cuts = np.union1d(upto[:, j], np.concatenate([[0], ends]))
        a, b = cuts[:-1], cuts[1:]
        doc = np.searchsorted(ends, a, side="right")
        win = np.searchsorted(upto[:, j], a, side="right") - 1
        at = base[win] + lead[win, j] + (a - upto[win, j])
        start = a - (ends - n)[doc]
        ids = [np.frombuffer(x, dtype="<u2").astype("<u4") for x in g["ids"]]
        out["ids_crc32"].append(np.fromiter(
            (zlib.crc32(ids[d][s:s + z]) for d, s, z in zip(doc, start, b - a)), dtype=np.int64, count=len(a)))
        out["doc_id"].append(g["doc_id"].to_numpy()[doc])
        out["no_id"].append(g["no_id"].to_numpy()[doc])
        out["source"].append(g["source"].to_numpy()[doc])
        out["start"].append(start)
        out["length"].append(b - a)
        out["doc_tokens"].append(n[doc])
        out["sequence_id"].append(at // window)
        out["offset"].append(at % window)
    return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})[cols]


def pack(docs: DataFrame, *, tokenizer_path: str, end_id: int = 1, window: int = WINDOW,
         lane_tokens: int = LANE_TOKENS, weights: dict[str, float] | None = None, **cols) -> DataFrame:
    """Pack whole ``docs`` into windows; one row per piece of a document.

    doc_id, source, start (ids of the document before the piece), length,
    ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens (end id
    included), sequence_id, offset. Every id lies in exactly one piece; pieces
    of a sequence leave no gap. All sequences hold ``window`` ids but the last.

    ``weights`` (source → weight) is the target mix of every window for as long as its sources
    last; sources it does not name, the null source among them, come after all others. Without it the
    target is the mix of ``docs``. The layout does not hang on the partitioning of ``docs``.

    A null or empty text is the end id alone. A null id stays null, a null source is a source. Rows
    that repeat an id are packed each by itself. Very long texts are cut over
    windows as any other. An empty table gives no pieces; other columns are
    not looked at. Vocabularies up to 65,536 ids."""
    tokens = materialize(tokenise(docs, tokenizer_path, end_id, **cols), "tokens")
    dealt, plan = _lanes(_numbered(tokens), lane_tokens, weights)
    pieces = (dealt.groupBy("lane").cogroup(plan.groupBy("lane"))
              .applyInPandas(lambda left, right: _pack_lane(left, right, window), PIECES))
    return pieces.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def sequences(pieces: DataFrame) -> DataFrame:
    """Length, number of pieces and mix of each sequence (source → tokens)."""
    per = pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("n"))
    return per.groupBy("sequence_id").agg(
        F.sum("tokens").alias("length"), F.sum("n").alias("pieces"),
        F.map_from_entries(F.collect_list(F.struct(F.coalesce("source", F.lit("")), "tokens"))).alias("mix"))

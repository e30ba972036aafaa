"""Periodic runs of words, by recompression.

A run is a maximal stretch of words with smallest period ``q`` that holds at
least two periods and ``least`` words. Documents are read in groups: their
words become numbers, one number of its own ends each document, and the row of
numbers is compressed level by level. Odd steps replace a block of one symbol
by (symbol, length), even steps replace a pair whose first symbol is drawn to
the left class and whose second to the right class. The rules make a run-length
grammar in which equal stretches are parsed alike except at their two ends, so
the longest common extension of two places takes one step for each level up
and one for each level down.

A run of period ``p`` matches itself, shifted by ``p``, over ``g = max(p, least - p)``
places at least, so one of the places 0, g, 2g, ... lies in the match: the
harmonic grid, n log n places for all periods together. Where the word there
equals the word ``p`` further, two extensions give the whole match exactly. A
multiple of a run's smallest period finds the same stretch, so the smallest
period found for a stretch is its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Words of the documents that are compressed together (one document may hold more).
GROUP_WORDS = 400_000
#: Places of the grid that are extended together.
GRID_PLACES = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)   # odd constant of a multiplicative hash

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Grammar:
    """Levels of a row of symbols; symbols from ``first_end`` to ``last_end`` end documents.

    ``symbols[h]`` is the row at level h, ``parent[h]`` gives the place of a symbol's
    parent at level h + 1, ``first[h]`` the place at level h of the first child of each
    symbol of level h + 1, ``blocks[h]`` tells block steps from pair steps. ``rules``
    has (symbols, their first parts, their second parts or lengths, is block)."""

    def __init__(self, row: np.ndarray, first_end: int, last_end: int):
        self.symbols, self.parent, self.first, self.blocks, self.rules = [row], [], [], [], []
        self.fresh, self.step = max(int(row.max()), last_end) + 1, 0
        self.ends = (first_end, last_end)
        while self._compress_blocks() | self._compress_pairs():
            pass

    def _append(self, starts: np.ndarray, symbols: np.ndarray, block: bool) -> None:
        parent = np.zeros(len(self.symbols[-1]), np.int32)
        parent[starts[1:]] = 1
        self.parent.append(np.cumsum(parent, dtype=np.int32))
        self.first.append(np.append(starts, len(self.symbols[-1])).astype(np.int32))
        self.blocks.append(block)
        self.symbols.append(symbols)

    def _named(self, left: np.ndarray, right: np.ndarray, block: bool) -> np.ndarray:
        """New symbols, one for each distinct (left, right)."""
        wide = int(right.max()) + 1
        keys, which = np.unique(left * wide + right, return_inverse=True)
        names = np.arange(self.fresh, self.fresh + len(keys))
        self.rules.append((names, keys // wide, keys % wide, block))
        self.fresh += len(keys)
        return names[which]

    def _compress_blocks(self) -> bool:
        row = self.symbols[-1]
        new = np.append(True, row[1:] != row[:-1])
        if new.all():
            return False
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(row)))
        out, long = row[starts], lengths > 1
        out[long] = self._named(out[long], lengths[long], True)
        self._append(starts, out, True)
        return True

    def _compress_pairs(self) -> bool:
        row = self.symbols[-1]
        word = (row < self.ends[0]) | (row > self.ends[1])
        if not (word[1:] & word[:-1]).any():
            return False
        joined = np.zeros(0, bool)
        while not joined.any():
            self.step += 1
            left = _drawn(row, self.step)
            joined = left[:-1] & ~left[1:] & word[:-1] & word[1:]
        keep = np.append(True, ~joined)
        starts = np.flatnonzero(keep)
        out, lead = row[starts], np.append(joined, False)[starts]
        out[lead] = self._named(row[:-1][joined], row[1:][joined], False)
        self._append(starts, out, False)
        return True

    def extend(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from each place ``a`` on that equal those from ``b`` on (a < b)."""
        return self._walk(a, b, 0)

    def extend_back(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before each place ``a`` that equal those before ``b`` (0 < a < b)."""
        return self._walk(a, b, -1)

    def _walk(self, a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
        """Climb while the symbols are equal, then come down to the word where they differ.

        ``side`` is 0 (symbols at the places) or -1 (symbols before them)."""
        at, low, high = np.arange(len(a)), a.astype(np.int32), b.astype(np.int32)
        stopped = []          # for each level: which, and both places
        for h, symbols in enumerate(self.symbols):
            same = symbols[low + side] == symbols[high + side]
            stopped.append((at[~same], low[~same], high[~same]))
            at, low, high = at[same], low[same], high[same]
            if not len(at):
                break
            first, parent = self.first[h], self.parent[h]
            inside = (first[parent[low]] != low) | (first[parent[high]] != high)
            step, even = self._reach(h, low[inside], high[inside], side)
            low[inside] += step
            high[inside] += step
            odd = np.zeros(len(at), bool)
            odd[inside] = ~even      # blocks of two lengths: the next symbols differ
            stopped.append((at[odd], low[odd], high[odd]))
            at, low, high = at[~odd], parent[low[~odd]], parent[high[~odd]]
        out = np.zeros(len(a), np.int64)
        at = np.zeros(0, np.int64)
        low = high = np.zeros(0, np.int32)
        levels = _by_level(stopped)
        for h in range(len(levels) - 1, -1, -1):
            if h < len(levels) - 1 and len(at):
                low, high = self.first[h][low], self.first[h][high]
                same = self.symbols[h][low + side] == self.symbols[h][high + side]
                step, _ = self._reach(h, low[same], high[same], side)
                low[same] += step
                high[same] += step
            for which, x, y in levels[h]:
                at, low, high = np.append(at, which), np.append(low, x), np.append(high, y)
        out[at] = np.abs(low.astype(np.int64) - a[at])
        return out

    def _reach(self, h: int, low: np.ndarray, high: np.ndarray, side: int):
        """Equal symbols to pass at level h (signed), and whether both places then begin a parent."""
        if not self.blocks[h]:
            return np.int32(1 if side == 0 else -1), np.ones(len(low), bool)
        first, parent = self.first[h], self.parent[h]
        if side == 0:
            x, y = first[parent[low] + 1] - low, first[parent[high] + 1] - high
            return np.minimum(x, y), x == y
        x, y = low - first[parent[low - 1]], high - first[parent[high - 1]]
        return -np.minimum(x, y), x == y


def _drawn(symbols: np.ndarray, step: int) -> np.ndarray:
    """Whether each symbol is drawn to the left class in this step."""
    x = (symbols.astype(np.uint64) ^ (np.uint64(step) << np.uint64(40))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX >> np.uint64(63) == 1


def _by_level(stopped: list) -> list:
    """Two entries of ``stopped`` belong to each level."""
    return [stopped[i:i + 2] for i in range(0, len(stopped), 2)]


def find_runs(row: np.ndarray, sizes: np.ndarray, first_end: int, least: int = LEAST):
    """(start, length, period) of all runs of ``row``: an end symbol, then documents of
    ``sizes`` words in falling order, each followed by an end symbol."""
    found = [np.zeros((0, 3), np.int64)]
    grammar = None
    reach = np.cumsum(sizes + 1) + 1               # place after each document's end symbol
    grid, held = [], 0
    longest = int(sizes[0]) if len(sizes) else 0
    last = longest // 2 if longest >= least else 0
    for p in range(1, last + 1):
        fit = np.searchsorted(-sizes, -max(2 * p, least), side="right")   # documents that can hold the period
        end, g = int(reach[fit - 1]) - 1, max(p, least - p)
        left, right = row[1:end - p:g], row[1 + p:end:g]
        places = np.flatnonzero(left == right) * g + 1
        if len(places):
            # a match has g places, more than one: a neighbour matches too
            near = (row[places - 1] == row[places - 1 + p]) | (row[places + 1] == row[places + 1 + p])
            places = places[near]
        if len(places):
            grid.append((places, np.full(len(places), p)))
            held += len(places)
        if held and (held >= GRID_PLACES or p == last):
            grammar = grammar or Grammar(row, first_end, first_end + len(sizes))
            places, periods = (np.concatenate(x) for x in zip(*grid))
            for i in range(0, len(places), GRID_PLACES):
                found.append(_whole_matches(grammar, places[i:i + GRID_PLACES], periods[i:i + GRID_PLACES], least))
            found, grid, held = [_smallest_periods(np.concatenate(found))], [], 0
    return _smallest_periods(np.concatenate(found))


def _whole_matches(grammar: Grammar, places: np.ndarray, periods: np.ndarray, least: int) -> np.ndarray:
    back = grammar.extend_back(places, places + periods)
    match = back + grammar.extend(places, places + periods)
    good = match >= np.maximum(periods, least - periods)
    return np.stack([places - back, match + periods, periods], axis=1)[good]


def _smallest_periods(runs: np.ndarray) -> np.ndarray:
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))] if len(runs) else runs


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def runs_of(texts: list[list[bytes]], least: int = LEAST):
    """Runs of lists of words, as (document, start, length, period) ordered by document, start and period,
    and for each document the flags of the words that a run repeats."""
    numbers = _Numbers()
    coded = [np.fromiter(map(numbers.__getitem__, ws), np.int64, len(ws)) for ws in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
    ends = len(numbers) + np.arange(len(texts) + 1)
    row = np.concatenate([ends[:1], *(x for n, i in enumerate(order, 1) for x in (coded[i], ends[n:n + 1]))])
    runs = find_runs(row, sizes, len(numbers), least)
    begins = np.cumsum(np.append(0, sizes + 1))[:-1] + 1
    drop = np.zeros(len(row) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    drop = np.cumsum(drop) > 0
    nth = np.searchsorted(begins, runs[:, 0], side="right") - 1
    out = np.column_stack([np.array(order, np.int64)[nth], runs[:, 0] - begins[nth], runs[:, 1:]]) if len(runs) else np.zeros((0, 4), np.int64)
    flags = [None] * len(texts)
    for n, i in enumerate(order):
        flags[i] = drop[begins[n]:begins[n] + sizes[n]]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))], flags


def _record(ids: pa.Array, texts: list[list[bytes]], least: int) -> pa.RecordBatch:
    runs, drop = runs_of(texts, least)
    per = np.bincount(runs[:, 0], minlength=len(texts))
    parts = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)).astype(np.int32)), parts)
    kept = [b" ".join(ws) if not d.any() else b" ".join([w for w, gone in zip(ws, d) if not gone]) for ws, d in zip(texts, drop)]
    return pa.RecordBatch.from_arrays([ids, pa.array([len(ws) for ws in texts], pa.int64()), lists,
                                       pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "kept_text"])


def periodic_runs(docs: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period; by start, then
    period) and kept_text, the words that no run repeats, joined by one space.

    Words are separated by space, tab, line feed, VT, FF and CR. A null text counts as
    empty and has no runs and an empty kept_text; a null id stays null; repeated rows give equal
    rows. Very long texts are read whole, by themselves if need be; a text must fit a
    row. An empty table gives an empty result; other columns are not looked at."""
    def run(batches):
        for batch in batches:
            ids, texts, start, held = batch.column(0), [], 0, 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_buffer()
                texts.append(text.to_pybytes().split() if text else [])
                held += len(texts[-1]) + 1
                if held >= GROUP_WORDS or i == batch.num_rows - 1:
                    yield _record(ids.slice(start, len(texts)), texts, least)
                    start, texts, held = i + 1, [], 0
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN}>, kept_text string")


def run_report(found: DataFrame) -> DataFrame:
    """Number of runs, the longest run (ties: smallest start, then period) and digests of ``periodic_runs``."""
    # the first by (length falling, start, period)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    wide = found.withColumn("best", best)
    return wide.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"),
                       (-F.col("best.l")).alias("length"), F.col("best.p").alias("period"),
                       F.expr("1000 * -best.l div best.p").alias("exponent_milli"),
                       F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"))

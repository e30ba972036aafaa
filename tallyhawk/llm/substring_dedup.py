"""Repeated passages by word automata.

A window is ``window`` consecutive words. A word goes if some window over it
also starts in a document with a smaller id.

1. Documents are dealt by a hash to blocks of a few MB, the unit of all Python
   work. All three passes below read the same shuffled blocks.
2. Recurrence: a block sends every distinct window hash once, with the smallest
   id that holds it, to the hash's shard, packed into one compressed row for
   each (block, shard). So a window that a third of all documents hold comes
   from each block once. A shard sees which hashes meet in two or more blocks
   and asks the block of the smallest id for those passages, for each other block.
   Windows are told apart by all 64 bits of their hash: some 5e9 windows hold one
   pair that shares a hash, of which the one with the larger id may be missed.
3. Confirmed passages: the asked block looks up the words, joins windows that
   follow one another to passages, and sends each passage to the block that
   shares it. From here on words count, not hashes.
4. Automata: each block compiles Aho-Corasick automata (pyahocorasick, words
   spelt by symbols) of the passages that recur in it, ``AUTOMATON_ANCHORS``
   anchors at a time, and streams all its documents through them. Anchors are
   phrases of half a window, so spaced that every window of a passage holds
   one; where an anchor occurs, the words on both sides are compared with the
   passage as far as they agree. Agreement over a window or more is a repeat.
"""

from __future__ import annotations

from functools import cached_property
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
BLOCK_BYTES = 4_000_000
SHARD_WINDOWS = 2_000_000
AUTOMATON_ANCHORS = 50_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(0xFFFFFFFF)
_NO_ID = np.iinfo(np.int64).max   # a null id comes after all others


class Block:
    """The words of some documents, in order of id, and the hashes of their windows."""

    def __init__(self, pdf: pd.DataFrame, window: int):
        order = np.argsort(pdf["doc_id"].to_numpy(dtype=np.int64), kind="stable")
        self.window, self.pdf = window, pdf.iloc[order]
        self.ids = self.pdf["doc_id"].to_numpy(dtype=np.int64)
        texts = self.pdf["text"]
        words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        self.counts = np.array([len(w) for w in words], dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        self.words = list(chain.from_iterable(words))
        coded = pa.array(self.words, pa.large_binary()).dictionary_encode()
        self.vocabulary = coded.dictionary.to_pylist()
        self.codes = codes = coded.indices.to_numpy().astype(np.int64)
        hashed = np.fromiter(map(xxhash.xxh64_intdigest, self.vocabulary), np.uint64, len(self.vocabulary))
        h, span, parts = hashed[codes] if len(codes) else np.zeros(0, np.uint64), 1, []
        # hashes of runs of 1, 2, 4, ... words make up the hash of ``window`` words
        rest, step = window, _STEP
        with np.errstate(over="ignore"):
            while rest:
                if rest & 1:
                    parts.append((span, step, h))
                rest >>= 1
                if rest:
                    h = h[:-span] * step + h[span:] if len(h) > span else h[:0]
                    step, span = step * step, span * 2
            n = max(0, len(self.words) - window + 1)
            total, at = np.zeros(n, np.uint64), 0
            for span, step, h in parts:
                total = total * step + h[at:at + n]
                at += span
            total ^= total >> np.uint64(29)
            total *= np.uint64(0xBF58476D1CE4E5B9)
            total ^= total >> np.uint64(32)
        doc = np.repeat(np.arange(len(words)), self.counts)[:n]
        inside = np.arange(n) + window <= self.ends[doc] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(inside)           # word index where a window starts
        self.hash, self.doc = total[self.at], doc[self.at]

    @cached_property
    def number(self) -> dict[bytes, int]:
        """The code of each word."""
        return {w: i for i, w in enumerate(self.vocabulary)}

    def firsts(self):
        """Distinct hashes in order, the first window of each, and whether two documents hold it."""
        order = np.argsort(self.hash)
        h = self.hash[order]
        if not len(h):
            return h, order, np.zeros(0, bool)
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        first, last = np.minimum.reduceat(order, start), np.maximum.reduceat(order, start)
        return h[start], first, self.ids[self.doc[last]] != self.ids[self.doc[first]]


def _by_shard(h: np.ndarray, shards: int):
    """Order by shard, then hash, of sorted hashes; shards; hashes."""
    shard = (h & _LOW) % np.uint64(shards)
    order = np.argsort(shard.astype(np.uint16 if shards < 65536 else np.uint32), kind="stable")
    return order, shard[order], h[order]


def _pack(a: np.ndarray) -> bytes:
    """Bytes of an integer array by planes, compressed."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(blob)), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).reshape(-1) if len(raw) else np.zeros(0, dtype)


def _send_hashes(pdf: pd.DataFrame, block: int, shards: int, window: int) -> pd.DataFrame:
    b = Block(pdf, window)
    h, first, _ = b.firsts()
    order, shard, keys = _by_shard(h, shards)
    doc = b.doc[first[order]].astype(np.uint32)
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, int)
    rows = []
    for s, e in zip(cut, np.append(cut[1:], len(shard))):
        used, local = np.unique(doc[s:e], return_inverse=True)
        rows.append((int(shard[s]), block, _pack(np.diff(keys[s:e], prepend=np.uint64(0))),
                     _pack(local.astype(np.uint32)), _pack(np.diff(b.ids[used], prepend=np.int64(0)))))
    return pd.DataFrame(rows, columns=["shard", "block", "keys", "docs", "ids"])


def _find_recurring(pdf: pd.DataFrame, shard: int) -> pd.DataFrame:
    keys, docs, blocks = [], [], []
    for block, k, d, i in zip(pdf["block"], pdf["keys"], pdf["docs"], pdf["ids"]):
        k = np.cumsum(_unpack(k, np.uint64), dtype=np.uint64)
        keys.append(k)
        docs.append(np.cumsum(_unpack(i, np.int64))[_unpack(d, np.uint32)])
        blocks.append(np.full(len(k), block, np.int64))
    keys, docs, blocks = map(np.concatenate, (keys, docs, blocks))
    order = np.argsort(keys, kind="stable")      # sorted runs: merged quickly
    keys = keys[order]
    same = np.append(False, keys[1:] == keys[:-1])
    shared = same | np.append(same[1:], False)
    order, keys = order[shared], keys[shared]
    order = order[np.lexsort((blocks[order], docs[order], keys))]
    blocks = blocks[order]
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    owner = blocks[np.flatnonzero(new)][np.cumsum(new) - 1] if len(keys) else blocks   # block of the smallest id
    other = ~new & (blocks != owner)
    asked, key, to = owner[other], keys[other], blocks[other]
    order = np.lexsort((to, key, asked))
    asked, key, to = asked[order], key[order], to[order]
    cut = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])) if len(asked) else np.zeros(0, int)
    rows = [(int(asked[s]), shard, _pack(np.diff(key[s:e], prepend=np.uint64(0))), _pack(to[s:e]))
            for s, e in zip(cut, np.append(cut[1:], len(asked)))]
    return pd.DataFrame(rows, columns=["block", "shard", "keys", "to"])


def _send_passages(pdf: pd.DataFrame, asked: pd.DataFrame, window: int) -> pd.DataFrame:
    cols = ["block", "first_ids", "passages"]
    if pdf.empty or asked.empty:
        return pd.DataFrame(columns=cols, dtype=object)
    b = Block(pdf, window)
    h, first, _ = b.firsts()
    want, to = [], []
    for k, t in zip(asked["keys"], asked["to"]):
        want.append(np.cumsum(_unpack(k, np.uint64), dtype=np.uint64))
        to.append(_unpack(t, np.int64))
    want, to = np.concatenate(want), np.concatenate(to)
    win = first[np.searchsorted(h, want)]     # a block is asked only for what it sent
    pos, doc = b.at[win], b.doc[win]
    order = np.lexsort((pos, to))
    pos, doc, to = pos[order], doc[order], to[order]
    apart = np.ones(len(pos), bool)
    apart[1:] = (to[1:] != to[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] > pos[:-1] + 1)
    start = np.flatnonzero(apart)
    end = np.append(start[1:], len(pos)) - 1 if len(pos) else start
    out: dict[int, tuple[list, list]] = {}
    for s, e in zip(start, end):
        ids, texts = out.setdefault(int(to[s]), ([], []))
        ids.append(int(b.ids[doc[s]]))
        texts.append(b" ".join(b.words[pos[s]:pos[e] + window]).decode("utf-8", "surrogatepass"))
    return pd.DataFrame([(k, i, t) for k, (i, t) in out.items()], columns=cols)


#: A word is spelt by two letters of different alphabets, so that automaton
#: states have few children and matches can only begin at a word.
_BASE, _SPELT = 256, 2
_NONE = "\x00" * _SPELT


def _symbol(i: int) -> str:
    return chr(0x4000 + i // _BASE) + chr(1 + i % _BASE)


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries are equal."""
    n, at = min(len(a), len(b)), 0
    while at < n:
        differ = np.flatnonzero(a[at:min(n, at + 64)] != b[at:min(n, at + 64)])
        if len(differ):
            return at + int(differ[0])
        at += 64
    return n


class _Passages:
    """Passages by block word codes, and an automaton of their anchors. An anchor's
    value lists where it stands: (passage, place)."""

    def __init__(self, passages: list[tuple[int, np.ndarray]], window: int, vocabulary: int):
        self.passages = passages
        self.size = -(-window // 2)
        gap = window - self.size + 1
        self.spell = [_NONE] * vocabulary
        known, anchors = 0, {}
        for p, (_, codes) in enumerate(passages):
            for at in range(0, len(codes) - self.size + 1, gap):
                words = codes[at:at + self.size].tolist()
                if min(words) < 0:
                    continue     # a word that this block does not have
                for c in words:
                    if self.spell[c] is _NONE:
                        self.spell[c], known = _symbol(known), known + 1
                anchors.setdefault("".join([self.spell[c] for c in words]), []).append((p, at))
        self.automaton = ahocorasick.Automaton()
        for phrase, places in anchors.items():
            self.automaton.add_word(phrase, places)
        if anchors:
            self.automaton.make_automaton()
        self.empty = not anchors

    def repeats(self, codes: np.ndarray, own: int, window: int):
        """(start, end) of runs of ``codes`` that passages of smaller ids hold, a window long or more."""
        line = "".join([self.spell[c] for c in codes.tolist()])
        done: dict[tuple[int, int], int] = {}
        for end, places in self.automaton.iter(line):
            start = (end + 1) // _SPELT - self.size
            for p, at in places:
                first, passage = self.passages[p]
                if first >= own or done.get((p, start - at), -1) >= start:
                    continue
                stop = start + _agree(codes[start:], passage[at:])
                back = _agree(codes[:start][::-1], passage[:at][::-1])
                done[(p, start - at)] = stop
                if stop - start + back >= window:
                    yield start - back, stop


def _locate(pdf: pd.DataFrame, sent: pd.DataFrame, window: int) -> pd.DataFrame:
    cols = ["doc_id", "no_id", "n_words", "n_removed", "kept_text"]
    if pdf.empty:
        return pd.DataFrame(columns=cols, dtype=object)
    b = Block(pdf, window)

    def passages():
        # shared inside the block: runs of first windows that another document repeats
        _, first, twice = b.firsts()
        win = np.sort(first[twice])
        pos, doc = b.at[win], b.doc[win]
        apart = np.ones(len(pos), bool)
        apart[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
        start = np.flatnonzero(apart)
        for s, e in zip(start, np.append(start[1:], len(pos)) - 1 if len(pos) else start):
            yield int(b.ids[doc[s]]), b.codes[pos[s]:pos[e] + window]
        for ids, texts in zip(sent["first_ids"], sent["passages"]):
            for i, t in zip(ids, texts):
                yield int(i), np.array([b.number.get(w, -1) for w in t.encode("utf-8", "surrogatepass").split()], np.int64)

    def batches():
        held, words = [], 0
        for passage in passages():
            held.append(passage)
            words += len(passage[1])
            if words >= AUTOMATON_ANCHORS * (window // 2 + 1):
                yield held
                held, words = [], 0
        if held:
            yield held
    cover = np.zeros(len(b.words) + 1, np.int64)
    for held in batches():
        found = _Passages(held, window, len(b.vocabulary))
        if found.empty:
            continue
        for k, (end, n) in enumerate(zip(b.ends, b.counts)):
            if n >= window:
                here = end - n
                for s, e in found.repeats(b.codes[here:end], int(b.ids[k]), window):
                    cover[here + s] += 1
                    cover[here + e] -= 1
    gone = np.cumsum(cover[:-1]) > 0
    kept, removed = [], []
    for end, n in zip(b.ends, b.counts):
        mask = gone[end - n:end]
        words = b.words[end - n:end]
        lost = int(mask.sum())
        removed.append(lost)
        left = words if not lost else [words[i] for i in np.flatnonzero(~mask)]
        kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
    return pd.DataFrame({"doc_id": b.ids, "no_id": b.pdf["no_id"].to_numpy(), "n_words": b.counts, "n_removed": removed,
                         "kept_text": kept})


def drop_repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                           window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                           shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (words joined by a space).

    Null and empty texts have no words. Texts shorter than a window lose
    nothing. Repeats inside one document, or in documents of the same id, stay.
    A null id comes after all others. An empty table gives an empty result;
    other columns are not looked at."""
    size = docs.agg(F.sum(F.octet_length(docs[text_col])), F.sum(F.regexp_count(docs[text_col], F.lit(r"\s+")))).first()
    blocks = max(1, -(-(size[0] or 0) // block_bytes))
    shards = max(1, -(-(size[1] or 0) // shard_windows))
    dealt = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NO_ID)).alias("doc_id"),
                        docs[id_col].isNull().alias("no_id"), docs[text_col].cast("string").alias("text"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    grouped = dealt.groupBy("block")
    hashes = grouped.applyInPandas(lambda key, pdf: _send_hashes(pdf, int(key[0]), shards, window),
                                   "shard long, block long, keys binary, docs binary, ids binary")
    asked = hashes.groupBy("shard").applyInPandas(lambda key, pdf: _find_recurring(pdf, int(key[0])),
                                                  "block long, shard long, keys binary, to binary")
    passages = grouped.cogroup(asked.groupBy("block")).applyInPandas(
        lambda left, right: _send_passages(left, right, window),
        "block long, first_ids array<long>, passages array<string>")
    found = grouped.cogroup(passages.groupBy("block")).applyInPandas(
        lambda left, right: _locate(left, right, window),
        "doc_id long, no_id boolean, n_words long, n_removed long, kept_text string")
    return found.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")

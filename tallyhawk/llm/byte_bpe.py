"""Byte-level BPE by recursive DuckDB queries inside Spark tasks.

A worker keeps one in-memory DuckDB database with two small tables made from a
rank file: ``merges`` (a pair of ids, and the id of the bytes they make) and the
tokens themselves. The distinct words of a batch become rows of position and
token; a recursive query joins neighbours with ``merges`` and contracts the
leftmost pair of least rank of each word until no word has a pair left. An
ordered aggregation turns ids back into bytes.

Words come from the rank file's own pattern. The pattern never crosses a
boundary between a run of other characters and the white space after it, so
texts are first cut there, and the pattern runs on distinct cuts that are more than letters. Words
met before are kept by the worker, up to ``CACHE_WORDS``.

Words of over ``LONG`` bytes are cut where two bytes stand side by side that no
token holds side by side (no merge can ever cross that place); what is still
long contracts all places of its least rank in one step, unless the merged
token has a pair of lower rank than its own, when the order could matter.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.tokens import SPACE

#: Characters of the texts that are encoded together.
BATCH_CHARS = 4_000_000
#: Tokens that are decoded together.
BATCH_TOKENS = 500_000
#: Rows that one recursive query may gather.
QUERY_ROWS = 5_000_000
LONG = 64
CACHE_WORDS = 1_300_000
MEMORY = "512MB"

_CUTS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

# A key is word * 2^32 + position. ``best`` is rank * 2^32 + position, so its minimum
# is the leftmost pair of least rank.
ENCODE = """
WITH RECURSIVE s(step, k, id) AS (
  SELECT 0, k, id FROM start
  UNION ALL
  (WITH p AS (SELECT k, id, lead(id) OVER o AS next_id, lead(k) OVER o AS next_k FROM s WINDOW o AS (ORDER BY k)),
   b AS (SELECT p.k >> 32 AS w, min((m.merged::BIGINT << 32) + (p.k & 4294967295)) AS best,
                arg_min(p.next_k, (m.merged::BIGINT << 32) + (p.k & 4294967295)) AS gone
         FROM p JOIN merges m ON m.pair = (p.id::BIGINT << 32) + p.next_id
         WHERE p.next_k >> 32 = p.k >> 32 GROUP BY 1)
   SELECT s.step + 1, s.k, CASE WHEN s.k & 4294967295 = b.best & 4294967295 THEN (b.best >> 32)::INTEGER ELSE s.id END
   FROM s JOIN b ON b.w = s.k >> 32 WHERE s.k <> b.gone AND s.step < $steps)),
"""
ENCODE_LONG = """
WITH RECURSIVE s(step, k, id) AS (
  SELECT 0, k, id FROM start
  UNION ALL
  (WITH p AS (SELECT k, id, lead(id) OVER o AS next_id, lead(k) OVER o AS next_k FROM s WINDOW o AS (ORDER BY k)),
   c AS (SELECT p.k >> 32 AS w, p.k, p.next_k, m.merged, m.alone
         FROM p JOIN merges m ON m.pair = (p.id::BIGINT << 32) + p.next_id WHERE p.next_k >> 32 = p.k >> 32),
   b AS (SELECT w, min(merged) AS least FROM c GROUP BY w),
   h AS (SELECT c.*, coalesce(lag(c.next_k) OVER (ORDER BY c.k) <> c.k, true) AS fresh
         FROM c JOIN b ON b.w = c.w AND b.least = c.merged),
   i AS (SELECT *, sum(fresh::INTEGER) OVER (ORDER BY k) AS island FROM h),
   t AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY k) % 2 = 1 AS free,
                row_number() OVER (PARTITION BY w ORDER BY k) = 1 AS leftmost FROM i),
   x AS (SELECT k, next_k, merged FROM t WHERE free AND (leftmost OR NOT alone))
   SELECT s.step + 1, s.k, coalesce(x.merged, s.id)
   FROM s JOIN b ON b.w = s.k >> 32 LEFT JOIN x ON x.k = s.k
   WHERE s.k NOT IN (SELECT next_k FROM x) AND s.step < $steps)),
"""
LAST = """
last AS (SELECT k >> 32 AS w, max(step) AS step FROM s GROUP BY 1)
SELECT s.k, s.id, s.step FROM s JOIN last ON last.w = s.k >> 32 AND last.step = s.step ORDER BY s.k
"""
DECODE = """
SELECT coalesce(list_aggregate(list_select(getvariable('tokens'), list_transform(ids, lambda x: x + 1)), 'string_agg', ''), '')
FROM given ORDER BY nth
"""


class RankFile:
    """The tables of one rank file, the database that holds them, and words met before."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.beside = np.zeros((256, 256), dtype=bool)   # bytes side by side in some token
        rows, least = [], {}
        for token, merged in self.ranks.items():
            for i in range(1, len(token)):
                self.beside[token[i - 1], token[i]] = True
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    rows.append(((left << 32) + right, merged))
                    for part in (left, right):
                        least[part] = min(merged, least.get(part, merged))
        tokens: list = [None] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token.decode("latin-1")       # one character for each byte
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        merges = pa.table({"pair": pa.array([r[0] for r in rows], pa.int64()),
                           "merged": pa.array([r[1] for r in rows], pa.int32()),
                           "alone": pa.array([least.get(r[1], r[1]) < r[1] for r in rows], pa.bool_())})
        self.db.register("given", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"tokens": pa.array([tokens], pa.list_(pa.string()))}))
        self.db.execute("SET VARIABLE tokens = (SELECT tokens FROM given)")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # --- words -> ids

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        raw = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(w) for w in words])
        at = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        key = (np.repeat(np.arange(len(words), dtype=np.int64), lengths) << 32) + at
        ids, out = self.byte_id[raw], [b""] * len(words)
        while len(key):
            steps = max(1, QUERY_ROWS // len(key))
            self.db.register("start", pa.table({"k": key, "id": ids}))
            got = self.db.sql(query + LAST, params={"steps": steps}).to_arrow_table()
            key, ids, step = (got.column(i).to_numpy() for i in range(3))
            word = key >> 32
            done = step < steps
            ended = word[done]
            cuts = np.flatnonzero(np.diff(ended, prepend=-1))
            raw = ids[done].astype("<u4").tobytes()
            for w, a, b in zip(ended[cuts].tolist(), (4 * cuts).tolist(), (4 * np.append(cuts[1:], len(ended))).tolist()):
                out[w] = raw[a:b]
            key, ids = key[~done], ids[~done]
        return out

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, by recursive queries over groups of bounded size."""
        parts, owner, out = [], [], [b""] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG:
                b = np.frombuffer(w, np.uint8)
                cuts = [0, *(np.flatnonzero(~self.beside[b[:-1], b[1:]]) + 1).tolist(), len(w)]
                parts += [w[x:y] for x, y in zip(cuts, cuts[1:])]
                owner += [i] * (len(cuts) - 1)
            else:
                parts.append(w)
                owner.append(i)
        got: list = [None] * len(parts)
        for query, chosen in ((ENCODE, [i for i, p in enumerate(parts) if len(p) <= LONG]),
                              (ENCODE_LONG, [i for i, p in enumerate(parts) if len(p) > LONG])):
            group, rows = [], 0
            for n, i in enumerate(chosen, 1):
                group.append(i)
                rows += len(parts[i]) ** 2 // 2 + 1
                if rows >= QUERY_ROWS or n == len(chosen):
                    for j, ids in zip(group, self._contract([parts[j] for j in group], query)):
                        got[j] = ids
                    group, rows = [], 0
        if len(parts) == len(words):
            return got
        for i, ids in zip(owner, got):
            out[i] += ids
        return out

    def _ids_of(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct words: known tokens and words met before as they are, the others by queries."""
        found, new = {}, []
        for w in words:
            ids = self.young.get(w)
            if ids is None:
                ids = self.old.get(w)
                if ids is not None:
                    self.young[w] = ids
            if ids is None:
                rank = self.ranks.get(w.encode())
                if rank is None:
                    new.append(w)
                    continue
                ids = self.young[w] = rank.to_bytes(4, "little")
            found[w] = ids
        for w, ids in zip(new, self._encode([w.encode() for w in new])):
            found[w] = self.young[w] = ids
        if len(self.young) > CACHE_WORDS // 2:
            self.old, self.young = self.young, {}
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cuts = [_CUTS.findall(t) for t in texts]
        every = set().union(*cuts)
        # letters behind at most one space are one word of the pattern
        words = {c: self.pattern.findall(c) for c in every if not (c[1:] if c[0] == " " else c).isalpha()}
        ids = self._ids_of(every.difference(words).union(*words.values()))
        ids.update({c: b"".join([ids[w] for w in ws]) for c, ws in words.items()})
        return [b"".join([ids[c] for c in cs]) for cs in cuts]

    # --- ids -> bytes

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes of each row of little-endian unsigned 32-bit ids."""
        out, group, held = [], [], 0
        for n, row in enumerate(rows, 1):
            group.append(row)
            held += len(row) // 4
            if held >= BATCH_TOKENS or n == len(rows):
                ends = np.cumsum([0, *(len(r) // 4 for r in group)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(group), "<u4").astype(np.int32)))
                self.db.register("given", pa.table({"nth": np.arange(len(group)), "ids": ids}))
                out += [s.encode("latin-1") for s in self.db.sql(DECODE).to_arrow_table().column(0).to_pylist()]
                group, held = [], 0
        return out


_LOADED: dict = {}


def rank_file(path: str, pattern: str) -> RankFile:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = RankFile(path, pattern)
    return _LOADED[path, pattern]


def _groups(sizes: list[int], most: int):
    """Ranges of rows whose sizes add up to ``most`` or little more."""
    start = held = 0
    for i, n in enumerate(sizes, 1):
        held += n
        if held >= most or i == len(sizes):
            yield start, i
            start, held = i, 0


def encode(docs: DataFrame, *, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32 bits) of whole texts;
    with ``decoded`` also the bytes that the ids decode to.

    A null text counts as empty and has no ids; a null id stays null; repeated
    rows are encoded each by itself. Texts of any length are read whole; a text
    and its ids must fit a row. An empty table gives an empty result; other
    columns are not looked at. Characters that UTF-8 cannot hold do not occur in Spark strings."""
    def run(batches):
        table = rank_file(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _groups([len(t) + 1 for t in texts], BATCH_CHARS):
                ids = table.encode(texts[a:b])
                cols = [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    cols.append(pa.array(table.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    names = ["doc_id", "n_tokens", "ids", *(["decoded"] if decoded else [])]
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary" + (", decoded binary" if decoded else ""))


def decode(rows: DataFrame, *, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the bytes (``decoded``) of rows of ids as ``encode`` gives them; null ids decode to no bytes.

    An id that the file does not hold is an error of the input and fails the task."""
    def run(batches):
        table = rank_file(ranks_path, pattern)
        for batch in batches:
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            if any(len(x) % 4 or (len(x) and int(np.frombuffer(x, "<u4").max()) >= len(table.ranks)) for x in ids):
                raise ValueError("ids that the rank file does not hold")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(table.decode(ids), pa.binary())], ["doc_id", "decoded"])
    picked = rows.select(rows[id_col].alias("doc_id"), rows[ids_col].cast("binary").alias("ids"))
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))

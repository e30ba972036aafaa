"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A signature has ``CHUNKS * CHUNK_SIZE`` MinHash values of 16 bits. If two
signatures differ in at most ``RADIUS = CHUNKS * (ERRORS + 1) - 1`` values, by
the pigeonhole principle some chunk differs in at most ``ERRORS`` values. All
ways to leave out ``ERRORS`` values of a chunk are enumerated as index keys,
so every such pair meets under some key: no pair within the radius is missed.
A pair of similarity 0.8 exceeds the radius with a probability of about
3e-6. Links are confirmed on the full shingle sets.

Texts with equal shingle sets are one class from the start. Inside a key's
bucket, members are compared with the bucket's smallest id, under an eighth of
the keys first and then under all keys where the components still differ. After
that only pairs of different components are open. Small buckets list theirs. In
large ones, texts outside a bucket's largest component are compared with all
texts of the open buckets they belong to, tile by tile in numpy, and only links
leave a task. So a bucket of copies costs a star, not all pairs, and no link
that could join two components is left out.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import components, small_side
from tallyhawk.session import materialize

CHUNKS, CHUNK_SIZE, ERRORS = 8, 6, 2
RADIUS = CHUNKS * (ERRORS + 1) - 1
BLOCK_DOCS = 4096
#: Texts signed at a time, and words whose hashes a worker keeps.
SIGN_ROWS, CACHE_WORDS = 2000, 200_000
SHARD_KEYS = 4_000_000
#: Members up to which an open bucket lists its pairs.
SMALL_BUCKET = 16
#: Rows of the two sides of a tile.
ROW_TILE, COLUMN_TILE = 512, 2048
#: Texts compared with one centre in one go; a centre with more is split.
STAR_SIZE = 256
#: Ids up to which the texts to confirm are picked by a broadcast (16 MB of ids).
PICK_ROWS = 1_000_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_RNG = np.random.RandomState(20240717)
_XOR = _RNG.randint(0, 2 ** 63, CHUNKS * CHUNK_SIZE).astype(np.uint64)
_MUL = _RNG.randint(0, 2 ** 63, CHUNKS * CHUNK_SIZE).astype(np.uint64) | np.uint64(1)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(27))


class Shingler:
    """Distinct shingles of a text as sorted 64-bit hashes; words are hashed once per worker batch."""

    def __init__(self, words: int):
        self.words, self.cache = words, {}

    def __call__(self, text) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, out = self.cache, []
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        h = np.array(out, dtype=np.uint64)
        n = max(1, len(h) - self.words + 1)
        span = min(self.words, len(h))
        with np.errstate(over="ignore"):
            s = np.full(n, span, np.uint64)
            for i in range(span):
                s = _spread(s + h[i:i + n])
        return np.unique(s)


def _sign(batches, words: int):
    """doc_id, n_shingles, digest of the set and signature."""
    cut = Shingler(words)
    for pdf in (b.iloc[at:at + SIGN_ROWS] for b in batches for at in range(0, len(b), SIGN_ROWS)):
        sets = [cut(t) for t in pdf["text"]]
        n = np.array([len(s) for s in sets])
        full = np.flatnonzero(n)
        sig = np.zeros((len(sets), len(_XOR)), np.uint16)
        if len(full):
            every = np.concatenate([sets[i] for i in full])
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            with np.errstate(over="ignore"):
                for k, (x, m) in enumerate(zip(_XOR, _MUL)):
                    low = np.minimum.reduceat((every ^ x) * m, starts)
                    sig[full, k] = (_spread(low) >> np.uint64(48)).astype(np.uint16)
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"], "no_id": pdf["no_id"], "n_shingles": n,
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) and not none else None
                       for s, none in zip(sets, pdf["no_id"])],
            "sig": [r.tobytes() for r in sig]})


def index_keys(sig: np.ndarray) -> np.ndarray:
    """All index keys of signatures (rows): one column per chunk and choice of values kept."""
    cols = []
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            for kept in combinations(range(CHUNK_SIZE), CHUNK_SIZE - ERRORS):
                k = np.full(len(sig), len(cols) + 1, np.uint64)
                for i in kept:
                    k = _spread(k * np.uint64(65537) + sig[:, c * CHUNK_SIZE + i].astype(np.uint64))
                cols.append(k)
    return np.stack(cols, axis=1)


def _deal_keys(pdf: pd.DataFrame, block: int, shards: int) -> pd.DataFrame:
    """For each shard, the block's distinct keys with the smallest id under each;
    as shard -1, every member of a key that several ids of the block share."""
    pdf = pdf.sort_values("rep")
    ids = pdf["rep"].to_numpy(np.int64)
    sig = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(len(pdf), -1)
    keys = index_keys(sig)
    who = np.repeat(np.arange(len(ids)), keys.shape[1])
    keys = keys.reshape(-1)
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(keys)))
    shared = np.repeat(size > 1, size)
    rows = [(-1, block, keys[shared].tobytes(), ids[who[shared]].tobytes(), b"")] if shared.any() else []
    key, first, many = keys[new], ids[who[new]], size > 1
    shard = key % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    for s, e in zip(cut, np.append(cut[1:], len(shard))):
        at = order[s:e]
        rows.append((int(shard[s]), block, key[at].tobytes(), first[at].tobytes(), many[at].tobytes()))
    return pd.DataFrame(rows, columns=["shard", "block", "keys", "ids", "many"])


def _shared_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """(key, id) of keys that several blocks hold; what blocks have listed is left out."""
    keys = np.frombuffer(b"".join(pdf["keys"]), np.uint64)
    ids = np.frombuffer(b"".join(pdf["ids"]), np.int64)
    many = np.frombuffer(b"".join(pdf["many"]), bool)
    order = np.argsort(keys, kind="stable")
    keys, ids, many = keys[order], ids[order], many[order]
    same = np.zeros(len(keys), bool)
    same[1:] = keys[1:] == keys[:-1]
    shared = same.copy()
    shared[:-1] |= same[1:]
    out = shared & ~many
    return pd.DataFrame({"key": keys[out].view(np.int64), "id": ids[out]})


def _listed(batches):
    for pdf in batches:
        for k, i in zip(pdf["keys"], pdf["ids"]):
            yield pd.DataFrame({"key": np.frombuffer(k, np.int64), "id": np.frombuffer(i, np.int64)})


def _compare(batches, words: int):
    """Rows sorted by (centre, part), the centre's own text first: shingles shared and in all."""
    cut, centre, own = Shingler(words), None, None
    for pdf in batches:
        found = []
        for c, i, text in zip(pdf["centre"], pdf["id"], pdf["text"]):
            s = cut(text)
            if c != centre or i == c:
                centre, own = c, s if i == c else None
            if i != c and own is not None:
                both = len(np.intersect1d(own, s, assume_unique=True))
                found.append((c, i, both, len(own) + len(s) - both))
        yield pd.DataFrame(found, columns=["a", "b", "both", "total"], dtype=np.int64)


def _list_sets(batches, words: int):
    cut = Shingler(words)
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "shingles": [cut(t).tobytes() for t in pdf["text"]]})


def _tile_links(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> pd.DataFrame:
    """One link (a, b) for each text of ``left`` and component of ``right`` that holds a near text."""
    if left.empty or right.empty:
        return pd.DataFrame(columns=["a", "b"], dtype=object)
    rows = [np.frombuffer(x, np.uint64) for x in left["shingles"]]
    cols = [np.frombuffer(x, np.uint64) for x in right["shingles"]]
    both = np.intersect1d(np.concatenate(rows), np.concatenate(cols))
    common = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, len(both), 2048):        # a slice of the shared shingles at a time
        part = both[at:at + 2048]

        def marks(sets):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, x in enumerate(sets):
                here = np.searchsorted(part, x[np.searchsorted(x, part[0]):np.searchsorted(x, part[-1], "right")])
                x = x[np.searchsorted(x, part[0]):np.searchsorted(x, part[-1], "right")]
                m[i, here[part[np.minimum(here, len(part) - 1)] == x]] = 1
            return m
        common += marks(rows) @ marks(cols).T
    n, m = np.array([len(x) for x in rows])[:, None], np.array([len(x) for x in cols])[None, :]
    near = 100 * common.astype(np.int64) >= percent * (n + m - common.astype(np.int64))
    near &= left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
    i, j = np.nonzero(near)
    found = pd.DataFrame({"a": left["id"].to_numpy()[i], "b": right["id"].to_numpy()[j],
                          "component": right["component"].to_numpy()[j]})
    return found.groupby(["a", "component"], as_index=False)["b"].min()[["a", "b"]]


def _texts_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    return texts.join(small_side(ids, PICK_ROWS), "id", "left_semi")


def _measure(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Of distinct pairs (centre, id), those within the radius: a, b, and the full
    sets' shingles in both and in all (written)."""
    of = lambda name: sigs.select(F.col("rep").alias(name), F.col("values").alias(f"{name}_values"))
    same = F.size(F.filter(F.zip_with("centre_values", "id_values", lambda x, y: x == y), lambda x: x))
    near = (pairs.join(of("centre"), "centre").join(of("id"), "id")
            .where(F.lit(CHUNKS * CHUNK_SIZE) - same <= RADIUS).select("centre", "id"))
    near = materialize(near, "near-pairs")
    parts = near.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / STAR_SIZE).alias("parts"))
    member = (near.join(parts, "centre").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts"))
    own = parts.select("centre", F.col("centre").alias("id"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    asked = materialize(member.select("centre", "id", "part").union(own.select("centre", "id", "part")), "near-asked")
    picked = _texts_of(materialize(asked.select("id").distinct(), "near-ids"), texts)
    tasks = (asked.join(picked, "id").withColumn("own", F.col("id") == F.col("centre"))
             .repartition("centre", "part")
             .sortWithinPartitions("centre", "part", F.col("own").desc())
             .select("centre", "id", "text"))
    return materialize(tasks.mapInPandas(lambda it: _compare(it, words), "a long, b long, both long, total long"),
                       "near-measured")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("centre", "id").alias("lo"), F.greatest("centre", "id").alias("hi"))


def _open_members(buckets: DataFrame, links: DataFrame, size) -> DataFrame:
    """(key, id, component) of buckets of a ``size`` that hold several components (written)."""
    comp = components(links)
    member = buckets.join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    split = (member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                       F.count(F.lit(1)).alias("n"))
             .where((F.col("lo") != F.col("hi")) & size(F.col("n"))).select("key"))
    return materialize(member.join(split, "key", "left_semi"), "near-open")


def _other_pairs(left: DataFrame, right: DataFrame, may_link, tried: DataFrame) -> DataFrame:
    """Distinct untried pairs of different components that share a key and may link (written)."""
    there = right.select(*[F.col(c).alias("key" if c == "key" else f"{c}2") for c in right.columns])
    met = left.join(there, (left["key"] == there["key"]) & (F.col("component") != F.col("component2")) & may_link)
    pairs = met.select(F.least("id", "id2").alias("lo"), F.greatest("id", "id2").alias("hi")).distinct()
    return materialize(pairs.join(tried, ["lo", "hi"], "left_anti")
                       .select(F.col("lo").alias("centre"), F.col("hi").alias("id")), "near-tried")


def _large_bucket_links(member: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between different components in large buckets (written)."""
    sizes = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    hub = member.groupBy("key").agg(F.min("id").alias("hub"))
    linked = components(member.join(hub, "key").select("id", "hub").distinct(), "id", "hub")
    odd = (member.join(main, "key").groupBy("id", "component")
           .agg(F.max((F.col("component") != F.col("main")).cast("int")).alias("odd")))
    ids = materialize(odd.join(linked.withColumnRenamed("component", "family"), "id"), "near-open-ids")
    sets = _texts_of(ids.select("id"), texts).mapInPandas(lambda it: _list_sets(it, words), "id long, shingles binary")
    full = materialize(ids.join(sets, "id"), "near-open-sets")
    tiles = full.groupBy("family").agg(F.ceil(F.sum("odd") / ROW_TILE).cast("long").alias("rows"),
                                       F.ceil(F.count(F.lit(1)) / COLUMN_TILE).cast("long").alias("cols"))
    full = full.join(materialize(tiles.where("rows > 0"), "near-tiles"), "family")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = full.where("odd = 1").select("family", F.pmod(F.xxhash64("id"), "rows").alias("r"), each("cols").alias("c"),
                                        "id", "component", "shingles")
    right = full.select(F.col("family").alias("family2"), each("rows").alias("r2"),
                        F.pmod(F.xxhash64("id"), "cols").alias("c2"), F.col("id").alias("id"),
                        F.col("component").alias("component"), F.col("shingles").alias("shingles"))
    return materialize(left.groupBy("family", "r", "c").cogroup(right.groupBy("family2", "r2", "c2"))
                       .applyInPandas(lambda x, y: _tile_links(x, y, percent), "a long, b long"), "near-tile-links")


def near_groups(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    than ``words`` words is one shingle. Two texts are linked if their shingle
    sets have a Jaccard similarity of ``percent`` / 100 or more; a component's
    id is its smallest doc_id, and that document is kept. Null, empty and blank
    texts have no shingles and are linked with nothing: they are kept, and so are rows
    without id. Ids must not repeat with different texts; equal rows share their
    fate (all kept, or all not). An empty table gives an empty result. Other columns
    are not looked at."""
    source = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(0).cast("long")).alias("doc_id"),
                         docs[id_col].isNull().alias("no_id"), docs[text_col].cast("string").alias("text"))
    signed = materialize(source.mapInPandas(lambda it: _sign(it, words),
                                            "doc_id long, no_id boolean, n_shingles long, digest binary, sig binary"), "signed")
    classes = materialize(signed.where("digest is not null").groupBy("digest")
                          .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "near-classes")
    n = classes.count()
    blocks = max(1, -(-n // block_docs))
    shards = max(1, -(-n * CHUNKS * 15 // SHARD_KEYS), blocks // 8)
    dealt = materialize(
        classes.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks))).groupBy("block")
        .applyInPandas(lambda key, pdf: _deal_keys(pdf, int(key[0]), shards),
                       "shard long, block long, keys binary, ids binary, many binary"), "near-keys")
    across = dealt.where("shard >= 0").groupBy("shard").applyInPandas(_shared_keys, "key long, id long")
    inside = dealt.where("shard < 0").select("keys", "ids").mapInPandas(_listed, "key long, id long")
    buckets = materialize(across.union(inside), "near-buckets")

    values = F.transform(F.sequence(F.lit(0), F.lit(CHUNKS * CHUNK_SIZE - 1)),
                         lambda i: F.substring("sig", (2 * i + 1), F.lit(2)))
    sigs = classes.select("rep", values.alias("values"))
    texts = source.where("not no_id").select(F.col("doc_id").alias("id"), "text")

    def measure(pairs):
        return _measure(pairs, sigs, texts, words)

    def links(measured):
        return measured.where(100 * F.col("both") >= percent * F.col("total")).select("a", "b")

    # 1. everybody with the smallest id of each bucket: an eighth of the keys, then those still apart
    hub = buckets.groupBy("key").agg(F.min("id").alias("centre"))
    star = materialize(buckets.where("pmod(key, 8) = 0").join(hub, "key").where("id <> centre")
                       .select("centre", "id").distinct(), "near-tried")
    found, tried = links(measure(star)), _both_ways(star)
    comp = materialize(components(found), "near-components")
    placed = (buckets.join(hub, "key").where("id <> centre").select("centre", "id").distinct()
              .join(comp, "id", "left").withColumn("own", F.coalesce("component", "id")).drop("component")
              .join(comp.select(F.col("id").alias("centre"), "component"), "centre", "left")
              .where(F.col("own") != F.coalesce("component", "centre")))
    star = materialize(_both_ways(placed).distinct().join(tried, ["lo", "hi"], "left_anti")
                       .select(F.col("lo").alias("centre"), F.col("hi").alias("id")), "near-tried")
    found, tried = found.union(links(measure(star))), tried.union(_both_ways(star))
    # 2. small buckets that hold several components: their other pairs
    left = _open_members(buckets, found, lambda n: (n > 2) & (n <= SMALL_BUCKET))
    more = _other_pairs(left, left, F.col("id") < F.col("id2"), tried)
    found = found.union(links(measure(more)))
    # 3. large ones, tile by tile
    left = _open_members(buckets, found, lambda n: n > SMALL_BUCKET)
    if left.limit(1).count():
        found = found.union(_large_bucket_links(left, texts, words, percent))
    comp = components(found).withColumnRenamed("id", "rep")
    of_class = classes.select("digest", "rep").join(comp, "rep", "left") \
        .select("digest", F.coalesce("component", "rep").alias("component"))
    return (signed.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "n_shingles", "digest")
            .join(of_class, "digest", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def keep_one_each(docs: DataFrame, *, id_col: str = "doc_id", **params) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns unchanged."""
    kept = near_groups(docs, id_col=id_col, **params).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")

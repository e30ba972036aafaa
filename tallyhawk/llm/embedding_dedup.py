"""Near-duplicate embeddings by sorted projections, compared in full.

The vectors of a label are dealt by a hash of their id to blocks, and every two
blocks of a label meet in one task, so what is compared depends neither on the
number of partitions nor on how close a label's vectors lie. A task sorts its
blocks by the concatenated bits of 64 random projections from the block's mean
and cuts them into tiles of ``WINDOW`` neighbours. Two tiles whose middles are
further apart than the threshold's angle and their radii hold no link; two that
lie within it as a whole hold nothing but links, which is how near copies of a
vector cost little. All other tiles are compared in double precision. No link
is missed: the bounds only spare work.

Where neither bound helps, as with vectors that point everywhere, the work
grows with the square of the largest label, and a vector is sent once to each
other block of its label.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.llm.common import components
from tallyhawk.session import materialize

WINDOW = 128
BITS = 64
#: Vectors of a label up to which it is one block; above, it is three or more.
SMALL = 1024
#: Vectors of a block.
BLOCK = 16_384
#: Hair's breadth in radians, so that rounding cannot turn a bound the wrong way.
_SLACK = 1e-6


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)     # squares of very large or small components stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(batches):
    """Vectors that can link: no nulls, finite, not zero."""
    for pdf in batches:
        def ok(v):
            if v is None or not len(v):
                return False
            x = np.asarray(v, dtype=np.float64)
            return bool(np.isfinite(x).all() and x.any())
        yield pdf[[ok(v) for v in pdf["v"]]].assign(dim=lambda p: [len(v) for v in p["v"]])


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


class _Sorted:
    """Some rows of a task in the order of their projections, as tiles with middles and radii."""

    def __init__(self, rows: np.ndarray, x: np.ndarray, window: int):
        planes = np.random.RandomState(7919 + x.shape[1]).randn(x.shape[1], BITS)
        bits = np.packbits((x - x.mean(axis=0)) @ planes > 0, axis=1)
        order = np.lexsort(bits.T[::-1])
        self.rows, self.x = rows[order], x[order]
        self.cut = np.append(np.arange(0, len(x), window), len(x))
        self.size = np.diff(self.cut)
        self.middle = np.add.reduceat(self.x, self.cut[:-1], axis=0)
        norm = np.linalg.norm(self.middle, axis=1, keepdims=True)
        self.middle = np.where(norm > 0, self.middle / np.where(norm > 0, norm, 1), self.x[self.cut[:-1]])
        off = _angle(np.einsum("ij,ij->i", self.x, np.repeat(self.middle, self.size, axis=0)))
        self.radius = np.maximum.reduceat(off, self.cut[:-1])


class _Joined:
    """Components of the rows of one task; rows of one component have one number."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Join each i[k] with j[k]."""
        while len(i):
            a, b = self.of[i], self.of[j]
            open_ = np.flatnonzero(a != b)
            if not len(open_):
                return
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, open_], axis=1)
            # each number goes to the smallest that it meets; the numbers met stay to be joined
            up = np.arange(len(self.of))
            np.minimum.at(up, pairs[1], pairs[0])
            while (up[up] != up).any():
                up = up[up]
            self.of = up[self.of]
            i, j = pairs


def _meet(a: _Sorted, b: _Sorted, links: np.ndarray, joined: _Joined, threshold: float) -> None:
    """Count and join the links between ``a`` and ``b``, or inside ``a`` if they are the same."""
    limit, inside = math.acos(threshold), a is b
    for t in range(len(a.size)):
        here = slice(a.cut[t], a.cut[t + 1])
        rows = a.rows[here]
        apart, radii = _angle(b.middle @ a.middle[t]), b.radius + a.radius[t]
        later = np.arange(len(b.size)) >= t if inside else np.ones(len(b.size), bool)
        sure = later & (apart + radii <= limit - _SLACK)
        for u in np.flatnonzero(sure):
            other = b.rows[b.cut[u]:b.cut[u + 1]]
            if inside and u == t:
                links[rows] += len(rows) - 1
            else:
                links[rows] += len(other)
                links[other] += len(rows)
            joined.join(np.full(len(other), rows[0]), other)
            joined.join(np.full(len(rows), rows[0]), rows)
        look = later & ~sure & (apart - radii <= limit + _SLACK)
        if not look.any():
            continue
        at = np.flatnonzero(np.repeat(look, b.size))
        near = a.x[here] @ b.x[at].T >= threshold
        if inside:
            near &= at[None, :] > np.arange(a.cut[t], a.cut[t + 1])[:, None]
        i, j = np.nonzero(near)
        i, j = rows[i], b.rows[at[j]]
        links += np.bincount(i, minlength=len(links)) + np.bincount(j, minlength=len(links))
        joined.join(i, j)


def _compare(pdf: pd.DataFrame, threshold: float, window: int) -> pd.DataFrame:
    """Blocks ``left`` and ``right`` (the same if a label is one block): the links a row
    has in here, and a row of its component. The links inside a block count where it is
    ``left`` and the next block, or itself, is ``right``."""
    pdf = pdf.sort_values("id", ignore_index=True)
    x, block, ids = _unit(pdf["v"]), pdf["block"].to_numpy(), pdf["id"].to_numpy(np.int64)
    links, joined = np.zeros(len(pdf), np.int64), _Joined(len(pdf))
    n, left, right = (int(pdf[c].iat[0]) for c in ("blocks", "left", "right"))
    side = {k: _Sorted(np.flatnonzero(block == k), x[block == k], window) for k in np.unique(block).tolist()}
    if left in side and (right == left or right == (left + 1) % n):
        _meet(side[left], side[left], links, joined, threshold)
    if right in side and right != left and left == (right + 1) % n:
        _meet(side[right], side[right], links, joined, threshold)
    if left != right and len(side) == 2:
        _meet(side[left], side[right], links, joined, threshold)
    linked = np.flatnonzero(links)
    return pd.DataFrame({"a": ids[joined.of[linked]], "b": ids[linked], "n": links[linked]})


def embedding_groups(vectors: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id",
                     vector_col: str = "embedding", label_col: str = "label", window: int = WINDOW) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null, their lengths are
    equal and their cosine, in double precision, is ``threshold`` or more.
    Vectors that are null, empty, zero or hold null or non-finite components,
    and vectors without label, link with nothing. Labels are integers. Ids must
    not be null; rows that repeat an id count as one vector, the least of theirs
    by label and components. An empty table gives an empty result. Other columns are not looked at.
    ``window`` is the size of a tile and has no part in the result."""
    every = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("long").alias("label"),
                           vectors[vector_col].alias("v"))
    complete = (every.where("label is not null and id is not null and v is not null and not exists(v, x -> x is null)")
                .groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.*"))
    usable = materialize(complete.mapInPandas(
        _usable, f"id long, label long, v {vectors.schema[vector_col].dataType.simpleString()}, dim int"), "emb-usable")
    blocks = F.when(F.col("n") <= SMALL, 1).otherwise(F.greatest(F.lit(3), F.ceil(F.col("n") / BLOCK))).cast("int")
    sizes = usable.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).select("label", "dim", blocks.alias("blocks"))
    # every two blocks of a label meet once; a label of one block meets itself
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (F.col("blocks") == 1) | (o != F.col("block")))
    dealt = (usable.join(sizes, ["label", "dim"])
             .withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
             .withColumn("other", F.explode(others))
             .select("label", "dim", "blocks", F.least("block", "other").alias("left"),
                     F.greatest("block", "other").alias("right"), "block", "id", "v"))
    found = materialize(dealt.groupBy("label", "dim", "left", "right").applyInPandas(
        lambda pdf: _compare(pdf, threshold, window), "a long, b long, n long"), "emb-links")
    comp = materialize(components(found.select("a", "b").distinct()), "emb-components")
    links = found.groupBy(F.col("b").alias("id")).agg(F.sum("n").alias("n_links"))
    known = comp.join(links, "id")
    return (every.select(F.col("id").alias("vec_id")).join(known.withColumnRenamed("id", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))

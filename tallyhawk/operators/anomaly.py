"""Isolation forest fitted and applied as distributed jobs.

1. Sample: each tree takes the ψ = min(256, n) rows with the smallest hash of
   (InvoiceID, seed, tree), independent of partitioning. Rows are pre-filtered
   per tree at about 4ψ/n, so only ~4ψ rows per tree are sorted; a tree short
   of ψ survivors is re-drawn with a wider filter (exact, no cap).
2. Grow: ``groupBy(tree).applyInPandas`` — one task per tree, ≤ ψ rows each.
3. Collect the node table (≤ trees × (2ψ − 1) rows, bounded) and broadcast it.
4. Score: a vectorised pandas UDF walks all trees for a batch of rows.
5. Cut: exact 0.98 quantile of the raw score (distributed order statistic);
   ML_AnomalyScore = s − q, flagged when s ≥ q (ties at the cut all flagged).
Method: Liu, Ting, Zhou, "Isolation Forest", ICDM 2008.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyhawk.operators.features import anomaly_features, feature_vector
from tallyhawk.operators.quantiles import exact_quantile
from tallyhawk.session import materialize

TREES = 100
CONTAMINATION = 0.02
SEED = 42
MAX_SAMPLES = 256
OVERSAMPLE = 4.0
EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int, leaf boolean")


def avg_path(m: np.ndarray | float) -> np.ndarray:
    """c(m): average path length of an unsuccessful search in a BST of m points."""
    m = np.asarray(m, dtype=np.float64)
    out = np.zeros_like(m)
    out = np.where(m == 2, 1.0, out)
    big = m > 2
    out = np.where(big, 2.0 * (np.log(np.where(big, m - 1, 1)) + EULER_GAMMA)
                   - 2.0 * (m - 1) / np.where(big, m, 1), out)
    return out


def _unit_hash(key, seed, tree) -> F.Column:
    h = F.xxhash64(key, F.lit(seed), tree)
    return F.pmod(h, F.lit(1 << 53)).cast("double") / float(1 << 53)


def _samples(feats: DataFrame, n: int, psi: int, trees: int, seed: int) -> DataFrame:
    """(tree, key, x) with exactly ψ rows per tree: the ψ smallest hashes (written)."""
    p = min(1.0, OVERSAMPLE * psi / n)
    while True:
        # a row for each tree, dropped as soon as it is hashed: compiled, unlike a filter over an array
        ex = (feats.select("key", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
                   .withColumn("h", _unit_hash(F.col("key"), seed, F.col("tree"))).where(F.col("h") < p))
        w = Window.partitionBy("tree").orderBy("h", "key")
        picked = materialize(ex.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r"),
                             "forest-sample")
        full = picked.groupBy("tree").count().where(F.col("count") >= psi).count()
        if full == trees or p >= 1.0:
            return picked
        p = min(1.0, p * 4)


def _grow(trees_seed: int, max_depth: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("key")
        X = np.stack(pdf["x"].to_numpy()).astype(np.float64)
        rng = np.random.default_rng([trees_seed, tree])
        rows = []

        def node(idx, depth):
            nid = len(rows)
            rows.append(None)
            sub = X[idx]
            if depth >= max_depth or len(idx) <= 1:
                rows[nid] = (tree, nid, -1, 0.0, -1, -1, len(idx), depth, True)
                return nid
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if usable.size == 0:
                rows[nid] = (tree, nid, -1, 0.0, -1, -1, len(idx), depth, True)
                return nid
            f = int(rng.choice(usable))
            thr = float(rng.uniform(lo[f], hi[f]))
            go_left = sub[:, f] < thr
            left = node(idx[go_left], depth + 1)
            right = node(idx[~go_left], depth + 1)
            rows[nid] = (tree, nid, f, thr, left, right, len(idx), depth, False)
            return nid

        node(np.arange(len(X)), 0)
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right",
                                           "size", "depth", "leaf"])
    return build


def fit_isolation_forest(feats: DataFrame, trees: int = TREES, seed: int = SEED,
                         max_samples: int = MAX_SAMPLES) -> dict | None:
    """The forest of a written table (key, x) as packed numpy arrays (small:
    ≤ trees × 511 nodes); none for an empty table."""
    n = feats.count()
    if not n:
        return None
    psi = min(max_samples, n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    sample = _samples(feats, n, psi, trees, seed)
    nodes = sample.groupBy("tree").applyInPandas(_grow(seed, max_depth), NODE_SCHEMA)
    pdf = nodes.toPandas().sort_values(["tree", "node"])  # bounded node table
    width = int(pdf.groupby("tree")["node"].max().max()) + 1
    shape = (trees, width)
    arr = {k: np.zeros(shape, dtype=t) for k, t in
           [("feature", np.int32), ("threshold", np.float64), ("left", np.int32), ("right", np.int32),
            ("size", np.float64), ("depth", np.float64), ("leaf", bool)]}
    arr["leaf"][:] = True
    for col in arr:
        arr[col][pdf["tree"].to_numpy(), pdf["node"].to_numpy()] = pdf[col].to_numpy()
    arr["psi"] = psi
    arr["max_depth"] = max_depth
    return arr


def _complete_trees(f: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, path length) of the trees filled up to their full depth: the children of place i are
    2i + 1 and 2i + 2, and every place of the last level has the path length of the leaf it lies under."""
    trees, depth = f["feature"].shape[0], int(f["max_depth"])
    inner = (1 << depth) - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.zeros((trees, inner))
    at = np.zeros((trees, 1), np.int64)
    own = np.arange(trees)[:, None]
    for level in range(depth):
        leaf = f["leaf"][own, at]
        here = slice((1 << level) - 1, (2 << level) - 1)
        feature[:, here] = np.where(leaf, 0, f["feature"][own, at])
        threshold[:, here] = f["threshold"][own, at]
        children = np.stack([np.where(leaf, at, f["left"][own, at]), np.where(leaf, at, f["right"][own, at])], axis=2)
        at = children.reshape(trees, -1)
    return feature, threshold, f["depth"][own, at] + avg_path(f["size"][own, at])


#: Rows that walk the trees at a time: their columns stay in a core's cache.
SCORE_BLOCK = 4096


def _path_sums(X: np.ndarray, feature: np.ndarray, threshold: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sum of the path lengths of every row over all trees, added in the order of the trees."""
    total = np.zeros(len(X))
    depth = feature.shape[1].bit_length()
    for start in range(0, len(X), SCORE_BLOCK):
        x = X[start:start + SCORE_BLOCK]
        flat, row = x.ravel(), np.arange(len(x)) * X.shape[1]
        for t in range(len(feature)):
            cur = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                right = ~(flat.take(row + feature[t].take(cur)) < threshold[t].take(cur))   # NaN goes right
                cur = 2 * cur + 1 + right
            total[start:start + len(x)] += length[t].take(cur - feature.shape[1])
    return total


def _score_fn(bforest):
    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = bforest.value
        complete = _complete_trees(f)
        for x in batches:
            X = np.stack(x.to_numpy()).astype(np.float64) if len(x) else np.zeros((0, 1))
            mean = _path_sums(X, *complete) / f["feature"].shape[0]
            yield pd.Series(np.power(2.0, -mean / float(avg_path(f["psi"]))))
    return score


def run_isolation_forest(df: DataFrame, trees: int = TREES, seed: int = SEED,
                         contamination: float = CONTAMINATION, max_samples: int = MAX_SAMPLES) -> DataFrame:
    """D1–D3 on an invoice table: adds ML_AnomalyScore and ML_IsAnomaly."""
    spark = df.sparkSession
    # the vendor aggregate and its join back are computed once
    feats = materialize(anomaly_features(df).select(*[df[c] for c in df.columns], feature_vector(None).alias("_x")),
                        "forest-features")
    forest = fit_isolation_forest(feats.select(F.col("InvoiceID").alias("key"), F.col("_x").alias("x")),
                                  trees, seed, max_samples)
    if forest is None:
        return df.withColumns({"ML_AnomalyScore": F.lit(None).cast("double"), "ML_IsAnomaly": F.lit(False)})
    bf = spark.sparkContext.broadcast(forest)
    scored = feats.withColumn("_s", _score_fn(bf)(F.col("_x")))
    scored = materialize(scored, "forest-scores")  # the quantile reads the scores twice
    q = exact_quantile(scored, "_s", 1.0 - contamination, name="_q").select("_q")
    out = scored.crossJoin(F.broadcast(q))  # one row
    keep = [c for c in df.columns]
    return out.select(*keep, (F.col("_s") - F.col("_q")).alias("ML_AnomalyScore"),
                      (F.col("_s") >= F.col("_q")).alias("ML_IsAnomaly"))

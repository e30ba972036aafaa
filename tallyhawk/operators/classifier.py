"""Fraud classifier (one-hot vendor + three numbers → random forest).

Every vendor is a column of its own and every distinct number a threshold: nothing is hashed to slots or binned. The
one-hot columns are never made: a row is a vendor's code and three numbers, some 40 bytes.
All trees grow together, one level a pass. A task draws each row's weight in each tree from a hash of the row, walks it down
to its open node, and counts labels by vendor and by number for the columns that the node has drawn. One
record a task and tree is sent; the counts of a tree meet in one task, which picks its splits. The driver holds the
splits (at most 511 nodes a tree) and, for a level, the columns drawn by its nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhawk.functions.joins import bounded_broadcast
from tallyhawk.operators.features import behaviour_features, days_since_last
from tallyhawk.operators.ordinal import with_ordinal
from tallyhawk.session import materialize, session_conf

TREES, DEPTH, SEED = 200, 8, 42
LABEL = "IsFraudLabel"
NUMERIC = ["Amount", "VendorInvoiceCount", "DaysSinceLastInvoice"]
VENDOR = len(NUMERIC)      #: the feature number of a split by vendor
#: Rows a task holds at a time, and rows that go down a tree at a time (they stay in a cache).
PIECE, BLOCK = 1_000_000, 32_768
#: Vendors (some 40 bytes each) that are broadcast to the invoices.
VENDOR_ROWS = 500_000
#: Work is many times that of reading, so tasks read little.
_READ = {"spark.sql.files.maxPartitionBytes": "16MB"}
_LEAST_GAIN = 1e-12
_TIMES, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _poisson() -> np.ndarray:
    """Weights of a bootstrap, Poisson with mean 1, by 16 random bits."""
    p, left, out = np.exp(-1.0), 1 << 16, np.zeros(1 << 16, np.uint8)
    at = 0
    for k in range(1, 10):
        at += round(p * (1 << 16))
        out[min(at, left):] = k
        p /= k
    return out


_WEIGHTS = _poisson()


def classifier_features(df: DataFrame) -> DataFrame:
    return days_since_last(behaviour_features(df))


def _coded(feats: DataFrame, vendors: DataFrame) -> DataFrame:
    """With ``_code`` of the vendor (−1: none or unknown) and the numbers as doubles (NaN: none)."""
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_x{i}") for i, c in enumerate(NUMERIC)]
    known = bounded_broadcast(vendors.withColumnRenamed("Vendor", "_vendor"), VENDOR_ROWS)
    return feats.join(known, F.col("Vendor") == F.col("_vendor"), "left").select(
        "*", F.coalesce("_known", F.lit(-1)).cast("int").alias("_code"), *numbers).drop("_vendor", "_known")


class Forest:
    """Nodes of all trees by place in a heap: ``feature`` (−1: a leaf), ``value`` (a threshold or a vendor's code) and ``counts`` of labels."""

    def __init__(self, trees: int, depth: int, classes: int):
        size = 2 ** (depth + 1) - 1
        self.feature = np.full((trees, size), -1, np.int8)
        self.value = np.full((trees, size), np.nan)
        self.counts = np.zeros((trees, size, classes))

    def walk(self, tree: int, code: np.ndarray, x: np.ndarray, levels: int):
        """(rows, nodes) of rows that are not in a leaf above after so many levels."""
        feature, value = self.feature[tree], self.value[tree]
        vendor = np.where(feature == VENDOR, value, -2).astype(np.int64)
        rows, node = None, np.zeros(len(code), np.int64)
        for _ in range(levels):
            f = feature[node]
            inner = f >= 0
            if not inner.all():
                inner = np.flatnonzero(inner)
                rows, node, f = inner if rows is None else rows[inner], node[inner], f[inner]
            right = (code if rows is None else code[rows]) != vendor[node]
            number = np.flatnonzero(f != VENDOR)
            if len(number):
                at = number if rows is None else rows[number]
                right[number] = ~(x[f[number], at] <= value[node[number]])
            node = 2 * node + 1 + right
        return (np.arange(len(code)) if rows is None else rows), node

    def scores(self, code: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of each class's share of the row's leaf."""
        total = self.counts.sum(axis=2, keepdims=True)
        share = self.counts / np.where(total > 0, total, 1.0)
        out = np.zeros((len(code), self.counts.shape[2]))
        for s in range(0, len(code), BLOCK):
            c, y = code[s:s + BLOCK], x[:, s:s + BLOCK]
            for t, feature in enumerate(self.feature):
                vendor = np.where(feature == VENDOR, self.value[t], -2).astype(np.int64)
                leaf, rows, node = np.zeros(len(c), np.int64), np.arange(len(c)), np.zeros(len(c), np.int64)
                while len(rows):
                    f = feature[node]
                    if (f < 0).any():
                        leaf[rows[f < 0]] = node[f < 0]
                        rows, node, f = rows[f >= 0], node[f >= 0], f[f >= 0]
                    right = c[rows] != vendor[node]
                    number = np.flatnonzero(f != VENDOR)
                    right[number] = ~(y[f[number], rows[number]] <= self.value[t][node[number]])
                    node = 2 * node + 1 + right
                out[s:s + BLOCK] += share[t][leaf]
        total = out.sum(axis=1, keepdims=True)
        return out / np.where(total > 0, total, 1.0)


def _drawn(tree: int, node: int, columns: int) -> np.ndarray:
    """The columns a node may split by, √columns of them: 0 … 2 the numbers, then the vendors."""
    n = int(np.ceil(np.sqrt(columns)))
    return np.random.default_rng([SEED, tree, node]).choice(columns, n, replace=False, shuffle=False)


def _level_counts(batches, forest: Forest, level: int, drawn: dict, vendors: int):
    """For each tree the labels' weights in its open nodes: in all, by (node, vendor) and by (node, number), where drawn."""
    nodes, classes = 1 << level, forest.counts.shape[2]
    salt = np.random.default_rng(SEED).integers(0, 1 << 63, len(forest.feature)).astype(np.uint64)

    def piece(code, x, label, key):
        order = np.argsort(code, kind="stable")     # rows of a vendor look up what the row before them did
        code, x, label, key = code[order], x[:, order], label[order], key[order]
        for tree, of in drawn.items():
            here = np.zeros(nodes, bool)
            by_vendor, by_number = np.zeros((vendors + 1, nodes), bool), np.zeros((VENDOR, nodes), bool)
            for k, columns in of.items():
                here[k] = True
                by_vendor[columns[columns >= VENDOR] - VENDOR, k] = True
                by_number[columns[columns < VENDOR], k] = True
            flat = by_vendor.ravel()                # the last row is that of no vendor, code −1
            total, met, found = np.zeros(nodes * classes), [], []
            for s in range(0, len(code), BLOCK):
                z = (key[s:s + BLOCK] ^ salt[tree]) * _TIMES
                z = (z ^ (z >> np.uint64(32))) * _AGAIN
                w = _WEIGHTS[z >> np.uint64(48)]
                bag = np.flatnonzero(w)
                c, y = code[s + bag], x[:, s + bag]
                rows, node = forest.walk(tree, c, y, level)
                node -= nodes - 1
                if not here.all():
                    open_ = here[node]
                    rows, node = rows[open_], node[open_]
                c, lab, w = c[rows], label[s + bag[rows]], w[bag[rows]]
                total += np.bincount(node * classes + lab, w, nodes * classes)
                hit = np.flatnonzero(flat[c * nodes + node])   # code −1 counts from the end: the last row
                met.append(((node[hit] * vendors + c[hit]) * classes + lab[hit], w[hit]))
                for f in range(VENDOR):
                    hit = np.flatnonzero(by_number[f][node])
                    if len(hit):
                        found.append((node[hit] * VENDOR + f, y[f, rows[hit]], lab[hit], w[hit]))
            keys, n = _summed(*map(np.concatenate, zip(*met)))
            slots, values, counts = _by_value(*map(np.concatenate, zip(*found)), classes) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros((0, classes)))
            yield (tree, total.tobytes(), keys.tobytes(), n.tobytes(), slots.tobytes(), values.tobytes(), counts.tobytes())

    def flush(held):
        code, label, key = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3))
        for row in piece(code, np.concatenate([h[1] for h in held], axis=1), label, key):
            yield pd.DataFrame([row], columns=["tree", "total", "keys", "n", "slots", "values", "counts"])
    held = []
    for pdf in batches:
        held.append((pdf["_code"].to_numpy(np.int64), np.stack([pdf[f"_x{i}"].to_numpy(float) for i in range(VENDOR)]),
                     pdf["_label"].to_numpy(np.int64), pdf["_key"].to_numpy(np.int64).view(np.uint64)))
        if sum(len(h[0]) for h in held) >= PIECE:
            yield from flush(held)
            held = []
    if sum(len(h[0]) for h in held):
        yield from flush(held)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys))


def _by_value(slot, value, label, n, classes: int):
    """Weights by (slot, value) in order, NaN last, one column for each label."""
    order = np.lexsort((value, slot))
    slot, value = slot[order], value[order]
    new = np.ones(len(slot), bool)
    new[1:] = (slot[1:] != slot[:-1]) | ((value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1])))
    group = np.cumsum(new) - 1
    counts = np.bincount(group * classes + label[order], n[order], (group[-1] + 1) * classes if len(group) else 0)
    return slot[new], value[new], counts.reshape(-1, classes)


def _impurity(counts: np.ndarray) -> np.ndarray:
    """Gini impurity times weight."""
    n = counts.sum(axis=-1)
    return n - (counts ** 2).sum(axis=-1) / np.where(n > 0, n, 1.0)


def _splits(pdf: pd.DataFrame, classes: int, vendors: int) -> pd.DataFrame:
    """The best split of each open node of one tree (feature −1: none that gains), with the counts on both sides."""
    def all_of(name, kind):
        return np.concatenate([np.frombuffer(x, kind) for x in pdf[name]])
    total = sum(np.frombuffer(x) for x in pdf["total"]).reshape(-1, classes)
    keys, n = _summed(all_of("keys", np.int64), all_of("n", float))
    pair, at = np.unique(keys // classes, return_inverse=True)
    left = [np.bincount(at * classes + keys % classes, n, len(pair) * classes).reshape(-1, classes)]
    node, feature, value = [pair // vendors], [np.full(len(pair), VENDOR)], [(pair % vendors).astype(float)]
    slots = all_of("slots", np.int64)
    if len(slots):
        c = all_of("counts", float).reshape(-1, classes)
        slot, x, c = _by_value(np.repeat(slots, classes), np.repeat(all_of("values", float), classes),
                               np.tile(np.arange(classes), len(slots)), c.ravel(), classes)
        run = np.cumsum(c, axis=0)
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        below = np.repeat(np.vstack([np.zeros((1, classes)), run])[first], np.diff(np.append(first, len(slot))), axis=0)
        # between a value and the next greater one of the node
        last = np.diff(slot, append=-1) != 0
        after = np.append(x[1:], np.nan)
        middle = x / 2 + after / 2
        cut = np.where(np.isfinite(middle) & (middle < after) & (middle >= x), middle, x)
        some = ~last & ~np.isnan(x)
        left.append((run - below)[some])
        node.append(slot[some] // VENDOR)
        feature.append(slot[some] % VENDOR)
        value.append(cut[some])
    left, node, feature, value = map(np.concatenate, (left, node, feature, value))
    right = total[node] - left
    gain = _impurity(total[node]) - _impurity(left) - _impurity(right)
    gain /= np.maximum(total[node].sum(axis=1), 1.0)
    gain[(left.sum(axis=1) <= 0) | (right.sum(axis=1) <= 0)] = 0.0
    order = np.lexsort((value, feature, -gain, node))
    best = order[np.flatnonzero(np.diff(node[order], prepend=-1))]
    best = best[gain[best] > _LEAST_GAIN]
    found = pd.DataFrame({"node": node[best], "feature": feature[best], "value": value[best], "left": list(left[best]), "right": list(right[best])})
    every = pd.DataFrame({"node": np.flatnonzero(total.sum(axis=1) > 0)})
    out = every.merge(found, on="node", how="left")
    out["feature"] = out["feature"].fillna(-1).astype(int)
    out["total"] = list(total[out["node"]])
    out.insert(0, "tree", pdf["tree"].iloc[0])
    for c in ("left", "right"):
        out[c] = [v if isinstance(v, np.ndarray) else np.zeros(classes) for v in out[c]]
    return out[["tree", "node", "feature", "value", "left", "right", "total"]]


def _grow(rows: DataFrame, vendors: int, classes: int) -> Forest:
    forest = Forest(TREES, DEPTH, classes)
    open_ = {t: [0] for t in range(TREES)}
    context = rows.sparkSession.sparkContext
    for level in range(DEPTH):
        base = (1 << level) - 1
        drawn = {t: {k: _drawn(t, base + k, VENDOR + vendors) for k in ks} for t, ks in open_.items() if ks}
        if not drawn:
            break
        sent = context.broadcast((forest, drawn))

        def count(batches, sent=sent, level=level):
            yield from _level_counts(batches, sent.value[0], level, sent.value[1], vendors)
        made = "tree int, total binary, keys binary, n binary, slots binary, values binary, counts binary"
        with session_conf(rows.sparkSession, _READ):
            found = rows.mapInPandas(count, made).groupBy("tree").applyInPandas(
                lambda pdf: _splits(pdf, classes, max(vendors, 1)),
                "tree int, node int, feature int, value double, left array<double>, right array<double>, total array<double>").collect()
        open_ = {t: [] for t in range(TREES)}
        for x in found:
            at = base + x.node
            forest.counts[x.tree, at] = x.total
            if x.feature < 0:
                continue
            forest.feature[x.tree, at], forest.value[x.tree, at] = x.feature, x.value
            for child, counts in ((2 * at + 1, x.left), (2 * at + 2, x.right)):
                forest.counts[x.tree, child] = counts
                if sum(c > 0 for c in counts) > 1:
                    open_[x.tree].append(child - 2 * base - 1)
        sent.destroy()
    return forest


class FraudModel:
    """A forest and the codes of its vendors; the features of the table it learnt from are kept for its own scores."""

    def __init__(self, forest: Forest, vendors: DataFrame, trained: DataFrame, features: DataFrame):
        self.forest, self.vendors, self._trained, self._features = forest, vendors, trained, features

    def transform(self, df: DataFrame) -> DataFrame:
        """With ``probability`` (one share for each label) and ``prediction``, the label of the greatest."""
        feats = _coded(self._features if df is self._trained else classifier_features(df), self.vendors)
        sent = feats.sparkSession.sparkContext.broadcast(self.forest)

        @F.pandas_udf("array<double>")
        def probability(code: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(list(sent.value.scores(code.to_numpy(np.int64), np.stack([a.to_numpy(float), b.to_numpy(float), c.to_numpy(float)]))))
        p = F.col("probability")
        out = feats.withColumn("probability", probability("_code", "_x0", "_x1", "_x2"))
        return out.withColumn("prediction", (F.array_position(p, F.array_max(p)) - 1).cast("double")).drop("_code", "_x0", "_x1", "_x2")


def train_classifier(df: DataFrame) -> FraudModel:
    """D4. HighValueInvoice and HasPO are computed but, as in the original, not
    used by the model (its column transformer names only four inputs). Rows without a label take no part."""
    feats = classifier_features(df)
    vendors = df.select("Vendor").where(F.col("Vendor").isNotNull()).distinct()
    vendors = materialize(with_ordinal(vendors, ["Vendor"], "_known"), "forest-vendors")
    # rows that are equal in every column share their weights
    key = F.xxhash64(*[F.col(c).cast("string") for c in df.columns])
    rows = materialize(_coded(feats, vendors).where(F.col(LABEL).isNotNull()).select(
        "_code", *[f"_x{i}" for i in range(len(NUMERIC))], F.col(LABEL).cast("int").alias("_label"), key.alias("_key")), "forest-rows")
    classes = max(2, (rows.agg(F.max("_label")).first()[0] or 0) + 1)
    return FraudModel(_grow(rows, vendors.count(), classes), vendors, df, feats)


def predict_fraud(model: FraudModel, df: DataFrame) -> DataFrame:
    """D5."""
    return model.transform(df).withColumn("fraud_probability", F.col("probability")[1])

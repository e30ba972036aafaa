"""A trained text embedding by randomised singular value decomposition.

The matrix is the sparse table of (row, term, weight), weights as in I15 with all
rows as one collection, each row of unit length. It is written as cells: the terms are dealt
to blocks by hash, the rows to chunks of ``CHUNK``, and one record holds the counts of one chunk
in one block. Random term vectors are drawn from hashes of the terms. A sweep gives
each block to one task, which reads its records in order of chunk: the row vectors of
each chunk are summed into the term vectors of the block, and these into the row vectors again.
Only dense row vectors travel, once a block and not once a count; a task holds the term vectors of
its block (at most some ``BLOCK_TERMS``) and one chunk. Between sweeps the rows are made orthonormal through
their Gram matrix. The driver holds only square matrices of ``dim + OVERSAMPLE`` rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhawk.operators.textmine import token_array
from tallyhawk.session import materialize, session_conf

OVERSAMPLE, POWER_ROUNDS, SEED = 16, 2, 7
_EPS = 1e-10
#: Blocks of terms: this many, more if a block would hold more than so many terms.
BLOCKS, BLOCK_TERMS = 4, 1_000_000
#: Rows of a chunk, a power of two.
CHUNK = 1024
#: Records have up to some hundred KB: bytes bound a batch, not rows alone.
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "32MB"}


def _terms(rows: DataFrame) -> DataFrame:
    """(id, key, term, tf, len, most) written; ``id`` numbers the keys with terms within their partition.

    Rows with one key are one row of the matrix; ``most`` is the greatest length among them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = Window.partitionBy("key")
    toks = (rows.repartition(parts, "key").select("key", token_array(F.col("text")).alias("toks"))
            .withColumn("len", F.size("toks")).where("len > 0").withColumn("id", F.monotonically_increasing_id())
            .withColumn("id", F.min("id").over(same)).withColumn("most", F.max("len").over(same)))
    return materialize(toks.select("id", "key", "len", "most", F.explode("toks").alias("term")).groupBy("id", "key", "len", "most", "term")
                       .agg(F.count(F.lit(1)).cast("int").alias("tf")), "latent-terms")


def _idf(terms: DataFrame, n: int) -> DataFrame:
    return materialize(terms.groupBy("term").agg((F.log(F.lit(n + 1.0) / (F.count(F.lit(1)) + 1)) + 1.0).alias("idf")), "latent-idf")


def _weights(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matrix as a table: (key, term, w) of unit rows, and (term, idf) learnt from them."""
    terms = _terms(rows)
    idf = _idf(terms, rows.count())
    raw = terms.join(idf, "term").select("key", "term", (F.col("tf") / F.col("len") * F.col("idf")).alias("w"))
    norm = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    return raw.join(norm, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("w")), idf


def _placed(idf: DataFrame) -> DataFrame:
    """Terms with their block and their place in it (from 0), written."""
    blocks = max(BLOCKS, -(-idf.count() // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int")
    slot = F.row_number().over(Window.partitionBy("block").orderBy("term")) - 1
    return materialize(idf.withColumn("block", block).withColumn("slot", slot), "latent-places")


def _cells(terms: DataFrame, placed: DataFrame) -> DataFrame:
    """The counts as written records (block, chunk, steps, pos, tf) in order of term: steps from place to place.

    ``tf`` is the count, greater in the shorter ones of texts with one key. Rows without a key take no part."""
    def pack(pdf):
        pdf = pdf.sort_values(["slot", "pos"])
        steps = np.diff(pdf["slot"].to_numpy(np.int32), prepend=np.int32(0)).astype(np.int32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "chunk": pdf["chunk"].iloc[:1], "steps": [steps.tobytes()],
                             "pos": [pdf["pos"].to_numpy(np.int16).tobytes()], "tf": [pdf["tf"].to_numpy(float).tobytes()]})
    cells = terms.where("key is not null").join(placed.select("term", "block", "slot"), "term").select(
        "block", "slot", F.floor(F.col("id") / CHUNK).alias("chunk"), (F.col("id") % CHUNK).cast("int").alias("pos"),
        (F.col("tf") * F.col("most") / F.col("len")).alias("tf"))
    return materialize(cells.groupBy("block", "chunk").applyInPandas(
        pack, "block int, chunk long, steps binary, pos binary, tf binary"), "latent-matrix")


def _gaussian(term: Column, width: int, seed: int) -> Column:
    """``width`` normal numbers drawn from hashes of the term."""
    def uniform(i, salt):
        return (F.pmod(F.xxhash64(term, i, F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.transform(F.sequence(F.lit(1), F.lit(width)),
                       lambda i: F.sqrt(-2.0 * F.log(uniform(i, 1))) * F.cos(2.0 * np.pi * uniform(i, 2)))


def _stack(column) -> np.ndarray:
    return np.stack(column.to_numpy())


def _add_products(out: np.ndarray, at: np.ndarray, vectors: np.ndarray, of: np.ndarray, times: np.ndarray) -> None:
    """Add ``times`` x the row ``of`` of ``vectors`` to the row ``at`` (ascending) of ``out``, in pieces that stay in a cache."""
    for i in range(0, len(at), 1024):
        part = vectors.take(of[i:i + 1024], axis=0)
        part *= times[i:i + 1024, None]
        rows = at[i:i + 1024]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        out[rows[first]] += np.add.reduceat(part, first, axis=0)


def _sweep(cells: DataFrame, placed: DataFrame, width: int, rows: DataFrame | None = None, back: bool = True) -> DataFrame:
    """One task a block; ``placed`` has the term vectors ``vec``, or ``rows`` (chunk, s, x) gives vectors to sum into them.

    ``back``: (chunk, y), for each block the sum over its terms of weight times term vector, without the scale of the rows
    (and with the term vectors given, the squares of the weights as a last column). Else (term, idf, block, slot, vec)."""
    # step 0: the terms of a block; 1: row vectors and then counts of a chunk; 2: the counts again
    none = F.lit(None)
    start = "vec" in placed.columns
    vectors = placed.schema["vec"].dataType if start else "array<double>"
    head = placed.select("block", F.lit(0).alias("step"), F.col("slot").cast("long").alias("chunk"), "idf",
                         (none.cast("string") if back else F.col("term")).alias("term"),
                         (F.col("vec") if start else none.cast(vectors)).alias("vec"),
                         *[none.cast("binary").alias(c) for c in ("x", "steps", "pos", "tf")])

    def counts(step):
        return cells.select("block", F.lit(step).alias("step"), "chunk", none.cast("double").alias("idf"), none.cast("string").alias("term"),
                            none.cast(vectors).alias("vec"), none.cast("binary").alias("x"), "steps", "pos", "tf")
    stream = head.unionByName(counts(2)) if back else head
    if rows is not None:
        sent = cells.select("block", "chunk").join(rows.select("chunk", "x"), "chunk").select(
            "block", F.lit(1).alias("step"), "chunk", none.cast("double").alias("idf"), none.cast("string").alias("term"),
            none.cast(vectors).alias("vec"), "x", *[none.cast("binary").alias(c) for c in ("steps", "pos", "tf")])
        stream = stream.unionByName(sent).unionByName(counts(1))

    def flush(block, names, idf, side):
        for i in range(0, len(idf) if block is not None else 0, 8192):
            yield pd.DataFrame({"term": names[i:i + 8192], "idf": idf[i:i + 8192], "block": block,
                                "slot": np.arange(i, min(i + 8192, len(idf))), "vec": list(side[i:i + 8192] * idf[i:i + 8192, None])})

    def run(batches):
        block, x, names, parts, vecs, idf, side, scaled = None, None, [], [], [], None, None, False
        for batch in batches:
            for (b, step), g in batch.groupby(["block", "step"], sort=True):
                if b != block:
                    if not back and side is not None:
                        yield from flush(block, names, idf, side)
                    block, names, parts, vecs, idf, side, scaled = b, [], [], [], None, None, False
                if step == 0:
                    parts.append(g["idf"].to_numpy())
                    if start:
                        vecs.append(_stack(g["vec"]).astype(float))
                    if not back:
                        names.extend(g["term"])
                    continue
                if idf is None:
                    idf = np.concatenate(parts)
                    side = np.concatenate(vecs) if start else np.zeros((len(idf), width))
                    parts, vecs = [], []
                if step == 2 and not scaled:
                    side *= (idf if start else idf * idf)[:, None]
                    scaled = True
                out = []
                for c, sent_x, steps, pos, tf in zip(g["chunk"], g["x"], g["steps"], g["pos"], g["tf"]):
                    if sent_x is not None:
                        x = np.frombuffer(sent_x).reshape(CHUNK, -1)
                        continue
                    slot, pos = np.cumsum(np.frombuffer(steps, np.int32)), np.frombuffer(pos, np.int16).astype(np.int64)
                    tf = np.frombuffer(tf)
                    if step == 1:
                        _add_products(side, slot, x, pos, tf)
                    else:
                        y = np.zeros((CHUNK, width + start))
                        order = np.argsort(pos, kind="stable")
                        _add_products(y[:, :width], pos[order], side, slot[order], tf[order])
                        if start:
                            y[:, -1] = np.bincount(pos, (tf * idf[slot]) ** 2, CHUNK)
                        out.append((c, y.tobytes()))
                if out:
                    yield pd.DataFrame(out, columns=["chunk", "y"])
        if not back and side is not None:
            yield from flush(block, names, idf, side)
    made = "chunk long, y binary" if back else "term string, idf double, block int, slot int, vec array<double>"
    blocks = (placed.agg(F.max("block")).first()[0] or 0) + 1
    order = ["block", "step", "chunk", F.col("x").isNull()]
    return stream.repartition(blocks, "block").sortWithinPartitions(*order).mapInPandas(run, made)


def _added(parts) -> np.ndarray:
    total = 0.0
    for y in parts:
        total = total + np.frombuffer(y).reshape(CHUNK, -1)
    return total


def _first_rows(parts: DataFrame) -> DataFrame:
    """The sums of a sweep from given term vectors: (chunk, s, y), s the scale that gives rows of weights unit length."""
    def run(pdf):
        y = _added(pdf["y"])
        s = np.where(y[:, -1] > 0, 1.0, 0.0) / np.sqrt(np.where(y[:, -1] > 0, y[:, -1], 1.0))
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "s": [s.tobytes()], "y": [(y[:, :-1] * s[:, None]).tobytes()]})
    with session_conf(parts.sparkSession, _BATCH):
        return materialize(parts.groupBy("chunk").applyInPandas(run, "chunk long, s binary, y binary"), "latent-rows")


def _next_rows(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """The sums of a sweep from ``rows``: (chunk, s, y, g), g the products of a chunk's vectors before and after."""
    def run(pdf, old):
        s, x = np.frombuffer(old["s"].iloc[0]), np.frombuffer(old["x"].iloc[0]).reshape(CHUNK, -1)
        y = _added(pdf["y"])
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "s": [s.tobytes()], "y": [(y * s[:, None]).tobytes()],
                             "g": [(x.T @ y).ravel()]})
    with session_conf(parts.sparkSession, _BATCH):
        return materialize(parts.groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInPandas(
            run, "chunk long, s binary, y binary, g array<double>"), "latent-rows")


def _basis(rows: DataFrame, m: np.ndarray) -> DataFrame:
    """(chunk, s, x): every row vector times a small matrix and times the row's scale."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"chunk": pdf["chunk"], "s": pdf["s"], "x": [
                ((np.frombuffer(y).reshape(CHUNK, -1) @ m) * np.frombuffer(s)[:, None]).tobytes() for s, y in zip(pdf["s"], pdf["y"])]})
    return rows.select("chunk", "s", "y").mapInPandas(run, "chunk long, s binary, x binary")


def _total(matrices: DataFrame, width: int) -> np.ndarray:
    """Sum of the square matrices ``g``."""
    total = matrices.agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g")).first()["g"]
    return np.array(total if total is not None else np.zeros(width * width)).reshape(width, width)


def _gram(vectors: DataFrame, width: int, unpack) -> np.ndarray:
    """Sum of the outer products of all vectors; ``unpack`` makes them a matrix from a batch."""
    def part(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                x = unpack(pdf)
                total += x.T @ x
        yield pd.DataFrame({"g": [total.ravel()]})
    return _total(vectors.mapInPandas(part, "g array<double>"), width)


def _whitening(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes columns of this Gram matrix orthonormal, without columns that depend on others."""
    values, axes = np.linalg.eigh(gram)
    good = values > _EPS * max(values.max(initial=0.0), _EPS)
    return axes[:, good] / np.sqrt(values[good])


def _orthonormal(rows: DataFrame, m: np.ndarray) -> np.ndarray:
    """``m`` times the matrix that makes the vectors of ``rows`` times ``m`` an orthonormal basis of their columns."""
    def unpack(pdf):
        return np.concatenate([np.frombuffer(y).reshape(CHUNK, -1) for y in pdf["y"]]) @ m
    return m @ _whitening(_gram(rows.select("y"), m.shape[1], unpack))


class LatentModel:
    """Term vectors (term, idf, vec), and the singular values of the training matrix."""

    def __init__(self, terms: DataFrame, singular_values: np.ndarray):
        self.terms, self.singular_values, self.dim = terms, singular_values, len(singular_values)

    def embed(self, df: DataFrame, key: str, text_col: str = "text", out_col: str = "embedding") -> DataFrame:
        """``df`` with unit float vectors; a text without a known term gets zeros. Texts with one key
        share a vector, a null key gets zeros."""
        def unit(batches):
            for pdf in batches:
                for c, y in zip(pdf["chunk"], pdf["y"]):
                    y = np.frombuffer(y).reshape(CHUNK, -1)
                    norm = np.sqrt((y * y).sum(axis=1))
                    some = np.flatnonzero(norm > 0)
                    yield pd.DataFrame({"id": c * CHUNK + some, "_unit": list((y[some] / norm[some, None]).astype(np.float32))})
        zeros = F.array_repeat(F.lit(0.0).cast("float"), self.dim)
        if not self.dim:
            return df.withColumn(out_col, zeros)
        terms = _terms(df.select(F.col(key).alias("key"), F.col(text_col).alias("text")))
        with session_conf(df.sparkSession, _BATCH):
            parts = _sweep(_cells(terms, self.terms), self.terms.select("block", "slot", "idf", "vec"), self.dim)
        units = materialize(_first_rows(parts).select("chunk", "y").mapInPandas(unit, "id long, _unit array<float>"), "latent-units")
        found = units.join(terms.select("id", F.col("key").alias("_key")).distinct(), "id").drop("id")
        return (df.join(found, F.col(key) == F.col("_key"), "left").withColumn(out_col, F.coalesce("_unit", zeros))
                .drop("_key", "_unit"))


def fit_latent(df: DataFrame, key: str, text_col: str = "text", dim: int = 64, power_rounds: int = POWER_ROUNDS,
               seed: int = SEED) -> LatentModel:
    """Learn term vectors from all rows of ``df``; at most ``dim``, fewer if the texts span fewer.

    Null or empty texts take no part. Texts with one key are one row; those without only count for the idf."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms = _terms(rows)
    placed = _placed(_idf(terms, rows.count()))
    cells = _cells(terms, placed)
    width = dim + OVERSAMPLE
    y = _first_rows(_sweep(cells, placed.withColumn("vec", _gaussian(F.col("term"), width, seed).cast("array<float>")), width))
    m = _orthonormal(y, np.eye(width))
    for _ in range(power_rounds):
        if not m.shape[1]:
            break
        basis = _basis(y, m)
        y = _next_rows(_sweep(cells, placed, m.shape[1], basis), basis)
        # the products of the rows before and after a sweep are the Gram matrix of the term vectors between them
        m = _orthonormal(y, _whitening(_total(y.select("g"), m.shape[1])))
    width = m.shape[1]
    if not width:
        return LatentModel(placed.select("term", "idf", "block", "slot", F.array().cast("array<double>").alias("vec")).limit(0), np.zeros(0))
    with session_conf(df.sparkSession, _BATCH):
        side = materialize(_sweep(cells, placed, width, _basis(y, m), back=False), "latent-vectors")
    values, axes = np.linalg.eigh(_gram(side.select("vec"), width, lambda pdf: _stack(pdf["vec"])))
    best = np.argsort(-values)[:dim]
    best = best[values[best] > _EPS * max(values.max(), _EPS)]
    sizes = np.sqrt(values[best])
    turn = axes[:, best] / sizes

    def turned(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(vec=list(_stack(pdf["vec"]) @ turn))
    return LatentModel(side.mapInPandas(turned, side.schema), sizes)

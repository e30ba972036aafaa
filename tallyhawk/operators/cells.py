"""An inverted-file index of vectors.

Vectors are dealt to the nearest of a number of k-means centres and written as a
table partitioned by cell. A query reads only the cells of its nearest centres:
the probes are joined to the table on its partition column, so files of other
cells are pruned when the query runs, and the products of a cell's rows with the
queries that probe it are made tile by tile. No pair table exists.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhawk.operators.vectors import TOP_K, cosine_topk

#: Rows that the centres are fitted on, about; all rows are indexed.
SAMPLE_ROWS = 100_000
#: Most cells: their centres are held by the driver and by every task.
MAX_CELLS = 4096
SEED = 11
#: Part of the best rows that a search of the default number of cells should find; how it is measured.
RECALL, TRIAL_QUERIES, TRIAL_K = 0.95, 300, 10


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1.0)


def _nearest(column, centres: np.ndarray, k: int) -> np.ndarray:
    """Of each vector, the ``k`` centres at the least distance from its unit vector."""
    far = (centres ** 2).sum(axis=1)[None, :] - 2.0 * _unit(column) @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :k]


def build_cells(corpus: DataFrame, path: str, cells: int | None = None, corpus_id: str = "vec_id",
                corpus_vec: str = "embedding", sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, seed: int = SEED) -> int:
    """Write the index of ``corpus`` (id, vector) under ``path``, a folder that all executors share; returns the number of cells.

    Default: about the square root of the number of rows. Centres are fitted on a hash sample of about ``sample_rows``
    rows. The number of cells that a search reads is measured on the written index, so that trial queries find
    ``recall`` of their best rows. Null vectors are not indexed."""
    rows = corpus.select(F.col(corpus_id).cast("long").alias("vec_id"), F.col(corpus_vec).alias("embedding")).where("embedding is not null")
    n = rows.count()
    cells = max(1, min(MAX_CELLS, n, cells or math.ceil(math.sqrt(n))))
    part = min(1.0, sample_rows / max(1, n))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    sample = (rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < math.ceil(part * (1 << 20))).withColumn("_n", norm).where("_n > 0")
              .select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.col("_n"))).alias("features")))
    if not sample.limit(1).count():
        centres = np.zeros((1, 1))
    else:
        centres = np.stack(KMeans(k=cells, seed=seed, maxIter=12).fit(sample).clusterCenters())

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=(_nearest(pdf["embedding"], centres, 1)[:, 0] if centres.shape[1] > 1 else 0)).astype({"cell": "int32"})
    kind = rows.schema["embedding"].dataType.simpleString()
    dealt = rows.mapInPandas(assign, f"vec_id long, embedding {kind}, cell int")
    dealt.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path.rstrip('/')}/rows")
    spark = corpus.sparkSession
    written = spark.read.parquet(f"{path.rstrip('/')}/rows")
    probes = _probes_for(written, centres, recall)
    spark.createDataFrame([(i, [float(x) for x in c], probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/centres")
    return len(centres)


def _probes_for(rows: DataFrame, centres: np.ndarray, recall: float) -> int:
    """How many of its nearest cells a query must read so that they hold ``recall`` of its best rows.

    Measured on about ``TRIAL_QUERIES`` rows taken as queries, against all rows."""
    n = rows.count()
    if centres.shape[1] == 1 or not n:
        return 1
    part = max(1, math.ceil(min(1.0, TRIAL_QUERIES / n) * (1 << 20)))
    asked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < part).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query_vec"))
    best = cosine_topk(asked, rows, TRIAL_K).join(rows.select(F.col("vec_id").alias("match_id"), "cell"), "match_id").join(asked, "query_id")

    def places(batches):
        for pdf in batches:
            if len(pdf):
                near = _nearest(pdf["query_vec"], centres, len(centres))
                yield pd.DataFrame({"place": (near == pdf["cell"].to_numpy()[:, None]).argmax(axis=1) + 1})
    counts = best.select("query_vec", "cell").mapInPandas(places, "place int").groupBy("place").count().orderBy("place").collect()   # one row per cell
    total, seen = sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen >= recall * total:
            return int(r["place"])
    return len(centres)


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int = TOP_K, probes: int | None = None,
                 query_id: str = "query_id", query_vec: str = "query_vec") -> DataFrame:
    """(query_id, rank, match_id, score): the ``k`` best rows, by cosine, of the ``probes`` cells nearest to each query
    (default: as many as ``build_cells`` found to be needed).

    With as many probes as cells the result is exact. Null query vectors take no part; fewer than ``k`` rows come
    back if the probed cells hold fewer."""
    found = sorted(spark.read.parquet(f"{path.rstrip('/')}/centres").collect())     # MAX_CELLS rows at most
    centres = np.array([r["centre"] for r in found])
    probes = probes or found[0]["probes"]

    def probe(batches):
        for pdf in batches:
            if len(pdf):
                near = _nearest(pdf["query_vec"], centres, min(probes, len(centres))) if centres.shape[1] > 1 else np.zeros((len(pdf), 1), int)
                at = np.repeat(np.arange(len(pdf)), near.shape[1])
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[at], "query_vec": pdf["query_vec"].to_numpy()[at],
                                    "cell": near.ravel().astype("int32")})
    asked = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(query_vec).cast("array<double>").alias("query_vec")) \
        .where("query_vec is not null")
    from tallyhawk.session import materialize
    probed = materialize(asked.mapInPandas(probe, "query_id long, query_vec array<double>, cell int"), "cell-probes")
    cells = F.broadcast(probed.where("cell >= 0").select("cell").distinct())        # MAX_CELLS rows at most
    rows = spark.read.parquet(f"{path.rstrip('/')}/rows").join(cells, "cell", "left_semi")
    return cosine_topk(probed, rows, k, group_col="cell")

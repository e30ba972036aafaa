"""Session helpers: a builder for local runs and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "tallyhawk", extra: dict | None = None) -> SparkSession:
    """Session for tests and benchmarks. On a cluster use the cluster's session."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


@contextlib.contextmanager
def session_conf(spark: SparkSession, values: dict[str, str]):
    """Settings for the actions inside the block; the old ones come back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def is_local(spark: SparkSession) -> bool:
    """True for ``local[...]`` masters, where driver and tasks share one disk."""
    return spark.sparkContext.master.split("[")[0] == "local"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting is required: a private folder there would lie on
    one machine's disk, so an unset value is an error. Only a ``local`` master
    gets a scratch folder of its own (tests)."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="tallyhawk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    return checkpoint_dir(spark).rstrip("/") + "/" + name


_SCRATCH: dict[str, list[str]] = {}


def materialize(df, tag: str):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` (a lost executor re-reads the files
    instead of recomputing), is columnar (later scans prune columns and push
    filters), and is computed once. Used wherever a derived table is read by
    several branches of one plan or must stay fixed between two passes.

    The table lives until ``release_scratch`` or the end of the Python process."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{tag}-{uuid.uuid4().hex}")
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        _SCRATCH[app] = []
        atexit.register(_release_at_exit, spark, app)
    _SCRATCH[app].append(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables(spark: SparkSession) -> list[str]:
    """Paths of the written tables this application holds, oldest first."""
    return list(_SCRATCH.get(spark.sparkContext.applicationId, []))


def release_scratch(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete written tables (all, or those at ``paths``) and return how many.

    DataFrames that still read them must have been written out before."""
    held = _SCRATCH.get(spark.sparkContext.applicationId, [])
    gone = [p for p in held if paths is None or p in paths]
    held[:] = [p for p in held if p not in gone]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(gone)


def _release_at_exit(spark: SparkSession, app: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
            release_scratch(spark)
    except Exception:  # noqa: BLE001  (the JVM is already gone: nothing to delete through)
        pass


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, wherever the driver imported it from."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tallyhawk-ship-"), "tallyhawk_src.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)

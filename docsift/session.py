"""Spark session helpers.

Library code never creates a session; it takes the caller's.  `local_session`
is for tests, benches and scripts.  `checkpoint_dir` reads the shared folder
the cluster names in ``spark.checkpoint.dir`` and only falls back to a
scratch folder when the setting is absent (local runs).
"""

from __future__ import annotations

import atexit
import contextlib
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "docsift") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; local masters get a scratch one if it is unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="docsift-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_TABLES = itertools.count()
#: Spark then deletes the shuffle files of a job as it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables of this application that nobody has dropped yet: path -> session.
_KEPT: dict[str, SparkSession] = {}


def cut_lineage(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Write `df` as a Parquet table under the shared checkpoint folder and read it back.

    Survives executor loss like a reliable checkpoint, and the re-read plan
    carries the real file sizes as statistics (a checkpointed Dataset keeps
    the size estimate of the plan it replaced, and products of such estimates
    compound over iterative jobs).  The table lives until `drop_table`,
    the end of its `workspace`, or the end of the application.  `row_group`:
    bytes a writing task holds before it writes them out (Parquet's default
    without), for tables of long array columns.  The shuffle files of the job
    that writes the table are deleted with its end.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/t{next(_TABLES):06d}-{uuid.uuid4().hex[:8]}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    _KEPT[path] = spark
    out = spark.read.parquet(path)
    out._docsift_table = path
    return out


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark's file systems reach it."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def _delete(path: str) -> None:
    spark = _KEPT.pop(path, None)
    if spark is not None:
        delete_path(spark, path)


def drop_table(*tables: DataFrame | None) -> None:
    """Delete tables of `cut_lineage` that no plan reads any more (others and None are left alone)."""
    for t in tables:
        path = getattr(t, "_docsift_table", None)
        if path:
            _delete(path)


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[str, Callable[[], DataFrame]], DataFrame]]:
    """Named tables with a life time: `with workspace(spark) as shared: terms = shared("terms", build)`.

    The first call for a name builds and writes the table, later calls read
    it; on leaving the block these tables, and all that were written inside it,
    are deleted.  Results must be written or collected inside the block.
    """
    before = set(_KEPT)
    named: dict[str, DataFrame] = {}

    def shared(name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in named:
            named[name] = cut_lineage(build())
        return named[name]

    try:
        yield shared
    finally:
        for path in [p for p in _KEPT if p not in before]:
            _delete(path)


@atexit.register
def release() -> None:
    """Delete every table this application still has (called when the driver's Python ends)."""
    for path in list(_KEPT):
        try:
            _delete(path)
        except Exception:  # the JVM is gone; the folder goes with the cluster's own clean-up
            _KEPT.pop(path, None)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make `docsift` importable in Python workers (pandas UDF / applyInPandas kernels).

    Zips the installed package once per application and registers it with
    `addPyFile`, which copies it to every executor.
    """
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="docsift-pkg-"), "docsift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)

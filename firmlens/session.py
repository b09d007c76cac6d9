"""Session helper and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: str | None = None
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "firmlens", cores: str | int = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the cluster's own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    A private temporary folder is used only for a local master without that setting; on a cluster a
    machine-local folder would be lost with its machine, so a missing setting is an error there.
    """
    global _LOCAL_ROOT
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_ROOT


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables with the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that ``materialise`` writes inside the block are removed when it ends, by an error too.

    What the block returns must not read them: write it with ``outer=True``.
    """
    path = f"{shared_root(spark)}/firmlens/{spark.sparkContext.applicationId}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set((*_SCRATCH.get(), path))
    try:
        yield path
    finally:
        _SCRATCH.reset(token)
        remove(spark, path)


def materialise(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where two branches must see the *same* physical rows (partition ids of a sampled range
    partitioning) and for stage tables that many later steps read. Survives lost executors.
    The table lies in the folder of the innermost ``scratch`` block, with ``outer`` in that of the block around it.
    Shuffle files of the plan are not needed once its rows are written, so they go at once.
    """
    spark = df.sparkSession
    blocks = _SCRATCH.get()[:-1] if outer else _SCRATCH.get()
    folder = blocks[-1] if blocks else f"{shared_root(spark)}/firmlens/{spark.sparkContext.applicationId}"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_SHUFFLES, None)
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_SHUFFLES)
        else:
            spark.conf.set(_CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Jobs started inside the block send Python at most ``rows`` rows and about ``size`` bytes at a time, so that memory does not follow long rows."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so jobs may start from any folder."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "firmlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("firmlens", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)

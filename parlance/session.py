"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings a cluster session should carry. Nothing here fixes a size that must grow with the data:
# AQE coalesces shuffle partitions down and splits skewed join partitions at run time, and a side is
# broadcast only when Spark's own size estimate is below spark.sql.autoBroadcastJoinThreshold.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cores: int | str = 8, app: str = "parlance", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_code()
    return spark


def ship_code() -> None:
    """Send this package's functions to the executors by value, so that no install is needed there."""
    package = sys.modules[__name__.split(".")[0]]
    cloudpickle.register_pickle_by_value(package)


def work_root(spark: SparkSession) -> str:
    """The folder shared by all executors, as named in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster the setting is required.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parlance-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result that several steps read, and read it back.

    The table lies in the shared folder, so a lost executor costs a re-read and not a recomputation. Inside ``scratch`` it
    goes with the block, and is packed closer.
    """
    path = new_folder(df.sparkSession, label)
    writer = df.write if _PASSING.get() is None else df.write.option("compression", PACKED)
    writer.parquet(passing(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PACKED = "zstd"
_PASSING: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose intermediate results take disk only as long as they are needed.

    What ``materialise`` and ``passing`` write inside goes when the block ends, whichever way it ends; shuffle files go as soon as
    the action that made them has run. So no frame that is read after the block may rest on what was made in it.
    """
    folders, before = [], spark.conf.get(SHUFFLES_GO, None)
    token = _PASSING.set(folders)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)
        _PASSING.reset(token)
        for path in folders:
            remove_folder(spark, path)


def passing(path: str) -> str:
    """The path of a folder that goes with the ``scratch`` block around, if there is one."""
    folders = _PASSING.get()
    if folders is not None:
        folders.append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def local_path(path: str) -> str:
    """Plain path of a file URI, for code that opens files of a mounted folder directly."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is not a mounted folder")
    return path


def make_local_dir(path: str) -> str:
    os.makedirs(local_path(path), exist_ok=True)
    return local_path(path)

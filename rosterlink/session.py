"""Session settings the plans rely on, and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: they can be set on a session somebody else started.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # skip the sort of a join where the measured partitions are small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_shipped: set[str] = set()  # applications that have the package


def configure(spark: SparkSession) -> SparkSession:
    """Set what the plans rely on, for good, and give the package to the executors once."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Python workers import this package from a zip, wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="rosterlink-package-")  # the driver serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for here, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for durable intermediate results.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    every task runs on this machine, may fall back to a local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rosterlink-"))
    return sc.getCheckpointDir()


_open: ContextVar[list[str] | None] = ContextVar("folders staged in the innermost temporary()", default=None)

# what a write has shuffled is of no use once it is written; else its files stay until the driver collects garbage
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives lost executors, fixes the rows for every later use
    and gives the optimizer true sizes to choose joins by. The folder goes at the end of the
    ``temporary()`` around the call, else when the driver ends; the shuffle files of the write
    go when it is done.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "staged")
    writer = df.write if compression is None else df.write.option("compression", compression)
    before = spark.conf.get(_SHUFFLES_END, None)
    spark.conf.set(_SHUFFLES_END, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_END)
        else:
            spark.conf.set(_SHUFFLES_END, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one; it goes as a staged one does."""
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder, files = _on_store(spark, path)
    files.deleteOnExit(folder)
    if _open.get() is not None:
        _open.get().append(path)
    return path


def _on_store(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Folders staged inside go at its end, but for those of the DataFrames handed to ``keep``.

    ``keep`` stages its argument; leave the block only with results that were kept or written.
    Kept folders belong to the next block outwards. After an error nothing is deleted here.
    """
    outer, inner, kept = _open.get(), [], []
    token = _open.set(inner)

    def keep(df: DataFrame) -> DataFrame:
        out = staged(df)
        kept.append(inner.pop())
        return out

    try:
        yield keep
        for path in inner:
            folder, files = _on_store(spark, path)
            files.delete(folder, True)
    finally:
        _open.reset(token)
        if outer is not None:
            outer.extend(kept)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

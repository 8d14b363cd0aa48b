"""Published tables: replace, append, snapshot, export."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlink import schemas


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns and types of the published table ``name``."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.table_schema(name)])


def replace_table(df: DataFrame, root: str, name: str) -> DataFrame:
    """Write the table anew and read it back; must not be read by ``df`` itself."""
    conform(df, name).write.mode("overwrite").parquet(table_path(root, name))
    return read_table(df.sparkSession, root, name)


def append_table(df: DataFrame, root: str, name: str) -> None:
    conform(df, name).write.mode("append").parquet(table_path(root, name))


def read_table(spark: SparkSession, root: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(schemas.table_schema(name)).parquet(table_path(root, name))
    return df.select(*columns) if columns else df


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schemas.table_schema(name))


def read_table_if_any(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table, empty where it was never written."""
    try:
        return read_table(spark, root, name)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_table(spark, name)


def report(df: DataFrame, path: str) -> None:
    # values keep their outer spaces
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").option("header", True).options(**kept).csv(path)


# ---- snapshots -------------------------------------------------------------------


def snapshot_root(root: str, timestamp: str) -> str:
    return f"{root.rstrip('/')}/snapshot={timestamp}"


def new_timestamp(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S")


def write_metadata(spark: SparkSession, snapshot: str, timestamp: str, seconds: float) -> DataFrame:
    row = spark.createDataFrame([(timestamp, float(seconds))], schemas.table_schema("metadata"))
    return replace_table(row, snapshot, "metadata")


def publish_snapshot(spark: SparkSession, root: str, timestamp: str) -> None:
    """Make a complete snapshot the latest one.

    Tables stay where they were written; a one-row pointer under a new name switches
    readers at once, so they never see half a build and no data is copied.
    """
    pointer = spark.createDataFrame([(timestamp,)], "snapshot string")
    pointer.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/latest")


def latest_snapshot(spark: SparkSession, root: str) -> str:
    """Folder of the newest published snapshot."""
    newest = spark.read.schema("snapshot string").parquet(f"{root.rstrip('/')}/latest").agg(F.max("snapshot")).first()[0]
    if newest is None:
        raise ValueError(f"nothing published under {root}")
    return snapshot_root(root, newest)


def last_update(spark: SparkSession, snapshot: str) -> str:
    return read_table(spark, snapshot, "metadata").first()["timestamp"]

"""Global positions, dense ids and tied ranks without a single-task window.

Rows are laid out by range over all tasks; each task numbers its own rows and the
sizes of the tasks before it give the offset. A group may span any number of tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlink.session import shuffle_partitions, staged

# monotonically_increasing_id() keeps the row number of a task in the low 33 bits
_ROW_BITS = 33


def _same(left: str, right: str, names: list[str]) -> Column:
    return reduce(
        lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    )


def with_position(
    df: DataFrame, order: list[str], within: list[str] | None = None, name: str = "position"
) -> DataFrame:
    """Add the 1-based position of each row by ``order`` inside its ``within`` group."""
    within = list(within or [])
    sort = [*within, *order]
    laid_out = staged(
        df.repartitionByRange(shuffle_partitions(df.sparkSession), *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_row", F.monotonically_increasing_id())
    ).withColumn("_task", F.shiftright("_row", _ROW_BITS))
    runs = laid_out.groupBy("_task", *within).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_size"))
    # at most one run per task and group here, never the rows themselves
    before = Window.partitionBy(*within).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    if not within:
        runs = F.broadcast(runs)  # one row per task
    joined = laid_out.alias("l").join(runs.alias("r"), _same("l", "r", ["_task", *within]))
    position = F.col("l._row") - F.col("r._first") + F.col("r._before") + 1
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], position.alias(name))


def assign_ids(df: DataFrame, order: list[str], name: str, after: int | Column = 0) -> DataFrame:
    """Dense ids ``after + 1 ..`` by ``order``, which must be unique per row."""
    numbered = with_position(df, order, name=name)
    return numbered.withColumn(name, F.col(name) + (F.lit(after) if isinstance(after, int) else after))


def average_rank(df: DataFrame, value: str, within: list[str], name: str) -> DataFrame:
    """Ascending rank of ``value`` per group; equal values share the mean of their ranks."""
    counts = df.groupBy(*within, value).agg(F.count(F.lit(1)).alias("_ties"))
    sort = [*within, value]
    laid_out = staged(
        counts.repartitionByRange(shuffle_partitions(df.sparkSession), *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_task", F.spark_partition_id())
    )
    sizes = laid_out.groupBy("_task", *within).agg(F.sum("_ties").alias("_size"))
    earlier_tasks = Window.partitionBy(*within).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier_tasks), F.lit(0))).drop("_size")
    # a task's share of a group is one range of values
    in_task = Window.partitionBy("_task", *within).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        laid_out.withColumn("_below", F.coalesce(F.sum("_ties").over(in_task), F.lit(0)))
        .join(sizes, ["_task", *within])
        .select(*sort, (F.col("_offset") + F.col("_below") + (F.col("_ties") + 1) / 2).alias(name))
    )
    return df.join(ranked, sort)

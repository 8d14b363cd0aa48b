"""Keyed updates, group picks and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_only(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the known ones (semi join)."""
    return df.join(known.select(key), key, "left_semi")


def override(df: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Replace all rows of the corrected keys by the corrections, known key or not."""
    kept = df.join(corrections.select(key).distinct(), key, "left_anti")
    return kept.unionByName(corrections.select(*df.columns))


def with_column_if_absent(df: DataFrame, name: str, dtype: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(dtype))


def merge_update(target: DataFrame, updates: DataFrame, key: str, setters: dict[str, Column]) -> DataFrame:
    """Update matched rows; ``updates`` has one row per key.

    ``setters`` give the new value of a column from columns ``t.*`` and ``u.*``.
    """
    joined = target.alias("t").join(updates.alias("u"), F.col(f"t.{key}") == F.col(f"u.{key}"), "left")
    return joined.select(*[
        setters[c].alias(c) if c in setters else F.col(f"t.{c}").alias(c) for c in target.columns
    ])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group; each task keeps only its own first ``k`` before the shuffle."""
    name = rank or "_rank"
    picked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)
    return picked if rank else picked.drop(name)


def one_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order`` (nulls last), pre-aggregated in each task.

    The other columns break ties, so that the row is the same in every run; none may be a map.
    """
    ranked = order + [c for c in df.columns if c not in key and c not in order]
    first = [part for c in ranked for part in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c).alias(c))]
    return df.groupBy(*key).agg(F.min(F.struct(*first)).alias("_best")).select(*[
        F.col(c) if c in key else F.col("_best")[c].alias(c) for c in df.columns
    ])


def sampled(df: DataFrame, key: list[str], n: int | None) -> DataFrame:
    """Optional sample mode: the first ``n`` rows by key; off when ``n`` is None."""
    return df if n is None else df.orderBy(*key).limit(n)


def require_columns(columns: list[str], needed: list[str], what: str) -> None:
    missing = sorted(set(needed) - set(columns))
    if missing:
        raise ValueError(f"{what} lacks the required columns: {missing}")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_between(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")
    return value

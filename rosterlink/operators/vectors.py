"""Vector means and distances on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: years after which a publication counts half.
HALF_LIFE_YEARS = 3.0


def as_double_array(col: Column) -> Column:
    return col.cast("array<double>")


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(as_double_array(a), as_double_array(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def decay_weight(year: Column, as_of_year: int, half_life: float = HALF_LIFE_YEARS) -> Column:
    """2 ^ (-age / half life); the weighted mean divides by the sum."""
    return F.pow(F.lit(2.0), -(F.lit(as_of_year) - year) / F.lit(half_life))


def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Element-wise mean per key; each task folds its rows to one buffer per key."""
    mean = Summarizer.mean(array_to_vector(as_double_array(F.col(vector))))
    return df.groupBy(key).agg(vector_to_array(mean).alias(vector))


def recency_vectors(
    df: DataFrame, key: str, year: str, as_of_year: int, vector: str = "embedding", half_life: float = HALF_LIFE_YEARS
) -> DataFrame:
    """Mean per key weighted by age; rows without a year are left out."""
    weight = decay_weight(F.col(year), as_of_year, half_life)
    summary = Summarizer.metrics("mean").summary(array_to_vector(as_double_array(F.col(vector))), weight)
    dated = df.where(F.col(year).isNotNull()).groupBy(key).agg(summary.alias("_summary"))
    return dated.select(key, vector_to_array(F.col("_summary.mean")).alias(vector))

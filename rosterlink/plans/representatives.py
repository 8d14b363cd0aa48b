"""Representative vectors of each person: mean, recency-weighted mean, cluster centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.operators.clusters import cluster_vectors
from rosterlink.operators.vectors import mean_vectors, recency_vectors


def person_vectors(sciper_pub: DataFrame, pub: DataFrame, pub_embedding: DataFrame) -> DataFrame:
    """``sciper, id_pub, year_issued, embedding``."""
    return (
        sciper_pub.join(pub.select("id_pub", "year_issued"), "id_pub").join(pub_embedding, "id_pub")
        .select("sciper", "id_pub", "year_issued", "embedding")
    )


def _typed(df: DataFrame, kind: str) -> DataFrame:
    weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    return df.select("sciper", F.lit(kind).alias("type"), weight.alias("weight"), "embedding")


def representatives(vectors: DataFrame, as_of_year: int, **clustering) -> DataFrame:
    """The ``representative`` table from :func:`person_vectors`."""
    return (
        _typed(mean_vectors(vectors, "sciper"), "mean")
        .unionByName(_typed(recency_vectors(vectors, "sciper", "year_issued", as_of_year), "recency"))
        .unionByName(_typed(cluster_vectors(vectors, "sciper", "id_pub", **clustering), "cluster"))
    )

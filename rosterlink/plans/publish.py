"""The flat publication view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.functions.text import blank_if_null


def publication_view(pub: DataFrame, sciper_pub: DataFrame, pub_embedding: DataFrame) -> DataFrame:
    """One row per (person, publication with a vector)."""
    source = F.when(F.col("id_infoscience").isNotNull(), "infoscience").otherwise("openalex")
    return (
        pub.select(
            "id_pub", blank_if_null(F.col("title")).alias("title"), blank_if_null(F.col("abstract")).alias("abstract"),
            source.alias("source"),
        )
        .join(sciper_pub, "id_pub").join(pub_embedding, "id_pub")
        .select("sciper", "title", "abstract", "id_pub", "source", "embedding")
    )

"""Person records of the identifier registry, flattened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import text


def wanted_orcids(sciper_openalex: DataFrame, registered: DataFrame) -> DataFrame:
    """Distinct ORCIDs known by either route, in bare form."""
    routes = sciper_openalex.select("orcid").unionByName(registered.select("orcid"))
    return routes.select(text.orcid_key(F.col("orcid")).alias("orcid")).where("orcid IS NOT NULL").distinct()


def person_records(records: DataFrame, orcids: DataFrame) -> DataFrame:
    """Landed records of the wanted ORCIDs, one per ORCID (the lowest where some differ)."""
    keyed = records.withColumn("orcid", text.orcid_key(F.col("`orcid-identifier`.path")))
    wanted = keyed.join(orcids, "orcid", "left_semi")
    return wanted.groupBy("orcid").agg(F.min(F.struct("history", "person")).alias("r")).select("orcid", "r.*")


def _texts(path: str, field: str):
    return F.coalesce(F.transform(path, lambda entry: entry[field]), F.array().cast("array<string>"))


def profile_rows(records: DataFrame) -> DataFrame:
    """The ``orcid`` table."""
    return records.select(
        "orcid",
        F.col("history.claimed").alias("claimed"),
        F.col("person.name.`given-names`.value").alias("firstname"),
        F.col("person.name.`family-name`.value").alias("lastname"),
        _texts("person.`other-names`.`other-name`", "content").alias("other_names"),
        _texts("person.emails.email", "email").alias("emails"),
        F.col("person.biography.content").alias("biography"),
        F.array_join(_texts("person.keywords.keyword", "content"), ";").alias("keyword"),
    )


def link_rows(records: DataFrame) -> DataFrame:
    """The ``orcid_links`` table: web links, then external identifiers, in one shape."""
    urls = records.select("orcid", F.explode("person.`researcher-urls`.`researcher-url`").alias("u")).select(
        "orcid", F.lit("url").alias("type"),
        F.coalesce(text.null_if_blank(F.col("u.`url-name`")), F.col("u.url.value")).alias("id"),
        F.col("u.url.value").alias("url"),
    )
    identifiers = records.select(
        "orcid", F.explode("person.`external-identifiers`.`external-identifier`").alias("e")
    ).select(
        "orcid", F.col("e.`external-id-type`").alias("type"), F.col("e.`external-id-value`").alias("id"),
        F.col("e.`external-id-url`.value").alias("url"),
    )
    return urls.unionByName(identifiers)

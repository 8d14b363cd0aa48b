"""Resolve people to external author ids by co-authorship frequency and name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import text
from rosterlink.operators.keyed import one_per_key, override, sampled, top_per_group
from rosterlink.sources.readers import work_authorships

# Newest DOIs looked up per person, candidates kept by frequency, edits
# allowed between name tokens, candidates accepted for a name without a token.
MAX_DOIS = 50
MAX_CANDIDATES = 50
NAME_EDITS = 1
UNNAMED_CANDIDATES = 5


def newest_dois(sciper_pub: DataFrame, pub: DataFrame, max_dois: int = MAX_DOIS) -> DataFrame:
    """``sciper, doi, year_issued, rank``: the newest DOIs per person, undated ones last."""
    dated = (
        sciper_pub.join(pub.where("doi IS NOT NULL").select("id_pub", "doi", "year_issued"), "id_pub")
        # placed by person once: the grouping and the ranking below share that shuffle
        .repartition("sciper").groupBy("sciper", "doi").agg(F.max("year_issued").alias("year_issued"))
    )
    return top_per_group(dated, ["sciper"], [F.desc_nulls_last("year_issued"), F.asc("doi")], max_dois, rank="rank")


def doi_lists(sciper_pub: DataFrame, pub: DataFrame, prof: DataFrame, max_dois: int = MAX_DOIS) -> DataFrame:
    """``sciper, total_dois, name, dois``; the total is taken before the cut."""
    totals = (
        sciper_pub.join(pub.where("doi IS NOT NULL").select("id_pub", "doi"), "id_pub")
        .groupBy("sciper").agg(F.count_distinct("doi").alias("total_dois"))
    )
    lists = newest_dois(sciper_pub, pub, max_dois).groupBy("sciper").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "doi"))), lambda d: d["doi"]).alias("dois")
    )
    return totals.join(lists, "sciper").join(person_names(prof), "sciper").select("sciper", "total_dois", "name", "dois")


def person_names(prof: DataFrame) -> DataFrame:
    """One ``sciper, name`` per person, the lowest where the roster has several."""
    name = text.full_name(F.col("firstname"), F.col("lastname"))
    return prof.groupBy("sciper").agg(F.min(name).alias("name"))


def candidate_authors(person_dois: DataFrame, authorships: DataFrame, k: int = MAX_CANDIDATES) -> DataFrame:
    """The most frequent co-authors of each person: ``sciper, author_id, n, rank, display_name``.

    An author id has the lowest of its names in the works that the person's DOIs found, so
    works are read and exploded once, and counts and names are gathered in one pass.
    """
    counted = (
        person_dois.select("sciper", "doi").join(authorships.select("doi", "author_id", "display_name"), "doi")
        .repartition("sciper").groupBy("sciper", "author_id").agg(F.count(F.lit(1)).alias("n"), F.min("display_name").alias("display_name"))
    )
    kept = top_per_group(counted, ["sciper"], [F.desc("n"), F.asc("author_id")], k, rank="rank")
    return kept.select("sciper", "author_id", "display_name", "n", "rank")


def matching_authors(
    candidates: DataFrame, names: DataFrame, edits: int = NAME_EDITS, unnamed: int = UNNAMED_CANDIDATES
) -> DataFrame:
    """Candidates whose name token is close to the person's own.

    A person without a token gets the ``unnamed`` most frequent; one without a close candidate
    gets none.
    """
    tokens = names.select("sciper", text.name_token(F.col("name")).alias("own"))
    joined = candidates.join(tokens, "sciper").withColumn("token", text.name_token(F.col("display_name")))
    close = F.levenshtein("token", "own", edits)
    return joined.where(
        F.when(F.col("own").isNull(), F.col("rank") <= unnamed).otherwise(close >= 0)
    ).select("sciper", F.col("author_id").alias("openalex_id"), "n", close.alias("edit_distance"))


def author_details(ids: DataFrame, authors: DataFrame) -> DataFrame:
    """Details of the resolved ids; a repeated author counts once, ORCIDs in bare form."""
    once = one_per_key(
        authors.select("id", "display_name", "display_name_alternatives", text.orcid_key(F.col("orcid")).alias("orcid"), "works_count"),
        ["id"], ["display_name", "orcid", "works_count"],
    ).withColumnRenamed("id", "openalex_id")
    return ids.select("sciper", "openalex_id").join(once, "openalex_id").select(
        "sciper", "openalex_id", "display_name", "display_name_alternatives", "orcid", "works_count"
    )


def resolve_authors(
    sciper_pub: DataFrame, pub: DataFrame, prof: DataFrame, works: DataFrame, authors: DataFrame,
    corrections: DataFrame | None = None, max_dois: int = MAX_DOIS, sample: int | None = None,
    max_candidates: int = MAX_CANDIDATES, edits: int = NAME_EDITS, unnamed: int = UNNAMED_CANDIDATES,
) -> DataFrame:
    """The ``sciper_openalex`` table.

    Per person the newest ``max_dois`` are looked up and the ``max_candidates`` most
    frequent co-authors compared by name, within ``edits``; a person without a name token
    gets the ``unnamed`` most frequent.
    """
    dois = newest_dois(sciper_pub, pub, max_dois)
    if sample is not None:
        dois = dois.join(sampled(dois.select("sciper").distinct(), ["sciper"], sample), "sciper", "left_semi")
    candidates = candidate_authors(dois, work_authorships(works), max_candidates)
    ids = matching_authors(candidates, person_names(prof), edits, unnamed)
    ids = ids.select("sciper", "openalex_id")
    if corrections is not None:
        ids = override(ids, corrections, "sciper")
    return author_details(ids, authors)

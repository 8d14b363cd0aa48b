"""Publications of known people from the repository, and the second source merged in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink import schemas
from rosterlink.functions import text
from rosterlink.operators.edit_join import nearest_text
from rosterlink.operators.keyed import known_only, merge_update, one_per_key, require_rows, with_column_if_absent
from rosterlink.operators.numbering import assign_ids
from rosterlink.session import staged
from rosterlink.sources.readers import metadata_value, metadata_values, works_of_authors

# Fixed value: titles closer than three edits are one publication.
TITLE_EDITS = 2


def item_people(items: DataFrame) -> DataFrame:
    """Items with the distinct numeric ids of their people."""
    ids = F.transform(
        F.filter(metadata_values(schemas.ITEM_PEOPLE), lambda v: v.isNotNull() & text.digits_only(v)), text.as_id
    )
    return items.withColumn("scipers", F.array_distinct(ids))


def publications(items: DataFrame, prof: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pub, sciper_pub) of the items that have a known person.

    Ids follow the natural key: repository id, then DOI, title and the rest.
    """
    described = item_people(items).select(
        metadata_value(schemas.ITEM_URI).alias("id_infoscience"),
        text.doi_key(metadata_value(schemas.ITEM_DOI)).alias("doi"),
        metadata_value(schemas.ITEM_TITLE).alias("title"),
        metadata_value(schemas.ITEM_ABSTRACT).alias("abstract"),
        text.publication_year(metadata_value(schemas.ITEM_ISSUED)).alias("year_issued"),
        "scipers",
    )
    # a row number only tells equal items apart until ids are given
    described = staged(described.withColumn("_item", F.monotonically_increasing_id()))
    links = known_only(described.select("_item", F.explode("scipers").alias("sciper")), prof, "sciper")
    links = staged(links.distinct())
    kept = described.drop("scipers").join(links.select("_item").distinct(), "_item", "left_semi")
    natural = ["id_infoscience", "doi", "title", "abstract", "year_issued", "_item"]
    numbered = staged(assign_ids(kept, natural, "id_pub"))
    require_rows(numbered, "no publications of known people found")
    pub = numbered.select("id_pub", "id_infoscience", "doi", "title", "abstract", "year_issued")
    sciper_pub = links.join(numbered.select("_item", "id_pub"), "_item").select("id_pub", "sciper")
    return pub, sciper_pub


def person_works(sciper_openalex: DataFrame, works: DataFrame, year_min: int, year_max: int) -> DataFrame:
    """Works of each person's author ids, with the keys they are matched by."""
    ids = sciper_openalex.select("sciper", F.col("openalex_id").alias("author_id")).distinct()
    found = (
        works_of_authors(works, year_min, year_max).join(ids, "author_id")
        .select(
            "sciper", "work_id", text.doi_key(F.col("doi")).alias("doi"),
            text.text_fold(text.blank_if_null(F.col("title"))).alias("title"),
            text.text_from_index(F.col("abstract_inverted_index")).alias("abstract"),
            F.col("publication_year").alias("year_issued"),
        )
    )
    return one_per_key(found, ["sciper", "work_id"], ["doi", "title", "abstract", "year_issued"])


def match_works(works: DataFrame, existing: DataFrame, title_edits: int = TITLE_EDITS) -> DataFrame:
    """First matching publication per (person, work): ``sciper, work_id, id_pub, distance``.

    ``works``: sciper, work_id, doi, title. ``existing``: sciper, id_pub, doi, title. An
    equal DOI comes first (distance -1), then the smaller title distance, then the lower
    id. Titles are folded already.
    """
    # one publication per person and DOI, so the join cannot multiply
    by_doi = existing.where("doi IS NOT NULL").groupBy("sciper", "doi").agg(F.min("id_pub").alias("id_pub"))
    doi_matches = works.where("doi IS NOT NULL").join(by_doi, ["sciper", "doi"]).select(
        "sciper", "work_id", "id_pub", F.lit(-1).alias("distance")
    )
    rest = works.join(doi_matches, ["sciper", "work_id"], "left_anti")
    title_matches = nearest_text(rest, existing, "sciper", "title", "work_id", "id_pub", title_edits)
    return doi_matches.unionByName(title_matches)


def merge_works(pub: DataFrame, sciper_pub: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pub, sciper_pub) with the works of the second source merged in.

    Every work ends on exactly one publication: the best match among its people's, or one
    new row with its own id however many people share it. All its people are linked to it.
    Where several works match one publication the last work id wins, and so does the
    last non-empty abstract where the publication has none.
    """
    pub = with_column_if_absent(pub, "openalex_id", "string")
    works = staged(works)
    existing = sciper_pub.join(pub.select("id_pub", "doi", text.text_fold(F.col("title")).alias("title")), "id_pub")
    best = F.min(F.struct("distance", "id_pub")).alias("best")
    resolved = staged(
        match_works(works, staged(existing)).groupBy("work_id").agg(best).select("work_id", F.col("best.id_pub").alias("id_pub"))
    )

    once = one_per_key(works.drop("sciper"), ["work_id"], ["doi", "title"])
    matched = once.join(resolved, "work_id")
    has_text = F.col("abstract") != ""
    updates = matched.groupBy("id_pub").agg(
        F.max("work_id").alias("openalex_id"),
        F.max_by(F.when(has_text, F.col("abstract")), F.when(has_text, F.col("work_id"))).alias("abstract"),
    )
    updated = merge_update(pub, updates, "id_pub", {
        "openalex_id": F.coalesce("u.openalex_id", "t.openalex_id"),
        "abstract": F.coalesce(text.null_if_blank(F.col("t.abstract")), F.col("u.abstract"), F.col("t.abstract")),
    })

    top = pub.agg(F.coalesce(F.max("id_pub"), F.lit(0))).first()[0]
    new = staged(assign_ids(once.join(resolved, "work_id", "left_anti"), ["work_id"], "id_pub", after=top))
    appended = updated.unionByName(
        new.withColumnRenamed("work_id", "openalex_id").withColumn("id_infoscience", F.lit(None).cast("string"))
        .select(*updated.columns)
    )
    placed = resolved.unionByName(new.select("work_id", "id_pub"))
    links = works.select("sciper", "work_id").join(placed, "work_id").select("id_pub", "sciper")
    return appended, sciper_pub.unionByName(links).distinct()

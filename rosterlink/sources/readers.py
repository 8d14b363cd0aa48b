"""Readers of the landed inputs. Remote lookups of single ids become joins with these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlink import schemas
from rosterlink.functions import text
from rosterlink.operators.keyed import require_columns, sampled


def read_roster(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """Roster CSV under the names of the published tables; columns beyond the known are ignored."""
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw.columns, list(schemas.ROSTER_FIELDS), f"roster {path}")
    typed = raw.select(*[
        F.col(f"`{header}`").cast(dtype).alias(name) for header, (name, dtype) in schemas.ROSTER_FIELDS.items()
    ])
    return sampled(typed, ["sciper", "cf"], sample)


def read_orcid_map(spark: SparkSession, path: str) -> DataFrame:
    """``{"<id>": {"orcid": ..}}`` objects as ``sciper, orcid`` rows.

    A map is one object, on one line or many, or many objects; either way it is read in
    parallel, cut behind closing brackets: each piece is an entry, and a blank one ends an object.
    A file that doesn't add up so (brackets in strings, deeper objects, damage) is read by
    lines and objects, which takes all valid JSON and raises at damage. Keys that are no number are dropped.
    """
    about = F.col("_metadata")
    pieces = spark.read.option("lineSep", "}").text(path).select(
        about["file_path"].alias("file"), about["file_size"].alias("bytes"), "value", (F.trim(F.translate("value", "\r\n\t", "   ")) == "").alias("blank")
    )
    begin = r"^\s*([{,])"
    body = F.concat(F.lit("{"), F.regexp_replace("value", begin, ""), F.lit("}}"))
    entries = F.when(F.col("value").rlike(begin), F.from_json(body, schemas.ORCID_MAP))
    read = pieces.withColumn("entries", F.when(~F.col("blank"), entries))
    # what stands behind the last bracket of a file is a piece more than there are brackets
    behind = F.sum(F.octet_length("value") + 1) - F.max("bytes")
    odd = read.groupBy("file").agg(
        F.count_if(~F.col("blank") & F.col("entries").isNull()).alias("broken"),
        (F.count_if("blank") - behind - F.count_if(F.col("value").rlike(r"^\s*\{"))).alias("open"),
    ).where("broken > 0 OR open <> 0").select("file").collect()  # one row per file that doesn't add up
    objects = read.where("entries IS NOT NULL").select("file", "entries")
    if odd:
        names = sorted(row.file for row in odd)
        objects = objects.where(~F.col("file").isin(names)).select("entries").unionByName(_whole_objects(spark, names))
    rows = objects.select(F.explode("entries").alias("key", "entry"))
    return rows.where(text.digits_only(F.col("key"))).select(
        text.as_id(F.col("key")).alias("sciper"), text.orcid_key(F.col("entry.orcid")).alias("orcid")
    ).where("orcid IS NOT NULL")


def _whole_objects(spark: SparkSession, files: list[str]) -> DataFrame:
    """``entries`` of files that hold an object per line, or one object over many lines; raises at damage."""
    # in brackets, so that anything after an object is an error and not left out
    bracketed, listed = F.concat(F.lit("["), "value", F.lit("]")), f"array<{schemas.ORCID_MAP}>"
    one = F.from_json(bracketed, listed)
    lines = spark.read.text(files).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.when(F.size(one) == 1, F.get(one, F.lit(0))).alias("entries")
    )
    broken = lines.groupBy("file").agg(
        F.count("entries").alias("objects"), F.count_if(F.col("entries").isNull()).alias("broken")
    ).where("broken > 0").collect()  # one row per file that isn't plain lines
    damaged = sorted((row.file, row.broken) for row in broken if row.objects)
    if damaged:
        raise ValueError(f"ORCID map has lines that are no object, by file: {damaged}")
    objects = lines.select("entries")
    if broken:
        strict = F.from_json(bracketed, listed, {"mode": "FAILFAST"})
        texts = spark.read.text([row.file for row in broken], wholetext=True)
        objects = objects.where("entries IS NOT NULL").unionByName(texts.select(F.explode(strict).alias("entries")))
    return objects


def metadata_values(field: str):
    return F.transform(F.element_at("metadata", F.lit(field)), lambda entry: entry["value"])


def metadata_value(field: str):
    """First value of a metadata field, null when absent."""
    return F.get(metadata_values(field), F.lit(0))


def _json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; a line that does not fit it raises and is not left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return _json_lines(spark, path, schemas.REPOSITORY_ITEM)


def select_items(items: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Publications issued in the range of ISO dates.

    A year or month alone counts where it touches the range; dates written otherwise are
    judged by their year.
    """
    issued = metadata_value(schemas.ITEM_ISSUED)
    iso, year = issued.rlike(r"^\d{4}"), text.publication_year(issued)
    kept = items.where(F.lower(metadata_value(schemas.ITEM_ENTITY)) == schemas.ITEM_ENTITY_PUBLICATION)
    if date_from:
        late_enough = issued >= F.substring(F.lit(date_from), F.lit(1), F.length(issued))
        kept = kept.where(F.when(iso, late_enough).otherwise(year >= int(date_from[:4])))
    if date_to:
        early_enough = F.substring(issued, 1, 10) <= date_to
        kept = kept.where(F.when(iso, early_enough).otherwise(year <= int(date_to[:4])))
    return kept


def read_works(spark: SparkSession, path: str) -> DataFrame:
    return _json_lines(spark, path, schemas.WORK)


def read_authors(spark: SparkSession, path: str) -> DataFrame:
    return _json_lines(spark, path, schemas.AUTHOR)


def read_person_records(spark: SparkSession, path: str) -> DataFrame:
    return _json_lines(spark, path, schemas.PERSON_RECORD)


def work_authorships(works: DataFrame) -> DataFrame:
    """One row per (work, author with an id): ``doi, author_id, display_name``."""
    # the key is made once per work, before authors multiply the rows
    return (
        works.select(text.doi_key(F.col("doi")).alias("doi"), "authorships")
        .select("doi", F.explode("authorships").alias("a"))
        .select("doi", F.col("a.author.id").alias("author_id"), F.col("a.author.display_name").alias("display_name"))
        .where("author_id IS NOT NULL AND author_id <> ''")
    )


def works_of_authors(works: DataFrame, year_min: int, year_max: int) -> DataFrame:
    """Works of the wanted years and types, once per distinct author id."""
    wanted = works.where(
        F.col("publication_year").between(year_min, year_max) & F.col("type").isin(*schemas.WORK_TYPES)
    )
    authors = F.array_distinct(F.transform("authorships", lambda a: a["author"]["id"]))
    return wanted.select(
        F.explode(authors).alias("author_id"), F.col("id").alias("work_id"), "doi", "title",
        "abstract_inverted_index", "publication_year",
    ).where("author_id IS NOT NULL")

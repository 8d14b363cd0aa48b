"""Reports: names that disagree between sources, nearest people, free-text name lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import text
from rosterlink.operators.keyed import one_per_key, top_per_group
from rosterlink.operators.nearest import BROADCAST_ROWS, TILE_ROWS, closest_pairs, compared, distance_matrix, matrix
from rosterlink.operators.numbering import average_rank
from rosterlink.operators.vectors import mean_vectors
from rosterlink.session import staged

# Fixed value: neighbours listed per person.
NEIGHBOURS = 20
# Fixed value: closest publication pairs averaged.
CLOSEST_PAIRS = 3


def differs(a: Column, b: Column) -> Column:
    """Unequal, or either side missing, both missing included."""
    return F.coalesce(a != b, F.lit(True))


def name_pairs(
    prof: DataFrame, orcid: DataFrame, registered: DataFrame, sciper_openalex: DataFrame, roster_label: str = "roster"
) -> DataFrame:
    """The names two sources hold for one person, side by side."""
    person = prof.select("sciper", text.full_name(F.col("firstname"), F.col("lastname")).alias("roster_name"))
    record = orcid.select("orcid", text.full_name(F.col("firstname"), F.col("lastname")).alias("record_name"))

    def pair(df: DataFrame, one: str, one_name: str, one_id: str, two: str, two_name: str, two_id: str) -> DataFrame:
        return df.select(
            "sciper", F.lit(one).alias("source1_type"), F.col(one_name).alias("source1_name"),
            F.col(one_id).cast("string").alias("source1_id"), F.lit(two).alias("source2_type"),
            F.col(two_name).alias("source2_name"), F.col(two_id).cast("string").alias("source2_id"),
        )

    author = sciper_openalex.select("sciper", "openalex_id", "display_name", "orcid")
    return (
        pair(person.join(author, "sciper"), roster_label, "roster_name", "sciper", "openalex", "display_name", "openalex_id")
        .unionByName(pair(
            person.join(registered.select("sciper", "orcid"), "sciper").join(record, "orcid"),
            roster_label, "roster_name", "sciper", "orcid integration", "record_name", "orcid",
        ))
        .unionByName(pair(
            author.join(record, "orcid"), "openalex", "display_name", "openalex_id", "orcid", "record_name", "orcid",
        ))
    )


def name_mismatches(pairs: DataFrame) -> DataFrame:
    """Pairs whose name tokens differ."""
    tokens = pairs.withColumns({
        "source1_name_norm": text.name_token(F.col("source1_name"), keep_hyphens=False),
        "source2_name_norm": text.name_token(F.col("source2_name"), keep_hyphens=False),
    })
    return tokens.where(differs(F.col("source1_name_norm"), F.col("source2_name_norm")))


def mean_distances(targets: DataFrame, means: DataFrame, **sizes) -> DataFrame:
    """Distance of each target's mean vector to everybody's: ``target, sciper, avg_dist``."""

    def every(ts, os):
        import pandas as pd

        distances = distance_matrix(matrix(ts["embedding"]), matrix(os["embedding"]))
        return pd.DataFrame({
            "target": ts["sciper"].to_numpy().repeat(len(os)),
            "sciper": list(os["sciper"]) * len(ts),
            "avg_dist": distances.ravel(),
        })

    return compared(targets, means, ["sciper"], ["sciper"], every, "target long, sciper long, avg_dist double", **sizes)


def nearest_people(
    targets: DataFrame, vectors: DataFrame, k: int = NEIGHBOURS, pairs: int = CLOSEST_PAIRS,
    broadcast_rows: int = BROADCAST_ROWS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The people nearest to each target by the mean of two ranks.

    ``targets``: sciper. ``vectors``: sciper, id_pub, embedding. One rank is by distance
    of mean vectors, one by the mean of the three closest publication pairs. Everybody is
    ranked, the target included, who is then left out of the list.
    """
    sizes = {"broadcast_rows": broadcast_rows, "tile_rows": tile_rows}
    vectors = vectors.select(F.col("sciper").cast("long").alias("sciper"), "id_pub", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = targets.select(F.col("sciper").cast("long").alias("sciper")).distinct()
    means = staged(mean_vectors(vectors, "sciper"))
    by_mean = mean_distances(means.join(asked, "sciper", "left_semi"), means, **sizes)
    by_pair = closest_pairs(vectors.join(asked, "sciper", "left_semi"), vectors, pairs, **sizes)
    both = staged(by_mean.join(by_pair.withColumnRenamed("distance", "closest_dist"), ["target", "sciper"]))
    ranked = average_rank(both, "avg_dist", ["target"], "avg_rank")
    ranked = average_rank(ranked, "closest_dist", ["target"], "closest_rank")
    ranked = ranked.withColumn("final_mean_rank", (F.col("avg_rank") + F.col("closest_rank")) / 2)
    others = ranked.where(F.col("target") != F.col("sciper"))
    return top_per_group(others, ["target"], [F.asc("final_mean_rank"), F.asc("sciper")], k, rank="place")


def with_details(neighbours: DataFrame, prof: DataFrame) -> DataFrame:
    """Neighbours with the details of the person found, one row each; people without details go."""
    rest = [c for c in prof.columns if c != "sciper"]
    return neighbours.join(one_per_key(prof, ["sciper"], rest), "sciper").select(*neighbours.columns, *rest)


def _grams(field: str) -> Column:
    """Distinct pieces of one to three characters of a field, tagged with the field."""
    length = F.length(field)
    pieces = [
        F.when(length >= n, F.transform(
            F.sequence(F.lit(1), length - n + 1), lambda at: F.substring(F.col(field), at, F.lit(n))
        )).otherwise(F.array().cast("array<string>"))
        for n in (1, 2, 3)
    ]
    tagged = F.transform(F.array_distinct(F.concat(*pieces)), lambda piece: F.concat(F.lit(field[0] + ":"), piece))
    return tagged


def lookup_names(wanted: DataFrame, people: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Resolve free-text names to people by containment of first and last name.

    ``wanted``: name. ``people``: sciper, firstname, lastname. ``corrections``: name,
    sciper. Gives ``name, sciper, n_matches``: the lowest id found, null for a miss, and
    how many people matched (0 miss, above 1 ambiguous). A name is only compared with the
    people who share its rarest piece of up to three characters.
    """
    words = F.split(text.squeeze(F.col("name")), " ")
    asked = staged(
        wanted.select("name").distinct().select(
            "name", F.lower(F.get(words, F.lit(0))).alias("first"),
            F.lower(F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ")).alias("last"),
        )
    )
    # people of one name are one row with their number and lowest id
    known = staged(
        people.groupBy(F.lower("firstname").alias("first"), F.lower("lastname").alias("last"))
        .agg(F.min("sciper").alias("sciper"), F.count_distinct("sciper").alias("n"))
        .where("first IS NOT NULL AND last IS NOT NULL")
    )
    pieces = known.select("first", "last", "sciper", "n", F.explode(F.concat(_grams("first"), _grams("last"))).alias("piece"))
    frequency = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("frequency"))
    asked_pieces = asked.select("name", F.explode(F.concat(_grams("first"), _grams("last"))).alias("piece"))
    rarest = (
        asked_pieces.join(frequency, "piece").groupBy("name").agg(F.min(F.struct("frequency", "piece")).alias("best"))
        .select("name", F.col("best.piece").alias("piece"))
    )
    candidates = asked.withColumnsRenamed({"first": "q_first", "last": "q_last"}).join(rarest, "name").join(pieces, "piece")
    hits = candidates.where(
        F.contains("first", F.col("q_first")) & F.contains("last", F.col("q_last"))
    ).groupBy("name").agg(F.min("sciper").alias("sciper"), F.sum("n").alias("n_matches"))
    resolved = asked.select("name").join(hits, "name", "left").select(
        "name", "sciper", F.coalesce("n_matches", F.lit(0)).alias("n_matches")
    )
    if corrections is None:
        return resolved
    fixed = corrections.select("name", F.col("sciper").alias("_fixed"))
    return resolved.join(fixed, "name", "left").select("name", F.coalesce("_fixed", "sciper").alias("sciper"), "n_matches")

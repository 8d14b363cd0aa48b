"""Fuzzy name search and semantic topic search, for one query or a table of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import text
from rosterlink.functions.fuzzy import partial_ratios
from rosterlink.operators.keyed import require_between
from rosterlink.operators.nearest import (
    BROADCAST_ROWS, TILE_ROWS, best_per_query, best_within_reach, compared, distance_matrix, fits, keep_best, matrix,
)
from rosterlink.plans import embeddings
from rosterlink.session import staged

# Ways to score a topic.
METHODS = ("mean", "recency", "cluster", "mixed")

_FOUND = "query_id long, item_id long, score double"


def _results(best: DataFrame) -> DataFrame:
    return best.select("query_id", F.col("item_id").alias("sciper"), F.col("score").alias("match_score"), "place")


def search_names(queries: DataFrame, names: DataFrame, limit: int = 5, **sizes) -> DataFrame:
    """Best people per query by the best partial ratio over their names.

    ``queries``: query_id, query. ``names``: sciper, name (the alternative names of the
    visible people). Gives ``query_id, sciper, match_score, place``. A task scores each
    distinct name of a batch once and passes on its ``limit`` best people.
    """
    require_between(limit, 1, 100, "limit")

    def score(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        name_at, distinct = pd.factorize(rows["name"])
        person_at, people = pd.factorize(rows["sciper"], sort=True)
        scores = np.zeros((len(asked), len(people)))
        texts = list(distinct)
        for row, query in enumerate(asked["query"]):
            np.maximum.at(scores[row], person_at, partial_ratios(query, texts)[name_at])
        best = keep_best(-scores, limit, asked["query_id"].to_numpy(), np.asarray(people))
        return best.assign(score=-best["score"])

    keyed = queries.select(F.col("query_id").cast("long").alias("query_id"), text.name_key(F.col("query")).alias("query"))
    named = names.select(F.col("sciper").cast("long").alias("sciper"), text.name_key(F.col("name")).alias("name"))
    partial = compared(keyed, named, ["query_id"], ["sciper", "name"], score, _FOUND, **sizes)
    # a person's names may lie in several batches
    per_person = partial.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return _results(best_per_query(per_person, limit, largest=True))


def person_representatives(representative: DataFrame) -> DataFrame:
    """One row per person: ``sciper, mean, recency, clusters`` (five clusters at most)."""
    def only(kind: str):
        return F.when(F.col("type") == kind, F.col("embedding"))

    return representative.groupBy("sciper").agg(
        F.any_value(only("mean"), True).alias("mean"),
        F.any_value(only("recency"), True).alias("recency"),
        F.collect_list(only("cluster")).alias("clusters"),
    )


def _one_vector(queries: np.ndarray, column: pd.Series) -> np.ndarray:
    out = np.full((len(queries), len(column)), np.inf)
    has = column.notna().to_numpy()
    if has.any():
        out[:, has] = distance_matrix(queries, matrix(column[has]))
    return out


def _nearest_cluster(queries: np.ndarray, column: pd.Series) -> np.ndarray:
    out = np.full((len(queries), len(column)), np.inf)
    counts = column.map(len).to_numpy()
    if counts.any():
        flat = np.stack([np.asarray(v, dtype=float) for vectors in column for v in vectors])
        starts = (np.cumsum(counts) - counts)[counts > 0]
        out[:, counts > 0] = np.minimum.reduceat(distance_matrix(queries, flat), starts, axis=1)
    return out


def _farthest_cluster(pivots: np.ndarray, column: pd.Series) -> np.ndarray:
    out = np.full((len(pivots), len(column)), np.inf)
    counts = column.map(len).to_numpy()
    if counts.any():
        flat = np.stack([np.asarray(v, dtype=float) for vectors in column for v in vectors])
        starts = (np.cumsum(counts) - counts)[counts > 0]
        out[:, counts > 0] = np.maximum.reduceat(distance_matrix(pivots, flat), starts, axis=1)
    return out


def search_topics(
    queries: DataFrame, representative: DataFrame, method: str = "mixed", limit: int = 5, **sizes
) -> DataFrame:
    """Nearest people per query vector; a missing kind of vector counts as infinitely far.

    ``queries``: query_id, embedding. ``representative``: that table, cut to the visible
    people. Gives ``query_id, sciper, match_score, place``, scores rounded to 4 digits.
    """
    require_between(limit, 1, 100, "limit")
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")

    def totals(vectors: np.ndarray, people: pd.DataFrame) -> np.ndarray:
        kinds = {
            "mean": lambda: _one_vector(vectors, people["mean"]),
            "recency": lambda: _one_vector(vectors, people["recency"]),
            "cluster": lambda: _nearest_cluster(vectors, people["clusters"]),
        }
        return kinds[method]() if method != "mixed" else sum(kind() for kind in kinds.values()) / 3

    def score(asked: pd.DataFrame, people: pd.DataFrame) -> pd.DataFrame:
        return keep_best(totals(matrix(asked["embedding"]), people), limit, asked["query_id"].to_numpy(), people["sciper"].to_numpy())

    wanted_kinds = [method] if method != "mixed" else ["mean", "recency", "cluster"]

    def farthest(pivots: np.ndarray, people: pd.DataFrame) -> np.ndarray:
        """How far from each pivot each person's vectors of each kind reach; infinitely where there is none."""
        each = {
            "mean": lambda: _one_vector(pivots, people["mean"]), "recency": lambda: _one_vector(pivots, people["recency"]),
            "cluster": lambda: _farthest_cluster(pivots, people["clusters"]),
        }
        return np.stack([each[kind]() for kind in wanted_kinds], axis=2)

    def bound(to_pivots: np.ndarray, reaches: np.ndarray) -> np.ndarray:
        """The lowest score that a person of a cell can have: each kind is no nearer than the rim of the cell."""
        return np.maximum(to_pivots[:, :, None] - reaches[None, :, :], 0).mean(axis=2)

    # a person without the wanted kind stays, infinitely far; the vectors of other kinds don't travel
    wanted = representative if method == "mixed" else representative.withColumn(
        "embedding", F.when(F.col("type") == method, F.col("embedding"))
    )
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    people = person_representatives(wanted).withColumn("sciper", F.col("sciper").cast("long"))
    asked, people = staged(asked), staged(people)  # each is looked at more than once
    rows = sizes.get("broadcast_rows", BROADCAST_ROWS)
    if fits(asked, rows) or fits(people, rows):
        partial = compared(asked, people, ["query_id"], ["sciper"], score, _FOUND, **sizes)
    else:
        items = people.withColumn("item_id", F.col("sciper"))
        partial = best_within_reach(asked, items, limit, totals, farthest, bound, tile_rows=sizes.get("tile_rows", TILE_ROWS))
    best = best_per_query(partial, limit)
    return _results(best).withColumn("match_score", F.round("match_score", 4))


def search_texts(
    queries: DataFrame, representative: DataFrame, cache: DataFrame, provider: embeddings.Provider, model: str,
    method: str = "mixed", limit: int = 5, **sizes
) -> tuple[DataFrame, DataFrame]:
    """Nearest people per query text, and the rows to add to the cache.

    ``queries``: query_id, text. Texts are embedded as publications' are: those the cache of
    ``model`` holds are taken from it, each other text goes to the provider once. A null or
    blank text finds nobody.
    """
    texts = queries.where(F.trim("text") != "").select("query_id", "text", text.text_hash(F.col("text")).alias("text_hash"))
    vectors, added = embeddings.embed_texts(texts, cache, provider, model)
    asked = texts.select("query_id", "text_hash").join(vectors, "text_hash").select("query_id", "embedding")
    return search_topics(asked, representative, method, limit, **sizes), added


def visible(df: DataFrame, people: DataFrame) -> DataFrame:
    return df.join(people.select("sciper").distinct(), "sciper", "left_semi")


def with_profiles(results: DataFrame, profiles: DataFrame) -> DataFrame:
    """Full profiles of the people found, with their score."""
    return results.join(profiles, "sciper")

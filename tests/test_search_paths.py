"""Searches and reports against brute force, through every way two sides can meet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlink.operators import nearest
from rosterlink.plans import audit, embeddings, profiles, search

from test_operators import ratio_by_hand  # noqa: E402

# both sides too large to travel; queries travel; items travel
SIZES = [
    {"broadcast_rows": 0, "tile_rows": 7},
    {"broadcast_rows": 1000, "tile_rows": 7},
    {"broadcast_rows": 11, "tile_rows": 7},
]


def _vectors(seed, people, per_person):
    rng = np.random.default_rng(seed)
    return [(p, 100 * p + i, rng.normal(size=4).round(3).tolist()) for p in range(people) for i in range(per_person)]


@pytest.mark.parametrize("sizes", SIZES[:2])
def test_name_search(spark, sizes):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 6)))
    names = [(rng.randint(0, 24), f"{word()} {word()}") for _ in range(60)]
    queries = [(i, f"{word()} {word()}") for i in range(12)]
    got = search.search_names(
        spark.createDataFrame(queries, "query_id long, query string"),
        spark.createDataFrame(names, "sciper long, name string").repartition(3), limit=4, **sizes,
    ).collect()
    for query_id, query in queries:
        best = {}
        for sciper, name in names:
            best[sciper] = max(best.get(sciper, 0), ratio_by_hand(query, name))
        want = sorted(best, key=lambda s: (-round(best[s], 9), s))[:4]
        mine = sorted((r for r in got if r.query_id == query_id), key=lambda r: r.place)
        assert np.allclose([r.match_score for r in mine], [best[s] for s in want])
        assert [r.sciper for r in mine] == want


@pytest.mark.parametrize("sizes, method", [*[(s, "mixed") for s in SIZES], *[(SIZES[0], m) for m in ("mean", "recency", "cluster")]])
def test_topic_search(spark, sizes, method):
    rng = np.random.default_rng(4)
    kinds = {}
    for person in range(20):
        if person % 7:
            kinds[(person, "mean")] = [rng.normal(size=4)]
        if person % 6:
            kinds[(person, "recency")] = [rng.normal(size=4)]
        kinds[(person, "cluster")] = [rng.normal(size=4) for _ in range(person % 4)]
    known = sorted({p for (p, _), vs in kinds.items() if vs})  # person 0 has no vector at all
    rows = [(p, kind, 1.0, v.tolist()) for (p, kind), vs in kinds.items() for v in vs]
    queries = [(i, rng.normal(size=4).tolist()) for i in range(10)]
    representative = spark.createDataFrame(rows, "sciper long, type string, weight double, embedding array<double>")
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = search.search_topics(asked, representative, method, 20, **sizes).collect()
    for query_id, vector in queries:
        def far(person, kind):
            return min((np.linalg.norm(np.array(vector) - v) for v in kinds.get((person, kind), [])), default=np.inf)

        wanted = ["mean", "recency", "cluster"] if method == "mixed" else [method]
        score = {p: sum(far(p, kind) for kind in wanted) / len(wanted) for p in known}
        want = sorted(score, key=lambda p: (score[p], p))
        mine = sorted((r for r in got if r.query_id == query_id), key=lambda r: r.place)
        assert [r.sciper for r in mine] == want
        assert np.allclose([r.match_score for r in mine], [np.round(score[p], 4) for p in want], atol=1e-4)


def test_topic_search_visits_cells_in_reach_only(spark):
    """Vectors in far apart bunches: a query meets its own bunch, and results are those of all pairs."""
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(12, 6)) * 50
    people = [(p, "mean", 1.0, (middles[p % 12] + rng.normal(size=6)).tolist()) for p in range(240)]
    queries = [(q, (middles[q % 12] + rng.normal(size=6)).tolist()) for q in range(120)]
    items = search.person_representatives(spark.createDataFrame(people, "sciper long, type string, weight double, embedding array<double>"))
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = nearest.best_within_reach(
        asked, items.withColumn("item_id", F.col("sciper")), 3,
        lambda vectors, rows: search._one_vector(vectors, rows["mean"]),
        lambda pivots, rows: search._one_vector(pivots, rows["mean"])[:, :, None],
        lambda far, reach: np.maximum(far[:, :, None] - reach[None], 0).mean(axis=2), tile_rows=50,
    )
    best = nearest.best_per_query(got, 3).collect()
    matrix = np.array([v for *_, v in people])
    for q, v in queries:
        far = np.linalg.norm(matrix - np.array(v), axis=1)
        assert [r.item_id for r in sorted(best, key=lambda r: r.place) if r.query_id == q] == sorted(range(240), key=lambda p: far[p])[:3]
    assert got.count() <= 120 * 240 // 12  # pairs of one bunch, not all pairs


def test_topic_search_from_texts(spark):
    calls = []

    def provider(texts):
        calls.extend(texts)
        return embeddings.hashed_words(texts)

    people = [(1, "deep maps of rivers"), (2, "cells and enzymes"), (3, "concrete bridges")]
    rows = [(p, "mean", 1.0, embeddings.hashed_words([t])[0].tolist()) for p, t in people]
    representative = spark.createDataFrame(rows, "sciper long, type string, weight double, embedding array<double>")
    queries = spark.createDataFrame([(10, "cells and enzymes"), (11, "concrete bridges"), (12, "concrete bridges"), (13, None), (14, " ")], "query_id long, text string")
    cache = spark.createDataFrame([], "model string, text_hash string, embedding array<double>")
    found, added = search.search_texts(queries, representative, cache, embeddings.hashed_words, "m", "mean", 1)
    assert {(r.query_id, r.sciper, r.match_score) for r in found.collect()} == {(10, 2, 0.0), (11, 3, 0.0), (12, 3, 0.0)}
    assert added.count() == 2
    again, more = search.search_texts(queries, representative, added, provider, "m", "mean", 1)
    assert more.count() == 0 and {r.sciper for r in again.collect()} == {2, 3}


@pytest.mark.parametrize("sizes", SIZES[:2])
def test_nearest_people(spark, sizes):
    rows = _vectors(9, 9, 5)
    df = spark.createDataFrame(rows, "sciper long, id_pub long, embedding array<double>")
    targets = spark.createDataFrame([(2,), (5,)], "sciper long")
    got = audit.nearest_people(targets, df, k=4, **sizes).collect()
    stacks = {p: np.array([v for q, _, v in rows if q == p]) for p in range(9)}
    for target in (2, 5):
        means, closest = [], []
        for other in range(9):
            means.append(np.linalg.norm(stacks[target].mean(0) - stacks[other].mean(0)))
            pairs = np.linalg.norm(stacks[target][:, None] - stacks[other][None], axis=2).ravel()
            closest.append(np.sort(pairs)[:3].mean())
        rank = (np.argsort(np.argsort(means)) + np.argsort(np.argsort(closest))) / 2 + 1
        want = [p for p in np.lexsort((np.arange(9), rank)) if p != target][:4]
        mine = sorted((r for r in got if r.target == target), key=lambda r: r.place)
        assert [r.sciper for r in mine] == want
        assert np.allclose([r.final_mean_rank for r in mine], rank[want])
        assert np.allclose([r.closest_dist for r in mine], np.array(closest)[want])


def test_closest_pairs_copy_no_vector_for_every_tile(spark):
    """Both sides too large to travel: they are written once, and only the few distances found are shuffled."""
    rng = np.random.default_rng(2)
    rows = [(p % 3, 10 * p, rng.normal(size=4).tolist()) for p in range(90)]
    df = spark.createDataFrame(rows, "sciper long, id_pub long, embedding array<double>")
    got = nearest.closest_pairs(df.where("sciper < 2"), df, 3, broadcast_rows=0, tile_rows=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(target" in plan, plan
    stacks = {p: np.array([v for q, _, v in rows if q == p]) for p in range(3)}
    far = {
        (t, o): np.sort(np.linalg.norm(stacks[t][:, None] - stacks[o][None], axis=2).ravel())[:3].mean()
        for t in range(2) for o in range(3)
    }
    found = {(r.target, r.sciper): r.distance for r in got.collect()}
    assert found.keys() == far.keys() and np.allclose([found[k] for k in far], [*far.values()])


@pytest.mark.parametrize("people", [3, 200])
@pytest.mark.parametrize("case", ["plain", "far from zero", "copies", "not finite", "huge"])
def test_few_smallest_are_those_of_all_differences(people, case):
    rng = np.random.default_rng(people)
    ts, os = rng.normal(size=(500, 5)), rng.normal(size=(900, 5))
    if case == "far from zero":
        ts, os = ts / 1000 + 1e4, os / 1000 + 1e4
    if case == "copies":
        os[:400], ts[100:200] = os[500:900], os[3]
    if case == "not finite":
        ts[7, 2], os[11, 0] = np.nan, np.inf
    if case == "huge":
        ts, os = ts * 1e160, os * 1e160
    t_keys, o_keys = np.sort(rng.integers(0, people, 500)), np.sort(rng.integers(0, people, 900))
    got = nearest.few_smallest(t_keys, ts, o_keys, os, 3)
    far = nearest.distance_matrix(ts, os)
    for (t, o), rows in got.groupby(["target", "sciper"]):
        want = np.sort(far[np.ix_(t_keys == t, o_keys == o)].ravel())[:3]
        assert np.array_equal(np.sort(rows["distance"].to_numpy()), want, equal_nan=True)
    assert len(got.groupby(["target", "sciper"])) == len(np.unique(t_keys)) * len(np.unique(o_keys))


def test_lookup_names(spark):
    people = spark.createDataFrame(
        [(7, "Anna", "Van de Ville"), (3, "Annabel", "Villeneuve"), (9, "Bo", "Li"), (4, None, "Li"), (5, "Hanna", "Ville")],
        "sciper long, firstname string, lastname string",
    )
    wanted = spark.createDataFrame(
        [("  Anna  VILLE",), ("bo li",), ("Bo",), ("Anna Zz",), ("Anna de Ville",), ("o i",)], "name string"
    )
    fixed = spark.createDataFrame([("Anna Zz", 99)], "name string, sciper long")
    got = {r.name: (r.sciper, r.n_matches) for r in audit.lookup_names(wanted, people, fixed).collect()}
    assert got == {
        "  Anna  VILLE": (3, 3), "bo li": (9, 1), "Bo": (9, 1), "Anna Zz": (99, 0), "Anna de Ville": (7, 1), "o i": (9, 1),
    }


def test_missing_names_always_differ(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), ("a", "a"), ("a", "b")], "a string, b string")
    assert [r.d for r in df.select(audit.differs(F.col("a"), F.col("b")).alias("d")).collect()] == [True, True, False, True]


def test_profile_counts_are_zero_filled(spark):
    people = spark.createDataFrame([(1,), (2,)], "sciper long")
    pub = spark.createDataFrame([(1, "x", None), (2, None, "y")], "id_pub long, id_infoscience string, openalex_id string")
    links = spark.createDataFrame([(1, 1), (2, 1)], "id_pub long, sciper long")
    got = {tuple(r) for r in profiles.with_counts(people, profiles.publication_counts(links, pub)).collect()}
    assert got == {(1, 1, 1, 2), (2, 0, 0, 0)}


def test_named_neighbours_where_no_side_travels(spark):
    rows = _vectors(6, 7, 4)
    df = spark.createDataFrame(rows, "sciper long, id_pub long, embedding array<double>")
    prof = spark.createDataFrame([(p, f"name {p}") for p in range(6)], "sciper long, lastname string")
    found = {}
    for broadcast_rows in (0, 1000):
        near = audit.nearest_people(df.select("sciper"), df, k=6, broadcast_rows=broadcast_rows, tile_rows=5)
        found[broadcast_rows] = sorted(tuple(r) for r in audit.with_details(near, prof).collect())
    assert found[0] == found[1000] and len(found[0]) == 7 * 6 - 6  # person 6 has no details

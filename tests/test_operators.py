"""Operators against brute force on small fixtures."""

import random
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rosterlink.functions.fuzzy import partial_ratio, partial_ratios
from rosterlink.operators import clusters, edit_join, keyed, numbering, vectors


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio_by_hand(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0

    def inside(s, t):
        spans = [t[:i] for i in range(1, len(s))] + [t[i:i + len(s)] for i in range(len(t) - len(s) + 1)]
        spans += [t[-i:] for i in range(1, len(s))]
        return max(200.0 * lcs(s, w) / (len(s) + len(w)) for w in spans)

    if len(a) == len(b):
        return max(inside(a, b), inside(b, a))
    return inside(a, b) if len(a) < len(b) else inside(b, a)


def random_text(rng, alphabet, longest):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))


@pytest.mark.parametrize(
    "distance,alphabet,longest,hot",
    [(1, "ab", 8, 2), (2, "ab", 8, 512), (2, "abcdef", 14, 1), (2, "ab", 3, 1), (2, "abc", 9, 0), (3, "ab", 12, 0), (0, "ab", 4, 0)],
)
def test_edit_pairs_equal_brute_force(spark, distance, alphabet, longest, hot):
    rng = random.Random(7 * longest + hot)
    sides = []
    for _ in range(2):
        texts = sorted({(rng.randint(0, 1), random_text(rng, alphabet, longest)) for _ in range(120)})
        sides.append([(i, scope, t) for i, (scope, t) in enumerate(texts) if t])
    left, right = (spark.createDataFrame(s, "id long, scope long, text string") for s in sides)
    got = {tuple(r) for r in edit_join.edit_pairs(left, right, distance, hot).collect()}
    want = {
        (i, j, d)
        for i, s, a in sides[0] for j, t, b in sides[1]
        if s == t and (d := levenshtein(a, b)) <= distance
    }
    assert got == want


def test_edit_pairs_through_shared_prefixes(spark):
    """One long shared piece in every text: each segment of it is hot."""
    titles = [f"Annual meeting {n:03d}" for n in range(0, 400, 9)]
    rows = [(i, 1, t) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id long, scope long, text string")
    got = {tuple(r) for r in edit_join.edit_pairs(df, df, 2, 5).collect()}
    want = {(i, j, d) for i, _, a in rows for j, _, b in rows if (d := levenshtein(a, b)) <= 2}
    assert got == want


def test_edit_pairs_of_texts_from_one_template(spark, monkeypatch):
    """250 characters that all texts share: one second look, a few rows per text, few pairs compared."""
    rng = random.Random(5)
    template = "".join(rng.choice("abcdefghij ") for _ in range(250))
    half = rng.randrange(60, 190)

    def title():
        own = "".join(rng.choice("klmnopqrstuvwxyz") for _ in range(30))
        return template[:half] + own + template[half:]

    texts = [title() for _ in range(600)]
    near = [t[:40] + "#" + t[41:half + 12] + t[half + 13:] for t in texts[:50]]  # one change, one loss
    left = [(i, 1, t) for i, t in enumerate([*near, *(title() for _ in range(550))])]
    right = [(i, 1, t) for i, t in enumerate(texts)]
    staged, sizes = edit_join.staged, []

    def counted(df):
        out = staged(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(edit_join, "staged", counted)
    sides = [staged(spark.createDataFrame(rows, "id long, scope long, text string")) for rows in (left, right)]
    assert {tuple(r) for r in edit_join.edit_pairs(*sides, 2).collect()} == {(i, i, 2) for i in range(50)}
    candidates = edit_join._candidates(*[s.select("id", F.xxhash64("scope").alias("grp"), "text") for s in sides], 2, 512)
    assert candidates.count() < 10_000  # of 360,000 pairs
    # the hot keys, each side's texts once, and the numbers of different grams
    texts_staged = [n for n in sizes if n == 600]
    assert len(sizes) == 8 and len(texts_staged) == 4


def test_bounded_distance_of_long_texts(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(60):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(300, 330)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "a"])
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.withColumn("d", edit_join.bounded_distance(F.col("a"), F.col("b"), 2)).collect():
        true = levenshtein(r.a, r.b)
        assert r.d == (true if true <= 2 else -1)


def test_nearest_text_prefers_distance_then_id(spark):
    left = spark.createDataFrame(
        [("p", "w1", "deep maps"), ("p", "w2", "deep maps"), ("p", "w3", None), ("p", "w4", ""), ("q", "w1", "deep maps")],
        "sciper string, work_id string, title string",
    )
    right = spark.createDataFrame(
        [("p", 5, "deep map"), ("p", 7, "deep maps"), ("p", 3, "deep maps"), ("q", 1, "other things")],
        "sciper string, id_pub long, title string",
    )
    got = {tuple(r) for r in edit_join.nearest_text(left, right, "sciper", "title", "work_id", "id_pub", 2).collect()}
    assert got == {("p", "w1", 3, 0), ("p", "w2", 3, 0)}


def test_partial_ratio(spark):
    assert partial_ratios("frossard", ["pascal frossard"])[0] == 100
    assert round(partial_ratios("pascal frosard", ["pascal frossard"])[0], 4) == 92.8571
    assert round(partial_ratios("abcd", ["bcda"])[0], 4) == 85.7143
    rng = random.Random(3)
    queries = [random_text(rng, "abc ", 12) for _ in range(25)] + ["", "x" * 70 + "abc", "ab" * 40]
    texts = [random_text(rng, "abc ", 16) for _ in range(60)] + ["", "x" * 80 + "abd", "ba" * 45, "xabx"]
    for query in queries:
        assert np.allclose(partial_ratios(query, texts), [ratio_by_hand(query, t) for t in texts])
    df = spark.createDataFrame([("abcd", "bcda"), (None, "x"), ("x", None)], "a string, b string")
    got = [r.v for r in df.select(partial_ratio("a", "b").alias("v")).collect()]
    assert round(got[0], 4) == 85.7143 and got[1:] == [None, None]


def test_positions_and_ids(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaab"), n, i) for i, n in enumerate(rng.sample(range(1000), 300))]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    got = {(r.g, r.v): r.position for r in numbering.with_position(df, ["v"], within=["g"]).collect()}
    for g in "ab":
        ordered = sorted(v for h, v, _ in rows if h == g)
        assert [got[(g, v)] for v in ordered] == list(range(1, len(ordered) + 1))
    ids = numbering.assign_ids(df, ["v"], "id_pub", after=41).orderBy("v").collect()
    assert [r.id_pub for r in ids] == list(range(42, 342))


def test_average_rank(spark):
    rows = [("x", v) for v in (1.0, 2.0, 2.0, 5.0)] + [("y", v) for v in (3.0, 3.0, 3.0)]
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g string, v double, i int")
    got = [r.r for r in numbering.average_rank(df, "v", ["g"], "r").orderBy("i").collect()]
    assert got == [1, 2.5, 2.5, 4, 2, 2, 2]
    rng = np.random.default_rng(0)
    many = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": rng.integers(0, 60, 500).astype(float), "i": range(500)})
    got = numbering.average_rank(spark.createDataFrame(many), "v", ["g"], "r").toPandas().sort_values("i")
    assert np.allclose(got["r"].to_numpy(), many.groupby("g")["v"].rank().to_numpy())


def test_keyed(spark):
    target = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    updates = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    got = keyed.merge_update(target, updates, "k", {"v": F.coalesce("t.v", "u.v")})
    assert {tuple(r) for r in got.collect()} == {(1, "a"), (2, "b")}
    got = keyed.override(target, spark.createDataFrame([(1, "z"), (9, "y")], "k int, v string"), "k")
    assert {tuple(r) for r in got.collect()} == {(2, None), (1, "z"), (9, "y")}
    got = keyed.one_per_key(spark.createDataFrame([(1, None, 1), (1, "b", 2), (1, "c", 0)], "k int, v string, w int"), ["k"], ["v"])
    assert [tuple(r) for r in got.collect()] == [(1, "b", 2)]
    with pytest.raises(ValueError, match="'b'"):
        keyed.require_columns(["a"], ["a", "b"], "file")
    with pytest.raises(ValueError):
        keyed.require_between(0, 1, 100, "limit")
    with pytest.raises(ValueError):
        keyed.require_rows(target.where("k > 5"), "nothing")


def test_vector_means(spark):
    rows = [(1, 2025, [1.0, 0.0]), (1, 2022, [0.0, 1.0]), (1, None, [9.0, 9.0]), (2, None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "sciper long, year int, embedding array<double>")
    means = {r.sciper: r.embedding for r in vectors.mean_vectors(df, "sciper").collect()}
    assert np.allclose(means[1], [10 / 3, 10 / 3]) and np.allclose(means[2], [1, 1])
    recent = {r.sciper: r.embedding for r in vectors.recency_vectors(df, "sciper", "year", 2025).collect()}
    assert set(recent) == {1} and np.allclose(recent[1], [2 / 3, 1 / 3])


def _points(seed, sizes):
    rng = np.random.default_rng(seed)
    return [(p, i, rng.normal(size=3).round(3).tolist()) for p, n in sizes.items() for i in range(n)]


def test_clusters(spark):
    rows = _points(1, {1: 1, 2: 3, 3: 8, 4: 60})
    df = spark.createDataFrame(rows, "sciper long, id_pub long, embedding array<double>").repartition(5)
    found = clusters.cluster_vectors(df, "sciper", "id_pub").toPandas()
    for person, n in {1: 1, 2: 3, 3: 8, 4: 60}.items():
        mine = found[found.sciper == person].sort_values("cluster")
        assert len(mine) == min(n, 5)
        assert abs(mine.weight.sum() - 1) < 1e-9 and mine["size"].sum() == n
        points = np.array([e for p, _, e in rows if p == person])
        centres = np.stack(mine.embedding)
        labels = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        for c in range(len(centres)):
            assert np.allclose(points[labels == c].mean(0), centres[c])


def test_large_keys_cluster_alike(spark):
    rows = _points(2, {1: 40, 2: 4, 3: 25})
    rows += [(3, 100 + i, [0.5, 0.5, 0.5]) for i in range(10)]
    df = spark.createDataFrame(rows, "sciper long, id_pub long, embedding array<double>")
    order = ["sciper", "cluster"]
    one = clusters.cluster_vectors(df, "sciper", "id_pub").toPandas().sort_values(order, ignore_index=True)
    two = clusters.cluster_vectors(df, "sciper", "id_pub", rows_in_one_task=10).toPandas().sort_values(order, ignore_index=True)
    assert one[["sciper", "cluster", "size"]].equals(two[["sciper", "cluster", "size"]])
    assert (np.stack(one.embedding) == np.stack(two.embedding)).all()  # to the bit
    again = clusters.cluster_vectors(df.repartition(5), "sciper", "id_pub", rows_in_one_task=7).toPandas().sort_values(order, ignore_index=True)
    assert (np.stack(one.embedding) == np.stack(again.embedding)).all()


def test_clusters_that_do_not_settle_raise(spark):
    points = np.array([[0.0], [1.0], [9.0], [10.0], [11.0]])
    with pytest.raises(RuntimeError, match="max_rounds"):
        clusters.lloyd(points, 2, max_rounds=1)
    rows = [(1, i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "sciper long, id_pub long, embedding array<double>")
    with pytest.raises(RuntimeError, match="max_rounds"):
        clusters.cluster_vectors(df, "sciper", "id_pub", max_clusters=2, rows_in_one_task=2, max_rounds=1)


def test_one_per_key_breaks_ties_by_the_other_columns(spark):
    rows = [(1, "x", ["b"], 2), (1, "x", ["a", None], 3), (1, "x", None, 1), (2, None, None, None), (2, "y", ["z"], 1)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id long, name string, others array<string>, n long").repartition(3)
        got = sorted(tuple(r) for r in keyed.one_per_key(df, ["id"], ["name"]).collect())
        assert got == [(1, "x", ["a", None], 3), (2, "y", ["z"], 1)]


def _rounds(points, max_clusters):
    """Rounds that ``lloyd`` takes until no row moves."""
    rounds = 1
    while True:
        try:
            clusters.lloyd(points, max_clusters, max_rounds=rounds)
            return rounds
        except RuntimeError:
            rounds += 1


def _jobs(spark, run) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    except RuntimeError:
        pass
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_large_keys_take_one_job_a_round(spark):
    rows = _points(3, {1: 300, 2: 200})
    rounds = max(_rounds(np.array([e for p, _, e in rows if p == person]), 5) for person in (1, 2))
    df = spark.createDataFrame(rows, "sciper long, id_pub long, embedding array<double>")
    found = []
    whole = _jobs(spark, lambda: found.extend(clusters.cluster_vectors(df, "sciper", "id_pub", rows_in_one_task=50).collect()))
    first = _jobs(spark, lambda: clusters.cluster_vectors(df, "sciper", "id_pub", rows_in_one_task=50, max_rounds=1).collect())
    assert rounds >= 10 and len(found) == 10
    # each later round of Lloyd is one query, a pass over the rows and one shuffle of their sums;
    # the whole run also ends by joining the sizes
    assert whole - first <= 2 * (rounds - 1) + 5, (whole, first, rounds)

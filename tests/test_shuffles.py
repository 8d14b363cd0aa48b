"""Queries whose rows meet by one key are shuffled once, and shuffle files end with the write they were made for."""

import time

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_inverted_index_shuffles_texts_once(spark):
    found = entry.queries()["inverted_index_roundtrip"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").select("doc_id", "text").collect())
    rows = dict(found.select("doc_id", "abstract").collect())
    assert rows == texts


def test_candidates_are_counted_and_ranked_in_one_shuffle_by_person(spark):
    from rosterlink.plans import authors

    dois = spark.createDataFrame([(1, "d1"), (1, "d2"), (2, "d2")], "sciper long, doi string")
    works = spark.createDataFrame(
        [("d1", "A1", "Ann Bo"), ("d1", "A2", "Cy Do"), ("d2", "A2", "Cy Da"), ("d2", "A3", "Ed Fu")],
        "doi string, author_id string, display_name string",
    )
    found = authors.candidate_authors(dois, works, k=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the join by doi, then one shuffle by person that both the counts and the ranks use
    assert plan.count("Exchange hashpartitioning(sciper") == 1, plan
    rows = sorted(tuple(r) for r in found.collect())
    assert rows == [(1, "A1", "Ann Bo", 1, 2), (1, "A2", "Cy Da", 2, 1), (2, "A2", "Cy Da", 1, 1), (2, "A3", "Ed Fu", 1, 2)]


def test_response_summary_gathers_profiles_once(spark):
    from rosterlink.plans import profiles

    found = entry.queries()["response_summary"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # partial and final aggregate of the profiles, not a second copy of them for the identifiers
    assert plan.count("ObjectHashAggregate(keys=[sciper") == 2, plan
    link = "struct<id:string,url:string,source:string,method:string>"
    some = spark.createDataFrame(
        [(1, 2, 1, 3, [("a", "u", "s", "m"), ("b", "u", "s", "m")]), (2, 0, 4, 4, [("a", "v", "s", "n")]), (3, 5, 0, 5, [])],
        f"sciper long, count_infoscience_pubs long, count_openalex_pubs long, count_total_pubs long, identifiers array<{link}>",
    )
    assert tuple(profiles.summary(some, "x").first()) == (3, "x", 7, 5, 12, 2)


def test_embedding_cache_is_built_once(spark):
    found = entry.queries()["embed_texts"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the cache is read back where it was written, not embedded again by the provider
    assert "MapInPandas" not in plan, plan
    assert found.count() == 16 * spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_staged_rows_leave_no_shuffle_files(spark):
    from rosterlink.session import _SHUFFLES_END, staged

    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while held.hasNext():
            names.add(held.next().getName())
        return {name for name in names if name.startswith("shuffle_")}

    before, setting = files(), spark.conf.get(_SHUFFLES_END, None)
    rows = staged(spark.range(2000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")))
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(_SHUFFLES_END, None) == setting
    assert {r.k: r.s for r in rows.collect()} == {k: sum(range(k, 2000, 7)) for k in range(7)}


def test_keys_meet_in_one_shuffle(spark):
    from rosterlink.llm import linking

    items = spark.createDataFrame([(1, 9, 1, [5, 6], 70), (2, 9, 3, [6, 7], 71), (3, 8, 1, [8], 72), (4, 8, 1, [7, 6], 73)], "id long, size long, copies long, bands array<long>, rep long")
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    crowded, about = linking.meetings(items, keep)
    assert plans[0].count("Exchange hashpartitioning") == 1, plans[0]
    assert {(r.key, r.id) for r in crowded.collect()} == {(6, 1), (6, 2), (6, 4), (7, 2), (7, 4)}
    assert {tuple(r) for r in about.select("id", "size", "copies", "rep", "meetings").collect()} == {(1, 9, 1, 70, 3), (2, 9, 3, 71, 5), (4, 8, 1, 73, 5)}


def test_full_sets_are_compared_once_and_linked_exactly(spark):
    import random

    from rosterlink.llm import linking

    rng = random.Random(3)
    sets = {}
    for family in range(30):
        base = rng.sample(range(10**9), 20)
        for copy in range(rng.randrange(1, 5)):
            sets[10 * family + copy] = sorted({*base[: 20 - rng.randrange(4)], *rng.sample(range(1000), rng.randrange(4))})
    members = spark.createDataFrame([(i, m) for i, m in sets.items()], "id long, members array<long>")
    common = [(i, [10**9 + i % 2, *m[:8]]) for i, m in sets.items()]  # two keys that all share, and members
    items = spark.createDataFrame([(i, len(sets[i]), 1, keys) for i, keys in common], "id long, size long, copies long, bands array<long>")
    asked = []

    def sets_of(wanted):
        asked.append(wanted.count())
        return members.join(wanted.select("id"), "id", "left_semi")

    got = {r.id: r.root for r in linking.similar_classes(items, sets_of, 80, 100).collect()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]}):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    linked = {i for i, r in root.items() if list(root.values()).count(r) > 1}
    assert asked == [len(sets)] and linked
    assert got == {i: root[i] for i in linked}

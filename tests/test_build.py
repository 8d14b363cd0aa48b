"""The full build on hand-made inputs, every published table compared."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlink import schemas
from rosterlink.plans import build as build_plan
from rosterlink.plans import embeddings, profiles, publications, roster, search
from rosterlink.sources import readers, tables

HEADER = list(schemas.ROSTER_FIELDS)


def _roster_row(sciper, email, last, first, cf, unit, role, kind):
    return [sciper, email, last, first, "2020/01/02 03:04:05", "full", cf, unit, role, kind, 1, 2, "L2", "L3"]


ROSTER = [
    _roster_row(1, "a@x", "Picard", "Jean-Luc", 10, "Bridge", "head", "LAB"),
    _roster_row(1, "a@x", "Picard", "Jean-Luc", 11, "Hub", "member", "CENTRE"),
    _roster_row(1, "a@x", "Picard", "Jean-Luc", 10, "Bridge", "head", "LAB"),
    _roster_row(2, "b@x", "Crusher", "Beverly", 11, "Hub", "head", "CENTRE"),
    _roster_row(3, "c@x", "Data", "", 12, "Ops", "member", ""),
    _roster_row(4, "d@x", "Troi", "Deanna", 10, "Bridge old", "", "LAB"),
]


def _item(uri, people, doi=None, title=None, abstract=None, issued="2025-02", kind="Publication"):
    fields = {
        schemas.ITEM_URI: [uri], schemas.ITEM_PEOPLE: people, schemas.ITEM_DOI: [doi] if doi else None,
        schemas.ITEM_TITLE: [title] if title else None, schemas.ITEM_ABSTRACT: [abstract] if abstract else None,
        schemas.ITEM_ISSUED: [issued], schemas.ITEM_ENTITY: [kind],
    }
    return {"metadata": {k: [{"value": v} for v in vs] for k, vs in fields.items() if vs}}


ITEMS = [
    _item("repo/1", ["1", "2", "1"], "https://doi.org/10.1000/AAA.", "Deep learning for maps", None, "2025-03-01"),
    _item("repo/2", ["1", "x9"], None, "Étude  of warp fields", "old abstract", "13.05.2025"),
    _item("repo/3", ["99"], "10.1000/unknown", "Nobody's paper"),
    _item("repo/4", ["3"], "10.1000/ddd", "Positronic nets", "text", "2025"),
    _item("repo/5", ["1"], "10.1000/out", "Too early", None, "2019-01-01"),
    _item("repo/6", ["1"], "10.1000/person", "A person", None, "2025-01-01", "Person"),
]


def _work(wid, doi, title, people, index=None, year=2025, kind="article"):
    return {
        "id": wid, "doi": doi, "title": title, "publication_year": year, "type": kind, "abstract_inverted_index": index,
        "authorships": [{"author": {"id": a, "display_name": n}} for a, n in people],
    }


JL, BC, DATA = ("A1", "Jean-Luc Picard"), ("A2", "Beverly Crusher"), ("A3", "Data")
WORKS = [
    _work("W1", "https://doi.org/10.1000/aaa", "Another title", [JL, BC, (None, "nobody")], {"maps": [1], "On": [0]}),
    _work("W2", "10.1000/other", "Deep learning of maps", [JL], {"later": [0]}),
    _work("W3", None, "Etude of warp field", [JL]),
    _work("W4", None, "Etude on the warp drive", [JL, BC], {"b": [1], "a": [0, 2]}),
    _work("W5", None, None, [BC]),
    _work("W6", "10.1000/ddd", "Positronic nets", [DATA, JL]),
    _work("W7", None, "A thesis", [JL], kind="dissertation"),
    _work("W8", None, "Old work", [JL], year=2020),
]
AUTHORS = [
    {"id": "A1", "display_name": "Jean-Luc Picard", "display_name_alternatives": ["J.-L. Picard"], "orcid": "https://orcid.org/0000-0000-0000-0001", "works_count": 7},
    {"id": "A1", "display_name": "Jean-Luc Picard", "display_name_alternatives": ["J.-L. Picard"], "orcid": "https://orcid.org/0000-0000-0000-0001", "works_count": 7},
    {"id": "A2", "display_name": "Beverly Crusher", "display_name_alternatives": None, "orcid": None, "works_count": 3},
    {"id": "A3", "display_name": "Data", "display_name_alternatives": [], "orcid": None, "works_count": 1},
    {"id": "A9", "display_name": "Fixed", "display_name_alternatives": None, "orcid": None, "works_count": 1},
]
RECORDS = [
    {
        "orcid-identifier": {"path": "0000-0000-0000-0001"}, "history": {"claimed": True},
        "person": {
            "name": {"given-names": {"value": "Jean"}, "family-name": None},
            "other-names": {"other-name": [{"content": "The Captain"}]}, "emails": {"email": []}, "biography": None,
            "keywords": {"keyword": [{"content": "tea"}, {"content": "earl grey"}]},
            "researcher-urls": {"researcher-url": [{"url-name": None, "url": {"value": "http://p"}}, {"url-name": "home", "url": {"value": "http://h"}}]},
            "external-identifiers": {"external-identifier": [{"external-id-type": "Scopus", "external-id-value": "77", "external-id-url": {"value": "http://s"}}]},
        },
    },
    {"orcid-identifier": {"path": "0000-0000-0000-0777"}, "history": {"claimed": False}, "person": {"name": {}}},
]
ORCIDS = {"1": {"orcid": "0000-0000-0000-0001"}, "abc": {"orcid": "0000-0000-0000-0002"}, "999": {"orcid": "0000-0000-0000-0003"}}


def _lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    quoted = lambda v: '"' + str(v) + '"'
    (folder / "roster.csv").write_text(
        "\n".join([",".join(map(quoted, HEADER))] + [",".join(map(quoted, r)) for r in ROSTER]), encoding="utf-8"
    )
    return build_plan.Inputs(
        roster=str(folder / "roster.csv"), orcid_map=_lines(folder / "orcids.json", [ORCIDS]),
        items=_lines(folder / "items.json", ITEMS), works=_lines(folder / "works.json", WORKS),
        authors=_lines(folder / "authors.json", AUTHORS), person_records=_lines(folder / "records.json", RECORDS),
    )


CALLS = []


def _run(spark, landed, root, timestamp):
    fixed = spark.createDataFrame([(3, "A9")], "sciper long, openalex_id string")
    return build_plan.build(
        spark, landed, root, 2025, 2025, 2025, embeddings.hashed_words, "hashed", corrections=fixed, timestamp=timestamp
    )


@pytest.fixture(scope="module")
def built(spark, landed, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("out"))
    return root, _run(spark, landed, root, "20250101_000000")


def rows(spark, snapshot, name, *columns):
    df = tables.read_table(spark, snapshot, name, list(columns) or None)
    return {tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect()}


def test_roster_tables(spark, built):
    _, out = built
    assert rows(spark, out, "prof", "sciper", "lastname", "firstname") == {
        (1, "Picard", "Jean-Luc"), (2, "Crusher", "Beverly"), (3, "Data", None), (4, "Troi", "Deanna")
    }
    assert rows(spark, out, "lab", "cf", "unit_name", "unit_type") == {
        (10, "Bridge", "LAB"), (10, "Bridge old", "LAB"), (11, "Hub", "CENTRE"), (12, "Ops", None)
    }
    assert rows(spark, out, "sciper_lab") == {(1, 10, "head"), (1, 11, "member"), (2, 11, "head"), (3, 12, "member")}
    assert rows(spark, out, "sciper_orcid_integration") == {(1, "0000-0000-0000-0001")}


def test_publication_tables(spark, built):
    _, out = built
    assert rows(spark, out, "pub") == {
        (1, "repo/1", "10.1000/aaa", "Deep learning for maps", "later", 2025, "W2"),
        (2, "repo/2", None, "Étude  of warp fields", "old abstract", 2025, "W3"),
        (3, "repo/4", "10.1000/ddd", "Positronic nets", "text", 2025, None),
        (4, None, None, "Etude on the warp drive", "a b a", 2025, "W4"),
        (5, None, None, "", "", 2025, "W5"),
        (6, None, "10.1000/ddd", "Positronic nets", "", 2025, "W6"),
    }
    assert rows(spark, out, "sciper_pub", "id_pub", "sciper") == {
        (1, 1), (1, 2), (2, 1), (3, 3), (4, 1), (4, 2), (5, 2), (6, 1)
    }


def test_author_tables(spark, built):
    _, out = built
    assert rows(spark, out, "sciper_openalex", "sciper", "openalex_id", "orcid") == {
        (1, "A1", "0000-0000-0000-0001"), (2, "A2", None), (3, "A9", None)
    }
    assert rows(spark, out, "orcid") == {
        ("0000-0000-0000-0001", True, "Jean", None, ("The Captain",), (), None, "tea;earl grey")
    }
    o = "0000-0000-0000-0001"
    assert rows(spark, out, "orcid_links") == {
        (o, "url", "http://p", "http://p"), (o, "url", "home", "http://h"), (o, "Scopus", "77", "http://s")
    }


def test_vector_tables(spark, built):
    _, out = built
    vectors = {r.id_pub: np.array(r.embedding) for r in tables.read_table(spark, out, "pub_embedding").collect()}
    texts = {r[0]: f"{r[1] or ''}. {r[2] or ''}" for r in rows(spark, out, "pub", "id_pub", "title", "abstract")}
    assert set(vectors) == set(texts)
    for key, text in texts.items():
        assert np.allclose(vectors[key], embeddings.hashed_words([text])[0])
    found = tables.read_table(spark, out, "representative").toPandas()
    mean = found[(found.sciper == 1) & (found.type == "mean")].embedding.iloc[0]
    assert np.allclose(mean, np.mean([vectors[i] for i in (1, 2, 4, 6)], axis=0))
    assert sorted(found[found.sciper == 1].type) == ["cluster"] * 4 + ["mean", "recency"]
    assert set(found.sciper) == {1, 2, 3}
    view = tables.read_table(spark, out, "publications")
    assert view.count() == 8
    assert {(r.id_pub, r.source) for r in view.collect()} >= {(1, "infoscience"), (4, "openalex")}


def test_embedding_by_id_range(spark, built):
    _, out = built
    pub, cache = tables.read_table(spark, out, "pub"), tables.empty_table(spark, "embedding_cache")
    part = embeddings.embed_publications(embeddings.in_id_range(pub, 2, 4), cache, embeddings.hashed_words, "hashed")
    assert (part.texts, part.computed) == (3, 3)
    assert {r.id_pub for r in part.pub_embedding.collect()} == {2, 3, 4}
    other = embeddings.embed_publications(pub, part.added, embeddings.hashed_words, "hashed")
    assert (other.texts, other.computed) == (6, 3)


def test_second_run_embeds_nothing_new_and_publishes(spark, landed, built):
    root, first = built
    cached = spark.read.parquet(tables.table_path(root, "embedding_cache")).count()
    second = _run(spark, landed, root, "20250102_000000")
    assert spark.read.parquet(tables.table_path(root, "embedding_cache")).count() == cached == 6
    assert tables.latest_snapshot(spark, root) == second != first
    assert tables.last_update(spark, second) == "20250102_000000"
    for name in ("pub", "sciper_pub", "representative"):
        one, two = (sorted(map(str, tables.read_table(spark, s, name).collect())) for s in (first, second))
        assert one == two


def test_profiles_of_the_snapshot(spark, built):
    root, out = built
    found, updated = build_plan.open_profiles(spark, root)
    people = {r.sciper: r for r in found.collect()}
    assert set(people) == {1, 3}  # only a centre, and only a null role, are no visible unit
    one = people[1]
    assert [u.cf for u in one.labs] == [10, 10] and one.n_labs == 2  # the unit has two names
    assert (one.count_infoscience_pubs, one.count_openalex_pubs, one.count_total_pubs) == (2, 4, 4)
    assert {"jean luc picard", "picard jean luc", "picard", "the captain", "j l picard", "jean"} <= set(one.alternative_names)
    assert {(i.source, i.id) for i in one.identifiers} == {
        ("openalex", "A1"), ("orcid", "https://orcid.org/0000-0000-0000-0001"), ("url", "http://p"), ("url", "home"), ("Scopus", "77")
    }
    assert people[3].identifiers and people[3].count_total_pubs == 1
    wide, _ = build_plan.open_profiles(spark, root, include_centres=True)
    assert {r.sciper for r in wide.collect()} == {1, 2, 3}
    assert [r.sciper for r in profiles.profiles_by_unit(wide, 11).orderBy("sciper").collect()] == [1, 2]
    assert [r.sciper for r in profiles.profiles_by_unit(wide, 11, limit=1).collect()] == [1]
    assert profiles.profile_by_id(found, 2).isEmpty()
    total = profiles.summary(found, updated).first()
    assert (total["count"], total.total_pubs, total.total_unique_identifiers) == (2, 5, 6)


def test_searches_of_the_snapshot(spark, built):
    root, out = built
    found, _ = build_plan.open_profiles(spark, root)
    opened = {n: tables.read_table(spark, out, n) for n in build_plan.PROFILE_TABLES}
    names = profiles.alternative_names(opened["prof"], opened["orcid"], opened["sciper_orcid_integration"], opened["sciper_openalex"])
    asked = spark.createDataFrame([(1, "Picard, J. Luc"), (2, "data")], "query_id long, query string")
    best = search.with_profiles(search.search_names(asked, search.visible(names, found), limit=1), found)
    assert {(r.query_id, r.sciper, r.lastname) for r in best.collect()} == {(1, 1, "Picard"), (2, 3, "Data")}
    vector = embeddings.hashed_words(["Positronic nets. text"])[0].tolist()
    topic = spark.createDataFrame([(1, vector)], "query_id long, embedding array<double>")
    representative = search.visible(tables.read_table(spark, out, "representative"), found)
    for method in search.METHODS:
        top = search.search_topics(topic, representative, method, limit=2).orderBy("place").collect()
        assert top[0].sciper == 3 and top[0].match_score == 0 and len(top) == 2
    with pytest.raises(ValueError):
        search.search_topics(topic, representative, "median")
    with pytest.raises(ValueError):
        search.search_names(asked, names, limit=101)


def test_guards_and_sinks(spark, landed, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="required columns"):
        readers.read_roster(spark, str(bad))
    assert readers.read_roster(spark, landed.roster, sample=2).count() == 2
    prof = roster.people(readers.read_roster(spark, landed.roster))
    with pytest.raises(ValueError, match="no publications"):
        publications.publications(readers.read_items(spark, landed.items).where("1 = 0"), prof)
    assert [r.firstname for r in roster.in_name_order(prof).collect()] == ["Beverly", "Deanna", "Jean-Luc", None]
    tables.report(prof.select("sciper"), str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 4
    with pytest.raises(Exception):
        tables.latest_snapshot(spark, str(tmp_path / "nothing"))


def test_every_work_ends_once(spark):
    """Each work is matched or inserted exactly once, and all its people are linked."""
    pub = spark.createDataFrame(
        [(i, f"r{i}", None, f"paper number {chr(97 + i)} on things", None, 2020) for i in range(6)],
        "id_pub long, id_infoscience string, doi string, title string, abstract string, year_issued int",
    )
    links = spark.createDataFrame([(i, i % 2) for i in range(6)], "id_pub long, sciper long")
    works = spark.createDataFrame(
        [(p, f"W{i}", None, f"paper number {chr(97 + i)} on things" if i < 3 else f"entirely new title {i * 1111}", "", 2021)
         for i in range(8) for p in (0, 1)],
        "sciper long, work_id string, doi string, title string, abstract string, year_issued int",
    )
    merged, linked = publications.merge_works(pub, links, works)
    found = merged.collect()
    ids = [r.openalex_id for r in found if r.openalex_id]
    assert len(ids) == len(set(ids)) and len({r.id_pub for r in found}) == len(found)
    people = {(r.id_pub, r.sciper) for r in linked.collect()}
    new = [r.id_pub for r in found if r.id_infoscience is None]
    assert all({(i, 0), (i, 1)} <= people for i in new)

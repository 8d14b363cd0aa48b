"""Landed inputs in any layout; damaged ones raise."""

import json

import pytest

from rosterlink.plans import embeddings
from rosterlink.sources import readers, tables

ORCIDS = {"1": {"orcid": "0000-0000-0000-0001"}, "x": {"orcid": "0000-0000-0000-0009"}, "22": {"orcid": None}, "3": {"orcid": "0000-0000-0000-0003"}}
FOUND = {(1, "0000-0000-0000-0001"), (3, "0000-0000-0000-0003")}


def _landed(folder, **files):
    for name, content in files.items():
        (folder / f"{name}.json").write_text(content)
    return str(folder)


@pytest.mark.parametrize("layout", [
    json.dumps(ORCIDS), json.dumps(ORCIDS, indent=4), "\n\n" + json.dumps(ORCIDS, indent=0) + "\n",
    "\n".join(json.dumps({k: v}) for k, v in ORCIDS.items()), "{}\n" + json.dumps(ORCIDS),
    json.dumps(ORCIDS, indent=2) + "\n" + json.dumps({"1": ORCIDS["1"]}, indent=2),
])
def test_orcid_map_in_any_layout(spark, tmp_path, layout):
    path = _landed(tmp_path, map=layout)
    assert {tuple(r) for r in readers.read_orcid_map(spark, path).collect()} == FOUND


def test_orcid_map_of_files_in_different_layouts(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    more = {"4": {"orcid": "0000-0000-0000-0004"}}
    path = _landed(folder, one=json.dumps(ORCIDS, indent=2), two=json.dumps(more))
    assert {tuple(r) for r in readers.read_orcid_map(spark, path).collect()} == FOUND | {(4, "0000-0000-0000-0004")}


@pytest.mark.parametrize("layout", [
    json.dumps({"1": {"orcid": "a"}}) + "\n{broken",
    json.dumps(ORCIDS, indent=2)[:-3],
    json.dumps(ORCIDS, indent=2) + ",\n" + json.dumps(ORCIDS, indent=2)[:-1],
])
def test_damaged_orcid_map_raises(spark, tmp_path, layout):
    with pytest.raises(Exception):  # noqa: B017, PT011
        readers.read_orcid_map(spark, _landed(tmp_path, map=layout)).collect()


@pytest.mark.parametrize("reader", [readers.read_items, readers.read_works, readers.read_authors, readers.read_person_records])
def test_broken_json_line_raises(spark, tmp_path, reader):
    assert reader(spark, _landed(tmp_path, good="{}\n\n{}")).count() == 2
    with pytest.raises(Exception):  # noqa: B017, PT011
        reader(spark, _landed(tmp_path, bad="{}\n{\"id\": ")).collect()


def test_table_never_written_is_empty(spark, tmp_path):
    found = tables.read_table_if_any(spark, str(tmp_path), "embedding_cache")
    assert found.isEmpty() and found.schema == tables.empty_table(spark, "embedding_cache").schema


def test_cache_is_cut_to_the_wanted_texts_before_it_is_grouped(spark):
    pub = spark.createDataFrame([(1, "a", "b"), (2, "c", None)], "id_pub long, title string, abstract string")
    hashes = [r.text_hash for r in embeddings.publication_texts(pub).orderBy("id_pub").collect()]
    rows = [("m", hashes[0], [1.0]), ("m", hashes[0], [0.5]), ("other", hashes[1], [9.0])] + [("m", f"old{i}", [2.0]) for i in range(50)]
    cache = spark.createDataFrame(rows, "model string, text_hash string, embedding array<double>")
    found = embeddings.embed_publications(pub, cache, embeddings.hashed_words, "m")
    assert (found.texts, found.computed) == (2, 1)
    got = {r.id_pub: r.embedding for r in found.pub_embedding.collect()}
    assert got[1] == [0.5] and len(got[2]) == 16
    plan = found.pub_embedding._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Aggregate"):]


def test_one_large_map_is_read_by_several_tasks(spark, tmp_path):
    entries = ", ".join(f'"{i}": {{"orcid": "https://orcid.org/0000-0000-{i // 10000:04d}-{i % 10000:04d}", "n": {i}}}' for i in range(60_000))
    (tmp_path / "map.json").write_text("{" + entries + "}\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "400k")
        found = readers.read_orcid_map(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > 4
        assert found.count() == 60_000 and found.where("sciper = 59999").first().orcid == "0000-0000-0005-9999"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("body, rows", [
    ('{"1": {"orcid": "0000-0000-0000-0001"}}', {1}),
    ('{\n "1": {\n  "orcid": "0000-0000-0000-0001"\n },\n "2": {"orcid": "0000-0000-0000-0002"}\n}\n\n', {1, 2}),
    ('{"1": null, "2": {"orcid": "0000-0000-0000-0002", "name": "a } b"}}', {2}),
    ('{"1": {"orcid": "0000-0000-0000-0001", "more": {"a": {"b": 1}}}}', {1}),
    ('{"1": {"orcid": "0000-0000-0000-0001"}}\n{"2": {"orcid": "0000-0000-0000-0002"}}', {1, 2}),
    ("{}", set()),
    ('{"1": {"orcid": "0000-0000-0000-0001"}}}', None),
    ('{\n"1": {"orcid": "0000-0000-0000-0001"}\n}\n}', None),
    ('{"1": {"orcid": "0000-0000-0000-0001"}', None),
    ('{"1": {"orcid": "0000-0000-0000-0001"} "2": {"orcid": "0000-0000-0000-0002"}}', None),
    ('{"1": {"orcid": "0000-0000-0000-0001"}}\nrest', None),
])
def test_maps_of_every_layout(spark, tmp_path, body, rows):
    (tmp_path / "map.json").write_text(body)
    if rows is None:
        with pytest.raises(Exception):
            readers.read_orcid_map(spark, str(tmp_path)).collect()
    else:
        assert {r.sciper for r in readers.read_orcid_map(spark, str(tmp_path)).collect()} == rows

"""Scalar tables: every edge case with its expected value."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from rosterlink.functions import text as X

CASES = {
    "name_key": (X.name_key, [
        ("José  García-López", "jose garcia lopez"),
        ("O’Neil, Anne_Marie", "o neil anne marie"),
        ("Łukasz Żak", "łukasz zak"),
        (None, ""), ("  ", ""), ("A\u00a0B", "a b"),
    ]),
    "doi_key": (X.doi_key, [
        ("https://doi.org/10.1000/ABC.", "10.1000/abc"), (".10.1000/x;", "10.1000/x"),
        ("DOI:10.1000/x", "10.1000/x"), ("doi: 10.1000/x y", None),
        ("doi:https://doi.org/10.1000/x", None), ("10.123/x", None),
        ("https://www.doi.org/10.1000/x", None), ("", None), (None, None),
        ("  http://dx.doi.org/10.12345/Q!? ", "10.12345/q"),
    ]),
    "name_token": (X.name_token, [
        ("Jean-Luc Picard", "jl picard"), ("Picard, Jean-Luc", "jl picard"),
        ("Dimitri Van de Ville", "d ville"), ("van der Berg, M.", "m berg"),
        ("Łukasz Żak", "u zak"), ("Madonna", None), ("", None), (None, None),
        ("-- Doe", "- doe"), ("-Al- Doe", "a doe"), ("A,B,C", "b a"),
    ]),
    "name_token_plain": (lambda c: X.name_token(c, keep_hyphens=False), [("Jean-Luc Picard", "j picard")]),
    "text_fold": (X.text_fold, [
        ("Étude  d’une\tﬁgure", "Etude dune figure"), ("Straße", "Strae"), (None, None), ("½ № 5…", "12 No 5..."),
    ]),
    "publication_year": (X.publication_year, [
        ("2025", 2025), ("2025-03", 2025), ("13.05.2025", 2025), ("01.05.2025", 2025), ("2025-02-30", 2025),
        ("2019-2020", 2019), ("Spring 2017", 2017), ("c2018", None), ("20211", None), (None, None), ("", None),
        ("2024-05-06T07:08:09Z", 2024), ("6 May 2013", 2013), ("1500", None),
    ]),
    "orcid_key": (X.orcid_key, [
        ("https://orcid.org/0000-0001-0000-0001", "0000-0001-0000-0001"),
        ("0000-0001-0000-0001", "0000-0001-0000-0001"), ("0000-0001", None), (None, None),
    ]),
    "as_id": (X.as_id, [("12", 12), ("a1", None), ("", None), (None, None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_scalar_table(spark, name):
    fn, rows = CASES[name]
    df = spark.createDataFrame([(i, given) for i, (given, _) in enumerate(rows)], "i int, s string")
    got = [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]
    assert got == [want for _, want in rows]


def test_folds_equal_python(spark):
    chars = [chr(c) for c in range(0x80, 0x3000) if not 0xD800 <= c <= 0xDFFF]
    chars += [chr(c) for c in list(range(0xF900, 0xFFFE)) + list(range(0x1D400, 0x1D7FF))]
    # all composed characters, Hangul included, alone and in a word
    whole = [c for c in map(chr, range(0x80, 0x110000)) if not "\ud800" <= c <= "\udfff" and unicodedata.normalize("NFD", c) != c]
    chars += [*whole, *(f"a{c}b" for c in whole[::7]), "한국어 Étude 각가힣ㄱ"]
    df = spark.createDataFrame([(c,) for c in chars], "s string")
    for row in df.select(
        "s", X.strip_accents(F.col("s")).alias("nfd"), X.ascii_fold(F.col("s")).alias("asc"),
        X.strip_accents(F.col("s"), strict=True).alias("nfd2"), X.ascii_fold(F.col("s"), strict=True).alias("asc2"),
    ).collect():
        want = "".join(c for c in unicodedata.normalize("NFD", row.s) if unicodedata.category(c) != "Mn")
        assert row.nfd == want and row.nfd2 == want, hex(ord(row.s))
        want = unicodedata.normalize("NFKD", row.s).encode("ascii", "ignore").decode()
        assert row.asc == want and row.asc2 == want, hex(ord(row.s))


def test_text_from_index(spark):
    df = spark.createDataFrame(
        [(1, {"b": [1, 3], "a": [0, 2]}), (2, None), (3, {})], "i int, m map<string,array<int>>"
    )
    got = [r.v for r in df.select("i", X.text_from_index(F.col("m")).alias("v")).orderBy("i").collect()]
    assert got == ["a b a b", "", ""]


def test_index_inverts_text(spark):
    texts = ["to be or not to be", "x", "b a b a c"]
    rows = []
    for text in texts:
        index = {}
        for at, word in enumerate(text.split(" ")):
            index.setdefault(word, []).append(at)
        rows.append((text, index))
    df = spark.createDataFrame(rows, "t string, m map<string,array<int>>")
    assert all(r.t == r.v for r in df.select("t", X.text_from_index(F.col("m")).alias("v")).collect())


def test_names_and_embedding_text(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    row = df.select(
        X.full_name(F.col("x"), F.col("y")).alias("n"), X.full_name(F.col("y"), F.col("x")).alias("m"),
        X.embedding_text(F.col("x"), F.col("y")).alias("e"),
    ).first()
    assert (row.n, row.m, row.e) == ("a ", " a", "a. ")

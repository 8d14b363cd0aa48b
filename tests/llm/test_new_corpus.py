"""Merkle fingerprints, importance resampling and whitening against brute force, with the odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlink.llm import merkle, resampling, text, whitening

SCHEMA = "doc_id long, text string, n_chars long, rank int, score string, weight double, task string, fingerprint string, row string"


def body(rng, lines, stem="wo"):
    return "\n".join(
        " ".join(rng.choice(["a", "The", stem, stem + "É", f"{stem}{rng.randrange(60)}"]) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randrange(1, 30)))
        for _ in range(lines)
    )


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = [body(rng, rng.randrange(1, 9), rng.choice(["wo", "ra", "ti"])) for _ in range(90)]
    texts += [texts[4], texts[4] + "x", None, "", " \n\n \n", "É" * 4000, "one two", "\n".join(["same line of words here again"] * 300), body(rng, 900), "a\n\nb.\n\n\nc", "..."]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(7, texts[7]), (7, texts[7]), (7, texts[8]), (None, texts[9]), (None, None), (-3, "minus")]
    return [(a, b, 1, 2, "x", 0.5, "t", "f", "r") for a, b in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    text.prepared(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- Merkle trees


def pieces_of(t):
    return Counter(
        p for line in t.split("\n") for p in re.findall(r"[^.!?]{0,200}[.!?]+|[^.!?]{1,200}", line)
    )


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = pieces_of(a), pieces_of(b)
    total = sum(len(p) * n for c in (x, y) for p, n in c.items())
    return 2 * sum(len(p) * n for p, n in (x & y).items()) / total if total else 0.0


def plain_root(t):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return sha("".join(
        sha("".join(sha("".join(map(sha, re.findall(r"[^.!?]{0,200}[.!?]+|[^.!?]{1,200}", p)))) for p in s.split("\n")))
        for s in t.split("\n\n")
    ))


def test_fingerprints_equal_brute_force(docs, rows):
    got = merkle.fingerprints(docs).collect()
    assert len(got) == len(rows)
    keyed = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    unique = Counter(k for k, _ in keyed)
    by_id = {r["doc_id"]: r for r in got if unique[r["doc_id"]] == 1}
    for i, (doc_id, t) in enumerate(keyed):
        following = keyed[(i + 1) % len(keyed)]
        if unique[doc_id] > 1 or unique[following[0]] > 1:
            continue
        half = len(t) // 2
        changed = t[: len(t) - half] + following[1][:half]
        r = by_id[doc_id]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"].split("|")[0] == plain_root(t)
        assert r["edited_fingerprint"] == merkle.fingerprint(changed)
        assert r["near_edited"] == plain_likeness(t, changed)
        assert r["near_next"] == plain_likeness(t, following[1])
    # equal texts have equal fingerprints and others have others
    trees = {}
    for r in got:
        trees.setdefault(r["fingerprint"], set()).add((r["n_chars"],))
    assert len(trees) == len({r[1] or "" for r in rows})
    assert by_id[90]["fingerprint"] == by_id[4]["fingerprint"] != by_id[91]["fingerprint"]


def test_fingerprints_do_not_depend_on_layout(docs, spark):
    whole = sorted(map(str, merkle.fingerprints(docs).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 40):  # 40: tasks with one row and tasks without
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert sorted(map(str, merkle.fingerprints(docs.repartition(n)).collect())) == whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_of_one_and_none(spark, empty, docs):
    assert merkle.fingerprints(empty).count() == 0
    (one,) = merkle.fingerprints(docs.where("doc_id = 3")).collect()
    assert one["near_next"] == 1.0 and one["near_edited"] < 1.0


def test_changes_locate_edits():
    rng = random.Random(3)
    for _ in range(60):
        before = body(rng, 12).split("\n")
        if rng.random() < 0.5:
            before.insert(6, "")  # two sections
        after, kind, at = list(before), rng.randrange(3), rng.randrange(len(before))
        if kind == 0:
            after[at] = after[at] + " changed"
        elif kind == 1:
            del after[at]
        else:
            after.insert(at, "a new line.")
        one, other = "\n".join(before), "\n".join(after)
        spans = merkle.changes(merkle.fingerprint(one), merkle.fingerprint(other))
        assert bool(spans) == (one != other)
        # what lies outside of the spans is the same in both texts
        kept = [[], []]
        for side, t in enumerate((one, other)):
            at = 0
            for span in spans:
                kept[side].append(t[at : span[2 * side]])
                at = span[2 * side + 1]
            kept[side].append(t[at:])
        assert ["".join(x.split("\n")) for x in kept[0]] == ["".join(x.split("\n")) for x in kept[1]]
        if kind == 0 and one != other:
            assert len(spans) == 1


# --- importance resampling


def plain_words(t):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_resampling(rows, target, longest=1, buckets=10_000, percent=10):
    def features(t):
        w = plain_words(t)
        grams = [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
        return [zlib.crc32(g.encode()) % buckets for g in grams]

    s, t = Counter(b for r in rows for b in features(r[1])), Counter(b for x in target for b in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    scored = []
    for doc_id, x in ((r[0], r[1]) for r in rows):
        found = features(x)
        weight = sum(map(gain, found))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x))))
    able = sorted((r for r in scored if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = len(able) * percent // 100
    out = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in scored if r[4] < 20]
    return sorted(out, key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, docs, rows, longest):
    rng = random.Random(2)
    goal = [body(rng, 3, "ra") for _ in range(20)] + [None, "", "wo\nra\n\nti x"]
    target = spark.createDataFrame([(i, x) for i, x in enumerate(goal)], "item_id long, text string")
    for percent in (10, 55):
        got = resampling.resampled(docs, target, longest=longest, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resampling(rows, goal, longest, percent=percent)


def test_distinct_lines_are_described_once(docs, rows):
    got = {bytes(r["key"]): r["n"] for r in resampling.distinct_lines(docs).collect()}
    lines = Counter(x for r in rows for x in (r[1] or "").split("\n") if plain_words(x))
    assert got == {resampling.line_key(x.encode()): n for x, n in lines.items()}


def test_resampling_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(empty, none).count() == 0
    assert resampling.resampled(docs, none).where("rank = 1").count() == 1


# --- whitening


def vectors(spark, data):
    rows = [(i, v, "x", 1) for i, v in data]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string, component int").repartition(3)


def plain_x(v, width):
    return [math.floor(64 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v))


@pytest.mark.parametrize("width, n", [(5, 40), (40, 300)])
def test_whitening_equals_brute_force(spark, width, n):
    rng = np.random.default_rng(width)
    data = [(i, (rng.normal(size=width) * np.linspace(1, 4, width) + 3).tolist()) for i in range(n)]
    odd = [(900, None), (901, [*[0.5] * (width - 1), None]), (902, [float("nan")] * width), (903, [*[1.0] * (width - 1), float("inf")]),
           (904, [2.5, -1.5]), (905, []), data[0], (None, data[1][1])]
    got = whitening.whitened(vectors(spark, data + odd)).collect()
    used = data + odd[4:]
    x = np.array([plain_x(v, width) for _, v in used], dtype=object)
    sums = x.sum(axis=0)
    exact = np.array([[float(a) for a in row] for row in (x * len(used) - sums)]) / len(used)
    cov = exact.T @ exact / len(used)
    values, basis = np.linalg.eigh(cov)
    k = min(32, width)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    assert len(got) == len(used) * k
    deviation = {i: int(((len(used) * row - sums) ** 2).sum()) for (i, _), row in zip(used, x, strict=True)}
    want = exact @ basis / np.sqrt(values)
    place = {i: r for r, (i, _) in enumerate(used)}
    sign = {}
    for r in got:
        c = r["component"] - 1
        assert r["n"] == len(used) and r["deviation"] == deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9) and r["identity_error"] < 1e-9
        assert r["distance"] == pytest.approx(deviation[r["vec_id"]] / len(used) ** 2, rel=1e-9)
        expected = want[place[r["vec_id"]], c]
        if abs(expected) > 1e-3:
            assert abs(r["whitened"]) == pytest.approx(abs(expected), rel=1e-5)
            sign.setdefault(c, set()).add(np.sign(expected * r["whitened"]))
    assert all(len(s) == 1 for s in sign.values())


def test_whitening_without_variance(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitening.whitened(vectors(spark, [(1, [])])).count() == 0
    flat = whitening.whitened(vectors(spark, [(i, [float(i), 2.0, float(-2 * i)]) for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and all(r["explained"] == pytest.approx(1) for r in flat)


def test_whitening_of_large_numbers(spark):
    rng = random.Random(1)
    data = [(i, [rng.uniform(-1e12, 1e12), rng.uniform(-1e12, 1e12), rng.uniform(-1, 1)]) for i in range(30)]
    fitted = whitening.fit(vectors(spark, data))
    x = [plain_x(v, 3) for _, v in data]
    assert fitted.sums == [sum(c) for c in zip(*x, strict=True)]
    got = whitening.whitened(vectors(spark, data)).collect()
    exact = {i: sum((30 * a - s) ** 2 for a, s in zip(row, fitted.sums, strict=True)) for (i, _), row in zip(data, x, strict=True)}
    assert all(r["deviation"] is None and r["distance"] == pytest.approx(exact[r["vec_id"]] / 900) for r in got)
    with pytest.raises(Exception, match="2\\^62"):
        whitening.whitened(vectors(spark, [(1, [1e30]), (2, [0.0])])).collect()


@pytest.mark.parametrize("kind", ["plain", "equal", "diagonal", "low rank", "clusters"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 30, 90):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        if kind == "equal":
            a = np.eye(n) * 3
        elif kind == "diagonal":
            a = np.diag(rng.permutation(n) + 1.0)
        elif kind == "low rank":
            b = rng.normal(size=(n, max(1, n // 3)))
            a = b @ b.T
        elif kind == "clusters":
            q = np.linalg.qr(a)[0]
            a = (q * np.repeat([5, 5 + 1e-13, 2, 1], -(-n // 4))[:n]) @ q.T
        k = min(32, n)
        values, found = whitening.leading_eigenpairs((a + a.T) / 2, k)
        want = np.linalg.eigvalsh((a + a.T) / 2)[::-1][:k]
        assert np.abs(values - want).max() <= 1e-13 * want[0]
        assert np.abs(a @ found - found * values).max() <= 1e-12 * want[0]
        assert np.abs(found.T @ found - np.eye(k)).max() <= 1e-12

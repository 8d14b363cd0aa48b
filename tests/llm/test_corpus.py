"""Each corpus operator against brute force on a small table with the odd cases."""

import zlib
from collections import Counter, defaultdict
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from rosterlink.llm import language, lblm, minmax, mixing, packing, passages, pii, quality, simple8b, text, tokens, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, id string, score string"


def words(x):
    return WORD.findall(x or "")


def sentence(rng, n, stem):
    return " ".join(rng.choice([stem + "a", "xe" + stem, "the" if stem == "on" else "der", stem * 2, stem + str(rng.randrange(90))]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(120):
        stem, lang = [("on", "en"), ("ich", "de"), ("eau", "fr"), ("cion", "es")][i % 4]
        body = "\n".join(sentence(rng, rng.randrange(5, 60), stem) for _ in range(rng.randrange(1, 6)))
        out.append((i, body, lang, f"s{i % 5}" if i % 7 else None))
    passage = sentence(rng, 60, "zu")
    for i, at in ((5, 40), (17, 8), (40, 60)):
        w = out[i][1].split(" ")
        out[i] = (i, " ".join([*w[:at], passage, *w[at:]]), *out[i][2:])
    long = sentence(rng, 9000, "on")
    out += [(200, out[3][1], "en", "s1"), (201, out[3][1] + " end", "en", "s1"), (202, None, "en", "s0"), (203, "", None, None), (204, " \n\t ", "de", "s2")]
    out += [(205, long, "en", "s0"), (206, "12 +1 (988) 555-2485, a@b.co.uk c@d 1.2.3.4 300.1.1.1 4111 1111 1111 1111", "fr", "s3"), (207, "É" * 3000, "fr", "s3")]
    out += [(208, "Mail x.y@z.org or 10.0.0.1 now", "en", "s1"), (209, "one two", "en", "s1"), (210, "one two", "en", "s2"), (205, long, "en", "s0")]
    return [(a, b, c, d, None if b is None else len(b), 1, "x", "y") for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    text.prepared(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], len(words(r[1]))) for r in rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    taken, scatter = Counter(), Counter()
    for r in got:
        want = 2 * size[r["source"]] if r["source"] in full else level * weight[r["source"]]
        assert r["target"] == pytest.approx(want) and r["copies"] <= 2 and r["source_size"] == size[r["source"]]
        taken[r["source"]] += r["size"] * r["copies"]
        scatter[r["source"]] += r["size"] ** 2 / 4  # at most, of an independent draw
    for r in got:
        assert abs(taken[r["source"]] - r["target"]) <= 4 * scatter[r["source"]] ** 0.5
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({d: n for d, n in _copies(got).items() if n})


def test_mixing_does_not_depend_on_layout(spark, docs, rows):
    """Ties in size, repeated rows, null ids and null sources; 3, 5 and 11 partitions."""
    again = [r for r in rows if r[0] is not None][:40]
    odd = [(None, "one two", "en", None, 7, 1, "x", "y")] * 3 + [(9, "one two", "en", "s0", 7, 1, "x", "y")] * 60
    many = spark.createDataFrame([*rows, *again, *odd], SCHEMA)
    results, texts = [], []
    for n in (3, 5, 11):
        results.append(sorted(map(str, mixing.mix(many.repartition(n)).collect())))
        texts.append(sorted(map(str, mixing.mixed_documents(many.repartition(n)).collect())))
    assert results[0] == results[1] == results[2] and texts[0] == texts[1] == texts[2]
    got = mixing.mix(many).collect()
    nine = Counter(r["copies"] for r in got if r["doc_id"] == 9 and r["size"] == 2)
    assert sum(nine.values()) == 60 and len(nine) == 2  # equal rows draw one by one
    taken = Counter()
    for r in got:
        taken[r["doc_id"]] += r["copies"]
    assert Counter(eval_id(t) for t in texts[0]) == Counter({d: n for d, n in taken.items() if n})


def eval_id(row):
    found = re.match(r"Row\(doc_id=(None|-?\d+)", row).group(1)
    return None if found == "None" else int(found)


def test_mixing_targets_with_many_levels(spark):
    """Each source fills at a level of its own."""
    sizes = [(f"s{i:03d}", 3**i % 1009 + 1) for i in range(60)] + [(None, 5), ("zero", 0)]
    df = spark.createDataFrame(sizes, "source string, size long")
    got = {r["source"]: r for r in mixing.source_targets(df).collect()}
    names = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    weight, size = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, dict(sizes)
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * size[s], level * weight[s]) for s in names) < 1.5 * sum(size.values()) else (low, level)
    for s in names:
        assert got[s]["target"] == pytest.approx(min(2 * size[s], low * weight[s]), rel=1e-6)


def _copies(got):
    out = Counter()
    for r in got:
        out[r["doc_id"]] += r["copies"]
    return out


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def base_spans(x):
    out = []
    for k, (name, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, x or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = [True, name == "ip" and all(int(p) <= 255 for p in m.group().split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def listed(found):
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in found)


ODD = [
    "a@b.com_x@y.org z@@q.de .@-.-", "1.2.3.4.5.6.7.8 001.002.003.255 1.2.3.256 1.2.3", "é 4111-1111-1111-1111x 4111  1111", "+1 ) +12345678901 +1-2-3-4-5-6-7-8-9-0 .",
    "a." * 20000 + "@b", "1" * 50000, "1.1." * 500 + "@", "+" * 3000 + "1" * 9, "a@b" + ".c" * 20000, "😀 x@y.zz 😀1.2.3.4",
]


def test_personal_data(spark, docs, rows, empty):
    more = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(ODD)], "doc_id long, text string")
    both = [(r[0], r[1]) for r in rows] + [(1000 + i, x) for i, x in enumerate(ODD)]
    got = {r["doc_id"]: r for r in pii.personal_data(docs.select("doc_id", "text").unionByName(more)).collect()}
    for d, x in both:
        want = base_spans(x)
        assert got[d]["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest(), d
        assert [got[d][f"n_{k}"] for k, _ in KINDS] == [sum(s[1] == i for s in want) for i in range(4)]
        assert set(listed(want).split(",")) - {""} <= set(got[d]["spans"].split(","))
    assert pii.personal_data(empty).count() == 0
    clean = {r["doc_id"]: r for r in pii.redacted(docs).collect()}
    assert clean[208]["text"] == "Mail <EMAIL> or <IP> now" and clean[208]["n_chars"] == 24
    assert clean[1]["text"] == rows[1][1] and clean[202]["text"] is None


def test_patterns_find_unseen_identifiers(spark):
    seeds = [(i, f"filler {i} contact mailbox u{i}@site{i}.org today") for i in range(30)]
    hidden = (50, "other words contact mailbox someone@intranet today")
    plain = (51, "a different text with someone@elsewhere and 1234567 things")
    df = spark.createDataFrame([*seeds, hidden, plain], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    at = hidden[1].index("someone")
    assert got[50] == f"email:{at}:{at + len('someone@intranet')}" and got[51] == ""


def test_found_identifiers_induce_patterns(spark):
    """Ten found by the seeds' pattern also stand at another one, which then finds an eleventh."""
    rows = [(i, f"filler {i} contact mailbox u{i}@site{i}.org today") for i in range(30)]
    rows += [(100 + i, f"other {i} contact mailbox p{i}@intranet now") for i in range(10)]
    rows += [(200 + i, f"more {i} responsible clerk p{i}@intranet then") for i in range(10)]
    rows += [(300, "last words responsible clerk someone@intranet end"), (301, "far off someone@elsewhere end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    at = rows[-2][1].index("someone")
    assert got[300]["spans"] == f"email:{at}:{at + len('someone@intranet')}" and got[301]["spans"] == ""
    assert all(got[100 + i]["spans"] and got[200 + i]["spans"] for i in range(10))
    assert (got[300]["n_email"], got[300]["n_all_email"], got[0]["n_email"], got[0]["n_all_email"]) == (0, 1, 1, 1)


def test_copies_of_a_text_do_not_lower_a_pattern(spark):
    seeds = [(i, f"filler {i} contact mailbox u{i}@site{i}.org today{i}") for i in range(30)]
    copies = [(100 + i, "one more contact mailbox x@site.org today, contact mailbox is empty") for i in range(3000)]
    hidden = (50, "other words contact mailbox someone@intranet today")
    df = spark.createDataFrame([*seeds, *copies, hidden], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).where("doc_id < 101").collect()}
    at = hidden[1].index("someone")
    assert got[50] == f"email:{at}:{at + len('someone@intranet')}" and got[100].count("email") == 1


def test_patterns_with_glued_marks_and_long_words(spark):
    rows, hidden = [], {}
    for k, label in enumerate(("call tel:", "ask (", "l" * 50 + " " + "m" * 50 + " ")):
        rows += [(100 * k + i, f"filler{i} {label}+1 988 555 {1000 + i} end{i}") for i in range(30)]
        rows += [(100 * k + 50, f"other {label}5551234567 now")]
        hidden[100 * k + 50] = f"phone:{len('other ' + label)}:{len('other ' + label) + 10}"
    rows += [(350 + i, f"filler{i} write mailto:u{i}@site.org end{i}") for i in range(30)] + [(390, "other write mailto:someone@intranet now")]
    hidden[390] = "email:19:35"
    rows += [(400 + i, f"filler{i} see ref:+1 988 777 {1000 + i} end{i}") for i in range(30)] + [(450, "other see ref:5557654321 now")]
    rows += [(500 + i, f"filler{i} see ref:none{i} end{i}") for i in range(300)]  # mostly something else stands there
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    assert {d: got[d] for d in [*hidden, 450]} == {**hidden, 450: ""}


def exact_ids(xs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in xs], add_special_tokens=False)]


def test_word_tokenizer_is_exact():
    xs = ["don't <|startoftext|>x a<|endoftext|> 'S İIı ΑΣ x\x85q ª'll e.g., naïve?!... x\x1cy ªº µ Ñ.. ß:", "a" * 100 + " " + "b" * 70 + "..", "", None, "éa ́ é", "A,B c.D E"]
    assert [tokens.word_tokenizer(tokens.default_path()).ids(x) for x in xs] == [i.tobytes() for i in exact_ids(xs)]


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 61, 4095, 4097, 20000):
        for v in (rng.integers(0, 2, n), rng.integers(0, 1 << 17, n), 2.0 ** (rng.random(n) * 63.9)):
            v = np.asarray(v, np.uint64)
            packed, blocks, escapes = simple8b.encode(v)
            assert (simple8b.decode(packed, escapes) == v).all()
            if n > 8192:
                assert (simple8b.decode(packed[blocks[1] : blocks[2]], escapes) == v[4096:8192]).all()


def test_token_files(spark, docs, rows, empty):
    got = sorted(tuple(r) for r in simple8b.read(spark, simple8b.write(docs)).collect())
    want, at = [], 0
    order = sorted(range(len(rows)), key=lambda i: rows[i][0])
    for i, ids in zip(order, exact_ids([rows[i][1] for i in order]), strict=True):
        want.append((rows[i][0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)
    assert simple8b.read(spark, simple8b.write(empty)).count() == 0


def shingles(x):
    w = [v.translate(LOWER) for v in words(x)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, docs, rows, empty):
    rng = random.Random(8)
    base = sentence(rng, 150, "on").split()
    family = []
    for i in range(60):  # variants of one text, many below the threshold to each other
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        family.append((500 + i, " ".join(w)))
    small = [(600 + i, " ".join(base[: 10 + i])) for i in range(12)]
    every = [(r[0], r[1]) for r in rows] + family + small
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(family + small, "doc_id long, text string"))
    sets = {d: shingles(x) for d, x in every}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = minmax.near_duplicates(df).collect()
    assert len(got) == len(every)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert minmax.near_duplicates(empty).count() == 0
    assert minmax.without_near_duplicates(docs).columns == docs.columns
    assert 200 not in {r["doc_id"] for r in minmax.without_near_duplicates(docs).select("doc_id").collect()}
    # whatever its doc_id, one row of a class stays
    assert minmax.without_near_duplicates(docs).where("doc_id = 205").count() == 1
    again = docs.sparkSession.createDataFrame([*rows, (None, rows[5][1], *rows[5][2:]), (None, rows[5][1], *rows[5][2:]), (None, "of its own", *rows[5][2:])], SCHEMA)
    left = minmax.without_near_duplicates(again)
    assert [r["text"] for r in left.where("doc_id IS NULL").collect()] == ["of its own"]
    assert left.where("doc_id IS NOT NULL").count() == minmax.without_near_duplicates(docs).count()
    assert minmax.bands_for((85, 100)) == (44, 8) and minmax.bands_for((80, 100)) == (46, 6)
    nulls = spark.createDataFrame([(None, "a b c d e f"), (None, "q"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, minmax.near_duplicates(nulls).select("component_id").collect())) == sorted(map(str, [Row(component_id=3), Row(component_id=None), Row(component_id=3)]))


def test_stages_keep_columns_of_any_name(docs):
    from corpus_pipeline import STAGES

    clashing = ["copies", "row", "doc", "key", "spans", "size", "kept", "lang_pred", "component_id", "value"]
    wide = docs.select("*", *[F.col("doc_id").alias(c) for c in clashing])
    for name, stage in STAGES[:-1]:
        out = stage(docs.sparkSession, wide, "")
        assert out.columns == wide.columns, name
        assert all(r["doc_id"] == r[c] for r in out.select("doc_id", *clashing).collect() for c in clashing), name


def test_first_fit_decreasing():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 100) for _ in range(300)]
    room = []
    for i in sorted(range(300), key=lambda i: -sizes[i]):
        bin_ = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
        if bin_ == len(room):
            room.append(100)
        assert packing.first_fit_decreasing(sizes, 100)[i] == (bin_, 100 - room[bin_])
        room[bin_] -= sizes[i]


def test_packing(docs, rows, empty):
    got = packing.pack(docs, group=40).collect()
    ids = defaultdict(list)
    for r, own in zip(rows, exact_ids([r[1] for r in rows]), strict=True):
        ids[r[0]].append(own)
    pieces = Counter()
    for r in got:
        own = ids[r["doc_id"]][0]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces[r["doc_id"]] += r["length"]
    assert pieces == Counter({d: sum(map(len, x)) for d, x in ids.items()})
    fill = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048
    assert packing.pack(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(700, 8)) * rng.gamma(1, 1, size=(700, 1)), np.zeros((20, 8)), np.ones((60, 8))])
    data = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)] + [(5, [1.0] * 8, 2), (None, [9.0] * 8, 2), (900, None, 2), (920, [1.0, None], 2), (940, [math.nan] * 8, 2), (960, [2.0], 1), (980, [], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    ints = [(i, np.pad(np.floor(64 * np.asarray(v, np.float32).astype(float)), (0, 8 - len(v)))) for i, v, _ in data if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    ids, m = np.array([i for i, _ in ints]), np.stack([v for _, v in ints])
    want = []
    for q in sorted({int(i) for i in ids if i % 20 == 0}):
        scores = m @ m[np.flatnonzero(ids == q)[0]]
        other = np.flatnonzero(ids != q)
        best = other[np.lexsort((ids[other], -scores[other]))][:20]
        want += [(q, k + 1, int(ids[j]), int(scores[j])) for k, j in enumerate(best)]
    bucket, topk.BUCKET = topk.BUCKET, 64
    try:
        assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    finally:
        topk.BUCKET = bucket
    assert topk.top_k(df.where("false")).count() == 0


def test_quality(docs, rows, empty):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for d, x, *_ in rows:
        w, seen, doubles, covered = words(x), set(), 0, set()
        for line in (x or "").split("\n"):
            if WORD.search(line):
                doubles += line in seen
                seen.add(line)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        for i in range(len(w) - 7):
            if windows[tuple(w[i : i + 8])] > 1:
                covered.update(range(i, i + 8))
        r = got[d]
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), doubles, len(covered)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality.judge(empty).count() == 0


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.7
    right = np.array([0.9, 0.8, 0.75, 0.95])
    votes = np.where(rng.random((20000, 4)) < right, 1, -1) * np.where(good, 1, -1)[:, None]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, p = quality.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.05 and np.abs(p[1, :, 2] - right).max() < 0.05


def test_language(docs, rows, empty):
    got = language.identified(docs).collect()
    truth = {r[0]: r for r in rows}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, truth[r["doc_id"]][1] or "")))
    held = [r for r in got if r["held_out"] and r["doc_id"] < 120]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][2] for r in held]) > 0.95
    assert language.identified(empty).count() == 0
    assert {r["lang_pred"] for r in language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language.recognised(docs)
    assert kept.columns == docs.columns and kept.where("score = 'y'").count() == len([r for r in got if r["lang_pred"] != "und"])
    clash = docs.withColumns({"lang_pred": F.lit("a"), "_score": F.lit("b"), "score_0": F.lit("c"), "lang_pred_0": F.lit("d")})
    again = language.recognised(clash)
    assert again.columns == clash.columns and again.where("lang_pred = 'a' AND _score = 'b' AND score_0 = 'c' AND lang_pred_0 = 'd'").count() == kept.count()
    # a null language is the one found; without labels all texts with a letter stay
    assert docs.where("lang IS NULL").count() and kept.where("lang IS NULL").count() == 0
    bare = language.recognised(docs.withColumn("lang", F.lit(None).cast("string")))
    assert bare.count() == kept.count() and bare.where("lang IS NOT NULL").count() == 0


def test_scores(docs, rows, empty):
    tok = [(r[0], [w.translate(LOWER) for w in words(r[1])] + ["\n"]) for r in rows]
    c = Counter(w for d, t in tok if zlib.crc32(str(d).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lblm.scores(docs).collect()}
    for d, t in tok:
        r = got[d]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isfinite(r["score"]) and r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lblm.scores(empty).count() == 0


def test_known_words_and_joined_words_score_alike(docs, monkeypatch):
    want = {r["doc_id"]: r for r in lblm.scores(docs).collect()}
    monkeypatch.setattr(lblm, "CLASSES", 10)
    monkeypatch.setattr(lblm, "KNOWN", 10)
    for r in lblm.scores(docs).collect():
        assert r["base_score"] == pytest.approx(want[r["doc_id"]]["base_score"]) and r["n_known"] == want[r["doc_id"]]["n_known"]


def test_class_probabilities_sum_to_one():
    # two words with classes, one known and others unknown in two groups
    vocab = lblm.Vocabulary({b"a": 0, b"b": 1, b"c": 2}, np.array([5, 3, 2]), 2, 2, np.array([0, 1, 3]), np.array([1, 4]), np.array([1, 2]), 2, 15, 6)
    scorer = lblm.Scorer(lblm.start(vocab))
    for context in range(vocab.size**2):
        p = 10 ** scorer.log10(np.full(vocab.size - 1, context), np.arange(vocab.size - 1))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_normalisers_in_shared_slots(monkeypatch):
    vocab = lblm.Vocabulary({b"a": 0, b"b": 1}, np.array([5, 3]), 2, 1, np.array([0, 1]), np.array([4]), np.array([2]), 2, 14, 5)
    whole = lblm.Scorer(lblm.start(vocab))
    monkeypatch.setattr(lblm, "REMEMBERED", 3)
    few = lblm.Scorer(lblm.start(vocab))
    context = np.tile(np.arange(vocab.size**2), 3)
    for target in range(vocab.size - 1):
        assert np.allclose(few.log10(context, np.full(len(context), target)), whole.log10(context, np.full(len(context), target)))


def test_classes_grow_with_the_words(spark):
    assert lblm.class_numbers(10**8)[0] > lblm.class_numbers(10**7)[0] > lblm.class_numbers(10**3)[0]
    assert lblm.class_numbers(10**8)[1] > lblm.class_numbers(10**6)[1]
    rows = [(i, " ".join(f"w{k}" for k in range(50 * i, 50 * i + 400))) for i in range(40)]
    counts = lblm.word_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    vocab = lblm.vocabulary(counts, 40)
    truth = Counter(w.encode() for _, t in rows for w in t.split())
    tokens, members = Counter(), Counter()
    for w, n in truth.items():
        if vocab.words[w] >= vocab.classes:
            tokens[zlib.crc32(w) % vocab.groups] += n
            members[zlib.crc32(w) % vocab.groups] += 1
    assert tokens == Counter({i: n for i, n in enumerate(vocab.group_tokens.tolist())}) and members == Counter({i: n for i, n in enumerate(vocab.group_words.tolist())})
    assert vocab.classes == lblm.CLASSES < len(truth)


def test_models_are_averaged_over_trainers(docs):
    counts = lblm.word_counts(docs)
    vocab = lblm.vocabulary(counts, docs.count())
    pairs = lblm.trigrams(docs, vocab)
    one, many = lblm.fit(pairs, vocab, rounds=1), lblm.fit(pairs, vocab, rounds=1, tokens_per_trainer=vocab.tokens // 5)
    assert not np.allclose(one.q, many.q) and np.isfinite(many.q).all() and one.q.shape == many.q.shape


def test_passages(docs, rows, empty):
    got = passages.repeated_passages(docs).collect()
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append(r)
    assert {5, 17, 40, 3, 200, 201} <= set(found)
    first = defaultdict(set)
    for d, x, *_ in rows:
        w = [v.translate(LOWER) for v in words(x)]
        for i in range(len(w) - 19):
            first[tuple(w[i : i + 20])].add(d)
    shared = {d for ds in first.values() if len(ds) > 1 for d in ds}
    assert set(found) <= shared  # nobody else is touched
    over = defaultdict(set)
    for d, x, *_ in rows:
        w = [v.translate(LOWER) for v in words(x)]
        for i in range(len(w) - 50):
            over[tuple(w[i : i + 51])].add(d)
    assert {d for ds in over.values() if len(ds) > 1 for d in ds} <= set(found)
    assert passages.repeated_passages(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in passages.without_repeats(docs).collect()}
    other = (3, "words of its own " * 40, "en", "s1", 5, 1, "x", "y")
    both = docs.sparkSession.createDataFrame([*rows, other, (None, rows[3][1], "en", "s1", 5, 1, "x", "y")], SCHEMA).withColumn("cuts", F.lit("k")).withColumn("key", F.lit("k"))
    kept = passages.without_repeats(both)
    assert kept.columns == both.columns
    texts = [r["text"] for r in kept.where("doc_id = 3").collect()]
    assert other[1] in texts and len(texts) == 2  # a row with the same id and another text loses nothing
    assert [r["text"] for r in kept.where("doc_id IS NULL").collect()] == [rows[3][1]]
    assert clean[1] == rows[1][1] and len(clean[200]) < len(rows[3][1]) and clean[3] == rows[3][1] and clean[202] is None


def test_similar_lines_meet():
    rng = np.random.default_rng(5)
    pairs = [np.split(rng.integers(0, 2**64, 50, np.uint64), [40, 45]) for _ in range(4000)]  # 40 of 50 shingles: 0.8
    sets = [np.concatenate([p[0], own]) for p in pairs for own in p[1:]]
    keys = minmax.min_max_bands(np.concatenate(sets), np.arange(len(sets)) * 45, *passages.LINES)
    assert (keys[::2] == keys[1::2]).any(axis=1).all()


def common_runs(x, y, least):
    """Spans of words of ``x`` in the longest runs that ``y`` has too."""
    out = set()
    for i in range(len(x)):
        for j in range(len(y)):
            if x[i] == y[j] and not (i and j and x[i - 1] == y[j - 1]):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, i + n))
    return out


def test_passages_reach_as_far_as_the_common_run(spark):
    rng = random.Random(6)
    fresh = (f"w{i}" for i in range(10**6))
    take = lambda n: [next(fresh) for _ in range(n)]
    texts = {}
    for n in range(30):
        passage = take(rng.choice([51, 60, 90, 150]))
        for k in range(2):
            texts[2 * n + k] = take(rng.randrange(40, 70)) + passage + take(rng.randrange(40, 70))
    longer = take(130)  # the first document has the middle of it only
    texts[100] = take(60) + longer[25:95] + take(60)
    for d in (101, 102):
        texts[d] = take(30) + longer + take(30)
    gap = {d: [rng.choice([" ", "  ", "\t", " é "]) for _ in t] for d, t in texts.items()}
    raw = {d: "".join(g.replace("é", "") + w for g, w in zip(gap[d], t, strict=True)) for d, t in texts.items()}
    raw[103] = " ".join(take(5)) + "\n" + (line := " ".join(take(30))) + "\n" + (tail := " ".join(take(12))) + " " + " ".join(take(9))
    raw[104] = line + "\n" + tail + "\n" + " ".join(take(7))
    df = spark.createDataFrame(list(raw.items()), "doc_id long, text string").repartition(4)
    got = defaultdict(set)
    for r in passages.repeated_passages(df).collect():
        got[r["doc_id"], r["removed"]].add(raw[r["doc_id"]][r["start"] : r["end"]])
    spans = lambda d, runs: {tuple(texts[d][a:b]) for a, b in runs}
    for n in range(30):
        for d, other in ((2 * n, 2 * n + 1), (2 * n + 1, 2 * n)):
            assert {tuple(x.split()) for x in got[d, d > other]} == spans(d, common_runs(texts[d], texts[other], 20)), d
    assert {tuple(x.split()) for x in got[100, False]} == {tuple(longer[25:95])}
    assert {tuple(x.split()) for x in got[101, True]} == {tuple(longer[25:95])}
    # what the first document lacks stays here; windows across the border are in both rows
    assert set(longer) >= {w for x in got[101, False] for w in x.split()} >= {*longer[:25], *longer[95:]}
    assert {tuple(x.split()) for x in got[102, True]} == {tuple(longer)}
    assert got[104, True] == {line + "\n" + tail}


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near-dedup", "pii", "mixing", "packing"]
    step = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, step, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/step{i}")
        step = spark.read.parquet(f"{tmp_path}/step{i}")
    left = {r["doc_id"]: r["text"] for r in step.collect()}
    assert not {202, 203, 204, 200, 201, 210} & set(left) and "x.y@z.org" not in left.get(208, "")
    taken = Counter(r["doc_id"] for r in step.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == taken
    ids = dict(zip(left, exact_ids(left.values()), strict=True))
    assert sum(r["length"] for r in packed) == sum(len(ids[d]) * n for d, n in taken.items())


def test_lines_above_threshold_share_a_key(spark):
    # lines of 20 to 40 words, some alike at 0.8 and a little above, short lines between them
    rng = random.Random(11)
    rows = []
    for pair in range(300):
        w = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 41))]
        v = w[: -1 - pair % 2] + ["changed"] * (1 + pair % 2)  # (n - 1) / (n + 1) or (n - 2) / (n + 2) of n shingles
        for k, x in enumerate((w, v)):
            rows.append((2 * pair + k, "short line\n" + " ".join(x) + "\nend"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = [r for r in passages.paragraphs(docs).collect() if r["line"]]
    ids = sorted({r["id"] for r in keyed})
    sets = {r["id"]: set(r["members"]) for r in passages.paragraph_sets(docs.withColumn("wanted", F.array(*[F.lit(i) for i in ids]))).collect()}
    keys = defaultdict(set)
    for r in keyed:
        keys[r["id"]] |= set(r["bands"])
    close = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert close and all(keys[a] & keys[b] for a, b in close)


def test_lm_training_takes_every_trigram(spark):
    vocab = lblm.Vocabulary({b"a": 0, b"b": 1}, np.array([5, 3]), 2, 1, np.array([0, 1]), np.array([4]), np.array([2]), 2, 14, 5)
    size = vocab.size
    common, rare = (vocab.begin * size + vocab.begin) * size, (0 * size + 1) * size + 2  # begin begin -> a; a b -> the group
    counts = spark.createDataFrame([(common, 10**8), (rare, 1)], "code long, n long")
    model, first = lblm.fit(counts, vocab, rounds=1), lblm.start(vocab)
    # a and b are context only in the rare trigram: it must have been trained on
    assert not np.allclose(model.r[:2], first.r[:2])


def test_lines_carry_their_prefix_keys_alone(spark):
    # a line's keys are its prefix: bands beside them found no more links and filled the disk
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(20, 200)))) for i in range(40)]
    keyed = [r for r in passages.paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["line"]]
    assert len(keyed) == len(rows)
    assert all(len(r["bands"]) == r["size"] - (80 * r["size"] + 99) // 100 + 1 for r in keyed)

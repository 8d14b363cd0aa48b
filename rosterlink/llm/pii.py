"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are identifiers that the base expressions find. The words around them induce lexical
patterns: the two words before, or the word before and the word after. A pattern's score is
the mean score of the different identifiers it stands at (seeds have 1, others what their
patterns give them), times the share of identifier-like strings among all places where the
pattern's words stand in the corpus. Scores are found in rounds on the graph of patterns and
instances; a string of the right form that the base expressions miss is personal data if
patterns of at least ``SUPPORT`` different seeds score it ``CONFIDENT`` or more. It then is a
seed itself, weighing its score, and patterns are induced anew, until a generation adds nothing.

Base matches are leftmost and do not overlap within a kind; those that fail their check are
dropped without another try. The expressions are guarded against restarts inside a run and
never backtrack, so very long runs take linear time. Positions are code points, ends
exclusive. Null texts are empty: no spans. Equal texts share one analysis. Repeated rows
have equal results; extra columns are kept by ``redacted``, ignored otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.text import SPACES
from rosterlink.session import staged

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3
CONFIDENT = 0.8
ROUNDS = 3

_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
# what an identifier may be glued to
_FIRST_MARK = r"^([A-Za-z0-9._%+@-]*+[^A-Za-z0-9._%+@-]++)[A-Za-z0-9._%+@-]"
_LAST_MARK = r"^(.*[^A-Za-z0-9._%+@-])[A-Za-z0-9._%+@-]"

# The same matches as the plain expressions: a run is entered at its start, or where the match before ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_IP_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

# Strings that look like an identifier whether or not a base expression takes them; opening marks and labels are not in them.
_LIKE = {
    "email": r"(?<![^\x20\x09-\x0D:=\"'(<\[])[^\x20\x09-\x0D@:=\"'(<\[]++@[^\x20\x09-\x0D@]++",
    "number": r"(?<![A-Za-z0-9._%+@-])\+?(?:\((?=[0-9\x20.-]{1,12}\)[\x20.-]{0,2}[0-9]))?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}(?![A-Za-z0-9@])",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _passes(kind: str, found: Column) -> Column:
    digits = _digits(found)
    return {
        "email": F.lit(True),
        "ip": found.rlike(_IP_PARTS),
        "card": F.length(digits).between(14, 19) & F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def _matches(text: Column, expression: str) -> Column:
    """Array of ``start, end, value`` of all matches."""
    values = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    between = F.split(text, expression, -1)
    state = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))

    def step(s: Column, pair: Column) -> Column:
        start = s["at"] + F.length(pair["before"])
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(values)), values, lambda b, v: F.struct(b.alias("before"), v.alias("value")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    # most texts have no match at all
    return F.when(text.rlike(expression), F.aggregate(pairs, state, step, lambda s: s["out"])).otherwise(none)


def _base(text: Column) -> Column:
    """Array of ``start, kind, end, value`` of all base spans, by start, then kind."""

    def of(number: int, kind: str) -> Column:
        found = F.filter(_matches(text, BASE[kind]), lambda m: _passes(kind, m["value"]))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    return F.array_sort(F.concat(*[of(number, kind) for number, kind in enumerate(KINDS)]))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def _key(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def _context(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The two words before and the word behind, lower-cased; there may be fewer."""

    def split(piece: Column) -> Column:
        return F.filter(F.split(F.lower(piece), SPACES), lambda w: w != "")

    # a piece may cut its outermost word: with one more than needed the rest are whole
    near = split(F.substr(text, F.greatest(start - 80, F.lit(0)) + 1, F.least(start, F.lit(80))))
    words = F.when((F.size(near) > 2) | (start <= 80), near).otherwise(split(F.substr(text, F.lit(1), start)))
    next_ = split(F.substr(text, end + 1, F.lit(40)))
    behind = F.when((F.size(next_) > 1) | (F.length(text) <= end + 40), next_).otherwise(split(F.substr(text, end + 1, F.length(text))))
    return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), behind


def analysed(texts: DataFrame) -> DataFrame:
    """``key, seen`` of each text with a digit or an at sign: spans found and strings that look alike."""
    found = texts.where(F.col("text").rlike("[0-9@]")).select("text").withColumn("base", _base(F.col("text")))

    def alike(form: str) -> Column:
        return F.transform(_matches(F.col("text"), _LIKE[form]), lambda m: F.struct(F.lit(form).alias("form"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))

    kinds = [alike(form) for form in _LIKE]
    free = F.filter(F.concat(*kinds), lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    seen = F.concat(
        F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"))),
        F.transform(free, lambda m: F.struct(F.when(m["form"] == "email", 0).otherwise(-1).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"))),
    )

    def placed(m: Column, index: Column) -> Column:
        left, right = _context(F.col("text"), m["start"], m["end"])
        return F.struct(
            m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lower(m["value"]).alias("value"),
            (index < F.size("base")).alias("seed"), left.alias("left"), F.element_at(F.concat(right, F.array(F.lit(""))), 1).alias("right"),
        )

    return found.select(_key().alias("key"), F.transform(seen, placed).alias("seen"))


def _patterns(left: Column, right: Column) -> Column:
    """Hashes of the patterns at a place: two words before; one before and one behind."""
    two = F.when(F.size(left) == 2, F.xxhash64(F.lit(1), left[0], left[1]))
    around = F.when((F.size(left) > 0) & (right != ""), F.xxhash64(F.lit(2), F.element_at(left, -1), right))
    return F.filter(F.array(two, around), lambda p: p.isNotNull())


def _places(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``pattern, places``: where the patterns' words stand in the different texts, whatever is there."""
    words = F.split(F.btrim(F.lower("text"), F.lit(_WHITE)), SPACES)
    listed = texts.select(_key().alias("key"), words.alias("w")).where(F.size("w") > 1)
    # a row per word with its neighbours, so that hashes are compiled expressions and no row carries its text
    n = F.size("w")
    beside = F.arrays_zip(
        F.concat(F.array(F.lit(None).cast("string")), "w").alias("before"), F.col("w").alias("x"),
        F.slice("w", 2, n).alias("behind"), F.slice("w", 3, n).alias("next"),
    )
    near = listed.select("key", F.posexplode(beside).alias("i", "z")).select("key", "i", "z.*").where(F.col("x").isNotNull())
    marked = F.col("x").rlike(_FIRST_MARK)
    near = near.select(
        "*", *[F.when(marked, F.nullif(F.regexp_extract("x", cut, 1), F.lit(""))).alias(c) for c, cut in (("first", _FIRST_MARK), ("last", _LAST_MARK))]
    )

    def two(left: Column, word: Column) -> Column:
        return F.when(left.isNotNull() & word.isNotNull(), F.xxhash64(F.lit(1), left, word))

    def around(word: Column, right: Column) -> Column:
        return F.when(word.isNotNull() & right.isNotNull(), F.xxhash64(F.lit(2), word, right))

    x, before, behind, first = F.col("x"), F.col("before"), F.col("behind"), F.col("first")
    plain = [two(x, behind), F.when(behind.isNotNull(), around(x, F.col("next")))]
    # where a word is glued to what follows, its beginning alone stands there too
    other = F.when(F.col("last") != first, F.col("last"))
    glued = [two(before, first), around(first, behind), two(before, other), around(other, behind)]
    hashes = F.when(first.isNotNull(), F.array(*plain, *glued)).otherwise(F.array(*plain))
    at_word = near.select("key", "i", F.posexplode(hashes).alias("at", "pattern")).where(F.col("pattern").isNotNull())
    met = at_word.join(patterns, "pattern", "left_semi")
    # hits are counted once in copies of a text, so places are too
    return met.distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("places"))


def discovered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``key, start, kind, end`` of the spans that patterns add, and ``key`` with the base spans."""
    texts = docs.where(F.col("text").isNotNull())
    # behind the aggregate, so that the filter is not worked out a second time over the texts
    found = staged(analysed(texts).dropDuplicates(["key"]).where(F.size("seen") > 0))
    spots = staged(
        found.select("key", F.explode("seen").alias("s")).select("key", "s.*")
        .select("key", "kind", "start", "end", "value", "seed", F.explode(_patterns(F.col("left"), F.col("right"))).alias("pattern"))
    )
    # one edge for each pattern and instance, however often they meet
    edges = staged(spots.groupBy("pattern", "value", "kind", "seed").agg(F.count(F.lit(1)).alias("times")))
    # patterns that can ever be backed, and stand at some string to be judged; their places are counted once for all generations
    able = edges.groupBy("pattern").agg(
        F.count_distinct("value").alias("values"), F.sum("times").alias("hits"), F.bool_or(~F.col("seed")).alias("asked")
    ).where(F.col("asked") & (F.col("values") >= SUPPORT))
    able = staged(able.select("pattern", "hits"))
    # a pattern whose words nowhere stand as words of the text has its hits for places
    shares = staged(able.join(staged(_places(texts.select("text"), able.select("pattern"))), "pattern", "left").select(
        "pattern", F.least(F.col("hits") / F.greatest(F.coalesce("places", F.lit(0)), "hits"), F.lit(1.0)).alias("share")
    ))
    graph = staged(edges.join(shares, "pattern"))
    sure = staged(graph.limit(0).select("value", F.col("kind").cast("int").alias("means"), F.lit(1.0).alias("score")))
    while True:
        more = staged(_generation(graph, sure))
        if more.isEmpty():
            break
        sure = staged(sure.unionByName(more))
    added = spots.where(~F.col("seed")).join(sure, "value").select("key", "start", F.col("means").alias("kind"), "end").distinct()
    base = found.select("key", F.filter("seen", lambda s: s["seed"]).alias("seen"))
    return added, base


def _generation(graph: DataFrame, sure: DataFrame) -> DataFrame:
    """``value, means, score`` of instances that become sure with the seeds and those sure before."""
    grown = graph.join(sure, "value", "left")
    backing = F.col("seed") | F.col("means").isNotNull()
    form = F.when(F.col("seed"), F.col("kind")).otherwise(F.col("means"))
    kinds = [F.count_distinct(F.when(backing & (form == i), F.col("value"))).alias(f"k{i}") for i in range(len(KINDS))]
    backed = grown.groupBy("pattern").agg(F.count_distinct(F.when(backing, F.col("value"))).alias("seeds"), *kinds).where(F.col("seeds") >= SUPPORT)
    most = F.greatest(*[F.col(f"k{i}") for i in range(len(KINDS))])
    kind = reduce(lambda rest, i: F.when(F.col(f"k{i}") == most, i).otherwise(rest), reversed(range(len(KINDS))), F.lit(None))
    live = staged(grown.join(backed.select("pattern", kind.alias("stands_for")), "pattern").withColumn("sure", F.col("means").isNotNull()).withColumnRenamed("score", "was"))
    scores = live.select("value").distinct().withColumn("score", F.lit(0.0))
    for _ in range(ROUNDS):
        own = F.when(F.col("seed"), 1.0).when(F.col("sure"), F.col("was")).otherwise(F.col("score"))
        known = live.join(scores, "value").withColumn("now", own)
        rated = known.groupBy("pattern").agg((F.max("share") * F.avg(F.when(F.col("now") > 0, F.col("now")))).alias("trust"))
        doubt = F.exp(F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999)))))
        scores = staged(live.join(rated, "pattern").groupBy("value").agg((1 - doubt).alias("score")))
    new = live.where(~F.col("seed") & ~F.col("sure")).groupBy("value").agg(F.min("stands_for").cast("int").alias("means"))
    return scores.where(F.col("score") >= CONFIDENT).join(new, "value").select("value", "means", "score")


def spans(docs: DataFrame) -> DataFrame:
    """``key, base, spans`` of each different text with personal data; arrays of ``start, kind, end`` in order."""
    added, base = discovered(docs)
    more = added.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    own = F.transform("seen", lambda s: F.struct(s["start"].alias("start"), s["kind"].cast("int").alias("kind"), s["end"].alias("end")))
    return staged(
        base.join(more, "key", "left").select("key", F.array_sort(own).alias("base"), F.coalesce("more", none).alias("more"))
        .select("key", "base", F.array_sort(F.array_union("base", "more")).alias("spans")).where(F.size("spans") > 0)
    )


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row, and ``n_all_email`` and so on.

    ``n_`` count base spans, ``n_all_`` those that patterns add as well.
    """
    joined = docs.select("doc_id", _key().alias("key")).join(spans(docs), "key", "left")
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    full = joined.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("all"))

    def number_of(spans: str, kind: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    counts = [number_of("base", n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    all_counts = [number_of("all", n).alias(f"n_all_{k}") for n, k in enumerate(KINDS)]
    return full.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"), *all_counts)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.col("doc.text")

    def step(s: Column, span: Column) -> Column:
        piece = F.concat(s["out"], F.substr(whole, s["at"] + 1, F.greatest(span["start"] - s["at"], F.lit(0))), F.element_at(names, span["kind"] + 1))
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), F.when(span["start"] >= s["at"], piece).otherwise(s["out"]).alias("out"))

    clean = F.aggregate("spans", state, step, lambda s: F.concat(s["out"], F.substr(whole, s["at"] + 1, F.length(whole))))
    # the whole row is one column, so no name of the input can clash
    rows = docs.select(_key().alias("key"), F.struct(*docs.columns).alias("doc"))
    # as many texts move at every size: whether spans are few is no matter
    found = spans(docs).select("key", "spans").hint("shuffle_hash")
    text = F.when(F.col("spans").isNull(), whole).otherwise(clean)
    made = rows.join(found, "key", "left").select("doc", text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return made.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])

"""Edit-distance join without comparing all pairs.

Two texts within distance t, the right one cut into t + 1 segments, share at least one
segment whole, shifted by a bounded number of places (Li et al., PassJoin, PVLDB 2011).
So right texts are indexed by segment and left texts probe the segments they could
share; the join is an equi-join on a hash of (group, length, segment).

A segment that very many right texts share would pair them all. Such hot segments are
not joined. A pair that shares no other has both its texts among those with a hot segment,
and these meet a second time, each text once, by its rarest grams of three characters within
their group (prefix filtering: Xiao et al., Ed-Join, PVLDB 2008). A template that thousands of texts share
is the last thing they are looked up by; what sets a text apart comes first. Texts down to t
characters are within the distance of each other anyway.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import text
from rosterlink.session import staged

# right texts under one key that are paired directly
HOT_KEY_TEXTS = 512
# before and behind a text whose grams are taken
_FRAME = "\x01\x01"
# characters from which the equal ends of two texts are cut off before comparing
LONG_TEXT = 300


def _probe_specs(distance: int) -> list[tuple[int, int, int]]:
    """(length difference, shift, segment) of every segment a left text may share.

    A shift by s places before the segment and a difference of d in all cost at least
    |s| + |d - s| edits. Segment -1 stands for right texts too short to cut, then the
    first number is their length.
    """
    reach = range(-distance, distance + 1)
    shifts = [(d, s) for d in reach for s in reach if abs(s) + abs(d - s) <= distance]
    return [(d, s, g) for d, s in shifts for g in range(distance + 1)] + [(n, 0, -1) for n in range(distance + 1)]


def _segments(texts: DataFrame, distance: int, specs: list[tuple[int, int, int]], fits: Column) -> DataFrame:
    """``id, grp, key, start, size``: one row per spec that fits the text."""
    listed = json.dumps([{"d": d, "s": s, "g": g} for d, s, g in specs])
    each = F.explode(F.from_json(F.lit(listed), "array<struct<d:int,s:int,g:int>>"))
    rows = texts.withColumn("length", F.length("text")).select("*", each.alias("p")).select("*", "p.*")
    rows = rows.withColumn("other", F.expr("CASE WHEN g < 0 THEN d ELSE length - d END"))
    rows = rows.withColumns({
        "start": F.expr(f"CASE WHEN g < 0 THEN 0 ELSE other * g DIV {distance + 1} END"),
        "end": F.expr(f"CASE WHEN g < 0 THEN 0 ELSE other * (g + 1) DIV {distance + 1} END"),
    }).select("id", "grp", "text", "length", "d", "g", "other", (F.col("start") + F.col("s")).cast("int").alias("start"),
              (F.col("end") - F.col("start")).cast("int").alias("size"))
    piece = F.substring(F.col("text"), F.col("start") + 1, F.col("size"))
    return rows.where(fits).select("id", "grp", F.xxhash64("grp", "other", "g", piece).alias("key"), "start", "size")


def _indexed(texts: DataFrame, distance: int) -> DataFrame:
    """One row per segment of each right text."""
    specs = [(0, 0, g) for g in range(distance + 1)] + [(n, 0, -1) for n in range(distance + 1)]
    fits = F.expr(f"CASE WHEN g < 0 THEN length = d ELSE length > {distance} END")
    return _segments(texts, distance, specs, fits)


def _probes(texts: DataFrame, distance: int) -> DataFrame:
    """One row per segment a left text may share with a right text."""
    fits = F.expr(
        f"CASE WHEN g < 0 THEN abs(length - d) <= {distance} "
        f"ELSE other > {distance} AND start >= 0 AND start + size <= length END"
    )
    return _segments(texts, distance, _probe_specs(distance), fits)


def _grams(texts: DataFrame, distance: int, right: bool) -> DataFrame:
    """``id, grp, length, q, gram``: the different q-grams of each text, framed so that its ends count.

    An edit touches q grams at most, so of texts with more than q * distance grams two within
    the distance share one: three characters serve right texts of 3 * distance - 1 characters
    on, single ones the shorter. Left texts have those that right texts in their reach need.
    """
    long_from = 3 * distance - 1
    length = F.length("text")
    if right:
        sizes = F.array(F.when(length >= long_from, 3).otherwise(1))
    else:
        sizes = F.array_compact(F.array(F.when(length + distance >= long_from, 3), F.when(length - distance < long_from, 1)))
    framed = texts.select("id", "grp", length.alias("length"), F.explode(sizes).alias("q"), "text").withColumn(
        "text", F.when(F.col("q") == 1, F.col("text")).otherwise(F.concat(F.lit(_FRAME), "text", F.lit(_FRAME)))
    )
    places = F.sequence(F.lit(1), F.greatest(F.length("text") - F.col("q") + 1, F.lit(1)))
    grams = F.array_distinct(F.transform(places, lambda at: F.substring(F.col("text"), at, F.col("q"))))
    return framed.select("id", "grp", "length", "q", F.explode(grams).alias("gram"))


def _rarest(grams: DataFrame, numbers: DataFrame, distance: int) -> DataFrame:
    """``id, grp, length, q, gram``: each text's q * distance + 1 grams that fewest right texts of its group have."""
    counted = grams.join(numbers, ["grp", "q", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = F.slice(F.sort_array(F.collect_list(F.struct("n", "gram"))), F.lit(1), F.col("q") * distance + 1)
    return counted.groupBy("id", "grp", "length", "q").agg(first.alias("first")).select("id", "grp", "length", "q", F.explode("first.gram").alias("gram"))


def _rare_pairs(left: DataFrame, right: DataFrame, distance: int) -> DataFrame:
    """Candidates among texts whose segments are common: they meet by their rarest grams.

    By one order of all grams, rarest first, two texts within the distance share one of the
    first q * distance + 1 of each: a text that many share leaves its common grams last.
    """
    rights, lefts = _grams(right, distance, True), _grams(left, distance, False)
    numbers = staged(rights.groupBy("grp", "q", "gram").agg(F.count(F.lit(1)).alias("n")))
    index = _rarest(rights, numbers, distance)
    reach = F.sequence(F.greatest(F.col("length") - distance, F.lit(distance + 1)), F.col("length") + distance)
    fits = (F.col("other") >= 3 * distance - 1) == (F.col("q") == 3)
    probes = _rarest(lefts, numbers, distance).where("length > 0").withColumn("other", F.explode(reach)).where(fits)
    keys = [F.xxhash64("grp", "q", "gram", size).alias("key") for size in ("other", "length")]
    return probes.select(keys[0], F.col("id").alias("left_id")).join(index.select(keys[1], F.col("id").alias("right_id")), "key").select("left_id", "right_id")


def _candidates(left: DataFrame, right: DataFrame, distance: int, hot_texts: int) -> DataFrame:
    probes, index = _probes(left, distance), _indexed(right, distance)
    hot = staged(index.where("size > 0").groupBy("key").count().where(F.col("count") > hot_texts).select("key"))
    if hot.isEmpty():
        return _meeting(probes, index).distinct()
    # a pair that shares hot segments alone has both its texts here, each once
    sides = []
    for texts, rows in ((left, probes), (right, index)):
        met = rows.join(hot, "key", "left_semi").select("id").distinct()
        sides.append(staged(texts.join(met, "id", "left_semi")))
    cool = _meeting(probes.join(hot, "key", "left_anti"), index.join(hot, "key", "left_anti"))
    return cool.unionByName(_rare_pairs(*sides, distance)).distinct()


def _meeting(probes: DataFrame, index: DataFrame) -> DataFrame:
    return probes.select("key", F.col("id").alias("left_id")).join(index.select("key", F.col("id").alias("right_id")), "key").select("left_id", "right_id")


def _shared_start(a: Column, b: Column) -> Column:
    """Length of the common start of two texts, found by halving steps."""
    steps = F.lit([2**n for n in range(20, -1, -1)])

    def grow(known: Column, step: Column) -> Column:
        same = (F.substring(a, known + 1, step) == F.substring(b, known + 1, step)) & (
            known + step <= F.least(F.length(a), F.length(b))
        )
        return F.when(same, known + step).otherwise(known)

    return F.aggregate(steps, F.lit(0), grow)


def bounded_distance(a: Column, b: Column, distance: int) -> Column:
    """Edit distance up to a bound, else -1; long texts are compared between their differing ends only."""

    def between(ends: Column) -> Column:
        x, y = F.reverse(ends["x"]), F.reverse(ends["y"])
        rest = text.let(_shared_start(x, y), lambda n: F.struct(
            F.substring(x, n + 1, F.length(x)).alias("x"), F.substring(y, n + 1, F.length(y)).alias("y")
        ))
        return text.let(rest, lambda r: F.levenshtein(r["x"], r["y"], distance))

    ends = text.let(_shared_start(a, b), lambda n: F.struct(
        F.substring(a, n + 1, F.length(a)).alias("x"), F.substring(b, n + 1, F.length(b)).alias("y")
    ))
    long_ones = text.let(ends, between)
    return F.when(a == b, 0).when(F.length(a) < LONG_TEXT, F.levenshtein(a, b, distance)).otherwise(long_ones)


def edit_pairs(left: DataFrame, right: DataFrame, distance: int, hot_texts: int = HOT_KEY_TEXTS) -> DataFrame:
    """All pairs within ``distance`` edits in the same scope: ``left_id, right_id, distance``.

    Both sides hold ``id`` (unique), ``scope`` (any type, null never pairs) and ``text``,
    with no text twice in a scope, and are read several times: give them staged.
    """
    left = left.where("scope IS NOT NULL AND text IS NOT NULL").select("id", "scope", "text")
    right = right.where("scope IS NOT NULL AND text IS NOT NULL").select("id", "scope", "text")
    grouped = [side.select("id", F.xxhash64("scope").alias("grp"), "text") for side in (left, right)]
    pairs = _candidates(*grouped, distance, hot_texts)
    # hashes only propose; scope and text decide
    checked = (
        pairs.join(left.select(F.col("id").alias("left_id"), F.col("scope").alias("ls"), F.col("text").alias("lt")), "left_id")
        .join(right.select(F.col("id").alias("right_id"), F.col("scope").alias("rs"), F.col("text").alias("rt")), "right_id")
        .where("ls = rs")
        .select("left_id", "right_id", bounded_distance(F.col("lt"), F.col("rt"), distance).alias("distance"))
    )
    return checked.where(F.col("distance") >= 0)


def _keyed(df: DataFrame, scope: str, body: str, id_col: str) -> DataFrame:
    """Rows that can match, staged: ``row_id, scope, text, id`` with id the hash of scope and text."""
    usable = df.where(F.col(body).isNotNull() & (F.col(body) != "") & F.col(scope).isNotNull())
    own = F.sha2(F.concat_ws("\x00", F.col(scope).cast("string"), F.col(body)), 256)
    return staged(usable.select(
        F.col(id_col).alias("row_id"), F.col(scope).alias("scope"), F.col(body).alias("text"), own.alias("id")
    ))


def nearest_text(
    left: DataFrame, right: DataFrame, scope: str, body: str, left_id: str, right_id: str,
    distance: int, hot_texts: int = HOT_KEY_TEXTS,
) -> DataFrame:
    """Per left row the nearest right row of its scope, ties to the lowest right id.

    Gives ``scope, left_id, right_id, distance`` for the left rows that have one. Null or
    empty texts never match. Copies of a text in a scope are compared as one.
    """
    lefts, rights = _keyed(left, scope, body, left_id), _keyed(right, scope, body, right_id)
    left_texts, right_texts = staged(lefts.dropDuplicates(["id"])), staged(rights.dropDuplicates(["id"]))
    lowest = rights.groupBy(F.col("id").alias("right_id")).agg(F.min("row_id").alias("best_id"))
    best = (
        edit_pairs(left_texts, right_texts, distance, hot_texts).join(lowest, "right_id")
        .groupBy(F.col("left_id").alias("id")).agg(F.min(F.struct("distance", "best_id")).alias("best"))
    )
    return lefts.select("id", "row_id", "scope").join(best, "id").select(
        F.col("scope").alias(scope), F.col("row_id").alias(left_id),
        F.col("best.best_id").alias(right_id), F.col("best.distance").alias("distance"),
    )

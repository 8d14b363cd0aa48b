"""From band keys to exact classes of similar sets, without all pairs of a group.

Items that share a band key form a bucket. Each bucket first compares its members with one
hub, the item that meets most others over all its bands (the original of a family of near
copies, where there is one). What that links is closed to components. Items of buckets whose
members are still in different components then meet by prefix filtering of their full sets,
across components only; this step finds all their links, banded or not. Pairs inside
a component need no look, so a family of thousands of near copies costs its size, and no
link between components is lost. Rows of a key or member are brought together and counted
in one shuffle, and full sets are shuffled for the first comparison alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlink.session import staged, temporary


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for the ends of the edges ``a, b``; the root is the smallest id of the class.

    Alternating large and small stars: each round points every end to the smallest of its
    neighbours, until nothing moves. Each round is written, so lost executors cost one round.
    """
    edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select(F.col("b").alias("v"), F.col("a").alias("u"))
        if large:
            both = both.unionByName(df.select(F.col("a").alias("v"), F.col("b").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")) if large else both.groupBy("v").agg(F.min("u").alias("m"))
        joined = both.join(least, "v")
        if large:
            out = joined.where("u > v").select(F.col("m").alias("a"), F.col("u").alias("b"))
        else:
            out = joined.select(F.col("m").alias("a"), F.col("u").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
        return out.where("a <> b").distinct()

    before = mark(edges)
    while before[0]:
        with temporary(edges.sparkSession) as keep:
            edges = keep(star(staged(star(edges, large=True)), large=False))
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


def _comparable(a: str, b: str, num: int, den: int) -> Column:
    return F.least(F.col(a), F.col(b)) * den >= F.greatest(F.col(a), F.col(b)) * num


def _by_common_members(items: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``id, size, root, ms, met``: of each of ``items`` its members ``n, m`` that ``n`` > 1 sets have, rarest first.

    Two items share none but these. Items with too few of them to be similar to any are left out.
    """
    if 2 * items.count() < sets.count():
        sets = staged(sets.join(items.select("id"), "id", "left_semi"))
    counted = sets.select("id", F.explode("members").alias("m")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("m")))
    common = counted.where("n > 1").repartition("id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "m"))).alias("ms"))
    return staged(common.join(items, "id").withColumn("met", F.size("ms")).where(F.col("met") * den >= F.col("size") * num))


def _prefix_pairs(ordered: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: every pair of items of different roots that may be similar enough, by prefix filtering.

    With members in a common order, rarest first, two similar sets share a member among the
    first few of each. In a family of near copies those are the members that only one copy has.
    """

    def first(share: int, of: int) -> Column:
        """The first places of the whole order, less those of members that no other set has."""
        places = F.col("size") - F.floor((F.col("size") * share + of - 1) / of) + 1 - (F.col("size") - F.col("met"))
        return F.posexplode(F.slice("ms.m", 1, F.greatest(places, F.lit(0)).cast("int")))

    # the smaller set of a pair may look at fewer
    larger = ordered.select("id", "size", "root", "met", first(num, den)).withColumnRenamed("col", "m")
    smaller = ordered.select("id", "size", "root", "met", first(2 * num, num + den)).toDF("id2", "size2", "root2", "met2", "pos2", "m")
    ranked = (F.col("size2") < F.col("size")) | ((F.col("size2") == F.col("size")) & (F.col("id2") < F.col("id")))
    # what they can share at most: up to this member, and behind it
    most = F.least("pos", "pos2") + 1 + F.least(F.col("met") - F.col("pos"), F.col("met2") - F.col("pos2")) - 1
    enough = most * (num + den) >= (F.col("size") + F.col("size2")) * num
    pairs = larger.join(smaller, "m").where(ranked & (F.col("root") != F.col("root2")) & _comparable("size", "size2", num, den) & enough)
    return pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def similar_classes(items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """``id, root`` of the items with a link; linked are sets with den * |A n B| >= num * |A u B|.

    ``items``: ``id, size, copies, bands`` (64-bit keys), one row per id. ``sets_of`` gives
    ``id, members`` (array of distinct 64-bit hashes), one row per id, for a table of items that
    has all their columns but ``bands``.
    """
    with temporary(items.sparkSession) as keep:
        return keep(_classes(*meetings(items, staged), sets_of, num, den))


def meetings(items: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``key, id`` of the keys met twice, and the items that have one: their columns but ``bands``, and ``meetings``.

    Both are written by ``keep``; after that the items' keys are not needed any more.
    """
    # one shuffle brings the rows of a key together and counts them; keys travel with ids alone
    counted = items.select("id", F.explode("bands").alias("key")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    crowded = keep(counted.where("n > 1"))
    total = crowded.groupBy("id").agg(F.sum("n").alias("meetings"))
    return crowded, keep(items.drop("bands").join(total, "id"))


def classes_of(crowded: DataFrame, about: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """``similar_classes`` from the ``meetings`` of the items."""
    with temporary(crowded.sparkSession) as keep:
        return keep(_classes(crowded, about, sets_of, num, den))


def _classes(crowded: DataFrame, about: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    # one row per set that meets another, with what it is ranked by
    rank = F.struct((-F.col("meetings")).alias("m"), (-F.col("copies")).alias("c"), "id", "size")
    ranked = crowded.select("key", "id").join(about.select("id", "size", rank.alias("rank")), "id")
    hubs = ranked.withColumn("hub", F.min("rank").over(Window.partitionBy("key")))
    shared = staged(hubs.select("key", "id", "size", F.col("hub.id").alias("hub"), F.col("hub.size").alias("hub_size")))
    sets = staged(sets_of(about.drop("meetings")))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("id").alias("b"), F.col("size").alias("right_size"), F.col("members").alias("right")), "b").join(
            sets.select(F.col("id").alias("a"), F.col("size").alias("left_size"), F.col("members").alias("left")), "a"
        )
        common = F.size(F.array_intersect("left", "right"))
        return both.where(common * den >= (F.col("left_size") + F.col("right_size") - common) * num).select("a", "b")

    stars = staged(shared.where((F.col("id") != F.col("hub")) & _comparable("size", "hub_size", num, den)).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    links = staged(confirmed(stars, sets.withColumn("size", F.size("members"))))
    roots = staged(components(links))
    labelled = shared.join(roots, "id", "left").select("key", "id", "size", F.coalesce("root", "id").alias("root"))
    by_key = Window.partitionBy("key")
    several = labelled.withColumns({"x": F.min("root").over(by_key), "y": F.max("root").over(by_key)}).where("x <> y")
    undecided = staged(several.select("id", "size", "root").distinct())
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ordered = _by_common_members(undecided, sets, num, den)
    across = staged(_prefix_pairs(ordered, num, den).join(tested, ["a", "b"], "left_anti"))
    more = staged(confirmed(across, ordered.select("id", "size", F.col("ms.m").alias("members"))))
    if more.isEmpty():
        return roots
    return staged(components(links.unionByName(more)))

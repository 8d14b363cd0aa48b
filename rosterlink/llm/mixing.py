"""Mixing sources to target weights: whole copies plus one hash-seeded Bernoulli copy.

A source's rate is its target over its size. Each document is taken floor(rate) times and once
more where its draw is below the fraction. The draw is a hash of seed, id, source, text and
number among equal rows, so it depends on no file layout and on no other document; what a
source yields scatters about its target as independent draws do, by the root of
fraction * (1 - fraction) * the sum of squared sizes.

Null texts have size 0 and a null source is a source of its own, last in order. Repeated rows
are documents of their own, with draws of their own. An empty table gives an empty mix. All
columns of the input are kept, whatever their names; rows that differ in these alone share
their draws in no stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlink.llm.text import WORD
from rosterlink.operators.numbering import with_position
from rosterlink.session import shuffle_partitions, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST_COPIES = 2.0
SEED = 7
_RUN = 10_000  # equal rows laid out at once


def size_in_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES
) -> DataFrame:
    """``source, source_size, target, rate`` of a table ``source, size``; one row per source.

    Sources by code point, null last, have the weights in turn. A target above ``most`` times
    the source's size stops there, and the excess goes to the others by weight: by rising bound
    over weight, a source is full as long as the level its forerunners leave passes its bound.
    """
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_last", F.col("source").isNull())
    placed = with_position(named, ["_last", "source"], name="_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    bound = F.col("source_size") * float(most)
    plan = placed.select("source", "source_size", weight.alias("_weight"), bound.alias("_most"))
    # sums of all forerunners: those of the tasks before, and those in the own task
    laid_out = staged(
        plan.withColumn("_turn", F.col("_most") / F.col("_weight"))
        .repartitionByRange(shuffle_partitions(sizes.sparkSession), "_turn", "source").sortWithinPartitions("_turn", "source")
        .withColumn("_task", F.spark_partition_id())
    )
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = laid_out.groupBy("_task").agg(F.sum("_most").alias("m"), F.sum("_weight").alias("w"))
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0.0)).alias(f"_{c}_before") for c in ("m", "w")]  # one row per task
    inside = Window.partitionBy("_task").orderBy("_turn", "source").rowsBetween(Window.unboundedPreceding, -1)
    held = [(F.coalesce(F.sum(c).over(inside), F.lit(0.0)) + F.col(f"_{b}_before")).alias(f"_{b}") for c, b in (("_most", "m"), ("_weight", "w"))]
    total = laid_out.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    left = laid_out.join(tasks.select("_task", *before), "_task").select("_turn", *held)
    level = (F.lit(float(share)) * float(total["size"] or 0) - F.col("_m")) / (F.lit(float(total["weight"] or 0.0)) - F.col("_w"))
    row = left.select("_turn", level.alias("level")).where(F.col("level") < F.col("_turn")).agg(F.min_by("level", "_turn").alias("level")).first()
    target = F.col("_most") if row["level"] is None else F.least(F.col("_most"), F.lit(row["level"]) * F.col("_weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return staged(laid_out.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate"))


def _named(doc_id: Column, source: Column, text: Column) -> Column:
    """What makes rows equal: a hash of id, source and text."""
    return F.sha2(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(source, F.lit("")), F.sha2(F.coalesce(text, F.lit("")), 256)), 256)


def _copies(rate: Column, name: Column, number: Column, seed: int) -> Column:
    """Whole copies and the drawn one; a draw is 52 bits of a hash."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), name, number.cast("string")), 256)
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def _of_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the source's columns; the plan has one row per source."""
    return rows.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "p.source_size", "p.target", "p.rate")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED
) -> DataFrame:
    """``doc_id, size, source, source_size, target, copies`` per row of ``docs``; no texts travel."""
    name = _named(F.col("doc_id"), F.col("source"), F.col("text"))
    # equal rows are one with their number until all is known
    counted = staged(
        docs.select("doc_id", "source", name.alias("name"), size_in_words().alias("size"), F.col("text").isNull().alias("_none"))
        .groupBy("doc_id", "source", "name", "size", "_none").agg(F.count(F.lit(1)).alias("n"))
    )
    plan = source_targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    runs = _of_source(counted, plan).withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(_RUN).cast("long"))))
    numbered = runs.withColumn("number", F.explode(F.sequence("_from", F.least(F.col("_from") + (_RUN - 1), F.col("n")))))
    copies = _copies(F.col("rate"), F.col("name"), F.col("number"), seed)
    return numbered.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"))


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED
) -> DataFrame:
    """The documents themselves, each as often as it is taken, with the input's columns.

    Texts stay where they are read, but for those of rows that repeat.
    """
    # the whole row is one column, so no name of the input can clash
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").alias("source"), _named(F.col("doc_id"), F.col("source"), F.col("text")).alias("name"))
    counted = staged(
        docs.select("source", _named(F.col("doc_id"), F.col("source"), F.col("text")).alias("name"), size_in_words().alias("size"))
        .groupBy("source", "name", "size").agg(F.count(F.lit(1)).alias("n"))
    )
    plan = source_targets(counted.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    repeated = staged(counted.where("n > 1").select("name").distinct())
    once = rows.withColumn("number", F.lit(1).cast("long"))
    if not repeated.isEmpty():
        again = rows.join(repeated, "name", "left_semi").withColumn("_row", F.monotonically_increasing_id())
        again = with_position(again.select(*rows.columns, "_row"), ["_row"], within=["name"], name="number").drop("_row")
        once = once.join(repeated, "name", "left_anti").select(*once.columns).unionByName(again.select(*once.columns))
    taken = _of_source(once, plan).withColumn("copies", _copies(F.col("rate"), F.col("name"), F.col("number"), seed))
    return taken.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")

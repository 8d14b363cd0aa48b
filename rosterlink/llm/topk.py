"""Exact top-k inner products by norm buckets, with per-bucket pruning.

Vectors become integers and are bucketed by length, longest first. A block of queries meets
a bucket only if the bound |q| * (bucket's longest) reaches the score that the query already
has k times; inside, each query looks at the bucket in one of two ways by its local cosine
threshold: from a low one on, the prefix of vectors long enough (length pruning); from a
high one on, only vectors whose coordinate at the query's largest one lies in the feasible
range (coordinate pruning). What is left is verified by exact products. Bounds never drop a
vector that ties, so results are those of brute force.

Rows with a null id, a null vector or null or non-finite components take no part. Shorter
vectors, empty ones included, count as padded with zeros. Rows that repeat a vec_id are candidates of their own,
never for a query of the same id; repeated queries are answered once. Products must stay
below 2^53, which the first step checks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlink.operators.numbering import with_position
from rosterlink.session import staged

SCALE = 64
BUCKET = 4096  # vectors
BLOCK = 1024  # queries
HIGH_COSINE = 0.6  # local threshold from which coordinates prune
_SLACK = 1e-9  # bounds are rounded up by this part


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, ints, norm`` of the rows that take part."""
    usable = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    )
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    norm = F.sqrt(F.aggregate("ints", F.lit(0.0), lambda a, x: a + x * x.cast("double")))
    return vectors.where(usable).select("vec_id", ints.alias("ints")).withColumn("norm", norm)


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def search_bucket(q: np.ndarray, q_ids, q_norm, floor, v: np.ndarray, v_ids, v_norm, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k best of a bucket (longest vector first) that reach ``floor``."""
    by_value = [None] * v.shape[1]
    for i in range(len(q)):
        if q_norm[i] * v_norm[0] * (1 + _SLACK) < floor[i]:
            continue
        cosine = floor[i] / (q_norm[i] * v_norm[0]) if q_norm[i] * v_norm[0] > 0 else -1.0
        if cosine >= HIGH_COSINE:
            # with unit vectors, q.v >= c leaves v's coordinate f in q_f c -+ sqrt((1 - q_f^2)(1 - c^2))
            f = int(np.argmax(np.abs(q[i])))
            if by_value[f] is None:
                unit = v[:, f] / np.maximum(v_norm, 1e-300)
                order = np.argsort(unit, kind="stable")
                by_value[f] = (order, unit[order])
            order, unit = by_value[f]
            qf, c = q[i, f] / q_norm[i], min(1.0, cosine)
            half = np.sqrt(max(0.0, (1 - qf * qf) * (1 - c * c)))
            low, high = qf * c - half - 1e-7, qf * c + half + 1e-7
            high = 1.0 if qf >= c else high  # vectors closer to the axis than the cone's rim
            low = -1.0 if -qf >= c else low
            at = order[np.searchsorted(unit, low) : np.searchsorted(unit, high, "right")]
        else:
            long_enough = floor[i] / q_norm[i] * (1 - _SLACK) if q_norm[i] > 0 else -np.inf
            at = np.arange(np.searchsorted(-v_norm, -long_enough, "right"))
        if not len(at):
            continue
        scores = v[at] @ q[i]
        keep = (scores >= floor[i]) & (v_ids[at] != q_ids[i])
        at, scores = at[keep], scores[keep]
        best = _best(scores, v_ids[at], k)
        yield i, v_ids[at[best]], scores[best]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose vec_id is divisible by ``every``."""
    usable = staged(integer_vectors(vectors, scale))
    width, longest = usable.agg(F.max(F.size("ints")), F.max("norm")).first()
    schema = "query_id long, vec_id long, score long"
    if width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if longest * longest >= 2**53:
        raise ValueError("inner products pass 2^53")
    placed = with_position(usable.withColumn("_short", -F.col("norm")), ["_short", "vec_id"], name="_place")
    buckets = staged(
        placed.withColumn("bucket", F.floor((F.col("_place") - 1) / BUCKET))
        .groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("_short", "vec_id", "ints"))).alias("rows"), F.max("norm").alias("longest"))
    )
    asked = with_position(usable.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), ["norm", "vec_id"], name="_place")
    blocks = staged(
        asked.withColumn("block", F.floor((F.col("_place") - 1) / BLOCK))
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("norm", "vec_id", "ints"))).alias("queries"), F.max("norm").alias("widest"))
    )

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, queries, floors in zip(batch["rows"], batch["queries"], batch["floors"], strict=True):
                v, v_ids = _matrix([r["ints"] for r in rows], width), np.array([r["vec_id"] for r in rows], np.int64)
                q, q_ids = _matrix([r["ints"] for r in queries], width), np.array([r["vec_id"] for r in queries], np.int64)
                v_norm, q_norm = np.array([-r["_short"] for r in rows]), np.array([r["norm"] for r in queries])
                known = {} if floors is None else {r["query_id"]: r["floor"] for r in floors}
                floor = np.array([known.get(x, -np.inf) for x in q_ids.tolist()], float)
                for i, ids, scores in search_bucket(q, q_ids, q_norm, floor, v, v_ids, v_norm, k):
                    yield pd.DataFrame({"query_id": q_ids[i], "vec_id": ids, "score": scores.astype(np.int64)})

    # The longest bucket gives each query a first floor: its k-th score there.
    none = F.lit(None).cast("array<struct<query_id:long,floor:double>>")
    longest_bucket = F.broadcast(buckets.where("bucket = 0").select("bucket", "rows"))  # BUCKET vectors at most
    spread = blocks.repartition(max(8, 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    first = staged(spread.withColumn("bucket", F.lit(0).cast("long")).join(longest_bucket, "bucket").select("rows", "queries", none.alias("floors")).mapInPandas(meet, schema))
    kth = first.groupBy("query_id").agg(F.min("score").cast("double").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    owner = blocks.select("block", F.explode("queries.vec_id").alias("query_id"))
    floors = owner.join(kth.drop("n"), "query_id", "left").groupBy("block").agg(
        F.collect_list(F.when(F.col("floor").isNotNull(), F.struct("query_id", "floor"))).alias("floors"),
        F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("lowest"),
    )
    # Blocks meet the buckets that can reach the lowest floor among them: a join of summaries, not of vectors.
    summary = staged(blocks.join(floors, "block").select("block", "widest", "lowest", "floors"))
    reach = F.col("widest") * F.col("longest") * (1 + _SLACK) >= F.col("lowest")
    pairs = summary.select("block", "widest", "lowest").join(buckets.where("bucket > 0").select("bucket", "longest"), reach).select("block", "bucket")
    rest = (
        pairs.join(buckets.select("bucket", "rows"), "bucket")
        .join(blocks.select("block", "queries").join(summary.select("block", "floors"), "block"), "block")
        .select("rows", "queries", "floors").repartition(max(8, 4 * vectors.sparkSession.sparkContext.defaultParallelism))
        .mapInPandas(meet, schema)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

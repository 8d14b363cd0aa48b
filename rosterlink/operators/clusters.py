"""k-means inside each key: k = min(rows, 5), centroid = mean of the members.

Seeding takes the row with the lowest id, then repeatedly the row farthest from the
chosen ones (ties to the lowest id); rows go to the nearest centroid (ties to the lowest
cluster), until none moves. That makes the result independent of the partitioning.

Keys of ordinary size are solved whole, one task holding one key's rows. A key with more
rows than that is solved by Spark rounds over all tasks with the same rules, where only
per-cluster sums are ever shuffled. Both add coordinates as integers (multiples of a power of
two that leaves room for all rows) and squares dimension by dimension, so neither the order of
rows nor the way taken shows in a single bit of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.operators.vectors import as_double_array, euclidean
from rosterlink.session import staged

# Fixed value: most clusters per key.
MAX_CLUSTERS = 5
# rounds after which a key that still moves is an error
MAX_ROUNDS = 1000
# rows of one key that one task may hold: 120 MB at 1,536 doubles a row
ROWS_IN_ONE_TASK = 10_000


def _unsettled(rounds: int) -> RuntimeError:
    return RuntimeError(f"rows still move between clusters after {rounds} rounds; raise max_rounds")


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    total = np.zeros((len(points), len(centres)))
    for x, c in zip(points.T, centres.T, strict=True):  # in the order of dimensions, as ``euclidean`` does
        total += (x[:, None] - c[None, :]) ** 2
    return np.sqrt(total)


def unit_of(largest: float, rows: int) -> float:
    """How many integer steps a coordinate of 1 has, if sums of ``rows`` coordinates stay below 2^62."""
    magnitude = max(math.frexp(largest)[1], -900) if largest else 0
    return 2.0 ** (61 - magnitude - max(rows, 1).bit_length())


def integer_sums(points: np.ndarray, unit: float) -> np.ndarray:
    return np.rint(points * unit).astype(np.int64).sum(axis=0)


def lloyd(
    points: np.ndarray, max_clusters: int = MAX_CLUSTERS, max_rounds: int = MAX_ROUNDS, unit: float | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(labels, centroids) of rows already in id order."""
    unit = unit or unit_of(float(np.abs(points).max(initial=0.0)), len(points))
    k = min(len(points), max_clusters)
    seeds = [0]
    nearest = _distances(points, points[:1])[:, 0]
    while len(seeds) < k:
        nearest[seeds] = -1.0
        seeds.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, _distances(points, points[seeds[-1:]])[:, 0])
    centres = points[seeds]
    labels = np.full(len(points), -1)
    for _ in range(max_rounds):
        moved = _distances(points, centres).argmin(axis=1)
        if (moved == labels).all():
            return labels, centres
        labels = moved
        centres = np.stack([
            integer_sums(points[labels == c], unit) / (labels == c).sum() / unit if (labels == c).any() else centres[c] for c in range(k)
        ])
    raise _unsettled(max_rounds)


def _one_key(schema_key: str, max_clusters: int, max_rounds: int, unit: float):
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        labels, centres = lloyd(np.stack(rows["embedding"].to_list()), max_clusters, max_rounds, unit)
        used = [c for c in range(len(centres)) if (labels == c).any()]
        return pd.DataFrame({
            schema_key: [rows[schema_key].iloc[0]] * len(used),
            "cluster": used,
            "size": [int((labels == c).sum()) for c in used],
            "weight": [float((labels == c).mean()) for c in used],
            "embedding": [centres[c] for c in used],
        })

    return solve


def _assigned(points: DataFrame, centres: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """Rows with their nearest centroid; a key's rows stay spread over its salts."""
    per_key = centres.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("cluster", "embedding"))).alias("centres")  # k at most
    )
    per_key = per_key.join(sizes.select(key, "salts"), key).select(
        key, "centres", F.explode(F.expr("sequence(0L, salts - 1)")).alias("_salt")
    )
    met = points.join(per_key, [key, "_salt"])
    ranked = F.transform(
        "centres",
        lambda c: F.struct(
            euclidean(F.col("embedding"), c["embedding"]).alias("distance"), c["cluster"].alias("cluster")
        ),
    )
    return met.withColumn("_near", F.array_min(ranked)).select(
        key, "id", "embedding", F.col("_near.cluster").alias("cluster"), F.col("_near.distance").alias("distance")
    )


def _centroids(hashed: DataFrame, held: dict, key: str, unit: float) -> DataFrame:
    """``key, cluster, size, members, mean`` of rows at their nearest centre in ``held``.

    Each batch of rows is assigned and added up where it is, as integers; only those sums are shuffled.
    """
    centres = {name: (sorted(found), np.stack([found[c][0] for c in sorted(found)])) for name, found in held.items()}

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, part in frame.groupby(key, sort=False):
                if name not in centres:  # rows without a key meet no centre
                    continue
                clusters, at = centres[name]
                points = np.stack(part["embedding"].to_list())
                labels = _distances(points, at).argmin(axis=1)  # ties to the lowest cluster
                hashes = part["hash"].to_numpy()
                for c in np.unique(labels):
                    mine = labels == c
                    rows.append((name, clusters[c], int(mine.sum()), np.bitwise_xor.reduce(hashes[mine]), integer_sums(points[mine], unit)))
            yield pd.DataFrame(rows, columns=[key, "cluster", "size", "members", "sums"])

    schema = f"{key} {dict(hashed.dtypes)[key]}, cluster int, size long, members long, sums array<long>"
    parts = hashed.mapInPandas(add, schema)
    # one shuffle: a cluster's rows are the batches' sums, added element-wise as integers
    whole = parts.groupBy(key, "cluster").agg(
        F.sum("size").alias("size"), F.bit_xor("members").alias("members"), F.collect_list("sums").alias("sums")
    )
    total = F.aggregate(
        "sums", F.transform(F.col("sums")[0], lambda _: F.lit(0).cast("long")), lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)
    )
    return whole.select(key, "cluster", "size", "members", F.transform(total, lambda x: x.cast("double") / F.col("size") / F.lit(unit)).alias("mean"))


def _large_keys(points: DataFrame, sizes: DataFrame, key: str, max_clusters: int, max_rounds: int, unit: float) -> DataFrame:
    """The same clustering by rounds over all tasks; ``points`` are staged and salted."""
    first = points.groupBy(key).agg(F.min_by("embedding", "id").alias("embedding"), F.min("id").alias("seed"))
    centres = staged(first.withColumn("cluster", F.lit(0)))
    for cluster in range(1, max_clusters):
        seeds = centres.select(key, F.col("seed").alias("id"))
        apart = _assigned(points, centres, sizes, key).join(seeds, [key, "id"], "left_anti")
        far = apart.groupBy(key).agg(
            F.min_by(F.struct("embedding", F.col("id").alias("seed")), F.struct(-F.col("distance"), "id")).alias("far")
        )
        centres = staged(centres.unionByName(
            far.select(key, F.col("far.embedding").alias("embedding"), F.col("far.seed").alias("seed"),
                       F.lit(cluster).alias("cluster"))
        ))
    centres = centres.select(key, "cluster", "embedding")
    # one job a round: each task assigns its rows and adds them up; only k centres a key come back
    held = {}
    for name, cluster, embedding in centres.collect():
        held.setdefault(name, {})[cluster] = (np.asarray(embedding, dtype=float), None, None)  # centre, size, members
    hashed = points.select(key, "embedding", F.xxhash64("id").alias("hash"))
    for _ in range(max_rounds):
        sums = {(name, cluster): (size, members, mean) for name, cluster, size, members, mean in _centroids(hashed, held, key, unit).collect()}
        # a cluster left without rows keeps its centre and has no members
        updated = {
            name: {
                cluster: (np.asarray(sums[name, cluster][2], dtype=float), *sums[name, cluster][:2]) if (name, cluster) in sums
                else (centre, None, None)
                for cluster, (centre, _, _) in found.items()
            }
            for name, found in held.items()
        }
        moved = any(updated[name][cluster][2] != members for name, found in held.items() for cluster, (_, _, members) in found.items())
        held = updated
        if not moved:
            break
    else:
        raise _unsettled(max_rounds)
    spark = points.sparkSession
    key_type = dict(points.dtypes)[key]
    rows = [
        (name, int(cluster), int(size), [float(x) for x in mean])
        for name, found in held.items() for cluster, (mean, size, _) in found.items() if size is not None
    ]
    found = spark.createDataFrame(rows, f"{key} {key_type}, cluster int, size long, embedding array<double>")
    return found.join(sizes, key).select(
        key, "cluster", "size", (F.col("size") / F.col("rows")).alias("weight"), "embedding"
    )


def cluster_vectors(
    df: DataFrame, key: str, id_col: str, vector: str = "embedding",
    max_clusters: int = MAX_CLUSTERS, rows_in_one_task: int = ROWS_IN_ONE_TASK, max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """``key, cluster, size, weight, embedding`` for each non-empty cluster of each key.

    Raises if rows of a key still move after ``max_rounds``.
    """
    points = df.select(key, F.col(id_col).alias("id"), as_double_array(F.col(vector)).alias("embedding"))
    sizes = points.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    # a large key is spread over parts of a task's rows each when it meets its centroids
    large = staged(
        sizes.where(F.col("rows") > rows_in_one_task)
        .withColumn("salts", F.ceil(F.col("rows") / rows_in_one_task).cast("long"))
    )
    largest, rows = points.agg(F.max(F.array_max(F.transform("embedding", F.abs))), F.count(F.lit(1))).first()
    unit = unit_of(largest or 0.0, rows)
    key_type = dict(points.dtypes)[key]
    schema = f"{key} {key_type}, cluster int, size long, weight double, embedding array<double>"
    if large.isEmpty():
        return points.groupBy(key).applyInPandas(_one_key(key, max_clusters, max_rounds, unit), schema)
    small = points.join(large, key, "left_anti").groupBy(key).applyInPandas(_one_key(key, max_clusters, max_rounds, unit), schema)
    salted = staged(
        points.join(large.select(key, "salts"), key)
        .select(key, "id", "embedding", F.pmod(F.xxhash64("id"), "salts").alias("_salt"))
    )
    return small.unionByName(_large_keys(salted, large, key, max_clusters, max_rounds, unit).select(
        key, F.col("cluster").cast("int").alias("cluster"), "size", "weight", "embedding"
    ))

"""Distance and similarity scoring that keeps only the best of each task's share.

One side is compared with batches of the other inside tasks, on NumPy matrices, and only
the k best per query (or the few closest per pair of groups) leave a task, so pairs are
never materialised or shuffled. A side travels to all tasks only when its size has been
checked; when both are larger a search for the nearest meets only the cells of items in
reach (:func:`best_within_reach`), the closest pairs of all vectors are found in blocks that tasks
read where they were written once, and other comparisons go tile by tile, each of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.operators.keyed import top_per_group
from rosterlink.session import staged

# rows of a side that may travel to every task: 16 MB at 1,024 doubles a row
BROADCAST_ROWS = 2_000
TILE_ROWS = 2_000
# points that vectors are laid out around where both sides are large
PIVOTS = 256

_SCORED = "query_id long, item_id long, score double"


def fits(df: DataFrame, limit: int) -> bool:
    return len(df.limit(limit + 1).select(F.lit(1)).collect()) <= limit


def within_rows(df: DataFrame, limit: int) -> pd.DataFrame | None:
    """The rows of ``df`` when there are at most ``limit``, else None."""
    rows = df.limit(limit + 1).toPandas()
    return rows if len(rows) <= limit else None


def tiled_pairs(
    left: DataFrame, right: DataFrame, left_id: list[str], right_id: list[str],
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``fn`` on every tile of left rows with every tile of right rows.

    Tiles are cut by a hash of the row's unique id, so no key can fill one.
    """
    right = right.toDF(*right.columns)  # the sides may be one frame
    left_tiles = max(1, -(-left.count() // tile_rows))
    right_tiles = max(1, -(-right.count() // tile_rows))

    def every(tiles: int):
        return F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))

    lefts = left.withColumn("_lt", F.pmod(F.xxhash64(*left_id), F.lit(left_tiles)).cast("int")).withColumn("_rt", every(right_tiles))
    rights = right.withColumn("_rt", F.pmod(F.xxhash64(*right_id), F.lit(right_tiles)).cast("int")).withColumn("_lt", every(left_tiles))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return fn(a, b) if len(a) and len(b) else pd.DataFrame()

    return lefts.groupBy("_lt", "_rt").cogroup(rights.groupBy("_lt", "_rt")).applyInPandas(run, schema)


def compared(
    queries: DataFrame, items: DataFrame, query_id: list[str], item_id: list[str],
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    broadcast_rows: int = BROADCAST_ROWS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``fn(queries, items)`` over all of both sides, whichever fits travelling."""
    fixed = within_rows(queries, broadcast_rows)
    if fixed is not None:
        sent = queries.sparkSession.sparkContext.broadcast(fixed)

        def on_items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(sent.value):
                    yield fn(sent.value, batch)

        return items.mapInPandas(on_items, schema)
    fixed = within_rows(items, broadcast_rows)
    if fixed is not None:
        sent = queries.sparkSession.sparkContext.broadcast(fixed)

        def on_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and len(sent.value):
                    yield fn(batch, sent.value)

        return queries.mapInPandas(on_queries, schema)
    return tiled_pairs(queries, items, query_id, item_id, fn, schema, tile_rows)


def best_within_reach(
    queries: DataFrame, items: DataFrame, k: int, score: Callable[[np.ndarray, pd.DataFrame], np.ndarray],
    distances: Callable[[np.ndarray, pd.DataFrame], np.ndarray], bound: Callable[[np.ndarray, np.ndarray], np.ndarray],
    pivots: int = PIVOTS, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``query_id, item_id, score``: each query's ``k`` lowest scores per part of a cell, in two rounds.

    ``queries``: query_id, embedding. ``items``: item_id and what ``score`` needs. A bounded
    sample of queries gives pivots, and each item lies in the cell of the pivot nearest to it.
    ``distances`` (pivots, items) gives an array pivots x items x kinds, of an item's farthest
    vector of each kind from a pivot; a cell's reach is the largest of its items by kind, and
    ``bound`` (distances of queries to pivots, reaches) is a score that no item of the cell
    can stay below. In the first round a query meets the cells of the lowest bounds that hold ``k``
    items; its k-th score there comes back to it, and in the second round it meets the other cells
    whose bound does not pass that. So results are those of all pairs, and only queries and items of cells
    in reach are brought together.
    """
    spark = queries.sparkSession
    sample = queries.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(pivots).toPandas()
    if not len(sample):
        return spark.createDataFrame([], _SCORED)
    centres = np.unique(matrix(sample["embedding"]), axis=0)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                # what lacks a kind has an infinite score, which no bound can pass
                far = distances(centres, frame)
                far = np.where(np.isfinite(far), far, 0.0)
                cell = far.sum(axis=2).argmin(axis=0)
                yield frame.assign(_cell=cell.astype(np.int32), _far=list(far[cell, np.arange(len(frame))]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    placed = staged(items.mapInPandas(place, f"{fields}, _cell int, _far array<double>"))
    kinds = F.posexplode("_far").alias("kind", "far")
    reach_rows = placed.select("_cell", kinds).groupBy("_cell", "kind").agg(F.max("far").alias("far")).collect()  # pivots x kinds
    counted = {r["_cell"]: r["count"] for r in placed.groupBy("_cell").count().collect()}
    sizes = {cell: -(-n // tile_rows) for cell, n in counted.items()}
    cells = np.array(sorted(sizes), np.int64)
    rows_of = np.array([counted[c] for c in cells.tolist()], np.int64)
    if not len(cells):
        return spark.createDataFrame([], _SCORED)
    reaches = np.zeros((len(cells), max(r["kind"] for r in reach_rows) + 1))
    for r in reach_rows:
        reaches[np.searchsorted(cells, r["_cell"]), r["kind"]] = r["far"]
    slack = 1 + 1e-9

    def lowest(asked: np.ndarray) -> np.ndarray:
        return bound(distance_matrix(asked, centres[cells]), reaches * slack) / slack

    def nearby(bounds: np.ndarray) -> np.ndarray:
        """Which cells a query meets first: by rising bound, until they hold k items."""
        order = np.argsort(bounds, axis=1, kind="stable")
        held = rows_of[order].cumsum(axis=1) - rows_of[order]
        out = np.zeros(bounds.shape, bool)
        np.put_along_axis(out, order, held < k, axis=1)
        return out

    def sent(second: bool):
        def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    bounds = lowest(matrix(frame["embedding"]))
                    met = nearby(bounds)
                    if second:
                        met = ~met & (bounds <= frame["_kth"].fillna(np.inf).to_numpy()[:, None])
                    rows, at = np.nonzero(met)
                    yield frame.iloc[rows][["query_id", "embedding"]].assign(_cell=cells[at].astype(np.int32))

        return send

    def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(rows):
            return pd.DataFrame()
        return keep_best(score(matrix(asked["embedding"]), rows), k, asked["query_id"].to_numpy(), rows["item_id"].to_numpy())

    parts = F.create_map(*[F.lit(int(x)) for c in sizes.items() for x in c])
    in_parts = placed.select("*", F.pmod(F.xxhash64("item_id"), parts[F.col("_cell")]).cast("int").alias("_part"))

    def round_of(asked: DataFrame) -> DataFrame:
        spread = asked.withColumn("_part", F.explode(F.sequence(F.lit(0), (parts[F.col("_cell")] - 1).cast("int"))))
        # a cell that many queries ask is cut by queries too; its items go along to each cut
        cut = staged(spread)
        many = cut.groupBy("_cell", "_part").agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("_cuts"))
        many = staged(many)
        cut = cut.join(many, ["_cell", "_part"]).withColumn("_cut", F.pmod(F.xxhash64("query_id"), F.col("_cuts")).cast("int")).drop("_cuts")
        wanted = in_parts.join(many, ["_cell", "_part"]).withColumn("_cut", F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))).drop("_cuts")
        keys = ["_cell", "_part", "_cut"]
        return cut.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(meet, _SCORED)

    asked = "query_id long, embedding array<double>, "
    near = staged(round_of(queries.mapInPandas(sent(False), asked + "_cell int")))
    kth = best_per_query(near, k).where(F.col("place") == k).select("query_id", F.col("score").alias("_kth"))
    rest = queries.join(kth, "query_id", "left").mapInPandas(sent(True), asked + "_cell int")
    return near.unionByName(round_of(rest))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def distance_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``a`` against rows of ``b``, by exact differences, a few rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for at in range(0, len(a), step):
        diff = a[at:at + step, None, :] - b[None, :, :]
        out[at:at + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def keep_best(scores: np.ndarray, k: int, query_ids: np.ndarray, item_ids: np.ndarray) -> pd.DataFrame:
    """k lowest scores per query (rows), ties to the lowest item id."""
    by_id = np.argsort(item_ids, kind="stable")
    scores, item_ids = scores[:, by_id], np.asarray(item_ids)[by_id]
    best = np.argsort(scores, axis=1, kind="stable")[:, :k]
    return pd.DataFrame({
        "query_id": np.repeat(query_ids, best.shape[1]),
        "item_id": item_ids[best].ravel(),
        "score": np.take_along_axis(scores, best, axis=1).ravel(),
    })


def best_per_query(partial: DataFrame, k: int, largest: bool = False) -> DataFrame:
    """Final k per query from the tasks' own best, with the place as ``place``."""
    score = F.desc("score") if largest else F.asc("score")
    return top_per_group(partial, ["query_id"], [score, F.asc("item_id")], k, rank="place")


def packed(vectors: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``scipers, vectors``: ``sciper, id_pub, embedding`` as blocks of at most ``tile_rows`` rows, by person."""
    rows = vectors.count()
    # some files of up to 16 blocks, so that every pair of files is one task's work
    files = max(1, -(-rows // (16 * tile_rows)), min(16, -(-rows // tile_rows)))
    laid_out = vectors.repartitionByRange(files, "sciper", "id_pub").sortWithinPartitions("sciper", "id_pub")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), tile_rows):
                some = frame.iloc[at:at + tile_rows]
                yield pd.DataFrame({"scipers": [some["sciper"].to_numpy()], "vectors": [matrix(some["embedding"]).tobytes()]})

    return staged(laid_out.select("sciper", "embedding").mapInPandas(pack, "scipers array<long>, vectors binary"))


def _by_person(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The people of sorted keys and their n + 1 bounds."""
    names, at = np.unique(keys, return_index=True)
    return names, np.append(at, len(keys))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances row by row, bit for bit those of ``distance_matrix``."""
    out = np.empty(len(a))
    step = max(1, 1_000_000 // max(1, a.shape[1]))
    for at in range(0, len(a), step):
        diff = a[at:at + step] - b[at:at + step]
        out[at:at + step] = np.sqrt(np.einsum("ik,ik->i", diff, diff))
    return out


def few_smallest(t_keys: np.ndarray, ts: np.ndarray, o_keys: np.ndarray, os: np.ndarray, few: int) -> pd.DataFrame:
    """``target, sciper, distance``: the ``few`` smallest distances of each pair of people; keys are sorted.

    A matrix product tells squared distances within ``slack``, and only pairs that may be among
    the smallest are measured by exact differences. People of few vectors, and numbers that
    are not finite, are measured outright.
    """
    t_names, t_at = _by_person(t_keys)
    o_names, o_at = _by_person(o_keys)
    t_norm, o_norm = np.einsum("ij,ij->i", ts, ts), np.einsum("ij,ij->i", os, os)
    slack = 16 * (ts.shape[1] + 4) * np.finfo(float).eps * (t_norm.max() + o_norm.max())
    out: list[tuple] = []
    if not np.isfinite(slack) or len(os) < 64 * len(o_names):
        for target, a, z in zip(t_names, t_at[:-1], t_at[1:], strict=True):
            values = distance_matrix(ts[a:z], os).T.ravel()
            sizes = np.diff(o_at) * (z - a)
            owner = np.repeat(np.arange(len(o_names)), sizes)
            order = np.lexsort((values, owner))  # grouped as before, so owner stays as it is
            kept = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < few
            out.append((np.full(kept.sum(), target), o_names[owner[kept]], values[order][kept]))
    else:
        left = np.column_stack([ts, np.ones(len(ts)), t_norm])
        right = np.ascontiguousarray(np.column_stack([-2 * os, o_norm, np.ones(len(os))]).T)
        step = max(1, 500_000 // len(os))
        for target, a, z in zip(t_names, t_at[:-1], t_at[1:], strict=True):
            best = [np.empty(0)] * len(o_names)
            limit = np.full(len(o_names), np.inf)  # of squared distances that can still matter
            for at in range(a, z, step):
                rows = ts[at:min(at + step, z)]
                squares = left[at:at + len(rows)] @ right
                for k, (c, d) in enumerate(zip(o_at[:-1], o_at[1:], strict=True)):
                    block, most = squares[:, c:d], limit[k]
                    if np.isinf(most) and most > 0 and block.size > few:
                        most = np.partition(block, few - 1, axis=None)[few - 1] + 2 * slack
                    elif block.min() > most:
                        continue
                    i, j = np.nonzero(block <= most)
                    best[k] = np.sort(np.concatenate([best[k], _exact(rows[i], os[c + j])]))[:few]
                    if len(best[k]) == few:
                        limit[k] = best[k][-1] ** 2 + 2 * slack if best[k][-1] else -np.inf
            sizes = [len(x) for x in best]
            out.append((np.full(sum(sizes), target), np.repeat(o_names, sizes), np.concatenate(best)))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pd.DataFrame(dict(zip(("target", "sciper", "distance"), columns, strict=True)))


def closest_pairs(
    targets: DataFrame, others: DataFrame, few: int, broadcast_rows: int = BROADCAST_ROWS, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Mean of the ``few`` smallest distances between two people's vectors.

    ``targets`` and ``others`` hold ``sciper, id_pub, embedding``. Gives ``target,
    sciper, distance``. Where neither side may travel, both are written once as blocks and each
    task reads its share of the pairs of blocks: vectors are not copied for every tile.
    """
    targets, others = (x.select("sciper", "id_pub", "embedding").where("sciper IS NOT NULL") for x in (targets, others))
    found = "target long, sciper long, distance double"
    if fits(targets, broadcast_rows) or fits(others, broadcast_rows):

        def frames(ts: pd.DataFrame, os: pd.DataFrame) -> pd.DataFrame:
            ts, os = ts.sort_values("sciper", kind="stable"), os.sort_values("sciper", kind="stable")
            return few_smallest(ts["sciper"].to_numpy(), matrix(ts["embedding"]), os["sciper"].to_numpy(), matrix(os["embedding"]), few)

        partial = compared(targets, others, ["sciper", "id_pub"], ["sciper", "id_pub"], frames, found, broadcast_rows, tile_rows)
    else:
        # blocks are rows here: the product of the sides reads them, and shuffles nothing
        pairs = packed(targets, tile_rows).crossJoin(packed(others, tile_rows).toDF("others", "other_vectors").hint("shuffle_replicate_nl"))

        def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for t_keys, ts, o_keys, os in frame.itertuples(index=False):
                    sides = (np.frombuffer(v, float).reshape(len(k), -1) for k, v in ((t_keys, ts), (o_keys, os)))
                    yield few_smallest(t_keys, next(sides), o_keys, next(sides), few)

        partial = pairs.mapInPandas(blocks, found)
    kept = top_per_group(partial, ["target", "sciper"], [F.asc("distance")], few)
    return kept.groupBy("target", "sciper").agg(F.avg("distance").alias("distance"))

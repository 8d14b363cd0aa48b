"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives its minimum and its
maximum, so a signature of twice that many entries costs half the hash evaluations. Bands of a
few entries (of different permutations, minima and maxima alike) are the keys by which
sets meet, in so many bands that a pair at the threshold misses all of them with probability
``MISS`` at most (44 bands of 8 at 0.85, 46 of 6 at 0.8); each link found is confirmed on the full sets.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A document's set is that of its
5-word shingles; with fewer words its whole sequence; without words or text (null) it is
empty and linked with nothing: its class is itself. Equal sets collapse before anything is
compared. Rows with the same doc_id are one document in ``near_duplicates``, and a row with a
null doc_id takes its class from the others; alone it has a null class. ``without_near_duplicates``
keeps one row of each class, whatever its doc_id, and every row without words, with all columns.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.linking import similar_classes
from rosterlink.llm.text import find_words, mix, shingle_hashes, slices, word_hashes
from rosterlink.operators.numbering import with_position
from rosterlink.session import staged

SIMILARITY = (85, 100)  # intersection over union, at least
MISS = 1e-6

_U = np.uint64


def bands_for(similarity: tuple[int, int], miss: float = MISS) -> tuple[int, int]:
    """Bands and rows that let a pair at the threshold pass unseen with probability ``miss`` at most.

    Rows are such that about a quarter of the pairs at the threshold agree in a band; the number of bands is even.
    """
    threshold = similarity[0] / similarity[1]
    rows = max(1, round(-1.3 / math.log(threshold))) if threshold < 1 else 16
    least = math.log(miss) / math.log1p(-(threshold**rows)) if threshold < 1 else 1
    return 2 * math.ceil(least / 2), rows


def min_max_bands(shingles: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys, one line per set; ``starts`` are the first shingles of the sets, none empty."""
    entries = np.empty((bands * rows, len(starts)), _U)
    half = bands * rows // 2
    factors = mix(np.arange(1, half + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
    turned = np.empty_like(shingles)
    for i in range(half):
        np.multiply(shingles, factors[i], out=turned)
        # a band has entries band, band + bands, ...: never both ends of one permutation but where it has one band
        np.minimum.reduceat(turned, starts, out=entries[i])
        np.maximum.reduceat(turned, starts, out=entries[half + (i + 1) % half])
    keys = np.empty((bands, len(starts)), _U)
    place = mix(np.arange(101, 101 + rows, dtype=_U)) | _U(1)
    for band in range(bands):
        keys[band] = mix((entries[band::bands] * place[:, None]).sum(axis=0, dtype=_U) + _U(band))
    return keys.T


def set_ids(shingles: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128-bit names of sets of distinct shingles, whatever their order."""
    sums = [np.add.reduceat(mix(shingles * _U(f)), starts) for f in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)]
    return [x.tobytes() for x in np.stack([mix(s) for s in sums], axis=1)]


def document_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and their n + 1 bounds."""
    words = find_words(column)
    shingles, bounds = shingle_hashes(word_hashes(words, lower=True), words.first)
    parts = [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = [len(p) for p in parts]
    return (np.concatenate(parts) if parts else shingles), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def signatures(docs: DataFrame, number: int, width: int) -> DataFrame:
    """``doc_id, n_shingles, id, bands`` per row; id and bands are null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                shingles, bounds = document_sets(piece.column("text"))
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                ids: list = [None] * len(size)
                bands: list = [None] * len(size)
                if len(full):
                    starts = bounds[:-1][full]
                    for i, name, keys in zip(full, set_ids(shingles, starts), min_max_bands(shingles, starts, number, width).view(np.int64), strict=True):
                        ids[i], bands[i] = name, keys
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "id", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, id binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """``id, members`` of the non-empty sets of all rows."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                shingles, bounds = document_sets(piece.column("text"))
                full = np.flatnonzero(np.diff(bounds))
                starts = bounds[:-1][full]
                names = set_ids(shingles, starts) if len(full) else []
                members = pa.ListArray.from_arrays(pa.array(np.append(starts, len(shingles)), pa.int32()), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), members], ["id", "members"])

    return docs.select("text").mapInArrow(collect, "id binary, members array<long>")


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row."""
    signed = staged(signatures(docs, *bands_for(similarity)))
    items = staged(
        signed.where(F.col("id").isNotNull()).groupBy("id", F.col("n_shingles").alias("size"), "bands")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )

    def sets_of(wanted: DataFrame) -> DataFrame:
        # one document of each set is read again; a null doc_id can't be looked up and is by its equal set only
        named = items.select("id", "rep").join(wanted, "id", "left_semi")
        texts = docs.select("doc_id", "text").join(named.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
        return shingle_sets(texts).join(named.select("id"), "id", "left_semi").dropDuplicates(["id"])

    roots = similar_classes(items.where(F.col("rep").isNotNull()).select("id", "size", "copies", "bands"), sets_of, *similarity)
    rooted = items.select("id", "rep").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    classes = rooted.join(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("id", "component_id")
    found = signed.drop("bands").join(staged(classes), "id", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The documents that stay, with all their columns: one row of each class, and rows without words."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        kept = near_duplicates(docs, similarity).where("kept").select(F.col("doc_id").alias("_kept"))
        return docs.join(kept, docs["doc_id"].cast("long") == kept["_kept"], "left_semi")
    # rows that ids don't tell apart get numbers in the order of ids, null last
    rows = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))
    order = rows.select("row", F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").cast("long").alias("id"))
    numbers = staged(with_position(order, ["none", "id", "row"], name="number").select("row", "number"))
    named = rows.join(numbers, "row").select(F.col("number").alias("doc_id"), F.col("doc.text").alias("text"))
    kept = near_duplicates(named, similarity).where("kept").join(numbers, F.col("doc_id") == F.col("number")).select("row")
    return rows.join(kept, "row", "left_semi").select("doc.*")

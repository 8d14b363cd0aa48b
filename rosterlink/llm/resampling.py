"""Importance resampling towards a target: hashed n-gram features, counted by distinct lines.

Newlines cut texts into lines. Each distinct line is looked at once: its features' buckets are
computed one time and weigh as often as the line occurs, in the counts of the corpus as in the
weights of documents. N-grams that run across the end of a line are no line's own; they are
found per document and added separately. A bucket's gain compares its share in the target with
that in the corpus; a document's weight is the sum of its features' gains, and Gumbel noise on
the weights makes the highest scores a sample without replacement.

The gains are one number per bucket (a parameter) and travel to the tasks; lines and documents
meet by 128-bit keys of lines in shuffled joins, so a line that a third of all documents holds
is one row on one side and is split on the other.

Null texts and texts without words have no features and weight 0. Rows that repeat are documents
of their own. A null doc_id draws its noise from the empty text and loses ties. An empty table
gives no rows; an empty target is one without counts. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.sums import matrix_sum
from rosterlink.operators.numbering import with_position
from rosterlink.session import staged

BUCKETS = 10_000
LONGEST = 1  # words of the longest n-gram
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000  # gains and noise are whole thousandths

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_REMEMBERED = 500_000  # features a task remembers; it starts anew beyond


class _Buckets(dict):
    """Bucket of each feature, remembered."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def line_grams(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words of a line."""
    grams = list(words)
    for n in range(2, longest + 1):
        grams += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return grams


def crossing_grams(lines: list[list[bytes]], longest: int) -> list[bytes]:
    """The runs of 2 to ``longest`` words of a text that do not lie within one line."""
    if longest < 2:
        return []
    words = [w for line in lines for w in line]
    line_of = [k for k, line in enumerate(lines) for _ in line]
    return [
        b" ".join(words[i : i + n])
        for n in range(2, longest + 1)
        for i in range(len(words) - n + 1)
        if line_of[i] != line_of[i + n - 1]
    ]


def line_key(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _packed(buckets: list[int]) -> bytes:
    return np.array(buckets, "<u4").tobytes()


def distinct_lines(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``key, n, n_words, features`` of each distinct line with a word; n: its occurrences in all texts."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(buckets)
        for batch in batches:
            keys, sizes, features = [], [], []
            for line in batch.column("line").cast(pa.large_binary()).to_pylist():
                words = words_of(line)
                keys.append(line_key(line))
                sizes.append(len(words))
                features.append(_packed([bucket[g] for g in line_grams(words, longest)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column("n"), pa.array(sizes, pa.int64()), pa.array(features, pa.binary())],
                ["key", "n", "n_words", "features"],
            )

    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where(F.col("line") != "")
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return counted.mapInArrow(describe, "key binary, n long, n_words long, features binary").where("n_words > 0")


def held_lines(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``texts``: its ``keep`` columns, ``keys`` and ``counts`` of its lines, and ``crossing`` features."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(buckets)
        for batch in batches:
            keys, counts, crossing = [], [], []
            for text in batch.column("_text").cast(pa.large_binary()).to_pylist():
                lines = (text or b"").split(b"\n")
                held = Counter(lines)
                held.pop(b"", None)
                keys.append([line_key(line) for line in held])
                counts.append(list(held.values()))
                across = crossing_grams([words_of(line) for line in lines], longest) if longest > 1 else []
                crossing.append(_packed([bucket[g] for g in across]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(keys, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int64())), pa.array(crossing, pa.binary())],
                [*keep, "keys", "counts", "crossing"],
            )

    given = texts.select(*keep, F.col("text").alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields if f.name != "_text"]
    return given.mapInArrow(describe, ", ".join([*fields, "keys array<binary>, counts array<long>, crossing binary"]))


def bucket_counts(lines: DataFrame, held: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: those of distinct lines times occurrences, and those across lines."""

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((1, buckets), np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            for features, times in zip(batch.column("features").to_pylist(), n, strict=True):
                np.add.at(total[0], np.frombuffer(features, "<u4"), times)
        return total

    across = held.where(F.length("crossing") > 0).select(F.lit(1).cast("long").alias("n"), F.col("crossing").alias("features"))
    total = matrix_sum(lines.select("n", "features").unionByName(across), add)
    return np.zeros(buckets, np.int64) if total is None else total[0]


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of B buckets."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array(
        [math.floor(SCALE * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def noise(seed: int, doc_id: str = "doc_id") -> Column:
    """Gumbel noise in whole thousandths, from the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-F.lit(float(SCALE)) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each document."""
    lines = staged(distinct_lines(docs, buckets, longest))
    held = staged(held_lines(docs, buckets, longest, ("doc_id",)).withColumn("row", F.monotonically_increasing_id()))
    wanted = bucket_counts(distinct_lines(target, buckets, longest), held_lines(target, buckets, longest), buckets)
    gain = gains(bucket_counts(lines, held, buckets), wanted)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(f, "<u4") for f in batch.column("features").to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            total = np.concatenate([[0], np.cumsum(gain[np.concatenate(found)])]) if found else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_words"), pa.array(np.diff(ends)), pa.array(np.diff(total[ends]))],
                ["key", "n_words", "n_features", "weight"],
            )

    schema = "key binary, n_words long, n_features long, weight long"
    line_weights = lines.select("key", "n_words", "features").mapInArrow(weigh, schema)
    occurring = held.select("row", F.explode(F.arrays_zip("keys", "counts")).alias("line")).select("row", F.col("line.keys").alias("key"), F.col("line.counts").alias("times"))
    parts = occurring.join(line_weights, "key").select("row", *[(F.col("times") * F.col(c)).alias(c) for c in ("n_words", "n_features", "weight")])
    if longest > 1:
        across = held.where(F.length("crossing") > 0).select(
            F.col("crossing").alias("features"), F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("key"), "row"
        )

        def weigh_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [np.frombuffer(f, "<u4") for f in batch.column("features").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("n_words"), pa.array([len(f) for f in found], pa.int64()), pa.array([int(gain[f].sum()) for f in found], pa.int64())],
                    ["row", "n_words", "n_features", "weight"],
                )

        parts = parts.unionByName(across.mapInArrow(weigh_rows, "row long, n_words long, n_features long, weight long"))
    names = ("n_words", "n_features", "weight")
    summed = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    return held.select("row", "doc_id").join(summed, "row", "left").select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def resampled(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of each document; rank is null where it is not drawn."""
    weighed = staged(weights(docs, target, buckets, longest).withColumn("score", F.col("weight") + noise(seed)))
    able = weighed.where(F.col("n_words") >= least_words).select(
        (-F.col("score")).alias("_low"), F.col("doc_id").isNull().alias("_last"), "doc_id", "n_features", "weight", "score"
    )
    # equal rows are alike in every column that comes out
    placed = with_position(able, ["_low", "_last", "doc_id", "n_features"], name="_place")
    most = able.count() * percent // 100
    drawn = placed.withColumn("rank", F.when(F.col("_place") <= most, F.col("_place")))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    unable = weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*names).unionByName(unable.select(*names))

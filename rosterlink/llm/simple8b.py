"""Token ids as Simple-8b words, in a file format of self-contained chunks.

A 64-bit word has a selector in its top four bits and 60 bits of payload; selector s packs
``COUNTS[s]`` numbers of ``WIDTHS[s]`` bits, the first in the lowest bits. Numbers of more
than 60 bits are kept beside the words; selector 15 gives their place. Words never cross a
block of ``BLOCK`` ids, and a chunk lists the word at which each block begins, so blocks
are decoded alone and at once with array operations.

A chunk is one Parquet row of a few hundred thousand ids at most (or one longer document):
the documents, their lengths, the block offsets, the escaped numbers and the words. Chunks
are written in ascending doc_id order (null first); the committed Parquet folder is the
file set, which every executor can read and a lost task writes again.

Null texts are empty. Rows that repeat a doc_id follow each other. An empty table gives an
empty folder that reads as no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlink.llm.tokens import default_path, word_tokenizer
from rosterlink.session import scratch_dir, shuffle_partitions, staged

WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = tuple(60 // w for w in WIDTHS)
ESCAPE = 15
BLOCK = 4096
CHUNK_IDS = 200_000

_U = np.uint64
_CHUNK = "part int, chunk int, before long, doc_ids array<long>, lengths array<long>, blocks array<int>, escapes binary, words binary"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (and the number of words), escaped numbers."""
    values = np.ascontiguousarray(values, _U)
    n = len(values)
    limits = np.array([(1 << w) - 1 for w in WIDTHS], _U)
    level = np.searchsorted(limits, values).astype(np.int8)  # the narrowest width that fits; 14: escaped
    room = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n)).astype(np.int16)
    # The narrowest width that holds as many successive numbers as fit into its word wins.
    widest = {1: level}

    def over(count: int) -> np.ndarray:
        """The widest of each ``count`` successive numbers, from those of shorter runs."""
        if count not in widest:
            part = max(c for c in (1, 2, 4, *COUNTS) if c < count <= 2 * c)
            short = over(part)
            widest[count] = np.maximum(short[: len(short) - (count - part)], short[count - part :])
        return widest[count]

    choice = np.full(n, ESCAPE, np.int8)
    for s in range(len(WIDTHS) - 1, -1, -1):
        if COUNTS[s] <= n:
            runs = over(COUNTS[s])
            np.copyto(choice[: len(runs)], np.int8(s), where=(runs <= s) & (room[: len(runs)] >= COUNTS[s]))
    step = np.array([*COUNTS, 1, 1], np.uint8)[choice].tobytes()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    starts = np.array(at, np.int64)
    chosen = choice[starts]
    words = chosen.astype(_U) << _U(60)
    for s, (width, count) in enumerate(zip(WIDTHS, COUNTS, strict=True)):
        here = np.flatnonzero(chosen == s)
        for k in range(count if len(here) else 0):
            words[here] |= values[starts[here] + k] << _U(width * k)
    escaped = chosen == ESCAPE
    words[escaped] |= np.arange(escaped.sum(), dtype=_U)
    blocks = np.searchsorted(starts, np.arange(0, n + BLOCK, BLOCK)[: -(-n // BLOCK) + 1])
    return words, blocks.astype(np.int32), values[starts[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """All numbers of the words, which may be those of some blocks only."""
    chosen = (words >> _U(60)).astype(np.int64)
    count = np.array([*COUNTS, 0, 1])[chosen]
    ends = np.cumsum(count)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, _U)
    for s, (width, number) in enumerate(zip(WIDTHS, COUNTS, strict=True)):
        here = np.flatnonzero(chosen == s)
        if len(here):
            shifts = (np.arange(number) * width).astype(_U)
            out[(ends[here] - number)[:, None] + np.arange(number)] = (words[here][:, None] >> shifts) & _U((1 << width) - 1)
    here = np.flatnonzero(chosen == ESCAPE)
    out[ends[here] - 1] = escapes[(words[here] & _U((1 << 60) - 1)).astype(np.int64)]
    return out


def write(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> str:
    """Write the ids of all texts in ascending doc_id order; gives the folder."""
    path_of_rules = tokenizer or default_path()

    def to_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_tokenizer(path_of_rules), TaskContext.get().partitionId()
        ids, names, lengths, number, before, held = [], [], [], 0, 0, 0

        def chunk() -> pa.RecordBatch:
            nonlocal number, before, held
            words, blocks, escapes = encode(np.frombuffer(b"".join(ids), "<u4"))
            row = [part, number, before, list(names), list(lengths), blocks.tolist(), escapes.astype("<u8").tobytes(), words.astype("<u8").tobytes()]
            number, before, held = number + 1, before + held, 0
            for x in (ids, names, lengths):
                x.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [c.split()[0] for c in _CHUNK.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = encoder.ids(text)
                ids.append(own)
                names.append(doc_id)
                lengths.append(len(own) // 4)
                held += lengths[-1]
                if held > CHUNK_IDS:
                    yield chunk()
        if names:
            yield chunk()

    spark = docs.sparkSession
    path = path or f"{scratch_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    # by range of ids: the tasks' numbers ascend with them
    laid_out = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    laid_out.mapInArrow(to_chunks, _CHUNK).write.option("compression", "zstd").parquet(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files alone."""
    chunks = spark.read.schema(_CHUNK).parquet(path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8")).astype("<u4")
                ends = np.cumsum(row["lengths"])
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                starts = row["before"] + ends - row["lengths"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(crcs), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # one row per task that wrote
    sizes = chunks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset")))
    found = chunks.mapInArrow(digest, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(offsets, "part").select("doc_id", (F.col("start") + F.col("_offset")).alias("start"), "n_tokens", "ids_crc32")

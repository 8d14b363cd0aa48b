"""Packing by first-fit decreasing with a tournament tree, inside random groups of documents.

A document's ids are cut into full sequences and a rest. Only lengths, positions and
checksums travel: the cut does not depend on the packing, so ids stay where they are read.
Each group of about ``GROUP`` documents is packed on its own in one task; the groups are
drawn by the hash of a row number, so copies and large sources spread over all of them.

Null texts are empty and have the end id alone. Repeated rows are documents of their own.
An empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.tokens import default_path, word_tokenizer
from rosterlink.session import staged

LENGTH = 2048
GROUP = 4000  # documents packed together

_PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class BinTree:
    """Bins in order of opening; finds the first with enough room in O(log n)."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.leaves)  # the largest room below each node

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size`` and the room that it had."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        room = most[node]
        most[node] = room - size
        found = node - self.leaves
        while node > 1:
            node //= 2
            most[node] = max(most[2 * node], most[2 * node + 1])
        return found, room


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """Bin and offset of each item; items of equal size in their given order."""
    tree, out = BinTree(len(sizes), room), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        where, left = tree.place(sizes[i])
        out[i] = (where, room - left)
    return out


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """``row, doc_id, start, length, ids_crc32, doc_tokens`` for each piece of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer)
        step = 4 * length
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                ids = encoder.ids(text)
                for a in range(0, len(ids), step):
                    part = ids[a : a + step]
                    for column, value in zip(out, (row, doc_id, a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, group: int = GROUP, seed: int = 5) -> DataFrame:
    """Each piece with ``sequence_id`` and its ``offset`` there; offsets are gapless from 0."""
    cut = staged(pieces(docs, tokenizer or default_path(), length))
    documents = cut.where("start = 0").count()
    groups = max(1, -(-documents // group))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "start"], ignore_index=True)
        full = rows["length"].to_numpy() == length
        rest = np.flatnonzero(~full)
        fitted = first_fit_decreasing(rows["length"].to_numpy()[rest].tolist(), length)
        where, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        if len(rest):
            where[rest], offset[rest] = np.array(fitted, np.int64).T
        where[full] = np.arange(full.sum()) + (where[rest].max() + 1 if len(rest) else 0)
        rows["sequence_id"], rows["offset"] = (np.int64(key[0]) << 32) + where, offset
        return rows.drop(columns=["row", "_group"])

    schema = _PIECES.removeprefix("row long, ") + ", sequence_id long, offset long"
    grouped = cut.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))
    return grouped.groupBy("_group").applyInPandas(place, schema)

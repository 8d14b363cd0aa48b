"""Words, 64-bit word hashes and shingles of text columns, straight from Arrow buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. Null texts are empty. Everything here works on one
Arrow batch inside a task, cut into slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlink.session import configure

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SHINGLE = 5  # words
SLICE_BYTES = 2_000_000  # text hashed at once; one longer text makes a longer slice
BATCH_ROWS = 1000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C1B  # odd, so that its powers have inverses modulo 2^64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings for tasks that hold whole texts: small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, by which folds are cut; of the empty text for null."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


class Words(NamedTuple):
    """The words of a slice of texts: of text i, those from ``first[i]`` to ``first[i + 1]``."""

    data: np.ndarray  # UTF-8 bytes of all texts
    bounds: np.ndarray  # of the texts in the bytes
    start: np.ndarray  # of each word in the bytes
    end: np.ndarray
    first: np.ndarray  # of each text's words, and their number at last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 bounds of a column of n texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most about ``most`` bytes of text, one text at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(size) // most
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [batch.num_rows]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


def find_words(column: pa.Array) -> Words:
    data, bounds = utf8(column)
    n = len(data)
    word = ~_IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | edge[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=4)
def byte_codes(lower: bool) -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z if ``lower``."""
    codes = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, _U), np.full(n, pow(_BASE, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def word_hashes(words: Words, lower: bool) -> np.ndarray:
    """64-bit hashes; equal words, and no others but by a chance of 2^-60, have equal ones."""
    n = len(words.data)
    if not len(words.start):
        return np.zeros(0, _U)
    up, down = _powers(max(SLICE_BYTES + 1, 1 << int(n).bit_length()))
    total = np.zeros(n + 1, _U)
    np.cumsum(byte_codes(lower)[words.data] * up[:n], out=total[1:])
    return mix((total[words.end] - total[words.start]) * down[words.start])


_PLACE = mix(np.arange(11, 11 + SHINGLE, dtype=_U)) | _U(1)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles in order, repeats included, and their n + 1 bounds by text.

    A text of one to four words has its whole sequence as the one shingle.
    """
    n = len(hashes)
    count = np.diff(first)
    if not n:
        return np.zeros(0, _U), np.zeros(len(first), np.int64)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, _U)])
    size = np.minimum(count, SHINGLE)
    number = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(number)])
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], number)
    length = np.repeat(size, number)
    total = length.astype(_U)
    for k in range(SHINGLE):
        part = padded[at + k] * _PLACE[k]
        total += np.where(length > k, part, _U(0)) if (size < SHINGLE).any() else part
    return mix(total), bounds


def char_positions(words: Words, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Code points before the byte positions ``at``, counted from the start of text number ``text``."""
    total = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    return total[at] - total[words.bounds[text]]

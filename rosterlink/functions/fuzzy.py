"""Partial ratio of two strings, 0..100, on NumPy batches.

The shorter string is compared with every stretch of the longer one that is as long,
and with the shorter stretches at both ends; the best share of common subsequence,
200 * LCS / (lengths), counts. Strings of one length are compared both ways. The common
subsequence is found bit-parallel (Hyyro, 2004), all strings of a batch at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = 64
_CELLS = 1_000_000


def _codes(strings: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(strings), width), dtype=np.int64)
    for row, value in enumerate(strings):
        out[row, : len(value)] = [ord(c) + 1 for c in value]  # 0 is padding
    return out


def _masks(pattern: str, codes: np.ndarray) -> np.ndarray:
    """Bits of the pattern positions each character matches; none for padding."""
    wide = len(pattern) > _WORD
    seen, place = np.unique(codes, return_inverse=True)
    bits = [sum(1 << i for i, c in enumerate(pattern) if ord(c) + 1 == code) for code in seen.tolist()]
    return np.array(bits, dtype=object if wide else np.uint64)[place].reshape(codes.shape)


def _common(pattern: str, steps: list[np.ndarray]) -> np.ndarray:
    """Common subsequence length of the pattern with texts fed one position at a time."""
    full = (1 << len(pattern)) - 1
    wide = len(pattern) > _WORD
    state = np.full(steps[0].shape, full, dtype=object if wide else np.uint64)
    for mask in steps:
        hit = state & mask
        state = (state + hit) | (state - hit)
        if wide:
            state = state & full
    if wide:
        return np.vectorize(lambda s: len(pattern) - s.bit_count(), otypes=[np.int64])(state)
    return len(pattern) - np.bitwise_count(state & np.uint64(full)).astype(np.int64)


def _pattern_in_texts(pattern: str, texts: list[str]) -> np.ndarray:
    """Best score of a pattern against texts at least as long."""
    m = len(pattern)
    width = max(map(len, texts))
    codes = np.pad(_codes(texts, width), ((0, 0), (m - 1, m - 1)))
    masks = _masks(pattern, codes)
    starts = width + m - 1
    common = _common(pattern, [masks[:, j:j + starts] for j in range(m)])
    lengths = np.array([len(t) for t in texts])[:, None]
    begin = np.arange(starts)[None, :] - (m - 1)
    covered = np.maximum(np.minimum(begin + m, lengths) - np.maximum(begin, 0), 0)
    return np.where(covered > 0, 200.0 * common / (m + covered), 0.0).max(axis=1)


def _texts_in_query(query: str, texts: list[str]) -> np.ndarray:
    """Best score of texts of one length inside a query at least as long."""
    n = len(texts[0])
    codes = _codes(texts, n)
    best = np.zeros(len(texts))
    for begin in range(1 - n, len(query)):
        window = query[max(begin, 0): begin + n]
        masks = _masks(window, codes)
        common = _common(window, [masks[:, j] for j in range(n)])
        best = np.maximum(best, 200.0 * common / (n + len(window)))
    return best


def partial_ratios(query: str, texts: list[str]) -> np.ndarray:
    """Partial ratio of one query with each text."""
    out = np.zeros(len(texts))
    by_length: dict[int, list[int]] = {}
    longer: list[int] = []
    for i, value in enumerate(texts):
        if not value or not query:
            out[i] = 100.0 if value == query else 0.0
            continue
        if len(value) >= len(query):
            longer.append(i)
        if len(value) <= len(query):
            by_length.setdefault(len(value), []).append(i)
    longer.sort(key=lambda i: len(texts[i]))
    while longer:
        # texts of like length share a matrix of bounded size, the longest setting its width
        width = len(texts[longer[-1]]) + 2 * len(query)
        rows, longer = longer[-max(1, _CELLS // width):], longer[:-max(1, _CELLS // width)]
        out[rows] = _pattern_in_texts(query, [texts[i] for i in rows])
    for rows in by_length.values():
        out[rows] = np.maximum(out[rows], _texts_in_query(query, [texts[i] for i in rows]))
    return out


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Partial ratio of two columns; null when either is null."""
    pairs = pd.DataFrame({"a": a, "b": b})
    out = pd.Series(np.nan, index=pairs.index)
    for query, rows in pairs.dropna().groupby("a", sort=False):
        out[rows.index] = partial_ratios(query, rows["b"].tolist())
    return out.astype(object).where(out.notna(), None)

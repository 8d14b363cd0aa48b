"""Weak supervision of quality rules: votes, accuracies by expectation-maximisation, posterior.

Each rule votes "good", "bad" or abstains. Votes are taken as independent given the hidden
quality; expectation-maximisation estimates how often each rule votes which way for good and
for bad documents, and the prior. A document is kept if its posterior probability of good
quality is at least a half. Estimation sees the counts of vote patterns of all documents
(3^rules at most, whatever the corpus), never the documents.

Null and empty texts have no words; they fail the base rules. Repeated rows count as often
as they occur. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.text import find_words, mix, slices, word_hashes
from rosterlink.session import staged

WINDOW = 8  # words
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of words
ROUNDS = 50
PRIOR_GOOD = 0.8
STRENGTH = 10.0  # documents' worth of belief in a rule's first accuracy

_COUNTS = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_FIELDS = ["doc_id", "n_words", *_COUNTS, "n_lines", "n_upper", "n_letters", "n_symbol_words"]
_U = np.uint64


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text, the words in 8-word windows that occur twice or more in it."""
    n, out = len(hashes), np.zeros(len(first) - 1, np.int64)
    if n < WINDOW:
        return out
    total = np.zeros(n - WINDOW + 1, _U)
    for k in range(WINDOW):
        total += hashes[k : n - WINDOW + 1 + k] * (mix(np.array([k + 31], _U)) | _U(1))
    total = mix(total)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text[: n - WINDOW + 1] == text[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    keys = mix(total[at] + mix(text[at].astype(_U) + _U(1)))  # windows of one text only are equal
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at[twice], 1)
    np.add.at(steps, at[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(steps[:-1]) > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def _duplicate_lines(data: np.ndarray, bounds: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the lines with a word and those of them that equal an earlier line."""
    raw = data.tobytes()
    lines, doubles = [], []
    words_before = np.searchsorted(start, bounds)
    for a, b, w, x in zip(bounds[:-1].tolist(), bounds[1:].tolist(), words_before[:-1].tolist(), words_before[1:].tolist(), strict=True):
        if w == x:
            lines.append(0)
            doubles.append(0)
            continue
        own = [line for line in raw[a:b].split(b"\n") if line and not line.isspace()]
        lines.append(len(own))
        doubles.append(len(own) - len(set(own)))
    return np.array(lines, np.int64), np.array(doubles, np.int64)


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each text."""
    kinds = np.zeros((4, 256), bool)
    kinds[0] = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
    kinds[1][list(SYMBOLS)] = True
    kinds[2][65:91] = True
    kinds[3][65:91] = kinds[3][97:123] = kinds[3][0xC3:0xD0] = True  # letters, by their first bytes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                words = find_words(piece.column("text"))
                totals = [np.concatenate([[0], np.cumsum(k[words.data])]) for k in kinds]
                in_words = np.concatenate([[0], np.cumsum(totals[0][words.end] - totals[0][words.start])])
                marked = np.concatenate([[0], np.cumsum(totals[1][words.end] > totals[1][words.start])])
                lines, doubles = _duplicate_lines(words.data, words.bounds, words.start)
                upper, letters, symbols = (t[words.bounds[1:]] - t[words.bounds[:-1]] for t in (totals[2], totals[3], totals[1]))
                columns = [
                    np.diff(words.first), in_words[words.first[1:]] - in_words[words.first[:-1]], symbols, doubles,
                    _repeated_words(word_hashes(words, lower=False), words.first), lines, upper, letters,
                    marked[words.first[1:]] - marked[words.first[:-1]],
                ]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], _FIELDS)

    return docs.select("doc_id", "text").mapInArrow(count, ", ".join(f"{c} long" for c in _FIELDS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """1 for good, -1 for bad, 0 for no opinion. A share of nothing is no opinion."""
    words, letters = F.greatest("n_words", F.lit(1)), F.greatest("n_letters", F.lit(1))
    repeated, symbols = F.col("n_repeat_words") / words, F.col("n_symbols") / words
    length, doubles = F.col("word_chars") / words, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))
    upper, some = F.col("n_upper") / letters, F.col("n_words") > 0
    return {
        "length": _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 50),
        "repeats": _vote(repeated > 0.3, repeated < 0.1),
        "symbols": _vote(symbols > 0.3, some & (symbols < 0.05)),
        "symbol_share": _vote(F.col("n_symbols") > 0.08 * F.col("word_chars"), some & (F.col("n_symbols") < 0.02 * F.col("word_chars"))),
        "symbol_words": _vote(F.col("n_symbol_words") > 0.3 * F.col("n_words"), some & (F.col("n_symbol_words") < 0.05 * F.col("n_words"))),
        "word_length": _vote(some & ((length < 2) | (length > 15)), some & length.between(3, 10)),
        "lines": _vote(doubles > 0.3, some & (doubles < 0.1)),
        "capitals": _vote(upper > 0.5, some & (upper < 0.2)),
        "letters": _vote(some & (F.col("n_letters") < 0.5 * F.col("word_chars")), some & (F.col("n_letters") > 0.75 * F.col("word_chars"))),
    }


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Prior of good and ``p[class, rule, vote]`` (class 1: good; vote -1, 0, 1 at 0, 1, 2).

    A rule's chances to vote bad, abstain or vote good start at 0.7 for the right side and
    are held there by ``STRENGTH`` documents, so rules that never disagree stay sensible.
    """
    rules = patterns.shape[1]
    first = np.empty((2, rules, 3))
    first[0], first[1] = (0.6, 0.25, 0.15), (0.1, 0.25, 0.65)
    p, prior = first.copy(), PRIOR_GOOD
    total = counts.sum()
    for _ in range(rounds if total else 0):
        good = posterior(patterns, prior, p)
        for side, weight in ((1, good * counts), (0, (1 - good) * counts)):
            for vote in (-1, 0, 1):
                p[side, :, vote + 1] = ((patterns == vote) * weight[:, None]).sum(axis=0) + STRENGTH * first[side, :, vote + 1]
            p[side] /= p[side].sum(axis=1, keepdims=True)
        prior = (good @ counts + STRENGTH * PRIOR_GOOD) / (total + STRENGTH)
    return float(prior), p


def posterior(patterns: np.ndarray, prior: float, p: np.ndarray) -> np.ndarray:
    rules = np.arange(patterns.shape[1])
    odds = np.log(prior / (1 - prior)) + (np.log(p[1]) - np.log(p[0]))[rules, patterns + 1].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base verdict, posterior and ``kept`` per row."""
    rules = votes()
    counted = staged(features(docs))
    voted = counted.select("*", *[v.alias(f"vote_{k}") for k, v in rules.items()])
    names = [f"vote_{k}" for k in rules]
    table = voted.groupBy(*names).count().collect()  # 3^rules rows at most
    patterns = np.array([[r[n] for n in names] for r in table], np.int64).reshape(-1, len(names))
    prior, p = estimate(patterns, np.array([r["count"] for r in table], float))
    weight = np.log(p[1]) - np.log(p[0])
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for i, n in enumerate(names):
        odds = odds + F.element_at(F.array(*[F.lit(float(x)) for x in weight[i]]), F.col(n) + 2)
    judged = voted.withColumn("base_failed", base_failed()).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop(*names)

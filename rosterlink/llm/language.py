"""Language identification: the family first, then one-versus-one linear SVMs inside it.

Texts become square-rooted, length-normalised counts of hashed byte trigrams of their
letters, over the whole text. Families are found from the languages' mean vectors by
average-link clustering. One-versus-rest linear support vector machines choose the family;
inside it each pair of languages has its own machine, and their votes are added. The score
is the probability of the family times that of the language in it.

Machines are fitted in numpy on a bounded sample: at most about ``SAMPLE`` labelled rows,
shared equally among the languages and drawn by a hash of the text. Prediction sees texts
only. A null text, or one without a letter, is ``und`` with score 0; so is everything if no
labelled text with a letter is given. Repeated rows are predicted alike. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterlink.llm.text import crc_of_id, slices, utf8

DIMENSIONS = 4096
SAMPLE = 1600  # labelled rows that the machines are fitted on
PENALTY = 1e-4
ROUNDS = 200
SHARPNESS = 3.0  # of the logistic curve from margins to probabilities
UNKNOWN = "und"

_LETTERS = np.full(256, 0x20, np.uint8)  # anything else counts as one space
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def held_out(fold: int = 1, of: int = 3) -> Column:
    return crc_of_id() % of == fold


def vectors(column: pa.Array) -> np.ndarray:
    """One line per text."""
    data, bounds = utf8(column)
    n, out = len(column), np.zeros((len(column), DIMENSIONS), np.float32)
    if len(data) < 3:
        return out
    letters = _LETTERS[data].astype(np.uint32)
    codes = letters[:-2] | (letters[1:-1] << np.uint32(8)) | (letters[2:] << np.uint32(16))
    bins = (codes * np.uint32(0x9E3779B1)) >> np.uint32(20)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), (bounds[1:] - 2).tolist(), strict=True)):
        if b > a:
            out[i] = np.bincount(bins[a:b], minlength=DIMENSIONS)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model(NamedTuple):
    languages: list[str]
    family: np.ndarray  # of each language
    machines: np.ndarray  # DIMENSIONS + 1 by families: one against the rest
    pairs: list[tuple[int, int]]  # languages of one family
    duels: np.ndarray  # DIMENSIONS + 1 by pairs; positive for the first

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each line."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        chance = _logistic(x @ self.machines)
        chance /= chance.sum(axis=1, keepdims=True)
        inside = np.zeros((len(x), len(self.languages)))
        for (a, b), p in zip(self.pairs, _logistic(x @ self.duels).T, strict=True):
            inside[:, a] += p
            inside[:, b] += 1 - p
        number = np.bincount(self.family, minlength=self.machines.shape[1])
        fights = (number - 1)[self.family]  # of each language
        inside = np.where(fights > 0, inside / np.maximum(fights, 1), 1.0)
        chosen = chance.argmax(axis=1)
        best = np.where(self.family == chosen[:, None], inside, -1.0).argmax(axis=1)
        lines = np.arange(len(x))
        return best, np.clip(chance[lines, chosen] * inside[lines, best], 0.0, 1.0)


def _logistic(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-SHARPNESS * np.clip(margins, -50, 50).astype(float)))


def machine(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """A linear SVM by averaged subgradient steps on the hinge loss; both sides weigh the same.

    The last column of ``x`` is one.
    """
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    weight = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    w, mean = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    for t in range(ROUNDS):
        short = y * (x @ w) < 1
        w = w * (1 - PENALTY) + (20.0 / np.sqrt(1 + t)) * (x.T @ (y * weight * short))
        if t >= ROUNDS // 2:
            mean += w / (ROUNDS - ROUNDS // 2)
    return mean


def families(means: np.ndarray) -> np.ndarray:
    """About the square root of the number of languages, by average linkage of cosines."""
    groups = [[i] for i in range(len(means))]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    close = unit @ unit.T
    while len(groups) > max(1, int(np.ceil(np.sqrt(len(means))))):
        pairs = [(close[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(pairs, key=lambda p: (p[0], -p[1], -p[2]))
        groups[i] += groups.pop(j)
    out = np.zeros(len(means), np.int64)
    for f, members in enumerate(groups):
        out[members] = f
    return out


def fit(labels: list[str], x: np.ndarray) -> Model:
    """``x`` has a last column of ones, so that no machine copies it to add one."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    family = families(np.stack([x[y == i, :-1].mean(axis=0) for i in range(len(languages))]))
    machines = np.stack([machine(x, family[y] == f) for f in range(family.max() + 1)], axis=1)
    pairs = [(a, b) for a in range(len(languages)) for b in range(a + 1, len(languages)) if family[a] == family[b]]
    duels = [machine(x[(y == a) | (y == b)], y[(y == a) | (y == b)] == a) for a, b in pairs]
    return Model(languages, family, machines, pairs, np.stack(duels, axis=1) if duels else np.zeros((x.shape[1], 0), np.float32))


def learn(docs: DataFrame, training: Column, sample: int = SAMPLE) -> Model | None:
    """Fit on the labelled rows where ``training`` holds."""
    usable = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()}
    if not sizes:
        return None
    each = max(1, sample // len(sizes))
    part = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.2 * each / n))) for k, n in sizes.items()], F.lit(0.0))
    drawn = usable.where(F.pmod(F.xxhash64(F.lit(17), "text"), F.lit(1 << 20)) < part * (1 << 20))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for batch in batches:
            for piece in slices(batch):
                x = vectors(piece.column("text")).astype(np.float16)
                langs = piece.column("lang").to_pylist()
                own = []
                for i, v in enumerate(langs):  # copies of one text may all be drawn; no task sends more than the sample
                    kept[v] = kept.get(v, 0) + 1
                    if kept[v] <= each:
                        own.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in own]), pa.array([x[i].tobytes() for i in own], pa.binary())], ["lang", "x"])

    # distinct texts, so that copies don't crowd out the rest; ordered, so that reruns agree
    rows = drawn.select("lang", "text").dropDuplicates().mapInArrow(collect, "lang string, x binary").orderBy("lang", "x").limit(2 * sample).collect()
    x = np.ones((len(rows), DIMENSIONS + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, :-1] = np.frombuffer(r["x"], np.float16)
    labels = [r["lang"] for r in rows]
    del rows
    return fit(labels, x)


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``; clashing names are replaced."""
    given = docs.drop("lang_pred", "score")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                text = piece.column("text")
                lettered = [has_letter(t) for t in text.to_pylist()]
                best, score = model.predict(vectors(text)) if model else (np.zeros(len(text), int), np.zeros(len(text)))
                names = [model.languages[b] if ok and model else UNKNOWN for ok, b in zip(lettered, best, strict=True)]
                columns = [*piece.columns, pa.array(names), pa.array(np.where(np.array(lettered, bool), score, 0.0))]
                yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names, "lang_pred", "score"])

    added = StructType.fromDDL("lang_pred string, score double").fields
    return given.mapInArrow(predict, StructType([*given.schema.fields, *added]))


def identified(docs: DataFrame, choose: Callable[[], Column] = held_out) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row, learning from the rows not held out."""
    out = choose()
    return predicted(docs, learn(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, choose: Callable[[], Column] = held_out) -> DataFrame:
    """The documents whose language is found, with the input's columns; a null lang becomes the language found.

    Where no row has a label nothing can be learned, and all texts with a letter stay as they are.
    """
    model = learn(docs, ~choose())
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    taken = {c.lower() for c in docs.columns}
    other = {c: next(n for i in range(len(taken) + 1) if (n := f"{c}_{i}").lower() not in taken) for c in ("lang_pred", "score")}
    there = {c: other[c.lower()] for c in docs.columns if c.lower() in other}
    found = predicted(docs.withColumnsRenamed(there), model).where(F.col("lang_pred") != UNKNOWN)
    columns = [F.col(there[c]).alias(c) if c in there else F.col(c) for c in docs.columns]
    return found.select(*[F.coalesce("lang", "lang_pred").alias(c) if c == "lang" else x for c, x in zip(docs.columns, columns, strict=True)])

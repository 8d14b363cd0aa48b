"""A log-bilinear language model by noise-contrastive estimation, scoring whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; each text ends with one end token.
Classes are the most frequent words, the end, and groups of all other words by a hash; both
numbers grow with the fourth root of the distinct words (``class_numbers``). The score of class w after
two classes is ``(R[a] * C1 + R[b] * C2) . Q[w] + bias[w]``. Training is noise-contrastive on
the trigram counts of all training documents, in numpy: one trainer for every
``TOKENS_PER_TRAINER`` tokens passes over all its trigrams in each round, each weighted by its
count, and the parameters are averaged between rounds, first in tasks. Scoring normalises exactly, by batched matrix products over contexts.
A word of a group has the group's probability times (c + 1) / (the group's tokens + its distinct
words + 1), so the model is a distribution over all words, unseen too.

Null and empty texts have the end alone. Without training documents every count is 0 and the
model is the uniform one it starts as. Repeated rows count and are scored one by one. Extra
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlink.llm.text import crc_of_id, slices, utf8
from rosterlink.session import staged

CLASSES = 1000  # words with a class of their own, at least
CLASSES_BY_ROOT = 30  # and so many for the fourth root of the distinct words
GROUPED = 64  # a group of other words for so many classes
KNOWN = 100_000  # words whose counts every task holds; the others meet their counts in a join
KNOWN_BYTES = 40  # longer words are always joined
DIMENSIONS = 32
NOISE = 64
BATCH = 2048
ROUNDS = 2
TOKENS_PER_TRAINER = 16_000_000
PARTIAL_MODELS = 16  # that meet on the driver
LEAST_STEPS = 400  # small inputs pass over their trigrams again until so many steps are made
REMEMBERED = 1 << 22  # normalisers of contexts, by slot
FLUSH = 500_000  # entries of a task's own counts

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def held_out(fold: int = 2, of: int = 7) -> Column:
    return crc_of_id() % of == fold


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The words of each text."""
    data, bounds = utf8(batch.column("text"))
    raw = data.tobytes().translate(_LOWER)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield raw[a:b].split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts; tasks count before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for piece in slices(batch):
                for words in _texts(piece):
                    seen.update(words)
                if len(seen) > FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_numbers(distinct: int) -> tuple[int, int]:
    """Words with a class of their own and groups of other words, for so many distinct words."""
    classes = max(CLASSES, round(CLASSES_BY_ROOT * distinct**0.25))
    return classes, -(-classes // GROUPED)


class Vocabulary(NamedTuple):
    """Known words by falling count; the first ``classes`` of them have a class."""

    words: dict[bytes, int]
    counts: np.ndarray
    classes: int
    groups: int
    class_of: np.ndarray  # of each known word
    group_tokens: np.ndarray
    group_words: np.ndarray
    documents: int  # in training: the count of the end
    tokens: int  # in training, ends included
    distinct: int  # ends included

    @property
    def end(self) -> int:
        return self.classes + self.groups

    @property
    def begin(self) -> int:
        return self.end + 1

    @property
    def size(self) -> int:
        return self.end + 2

    def unigrams(self) -> np.ndarray:
        """Smoothed probabilities of all classes; that of the begin is 0."""
        n = np.concatenate([self.counts[: self.classes], self.group_tokens, [self.documents, 0]]).astype(float) + 1
        n[-1] = 0
        return n / n.sum()

    def classes_of(self, known: np.ndarray) -> np.ndarray:
        """Classes of the places that ``_known`` gives."""
        if not len(self.class_of):
            return self.classes - 1 - known
        return np.where(known >= 0, self.class_of[np.maximum(known, 0)], self.classes - 1 - known)


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    short = counts.where(F.octet_length("word") <= KNOWN_BYTES).withColumn("level", F.floor(16 * F.log2("n")).cast("int"))
    room, lowest = KNOWN, None  # a level is a range of counts; whole levels are taken, a thousand of them at most exist
    for row in sorted(short.groupBy("level").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        if row["words"] > room:
            break
        room, lowest = room - row["words"], row["level"]
    top = [] if lowest is None else sorted(short.where(F.col("level") >= lowest).collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    words = {bytes(r["word"]): i for i, r in enumerate(top)}
    classes, groups = class_numbers(distinct)
    classes = min(classes, len(top))
    group_of = np.array([zlib.crc32(w) % groups for w in words], np.int64)
    class_of = np.where(np.arange(len(words)) < classes, np.arange(len(words)), classes + group_of)
    tokens, members = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    for r in counts.groupBy((F.crc32("word") % groups).cast("int").alias("g")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        tokens[r["g"]], members[r["g"]] = r["n"], r["words"]
    counted = np.array([r["n"] for r in top], np.int64)
    np.subtract.at(tokens, group_of[:classes], counted[:classes])
    np.subtract.at(members, group_of[:classes], 1)
    return Vocabulary(words, counted, classes, groups, class_of, tokens, members, documents, total + documents, distinct + (documents > 0))


def trigrams(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``code, n``: two classes and the one after them, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        get, size = vocab.words.get, vocab.size

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def row(pair: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["code", "n"])

        for batch in batches:
            for piece in slices(batch):
                known, lengths, _ = _known(_texts(piece), get, vocab.groups)
                codes = _codes(vocab.classes_of(known), vocab, lengths)
                u, n = np.unique(codes[0] * size + codes[1], return_counts=True)
                parts.append((u, n))
                if sum(len(p[0]) for p in parts) > 4 * FLUSH:
                    parts[:] = [merged()]
                    if len(parts[0][0]) > 2 * FLUSH:
                        yield row(parts.pop())
        if parts:
            yield row(merged())

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _known(texts: Iterator[list[bytes]], get, groups: int) -> tuple[np.ndarray, list[int], list]:
    """Places in the vocabulary of all words in a row (below 0: unknown, -1 - group), lengths, unknown words by text."""
    places: list[int] = []
    lengths, tails = [], []
    for words in texts:
        own = [get(w, -1) for w in words]
        tail = None
        if -1 in own:
            tail = Counter(w for w, p in zip(words, own, strict=True) if p < 0)
            own = [p if p >= 0 else -1 - zlib.crc32(w) % groups for w, p in zip(words, own, strict=True)]
        tails.append(tail)
        places += own
        lengths.append(len(own))
    return np.array(places, np.int64), lengths, tails


def _codes(classes: np.ndarray, vocab: Vocabulary, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token, ends included: its context, its class and the number of its text."""
    n = np.array(lengths, np.int64)
    text = np.repeat(np.arange(len(n)), n + 3)  # two begins before, one end behind
    row = np.full(len(text), vocab.begin, np.int64)
    first = np.cumsum(n + 3) - (n + 3)
    token = np.ones(len(text), bool)
    token[first] = token[first + 1] = False
    ends = first + n + 2
    row[ends] = vocab.end
    inner = token.copy()
    inner[ends] = False
    row[inner] = classes
    at = np.flatnonzero(token)
    return row[at - 2] * vocab.size + row[at - 1], row[at], text[at]


class Parameters(NamedTuple):
    r: np.ndarray  # of classes as context
    q: np.ndarray  # of classes as target
    c: np.ndarray  # 2 x d: weights of the word two before and the word just before
    bias: np.ndarray

    def predicted(self, context: np.ndarray) -> np.ndarray:
        size = len(self.bias)
        return self.r[context // size] * self.c[0] + self.r[context % size] * self.c[1]


def start(vocab: Vocabulary, seed: int = 3) -> Parameters:
    rng = np.random.default_rng(seed)
    shape = (vocab.size, DIMENSIONS)
    bias = np.log(np.maximum(vocab.unigrams(), 1e-30))
    return Parameters(rng.normal(0, 0.1, shape), rng.normal(0, 0.1, shape), np.ones((2, DIMENSIONS)), bias)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row number once, with the sum of its values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def passes(codes: int) -> int:
    """Whole passes over so many trigrams that make at least ``LEAST_STEPS`` steps."""
    return max(1, -(-LEAST_STEPS * BATCH // max(codes, 1)))


def train(model: Parameters, codes: np.ndarray, counts: np.ndarray, noise: np.ndarray, seed: int, rate: float = 0.15) -> Parameters:
    """Noise-contrastive steps over all trigrams, each weighted by its count, with AdaGrad on the rows touched.

    Every pass takes each trigram once, in an order drawn anew, so every token counts in every pass.
    """
    rng, size = np.random.default_rng(seed), len(model.bias)
    r, q, c, bias = (x.astype(np.float32) for x in model)
    squares = [np.full_like(x, 1e-2) for x in (r, q, c, bias)]
    weights = (counts / counts.mean()).astype(np.float32)  # a token weighs 1 / the mean count, the same in all batches
    noise_reach = np.cumsum(noise)
    log_noise = np.log(NOISE * np.maximum(noise, 1e-30)).astype(np.float32)

    def move(x: np.ndarray, s: np.ndarray, rows, g: np.ndarray) -> None:
        g = g / np.float32(BATCH)
        s[rows] += g * g
        x[rows] += np.float32(rate) * g / np.sqrt(s[rows])

    order = np.concatenate([rng.permutation(len(codes)) for _ in range(passes(len(codes)))])
    for at in range(0, len(order), BATCH):
        taken = order[at : at + BATCH]
        drawn, weight = codes[taken], weights[taken]
        w, context = drawn % size, drawn // size
        a, b = context // size, context % size
        k = np.searchsorted(noise_reach, rng.random(NOISE) * noise_reach[-1], "right").clip(max=size - 1)
        ra, rb = r[a], r[b]
        hidden = ra * c[0] + rb * c[1]
        # d loss / d score: of the data 1 - P(data), of each noise class - P(data)
        up = weight / (1 + np.exp(np.clip((hidden * q[w]).sum(axis=1) + bias[w] - log_noise[w], -30, 30)))
        down = -weight[:, None] / (1 + np.exp(-np.clip(hidden @ q[k].T + bias[k] - log_noise[k], -30, 30)))
        g_hidden = up[:, None] * q[w] + down @ q[k]
        g_c = np.stack([(g_hidden * ra).sum(axis=0), (g_hidden * rb).sum(axis=0)])
        g_r = _summed(np.concatenate([a, b]), np.concatenate([g_hidden * c[0], g_hidden * c[1]]))
        targets = np.concatenate([w, k])
        g_q = _summed(targets, np.concatenate([up[:, None] * hidden, down.T @ hidden]))
        g_bias = _summed(targets, np.concatenate([up, down.sum(axis=0)]))
        move(r, squares[0], *g_r)
        move(q, squares[1], *g_q)
        move(c, squares[2], slice(None), g_c)
        move(bias, squares[3], *g_bias)
    return Parameters(*(x.astype(float) for x in (r, q, c, bias)))


def fit(counts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, tokens_per_trainer: int = TOKENS_PER_TRAINER) -> Parameters:
    """Rounds of training in tasks on disjoint shares of the trigrams, averaged after each.

    Models are added up in ``PARTIAL_MODELS`` groups of tasks; those sums come to the driver.
    """
    model, noise = start(vocab), vocab.unigrams()
    rows = counts.count()
    if not rows:
        return model
    shared = counts.repartition(max(1, -(-vocab.tokens // tokens_per_trainer)))
    schema = "part int, weight double, model binary"
    for turn in range(rounds):
        now = model

        def work(batches: Iterator[pa.RecordBatch], now: Parameters = now, turn: int = turn) -> Iterator[pa.RecordBatch]:
            parts = [(b.column("code").to_numpy(), b.column("n").to_numpy()) for b in batches]
            codes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            if len(codes):
                order = np.argsort(codes)  # rows come in any order; the draws must not depend on it
                codes, n = codes[order], np.concatenate([p[1] for p in parts])[order]
                done = train(now, codes, n, noise, int(codes[0]) + turn)
                flat = np.concatenate([x.ravel() for x in done]) * n.sum()
                group = int(codes[0]) % PARTIAL_MODELS
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([float(n.sum())]), pa.array([flat.tobytes()], pa.binary())], ["part", "weight", "model"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """One sum per task, of models in an order that does not depend on their arrival."""
            weight, total = 0.0, None
            for batch in batches:
                for w, flat in zip(batch.column("weight").to_pylist(), batch.column("model"), strict=True):
                    own = np.frombuffer(flat.as_py())
                    weight, total = weight + w, own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([weight]), pa.array([total.tobytes()], pa.binary())], ["part", "weight", "model"])

        trained = shared.mapInArrow(work, schema).repartition(PARTIAL_MODELS, "part").sortWithinPartitions("part", "weight", "model")
        results = sorted(trained.mapInArrow(add, schema).collect(), key=lambda x: (x["weight"], bytes(x["model"][:64])))
        flat = sum(np.frombuffer(x["model"]) for x in results) / sum(x["weight"] for x in results)
        cuts = np.cumsum([x.size for x in model])[:-1]
        model = Parameters(*[part.reshape(x.shape) for part, x in zip(np.split(flat, cuts), model, strict=True)])
    return model


class Scorer:
    """Normalised log10 probabilities of classes; normalisers found before are remembered by slot."""

    def __init__(self, model: Parameters):
        size = len(model.bias)
        bias = model.bias.astype(np.float32)
        bias[size - 1] = -np.inf  # nothing begins inside a text
        self.model = Parameters(*(x.astype(np.float32) for x in model[:3]), bias)
        slots = min(REMEMBERED, size * size)
        self.context, self.normaliser = np.full(slots, -1, np.int64), np.zeros(slots, np.float32)

    def _normalisers(self, contexts: np.ndarray) -> np.ndarray:
        m, out = self.model, np.empty(len(contexts), np.float32)
        for a in range(0, len(contexts), 2048):
            scores = m.predicted(contexts[a : a + 2048]) @ m.q.T + m.bias
            most = scores.max(axis=1)
            scores -= most[:, None]
            out[a : a + 2048] = most + np.log(np.exp(scores, out=scores).sum(axis=1))
        return out

    def log10(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        m, slot = self.model, context % len(self.context)
        new = np.unique(context[self.context[slot] != context])
        if len(new):
            at = new % len(self.context)
            self.normaliser[at], self.context[at] = self._normalisers(new), new
        normaliser = self.normaliser[slot]
        lost = np.flatnonzero(self.context[slot] != context)  # two contexts of one slot
        if len(lost):
            again, where = np.unique(context[lost], return_inverse=True)
            normaliser[lost] = self._normalisers(again)[where]
        score = np.einsum("ij,ij->i", m.predicted(context), m.q[target]) + m.bias[target]
        return (score - normaliser).astype(float) / np.log(10)


@lru_cache(maxsize=1)
def _scorer(flat: bytes, size: int) -> Scorer:
    """One per worker process and model."""
    x = np.frombuffer(flat)
    d = size * DIMENSIONS
    return Scorer(Parameters(x[:d].reshape(size, -1), x[d : 2 * d].reshape(size, -1), x[2 * d : 2 * d + 2 * DIMENSIONS].reshape(2, -1), x[2 * d + 2 * DIMENSIONS :]))


_LINE = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, other double, model double, "
    "tail array<struct<word:binary,tf:long>>"
)
_NAMES = re.findall(r"(\w+) (?:long|boolean|double|array)", _LINE)


def scores(docs: DataFrame, fold: Column | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    out = held_out() if fold is None else fold
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", out.alias("held_out"))
    training = numbered.where(~F.col("held_out"))
    counts = staged(word_counts(training))
    vocab = vocabulary(counts, training.count())
    model = fit(staged(trigrams(training, vocab)), vocab)
    sc = docs.sparkSession.sparkContext
    # bounded by KNOWN words of KNOWN_BYTES and by the classes
    shared = sc.broadcast((vocab, np.concatenate([x.ravel() for x in model]).tobytes()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat = shared.value
        scorer, get = _scorer(flat, vocab.size), vocab.words.get
        logs = np.append(np.log10(vocab.counts + 1.0), 0.0)  # unknown words: 0, at the end
        shares = np.log10(vocab.group_tokens + vocab.group_words + 1.0)
        for batch in batches:
            for piece in slices(batch):
                known, lengths, tails = _known(_texts(piece), get, vocab.groups)
                classes = vocab.classes_of(known)
                other = classes >= vocab.classes
                context, target, text = _codes(classes, vocab, lengths)
                n = len(lengths)
                word_text = np.repeat(np.arange(n), lengths)
                add = lambda values, at=word_text: np.bincount(at, values, n)
                log = logs[np.where(known >= 0, known, len(logs) - 1)]
                share = shares[np.where(other, classes - vocab.classes, 0)]
                columns = [
                    piece.column("row"), piece.column("doc_id").cast(pa.int64()), piece.column("held_out"), pa.array(np.array(lengths, np.int64) + 1),
                    pa.array(add((known >= 0).astype(float)).astype(np.int64)), pa.array(add(log)), pa.array(add(np.where(other, log - share, 0.0))),
                    pa.array(np.bincount(text, scorer.log10(context, target), n)),
                    pa.array([[{"word": w, "tf": k} for w, k in t.items()] if t else [] for t in tails], pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int64())]))),
                ]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)

    lines = staged(numbered.mapInArrow(score, _LINE))
    tail = lines.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.tf")
    met = tail.join(counts, "word").groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("more"), F.sum("tf").alias("more_known"))
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    end = float(np.log10(vocab.documents + 1))
    return lines.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more_known + int(vocab.documents > 0)).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more + end - F.col("n_tokens") * float(np.log10(vocab.tokens + vocab.distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("other") + more).alias("score"),
    )

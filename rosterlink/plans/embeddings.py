"""Embed publication texts, computing only what the cache does not hold."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlink.functions import text
from rosterlink.session import staged

# Fixed value: texts handed to a provider in one call.
PROVIDER_BATCH = 64

Provider = Callable[[list[str]], np.ndarray]


def hashed_words(texts: list[str], dims: int = 16) -> np.ndarray:
    """Stand-in provider: words counted in MD5 buckets, scaled to unit length.

    Any callable from texts to one vector each can take its place.
    """
    out = np.zeros((len(texts), dims))
    for row, value in enumerate(texts):
        for word, n in Counter(value.split(" ")).items():
            if word:
                out[row, int(hashlib.md5(word.encode()).hexdigest()[:2], 16) % dims] += n
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1.0, norms)


def in_id_range(pub: DataFrame, first: int, last: int) -> DataFrame:
    """Publications of an id range, for a run over new ids only."""
    return pub.where(F.col("id_pub").between(first, last))


def publication_texts(pub: DataFrame) -> DataFrame:
    """``id_pub, text, text_hash``."""
    body = pub.select("id_pub", text.embedding_text(F.col("title"), F.col("abstract")).alias("text"))
    return body.withColumn("text_hash", text.text_hash(F.col("text")))


def uncached_texts(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct ``text_hash, text`` that the cache of ``model`` lacks."""
    known = cache.where(F.col("model") == model).select("text_hash")
    # copies collapse in each task first, so a text many share is shuffled once per task
    once = texts.select("text_hash", "text").dropDuplicates(["text_hash"])
    return once.join(known, "text_hash", "left_anti")


def embed(missing: DataFrame, provider: Provider, model: str, batch: int = PROVIDER_BATCH) -> DataFrame:
    """Cache rows for the given texts; the provider sees ``batch`` texts per call."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                vectors = np.asarray(provider(part["text"].tolist()), dtype=float)
                yield pd.DataFrame({"model": model, "text_hash": part["text_hash"], "embedding": list(vectors)})

    return missing.mapInPandas(run, "model string, text_hash string, embedding array<double>")


@dataclass
class Embedded:
    pub_embedding: DataFrame
    added: DataFrame
    texts: int
    computed: int


def embed_publications(pub: DataFrame, cache: DataFrame, provider: Provider, model: str) -> Embedded:
    """Vectors of all publications and the rows to add to the cache.

    The added rows are staged before use, so the provider runs once per missing text, and
    a second run against the grown cache adds none.
    """
    texts = publication_texts(pub)
    vectors, added = embed_texts(texts, cache, provider, model)
    keys = texts.select("id_pub", "text_hash")
    joined = keys.join(vectors, "text_hash").select("id_pub", "embedding")
    return Embedded(joined, added, keys.count(), added.count())


def embed_texts(texts: DataFrame, cache: DataFrame, provider: Provider, model: str) -> tuple[DataFrame, DataFrame]:
    """``text_hash, embedding`` of all texts (``text_hash, text``), and the rows to add to the cache."""
    added = staged(embed(uncached_texts(texts, cache, model), provider, model))
    # only wanted vectors are shuffled; two builds at once may both have added a text
    wanted = cache.where(F.col("model") == model).join(texts.select("text_hash").distinct(), "text_hash", "left_semi")
    vectors = wanted.unionByName(added).groupBy("text_hash").agg(F.min("embedding").alias("embedding"))
    return vectors, added

"""Embedding and reranking providers.  The offline defaults are deterministic stand-ins, not models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import MAX_EMBED_CHARS

#: What a provider is: texts to one row of numbers each, or None where a text cannot be embedded.
Provider = Callable[[list[str]], list[list[float] | None]]
BATCH, BATCH_CHARS = 500, 400_000
#: Tries of a provider that raises, and seconds before the second one; each further wait is twice as long.
TRIES, WAIT = 3, 0.1
#: Candidates that one call of a reranker gets.
RERANK_BATCH = 25
# What a text is embedded as.
TASKS = ("query", "passage")


def hashing_provider(dimension: int = 64) -> Provider:
    """Signed counts of word hashes, normalised: equal texts have equal vectors, shared words bring texts near."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        import zlib

        out = np.zeros((len(texts), dimension))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % dimension] += 1 if h & 0x80000000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    return embed


def zero_provider(dimension: int) -> Provider:
    return lambda texts: [[0.0] * dimension for _ in texts]


def for_task(provider: Provider, task: str) -> Provider:
    """The provider for one task: a provider with an argument `task` is told, others treat both alike."""
    import inspect

    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    return (lambda texts: provider(texts, task=task)) if "task" in inspect.signature(provider).parameters else provider


def retried(provider: Provider, texts: list[str], tries: int = TRIES, wait: float = WAIT) -> list[list[float] | None]:
    """The provider's answer; it is asked again after growing waits, and its last error stands."""
    import time

    for n in range(tries):
        try:
            return provider(texts)
        except Exception:
            if n == tries - 1:
                raise
            time.sleep(wait * 2**n)
    return []


def batches(lengths: list[int], most: int, chars: int = BATCH_CHARS) -> Iterator[range]:
    """Runs of texts of at most `most` texts and `chars` characters (a longer text is a run of its own)."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start == most or held + n > chars):
            yield range(start, i)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield range(start, len(lengths))


def embed(df: DataFrame, text: str, provider: Provider, out: str = "embedding", batch: int = BATCH, task: str = "passage") -> DataFrame:
    """df with the vector of each text; null for a null text, one over the length limit, or what the provider refuses."""
    ask = for_task(provider, task)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            found: list = [None] * len(texts)
            able = [i for i, t in enumerate(texts) if t is not None and len(t) <= MAX_EMBED_CHARS]
            for run_ in batches([len(texts.iloc[i]) for i in able], batch):
                some = [able[j] for j in run_]
                for i, v in zip(some, retried(ask, [texts.iloc[i] for i in some]), strict=True):
                    found[i] = v
            yield pd.Series(found)

    apply = F.pandas_udf(_typed(run), "array<float>")
    return df.withColumn(out, apply(text))


def _typed(run):
    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run


def rerank_batches(candidates: DataFrame, query: str, key: str, text: str, score: Callable[[str, list[str]], list[float]], batch: int = RERANK_BATCH) -> DataFrame:
    """key, score of a bounded list of candidates (best first by its column `rank`), scored in batches side by side; a batch whose scoring fails is left out."""
    kind = candidates.schema[key].dataType.simpleString()
    rows = candidates.select(F.floor((F.col("rank") - 1) / batch).alias("batch"), "rank", F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        try:
            found = score(query, pdf["text"].tolist())
        except Exception:
            return pd.DataFrame({"key": pdf["key"][:0], "score": pd.Series([], dtype=float)})
        return pd.DataFrame({"key": pdf["key"], "score": [float(x) for x in found]})

    found = rows.groupBy("batch").applyInPandas(run, f"key {kind}, score double")
    return found.select(F.col("key").alias(key), "score").orderBy(F.isnan("score"), F.desc("score"), key)


def word_overlap(query: str) -> Callable[[Column], Column]:
    """Offline reranker: share of the query's words that a text has."""
    words = sorted(set(query.lower().split()))
    have = lambda text: F.size(F.array_intersect(F.split(F.lower(text), r"\s+"), F.array(*map(F.lit, words))))
    return lambda text: have(text) / float(max(len(words), 1))

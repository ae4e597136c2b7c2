"""Embedding vectors through a pluggable batch embedder, on the executors."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_CHARS, truncate_at_word

#: Fixed values.
MODEL, FAKE_DIM, BATCH, RETRIES = "text-embedding-3-small", 8, 50, 5


class RateLimited(Exception):
    """Raised by an embedder that may be called again later; its text names an exhausted quota."""


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Settings:
    """What the environment says about embedding; read once, when asked for."""

    api_key: str | None = None
    fake: bool = False
    max_chars: int = MAX_CHARS

    @classmethod
    def read(cls, env: Mapping[str, str] = os.environ) -> Settings:
        return cls(env.get("OPENAI_API_KEY") or None, env.get("USE_FAKE_EMBEDDINGS") == "1", int(env.get("MAX_EMBEDDING_CHARS", MAX_CHARS)))

    def embedder(self) -> Embedder:
        """Fakes where they are asked for, else the provider, which needs a key."""
        return FakeEmbedder() if self.fake else OpenAIEmbedder(self.api_key)


class OpenAIEmbedder:
    """Vectors from the provider; each Python worker makes its client at the first call."""

    def __init__(self, api_key: str | None, model: str = MODEL):
        if not api_key:
            raise ValueError("OPENAI_API_KEY is not set; USE_FAKE_EMBEDDINGS=1 asks for zero vectors instead")
        self.api_key, self.model, self._client = api_key, model, None

    def __getstate__(self):
        return {"api_key": self.api_key, "model": self.model, "_client": None}

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import openai

        if self._client is None:
            self._client = openai.OpenAI(api_key=self.api_key)
        try:
            got = self._client.embeddings.create(model=self.model, input=texts)
        except openai.RateLimitError as e:
            raise RateLimited(str(e)) from e
        return [d.embedding for d in sorted(got.data, key=lambda d: d.index)]


class FakeEmbedder:
    """Zero vectors, for runs without a provider; expressed as a literal column, no Python involved."""

    dim = FAKE_DIM

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[0.0] * self.dim for _ in texts]


def with_retry(embed: Embedder, retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """Waits 2, 4, 8, ... seconds after each rate limit; an exhausted quota fails at once."""

    def call(texts: list[str]) -> list[list[float]]:
        for attempt in range(1, retries + 2):
            try:
                return embed(texts)
            except RateLimited as e:
                if "insufficient_quota" in str(e) or attempt > retries:
                    raise
                sleep(2.0**attempt)
        raise AssertionError("unreachable")

    return call


def embed_batches(embed: Embedder, texts: list[str], batch: int = BATCH) -> list[list[float]]:
    """Vectors in the order of the texts, asked for in batches; all must be as long as the first."""
    out: list[list[float]] = []
    for lo in range(0, len(texts), batch):
        part = texts[lo : lo + batch]
        got = embed(part)
        if len(got) != len(part):
            raise ValueError(f"{len(got)} vectors for {len(part)} texts")
        out.extend(got)
    if any(len(v) != len(out[0]) for v in out):
        raise ValueError("Inconsistent embedding dimensions")
    return out


def attach_vectors(docs: DataFrame, embedder: Embedder | None = None, batch: int = BATCH, max_chars: int = MAX_CHARS) -> DataFrame:
    """docs with a column vector, ARRAY<FLOAT>. Apply it after de-duplication: calls may cost money.

    A task that is run again asks again, so an embedder must be idempotent.
    """
    if embedder is None or isinstance(embedder, FakeEmbedder):
        return docs.withColumn("vector", F.array_repeat(F.lit(0.0).cast("float"), FAKE_DIM))
    embed = with_retry(embedder)

    def fill(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            yield pd.Series(embed_batches(embed, texts.tolist(), batch))

    column = F.pandas_udf(fill, "array<float>")
    return docs.withColumn("vector", column(truncate_at_word(F.col("text"), max_chars)))


def truncation(docs: DataFrame, max_chars: int = MAX_CHARS, text: str = "text") -> DataFrame:
    """One row: how many texts are cut before they are embedded, and their characters before and after."""
    whole = F.length(text)
    cut = F.length(truncate_at_word(F.col(text), max_chars))
    over = whole > max_chars
    total = lambda c: F.coalesce(F.sum(F.when(over, c)), F.lit(0)).cast("long")
    return docs.agg(F.count_if(over).alias("n_truncated"), total(whole).alias("chars_before"), total(cut).alias("chars_after"))


def dimensions(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """One row: how many vectors there are and how many different lengths."""
    return vectors.agg(F.count(F.lit(1)).alias("n_vectors"), F.count_distinct(F.size(column)).alias("n_dims"))


def checked(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """The same rows; fails if lengths differ anywhere in the dataset."""
    if dimensions(vectors, column).first()["n_dims"] > 1:
        raise ValueError("Inconsistent embedding dimensions")
    return vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

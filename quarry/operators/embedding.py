"""The seam to embedding models: texts in batches bounded in number and tokens, vectors checked, failures tried again.

A backend is a function from a list of texts to a list of vectors that executors can run; the hashing backend here needs no
model and no network and serves tests. Batches are cut inside Arrow batches, so nothing is shuffled or collected.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions.text import BYTES_PER_TOKEN

BATCH, BATCH_TOKENS = 64, 100_000
#: Answers of a service after which a request is worth trying again.
RETRYABLE = {408, 409, 425, 429, 500, 502, 503, 504}
Backend = Callable[[list[str]], list[list[float]]]


def batches(texts: list[str], most: int = BATCH, most_tokens: int = BATCH_TOKENS) -> Iterator[list[str]]:
    """Consecutive texts, as many as number and estimated tokens allow; a text over the budget goes alone."""
    held, cost = [], 0
    for text in texts:
        n = len(text.encode("utf-8", "replace"))
        tokens = max(1, round(n / BYTES_PER_TOKEN["code"])) if n else 0
        if held and (len(held) >= most or cost + tokens > most_tokens):
            yield held
            held, cost = [], 0
        held.append(text)
        cost += tokens
    if held:
        yield held


class Retry:
    """How often and how long apart: doubled delays with jitter up to a maximum, or what the service asks for."""

    def __init__(self, attempts: int = 5, base: float = 1.0, longest: float = 60.0, jitter: float = 0.25, sleep: Callable[[float], None] = time.sleep):
        self.attempts, self.base, self.longest, self.jitter, self.sleep = attempts, base, longest, jitter, sleep

    def delay(self, attempt: int, asked: str | float | None = None) -> float:
        """Seconds before the next attempt, the first being 1. `asked` is a Retry-After; one that is no number doesn't count."""
        try:
            return min(float(asked), self.longest)
        except (TypeError, ValueError):
            return min(self.base * 2 ** (attempt - 1), self.longest) * (1 + random.uniform(0, self.jitter))

    def call(self, f: Callable[[], list]) -> list:
        for attempt in range(1, self.attempts + 1):
            try:
                return f()
            except Exception as e:
                status = getattr(e, "status_code", None)
                transient = status in RETRYABLE if status is not None else isinstance(e, (TimeoutError, ConnectionError))
                if attempt == self.attempts or not transient:
                    raise
                self.sleep(self.delay(attempt, getattr(e, "headers", None) and e.headers.get("Retry-After")))
        raise AssertionError


def aligned(vectors: list, n: int, width: int | None) -> list:
    """The vectors, if there is one of the right width for each text: a gap would give every later text another's vector."""
    if len(vectors) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} texts")
    if width is not None and (wrong := next((len(v) for v in vectors if len(v) != width), None)) is not None:
        raise ValueError(f"a vector of {wrong} values where the space has {width}")
    return vectors


def embed(rows: DataFrame, backend: Backend, *, text: str = "source_text", name: str = "dense", width: int | None = None, most: int = BATCH, most_tokens: int = BATCH_TOKENS, retry: Retry | None = None) -> DataFrame:
    """The rows with their vectors. Null texts count as empty ones."""
    schema = StructType([*rows.schema.fields, StructField(name, ArrayType(FloatType()))])

    def run(parts):
        again = retry or Retry()
        for part in parts:
            texts = [t or "" for t in part.column(part.schema.names.index(text)).to_pylist()]
            out = []
            for some in batches(texts, most, most_tokens):
                out += aligned(again.call(lambda some=some: backend(some)), len(some), width)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(aligned(out, len(texts), width), pa.list_(pa.float32()))], names=[*part.schema.names, name])

    return rows.mapInArrow(run, schema)


def hashing_backend(width: int) -> Backend:
    """Words hashed to signed places, scaled to length 1: near texts are near, without a model."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * width
            for word in text.lower().split():
                h = int.from_bytes(blake2b(word.encode("utf-8", "replace"), digest_size=8).digest(), "big")
                v[h % width] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return run


def sparse(text) -> Column:
    """Terms of a text with their counts, as the keyword branch indexes them."""
    from .retrieval import tokens

    words = tokens(text)
    return F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("term"), F.size(F.filter(words, lambda x: x == w)).alias("tf")))

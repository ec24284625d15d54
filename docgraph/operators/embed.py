"""Plug points of search: what embeds texts and what ranks passages again.

An embedder is any object with ``dimension`` and ``embed(texts) -> float matrix``;
a scorer is a function from a query and passages to numbers.  Both are called
with Arrow batches inside the executors.  The hashing embedder needs no model:
it is deterministic and serves tests and offline use.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Words and their neighbours hashed to signed places of a unit vector."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            words = re.findall(r"[^\W_]+", text.lower())
            for t in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)


def embed(chunks: DataFrame, embedder: Embedder, key: str = "chunk_id", text: str = "text", at_once: int = 64) -> DataFrame:
    """key, embedding of every chunk; a null text has the vector of an empty one."""
    kind = dict(chunks.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, at_once):
                part = b.slice(at, at_once)
                v = np.asarray(embedder.embed([t or "" for t in part.column(1).to_pylist()]), np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(v), pa.list_(pa.float32()))], [key, "embedding"])

    return chunks.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def rerank(hits: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]], key: str = "chunk_id", text: str = "text", most: int = 512) -> DataFrame:
    """key, score of hits by a scorer that sees the query and each passage's first ``most`` characters."""
    kind = dict(hits.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scorer(query, [(t or "")[:most] for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(x) for x in s], pa.float64())], [key, "score"])

    return hits.select(key, text).mapInArrow(run, f"{key} {kind}, score double")


def overlap(query: str, passages: list[str]) -> list[float]:
    """A scorer without a model: the share of the query's words that a passage has."""
    q = set(re.findall(r"[^\W_]+", query.lower()))
    return [len(q & set(re.findall(r"[^\W_]+", p.lower()))) / max(1, len(q)) for p in passages]

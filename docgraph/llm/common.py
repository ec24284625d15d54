"""Helpers the operators share: tables, columns by position, the shared folder, word hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.storage import shared_path, written

__all__ = ["shared_path", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two_hashes(column: str) -> list[Column]:
    """text_hash and text_hash2: 128 bits, so that texts of a corpus of any size don't meet by chance."""
    return [F.xxhash64(column).alias("text_hash"), F.xxhash64(column, F.lit(1)).alias("text_hash2")]


class Columns:
    """Positional view of a table, so that no name of its extra columns can clash.

    ``df`` has the needed columns as ``_0, _1, ...`` in the order asked for
    and the others after them.  ``restore`` gives the first table's names back
    and appends new columns; a column of the input that bears the name of a
    new one (in any case) is replaced by it.
    """

    def __init__(self, df: DataFrame, needed: Sequence[str]):
        self.names = df.columns
        missing = [n for n in needed if n not in self.names]
        if missing:
            raise ValueError(f"columns {missing} are missing; there are {self.names}")
        first = [self.names.index(n) for n in needed]
        self.order = first + [i for i in range(len(self.names)) if i not in first]
        tmp = df.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.df = tmp.select(*[F.col(f"c{i}").alias(f"_{k}") for k, i in enumerate(self.order)])
        self.needed = list(needed)

    def only(self) -> DataFrame:
        """The needed columns alone, under their own names."""
        return self.df.select(*[F.col(f"_{k}").alias(n) for k, n in enumerate(self.needed)])

    def restore(self, df: DataFrame, **new: Column) -> DataFrame:
        over = {n.lower() for n in new}
        place = {i: k for k, i in enumerate(self.order)}
        old = [F.col(f"_{place[i]}").alias(n) for i, n in enumerate(self.names) if n.lower() not in over]
        return df.select(*old, *[c.alias(n) for n, c in new.items()])


def filtered(df: DataFrame, needed: Sequence[str], keep: Callable[[pa.RecordBatch], Sequence[bool]]) -> DataFrame:
    """The rows of ``df`` that ``keep`` says of a batch whose first columns are the needed ones, as they are."""
    cols = Columns(df, needed)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b), pa.bool_()))

    return cols.restore(cols.df.mapInArrow(some, cols.df.schema))


_LETTER = np.ones(256, bool)
_LETTER[:128] = [chr(i).isalnum() for i in range(128)]
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _need_powers(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        inv = np.uint64(pow(int(_P), -1, 2**64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _P)]), dtype=np.uint64)
            _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inv)]), dtype=np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array on end and the offsets of its rows; a null is an empty row."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of raw[start:end] for every span, all at once.

    It is a polynomial in the bytes modulo 2^64: prefix sums give it for any
    span, whatever its place, and a finaliser spreads its bits.
    """
    _need_powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers[:len(raw)], dtype=np.uint64)])
        return mix64((sums[ends] - sums[starts]) * _inverse[starts] + np.uint64(seed))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of every word and, for each row, the index of its first word (n+1 of them).

    A word is a longest run of ASCII letters and digits and of non-ASCII
    characters within one row.
    """
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _LETTER[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[0::2], edge[1::2]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(raw))])
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    if len(cuts):  # a word that goes over from one row into the next is two words
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def batches_of(batch: pa.RecordBatch, column: str | int, most: int = 4 << 20):
    """Slices of a batch whose texts have about ``most`` bytes, so that arrays beside them stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto

"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Every text becomes tokens: words in lower case, runs of symbols, one token for
a word all in capitals and one for a word that repeats the word before.  Its
single tokens and pairs of neighbours are hashed into ``2**BITS`` buckets.
Two multinomials over the buckets are estimated: of the raw corpus, from every
document, and of trusted documents (label quality 1, toxic 0).  The trusted
one is mixed with ``prior`` parts of the raw one, so that what it never had
doesn't count without bound.  A document's score is the mean over its n-grams
of the log ratio; documents at the threshold or above are kept, every one by
the same threshold, unless they are toxic.

Toxic text may be fluent, so it has a ratio of its own: of each bucket, the
share of toxic documents (label toxic 1, whatever their quality) that have it
against the share of trusted ones, where the toxic documents with it are
``SURE`` standard deviations more than the trusted ones let expect, else 0.  A
document's toxicity is the mean over its n-grams.

Of the labels, up to ``most_labelled`` rows are used, chosen by a hash of their
id.  A second hash puts them in two halves: the trusted documents of one make
the multinomial, the scores of the other set the threshold, as they are not
flattered by having been counted: halfway between the lowest scores of its
trusted documents (quantile ``tail``) and the highest of its documents of
quality 0, or at the former where the two overlap.  The cut of toxicity is set
alike, between the trusted documents (quantile ``toxic_tail`` from above) and
the toxic ones.

The first pass counts (each task sends one row a bucket, at most 2**BITS
however many documents), the second scores, against a broadcast of 2**BITS
weights.  No text moves between executors.  Both work on whole batches of
texts with array operations, not word by word.

Nulls: a null or empty text, or one without any token, has no n-grams: its
score is null and it isn't kept.  Labels without an id or a quality count for
nothing; of repeated labels for one id the highest of each kind counts.
Without trusted documents in both halves every text with tokens is kept;
without toxic ones in the first, none is dropped as toxic.  Repeated rows count each time and score
alike.  An empty table gives an empty result.  Extra columns pass through
``keep_quality``, whatever their names, and are ignored by ``score_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import Columns, batches_of, filtered, mix64, span_hashes, table, text_bytes, word_spans

BITS, PRIOR, TAIL, TOXIC_TAIL, SURE, MOST_LABELLED = 17, 0.05, 0.002, 0.01, 4, 50_000
SCORES = "doc_id bigint, ngrams bigint, score double, keep boolean"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:128] = [not chr(i).isalnum() and chr(i) not in ".," for i in range(33, 128)]
_REPEAT, _CAPITALS = np.uint64(0x51ED270B), np.uint64(0x2545F491)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts' n-grams and the row of each, ordered by row."""
    raw, offsets = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    capital = (raw >= 65) & (raw <= 90)
    lower = np.where(capital, raw + np.uint8(32), raw)
    starts, ends, _ = word_spans(raw, offsets)
    words = span_hashes(lower, starts, ends)
    shout = capital[starts] & capital[ends - 1] & (ends - starts > 1)
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    words[shout] = _CAPITALS
    words[again] = _REPEAT
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _SYMBOL[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    from_, to = edge[0::2], edge[1::2]
    tokens = np.concatenate([words, span_hashes(raw, from_, to, 7)])
    place = np.concatenate([starts, from_])
    order = np.argsort(place, kind="stable")
    tokens, row = tokens[order], np.searchsorted(offsets, place[order], "right") - 1
    mask = np.uint64((1 << bits) - 1)
    with np.errstate(over="ignore"):
        pairs = mix64(tokens[:-1] * np.uint64(3) + tokens[1:])
    same = row[1:] == row[:-1]
    buckets = np.concatenate([mix64(tokens) & mask, pairs[same] & mask]).astype(np.int64)
    rows = np.concatenate([row, row[1:][same]])
    return buckets, rows


def weights(raw: np.ndarray, trusted: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Log ratio of each bucket."""
    if not trusted.sum() or not raw.sum():
        return np.zeros(len(raw), np.float64)
    q = np.maximum(raw, 1) / raw.sum()
    p = (trusted / trusted.sum() + prior * q) / (1 + prior)
    return np.where(raw > 0, np.log(p / q), 0.0)


def toxic_weights(toxic: np.ndarray, clean: np.ndarray, documents: tuple[float, float]) -> np.ndarray:
    """Log ratio of each bucket, from the toxic and the trusted documents with it and how many there are of either."""
    if not min(documents):
        return np.zeros(len(toxic), np.float64)
    due = clean * (documents[0] / documents[1])
    return np.where(toxic - due > SURE * np.sqrt(due + 1), np.log((toxic + 1) / (due + 1)), 0.0)


def all_scores(texts: pa.Array, bits: int, *ws: np.ndarray) -> tuple[np.ndarray, ...]:
    """n-grams of each text and its score (NaN without any) by each of the weights."""
    buckets, rows = features(texts, bits)
    n = np.bincount(rows, minlength=len(texts))
    totals = (np.bincount(rows, w[buckets], minlength=len(texts)) for w in ws)
    return n, *(np.where(n > 0, np.round(total / np.maximum(n, 1), 6), np.nan) for total in totals)


def scores(texts: pa.Array, w: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and score (NaN without any) of each text."""
    return all_scores(texts, bits, w)


def threshold_of(good: np.ndarray, bad: np.ndarray, tail: float = TAIL) -> float:
    if not len(good):
        return -np.inf
    low = float(np.quantile(good, tail, method="lower"))
    high = float(np.quantile(bad, 0.99, method="higher")) if len(bad) else low
    return (low + high) / 2 if high < low else low


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, prior: float = PRIOR, tail: float = TAIL, most_labelled: int = MOST_LABELLED, toxic_tail: float = TOXIC_TAIL) -> tuple[np.ndarray, float, np.ndarray, float]:
    """The buckets' weights and the threshold; their weights for toxicity and the most that is kept."""
    named = Columns(labels, ["doc_id", "quality", "toxic"]).only().filter("doc_id is not null and quality is not null")
    ids = (named.groupBy(F.col("doc_id").try_cast("bigint").alias("id")).agg(F.max("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
           .orderBy(F.xxhash64("id"), "id").limit(most_labelled)
           .select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).alias("half"), (F.col("toxic") == 1).alias("toxic"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality") == 0, 0).otherwise(-1).alias("class")))
    ids = F.broadcast(docs.sparkSession.createDataFrame(ids.toArrow()).filter("class >= 0 or toxic"))  # most_labelled rows at most
    d = Columns(docs, ["doc_id", "text"]).only().withColumn("doc_id", F.col("doc_id").try_cast("bigint"))
    marked = d.join(ids, d["doc_id"] == ids["id"], "left").select("text", F.expr("coalesce(half = 0 and class = 1, false)").alias("trusted"), F.expr("coalesce(half = 0 and toxic, false)").alias("toxic"))
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = np.zeros((4, size + 1), np.int64)  # n-grams: raw, trusted; documents: trusted, toxic; at the end how many documents
        for b in batches:
            for part in batches_of(b, "text"):
                buckets, rows = features(part.column(0), bits)
                all_[0, :size] += np.bincount(buckets, minlength=size)
                for k, column in ((2, 1), (3, 2)):
                    chosen = part.column(column).to_numpy(zero_copy_only=False).astype(bool)
                    own = chosen[rows]
                    if k == 2:
                        all_[1, :size] += np.bincount(buckets[own], minlength=size)
                    once = np.unique(rows[own].astype(np.int64) * size + buckets[own])
                    all_[k, :size] += np.bincount(once % size, minlength=size)
                    all_[k, size] += len(np.unique(once // size))
        some = np.flatnonzero(all_.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(a[some]) for a in all_)], ["bucket", *names])

    names = ["raw", "trusted", "clean", "toxic"]
    counted = marked.mapInArrow(count, "bucket int, " + ", ".join(f"{n} bigint" for n in names)).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    sums = np.zeros((4, size + 1), np.int64)
    sums[:, counted.column("bucket").to_numpy()] = [counted.column(n).to_numpy() for n in names]
    w = weights(sums[0, :size], sums[1, :size], prior)
    v = toxic_weights(sums[3, :size], sums[2, :size], (sums[3, size], sums[2, size]))
    shared = docs.sparkSession.sparkContext.broadcast((w, v))

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in batches_of(b, "text"):
                _, s, x = all_scores(part.column(0), bits, *shared.value)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(s, from_pandas=True), pa.array(x, from_pandas=True)], ["class", "toxic", "score", "toxicity"])

    other = d.join(ids.filter("half = 1"), d["doc_id"] == ids["id"]).select("text", "class", "toxic").mapInArrow(held_out, "class int, toxic boolean, score double, toxicity double").filter("score is not null").toPandas()
    of = lambda rows, column: other[column][rows].to_numpy()
    good, toxic = other["class"] == 1, other["toxic"].astype(bool)
    most = -threshold_of(-of(good, "toxicity"), -of(toxic, "toxicity"), toxic_tail) if v.any() else np.inf
    return w, threshold_of(of(good, "score"), of(other["class"] == 0, "score"), tail), v, most


def _judged(docs: DataFrame, labels: DataFrame, bits: int, **how):
    """A function from texts to n-grams, score and whether it is kept, of each."""
    w, threshold, v, most = fit(docs, labels, bits, **how)
    shared = docs.sparkSession.sparkContext.broadcast((w, v))

    def judge(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, s, x = all_scores(texts, bits, *shared.value)
        return n, s, (s >= threshold) & (x <= most)

    return judge


def score_quality(docs: DataFrame, labels: DataFrame, bits: int = BITS, **how) -> DataFrame:
    """doc_id, number of n-grams, score and whether it is kept, of every document."""
    judge = _judged(docs, labels, bits, **how)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in batches_of(b, "text"):
                n, s, kept = judge(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(s, from_pandas=True), pa.array(kept)], ["doc_id", "ngrams", "score", "keep"])

    return Columns(docs, ["doc_id", "text"]).only().withColumn("doc_id", F.col("doc_id").try_cast("bigint")).mapInArrow(score, SCORES)


def keep_quality(docs: DataFrame, labels: DataFrame, bits: int = BITS, **how) -> DataFrame:
    """The documents that the rules keep, as they are."""
    judge = _judged(docs, labels, bits, **how)

    def keep(b: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, bool), *[judge(part.column(0))[2] for part in batches_of(b, 0)]])

    return filtered(docs, ["text"], keep)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}

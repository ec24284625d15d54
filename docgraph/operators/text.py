"""Keyword and substring search: BM25 over words and over a phrase of characters.

Only a query's terms are counted in each text, inside one scan, whose counts
are written; what is shuffled is one row for a text and term that match, and
one row of corpus statistics is joined by broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.storage import written

K1, B = 1.2, 0.75
WORD = r"([\p{L}\p{N}]+)"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(1))


def query_terms(query: str) -> list[str]:
    """Terms, OR-ed: those of the query, and for an id like ABC-17 its parts and both together."""
    terms = []
    for part in query.split():
        m = re.fullmatch(r"([A-Za-z]+)-(\d+)", part)
        terms += [m[1] + m[2], m[1], m[2]] if m else re.findall(r"[^\W_]+", part)
    return list(dict.fromkeys(t.lower() for t in terms))


def is_id_query(query: str) -> bool:
    parts = query.split()
    return len(parts) <= 2 and any(re.fullmatch(r"[A-Za-z]+-?\d+", p) for p in parts)


def _bm25(tf: str = "tf", dl: str = "dl") -> Column:
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    return -idf * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.col("avgdl")))


def keyword_search(chunks: DataFrame, query: str, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, score of every chunk with one of the query's terms; lower is better."""
    terms = query_terms(query)
    if not terms:
        return chunks.select(key).withColumn("score", F.lit(0.0)).limit(0)
    t = chunks.select(key, words(F.col(text)).alias("w"))
    t = written(t.select(key, F.size("w").alias("dl"), F.array(*[F.struct(F.lit(x).alias("term"), F.size(F.filter("w", _is(x))).alias("tf")) for x in terms]).alias("m")), "words")  # texts are read once
    counted = t.select(key, "dl", F.explode("m").alias("m")).select(key, "dl", "m.term", "m.tf").filter("tf > 0")
    whole = t.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return counted.join(F.broadcast(df), "term").crossJoin(F.broadcast(whole)).groupBy(key).agg(F.sum(_bm25()).alias("score"))


def _is(x: str):
    return lambda y: y == x


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """term, key, tf, dl: which chunks have which words; written once, by term, it spares every later query the texts."""
    t = chunks.select(key, words(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    return t.select(key, "dl", F.explode("w").alias("term")).groupBy("term", key, "dl").agg(F.count(F.lit(1)).alias("tf"))


def trigram_postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """gram, key: which chunks have which three characters. A text's own are told apart before anything is shuffled."""
    kind = dict(chunks.dtypes)[key]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                own = sorted({t[i:i + 3] for i in range(len(t) - 2)}) if t else []
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(own), b.schema.field(0).type), pa.array(own, pa.string())], [key, "gram"])

    return chunks.select(key, F.lower(F.col(text)).alias("low")).mapInArrow(grams, f"{key} {kind}, gram string")


def corpus_facts(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: n and avgdl, in words."""
    return chunks.select(F.size(words(F.col(text))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def posting_search(held: DataFrame, facts: DataFrame, query: str, key: str = "chunk_id") -> DataFrame:
    """keyword_search from postings and corpus facts: only the query's terms are read."""
    hit = held.filter(F.col("term").isin(query_terms(query)))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return hit.join(F.broadcast(df), "term").crossJoin(F.broadcast(facts)).groupBy(key).agg(F.sum(_bm25()).alias("score"))


def trigram_candidates(held: DataFrame, query: str, key: str = "chunk_id") -> DataFrame:
    """The chunks that have all three-character parts of a query; those with the query whole are among them."""
    q = query.lower()
    grams = list(dict.fromkeys(q[i:i + 3] for i in range(len(q) - 2)))
    return held.filter(F.col("gram").isin(grams)).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select(key)


def substring_search(chunks: DataFrame, query: str, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, score of every chunk that has the whole query, whatever the case; queries under 3 characters have no hits."""
    q = query.lower()
    if len(q) < 3:
        return chunks.select(key).withColumn("score", F.lit(0.0)).limit(0)
    low = F.lower(text)
    hits = chunks.select(key, F.length(text).alias("dl"), low.alias("low"))
    tf = ((F.length("low") - F.length(F.replace("low", F.lit(q), F.lit("")))) / len(q)).cast("bigint")
    hits = written(hits.select(key, "dl", F.when(F.col("low").contains(q), tf).alias("tf")), "places")  # texts are read once
    whole = hits.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    found = hits.filter("tf is not null")
    df = found.agg(F.count(F.lit(1)).alias("df"))
    return found.crossJoin(F.broadcast(df)).crossJoin(F.broadcast(whole)).select(key, _bm25().alias("score"))


def top(hits: DataFrame, k: int, key: str = "chunk_id", by: str = "score") -> DataFrame:
    return hits.orderBy(by, key).limit(k)


def changes(old: DataFrame, new: DataFrame, key: str = "chunk_id", text_hash: str = "text_hash") -> DataFrame:
    """key and what became of it between two indexes: new, changed, unchanged or deleted."""
    o, n = old.select(key, F.col(text_hash).alias("a")), new.select(key, F.col(text_hash).alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return o.join(n, key, "full").select(key, state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def snippet(text: Column, term: str, around: int = 40) -> Column:
    """The surroundings of a term's first place, or the head of the text."""
    at = F.locate(term.lower(), F.lower(text))
    begin = F.greatest(F.lit(1), at - around)
    cut = F.when(at > 0, F.substring(text, begin, F.lit(2 * around + len(term)))).otherwise(F.substring(text, 1, 2 * around))
    return F.concat(F.when((at > 0) & (begin > 1), "...").otherwise(""), F.regexp_replace(cut, r"\s+", " "))


def relevance_metrics(ranked: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """P@k, R@k, reciprocal rank and NDCG@k of each query.

    ``ranked``: query, rank (from 1), relevant (0/1) of what was retrieved; ``totals``: query, relevant, how many of all judged items are.
    """
    near = F.col("rank") <= k
    gain = F.col("relevant") / F.log2(F.col("rank") + 1)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.col("total").cast("int")))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    r = ranked.groupBy("query").agg(F.sum(F.when(near, F.col("relevant")).otherwise(0)).alias("hits"), F.min(F.when(F.col("relevant") > 0, F.col("rank"))).alias("first"), F.sum(F.when(near, gain).otherwise(0)).alias("dcg"))
    j = totals.select("query", F.col("relevant").alias("total")).join(r, "query", "left")
    of = lambda n: F.when(F.col("total") > 0, n).otherwise(0.0)
    return j.select("query", (F.coalesce("hits", F.lit(0)) / k).alias("precision"), of(F.coalesce("hits", F.lit(0)) / F.col("total")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), of(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))

"""Hybrid search: three ranked lists joined, objects scored, walked from and ranked again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.operators import graph
from docgraph.operators.text import is_id_query
from docgraph.storage import written

WEIGHTS = {True: (0.3, 0.7, 0.4), False: (0.7, 0.3, 0.2)}


def fuse(dense: DataFrame, words: DataFrame, substring: DataFrame | None, query: str, key: str = "chunk_id") -> DataFrame:
    """key, score. dense: key, distance; the others: key, score (below 0, lower is better).

    Distances and word scores are put between 0 and 1 by their least and
    greatest (each list's are one row, broadcast), substring scores by the
    greatest alone; the query's kind sets the weights.
    """
    wd, ww, ws = WEIGHTS[is_id_query(query)]

    def part(df: DataFrame, value, weight: float, by_range: bool, flip: bool) -> DataFrame:
        d = df.select(key, value.alias("v"))
        ends = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        width = F.when(F.col("hi") != F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
        n = (F.col("v") - F.col("lo")) / width if by_range else F.col("v") / F.when(F.col("hi") != 0, F.col("hi")).otherwise(1.0)
        return d.crossJoin(F.broadcast(ends)).select(key, ((1 - n if flip else n) * weight).alias("score"))

    parts = [part(dense, F.col("distance"), wd, True, True), part(words, F.abs("score"), ww, True, False)]
    if substring is not None:
        parts.append(part(substring, F.abs("score"), ws, False, False))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.sum("score").alias("score"))


def object_scores(scores: DataFrame, chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """object_id, score: an object's best chunk, lifted by the number of its chunks and by their mean."""
    s = scores.join(chunks.select(key, "object_id"), key).groupBy("object_id").agg(F.max("score").alias("m"), F.count(F.lit(1)).alias("n"), F.avg("score").alias("a"))
    mean = F.when(F.col("m") > 0, 0.5 + 0.5 * F.col("a") / F.col("m")).otherwise(1.0)
    return s.select("object_id", (F.col("m") * (1 + 0.1 * F.ln(1 + F.col("n"))) * mean).alias("score"))


def without_namespaces(scores: DataFrame, objects: DataFrame, hidden: list[str]) -> DataFrame:
    """Scores of objects whose namespace isn't hidden, nor their file below a folder of that name."""
    o = objects.filter(~F.coalesce(F.col("namespace"), F.lit("")).isin(hidden) & ~F.split(F.coalesce("file", F.lit("")), "/")[0].isin(hidden))
    return scores.join(o.select("object_id"), "object_id", "left_semi")


def expand(scores: DataFrame, edges: DataFrame, distances: DataFrame, top_k: int, depth: int = 2) -> DataFrame:
    """object_id, score of the objects within ``depth`` hops, either way, of the best top_k // 2.

    What was found keeps its score; what the walk adds gets 0.8 times its
    likeness to the query (distances: object_id, distance), and the greater counts.
    Hits that the walk doesn't reach are left out.
    """
    scores = written(scores, "scores")  # read by the walk and by the end
    seeds = scores.orderBy(F.desc("score"), "object_id").limit(max(1, top_k // 2)).select(F.col("object_id").alias("id"))
    e = edges.select("source_id", "target_id")
    reached = graph.walk(seeds, graph.steps(e, "both"), depth).select(F.col("id").alias("object_id"))
    near = distances.groupBy("object_id").agg(F.min("distance").alias("distance"))
    again = reached.join(near, "object_id", "left").select("object_id", (F.greatest(F.lit(0.0), 1 - F.col("distance")) * 0.8).alias("score"))
    found = scores.join(reached, "object_id", "left_semi")
    return found.unionByName(again.filter("score is not null")).groupBy("object_id").agg(F.max("score").alias("score"))


def search(chunks: DataFrame, dense: DataFrame, words: DataFrame, substring: DataFrame, edges: DataFrame, distances: DataFrame, query: str, top_k: int = 10, depth: int = 2) -> DataFrame:
    """object_id, score, snippet chunk of the top_k objects."""
    scores = object_scores(fuse(dense, words, substring, query), chunks)
    ranked = expand(scores, edges, distances, top_k, depth) if depth > 0 else scores
    best = ranked.orderBy(F.desc(F.round("score", 9)), "object_id").limit(top_k)
    longest = chunks.join(F.broadcast(best.select("object_id")), "object_id", "left_semi").groupBy("object_id").agg(F.max_by("chunk_id", F.struct(F.length("text"), "chunk_id")).alias("chunk_id"))
    return best.join(longest, "object_id", "left")

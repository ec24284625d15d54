"""Queries of chunking, keyword, vector and hybrid search over the test tables.

Chunks are documents; chunk c belongs to object c % 100 and has the vector with its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.operators import fusion, graph, text, vector

WORDS, PART, ID = "was und the", "reening", "ABC-17 the"


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 100).alias("object_id"), "text")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet")


def _query(s: SparkSession, d: str) -> list:
    """The vector that stands for the query's text."""
    return [(r[0], list(r[1])) for r in _vectors(s, d).filter("vec_id = 0").select("vec_id", "embedding").collect()]


def _links(s: SparkSession) -> DataFrame:
    return s.range(100).select(F.col("id").alias("source_id"), ((F.col("id") * 3 + 1) % 100).alias("target_id"))


def _dense(s: SparkSession, d: str) -> DataFrame:
    return vector.knn(_vectors(s, d), _query(s, d), 20).select(F.col("vec_id").alias("chunk_id"), "distance")


def _fused(s: SparkSession, d: str, query: str) -> DataFrame:
    c = _chunks(s, d)
    return fusion.fuse(_dense(s, d), text.top(text.keyword_search(c, query), 20), text.top(text.substring_search(c, PART), 20), query)


def _objects(s: SparkSession, d: str) -> DataFrame:
    return fusion.object_scores(_fused(s, d, WORDS), _chunks(s, d))


def _distances(s: SparkSession, d: str) -> DataFrame:
    return vector.distances(_vectors(s, d), _query(s, d)[0][1]).select((F.col("vec_id") % 100).alias("object_id"), "distance")


def _found(s: SparkSession, d: str) -> DataFrame:
    c = _chunks(s, d)
    return fusion.search(c, _dense(s, d), text.top(text.keyword_search(c, WORDS), 20), text.top(text.substring_search(c, PART), 20), _links(s), _distances(s, d), WORDS)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _edges50(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select(F.col("vec_id").alias("source_id"), ((F.col("vec_id") * 7 + 3) % 500).alias("target_id"))


def _ranked(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d)
    hits = vector.knn_all(v, 10)
    label = v.select("vec_id", "label")
    own = v.select(F.col("vec_id").alias("query"), F.col("label").alias("wanted"))
    return hits.join(label, "vec_id").join(own, "query").select("query", "rank", (F.col("label") == F.col("wanted")).cast("int").alias("relevant"))


def _totals(s: SparkSession, d: str) -> DataFrame:
    """How many others have each vector's label."""
    v = _vectors(s, d)
    n = v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("relevant"))
    return v.join(n, "label").select(F.col("vec_id").alias("query"), "relevant")


def _groups(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select(F.col("vec_id").alias("id"), F.col("label").alias("group"))


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = _chunks(s, d).select("chunk_id", F.substring(F.sha2("text", 256), 1, 16).alias("text_hash"))
    return h.filter("chunk_id % 10 <> 0"), h.filter("chunk_id % 10 <> 1").withColumn("text_hash", F.when(F.col("chunk_id") % 10 == 2, F.reverse("text_hash")).otherwise(F.col("text_hash")))


def _lines(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return p.select(F.concat_ws(":", "doc_id", "n").alias("chunk_id"), F.col("doc_id").alias("object_id"), "line", F.when(F.length("line") >= 50, "child").otherwise("combined").alias("chunk_type"))


QUERIES = {
    "c_chunk_lines": _lines,
    "c_combined_vs_child": lambda s, d: _lines(s, d).groupBy("object_id", "chunk_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("chars")),
    "c_diff_hash": lambda s, d: text.changes(*_two(s, d)),
    "c_upsert": lambda s, d: text.upsert(*_two(s, d)),
    "f_bm25": lambda s, d: _rounded(text.keyword_search(_chunks(s, d), WORDS), "score"),
    "f_trigram": lambda s, d: _rounded(text.substring_search(_chunks(s, d), PART), "score"),
    "f_knn_cosine": lambda s, d: _rounded(vector.knn_all(_vectors(s, d), 10), "distance"),
    "f_fusion_semantic": lambda s, d: _rounded(_fused(s, d, WORDS), "score"),
    "f_fusion_id": lambda s, d: _rounded(_fused(s, d, ID), "score"),
    "f_group_by_object": lambda s, d: _rounded(_objects(s, d), "score"),
    "f_graph_walk": lambda s, d: graph.walk(s.createDataFrame([(5,), (17,)], "id bigint"), graph.steps(_links(s), "both"), 2),
    "f_rerank": lambda s, d: _rounded(fusion.expand(_objects(s, d), _links(s), _distances(s, d), 10), "score"),
    "f_search": lambda s, d: _rounded(_found(s, d), "score"),
    "f_exclude_namespaces": lambda s, d: _rounded(fusion.without_namespaces(_objects(s, d), s.range(100).select(F.col("id").alias("object_id"), F.when(F.col("id") % 2 == 0, "even").alias("namespace"), F.concat(F.col("id") % 5, F.lit("/f.md")).alias("file")), ["even", "3"]), "score"),
    "f_inferred_edges": lambda s, d: _rounded(vector.inferred_edges(_vectors(s, d), 0.2, 50), "similarity"),
    "f_hints": lambda s, d: vector.hints(_vectors(s, d), _groups(s, d), _edges50(s, d).select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), 0.2),
    "f_inferred_default": lambda s, d: _rounded(vector.inferred_edges(_vectors(s, d)), "similarity"),
    "f_bm25_postings": lambda s, d: _rounded(text.posting_search(text.postings(_chunks(s, d)), text.corpus_facts(_chunks(s, d)), WORDS), "score"),
    "f_trigram_postings": lambda s, d: text.trigram_candidates(text.trigram_postings(_chunks(s, d)), PART).join(_chunks(s, d), "chunk_id").filter(F.lower("text").contains(PART)).select("chunk_id"),
    "f_representatives": lambda s, d: vector.representatives(_chunks(s, d), _vectors(s, d).withColumnRenamed("vec_id", "chunk_id")).select("object_id", F.format_string("%.4f", F.element_at("embedding", 1).cast("double")).alias("head")),
    "f_audit_suspicious": lambda s, d: _rounded(vector.suspicious_edges(_edges50(s, d), _vectors(s, d), 0.0), "similarity"),
    "f_audit_missing": lambda s, d: _rounded(vector.missing_edges(vector.inferred_edges(_vectors(s, d), 0.2, 50), _edges50(s, d), 0.3, _vectors(s, d).select(F.col("vec_id").alias("id"), F.col("label").alias("group"))), "similarity"),
    "f_object_vectors": lambda s, d: vector.object_vectors(_vectors(s, d), "label").select("label", F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", x)), ",").alias("head")),
    "f_metrics_mrr_ndcg": lambda s, d: _rounded(text.relevance_metrics(_ranked(s, d), _totals(s, d), 10), "precision", "recall", "mrr", "ndcg"),
    "f_snippet": lambda s, d: _chunks(s, d).select("chunk_id", text.snippet(F.col("text"), PART).alias("snippet")),
}

_W = "regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)"
_IDF = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"
_BM = f"-{_IDF} * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"


def _bm(name: str, terms: list[str]) -> str:
    each = " UNION ALL ".join(f"SELECT chunk_id, '{t}' AS term, len(list_filter(w, lambda x: x = '{t}')) AS tf, len(w) AS dl FROM tok" for t in terms)
    return f"""tok AS (SELECT doc_id AS chunk_id, {_W} AS w FROM documents), {name}_m AS (SELECT * FROM ({each}) WHERE tf > 0), whole AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
    {name}_df AS (SELECT term, count(*) AS df FROM {name}_m GROUP BY 1), {name} AS (SELECT chunk_id, sum({_BM}) AS score FROM {name}_m JOIN {name}_df USING (term), whole GROUP BY 1)"""


_TRI = f"""sub_m AS (SELECT doc_id AS chunk_id, (length(lower(text)) - length(replace(lower(text), '{PART}', ''))) // {len(PART)} AS tf, length(text) AS dl FROM documents WHERE contains(lower(text), '{PART}')),
  sub AS (SELECT chunk_id, {_BM} AS score FROM sub_m, (SELECT count(*) AS df FROM sub_m), (SELECT count(*) AS n, avg(length(text)) AS avgdl FROM documents))"""
_KNN = """vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
  near AS (SELECT q.vec_id AS query, x.vec_id, round(1 - list_dot_product(q.v, x.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(x.v, x.v)), 12) AS distance FROM vec q, vec x WHERE {which})"""


def _fuse(terms: list[str], wd: float, ww: float, ws: float) -> str:
    return f"""{_bm('kw', terms)}, {_TRI}, {_KNN.format(which='q.vec_id = 0')},
  dense AS (SELECT vec_id AS chunk_id, distance FROM near ORDER BY distance, vec_id LIMIT 20), k20 AS (SELECT * FROM kw ORDER BY score, chunk_id LIMIT 20), s20 AS (SELECT * FROM sub ORDER BY score, chunk_id LIMIT 20),
  parts AS (SELECT chunk_id, {wd} * (1 - (distance - lo) / CASE WHEN hi <> lo THEN hi - lo ELSE 1 END) AS score FROM dense, (SELECT min(distance) AS lo, max(distance) AS hi FROM dense)
    UNION ALL SELECT chunk_id, {ww} * (abs(score) - lo) / CASE WHEN hi <> lo THEN hi - lo ELSE 1 END FROM k20, (SELECT min(abs(score)) AS lo, max(abs(score)) AS hi FROM k20)
    UNION ALL SELECT chunk_id, {ws} * abs(score) / hi FROM s20, (SELECT max(abs(score)) AS hi FROM s20)),
  fused AS (SELECT chunk_id, sum(score) AS score FROM parts GROUP BY 1),
  obj AS (SELECT object_id, m * (1 + 0.1 * ln(1 + n)) * CASE WHEN m > 0 THEN 0.5 + 0.5 * a / m ELSE 1 END AS score FROM (SELECT chunk_id % 100 AS object_id, max(score) AS m, count(*) AS n, avg(score) AS a FROM fused WHERE chunk_id IN (SELECT doc_id FROM documents) GROUP BY 1))"""


_SEM = _fuse(["was", "und", "the"], 0.7, 0.3, 0.2)
_HOP = "hop AS (SELECT range AS a, (range * 3 + 1) % 100 AS b FROM range(100) UNION SELECT (range * 3 + 1) % 100, range FROM range(100))"
_WALK = f"""{_HOP}, seeds AS (SELECT object_id AS id FROM obj ORDER BY score DESC, object_id LIMIT 5),
  walk(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT b, depth + 1 FROM walk JOIN hop ON a = id WHERE depth < 2), reached AS (SELECT DISTINCT id AS object_id FROM walk),
  again AS (SELECT object_id, 0.8 * greatest(0, 1 - min(distance)) AS score FROM reached JOIN near ON near.vec_id % 100 = object_id GROUP BY 1),
  ranked AS (SELECT object_id, max(score) AS score FROM (SELECT * FROM obj WHERE object_id IN (SELECT object_id FROM reached) UNION ALL SELECT * FROM again) GROUP BY 1)"""
_PAIRS = """vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb,
  list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) AS similarity FROM vec a, vec b WHERE a.vec_id <> b.vec_id),
  links AS (SELECT vec_id AS source_id, (vec_id * 7 + 3) % 500 AS target_id FROM embeddings)"""
_INF = """inferred AS (SELECT least(a, b) AS source_id, greatest(a, b) AS target_id, max(similarity) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(similarity, 9) DESC, b) AS r FROM pairs WHERE similarity > 0.2) WHERE r <= 50 GROUP BY 1, 2)"""
_H = "(SELECT doc_id AS chunk_id, substr(sha256(text), 1, 16) AS text_hash FROM documents)"
_L = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)"
ORACLE_SQL = {
    "c_chunk_lines": f"SELECT doc_id || ':' || n AS chunk_id, doc_id AS object_id, line, CASE WHEN length(line) >= 50 THEN 'child' ELSE 'combined' END AS chunk_type FROM {_L}",
    "c_combined_vs_child": f"SELECT doc_id AS object_id, CASE WHEN length(line) >= 50 THEN 'child' ELSE 'combined' END AS chunk_type, count(*) AS n, sum(length(line))::BIGINT AS chars FROM {_L} GROUP BY 1, 2",
    "c_diff_hash": f"SELECT chunk_id, CASE chunk_id % 10 WHEN 0 THEN 'new' WHEN 1 THEN 'deleted' WHEN 2 THEN CASE WHEN text_hash = reverse(text_hash) THEN 'unchanged' ELSE 'changed' END ELSE 'unchanged' END AS state FROM {_H}",
    "c_upsert": f"SELECT chunk_id, CASE WHEN chunk_id % 10 = 2 THEN reverse(text_hash) ELSE text_hash END AS text_hash FROM {_H}",
    "f_bm25": f"WITH {_bm('kw', ['was', 'und', 'the'])} SELECT chunk_id, round(score, 6) AS score FROM kw",
    "f_trigram": f"WITH {_TRI} SELECT chunk_id, round(score, 6) AS score FROM sub",
    "f_knn_cosine": f"WITH {_KNN.format(which='q.vec_id <> x.vec_id')} SELECT query, vec_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS rank FROM near QUALIFY rank <= 10",
    "f_fusion_semantic": f"WITH {_SEM} SELECT chunk_id, round(score, 6) AS score FROM fused",
    "f_fusion_id": f"WITH {_fuse(['abc17', 'abc', '17', 'the'], 0.3, 0.7, 0.4)} SELECT chunk_id, round(score, 6) AS score FROM fused",
    "f_group_by_object": f"WITH {_SEM} SELECT object_id, round(score, 6) AS score FROM obj",
    "f_graph_walk": f"WITH RECURSIVE {_HOP}, walk(id, depth) AS (SELECT unnest([5, 17])::BIGINT, 0 UNION SELECT b, depth + 1 FROM walk JOIN hop ON a = id WHERE depth < 2) SELECT id, min(depth) AS depth FROM walk GROUP BY 1",
    "f_rerank": f"WITH RECURSIVE {_SEM}, {_WALK} SELECT object_id, round(score, 6) AS score FROM ranked",
    "f_search": f"WITH RECURSIVE {_SEM}, {_WALK}, best AS (SELECT object_id, score FROM ranked ORDER BY round(score, 9) DESC, object_id LIMIT 10) SELECT object_id, round(score, 6) AS score, (SELECT arg_max(doc_id, (length(text), doc_id)) FROM documents WHERE doc_id % 100 = object_id) AS chunk_id FROM best",
    "f_exclude_namespaces": f"WITH {_SEM} SELECT object_id, round(score, 6) AS score FROM obj WHERE object_id % 2 <> 0 AND object_id % 5 <> 3",
    "f_inferred_edges": f"WITH {_PAIRS}, {_INF} SELECT source_id, target_id, round(similarity, 6) AS similarity FROM inferred",
    "f_hints": f"WITH {_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(similarity, 9) DESC, b) AS k FROM pairs WHERE similarity > 0.2), f AS (SELECT * FROM k WHERE k <= 20 AND la <> lb AND NOT EXISTS (SELECT 1 FROM links WHERE source_id = a AND target_id = b) QUALIFY row_number() OVER (PARTITION BY a, lb ORDER BY round(similarity, 9) DESC, b) = 1) "
               "SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(similarity, 9) DESC, b) AS place, round(similarity, 3) AS similarity FROM f QUALIFY place <= 3",
    "f_audit_suspicious": f"WITH {_PAIRS} SELECT source_id, target_id, round(similarity, 6) AS similarity FROM links JOIN pairs ON a = source_id AND b = target_id WHERE similarity < 0",
    "f_audit_missing": f"WITH {_PAIRS}, {_INF} SELECT i.source_id, i.target_id, round(i.similarity, 6) AS similarity FROM inferred i JOIN pairs p ON p.a = i.source_id AND p.b = i.target_id WHERE i.similarity > 0.3 AND la <> lb AND NOT EXISTS (SELECT 1 FROM links l WHERE least(l.source_id, l.target_id) = i.source_id AND greatest(l.source_id, l.target_id) = i.target_id)",
    "f_object_vectors": "SELECT label, string_agg(printf('%.4f', m), ',' ORDER BY i) AS head FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1",
    "f_metrics_mrr_ndcg": f"WITH {_KNN.format(which='q.vec_id <> x.vec_id')}, r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY distance, near.vec_id) AS rank, CASE WHEN x.label = q.label THEN 1 ELSE 0 END AS relevant FROM near JOIN vec x ON x.vec_id = near.vec_id JOIN vec q ON q.vec_id = query), "
                          "t AS (SELECT query, sum(relevant) AS total FROM r GROUP BY 1), i AS (SELECT query, sum(1 / log2(n + 1)) AS ideal FROM t, (SELECT unnest(range(1, 11)) AS n) WHERE n <= total GROUP BY 1) "
                          "SELECT r.query, round(sum(CASE WHEN rank <= 10 THEN relevant ELSE 0 END) / 10, 6) AS precision, round(sum(CASE WHEN rank <= 10 THEN relevant ELSE 0 END) / greatest(any_value(total), 1), 6) AS recall, round(coalesce(1 / min(CASE WHEN relevant > 0 AND rank <= 10 THEN rank END), 0), 6) AS mrr, "
                          "round(coalesce(sum(CASE WHEN rank <= 10 THEN relevant / log2(rank + 1) ELSE 0 END) / any_value(ideal), 0), 6) AS ndcg FROM r JOIN t USING (query) LEFT JOIN i USING (query) GROUP BY 1",
    "f_inferred_default": f"WITH {_PAIRS}, {_INF.replace('similarity > 0.2', 'round(similarity, 9) >= 0.7')} SELECT source_id, target_id, round(similarity, 6) AS similarity FROM inferred",
    "f_bm25_postings": f"WITH {_bm('kw', ['was', 'und', 'the'])} SELECT chunk_id, round(score, 6) AS score FROM kw",
    "f_trigram_postings": f"SELECT doc_id AS chunk_id FROM documents WHERE contains(lower(text), '{PART}')",
    "f_representatives": "SELECT doc_id % 100 AS object_id, printf('%.4f', arg_min(embedding[1]::DOUBLE, doc_id)) AS head FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY 1",
    "f_snippet": f"WITH a AS (SELECT doc_id, text, strpos(lower(text), '{PART}') AS pos FROM documents) SELECT doc_id AS chunk_id, CASE WHEN pos - 40 > 1 THEN '...' ELSE '' END || regexp_replace(CASE WHEN pos > 0 THEN substr(text, greatest(1, pos - 40), {80 + len(PART)}) ELSE substr(text, 1, 80) END, '\\s+', ' ', 'g') AS snippet FROM a",
}

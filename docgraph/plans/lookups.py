"""Queries of lookup, references in data, diagnostics, trees and names over the test tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.functions import text as names
from docgraph.operators import identity, lookup, validation
from docgraph.plans.linking import _REFS, _RESOLVED, _edges, _obj, _refs, _with
from docgraph.plans.model import duck
from docgraph.sources import load

REFS = ("nation_3", "[[#EUROPE:nope]]", "ghost", "nation_7", "region_2", "part_5")


def _dotted(s: SparkSession, d: str) -> DataFrame:
    """Every object once more, below the object that is its parent, by a dotted id; some parents aren't there."""
    o = _obj(s, d)
    return o.unionByName(o.filter("__parent is not null").withColumn("__id", F.concat("__parent", F.lit("."), "__id")).withColumn("__global_id", F.concat("__global_id", F.lit("!"))))


def _dotted_refs(s: SparkSession, d: str) -> DataFrame:
    return _obj(s, d).select("__workspace", "__namespace", "__id", F.concat("__id", F.lit(".name")).alias("raw"))


def _with_named(s: SparkSession, d: str) -> DataFrame:
    o = _obj(s, d)
    return o.unionByName(o.filter("__line % 2 = 0").withColumn("__id", F.concat("__id", F.lit(".name"))))


def _located(s: SparkSession, d: str) -> DataFrame:
    o = _obj(s, d)
    return functools.reduce(DataFrame.unionByName, [lookup.locate(o, r).withColumn("ref", F.lit(r)) for r in REFS])


def _kind_refs(s: SparkSession, d: str) -> DataFrame:
    """Each customer refers to its nation: plainly, by kind, by a wrong kind, by namespace or to nothing."""
    c = _obj(s, d).filter("__kind = 'Customer'")
    k = F.col("__line") % 5
    return c.select("__workspace", "__namespace", "__id", F.when(k == 0, F.col("__parent")).when(k == 1, F.concat(F.lit("Nation:"), "__parent")).when(k == 2, F.concat(F.lit("Part:"), "__parent"))
                    .when(k == 3, F.concat(F.lower("__namespace"), F.lit(":"), "__id")).otherwise(F.lit("nobody")).alias("raw"))


def _local_twice(s: SparkSession, d: str) -> DataFrame:
    return _obj(s, d).withColumns({"__local_id": F.concat(F.lit("n"), F.col("__line") % 50), "__id": F.concat(F.lit("o_"), "__id")})


def _local_refs(s: SparkSession, d: str) -> DataFrame:
    return _obj(s, d).select("__workspace", "__namespace", "__id", F.concat(F.lit("n"), F.col("__line") % 60).alias("raw"))


def _site_hints(s: SparkSession, d: str) -> DataFrame:
    o = _obj(s, d).filter("__level = 2")
    return o.select(F.col("__global_id").alias("key"), "__label").unionByName(o.select(F.concat(F.lit("field:region@"), "__file").alias("key"), "__label"))


QUERIES = {
    "l_data_refs": lambda s, d: identity.data_references(_obj(s, d)),
    "l_data_edges": lambda s, d: identity.edges_of_data(_obj(s, d)),
    "l_dot_parent": lambda s, d: validation.dotted_parents(_dotted(s, d)),
    "l_index": lambda s, d: load.index(_obj(s, d)).groupBy("index", "key").agg(F.count(F.lit(1)).alias("n")),
    "l_resync": lambda s, d: load.replace_files(_obj(s, d), _obj(s, d).filter("__file = 'part/3.md' and __line % 2 = 0").withColumn("__label", F.lit("new"))).select("__global_id", "__label"),
    "v_ambiguous_field": lambda s, d: validation.ambiguous_fields(_dotted_refs(s, d), _with_named(s, d)),
    "v_ambiguous_locals": lambda s, d: validation.ambiguous_locals(_local_refs(s, d), _local_twice(s, d)),
    "v_validate": lambda s, d: validation.diagnostics(_refs(s, d), _obj(s, d)),
    "v_resolve_reference": lambda s, d: validation.candidates_of(_kind_refs(s, d), _obj(s, d)),
    "g_locate": _located,
    "g_describe_fields": lambda s, d: lookup.field_types(_obj(s, d)),
    "g_outline": lambda s, d: lookup.outline(_obj(s, d), "nation/3.md").select("id", "name", "symbol", "parent"),
    "g_symbols": lambda s, d: lookup.symbols(_obj(s, d), "nAtion_1"),
    "g_complete_ids": lambda s, d: lookup.complete_ids(_obj(s, d)),
    "g_complete_kinds": lambda s, d: lookup.complete_kinds(_obj(s, d)),
    "g_by_kind": lambda s, d: lookup.by_kind(_obj(s, d)),
    "g_tree_namespace": lambda s, d: lookup.namespace_tree(_obj(s, d)),
    "g_tree_file": lambda s, d: lookup.file_tree(_obj(s, d)),
    "g_nodes": lambda s, d: load.nodes(_obj(s, d)),
    "g_rename_edits": lambda s, d: lookup.rename_edits(_refs(s, d).select(F.col("__id").alias("file"), F.lit(1).cast("bigint").alias("line"), "raw"), _obj(s, d), "nation_7", "country_7"),
    "p_link_targets": lambda s, d: lookup.link_targets(_kind_refs(s, d).select(identity.global_id(F.col("__workspace"), F.col("__namespace"), F.col("__id")).alias("source_id"), "raw"), _edges(s, d), _obj(s, d)),
    "p_page_hints": lambda s, d: lookup.page_hints(_site_hints(s, d), _obj(s, d), "nation/3.md"),
    "q_text_utils": lambda s, d: _obj(s, d).select("__global_id", names.snake_case(F.col("__label")).alias("snake"), names.slug(F.concat(F.lit("## **"), "__label", F.lit("** (x):"))).alias("slug"), names.title_of(F.col("__file"), ".md").alias("title")),
}
_FIELD_TYPE = "CASE json_type(data, '$.' || k) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN CASE WHEN contains(json_extract_string(data, '$.' || k), '[[#') THEN 'reference' ELSE 'string' END ELSE 'number' END"
_DATA = """d AS (SELECT __workspace, __namespace, __id, k AS source_field, unnest(regexp_extract_all(json_extract_string(data, '$.' || k), '\\[\\[#([^\\]]+)\\]\\]', 1)) AS raw, k AS edge_type FROM (SELECT *, unnest(json_keys(data)) AS k FROM objects))"""
_KREFS = """kr AS (SELECT __workspace, __namespace, __id, __global_id, CASE __line % 5 WHEN 0 THEN __parent WHEN 1 THEN 'Nation:' || __parent WHEN 2 THEN 'Part:' || __parent WHEN 3 THEN lower(__namespace) || ':' || __id ELSE 'nobody' END AS raw, __line % 5 AS c, __parent FROM objects WHERE __kind = 'Customer')"""
ORACLE_SQL = {
    "l_data_refs": duck(f"WITH {_DATA} SELECT * FROM d", "objects"),
    "l_data_edges": duck(f"WITH {_DATA} SELECT DISTINCT d.__workspace || ':' || d.__namespace || ':' || d.__id AS source_id, source_field, o.__global_id AS target_id, edge_type, '' AS target_field, d.__workspace FROM d JOIN objects o ON o.__id = raw AND o.__workspace = d.__workspace", "objects"),
    "l_dot_parent": duck("SELECT __global_id || '!' AS __global_id, o.__parent AS prefix, (SELECT min(p.__global_id) FROM objects p WHERE p.__id = o.__parent AND p.__workspace = o.__workspace) AS parent_id FROM objects o WHERE __parent IS NOT NULL"),
    "l_index": duck("SELECT 'by_' || i AS \"index\", key, count(*) AS n FROM (SELECT unnest(['id', 'local_id', 'kind', 'file', 'namespace']) AS i, unnest([__id, __local_id, __kind, __file, __namespace]) AS key FROM objects) WHERE key IS NOT NULL AND key <> '' GROUP BY 1, 2"),
    "l_resync": duck("SELECT __global_id, CASE WHEN __file = 'part/3.md' THEN 'new' ELSE __label END AS __label FROM objects WHERE __file <> 'part/3.md' OR __line % 2 = 0"),
    "v_ambiguous_field": duck("SELECT __workspace, __namespace, __id, __id || '.name' AS raw FROM objects WHERE __line % 2 = 0 AND list_contains(json_keys(data), 'name')"),
    "v_ambiguous_locals": duck("SELECT r.__workspace, r.__namespace, r.__id, 'n' || r.__line % 60 AS raw, c.candidates FROM objects r JOIN (SELECT __workspace, __namespace, 'n' || __line % 50 AS l, count(*) AS candidates FROM objects GROUP BY 1, 2, 3 HAVING count(*) > 1) c ON c.l = 'n' || r.__line % 60 AND c.__workspace = r.__workspace AND c.__namespace = r.__namespace", "objects"),
    "v_validate": _with("SELECT r.__workspace, r.__namespace, r.__id, source_field, raw, edge_type, 'REF001' AS code, 'error' AS severity, 'broken reference [[#' || raw || ']]' || coalesce((SELECT '. Did you mean ' || min('[[#' || o.__namespace || ':' || o.__id || ']]') || '?' FROM objects o WHERE o.__local_id = regexp_extract(raw, '([^.:]*)$', 1) AND o.__namespace <> ''), '') AS message FROM resolved r WHERE target_id IS NULL", _REFS, _RESOLVED),
    "v_resolve_reference": duck(f"WITH {_KREFS} SELECT __workspace, __namespace, __id, raw, CASE WHEN c IN (0, 1) THEN 'resolved' ELSE 'broken' END AS state, CASE WHEN c IN (0, 1) THEN 1 ELSE 0 END AS candidates, CASE WHEN c IN (0, 1) THEN (SELECT min(o.__global_id) FROM objects o WHERE o.__id = kr.__parent) END AS first FROM kr", "objects"),
    "g_locate": duck("SELECT __file AS file, __line AS line, __id AS id, __kind AS kind, __namespace AS namespace, __id AS ref FROM objects WHERE __id IN ('nation_3', 'nation_7', 'region_2', 'part_5')"),
    "g_describe_fields": duck(f"SELECT __global_id, k AS field, {_FIELD_TYPE} AS type FROM (SELECT *, unnest(json_keys(data)) AS k FROM objects)"),
    "g_outline": duck("SELECT __id AS id, __label AS name, 'Class' AS symbol, CAST(NULL AS STRING) AS parent FROM objects WHERE __file = 'nation/3.md'"),
    "g_symbols": duck("SELECT __label AS name, __global_id, 'Class' AS symbol, __file, __line FROM objects WHERE contains(lower(__id), 'nation_1') OR contains(lower(__label), 'nation_1') ORDER BY __label, __global_id LIMIT 100"),
    "g_complete_ids": duck("SELECT __id, __kind, __label FROM objects"),
    "g_complete_kinds": duck("SELECT DISTINCT __kind FROM objects UNION SELECT '__Object'"),
    "g_by_kind": duck("SELECT __kind, __file, count(*) AS n, string_agg(__id, ',' ORDER BY __id) AS ids FROM objects GROUP BY 1, 2"),
    "g_tree_namespace": duck("SELECT __workspace, __namespace, __kind, count(*) AS n, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM objects p WHERE p.__id = o.__parent)) AS top FROM objects o GROUP BY 1, 2, 3"),
    "g_tree_file": duck("SELECT __workspace, __file, count(*) AS n, string_agg(DISTINCT __kind, ',' ORDER BY __kind) AS kinds, arg_min(__label, (__level, __line, __id)) AS label FROM objects GROUP BY 1, 2"),
    "g_nodes": duck("SELECT __id AS id, __kind AS kind, coalesce(json_extract_string(data, '$.name'), __id) AS label FROM objects"),
    "g_rename_edits": _with("SELECT __file AS file, __line AS line, 'definition' AS what, __id AS old_text, 'country_7' AS new_text FROM objects WHERE __id = 'nation_7' UNION ALL SELECT DISTINCT __id, 1, 'reference', raw, replace(raw, 'nation_7', 'country_7') FROM refs WHERE split_part(raw, ':', -1) = 'nation_7' OR starts_with(split_part(raw, ':', -1), 'nation_7.')", _REFS),
    "p_link_targets": duck(f"WITH {_KREFS} SELECT kr.__global_id AS source_id, raw, t.__global_id AS target_id, t.__file AS file FROM kr LEFT JOIN objects t ON t.__id = split_part(raw, ':', -1)", "objects"),
    "p_page_hints": duck("SELECT __global_id AS key, __label, CAST(NULL AS STRING) AS field FROM objects WHERE __file = 'nation/3.md' UNION ALL SELECT 'field:region@' || __file, __label, 'region' FROM objects WHERE __level = 2 AND __file = 'nation/3.md'"),
    "q_text_utils": duck("SELECT __global_id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(__label, '[^\\w\\s-]', '', 'g'), '[\\s-]+', '_', 'g')), '^_+', ''), '_+$', '') AS snake, "
                         "substr(trim(regexp_replace(lower(regexp_replace(__label, '[#*`]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_'), 1, 40) AS slug, split_part(split_part(__file, '/', 2), '.md', 1) AS title FROM objects"),
}

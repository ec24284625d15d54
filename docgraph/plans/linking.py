"""Queries of resolution, validation and graph walks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.operators import graph, identity, validation
from docgraph.plans.model import duck, relation

START, WORKSPACE = "ASIA::region_2", "ASIA"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "texts")


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.extract_references(_texts(spark, sf_dir), "body", "body", "__workspace", "__namespace", "__id")


def _obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "objects")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, "edges")


def _starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(START,)], "id string")


def _loaded_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obj(spark, sf_dir)
    again = o.filter("__line % 3 = 0").withColumns({"__label": F.concat(F.lit("new "), "__label"), "__file": F.lit("later.md")})
    return identity.last_writer(o.withColumn("ordinal", F.lit(0)).unionByName(again.withColumn("ordinal", F.lit(1)))).select("__global_id", "__label", "__file")


def _doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _obj(spark, sf_dir)
    return o.unionByName(o.filter("__line % 5 = 0").withColumn("__file", F.lit("copy.md")))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _obj(spark, sf_dir).filter("not (__kind = 'Customer' and __line % 4 = 0)")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object in one workspace, with ids cut to their number, so that many are alike."""
    return _obj(spark, sf_dir).withColumns({"__id": F.concat(F.lit("x"), F.col("__line")), "__workspace": F.lit("w")})


QUERIES = {
    "l_last_writer_wins": _loaded_twice,
    "l_extract_refs": _refs,
    "l_typed_preamble": lambda s, d: _refs(s, d).filter("edge_type <> 'body'"),
    "l_resolve_cascade": lambda s, d: identity.resolve(_refs(s, d).distinct(), _obj(s, d)),
    "l_field_ref": lambda s, d: identity.resolve(_refs(s, d).filter("raw like '%.%'"), _obj(s, d)),
    "l_edges_dedup": lambda s, d: identity.build_edges(_texts(s, d), _obj(s, d)),
    "v_broken_links": lambda s, d: validation.broken_links(_refs(s, d), _obj(s, d)),
    "v_duplicate_ids": lambda s, d: validation.duplicate_ids(_doubled(s, d)),
    "v_duplicate_rows": lambda s, d: validation.duplicate_rows(_doubled(s, d)),
    "v_broken_parent": lambda s, d: validation.broken_parents(_orphans(s, d)),
    "v_ambiguous_refs": lambda s, d: validation.ambiguous_references(_merged(s, d).select("__workspace", F.lit("none").alias("__namespace"), F.col("__id").alias("raw")).distinct(), _merged(s, d)),
    "g_traverse_in": lambda s, d: graph.traverse(_obj(s, d), _edges(s, d), START, "incoming", None, 2),
    "g_traverse_out": lambda s, d: graph.traverse(_obj(s, d), _edges(s, d), _first(s, d, "Supplier"), "outgoing", None, 3),
    "g_traverse_both": lambda s, d: graph.traverse(_obj(s, d), _edges(s, d), START, "both", None, 3),
    "g_traversed_edges": lambda s, d: graph.traversed_edges(_edges(s, d), graph.walk(_starts(s), graph.steps(_edges(s, d), "incoming"), 2), 2, "incoming"),
    "u_reachable_fixpoint": lambda s, d: graph.reachable(_edges(s, d), _starts(s), "incoming"),
    "g_shortest_path": lambda s, d: _paths(s, d),
    "g_find_references": lambda s, d: graph.find_references(_edges(s, d), _obj(s, d), START).select("__global_id", "__kind"),
    "g_search_substring": lambda s, d: graph.search(_obj(s, d), "oMer_12").select("__global_id"),
    "g_fuzzy_ids": lambda s, d: graph.fuzzy(_obj(s, d), "sp99").select("__global_id"),
    "g_tree_top_level": lambda s, d: graph.descendants(_obj(s, d)),
    "g_tree_nodes": lambda s, d: graph.tree(_obj(s, d)),
    "g_level_parents": lambda s, d: graph.level_parents(_obj(s, d)),
    "g_rename_plan": lambda s, d: graph.rename_plan(_refs(s, d).withColumn("source_id", F.col("__id")), _obj(s, d), "nation_7", "country_7"),
    "g_dump_page": lambda s, d: graph.page_of(_obj(s, d).select("__global_id", "__kind"), "__global_id", "ASIA:", 100)[0],
}


def _first(spark: SparkSession, sf_dir: str, kind: str, workspace: str = WORKSPACE) -> str:
    return _obj(spark, sf_dir).filter((F.col("__kind") == kind) & (F.col("__workspace") == workspace)).agg(F.min("__global_id")).first()[0] or "none"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of no, one, two and three steps, and to nowhere (which has no row), over all edges."""
    e = _edges(spark, sf_dir)
    ends = [START, _first(spark, sf_dir, "Nation"), _first(spark, sf_dir, "Customer"), _first(spark, sf_dir, "Order"), "ASIA::ghost"]
    return graph.find_paths(e, START, ends).select(F.array_join("path", ">").alias("path"), "length")


_REFS = r"""refs AS (
  WITH h AS (SELECT __workspace, __namespace, __id, body, string_split(body, chr(10) || chr(10))[1] AS head FROM texts WHERE contains(body, '[[#')),
  t AS (SELECT *, len(list_filter(string_split(trim(head), chr(10)), lambda x: NOT regexp_matches(x, '^- [^:\[\]]+: *\[\[#[^\]]+\]\](, *\[\[#[^\]]+\]\])* *$'))) = 0 AS typed FROM h),
  i AS (SELECT __workspace, __namespace, __id, unnest(string_split(trim(head), chr(10))) AS item FROM t WHERE typed),
  p AS (SELECT __workspace, __namespace, __id, unnest(regexp_extract_all(item, '\[\[#([^\]]+)\]\]', 1)) AS raw, regexp_extract(item, '^- ([^:\[\]]+):', 1) AS edge_type FROM i),
  o AS (SELECT __workspace, __namespace, __id, unnest(regexp_extract_all(CASE WHEN typed THEN substr(body, length(head) + 1) ELSE body END, '\[\[#([^\]]+)\]\]', 1)) AS raw FROM t)
  SELECT __workspace, __namespace, __id, 'body' AS source_field, raw, edge_type FROM p
  UNION ALL SELECT o.__workspace, o.__namespace, o.__id, 'body', o.raw, 'body' FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.__id = o.__id AND p.__workspace = o.__workspace AND p.__namespace = o.__namespace AND p.raw = o.raw))"""
_RESOLVED = r"""keyed AS (SELECT *, split_part(raw, ':', -1) AS rid FROM refs),
  tries AS (SELECT DISTINCT __workspace AS w, __namespace AS n, rid, rid AS t, '' AS field FROM keyed UNION SELECT DISTINCT __workspace, __namespace, rid, regexp_extract(rid, '^(.*)\.[^.]*$', 1), regexp_extract(rid, '\.([^.]*)$', 1) FROM keyed WHERE contains(rid, '.')),
  cand AS (SELECT w, n, rid, field, 1 AS r, __global_id AS g FROM tries JOIN objects ON t = objects.__id AND w = __workspace AND n = __namespace
    UNION ALL SELECT w, n, rid, field, 2, __global_id FROM tries JOIN objects ON t = objects.__id AND w = __workspace
    UNION ALL SELECT w, n, rid, field, 3, __global_id FROM tries JOIN objects ON t = objects.__id
    UNION ALL SELECT w, n, rid, field, 4, g FROM tries JOIN (SELECT __workspace AS lw, __namespace AS ln, __local_id AS l, min(__global_id) AS g FROM objects WHERE __local_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) = 1) ON t = l AND w = lw AND n = ln),
  best AS (SELECT w, n, rid, field, g FROM cand QUALIFY row_number() OVER (PARTITION BY w, n, rid ORDER BY length(field), r, g) = 1),
  resolved AS (SELECT k.__workspace, k.__namespace, k.__id, k.source_field, k.raw, k.edge_type, best.g AS target_id, coalesce(best.field, '') AS target_field FROM keyed k LEFT JOIN best ON w = k.__workspace AND n = k.__namespace AND best.rid = k.rid)"""


def _with(body: str, *ctes: str) -> str:
    return duck(f"WITH {', '.join(ctes)} {body}", "objects", "texts", "edges") if ctes else duck(body)


_STEP_IN = "WITH RECURSIVE walk(id, depth) AS (SELECT '{start}', 0 UNION SELECT e.source_id, w.depth + 1 FROM walk w JOIN edges e ON e.target_id = w.id WHERE w.depth < {depth}) "
ORACLE_SQL = {
    "l_extract_refs": _with("SELECT * FROM refs", _REFS),
    "l_typed_preamble": _with("SELECT * FROM refs WHERE edge_type <> 'body'", _REFS),
    "l_resolve_cascade": _with("SELECT DISTINCT * FROM resolved", _REFS, _RESOLVED),
    "l_field_ref": _with("SELECT * FROM resolved WHERE contains(raw, '.')", _REFS, _RESOLVED),
    "l_edges_dedup": _with("SELECT DISTINCT __workspace || ':' || __namespace || ':' || __id AS source_id, source_field, target_id, edge_type, target_field, __workspace FROM resolved WHERE target_id IS NOT NULL", _REFS, _RESOLVED),
    "v_broken_links": _with("SELECT r.__workspace, r.__namespace, r.__id, source_field, raw, edge_type, h.hint FROM resolved r LEFT JOIN (SELECT __id AS hid, min(__global_id) AS hint FROM objects GROUP BY 1) h ON h.hid = regexp_extract(raw, '([^.:]*)$', 1) WHERE target_id IS NULL", _REFS, _RESOLVED),
    "v_broken_parent": duck("SELECT __global_id, __parent FROM objects o WHERE __parent IS NOT NULL AND NOT (__kind = 'Customer' AND __line % 4 = 0) AND NOT EXISTS (SELECT 1 FROM objects p WHERE p.__id = o.__parent AND NOT (p.__kind = 'Customer' AND p.__line % 4 = 0))"),
    "g_traverse_in": duck(_STEP_IN.format(start=START, depth=2) + "SELECT id, min(depth) AS depth, __kind, __label FROM walk JOIN objects ON __global_id = id GROUP BY ALL", "objects", "edges"),
    "g_traverse_both": duck("WITH RECURSIVE both_ways AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges), "
                            f"walk(id, depth) AS (SELECT '{START}', 0 UNION SELECT b, depth + 1 FROM walk JOIN both_ways ON a = id WHERE depth < 3) SELECT id, min(depth) AS depth, any_value(__kind) AS __kind, any_value(__label) AS __label FROM walk JOIN objects ON __global_id = id GROUP BY id", "objects", "edges"),
    "g_traversed_edges": duck(_STEP_IN.format(start=START, depth=1) + "SELECT DISTINCT edges.* FROM edges JOIN walk ON target_id = id", "edges"),
    "g_find_references": duck(f"SELECT __global_id, __kind FROM objects WHERE __global_id IN (SELECT source_id FROM edges WHERE target_id = '{START}')"),
    "g_search_substring": duck("SELECT __global_id FROM objects WHERE contains(lower(__id), 'omer_12') OR contains(lower(__label), 'omer_12')"),
    "g_fuzzy_ids": duck("SELECT __global_id FROM objects WHERE regexp_matches(lower(__id), 's.*p.*9.*9')"),
    "g_tree_top_level": duck("WITH RECURSIVE up(node, top, depth) AS (SELECT DISTINCT __id, __id, 0 FROM objects UNION ALL SELECT u.node, o.__parent, u.depth + 1 FROM up u JOIN (SELECT DISTINCT __id, __parent FROM objects) o ON o.__id = u.top WHERE o.__parent IS NOT NULL) SELECT node, arg_max(top, depth) AS top, max(depth) AS depth FROM up GROUP BY node", "objects"),
    "g_tree_nodes": duck("WITH n AS (SELECT o.__global_id, o.__id, o.__label, coalesce(p.p, nullif(o.__namespace, '')) AS parent FROM objects o LEFT JOIN (SELECT DISTINCT __id AS p FROM objects) p ON o.__parent = p.p) "
                         "SELECT __global_id, parent, row_number() OVER (PARTITION BY parent ORDER BY CASE WHEN __id IN (SELECT parent FROM n WHERE parent IS NOT NULL) THEN 0 ELSE 1 END, lower(__label), __global_id) AS place FROM n", "objects"),
    "g_rename_plan": _with("SELECT __global_id AS source_id, 'definition' AS what, __id AS old_text, 'country_7' AS new_text FROM objects WHERE __id = 'nation_7' UNION ALL SELECT DISTINCT __id, 'reference', raw, replace(raw, 'nation_7', 'country_7') FROM refs WHERE split_part(raw, ':', -1) = 'nation_7' OR starts_with(split_part(raw, ':', -1), 'nation_7.')", _REFS),
    "g_dump_page": duck("SELECT __global_id, __kind FROM objects WHERE __global_id > 'ASIA:' ORDER BY __global_id LIMIT 101"),
    "l_last_writer_wins": duck("SELECT __global_id, CASE WHEN __line % 3 = 0 THEN 'new ' || __label ELSE __label END AS __label, CASE WHEN __line % 3 = 0 THEN 'later.md' ELSE __file END AS __file FROM objects"),
    "v_duplicate_ids": duck("SELECT __workspace, __namespace, __id, count(*) AS n, count(DISTINCT f) AS files, count(DISTINCT __kind) AS kinds FROM (SELECT *, __file AS f FROM objects UNION ALL SELECT *, 'copy.md' FROM objects WHERE __line % 5 = 0) GROUP BY 1, 2, 3 HAVING count(*) > 1"),
    "v_duplicate_rows": duck("SELECT __workspace, __namespace, __id, __kind, f AS __file, __line, nth, first FROM (SELECT *, row_number() OVER w AS nth, first_value(f || ':' || __line) OVER w AS first, count(*) OVER (PARTITION BY __workspace, __namespace, __id) AS n "
                             "FROM (SELECT *, __file AS f FROM objects UNION ALL SELECT *, 'copy.md' FROM objects WHERE __line % 5 = 0) WINDOW w AS (PARTITION BY __workspace, __namespace, __id ORDER BY f, __line, __kind)) WHERE n > 1 AND nth > 1"),
    "v_ambiguous_refs": duck("SELECT 'w' AS __workspace, 'none' AS __namespace, 'x' || CAST(__line AS STRING) AS raw, count(*) AS candidates FROM objects GROUP BY __line HAVING count(*) > 1"),
    "g_traverse_out": duck("WITH RECURSIVE walk(id, depth) AS (SELECT (SELECT min(__global_id) FROM objects WHERE __kind = 'Supplier' AND __workspace = 'ASIA'), 0 UNION SELECT e.target_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_id = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth, any_value(__kind) AS __kind, any_value(__label) AS __label FROM walk JOIN objects ON __global_id = id GROUP BY id", "objects", "edges"),
    "u_reachable_fixpoint": duck(f"WITH RECURSIVE walk(id, depth) AS (SELECT '{START}', 0 UNION SELECT e.source_id, w.depth + 1 FROM walk w JOIN edges e ON e.target_id = w.id) SELECT id, min(depth) AS depth FROM walk GROUP BY id", "edges"),
    "g_shortest_path": duck(f"WITH t AS (SELECT __kind AS k, min(__global_id) AS g FROM objects WHERE __workspace = 'ASIA' GROUP BY 1), "
                            f"one AS (SELECT '{START}>' || source_id AS path, source_id AS spot FROM edges WHERE target_id = '{START}'), two AS (SELECT path || '>' || source_id AS path, source_id AS spot FROM one JOIN edges ON target_id = spot), "
                            f"three AS (SELECT path || '>' || source_id AS path, source_id AS spot FROM two JOIN edges ON target_id = spot) "
                            f"SELECT '{START}' AS path, 0 AS length UNION ALL SELECT path, 1 FROM one JOIN t ON spot = g AND k = 'Nation' UNION ALL SELECT path, 2 FROM two JOIN t ON spot = g AND k = 'Customer' UNION ALL SELECT path, 3 FROM three JOIN t ON spot = g AND k = 'Order'", "objects", "edges"),
    "g_level_parents": duck("SELECT a.__global_id, arg_max(b.__global_id, (b.__line, b.__global_id)) AS parent_id FROM objects a LEFT JOIN objects b ON b.__file = a.__file AND b.__line < a.__line AND b.__level < a.__level GROUP BY 1"),
}

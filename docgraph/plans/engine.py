"""Queries asked through the engine: its dialect pass, scopes, guard, stored queries, parameters and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.operators import pages
from docgraph.plans.model import duck, relation
from docgraph.session import Engine, Refused

WORKSPACE = "ASIA"
STORED = """{"sql":"select __kind, count(*) as n from objects where __kind <> 'Query' group by __kind"}"""


def engine(s: SparkSession, d: str) -> Engine:
    """The graph with one stored query."""
    objects = relation(s, d, "objects")
    row = s.createDataFrame([(WORKSPACE, "", "kinds", f"{WORKSPACE}::kinds", "Query", "Kinds", None, "q.md", None, 1, 1, STORED)],
                            "__workspace string, __namespace string, __id string, __global_id string, __kind string, __label string, __local_id string, __file string, __parent string, __line bigint, __level bigint, data string")
    return Engine(s, objects.unionByName(row), relation(s, d, "edges"))


#: name: (query in the engine's dialect, the oracle's, workspace)
DIALECT = {
    "q_glob": ("SELECT __id FROM objects WHERE __id GLOB 'nation_[0-9]' OR __id GLOB 'part_1?[^0-4]' AND NOT __id GLOB '*7'", "SELECT __id FROM objects WHERE __id GLOB 'nation_[0-9]' OR __id GLOB 'part_1?[!0-4]' AND NOT __id GLOB '*7'", None),
    "q_int_div": ("SELECT __id, __line/7 AS q, __line % 7 AS r, __line & 3 AS b FROM objects", "SELECT __id, __line // 7 AS q, __line % 7 AS r, __line & 3 AS b FROM objects", None),
    "q_cast_null": ("SELECT __id, coalesce(__parent, 'none') AS parent, CAST(json_extract(data, '$.cents') AS INTEGER) AS cents, CAST(__label AS INTEGER) AS number, nullif(__namespace, '') AS ns FROM objects",
                    "SELECT __id, coalesce(__parent, 'none') AS parent, TRY_CAST({j:data:cents} AS BIGINT) AS cents, TRY_CAST(__label AS BIGINT) AS number, nullif(__namespace, '') AS ns FROM objects", None),
    "q_like_prefix": ("SELECT __id FROM objects WHERE __id LIKE 'CUSTOMER$_1%' ESCAPE '$' AND __label NOT LIKE '%9'", "SELECT __id FROM objects WHERE __id ILIKE 'CUSTOMER$_1%' ESCAPE '$' AND __label NOT ILIKE '%9'", None),
    "q_quoted_names": ('SELECT "__id" AS "the id", iif("__level" > 2, \'deep\', \'flat\') AS d FROM objects', 'SELECT "__id" AS "the id", CASE WHEN "__level" > 2 THEN \'deep\' ELSE \'flat\' END AS d FROM objects', None),
    "a_group_concat": ("SELECT __workspace, group_concat(n) AS ns, total(c) AS t FROM (SELECT __workspace, __kind AS n, count(*) AS c FROM objects WHERE __kind = 'Nation' GROUP BY 1, 2) g GROUP BY 1",
                       "SELECT __workspace, string_agg(n, ',') AS ns, CAST(sum(c) AS DOUBLE) AS t FROM (SELECT __workspace, __kind AS n, count(*) AS c FROM objects WHERE __kind = 'Nation' GROUP BY 1, 2) g GROUP BY 1", None),
    "a_group_json_key_glob": ("SELECT key, count(*) AS n FROM objects, json_each(objects.data) WHERE key GLOB '[a-n]*' GROUP BY key", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(data)) AS key FROM objects) WHERE key GLOB '[a-n]*' GROUP BY key", None),
    "a_total_of_nothing": ("SELECT total(__line) AS t, sum(__line) AS s, count(*) AS n FROM objects WHERE __kind = 'Nobody'", "SELECT CAST(0 AS DOUBLE) AS t, CAST(NULL AS BIGINT) AS s, 0 AS n", None),
    "t_nocase_sort": ("SELECT __id, row_number() OVER (ORDER BY __label COLLATE NOCASE, __id) AS rn FROM objects WHERE __level < 3", "SELECT __id, row_number() OVER (ORDER BY lower(__label), __id) AS rn FROM objects WHERE __level < 3", None),
    "q_scoped_ws": ("SELECT __kind, count(*) AS n FROM objects GROUP BY __kind", "SELECT __kind, count(*) AS n FROM objects WHERE __workspace = 'EUROPE' GROUP BY __kind", "EUROPE"),
    "q_scoped_leftjoin": ("SELECT o.__id, count(e.source_id) AS n FROM objects o LEFT JOIN edges e ON e.target_id = o.__global_id GROUP BY o.__id",
                          "SELECT o.__id, count(e.source_id) AS n FROM (SELECT * FROM objects WHERE __workspace = 'EUROPE') o LEFT JOIN (SELECT * FROM edges WHERE __workspace = 'EUROPE') e ON e.target_id = o.__global_id GROUP BY o.__id", "EUROPE"),
    "q_scoped_everywhere": ("WITH k AS (SELECT __kind, count(*) AS n FROM objects GROUP BY 1) SELECT a.__kind, a.n, (SELECT count(*) FROM edges) AS e FROM k a, (SELECT DISTINCT __kind FROM objects) b WHERE a.__kind = b.__kind UNION ALL SELECT 'all', count(*), 0 FROM objects HAVING count(*) > (SELECT min(__line) FROM objects)",
                            "WITH o AS (SELECT * FROM objects WHERE __workspace = 'EUROPE'), f AS (SELECT * FROM edges WHERE __workspace = 'EUROPE'), k AS (SELECT __kind, count(*) AS n FROM o GROUP BY 1) SELECT a.__kind, a.n, (SELECT count(*) FROM f) AS e FROM k a UNION ALL SELECT 'all', count(*), 0 FROM o", "EUROPE"),
    "q_scoped_window": ("SELECT __id, row_number() OVER (PARTITION BY __kind ORDER BY __id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rn FROM objects", "SELECT __id, row_number() OVER (PARTITION BY __kind ORDER BY __id) AS rn FROM objects WHERE __workspace = 'EUROPE'", "EUROPE"),
}
#: Texts that are refused, and the code they are refused with.
REFUSED = [
    ("DROP TABLE objects", "not-read-only"), ("WITH a AS (SELECT 1) DELETE FROM objects", "not-read-only"), ("INSERT INTO objects SELECT * FROM objects", "not-read-only"), ("SET x=1", "not-read-only"),
    ("SELECT * FROM parquet.`/tmp`", "not-read-only"), ("SELECT * FROM global_temp.objects", "not-read-only"), ("SELECT reflect('java.lang.System', 'lineSeparator')", "not-read-only"), ("SELECT * FROM other", "not-read-only"),
    ("SELECT 1 WHERE EXISTS (SELECT 1 FROM csv.`/tmp`)", "not-read-only"), ("SELECT 1; DROP TABLE objects", "invalid-sql"), ("nonsense here", "invalid-sql"), ("#nobody", "not-found"), (".nothing", "invalid-argument"),
    ("SELECT transform(array(1), x -> java_method('a', 'b'))", "not-read-only"), ("EXPLAIN SELECT 1", "not-read-only"), ("CACHE TABLE objects", "not-read-only"), ("SELECT (", "invalid-sql"), ("SELECT count(*) FROM objects", "")]


def _refusals(s: SparkSession, d: str) -> DataFrame:
    e, rows = engine(s, d), []
    for text, _ in REFUSED:
        try:
            e.sql(text)
            rows.append((text, ""))
        except Refused as x:
            rows.append((text, x.code))
    return s.createDataFrame(rows, "query string, code string")


def _envelope(s: SparkSession, d: str) -> DataFrame:
    """Envelopes of several pages as rows."""
    e, rows = engine(s, d), []
    for limit, offset in ((3, 0), (3, 4), (1000, 0), (5, 100_000)):
        got = pages.envelope(e.sql("SELECT __kind FROM objects WHERE __kind <> 'Query' GROUP BY __kind ORDER BY __kind"), limit, offset)
        rows.append((limit, offset, ",".join(r[0] for r in got["items"]), got["truncated"], got.get("remaining", 0)))
    return s.createDataFrame(rows, "lim int, off int, items string, truncated boolean, remaining bigint")


QUERIES = {name: (lambda s, d, q=q, ws=ws: engine(s, d).sql(q, ws) if ws else Engine(s, relation(s, d, "objects"), relation(s, d, "edges")).sql(q)) for name, (q, _, ws) in DIALECT.items()} | {
    "q_stored_query": lambda s, d: engine(s, d).sql("#kinds"),
    "q_stored_query_scoped": lambda s, d: engine(s, d).sql("#kinds", WORKSPACE),
    "q_parameters": lambda s, d: engine(s, d).sql("SELECT __id, __label FROM objects WHERE __kind = ?1 AND __line > ?2", None, ["Supplier", 3]),
    "q_dot_schema": lambda s, d: engine(s, d).command(".schema"),
    "q_dot_tables": lambda s, d: engine(s, d).command(".tables"),
    "q_guard_refusals": _refusals,
    "t_envelope": _envelope,
    "t_keyset_envelope": lambda s, d: pages.page(relation(s, d, "objects").select("__global_id", "__kind"), "__global_id", 40, "ASIA:"),
    "t_keyset_last": lambda s, d: pages.page(relation(s, d, "objects").filter(F.col("__kind") == "Nation").select("__global_id", "__kind"), "__global_id", 1000),
}
_COLUMNS = [(t, c, k) for t, cols in (("objects", "__workspace:string __namespace:string __id:string __global_id:string __kind:string __label:string __local_id:string __file:string __parent:string __line:bigint __level:bigint data:string"),
                                      ("edges", "source_id:string source_field:string target_id:string edge_type:string target_field:string __workspace:string")) for c, k in (x.split(":") for x in cols.split())]
_values = lambda rows: ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)
ORACLE_SQL = {name: duck(theirs) for name, (_, theirs, _) in DIALECT.items()} | {
    "q_stored_query": duck("SELECT __kind, count(*) AS n FROM objects GROUP BY 1"),
    "q_stored_query_scoped": duck("SELECT __kind, count(*) AS n FROM objects WHERE __workspace = 'ASIA' GROUP BY 1"),
    "q_parameters": duck("SELECT __id, __label FROM objects WHERE __kind = 'Supplier' AND __line > 3"),
    "q_dot_schema": f"SELECT * FROM (VALUES {_values(_COLUMNS)}) AS t(name, \"column\", type)",
    "q_dot_tables": "SELECT * FROM (VALUES ('edges'), ('objects')) AS t(name)",
    "q_guard_refusals": f"SELECT * FROM (VALUES {_values(REFUSED)}) AS t(query, code)",
    "t_envelope": duck("WITH k AS (SELECT __kind, row_number() OVER (ORDER BY __kind) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT __kind FROM objects)), p(lim, off) AS (VALUES (3, 0), (3, 4), (1000, 0), (5, 100000)) "
                       "SELECT lim, off, coalesce((SELECT string_agg(__kind, ',' ORDER BY n) FROM k WHERE n > off AND n <= off + lim), '') AS items, (SELECT max(c) FROM k) > lim + off AS truncated, greatest((SELECT max(c) FROM k) - lim - off, 0) AS remaining FROM p", "objects"),
    "t_keyset_envelope": duck("WITH r AS (SELECT __global_id, __kind, row_number() OVER (ORDER BY __global_id) AS n FROM objects WHERE __global_id > 'ASIA:') SELECT __global_id, __kind, (SELECT count(*) FROM objects) AS total, (SELECT count(*) FROM r) > 40 AS truncated, CASE WHEN (SELECT count(*) FROM r) > 40 THEN (SELECT __global_id FROM r WHERE n = 40) END AS next_cursor FROM r WHERE n <= 40", "objects"),
    "t_keyset_last": duck("SELECT __global_id, __kind, (SELECT count(*) FROM objects WHERE __kind = 'Nation') AS total, FALSE AS truncated, CAST(NULL AS STRING) AS next_cursor FROM objects WHERE __kind = 'Nation'", "objects"),
}

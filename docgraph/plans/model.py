"""The graph model over the test tables: objects, edges and textual references.

One SQL text builds each relation in Spark and states it for the oracle; what
the dialects spell differently is a macro: ``{j:expr:field}`` reads a field of
a JSON text, ``{all:expr:regex}`` lists a regular expression's first groups,
``{x:list}`` explodes a list in a select list.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_ROW = """SELECT {ws} AS __workspace, {ns} AS __namespace, '{kind}_' || CAST({key} AS STRING) AS __id,
  {ws} || ':' || {ns} || ':{kind}_' || CAST({key} AS STRING) AS __global_id, '{Kind}' AS __kind, {label} AS __label, {local} AS __local_id,
  '{kind}/' || CAST({key} % 10 AS STRING) || '.md' AS __file, {parent} AS __parent, CAST({key} % 1000 + 1 AS BIGINT) AS __line, CAST({level} AS BIGINT) AS __level, {data} AS data
  FROM {source}"""


def _row(kind: str, key: str, ws: str, ns: str, label: str, local: str, parent: str, level: int, data: str, source: str) -> str:
    return _ROW.format(kind=kind.lower(), Kind=kind, key=key, ws=ws, ns=ns, label=label, local=local, parent=parent, level=level, data=data, source=source)


_PLACE = "JOIN nation n ON n.n_nationkey = {fk} JOIN region r ON r.r_regionkey = n.n_regionkey"
OBJECTS = "\nUNION ALL\n".join([
    _row("Region", "r_regionkey", "r_name", "''", "r_name", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", 1, """'{"name":"' || r_name || '"}'""", "region"),
    _row("Nation", "n_nationkey", "r_name", "''", "n_name", "lower(n_name)", "'region_' || CAST(n_regionkey AS STRING)", 2,
         """'{"name":"' || n_name || '","region":"[[#region_' || CAST(n_regionkey AS STRING) || ']]"}'""", "nation JOIN region r ON r.r_regionkey = n_regionkey"),
    _row("Customer", "c_custkey", "r_name", "n_name", "c_name", "lower(c_name)", "'nation_' || CAST(c_nationkey AS STRING)", 3,
         """'{"segment":"' || c_mktsegment || '","nation":"[[#nation_' || CAST(c_nationkey AS STRING) || ']]","cents":' || CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS STRING) || '}'""", "customer " + _PLACE.format(fk="c_nationkey")),
    _row("Supplier", "s_suppkey", "r_name", "n_name", "s_name", "lower(s_name)", "'nation_' || CAST(s_nationkey AS STRING)", 3,
         """'{"nation":"[[#nation_' || CAST(s_nationkey AS STRING) || ']]","cents":' || CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS STRING) || '}'""", "supplier " + _PLACE.format(fk="s_nationkey")),
    _row("Order", "o_orderkey", "r_name", "n_name", "'order ' || CAST(o_orderkey AS STRING)", "CAST(o_orderkey AS STRING)", "'customer_' || CAST(o_custkey AS STRING)", 4,
         """'{"status":"' || o_orderstatus || '","customer":"[[#customer_' || CAST(o_custkey AS STRING) || ']]","priority":"' || o_orderpriority || '","cents":' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS STRING) || '}'""",
         "orders JOIN customer c ON c.c_custkey = o_custkey " + _PLACE.format(fk="c_nationkey")),
    _row("Part", "p_partkey", "'CATALOG'", "p_brand", "p_name", "CAST(p_partkey AS STRING)", "CAST(NULL AS STRING)", 1,
         """'{"type":"' || p_type || '","brand":"' || p_brand || '","size":' || CAST(p_size AS STRING) || '}'""", "part"),
])

_EDGE = "SELECT {s} AS source_id, '{f}' AS source_field, {t} AS target_id, '{e}' AS edge_type, '{tf}' AS target_field, {ws} AS __workspace FROM {source}"


def _gid(ws: str, ns: str, kind: str, key: str) -> str:
    return f"{ws} || ':' || {ns} || ':{kind}_' || CAST({key} AS STRING)"


EDGES = "\nUNION ALL\n".join([
    _EDGE.format(s=_gid("r.r_name", "''", "nation", "n_nationkey"), f="region", t=_gid("r.r_name", "''", "region", "n_regionkey"), e="region", tf="", ws="r.r_name", source="nation JOIN region r ON r.r_regionkey = n_regionkey"),
    _EDGE.format(s=_gid("r.r_name", "n.n_name", "customer", "c_custkey"), f="nation", t=_gid("r.r_name", "''", "nation", "c_nationkey"), e="nation", tf="", ws="r.r_name", source="customer " + _PLACE.format(fk="c_nationkey")),
    _EDGE.format(s=_gid("r.r_name", "n.n_name", "supplier", "s_suppkey"), f="nation", t=_gid("r.r_name", "''", "nation", "s_nationkey"), e="nation", tf="name", ws="r.r_name", source="supplier " + _PLACE.format(fk="s_nationkey")),
    _EDGE.format(s=_gid("r.r_name", "n.n_name", "order", "o_orderkey"), f="customer", t=_gid("r.r_name", "n.n_name", "customer", "o_custkey"), e="placed_by", tf="", ws="r.r_name", source="orders JOIN customer c ON c.c_custkey = o_custkey " + _PLACE.format(fk="c_nationkey")),
    _EDGE.format(s=_gid("ws", "ns", "supplier", "l_suppkey"), f="parts", t=_gid("'CATALOG'", "p_brand", "part", "l_partkey"), e="supplies", tf="", ws="ws",
                 source="(SELECT DISTINCT l_suppkey, l_partkey, r_name AS ws, n_name AS ns, p_brand FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey " + _PLACE.format(fk="s_nationkey") + ") l"),
])

#: Textual references: plain, qualified, field, repeated, in a preamble, dangling and by local id.
TEXTS = """SELECT 'customer_' || CAST(c_custkey AS STRING) AS __id, r_name AS __workspace, n_name AS __namespace,
  CASE c_custkey % 6 WHEN 0 THEN '- owner: [[#nation_' || CAST(c_nationkey AS STRING) || ']]' || chr(10) || '- peers: [[#customer_' || CAST(c_custkey + 1 AS STRING) || ']], [[#customer_' || CAST(c_custkey + 2 AS STRING) || ']]' || chr(10) || chr(10) || 'see [[#region_' || CAST(n_regionkey AS STRING) || ']] and [[#nation_' || CAST(c_nationkey AS STRING) || ']]'
    WHEN 1 THEN 'in [[#' || n_name || ':customer_' || CAST(c_custkey % 97 AS STRING) || ']] twice [[#' || n_name || ':customer_' || CAST(c_custkey % 97 AS STRING) || ']]'
    WHEN 2 THEN 'field [[#nation_' || CAST(c_nationkey AS STRING) || '.name]]'
    WHEN 3 THEN 'nobody [[#ghost_' || CAST(c_custkey AS STRING) || ']]'
    WHEN 4 THEN 'local [[#supplier#' || CAST(c_custkey % 50 AS STRING) || ']] or [[#' || lower(n_name) || ']]'
    ELSE '- bad item' || chr(10) || '- owner: [[#region_' || CAST(n_regionkey AS STRING) || ']]' END AS body
  FROM customer """ + _PLACE.format(fk="c_nationkey")

RELATIONS = {"objects": OBJECTS, "edges": EDGES, "texts": TEXTS}

_MACRO = re.compile(r"\{(j|all|x):([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}")


def expand(sql: str, spark: bool) -> str:
    def one(m: re.Match) -> str:
        kind, body = m[1], m[2]
        if kind == "j":
            e, f = body.rsplit(":", 1)
            return f"get_json_object({e}, '$.{f}')" if spark else f"json_extract_string({e}, '$.{f}')"
        if kind == "all":
            e, rx = body.split(":", 1)
            quoted = rx.replace("\\", "\\\\") if spark else rx
            return f"regexp_extract_all({e}, '{quoted}', 1)"
        return f"explode({body})" if spark else f"unnest({body})"

    while _MACRO.search(sql):
        sql = _MACRO.sub(one, sql)
    return sql


def duck(sql: str, *relations: str) -> str:
    """The SQL with the relations it uses as common table expressions."""
    used = relations or tuple(n for n in RELATIONS if re.search(rf"\b{n}\b", sql))
    heads = ", ".join(f"{n} AS ({expand(RELATIONS[n], False)})" for n in used)
    body = expand(sql, False).strip()
    if not heads:
        return body
    m = re.match(r"(?i)WITH\s+(RECURSIVE\s+)?", body)
    return f"WITH RECURSIVE {heads}, {body[m.end():]}" if m else f"WITH {heads} {body}"


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in TABLES:
        if re.search(rf"\b{t}\b", RELATIONS[name]):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(expand(RELATIONS[name], True))


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the relations and tables it names."""
    for n in RELATIONS:
        if re.search(rf"\b{n}\b", sql):
            relation(spark, sf_dir, n).createOrReplaceTempView(n)
    for t in TABLES:
        if re.search(rf"\b{t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(expand(sql, True))


def both(queries: dict[str, str | tuple[str, str]]) -> tuple[dict, dict]:
    """QUERIES and ORACLE_SQL of SQL texts; a pair has one for each engine."""
    run, say = {}, {}
    for name, sql in queries.items():
        ours, theirs = (sql, sql) if isinstance(sql, str) else sql
        run[name] = lambda spark, sf_dir, ours=ours: run_sql(spark, sf_dir, ours)
        say[name] = duck(theirs)
    return run, say

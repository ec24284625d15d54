"""The SQL surface over objects and edges: projection, joins, aggregation, windows, paging, set operations."""

from __future__ import annotations

from docgraph.plans.model import both

SQL: dict = {
    # projection, filters, scalar expressions
    "q_project_alias": "SELECT __id AS id, __kind AS kind, upper(__label) AS shout FROM objects WHERE __level <= 2",
    "q_distinct": "SELECT DISTINCT __kind, __namespace FROM objects",
    "q_and_or_not": "SELECT __id FROM objects WHERE (__kind = 'Customer' OR __kind = 'Supplier') AND NOT (__line < 500) AND __workspace != 'ASIA'",
    "q_in_list": "SELECT __id, __kind FROM objects WHERE __kind IN ('Region', 'Nation') AND __namespace NOT IN ('x')",
    "q_case": "SELECT __kind, CASE WHEN __level = 1 THEN 'root' WHEN __level < 4 THEN 'inner' ELSE 'leaf' END AS depth, CASE __kind WHEN 'Part' THEN 1 ELSE 0 END AS is_part, count(*) AS n FROM objects GROUP BY 1, 2, 3",
    "q_between_in": "SELECT __id FROM objects WHERE __line BETWEEN 10 AND 20 AND __parent IS NOT NULL AND __local_id IS DISTINCT FROM 'x'",
    "q_scalar_subquery": "SELECT o.__id, (SELECT count(*) FROM edges e WHERE e.target_id = o.__global_id) AS n FROM objects o WHERE o.__kind = 'Nation'",
    "q_json_field": "SELECT __id, {j:data:segment} AS segment FROM objects WHERE {j:data:segment} = 'BUILDING'",
    "q_string_functions": "SELECT __id, substr(__kind, 1, 2) AS two, length(__label) AS n, __kind || '/' || __id AS path FROM objects WHERE __level < 4",
    "q_hash_prefix": ("SELECT doc_id, substr(sha2(text, 256), 1, 16) AS h FROM documents", "SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents"),
    "q_exists_having": "SELECT __workspace, count(*) AS n FROM objects o WHERE EXISTS (SELECT 1 FROM edges e WHERE e.source_id = o.__global_id AND e.edge_type = 'supplies') GROUP BY __workspace HAVING count(*) > 1",
    # joins
    "j_backlinks_inner": "SELECT t.__id AS target, s.__id AS source, e.edge_type FROM edges e JOIN objects s ON s.__global_id = e.source_id JOIN objects t ON t.__global_id = e.target_id WHERE t.__kind IN ('Region', 'Nation')",
    "j_edges_left": "SELECT o.__id, e.target_id FROM objects o LEFT JOIN edges e ON e.source_id = o.__global_id AND e.edge_type = 'nation' WHERE o.__kind IN ('Customer', 'Region')",
    "j_right": "SELECT o.__id, e.source_id FROM edges e RIGHT JOIN objects o ON e.target_id = o.__global_id WHERE o.__kind = 'Region'",
    "j_full_outer_fk": "SELECT a.c AS custs, b.s AS supps, coalesce(a.ns, b.ns) AS ns FROM (SELECT __namespace AS ns, count(*) AS c FROM objects WHERE __kind = 'Customer' GROUP BY 1) a FULL OUTER JOIN (SELECT __namespace AS ns, count(*) AS s FROM objects WHERE __kind = 'Supplier' GROUP BY 1) b ON a.ns = b.ns",
    "j_cross_kinds": "SELECT a.__id AS a, b.__id AS b FROM (SELECT __id FROM objects WHERE __kind = 'Region') a CROSS JOIN (SELECT __id FROM objects WHERE __kind = 'Nation') b",
    "j_self_parent": "SELECT c.__id AS child, p.__id AS parent, p.__label AS label FROM objects c JOIN objects p ON c.__parent = p.__id",
    "j_theta_like": "SELECT o.__id, t.__id AS t FROM objects o JOIN edges e ON e.source_id = o.__global_id JOIN objects t ON t.__global_id = e.target_id AND t.__id LIKE 'nation%' AND t.__line < 12",
    "j_using": "SELECT __workspace, a.n, b.m FROM (SELECT __workspace, count(*) AS n FROM objects GROUP BY 1) a JOIN (SELECT __workspace, count(*) AS m FROM edges GROUP BY 1) b USING (__workspace)",
    "j_natural": "SELECT __workspace, n, m FROM (SELECT __workspace, count(*) AS n FROM objects GROUP BY 1) a NATURAL JOIN (SELECT __workspace, count(*) AS m FROM edges GROUP BY 1) b",
    "j_semi_in": "SELECT __id FROM objects WHERE __global_id IN (SELECT target_id FROM edges WHERE edge_type = 'placed_by')",
    "j_anti_not_exists": "SELECT __id FROM objects o WHERE __kind = 'Customer' AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = o.__global_id)",
    "j_on_count_lifted": "SELECT o.__id, n.n FROM objects o JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY 1) n ON n.target_id = o.__global_id AND n.n > 10",
    "j_lateral_json_each": ("SELECT __id, key, value FROM objects, LATERAL explode(from_json(data, 'map<string,string>')) AS t(key, value) WHERE __kind = 'Part'",
                            "SELECT __id, t.k AS key, json_extract_string(data, '$.' || t.k) AS value FROM (SELECT *, unnest(json_keys(data)) AS k FROM objects WHERE __kind = 'Part') t"),
    # aggregation
    "a_count_kind": "SELECT __kind, count(*) AS n, min(__id) AS first_id, max(__line) AS last_line FROM objects GROUP BY __kind",
    "a_global": "SELECT count(*) AS n, count(__parent) AS with_parent, sum(__line) AS lines, max(__level) AS deepest FROM objects",
    "a_count_edges": "SELECT count(*) AS n FROM edges",
    "a_count_distinct_targets": "SELECT edge_type, count(DISTINCT target_id) AS targets, count(DISTINCT source_id) AS sources FROM edges GROUP BY edge_type",
    "a_having": "SELECT source_id, count(*) AS n FROM edges GROUP BY source_id HAVING count(*) >= 40",
    "a_avg_rounded": "SELECT __kind, round(avg(__line), 4) AS mean_line FROM objects GROUP BY __kind",
    "a_first_label_per_file": ("SELECT __file, min_by(__label, struct(__level, __line, __id)) AS label FROM objects GROUP BY __file", "SELECT __file, arg_min(__label, (__level, __line, __id)) AS label FROM objects GROUP BY __file"),
    "a_metamodel_kinds": ("SELECT __kind, count(DISTINCT __global_id) AS n, array_join(sort_array(collect_set(key)), ',') AS fields FROM objects, LATERAL explode(map_keys(from_json(data, 'map<string,string>'))) AS t(key) GROUP BY __kind",
                          "SELECT __kind, count(DISTINCT __global_id) AS n, array_to_string(list_sort(list(DISTINCT key)), ',') AS fields FROM (SELECT *, unnest(json_keys(data)) AS key FROM objects) GROUP BY __kind"),
    "a_metamodel_edges": "SELECT edge_type, count(*) AS n FROM edges WHERE source_id IN (SELECT __global_id FROM objects WHERE __namespace != '') GROUP BY edge_type",
    "a_edge_types_by_kind": "SELECT s.__kind AS source_kind, e.edge_type, t.__kind AS target_kind, count(*) AS n FROM edges e JOIN objects s ON s.__global_id = e.source_id JOIN objects t ON t.__global_id = e.target_id GROUP BY 1, 2, 3",
    "a_tree_counts": "SELECT __workspace, __file, __kind, count(*) AS n FROM objects GROUP BY 1, 2, 3",
    # windows
    "w_row_number": "SELECT __kind, n, row_number() OVER (ORDER BY n DESC, __kind) AS rn FROM (SELECT __kind, count(*) AS n FROM objects GROUP BY 1) g",
    "w_rank_in_kind": "SELECT __id, __kind, row_number() OVER (PARTITION BY __kind, __namespace ORDER BY __line DESC, __id) AS rn FROM objects",
    "w_count_over_ws": "SELECT __id, count(*) OVER (PARTITION BY __workspace, __kind) AS n FROM objects WHERE __level < 4",
    "w_rows_frame": "SELECT __id, sum(__line) OVER (PARTITION BY __namespace ORDER BY __id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, lag(__id) OVER (PARTITION BY __namespace ORDER BY __id) AS before FROM objects WHERE __kind = 'Customer'",
    "w_named": "SELECT __id, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER w AS q FROM objects WHERE __kind = 'Supplier' WINDOW w AS (PARTITION BY __workspace ORDER BY __line, __id)",
    "w_nulls_first": "SELECT __id, row_number() OVER (PARTITION BY __kind ORDER BY __parent NULLS LAST, __id) AS rn FROM objects WHERE __level < 4",
    # ordering and pages
    "t_topk": "SELECT __id, __line FROM objects ORDER BY __line DESC, __id LIMIT 25",
    "t_offset_page": "SELECT __global_id FROM objects ORDER BY __global_id LIMIT 50 OFFSET 100",
    "t_keyset_page": "SELECT __global_id FROM objects WHERE __global_id > 'ASIA:' ORDER BY __global_id LIMIT 40",
    "t_case_key": "SELECT __id, row_number() OVER (ORDER BY CASE WHEN __kind = 'Region' THEN 0 ELSE 1 END, __id) AS rn FROM objects WHERE __level <= 2",
    "t_readme_first": "SELECT __file, row_number() OVER (ORDER BY split_part(__file, '/', 1), CASE WHEN __file LIKE '%/0.md' THEN 0 ELSE 1 END, __file) AS rn FROM (SELECT DISTINCT __file FROM objects) f",
    # set operations and common table expressions
    "u_union": "SELECT __workspace AS w FROM objects UNION SELECT __workspace FROM edges",
    "u_union_all": "SELECT source_id AS id FROM edges WHERE edge_type = 'region' UNION ALL SELECT target_id FROM edges WHERE edge_type = 'region'",
    "u_intersect": "SELECT source_id AS id FROM edges INTERSECT SELECT target_id FROM edges",
    "u_except": "SELECT __global_id AS id FROM objects EXCEPT SELECT source_id FROM edges",
    "u_cte_chain": "WITH deg(id, n) AS (SELECT target_id, count(*) FROM edges GROUP BY 1), top AS (SELECT id, n FROM deg WHERE n > 5) SELECT o.__id, top.n FROM top JOIN objects o ON o.__global_id = top.id",
    "u_derived": "SELECT k.__kind, k.n FROM (SELECT __kind, count(*) AS n FROM objects GROUP BY __kind) k WHERE k.n > 10",
    "u_recursive_depth": "WITH RECURSIVE walk(id, depth) AS (SELECT __id, 0 FROM objects WHERE __kind = 'Region' UNION ALL SELECT o.__id, w.depth + 1 FROM walk w JOIN objects o ON o.__parent = w.id WHERE w.depth < 2) SELECT id, depth FROM walk",
    "l_global_id": "SELECT __global_id, CASE WHEN __namespace = '' THEN __workspace || '::' || __id ELSE __workspace || ':' || __namespace || ':' || __id END AS again FROM objects",
    "l_counts": "SELECT (SELECT count(*) FROM objects) AS objects_n, (SELECT count(*) FROM edges) AS edges_n",
    # pages of a site
    "p_page_edges": "SELECT DISTINCT e.edge_type, s.__file AS from_file, t.__file AS to_file, t.__kind AS kind FROM edges e JOIN objects s ON s.__global_id = e.source_id JOIN objects t ON t.__global_id = e.target_id WHERE s.__file <> t.__file AND t.__kind NOT LIKE '\\_\\_%'".replace("\\_\\_", "~~"),
    "p_related_files": ("SELECT a, b, array_join(sort_array(collect_set(edge_type)), ',') AS types FROM (SELECT s.__file AS a, t.__file AS b, edge_type FROM edges e JOIN objects s ON s.__global_id = e.source_id JOIN objects t ON t.__global_id = e.target_id UNION ALL SELECT t.__file, s.__file, edge_type FROM edges e JOIN objects s ON s.__global_id = e.source_id JOIN objects t ON t.__global_id = e.target_id) u WHERE a <> b GROUP BY a, b",
                        "SELECT a, b, array_to_string(list_sort(list(DISTINCT edge_type)), ',') AS types FROM (SELECT s.__file AS a, t.__file AS b, edge_type FROM edges e JOIN objects s ON s.__global_id = e.source_id JOIN objects t ON t.__global_id = e.target_id UNION ALL SELECT t.__file, s.__file, edge_type FROM edges e JOIN objects s ON s.__global_id = e.source_id JOIN objects t ON t.__global_id = e.target_id) u WHERE a <> b GROUP BY a, b"),
    "p_site_tree": "SELECT split_part(f.__file, '/', 1) AS dir, f.__file, f.n FROM (SELECT __file, count(*) AS n FROM objects GROUP BY 1) f WHERE NOT (f.__file LIKE '%/0.md' AND NOT EXISTS (SELECT 1 FROM objects b WHERE b.__file = f.__file AND b.__kind NOT IN ('Region', 'Nation')))",
    "p_siblings": ("SELECT f.__file, g.__file AS sibling, g.label FROM (SELECT DISTINCT __file FROM objects) f JOIN (SELECT __file, min_by(__label, struct(__level, __line, __id)) AS label FROM objects GROUP BY __file) g ON split_part(f.__file, '/', 1) = split_part(g.__file, '/', 1) AND f.__file <> g.__file",
                   "SELECT f.__file, g.__file AS sibling, g.label FROM (SELECT DISTINCT __file FROM objects) f JOIN (SELECT __file, arg_min(__label, (__level, __line, __id)) AS label FROM objects GROUP BY __file) g ON split_part(f.__file, '/', 1) = split_part(g.__file, '/', 1) AND f.__file <> g.__file"),
    "p_kinds_per_file": "SELECT __file, __kind, count(*) AS n FROM objects GROUP BY __file, __kind",
    "p_toc": "SELECT __file, __id, __label, __level FROM objects WHERE __level >= 2",
    "p_breadcrumb": "SELECT o.__id, w.__label AS workspace_label, o.__namespace, o.__file FROM objects o JOIN objects w ON w.__kind = 'Region' AND w.__workspace = o.__workspace WHERE o.__level IN (2, 3)",
    "p_nav_titles": "SELECT f.__file, coalesce(l.__label, f.__file) AS title FROM (SELECT DISTINCT __file FROM objects) f LEFT JOIN objects l ON l.__file = f.__file AND l.__level = 1 AND l.__kind = 'Region'",
    # hashes of hashes, a thousand ids at a time, so that no row has to hold a source whole
    "p_stale_sources": ("SELECT source, substr(sha2(listagg(h, '') WITHIN GROUP (ORDER BY part), 256), 1, 16) AS fingerprint FROM (SELECT source, doc_id div 1000 AS part, sha2(listagg(substr(sha2(text, 256), 1, 16), '') WITHIN GROUP (ORDER BY doc_id), 256) AS h FROM documents GROUP BY 1, 2) p GROUP BY source",
                        "SELECT source, substr(sha256(string_agg(h, '' ORDER BY part)), 1, 16) AS fingerprint FROM (SELECT source, doc_id // 1000 AS part, sha256(string_agg(substr(sha256(text), 1, 16), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2) p GROUP BY source"),
}

SQL["p_page_edges"] = SQL["p_page_edges"].replace("NOT LIKE '~~%'", "<> 'Region'")
QUERIES, ORACLE_SQL = both(SQL)

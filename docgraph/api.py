"""The library's calls and the agents' tools: plain functions over one loaded graph, answers as dictionaries.

A ``Graph`` holds the relations of a load, written once to the shared folder, so
that calls don't parse again.  Every answer is ``{"success": True, ...}`` or
``{"success": False, "error": {"code", "message"}}``; lists are bounded and say
what they leave out.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.operators import chunks, fusion, graph, identity, lookup, pages, text, validation, vector
from docgraph.operators.embed import Embedder, embed
from docgraph.session import Engine, Refused
from docgraph.sources import load as loading
from docgraph.sources.parse import parse
from docgraph.sources.render import rebuild
from docgraph.storage import written

__all__ = ["Graph", "GUIDE", "parse", "rebuild", "TOOLS"]

GUIDE = """Objects are headings with [[id: Kind]]; their fields are `- key: value` items, texts, tables and blocks below them.
References are [[#id]], [[#namespace:id]] or [[#id.field]]. Ask with SQL over
objects(__workspace, __namespace, __id, __global_id, __kind, __label, __local_id, __file, __parent, __line, __level, data) and
edges(source_id, source_field, target_id, edge_type, target_field, __workspace); json_extract(data, '$.field') reads a field."""


def answer(f: Callable) -> Callable:
    """What a call gives as an envelope of success; refusals and wrong arguments as one of failure."""

    @wraps(f)
    def call(*args: Any, **kwargs: Any) -> dict[str, Any]:
        try:
            got = f(*args, **kwargs)
        except Refused as e:
            return e.envelope()
        except ValueError as e:
            return lookup.failure("invalid-argument", str(e))
        return got if "success" in got else {"success": True, **got}

    return call


class Graph:
    def __init__(self, spark: SparkSession, workspace: loading.Workspace):
        self.spark = spark
        keep = lambda df, name: written(df, name)
        self.rows, self.files = workspace.rows, workspace.files
        self.objects, self.refs, self.errors = keep(workspace.objects, "objects"), keep(workspace.refs, "refs"), keep(workspace.errors, "errors")
        self.edges = keep(workspace.edges, "edges")
        self.engine = Engine(spark, self.objects, self.edges)

    @classmethod
    def open(cls, spark: SparkSession, root: str, **how: Any) -> Graph:
        return cls(spark, loading.load(spark, root, **how))

    @classmethod
    def of_texts(cls, spark: SparkSession, texts: dict[str, str], name: str = "workspace") -> Graph:
        return cls(spark, loading.relations(spark.createDataFrame(sorted(texts.items()), "file string, text string"), name))

    def _one(self, ref: str) -> dict[str, Any]:
        row = lookup.resolve(self.objects, ref).first()
        if row["state"] != "resolved":
            raise Refused(row["state"], f"no single object matches '{ref}'" + (f". Did you mean {row['hint']}?" if row["hint"] else ""))
        return row.asDict()

    # -- tools
    @answer
    def locate(self, ref: str) -> dict[str, Any]:
        o = self._one(ref)
        return {"file": o["__file"], "line": o["__line"], "id": o["__id"], "kind": o["__kind"], "namespace": o["__namespace"]}

    @answer
    def find_references(self, ref: str, limit: int | None = None, cursor: str | None = None) -> dict[str, Any]:
        target = self._one(ref)
        found = graph.find_references(self.edges, self.objects, target["__global_id"]).select("__global_id", "__id", "__kind", "__file", "__line")
        return pages.keyset(found, "__global_id", limit, cursor)

    @answer
    def rename(self, old: str, new: str) -> dict[str, Any]:
        target = self._one(old)
        edits, more, rest = pages.bound_list(lookup.rename_edits(self.refs, self.objects, target["__id"], new))
        return {"edits": edits, "truncated": more, "remaining": rest}

    @answer
    def describe(self, ref: str) -> dict[str, Any]:
        return lookup.describe(self.objects, ref)

    @answer
    def outline(self, file: str) -> dict[str, Any]:
        rows, more, rest = pages.bound_list(lookup.outline(self.objects, file).orderBy("__line", "id"), pages.MOST)
        return {"symbols": lookup.nested_tree([{**r, "place": n} for n, r in enumerate(rows)]), "truncated": more, "remaining": rest}

    @answer
    def search(self, query: str, namespace: str | None = None, limit: int | None = None, cursor: str | None = None) -> dict[str, Any]:
        return pages.keyset(graph.search(self.objects, query, namespace).select("__global_id", "__id", "__kind", "__label", "__file", "__line"), "__global_id", limit, cursor)

    @answer
    def validate(self, file: str | None = None, limit: int | None = None) -> dict[str, Any]:
        d = self.problems()
        d = d if file is None else d.filter(F.col("file") == file)
        rows, more, rest = pages.bound_list(d.orderBy("file", "line", "type", "object"), limit)
        return {"diagnostics": rows, "truncated": more, "remaining": rest}

    @answer
    def get_tree(self, mode: str = "smart", limit: int | None = None, cursor: str | None = None) -> dict[str, Any]:
        if mode == "namespace":
            return pages.envelope(lookup.namespace_tree(self.objects).orderBy("__workspace", "__namespace", F.lower("__kind")), limit)
        if mode == "file":
            return pages.envelope(lookup.file_tree(self.objects).orderBy("__workspace", "__file"), limit)
        if mode != "smart":
            raise ValueError("mode is smart, namespace or file")
        return pages.keyset(graph.tree(self.objects).join(self.objects.select("__global_id", "__kind", "__label"), "__global_id"), "__global_id", limit, cursor)

    @answer
    def query_sql(self, sql: str, workspace: str | None = None, limit: int | None = None, offset: int = 0) -> dict[str, Any]:
        return pages.envelope(self.engine.sql(sql, workspace), limit, offset)

    @answer
    def dump(self, namespace: str | None = None, kind: str | None = None, limit: int | None = None, cursor: str | None = None) -> dict[str, Any]:
        o = self.objects if namespace is None else self.objects.filter(F.col("__namespace") == namespace)
        o = o if kind is None else o.filter(F.col("__kind") == kind)
        files, more, rest = pages.bound_list(o.select("__file").distinct().orderBy("__file"))
        return {**pages.keyset(o, "__global_id", limit, cursor), "files": [f["__file"] for f in files], "files_truncated": more, "files_remaining": rest}

    @answer
    def traverse(self, start: str, edge_type: str | None = None, direction: str = "outgoing", depth: int = 3) -> dict[str, Any]:
        at = self._one(start)["__global_id"]
        got = written(graph.traverse(self.objects, self.edges, at, direction, edge_type, depth), "traversed")
        met = graph.traversed_edges(self.edges, got.select("id", "depth"), depth, direction, edge_type)
        (nodes, a, m), (links, b, n) = pages.bound_list(got.orderBy("depth", "id")), pages.bound_list(met.orderBy("source_id", "target_id", "edge_type"))
        return {"nodes": nodes, "edges": links, "truncated": a or b, "remaining": m + n}

    @answer
    def find_path(self, from_: str, to: str, edge_type: str | None = None) -> dict[str, Any]:
        a, b = self._one(from_)["__global_id"], self._one(to)["__global_id"]
        row = graph.find_path(self.edges, a, b, edge_type).first()
        return {"path": list(row["path"]), "length": row["length"]} if row else lookup.failure("no-path", f"no path from {a} to {b}")

    @answer
    def describe_metamodel(self, namespace: str | None = None) -> dict[str, Any]:
        o = self.objects if namespace is None else self.objects.filter(F.col("__namespace") == namespace)
        keys = F.explode_outer(F.map_keys(F.from_json("data", "map<string,string>")))
        kinds = o.select("__kind", "__global_id", keys.alias("key")).groupBy("__kind").agg(F.count_distinct("__global_id").alias("count"), F.array_sort(F.collect_set("key")).alias("fields"))
        types = self.edges.join(o.select(F.col("__global_id").alias("source_id")), "source_id", "left_semi").groupBy("edge_type").agg(F.count(F.lit(1)).alias("count"))
        (k, a, m), (t, b, n) = pages.bound_list(kinds.orderBy("__kind")), pages.bound_list(types.orderBy("edge_type"))
        return {"kinds": k, "edge_types": t, "truncated": a or b, "remaining": m + n}

    @answer
    def get_guide(self) -> dict[str, Any]:
        return {"guide": GUIDE}

    # -- resources
    def resource(self, uri: str) -> dict[str, Any]:
        """guide, tree, diagnostics or object/<id>."""
        if m := re.fullmatch(r"object/(.+)", uri):
            return self.describe(m[1])
        known = {"guide": self.get_guide, "tree": self.get_tree, "diagnostics": self.validate}
        return known[uri]() if uri in known else lookup.failure("not-found", f"no resource {uri}")

    # -- editors' commands
    @answer
    def run_sql_query(self, sql: str, file: str | None = None, scope: str = "workspace") -> dict[str, Any]:
        """A query seen by the workspace of a file (or all, with scope 'all'); a file of none sees nothing."""
        ws = None
        if scope != "all":
            row = self.files.filter(F.col("file") == file).select("workspace").first() if file else None
            if row is None:
                raise Refused("not-found", f"no workspace has the file {file}")
            ws = row[0]
        from docgraph.sources.render import to_table

        df = self.engine.sql(sql, ws)
        e = pages.envelope(df, pages.MOST)
        return {"columns": df.columns, "rows": e["items"], "row_count": len(e["items"]), "truncated": e["truncated"], "table": to_table(df)}

    def get_workspace_tree(self, mode: str = "smart") -> dict[str, Any]:
        return self.get_tree(mode)

    @answer
    def dump_index(self) -> dict[str, Any]:
        return pages.envelope(loading.index(self.objects).groupBy("index", "key").agg(F.count(F.lit(1)).alias("n")).orderBy("index", "key"), pages.MOST)

    # -- validation
    def problems(self) -> DataFrame:
        """type, workspace, file, line, object, severity, message of everything that is wrong."""
        d = validation.diagnostics(self.refs, self.objects)
        refs = d.select(F.when(F.col("code") == "REF002", "ambiguous_reference").otherwise("broken_link").alias("type"), F.col("__workspace").alias("workspace"), "file", "line", F.col("__id").alias("object"), "severity", "message")
        unlike = [c for c in self.rows.columns if c in ("workspace", "namespace")]
        loaded = self.rows.filter("error is null and __kind not in ('__Document', '__TextBlock')").select(*unlike, F.col("file").alias("__file"), "__id", "__kind", "__line").withColumns({"__workspace": F.col("workspace"), "__namespace": F.col("namespace")})
        twice = validation.duplicate_rows(loaded).select(F.lit("duplicate_id").alias("type"), F.col("__workspace").alias("workspace"), F.col("__file").alias("file"), F.col("__line").alias("line"), F.col("__id").alias("object"),
                                                         F.lit("error").alias("severity"), F.concat(F.lit("id defined first at "), "first").alias("message"))
        orphans = validation.dotted_parents(self.objects.filter("__local_id = __id and __parent is null")).filter("parent_id is null").join(self.objects, "__global_id").select(
            F.lit("broken_parent").alias("type"), F.col("__workspace").alias("workspace"), F.col("__file").alias("file"), F.col("__line").alias("line"), F.col("__id").alias("object"), F.lit("error").alias("severity"),
            F.concat(F.lit("there is no parent "), "prefix").alias("message"))
        parsed = self.errors.select("type", "workspace", "file", "line", "object", F.lit("error").alias("severity"), F.col("type").alias("message"))
        return refs.unionByName(twice).unionByName(orphans).unionByName(parsed)

    # -- search by meaning
    def chunks(self, sizes: chunks.Sizes = chunks.Sizes()) -> DataFrame:
        return chunks.extract(self.objects, chunks.comments_of(self.rows, self.objects), sizes)

    def index(self, embedder: Embedder, old: DataFrame | None = None) -> dict[str, DataFrame]:
        """Chunks, vectors and inferred edges; with an ``old`` table of chunks and vectors only what changed is embedded."""
        c = written(self.chunks(), "chunks")
        fresh = c if old is None else c.join(old.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti")
        v = embed(fresh, embedder)
        if old is not None:
            v = v.unionByName(old.select("chunk_id", "embedding").join(c.join(fresh.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"), "chunk_id", "left_semi"))
        v = written(v, "vectors")
        return {"chunks": c, "vectors": v}

    def semantic_search(self, query: str, store: dict[str, DataFrame], embedder: Embedder, top_k: int = 10, depth: int = 2, exclude: list[str] | None = None) -> DataFrame:
        """object_id, score and snippet chunk: vectors, words and substrings fused, then walked from over the graph."""
        c, v = store["chunks"], store["vectors"]
        d = written(vector.distances(v, embedder.embed([query])[0].tolist(), "chunk_id"), "distances")
        far = d.join(c.select("chunk_id", "object_id"), "chunk_id")
        found = fusion.search(c, text.top(d, 2 * top_k, by="distance"), text.top(text.keyword_search(c, query), 2 * top_k), text.top(text.substring_search(c, query), 2 * top_k),
                              self.edges, far.select("object_id", "distance"), query, top_k, depth)
        if exclude:
            found = fusion.without_namespaces(found, self.objects.select(F.col("__global_id").alias("object_id"), F.col("__namespace").alias("namespace"), F.col("__file").alias("file")), exclude)
        return found.orderBy(F.desc("score"), "object_id")

    # -- writing back
    def write(self, folder: str) -> DataFrame:
        from docgraph.sources.render import write_documents

        return write_documents(loading.last_rows(self.rows), folder)

    def to_json(self, limit: int = 10_000) -> dict[str, Any]:
        """Objects and errors of a small workspace in one dictionary (the first ``limit`` of either; larger ones are written with ``objects.write``)."""
        (o, a, m), (e, b, n) = ((lambda rows, df: (rows[:limit], len(rows) > limit, max(0, df.count() - limit) if len(rows) > limit else 0))([r.asDict(True) for r in df.limit(limit + 1).collect()], df) for df in (self.objects.orderBy("__file", "__line"), self.problems()))
        return {"objects": o, "errors": e, "truncated": a or b, "remaining": m + n}


TOOLS = ("locate", "find_references", "rename", "describe", "outline", "search", "validate", "get_tree", "query_sql", "dump", "traverse", "find_path", "describe_metamodel", "get_guide")


def call(g: Graph, tool: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """A tool by name, arguments as given by a client."""
    if tool not in TOOLS:
        return lookup.failure("not-found", f"no tool {tool}")
    try:
        return getattr(g, tool)(**{"from_" if k == "from" else k: v for k, v in arguments.items()})
    except TypeError as e:
        return lookup.failure("invalid-argument", str(e))


def resolve_reference(g: Graph, raw: str, workspace: str = "", namespace: str = "") -> dict[str, Any]:
    """state, candidates and the first of them for a reference as written."""
    r = g.spark.createDataFrame([(workspace, namespace, lookup.normalised(raw))], "__workspace string, __namespace string, raw string")
    return validation.candidates_of(r, g.objects).first().asDict()


def data_edges(objects: DataFrame) -> DataFrame:
    """Edges of a table of objects that has only ``data``, as loaded from elsewhere."""
    return identity.edges_of_data(objects)

"""Workspaces of documents as relations: files, objects, references, edges, errors.

Files are listed and read by Spark, parsed in Arrow batches (one document at a
time, in as many tasks as the listing has partitions), and everything after
that is relational: a file's workspace and namespace are found by an equi-join
of its folder's ancestors with the folders that are marked, never by walking.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.operators import identity
from docgraph.sources.parse import outside_examples, parse
from docgraph.storage import batches_of, dealt, written

SUFFIX, IGNORE = ".qmd.md", ".docignore"
_MARK = r"\[\[\s*([^\]:\s]+)\s*:\s*{kind}\s*\]\]"
_REF = "struct<target:string,type:string,line:int,start_col:int,end_col:int,raw:string>"
PARSED = ("file string, ordinal int, __id string, __kind string, __label string, __local_id string, __parent string, __line bigint, __level bigint, data string, object string, "
          f"texts array<struct<field:string,text:string>>, refs array<{_REF}>, error string")


def ignore_patterns(text: str) -> list[str]:
    """Patterns of an ignore file: blank lines and comments don't count, a folder stands for all below it."""
    return [p + "**" if p.endswith("/") else p for p in (line.strip() for line in text.splitlines()) if p and not p.startswith("#")]


def ignored(file: Column, patterns: list[str], prefix: str = "") -> Column:
    """Whether a path matches a pattern, as a whole or by its name; with ``prefix``, without that folder too."""
    tests = [F.lit(False)]
    for p in patterns:
        rx = "^" + fnmatch.translate(p.replace("**/", "*").replace("**", "*")).replace("(?s:", "(?s)").removesuffix(")\\Z").removesuffix(")\\z") + "$"
        tests += [file.rlike(rx), F.element_at(F.split(file, "/"), -1).rlike(rx)]
        if prefix:
            tests.append(F.when(file.startswith(prefix + "/"), F.substring(file, len(prefix) + 2, 1 << 30).rlike(rx)).otherwise(F.lit(False)))
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def folder_of(file: Column) -> Column:
    return F.regexp_replace(file, "/?[^/]*$", "")


def file_order(file: Column, suffix: str = SUFFIX) -> Column:
    """Folders in order, in each the readme first."""
    name = F.element_at(F.split(file, "/"), -1)
    return F.struct(folder_of(file).alias("dir"), (name != "readme" + suffix).cast("int").alias("later"), name.alias("name"))


def scan(spark: SparkSession, root: str, suffix: str = SUFFIX, ignore: str = IGNORE) -> DataFrame:
    """file (below root) and text of all documents that the root's ignore file doesn't name."""
    root = root.rstrip("/")
    found = (spark.read.format("binaryFile").option("pathGlobFilter", "*" + suffix).option("recursiveFileLookup", "true").load(root)
             .select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("text")))
    base = "/" + root.split("://", 1)[-1].lstrip("/") if "://" in root or root.startswith("file:") else root
    files = found.select(F.substring("path", len(base.removeprefix("file:")) + 2, 1 << 30).alias("file"), "text")
    return files.filter(~ignored(F.col("file"), ignore_patterns(small_text(spark, f"{root}/{ignore}"))))


def small_text(spark: SparkSession, path: str) -> str:
    """A small file's text, '' if it isn't there; Spark's own readers pass over names that begin with a dot."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return ""
    stream = fs.open(where)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def nearest(files: DataFrame, marked: DataFrame, name: str) -> DataFrame:
    """``files`` with column ``name``: the value of the nearest marked folder (columns dir, value) at or above a file's own."""
    dirs = files.select(folder_of(F.col("file")).alias("own")).distinct()
    parts = F.split("own", "/")
    ups = F.when(F.col("own") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    best = dirs.select("own", F.explode(ups).alias("dir")).join(marked, "dir").groupBy("own").agg(F.max_by("value", F.length("dir")).alias(name))
    return files.withColumn("own", folder_of(F.col("file"))).join(best, "own", "left").drop("own")


def marks(files: DataFrame, kind: str, suffix: str = SUFFIX) -> DataFrame:
    """dir, value (id) of the folders whose readme defines an object of the kind."""
    rx = _MARK.format(kind=kind)
    readme = F.element_at(F.split("file", "/"), -1) == "readme" + suffix
    return files.filter(readme & F.col("text").rlike(rx)).select(folder_of(F.col("file")).alias("dir"), F.regexp_extract("text", rx, 1).alias("value"))


def placed(files: DataFrame, root_name: str, suffix: str = SUFFIX) -> DataFrame:
    """``files`` with workspace (the nearest above; the root's name for what has none) and namespace ('' for none).

    A namespace counts within its own workspace only.
    """
    dirs = files.select(folder_of(F.col("file")).alias("at")).distinct().withColumn("file", F.concat("at", F.lit("/x")))  # texts move once, with what their folder gives
    f = nearest(dirs, marks(files, "__Workspace", suffix).select("dir", F.struct("dir", "value").alias("value")), "ws")
    f = nearest(f, marks(files, "__Namespace", suffix).select("dir", F.struct("dir", "value").alias("value")), "ns")
    inner = F.col("ns").isNotNull() & (F.col("ws").isNull() | (F.length("ns.dir") >= F.length("ws.dir")))
    f = f.select("at", F.coalesce("ws.value", F.lit(root_name)).alias("workspace"), F.col("ws").isNotNull().alias("marked"), F.when(inner, F.col("ns.value")).otherwise("").alias("namespace"))
    return files.withColumn("at", folder_of(F.col("file"))).join(f, "at").select("file", "text", "workspace", "marked", "namespace")


def _strings(v: Any) -> Iterator[str]:
    """Strings of a value and of the arrays in it; maps aren't descended into."""
    if isinstance(v, str):
        yield v
    elif isinstance(v, list):
        for x in v:
            yield from _strings(x)


def _row(file: str, n: int, o: dict[str, Any]) -> dict[str, Any]:
    bad = o["__kind"] == "__ParsingError"
    user = {k: v for k, v in o.items() if not k.startswith("__")}
    ref = lambda v: v[3:-2] if isinstance(v, str) and v.startswith("[[#") else v
    return {"file": file, "ordinal": n, "__id": o.get("__id"), "__kind": o["__kind"], "__label": o.get("__label"), "__local_id": o.get("__local_id"), "__parent": ref(o.get("__parent")),
            "__line": o.get("line") if bad else o.get("__line", 1), "__level": o.get("__level"), "data": json.dumps(user, ensure_ascii=False, separators=(",", ":")), "object": json.dumps(o, ensure_ascii=False),
            "texts": [] if bad else [{"field": k, "text": t} for k, v in user.items() for t in _strings(v) if "[[#" in t],
            "refs": [{k: r[k] for k in ("target", "type", "line", "start_col", "end_col", "raw")} for r in o.get("__references", [])], "error": o.get("type") if bad else None}


def parse_files(files: DataFrame, seed: int = 666, keep: tuple[str, ...] = ()) -> DataFrame:
    """The parsed rows (PARSED) of documents (columns file, text), a row for each object and each parse error; null texts have none.

    Documents are dealt evenly to tasks, whatever files they come in; ``keep``: columns that each document's rows get too.
    """
    types = files.sparkSession.createDataFrame([], PARSED)
    names, shape = types.columns, types.schema
    kinds = dict(files.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(shape)
        for b in batches:
            for part in batches_of(b, 1):
                rows, origin = [], []
                for k, (file, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    if text is not None:
                        own = [_row(file, n, o) for n, o in enumerate(parse(text, seed, "full"))]
                        rows += own
                        origin += [k] * len(own)
                if rows:
                    out = pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)
                    more = [part.column(2 + n).take(pa.array(origin)) for n in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*out.columns, *more], [*names, *keep])

    return dealt(files.select("file", "text", *keep), "text").mapInArrow(read, ", ".join([PARSED, *(f"{c} {kinds[c]}" for c in keep)]))


@dataclass
class Workspace:
    """The relations of one load: ``objects`` and ``edges`` as the engine asks them, and what they were made from."""

    files: DataFrame
    rows: DataFrame
    objects: DataFrame
    refs: DataFrame
    edges: DataFrame
    errors: DataFrame


OBJECTS = ["__workspace", "__namespace", "__id", "__global_id", "__kind", "__label", "__local_id", "__file", "__parent", "__line", "__level", "data"]


def objects_of(rows: DataFrame) -> DataFrame:
    """The relation objects of parsed rows (with workspace, namespace): one a key, the last loaded."""
    at_root = F.col("__kind") == "__Workspace"
    o = rows.filter("error is null").select(
        F.when(at_root, "").otherwise(F.col("workspace")).alias("__workspace"), F.when(F.col("__kind").isin("__Workspace", "__Namespace"), "").otherwise(F.col("namespace")).alias("__namespace"),
        "__id", "__kind", "__label", "__local_id", F.col("file").alias("__file"), "__parent", "__line", "__level", "data", F.struct(file_order(F.col("file")), "ordinal").alias("place"))
    one = identity.last_writer(o, "place")
    return one.withColumn("__global_id", identity.global_id(F.col("__workspace"), F.col("__namespace"), F.col("__id"))).select(*OBJECTS)


def edges_of(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """The relation edges: references in strings and arrays of all rows, resolved."""
    at_root = F.col("__kind") == "__Workspace"
    texts = rows.filter("error is null").select(
        F.when(at_root, "").otherwise(F.col("workspace")).alias("__workspace"), F.when(F.col("__kind").isin("__Workspace", "__Namespace"), "").otherwise(F.col("namespace")).alias("__namespace"), "__id",
        F.explode("texts").alias("t")).select("__workspace", "__namespace", "__id", F.col("t.field").alias("field"), F.col("t.text").alias("body"))
    return identity.build_edges(texts, objects, "body", F.col("field"))


def relations(files: DataFrame, root_name: str = "workspace", suffix: str = SUFFIX, seed: int = 666) -> Workspace:
    """A load of documents (columns file, text)."""
    where = placed(files, root_name, suffix)
    rows = written(parse_files(where, seed, ("workspace", "marked", "namespace")), "parsed")
    stray = (F.col("__kind") == "__Workspace") & (F.element_at(F.split("file", "/"), -1) != "readme" + suffix)
    kept = rows.filter(~stray)
    virtual = (where.filter("not marked").select("workspace").distinct()
               .select(F.lit("").alias("__workspace"), F.lit("").alias("__namespace"), F.col("workspace").alias("__id"), F.concat(F.lit("::"), "workspace").alias("__global_id"), F.lit("__Workspace").alias("__kind"),
                       F.lit(None).cast("string").alias("__label"), F.lit(None).cast("string").alias("__local_id"), F.lit("").alias("__file"), F.lit(None).cast("string").alias("__parent"),
                       F.lit(1).cast("bigint").alias("__line"), F.lit(None).cast("bigint").alias("__level"), F.to_json(F.struct(F.col("workspace").alias("name"))).alias("data")))
    unmarked = where.groupBy().agg(F.max(F.col("marked").cast("int")).alias("m")).filter("coalesce(m, 0) = 0")  # a made-up workspace only where none is marked
    objects = objects_of(kept).unionByName(virtual.crossJoin(F.broadcast(unmarked)).drop("m"))
    refs = kept.filter("error is null").select(
        F.when(F.col("__kind") == "__Workspace", "").otherwise(F.col("workspace")).alias("__workspace"), F.when(F.col("__kind").isin("__Workspace", "__Namespace"), "").otherwise(F.col("namespace")).alias("__namespace"),
        "__id", "file", F.explode("refs").alias("r")).select("__workspace", "__namespace", "__id", "file", F.regexp_replace("r.target", "^#", "").alias("raw"), F.col("r.type").alias("type"), "r.line", "r.start_col", "r.end_col")
    wrong = rows.filter(stray).select(F.lit("workspace_in_wrong_file").alias("type"), "workspace", "file", F.col("__line").alias("line"), F.col("__id").alias("object"))
    parse_errors = rows.filter("error is not null").select(F.col("error").alias("type"), "workspace", "file", F.col("__line").alias("line"), F.regexp_replace(F.get_json_object("data", "$.object"), r"^\[\[#|\]\]$", "").alias("object"))
    roots = marks(files, "__Workspace", suffix).select("dir", F.col("value").alias("id"))
    inner = nested(roots).select(F.lit("nested_workspace").alias("type"), F.col("id").alias("workspace"), F.concat("dir", F.lit("/readme" + suffix)).alias("file"), F.lit(1).cast("bigint").alias("line"), F.col("id").alias("object"))
    return Workspace(where, rows, objects, refs, edges_of(kept, objects), parse_errors.unionByName(wrong).unionByName(inner))


def nested(roots: DataFrame) -> DataFrame:
    """dir, id of the marked folders that lie below another marked one."""
    a = roots.filter("dir <> ''").withColumn("file", F.concat(F.regexp_replace("dir", "/?[^/]*$", ""), F.lit("/x")))
    a = a.withColumn("file", F.regexp_replace("file", "^/", ""))
    return nearest(a, roots.select("dir", F.col("dir").alias("value")), "outer").filter("outer is not null").select("dir", "id")


def load(spark: SparkSession, root: str, suffix: str = SUFFIX, ignore: str = IGNORE, seed: int = 666) -> Workspace:
    """All workspaces below a folder."""
    return relations(written(scan(spark, root, suffix, ignore), "files"), root.rstrip("/").rpartition("/")[2] or "workspace", suffix, seed)


def raw_edges(rows: DataFrame) -> DataFrame:
    """Edges as written, before any resolution: source id, field and target text (what graph walks over texts use)."""
    t = rows.filter("error is null").select("__id", F.explode("texts").alias("t"))
    return t.select(F.col("__id").alias("source_id"), F.explode(F.regexp_extract_all("t.text", F.lit(identity.REFERENCE), F.lit(1))).alias("target_id"), F.col("t.field").alias("edge_type"))


def nodes(objects: DataFrame) -> DataFrame:
    """id, kind and label (field ``name``, else the id) of objects."""
    return objects.select(F.col("__id").alias("id"), F.col("__kind").alias("kind"), F.coalesce(F.get_json_object("data", "$.name"), F.col("__id")).alias("label"))


def without_examples(text: str) -> str:
    return "\n".join(outside_examples(text))


def replace_files(old: DataFrame, new: DataFrame, file: str = "__file") -> DataFrame:
    """A relation with the rows of the files in ``new`` replaced by its own."""
    return old.join(new.select(file).distinct(), file, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def index(objects: DataFrame) -> DataFrame:
    """key, name, global ids: objects by id, local id, kind, file and namespace; generated objects only by file."""
    keys = {"by_id": "__id", "by_local_id": "__local_id", "by_kind": "__kind", "by_file": "__file", "by_namespace": "__namespace"}
    generated = F.col("__kind").isin("__Document", "__TextBlock", "__ParsingError")
    each = objects.select("__global_id", F.explode(F.array(*[F.struct(F.lit(k).alias("index"), F.when(~generated if k != "by_file" else F.lit(True), F.col(c)).alias("key")) for k, c in keys.items()])).alias("e"))
    return each.select("e.index", "e.key", "__global_id").filter("key is not null and key <> ''")


def last_rows(rows: DataFrame) -> DataFrame:
    """Parsed rows of each file in order (for ``render.documents``)."""
    return rows.filter("error is null").select(F.col("file").alias("__file"), "ordinal", "object")


def order_number(files: DataFrame) -> DataFrame:
    """file and its number in order; one window over names, not texts."""
    return files.select("file").withColumn("n", F.row_number().over(Window.orderBy(file_order(F.col("file")))))

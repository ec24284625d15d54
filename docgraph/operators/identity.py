"""Global ids, references in texts, typed preambles and resolution to objects.

Relations: objects (see the readme's data model), texts (source object and a
text), refs (source, field, target as written, type), edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REFERENCE = r"\[\[#([^\]]+)\]\]"
_ITEM = r"^- [^:\[\]]+: *\[\[#[^\]]+\]\](, *\[\[#[^\]]+\]\])* *$"


def global_id(ws: Column, ns: Column, local: Column) -> Column:
    return F.concat(F.coalesce(ws, F.lit("")), F.lit(":"), F.coalesce(ns, F.lit("")), F.lit(":"), local)


def strip_reference(c: Column) -> Column:
    return F.regexp_replace(c, r"^\[\[#(.*)\]\]$", "$1")


def last_writer(objects: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row a key: the last loaded."""
    w = Window.partitionBy("__workspace", "__namespace", "__id").orderBy(F.col(ordinal).desc())
    return objects.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def extract_references(texts: DataFrame, text: str, field: str | Column, *keep: str) -> DataFrame:
    """Every reference of a text with its type: that of its preamble item, else the field's name.

    A preamble is a leading list, up to the first blank line, all items of
    which are ``- type: [[#ref]](, [[#ref]])*``; if one is not, there is none.
    Later references to a target of the preamble are left out.
    """
    own = F.lit(field) if isinstance(field, str) else field
    head = F.split(F.col(text), "\n\n")[0]
    items = F.split(F.trim(head), "\n")
    typed = F.forall(items, lambda x: x.rlike(_ITEM))
    found = lambda c: F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1))
    pre = F.when(typed, F.flatten(F.transform(items, lambda x: F.transform(found(x), lambda r: F.struct(r.alias("target"), F.regexp_extract(x, r"^- ([^:\[\]]+):", 1).alias("edge_type"))))))
    pre = F.coalesce(pre, F.array().cast("array<struct<target:string,edge_type:string>>"))
    rest = F.when(typed, F.substring(F.col(text), F.length(head) + 1, F.length(F.col(text)))).otherwise(F.col(text))
    out = texts.filter(F.col(text).contains("[[#")).select(*keep, own.alias("_own"), pre.alias("_pre"), found(rest).alias("_rest"))
    out = out.withColumn("_other", F.transform(F.filter("_rest", lambda r: ~F.exists("_pre", lambda p: p["target"] == r)), lambda r: F.struct(r.alias("target"), F.col("_own").alias("edge_type"))))
    return out.select(*keep, F.col("_own").alias("source_field"), F.explode(F.concat("_pre", "_other")).alias("_r")).select(*keep, "source_field", F.col("_r.target").alias("raw"), F.col("_r.edge_type").alias("edge_type"))


def resolve(refs: DataFrame, objects: DataFrame, ref: str = "raw") -> DataFrame:
    """``refs`` (with __workspace, __namespace) and target_id, target_field: null and '' where nothing fits.

    Candidates in order: same workspace and namespace; same workspace; any;
    the one object of the workspace and namespace with that local id.  What
    no whole id resolves is tried without its last dotted part, which is then
    the field.  A qualified id (ns:id) counts by its last part.

    Each object gives up to two keyed rows, its id and its local id; the ids of
    anywhere and of the workspace are reduced to their first object before the
    join, so that an id that is common can't multiply.
    """
    o = objects.select("__workspace", "__namespace", "__id", "__local_id", "__global_id")
    first = F.min("__global_id").alias("gid")
    by_ns = o.groupBy("__workspace", "__namespace", "__id").agg(first)
    by_ws = o.groupBy("__workspace", "__id").agg(first)
    by_id = o.groupBy("__id").agg(first)
    by_local = o.filter("__local_id is not null").groupBy("__workspace", "__namespace", "__local_id").agg(first, F.count(F.lit(1)).alias("n")).filter("n = 1")
    keyed = refs.withColumn("_id", F.element_at(F.split(F.col(ref), ":"), -1))
    wanted = keyed.select("__workspace", "__namespace", "_id").distinct()
    dotted = F.col("_id").contains(".")
    tries = wanted.select("__workspace", "__namespace", "_id", F.col("_id").alias("t"), F.lit("").alias("field")).union(
        wanted.filter(dotted).select("__workspace", "__namespace", "_id", F.regexp_extract("_id", r"^(.*)\.[^.]*$", 1).alias("t"), F.regexp_extract("_id", r"\.([^.]*)$", 1).alias("field")))
    hit = (tries.join(by_ns.select("__workspace", "__namespace", F.col("__id").alias("t"), F.col("gid").alias("g1")), ["__workspace", "__namespace", "t"], "left")
           .join(by_ws.select("__workspace", F.col("__id").alias("t"), F.col("gid").alias("g2")), ["__workspace", "t"], "left")
           .join(by_id.select(F.col("__id").alias("t"), F.col("gid").alias("g3")), ["t"], "left")
           .join(by_local.select("__workspace", "__namespace", F.col("__local_id").alias("t"), F.col("gid").alias("g4")), ["__workspace", "__namespace", "t"], "left")
           .withColumn("g", F.coalesce("g1", "g2", "g3", "g4")).filter("g is not null"))
    best = hit.groupBy("__workspace", "__namespace", "_id").agg(F.min_by(F.struct("g", "field"), F.length("field")).alias("b"))
    return (keyed.join(best, ["__workspace", "__namespace", "_id"], "left")
            .select(*[F.col(c) for c in refs.columns], F.col("b.g").alias("target_id"), F.coalesce("b.field", F.lit("")).alias("target_field")))


def build_edges(texts: DataFrame, objects: DataFrame, text: str = "body", field: str | Column = "body") -> DataFrame:
    """Resolved edges of the references in texts: dangling ones give none, repeated ones one."""
    refs = extract_references(texts, text, field, "__workspace", "__namespace", "__id")
    r = resolve(refs, objects).filter("target_id is not null")
    return r.select(global_id(F.col("__workspace"), F.col("__namespace"), F.col("__id")).alias("source_id"), "source_field", "target_id", "edge_type", "target_field", "__workspace").dropDuplicates()


def data_texts(objects: DataFrame) -> DataFrame:
    """__workspace, __namespace, __id, field, body: the strings of the objects' ``data`` that have references, those in arrays too; maps aren't descended into."""
    each = objects.select("__workspace", "__namespace", "__id", F.try_parse_json("data").alias("v")).lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant("value")
    texts = F.when(kind == "STRING", F.array(F.col("value").cast("string"))).when(kind.startswith("ARRAY<") & ~kind.contains("OBJECT"), F.array(F.to_json("value")))
    return each.select("__workspace", "__namespace", "__id", F.col("key").alias("field"), F.explode(texts).alias("body")).filter(F.col("body").contains("[[#"))


def data_references(objects: DataFrame) -> DataFrame:
    """References of the objects' ``data``, by field."""
    return extract_references(data_texts(objects), "body", F.col("field"), "__workspace", "__namespace", "__id")


def edges_of_data(objects: DataFrame) -> DataFrame:
    """Resolved edges of the references in the objects' ``data``."""
    return build_edges(data_texts(objects), objects, "body", F.col("field"))

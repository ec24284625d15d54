"""Integrity checks: dangling, ambiguous and duplicate ids, missing parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.operators.identity import resolve


def broken_links(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References that nothing resolves, with a hint where another namespace has the id."""
    bad = resolve(refs, objects).filter("target_id is null").drop("target_id", "target_field")
    other = objects.groupBy(F.col("__id").alias("hid")).agg(F.min("__global_id").alias("hint"))
    return bad.join(other, F.element_at(F.split("raw", r"[.:]"), -1) == F.col("hid"), "left").drop("hid")


def duplicate_ids(objects: DataFrame) -> DataFrame:
    """Ids that objects of several files or kinds share; groups with generated objects don't count."""
    g = objects.groupBy("__workspace", "__namespace", "__id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("__file").alias("files"), F.count_distinct("__kind").alias("kinds"),
        F.max(F.col("__kind").isin("__Document", "__TextBlock").cast("int")).alias("generated"))
    return g.filter("n > 1 and (files > 1 or kinds > 1) and coalesce(generated, 0) = 0").drop("generated")


def duplicate_rows(objects: DataFrame) -> DataFrame:
    """Every object but the first of each duplicate id (see duplicate_ids), with the first and the number of all."""
    d = duplicate_ids(objects).select("__workspace", "__namespace", "__id")
    w = Window.partitionBy("__workspace", "__namespace", "__id").orderBy("__file", "__line", "__kind")
    place = F.concat_ws(":", F.coalesce("__file", F.lit("")), F.col("__line").cast("string"))
    o = objects.join(d, ["__workspace", "__namespace", "__id"], "left_semi").withColumns({"nth": F.row_number().over(w), "first": F.first(place).over(w)})
    return o.filter("nth > 1").select("__workspace", "__namespace", "__id", "__kind", "__file", "__line", "nth", "first")


def ambiguous_locals(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References that no id resolves and that several objects of their own namespace have as local id."""
    keyed = refs.withColumn("_id", F.element_at(F.split("raw", ":"), -1))
    local = objects.filter("__local_id is not null").groupBy("__workspace", "__namespace", F.col("__local_id").alias("_id")).agg(F.count(F.lit(1)).alias("candidates")).filter("candidates > 1")
    many = keyed.select("__workspace", "__namespace", "_id").distinct().join(local, ["__workspace", "__namespace", "_id"])  # keys, however many references each has
    ids = objects.select("__workspace", F.col("__id").alias("_id")).join(many.select("__workspace", "_id").distinct(), ["__workspace", "_id"], "left_semi")
    bad = many.join(ids, ["__workspace", "_id"], "left_anti")
    return keyed.join(bad, ["__workspace", "__namespace", "_id"]).select(*refs.columns, "candidates")


def candidates_of(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """refs with state ('broken', 'resolved', 'ambiguous') and the number and first of the objects they may mean.

    A part before the id is a kind if in capitals, else a namespace.
    """
    parts = F.split("raw", ":")
    head = F.when(F.size(parts) > 1, F.element_at(parts, -2))
    upper = head.rlike("^[A-Z]")
    keyed = refs.withColumns({"_id": F.element_at(parts, -1), "_kind": F.when(upper, head), "_ns": F.when(F.size(parts) == 3, parts[0]).when(~upper, head)})
    o = objects.select(F.col("__id").alias("_id"), F.col("__kind").alias("ok"), F.col("__namespace").alias("on"), "__global_id").distinct()
    fits = (F.col("_kind").isNull() | (F.col("_kind") == F.col("ok"))) & (F.col("_ns").isNull() | (F.col("_ns") == F.col("on")))
    wanted = keyed.select("_id", "_kind", "_ns").distinct()
    hit = (wanted.join(o, "_id").filter(fits).groupBy("_id", F.coalesce("_kind", F.lit("")).alias("hk"), F.coalesce("_ns", F.lit("")).alias("hn")).agg(F.count(F.lit(1)).alias("n"), F.min("__global_id").alias("first")))
    j = keyed.withColumns({"hk": F.coalesce("_kind", F.lit("")), "hn": F.coalesce("_ns", F.lit(""))}).join(hit, ["_id", "hk", "hn"], "left")
    state = F.when(F.col("n").isNull(), "broken").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return j.select(*refs.columns, state.alias("state"), F.coalesce("n", F.lit(0)).alias("candidates"), "first")


def diagnostics(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """One row a reference that is wrong: code, severity, message; REF001 (error) resolves to nothing, REF002 (warning) to several local ids."""
    keys = ["__workspace", "__namespace", "raw"]
    unresolved = resolve(refs.select(*keys).distinct(), objects).filter("target_id is null").select(*keys)
    local = ambiguous_locals(unresolved, objects).select(*keys, F.lit(True).alias("many"))
    elsewhere = objects.filter("__local_id is not null and __namespace <> ''").groupBy(F.col("__local_id").alias("_id")).agg(F.min(F.concat(F.lit("[[#"), "__namespace", F.lit(":"), "__id", F.lit("]]"))).alias("hint"))
    bad = refs.join(unresolved, keys, "left_semi").join(local, keys, "left").withColumn("_id", F.element_at(F.split("raw", "[.:]"), -1)).join(elsewhere, "_id", "left")
    many = F.coalesce("many", F.lit(False))
    text = F.when(many, F.concat(F.lit("ambiguous reference [[#"), "raw", F.lit("]]"))).otherwise(F.concat(F.lit("broken reference [[#"), "raw", F.lit("]]"), F.coalesce(F.concat(F.lit(". Did you mean "), "hint", F.lit("?")), F.lit(""))))
    return bad.select(*refs.columns, F.when(many, "REF002").otherwise("REF001").alias("code"), F.when(many, "warning").otherwise("error").alias("severity"), text.alias("message"))


def ambiguous_references(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References whose id several objects of the workspace have, none of them in the reference's own namespace."""
    keyed = refs.withColumn("_id", F.element_at(F.split("raw", ":"), -1))
    c = objects.select("__workspace", F.col("__namespace").alias("ns"), F.col("__id").alias("_id"), "__global_id")
    j = keyed.join(c, ["__workspace", "_id"]).groupBy(*refs.columns).agg(F.count(F.lit(1)).alias("candidates"), F.max((F.col("ns") == F.col("__namespace")).cast("int")).alias("own"))
    return j.filter("candidates > 1 and own = 0").drop("own")


def ambiguous_fields(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Dotted references that name an object and, as well, a field of another."""
    dotted = refs.filter(F.col("raw").contains(".")).withColumns({"base": F.regexp_extract("raw", r"^(.*)\.[^.]*$", 1), "field": F.regexp_extract("raw", r"\.([^.]*)$", 1)})
    whole = objects.filter(F.col("__id").contains(".")).select(F.col("__id").alias("raw"))
    fields = objects.select(F.col("__id").alias("of"), F.json_object_keys("data").alias("keys"))  # one row an object; a semi join takes no row twice
    return dotted.join(whole, "raw", "left_semi").join(fields, (F.col("base") == F.col("of")) & F.array_contains("keys", F.col("field")), "left_semi").select(*refs.columns)


def broken_parents(objects: DataFrame) -> DataFrame:
    """Objects whose parent isn't there."""
    ids = objects.select(F.col("__id").alias("p"))  # not told apart: an anti join takes no row twice, and no task has to hold them
    return objects.filter("__parent is not null").join(ids, F.col("__parent") == F.col("p"), "left_anti").select("__global_id", "__parent")


def dotted_parents(objects: DataFrame) -> DataFrame:
    """Objects with dotted ids and the object their prefix names, if any."""
    o = objects.filter(F.col("__id").contains(".")).select("__global_id", "__workspace", F.regexp_extract("__id", r"^(.*)\.[^.]*$", 1).alias("prefix"))
    p = objects.select("__workspace", F.col("__id").alias("prefix"), F.col("__global_id").alias("parent_id"))
    return o.join(p, ["__workspace", "prefix"], "left").select("__global_id", "prefix", "parent_id")


def nested_workspaces(roots: DataFrame) -> DataFrame:
    """Workspace roots (column root) that lie in another."""
    a, b = roots.select(F.col("root").alias("inner")), roots.select(F.col("root").alias("outer"))
    w = Window.partitionBy("inner").orderBy(F.length("outer").desc())
    return a.join(b, F.col("inner").startswith(F.concat("outer", F.lit("/")))).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")

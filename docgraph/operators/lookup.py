"""Finding objects by what is written: resolution of one reference, cards, outlines, symbols, completion, trees by namespace and file."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENERATED = ("__Document", "__TextBlock", "__ParsingError")
#: Kinds of symbols for editors, by kind of object.
SYMBOLS = {"__Workspace": "Module", "__Namespace": "Namespace", "__Document": "File", "__TextBlock": "String", "__Object": "Object"}


def normalised(ref: str) -> str:
    """A reference without brackets and hash."""
    return re.sub(r"^\[\[|\]\]$", "", ref.strip()).lstrip("#").strip()


def namespace_in(ref: str) -> str | None:
    """The namespace a reference names: its first part, unless that is a kind (in capitals)."""
    first, colon, _ = ref.partition(":")
    return first if colon and first and not first[0].isupper() else None


def candidates(objects: DataFrame, ref: str, namespace: str = "") -> DataFrame:
    """Objects a reference may mean, with their rank: 1 the whole dotted id, 2 the id after the last colon (else dot), 3 the local id in the namespace.

    All ranks come from one pass over the objects.
    """
    ref = normalised(ref)
    body = ref.rsplit("#", 1)[-1]
    last = body.rsplit(":", 1)[-1] if ":" in body else body.rsplit(".", 1)[-1]
    where = namespace_in(ref) or namespace
    same = F.coalesce("__namespace", F.lit("")) == where
    rank = (F.when((F.col("__id") == body) & F.lit(":" not in body), 1).when(F.col("__id") == last, 2).when((F.col("__local_id") == last) & same, 3))
    return objects.withColumn("rank", rank).filter("rank is not null")


def resolve(objects: DataFrame, ref: str, namespace: str = "") -> DataFrame:
    """state ('resolved', 'ambiguous', 'not-found'), the object of the best rank, and a hint: of what has the local id elsewhere.

    One row.  Several objects with one id are one choice (the reference's own
    namespace first, then the least global id); several with one local id are ambiguous.
    """
    found = candidates(objects, ref, namespace)
    where = namespace_in(normalised(ref)) or namespace
    at = F.struct("rank", (F.coalesce("__namespace", F.lit("")) != where).cast("int"), "__global_id")
    best = found.agg(F.min("rank").alias("r"), F.min_by(F.struct("__global_id", "__id", "__kind", "__namespace", "__workspace", "__file", "__line", "__label", "__parent", "data"), at).alias("o"),
                     F.count(F.when(F.col("rank") == 3, 1)).alias("locals"))
    body = normalised(ref)
    last = re.split(r"[:.]", body)[-1]
    elsewhere = objects.filter((F.col("__local_id") == last) & (F.coalesce("__namespace", F.lit("")) != "")).agg(F.min(F.concat(F.lit("[[#"), "__namespace", F.lit(":"), "__id", F.lit("]]"))).alias("hint"))
    state = F.when(F.col("r").isNull(), "not-found").when((F.col("r") == 3) & (F.col("locals") > 1), "ambiguous").otherwise("resolved")
    o = F.when(state == "resolved", F.col("o"))
    return best.crossJoin(F.broadcast(elsewhere)).select(state.alias("state"), F.when(state == "not-found", F.col("hint")).alias("hint"), o.alias("o")).select("state", "hint", "o.*")


def locate(objects: DataFrame, ref: str, namespace: str = "") -> DataFrame:
    """file, line, id, kind, namespace of what a reference means; no row if nothing or several."""
    return resolve(objects, ref, namespace).filter("state = 'resolved'").select(F.col("__file").alias("file"), F.col("__line").alias("line"), F.col("__id").alias("id"), F.col("__kind").alias("kind"), F.col("__namespace").alias("namespace"))


def value_type(value: Column) -> Column:
    """reference, string, number, boolean, array, object or null, of a value of type variant."""
    t = F.schema_of_variant(value)
    return (F.when(value.isNull() | (t == "VOID"), "null").when(t == "STRING", F.when(value.cast("string").contains("[[#"), "reference").otherwise("string")).when(t == "BOOLEAN", "boolean")
            .when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").otherwise("number"))


def describe(objects: DataFrame, ref: str, namespace: str = "") -> dict[str, Any]:
    """The card of an object, or a field's value and type."""
    ref = normalised(ref)
    if not ref:
        return failure("invalid-argument", "ref must not be empty")
    row = resolve_row(objects, ref, namespace)
    dotted = ref.rpartition(".") if "." in ref and ":" not in ref else None
    if dotted and row and row["__id"] != ref and dotted[0] and dotted[2]:  # a whole dotted id goes before a field; a field before the last part alone
        owner = resolve_row(objects, dotted[0], namespace)
        if owner:
            field = _field(owner, dotted[0], dotted[2])
            if field["success"]:
                return field
    if row:
        import json

        return {"success": True, "id": row["__id"], "kind": row["__kind"], "file": row["__file"], "line": row["__line"], "namespace": row["__namespace"], "workspace": row["__workspace"],
                "parent": row["__parent"] or "", "fields": json.loads(row["data"] or "{}")}
    if dotted:
        owner = resolve_row(objects, dotted[0], namespace)
        if owner:
            return _field(owner, dotted[0], dotted[2])
    return failure("not-found", f"no object matching '{ref}' found")


def resolve_row(objects: DataFrame, ref: str, namespace: str = "") -> dict[str, Any] | None:
    row = resolve(objects, ref, namespace).first()
    return row.asDict() if row and row["state"] == "resolved" else None


def failure(code: str, message: str) -> dict[str, Any]:
    return {"success": False, "error": {"code": code, "message": message}}


def _field(owner: dict[str, Any], id_: str, name: str) -> dict[str, Any]:
    import json

    fields = json.loads(owner["data"] or "{}")
    if name.startswith("__") or name not in fields:
        return failure("not-found", f"field '{name}' " + ("is a system field" if name.startswith("__") else f"not found on object '{id_}'"))
    v = fields[name]
    kind = ("null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, int | float) else "array" if isinstance(v, list) else "object" if isinstance(v, dict)
            else "reference" if "[[#" in v else "string")
    return {"success": True, "object_id": id_, "field": name, "value": v, "type": kind}


def field_types(objects: DataFrame) -> DataFrame:
    """__global_id, field, type of every field of every object."""
    return (objects.select("__global_id", F.try_parse_json("data").alias("v")).lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("v").outer()))
            .select("__global_id", F.col("key").alias("field"), value_type(F.col("value")).alias("type")))


def outline(objects: DataFrame, file: str) -> DataFrame:
    """Objects of a file in order, each with its nearest parent there and its depth by headings."""
    o = objects.filter((F.col("__file") == file) & ~F.coalesce(F.col("__kind"), F.lit("")).isin(*GENERATED))
    ids = o.select(F.col("__id").alias("p")).distinct()
    return o.join(ids, F.col("__parent") == F.col("p"), "left").select(F.col("__id").alias("id"), F.coalesce("__label", "__id").alias("name"), symbol(F.col("__kind")).alias("symbol"), "__kind", "__line", "__level", F.col("p").alias("parent"))


def symbol(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv]), F.coalesce(kind, F.lit(""))), F.lit("Class"))


def symbols(objects: DataFrame, text: str = "", most: int = 100) -> DataFrame:
    """Symbols of the workspace whose id or label has the text, by name; the first ``most`` (a report for a picker)."""
    t = F.lower(F.lit(text))
    name = F.coalesce(F.nullif(F.col("__label"), F.lit("")), F.col("__id"))
    hit = F.lower("__id").contains(t) | F.lower(F.coalesce("__label", F.lit(""))).contains(t)
    o = objects.filter(~F.coalesce(F.col("__kind"), F.lit("")).isin(*GENERATED) & hit)
    return o.select(name.alias("name"), "__global_id", symbol(F.col("__kind")).alias("symbol"), "__file", "__line").orderBy("name", "__global_id").limit(most)


def complete_ids(objects: DataFrame, kind: str | None = None) -> DataFrame:
    """Ids to offer, one row each with kind and label, without generated ones."""
    o = objects.filter(~F.col("__id").rlike("^(doc|text)_"))
    o = o if kind is None else o.filter(F.col("__kind") == kind)
    return o.groupBy("__id").agg(F.min_by(F.struct("__kind", "__label"), "__global_id").alias("o")).select("__id", "o.__kind", "o.__label")


def complete_kinds(objects: DataFrame) -> DataFrame:
    """Kinds to offer: those of users, and __Object."""
    return objects.filter(~F.col("__kind").startswith("__")).select("__kind").union(objects.sparkSession.createDataFrame([("__Object",)], "__kind string")).distinct()


def hover(objects: DataFrame, ref: str, namespace: str = "") -> str | None:
    """A short Markdown card."""
    row = resolve_row(objects, ref, namespace)
    return row and f"**{row['__label'] or row['__id']}** `{row['__kind']}`\n\n`{row['__global_id']}` {row['__file']}:{row['__line']}"


def by_kind(objects: DataFrame) -> DataFrame:
    """kind, objects, the ids in order, one row a kind and file (so that no row grows with the kind)."""
    return objects.groupBy("__kind", "__file").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("__id")), ",").alias("ids"))


def namespace_tree(objects: DataFrame) -> DataFrame:
    """workspace, namespace, kind, objects and, of them, top-level ones: those without a parent that is there.

    What stands below another object counts in its group but isn't top level.
    """
    o = objects.filter(~F.coalesce(F.col("__kind"), F.lit("")).isin(*GENERATED))
    ids = o.select(F.col("__id").alias("p")).distinct()
    placed = o.join(ids, F.col("__parent") == F.col("p"), "left")
    return placed.groupBy("__workspace", "__namespace", "__kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("p").isNull(), 1)).alias("top"))


def file_tree(objects: DataFrame) -> DataFrame:
    """workspace, file, objects, kinds, first label by level and line."""
    o = objects.filter(~F.coalesce(F.col("__kind"), F.lit("")).isin(*GENERATED))
    return o.groupBy("__workspace", "__file").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("__kind")), ",").alias("kinds"), F.min_by("__label", F.struct("__level", "__line", "__id")).alias("label"))


def nested_tree(nodes: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Nodes (id, parent, place) of one page as nested lists."""
    below: dict[str | None, list[dict]] = {}
    ids = {n["id"] for n in nodes}
    for n in sorted(nodes, key=lambda n: n["place"]):
        below.setdefault(n["parent"] if n["parent"] in ids else None, []).append(n)

    def of(parent: str | None, seen: frozenset) -> list[dict[str, Any]]:
        return [{**n, "children": of(n["id"], seen | {n["id"]})} for n in below.get(parent, []) if n["id"] not in seen]

    return of(None, frozenset())


def page_hints(hints: DataFrame, objects: DataFrame, file: str) -> DataFrame:
    """Hints (key, label, kind, file, score, id) for a page: those of its objects by global id and of its fields by ``field:<name>@<file>``."""
    ids = objects.filter(F.col("__file") == file).select(F.col("__global_id").alias("key"))
    field = F.regexp_extract("key", r"^field:([^@]+)@(.+)$", 1)
    on_page = F.regexp_extract("key", r"^field:([^@]+)@(.+)$", 2) == file
    return hints.join(ids, "key", "left_semi").withColumn("field", F.lit(None).cast("string")).unionByName(hints.filter(on_page).withColumn("field", field))


def link_targets(refs: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """refs (source_id, raw) with the file and id they link to: by an edge of the source first, else by the id alone."""
    key = F.element_at(F.split(F.element_at(F.split("raw", ":"), -1), "#"), -1)
    place = objects.select(F.col("__global_id").alias("g"), F.col("__id").alias("tid"), F.col("__file").alias("tfile"))
    by_edge = (edges.select("source_id", F.col("target_id").alias("g")).distinct().join(place, "g").groupBy("source_id", "tid").agg(F.min(F.struct("g", "tfile")).alias("e")))
    by_id = place.groupBy("tid").agg(F.min(F.struct("g", "tfile")).alias("i"))
    r = refs.withColumn("tid", key)
    return r.join(by_edge, ["source_id", "tid"], "left").join(by_id, "tid", "left").select(*refs.columns, F.coalesce("e.g", "i.g").alias("target_id"), F.coalesce("e.tfile", "i.tfile").alias("file"))


def rename_edits(refs: DataFrame, objects: DataFrame, old: str, new: str) -> DataFrame:
    """The rename plan with places: file, line, old text, new text, in their order. ``refs``: file, line, raw of every reference."""
    if not re.fullmatch(r"[\w.\-]+", new):
        raise ValueError(f"{new!r} isn't an id")
    key = F.element_at(F.split("raw", ":"), -1)
    bounded = rf"(^|[^\w.-])\Q{old}\E(?=$|[^\w-])"
    definition = objects.filter(F.col("__id") == old).select(F.col("__file").alias("file"), F.col("__line").alias("line"), F.lit("definition").alias("what"), F.col("__id").alias("old_text"), F.lit(new).alias("new_text"))
    hit = refs.filter((key == old) | key.startswith(old + "."))
    edits = hit.select("file", "line", F.lit("reference").alias("what"), F.col("raw").alias("old_text"), F.regexp_replace("raw", bounded, f"$1{new}").alias("new_text"))
    return definition.unionByName(edits.distinct(), allowMissingColumns=True).orderBy("file", "line", "old_text")


def first_window(objects: DataFrame) -> DataFrame:
    """The first object of every file, by level and line."""
    w = Window.partitionBy("__file").orderBy("__level", "__line", "__id")
    return objects.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")

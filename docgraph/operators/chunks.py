"""Chunks of objects for search: child chunks of long fields, a parent of the short ones, or one of both."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.storage import batches_of, dealt, written

SCHEMA = "chunk_id string, object_id string, object_kind string, chunk_type string, source_file string, text string, text_hash string, parent_chunk_id string"
_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
SECTION = re.compile(r"^(?:#{1,4}\s+.+|[A-Z][A-Za-z /()-]+:$|\*\*[^*]+\*\*:?$|[A-Z][a-z]+ [a-z]+ \([^)]+\):$)", re.MULTILINE)


@dataclass(frozen=True)
class Sizes:
    """least: characters of a chunk; long: of a field that has its own; most: of a chunk before it is split."""

    least: int = 30
    long: int = 50
    most: int = 3000


def slug(header: str) -> str:
    plain = re.sub(r"\([^)]*\)", "", re.sub(r"[#*`]", "", header).rstrip(":"))
    return re.sub(r"[^a-z0-9]+", "_", plain.lower().strip()).strip("_")[:40] or "section"


def _packed(parts: list[str], glue: str, most: int) -> list[str]:
    """Parts joined while they fit."""
    out: list[str] = []
    for p in parts:
        if out and out[-1] and len(out[-1]) + len(p) + len(glue) <= most:
            out[-1] += glue + p
        elif out and not out[-1]:
            out[-1] = p
        else:
            out.append(p)
    return [x for x in out if x.strip()]


def by_paragraphs(text: str, most: int) -> list[tuple[str, str]]:
    """Paragraphs packed up to ``most`` characters; one that is longer goes by lines (a longer line stays whole)."""
    out = []
    for n, part in enumerate(_packed(text.split("\n\n"), "\n\n", most)):
        part = part.strip()
        if len(part) <= most:
            out.append((f"part_{n}", part))
        else:
            out += [(f"part_{n}_{i}", x.strip()) for i, x in enumerate(_packed(part.split("\n"), "\n", most))]
    return out


def by_sections(text: str, most: int) -> list[tuple[str, str]]:
    """(label, text): at headings and lines that look like them, short ones merged (below a quarter of ``most``), long ones by paragraphs."""
    if len(text) <= most:
        return [("", text)]
    cuts = [m.start() for m in SECTION.finditer(text)]
    if not cuts:
        return by_paragraphs(text, most)
    parts = [("preamble", text[:cuts[0]].strip())] + [(slug(text[a:b].strip().split("\n")[0].strip()), text[a:b].strip()) for a, b in zip(cuts, [*cuts[1:], len(text)]) if text[a:b].strip()]
    merged: list[tuple[str, str]] = []
    for label, part in (p for p in parts if p[1]):
        if merged and len(merged[-1][1]) < most // 4 and len(merged[-1][1]) + len(part) + 2 <= most:
            merged[-1] = (merged[-1][0], merged[-1][1] + "\n\n" + part)
        else:
            merged.append((label, part))
    out = []
    for label, part in merged:
        if len(part) <= most:
            out.append((label, part))
        else:
            out += [(label if i == 0 else f"{label}_{i}", x) for i, (_, x) in enumerate(by_paragraphs(part, most))]
    return out


def text_fields(fields: dict[str, Any], comments: list[dict[str, str]]) -> dict[str, str]:
    """Fields with text, and comments put to the field they follow (those after the heading are a description)."""
    out = {k: v for k, v in fields.items() if not k.startswith("__") and isinstance(v, str) and v.strip()}
    groups: dict[str, list[str]] = {}
    for c in comments or []:
        if c.get("content", "").strip():
            groups.setdefault(c.get("after", ""), []).append(c["content"])
    for anchor, own in groups.items():
        name = "__description" if anchor == "__self" else anchor
        out[name] = "\n\n".join([out[name], *own] if name in out else own)
    return out


def id_variants(id_: str) -> str:
    """An id and, of letters with a number, its form with a hyphen."""
    m = re.fullmatch(r"([a-zA-Z]+)(\d+)", id_)
    return f"{id_} {m[1].upper()}-{m[2]}" if m else id_


def chunks_of(o: dict[str, Any], sizes: Sizes = Sizes(), suffix: str = ".qmd.md") -> list[dict[str, Any]]:
    """Chunks of one object (a dict with __id, __kind, __label, __file, __global_id, fields and __comments)."""
    id_, kind, label, file = o.get("__id") or "", o.get("__kind") or "", o.get("__label") or "", o.get("__file") or ""
    whole = o.get("__global_id") or f"::{id_}"
    base = f"{whole}@{file.replace('/', '_').replace(suffix, '')}" if kind.startswith("__") and file else whole
    fields = text_fields(o, o.get("__comments") or [])
    if not fields:
        return []
    header = "" if kind.startswith("__") else (f"{kind}: {label}" if label else kind) + f"\nID: {id_variants(id_)}"
    spaces = [p for p in whole.split("::")[:-1] if p]
    context = f"[{' > '.join(spaces)}]" if spaces else ""

    def chunk(name: str, type_: str, text: str, parent: str | None = None) -> dict[str, Any]:
        return dict(zip(_NAMES, (name, whole, kind, type_, file, text, hashlib.sha256(text.encode()).hexdigest()[:16], parent)))

    out = []
    long, short = ({k: v for k, v in fields.items() if (len(v) >= sizes.long) == want} for want in (True, False))
    for name, v in long.items():
        text = (context + "\n" if context else "") + (v if name in ("content", "__description") else f"{name}: {v}")
        if len(text) < sizes.least:
            continue
        parts = by_sections(text, sizes.most)
        if len(parts) == 1:
            parts = [("", text)]
        out += [chunk(f"{base}:{name}" + (f":{part}" if part else ""), "child", t, base) for part, t in parts if len(t) >= sizes.least]
    plain = short["content"] if not long and kind == "__TextBlock" and list(short) == ["content"] else "\n".join(f"{k}: {v}" for k, v in short.items())
    text = "\n".join(x for x in (header, context, plain) if x)
    if len(text) >= sizes.least:
        out.append(chunk(base, "parent" if long else "combined", text))
    return out


def extract(objects: DataFrame, comments: DataFrame | None = None, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of a relation of objects. ``comments``: __global_id and comments (JSON list), if there are any."""
    o = objects.select("__id", "__kind", "__label", "__file", "__global_id", "data")
    o = o.withColumn("comments", F.lit(None).cast("string")) if comments is None else o.join(comments.select("__global_id", "comments"), "__global_id", "left").select(*o.columns, "comments")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in _NAMES])
        for b in (part for whole in batches for part in batches_of(whole, 5, 6)):
            rows = [c for r in b.to_pylist() for c in chunks_of({**json.loads(r["data"] or "{}"), **{k: r[k] for k in ("__id", "__kind", "__label", "__file", "__global_id")}, "__comments": json.loads(r["comments"] or "[]")}, sizes)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return (o if comments is None else dealt(written(o, "objects"), "data")).mapInArrow(read, SCHEMA)  # what is joined comes in few partitions


def comments_of(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """__global_id, comments of the parsed rows' objects."""
    c = rows.select(F.col("file").alias("__file"), "__id", F.get_json_object("object", "$.__comments").alias("comments")).filter("comments is not null")
    return c.join(objects.select("__file", "__id", "__global_id"), ["__file", "__id"]).groupBy("__global_id").agg(F.max("comments").alias("comments"))


def delete(store: DataFrame, gone: DataFrame) -> DataFrame:
    """A store of chunks without those of ``gone`` (chunk_id) and without the children of a parent that goes."""
    ids = gone.select("chunk_id").distinct()
    return store.join(ids, "chunk_id", "left_anti").join(ids.select(F.col("chunk_id").alias("parent_chunk_id")), "parent_chunk_id", "left_anti").select(*store.columns)


def of_model(store: DataFrame, model: str) -> DataFrame:
    """The chunks embedded by a model."""
    return store.filter(F.col("model_id") == model)


def parent_context(hits: DataFrame, store: DataFrame) -> DataFrame:
    """Hits (chunk_id) with their chunk's text and its parent's."""
    parents = store.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("text").alias("parent_text"))
    return hits.join(store.select("chunk_id", "object_id", "parent_chunk_id", "text"), "chunk_id").join(parents, "parent_chunk_id", "left").select(*hits.columns, "object_id", "text", "parent_text")


def full_context(objects: DataFrame, store: DataFrame) -> DataFrame:
    """object_id and all its chunks' texts, the parent first, of the objects asked for (object_id)."""
    own = store.join(objects.select("object_id").distinct(), "object_id", "left_semi")
    place = F.struct(F.when(F.col("chunk_type") == "child", 1).otherwise(0).alias("later"), "chunk_id", "text")
    return own.groupBy("object_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["text"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("chunks"))


def explicit_edges(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """source_id, target_id, source_field of references for search: by namespace and id, then by id; the last of several counts."""
    o = objects.select("__namespace", "__id", "__global_id")
    by_ns, by_id = o.groupBy("__namespace", "__id").agg(F.max("__global_id").alias("g1")), o.groupBy("__id").agg(F.max("__global_id").alias("g2"))
    key = F.element_at(F.split("raw", ":"), -1)
    r = refs.withColumns({"k": key, "n": F.when(F.col("raw").contains(":"), F.element_at(F.split("raw", ":"), -2)).otherwise(F.col("__namespace"))})
    j = r.join(by_ns.select(F.col("__namespace").alias("n"), F.col("__id").alias("k"), "g1"), ["n", "k"], "left").join(by_id.select(F.col("__id").alias("k"), "g2"), "k", "left")
    source = F.concat("__workspace", F.lit(":"), "__namespace", F.lit(":"), "__id")
    return j.select(source.alias("source_id"), F.coalesce("g1", "g2").alias("target_id"), "source_field").filter("target_id is not null and target_id <> source_id").distinct()

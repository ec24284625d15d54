"""Documents written back from their objects, and results as text: tables, Markdown, HTML.

``rebuild`` is the inverse of ``parse``: parsing what it gives yields the same
objects.  ``write_documents`` does it for a whole relation, file by file, in as
many tasks as there are; a file's own rows are all it holds at a time.
"""

from __future__ import annotations

import html
import itertools
import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from docgraph.storage import batches_of, dealt

_HINTS = {"multiline_text": "text", "markdown_list": "array", "yaml_object": "yaml", "json_object": "json", "map": "map"}


def shown(v: Any) -> str:
    """A value as a field has it."""
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, list):
        return "[" + ", ".join(map(shown, v)) + "]"
    if isinstance(v, str):
        return v if v == v.strip() else '"' + v.replace('"', '\\"') + '"'
    return str(v)


def _field(name: str, v: Any, syntax: str | None) -> list[str]:
    if syntax == "yaml_multiline" and isinstance(v, str):
        return [f"- {name}: |", *("    " + x for x in v.split("\n"))]
    if syntax == "yaml_multiline_array" and isinstance(v, list) and v:
        return [f"- {name}: [", *(f"    {shown(x)}," for x in v[:-1]), f"    {shown(v[-1])}", "  ]"]
    if syntax == "comma_refs" and isinstance(v, list):
        return [f"- {name}: " + ", ".join(map(shown, v))]
    return [f"- {name}: {shown(v)}"]


def _heading(o: dict[str, Any], level: int) -> str:
    name, kind, syntax = o.get("__local_id", o.get("__id", "")), o.get("__kind"), o.get("__syntax", {})
    kind = None if kind == "__Object" else kind
    hint = None
    if name in syntax and not kind:
        hint = f"[{syntax['__array_kind']}]" if syntax[name] == "headers" and syntax.get("__array_kind") else _HINTS.get(syntax[name])
    label = o.get("__label", "")
    if kind:
        brackets = f"[[{name}: {kind}]]" if label or "__label" not in o and name else f"[[:{kind}]]"
    elif hint:
        brackets = f"[[{name}: {hint}]]"
    else:
        brackets = f"[[{name}]]" if o.get("__has_explicit_id", True) else ""
    return " ".join(x for x in ("#" * level, label, brackets) if x)


class _Writer:
    def __init__(self, objects: list[dict[str, Any]]):
        self.by_id = {o["__id"]: o for o in objects if "__id" in o}
        self.out: list[str] = []
        self.below: dict[str, list[str]] = {}
        for o in objects:
            if isinstance(o.get("__parent"), str) and not (o["__kind"].startswith("__") and o["__kind"] != "__Object"):
                self.below.setdefault(o["__parent"][3:-2], []).append(o["__id"])

    def object(self, o: dict[str, Any], level: int) -> None:
        level = o.get("__level", level)
        syntax, types, labels = o.get("__syntax", {}), o.get("__types", {}), o.get("__labels", {})
        below, done, listed, later = self.below.get(o["__id"], []), set(), False, []
        self.out.append(_heading(o, level))

        def comments(anchor: str) -> None:
            for c in o.get("__comments", []):
                if c["after"] == anchor:
                    self.out.extend(["", c["content"]])

        def child(id_: str, deeper: int = 1) -> None:
            if id_ in self.by_id and id_ not in done:
                done.add(id_)
                self.out.append("")
                self.object(self.by_id[id_], level + deeper)

        def flush() -> None:
            while later:
                child(later.pop(0))

        comments("__self")
        for name, v in o.items():
            if name.startswith("__"):
                continue
            how = syntax.get(name)
            if how in ("headers", "table", *_HINTS):
                listed = False
                flush()
                own = how == "headers" and name == o["__id"] and "__array_kind" in syntax  # the object itself is the array
                if not own:
                    first = self.by_id.get(v[0][3:-2], {}) if how in ("headers", "table") and v else {}
                    hint = _HINTS.get(how) or f"[{first.get('__kind', '')}]"
                    self.out.extend(["", f"{'#' * (level + 1)} {labels.get(name, name.replace('_', ' ').title())} [[{name}: {hint}]]".replace("  ", " ")])
                self.value(v, how, lambda id_, deeper=1 if own else 2: child(id_, deeper), done)
                comments(name)
                continue
            ref = v[3:-2] if isinstance(v, str) and v.startswith("[[#") and v.endswith("]]") else None
            if ref in below and name not in types:
                listed = False
                flush()
                child(ref)
                comments(name)
                continue
            if not listed:
                self.out.append("")
                listed = True
            self.out += _field(name, v, how)
            n = len(self.out)
            comments(name)
            listed = len(self.out) == n
            if ref in below:
                later.append(ref)
        flush()
        for id_ in below:
            child(id_)

    def value(self, v: Any, how: str, child, done: set[str]) -> None:
        if how == "headers":
            for ref in v:
                child(ref[3:-2])
        elif how == "table":
            rows = [self.by_id[r[3:-2]] for r in v if r[3:-2] in self.by_id]
            done.update(r["__id"] for r in rows)
            names = [k for k in rows[0] if not k.startswith("__")] if rows else []
            if names:
                self.out += ["", "| " + " | ".join(names) + " |", "|" + "|".join(["---"] * len(names)) + "|"]
                self.out += ["| " + " | ".join(shown(r.get(k, "")) for k in names) + " |" for r in rows]
        elif how == "markdown_list":
            self.out += ["", *(f"- {shown(x)}" for x in v)]
        elif how == "multiline_text" and v:
            self.out += ["", v]
        elif how in ("yaml_object", "json_object"):
            if isinstance(v, str):
                text = v.rstrip("\n")
            elif how == "yaml_object":
                import yaml

                text = yaml.dump(v, default_flow_style=False, allow_unicode=True, sort_keys=False).rstrip()
            else:
                text = json.dumps(v, indent=2, ensure_ascii=False)
            self.out += ["", f"```{how[:4]}", text, "```"]
        elif how == "map" and v:
            self.out.append("")
            for k, x in v.items():
                self.out += _field(k, str(x), "yaml_multiline" if "\n" in str(x) else None)


def rebuild(objects: list[dict[str, Any]]) -> str:
    """A document's text from its objects (of the standard or full format)."""
    objects = [o for o in objects if o.get("__kind") != "__ParsingError"]
    w = _Writer(objects)
    doc = next((o for o in objects if o["__kind"] == "__Document"), None)
    order = [w.by_id[r[3:-2]] for r in doc["content"] if r[3:-2] in w.by_id] if doc else [o for o in objects if "__parent" not in o]
    for o in order:
        if w.out:
            w.out.append("")
        if o["__kind"] == "__TextBlock":
            w.out.append(o["content"])
        else:
            w.object(o, 2)
    return "\n".join(w.out).rstrip("\n") + "\n" if w.out else ""


def documents(objects: DataFrame) -> DataFrame:
    """file, text of every file of ``objects`` (columns __file, ordinal and object, the parsed object as JSON)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for part in batches_of(b, 1) for r in zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
        files, texts, size = [], [], 0
        for file, own in itertools.groupby(rows, lambda r: r[0]):
            files.append(file)
            texts.append(rebuild([json.loads(o) for _, o in own]))
            size += len(texts[-1])
            if len(files) >= 1000 or size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(texts, pa.string())], ["file", "text"])
                files, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(texts, pa.string())], ["file", "text"])

    o = dealt(objects.select("__file", "ordinal", "object"), "object", "__file").sortWithinPartitions("__file", "ordinal")
    return o.select("__file", "object").mapInArrow(read, "file string, text string")


def write_documents(objects: DataFrame, folder: str) -> DataFrame:
    """Writes every file below ``folder`` (a path or URI all executors reach); gives file and bytes.  A file is renamed into place once whole."""
    import uuid

    import pyarrow.fs as pafs

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        for pdf in parts:
            sizes = []
            for name, text in zip(pdf["file"], pdf["text"]):
                path = f"{root}/{name}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                data, tmp = text.encode(), f"{path}.{uuid.uuid4().hex[:8]}"
                with fs.open_output_stream(tmp) as f:
                    f.write(data)
                fs.move(tmp, path)
                sizes.append(len(data))
            yield pd.DataFrame({"file": pdf["file"], "bytes": sizes})

    return documents(objects).mapInPandas(put, "file string, bytes bigint")


def _cells(rows: Sequence[Sequence[Any]]) -> list[list[str]]:
    return [["NULL" if v is None else " ".join(str(v).lower().split()) if isinstance(v, bool) else " ".join(str(v).split()) for v in r] for r in rows]


def to_table(df: DataFrame, limit: int = 200) -> str:
    """The first ``limit`` rows as a plain table: white space in one, nothing cut, '(empty result)' for none."""
    rows = _cells(df.limit(limit).collect())
    if not rows:
        return "(empty result)"
    width = [max(len(c), *(len(r[i]) for r in rows)) for i, c in enumerate(df.columns)]
    line = lambda r: " | ".join(x.ljust(w) for x, w in zip(r, width)).rstrip()
    return "\n".join([line(df.columns), "-+-".join("-" * w for w in width), *map(line, rows)])


def to_markdown(df: DataFrame, limit: int = 200) -> str:
    rows = [[x.replace("|", "\\|") for x in r] for r in _cells(df.limit(limit).collect())]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(r) + " |" for r in rows)])


def to_html(df: DataFrame, limit: int = 200) -> str:
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    return "<table>" + row(df.columns, "th") + "".join(row(r, "td") for r in _cells(df.limit(limit).collect())) + "</table>"


def to_json(df: DataFrame, limit: int = 200) -> dict[str, Any]:
    """columns and rows."""
    return {"columns": df.columns, "rows": [list(r) for r in df.limit(limit).collect()]}

"""Objects of one document: headings, fields, lists, tables, embedded blocks, comments and text blocks.

``parse`` is a pure function of a text, so that files are read in any number of
tasks at once (``load.py``).  A document is scanned into blocks once and walked
once; what belongs to an object is found by the levels of headings.
"""

from __future__ import annotations

import json
import re
import string
from typing import Any

from docgraph.sources.blocks import Block, scan

FIELD = re.compile(r"^([a-zA-Z_][a-zA-Z0-9_]*)\s*:\s*(.*)$")
KEY = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
LIKE_FIELD = re.compile(r"^([^:]+):\s+(.*)$", re.DOTALL)
BRACKETS = re.compile(r"\[\[((?:[^\[\]]|\[[^\]]*\])*)\]\]")
CODE = re.compile(r"`[^`]+`")
REFERENCE = re.compile(r"\[\[([^\]]+)\]\]")
TYPES = ("array", "yaml", "json", "text", "map")
SYSTEM = ("__Document", "__TextBlock", "__Object")
#: Metadata kept by each format; user fields and comments always are.
_STANDARD = {"__id", "__kind", "__label", "__parent", "__parent_field", "__container", "__types", "__syntax", "__level", "__has_explicit_id"}
FORMATS = {"minimal": set(), "standard": _STANDARD, "full": _STANDARD | {"__line", "__code_fences", "__references", "__positions"}}
_OPTIONAL = FORMATS["full"] - {"__id", "__kind"}
_FIRST = ("__id", "__local_id", "__label", "__kind", "__container", "__parent", "__parent_field", "__comments")


class Names:
    """Generated ids: a linear congruential generator, so that a document always gets the same."""

    def __init__(self, seed: int):
        self.state = seed

    def suffix(self) -> str:
        chars, out = string.ascii_lowercase + string.digits, ""
        for _ in range(6):
            self.state = (self.state * 1664525 + 1013904223) % 2**32
            out += chars[int(self.state / 2**32 * len(chars))]
        return out

    def of(self, label: str) -> str:
        """snake_case of a label, or a generated id where nothing is left of it."""
        plain = re.sub(r"[\s-]+", "_", re.sub(r"[^\w\s-]", "", label)).lower().strip("_")
        return plain or f"object_{self.suffix()}"


def header(text: str, names: Names) -> dict[str, Any]:
    """id, label and, where given, kind, field type and array kind of a heading; ``explicit`` if it has brackets."""
    text = text.strip()
    found = list(BRACKETS.finditer(CODE.sub(lambda m: " " * len(m[0]), text)))
    if not found:
        return {"id": names.of(text), "label": text, "explicit": False, "definitions": []}
    label = text
    for m in reversed(found):
        label = label[:m.start()] + label[m.end():]
    label = " ".join(label.split())
    inner = text[found[0].start() + 2:found[0].end() - 2].strip()
    out: dict[str, Any] = {"label": label, "explicit": True, "definitions": [text[m.start():m.end()] for m in found] if len(found) > 1 else []}
    left, colon, right = (x.strip() for x in inner.partition(":"))
    array = right[1:-1].strip() if right.startswith("[") and right.endswith("]") else None
    if colon and right.lower() in TYPES:
        out["type"] = right.lower()
    elif colon and array is not None:
        out |= {"type": "object_array", "array_kind": array}
    elif colon:
        out["kind"] = right
        out["id"] = left or (names.of(label) if label else f"object_{names.suffix()}")
    if "id" not in out:
        out["id"] = left or f"object_{names.suffix()}"
    return out


def split_array(inner: str) -> list[str]:
    """The items between the commas of an array, minding quotes and brackets."""
    items, depth, quote, now = [], 0, "", ""
    for c in inner:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "," and not depth:
            items.append(now.strip())
            now = ""
            continue
        depth += (c in "[{") - (c in "]}") if not quote else 0
        now += c
    return items + ([now.strip()] if now.strip() else [])


def value_of(text: str) -> tuple[Any, str]:
    """A field's value and its type: array, ref_array, null, boolean, number or string."""
    v = text.strip()
    if v == "[]":
        return [], "array"
    one_reference = v.startswith("[[") and not v.startswith("[[[")
    if one_reference and "]], [[" in v:
        return [("" if p.startswith("[[") else "[[") + p + ("" if p.endswith("]]") else "]]") for p in (x.strip() for x in v.split("]], [["))], "ref_array"
    if v.startswith("[") and v.endswith("]") and not one_reference:
        return [value_of(x)[0] for x in split_array(v[1:-1].strip())], "array"
    if v in ("null", "true", "false"):
        return {"null": None, "true": True, "false": False}[v], "null" if v == "null" else "boolean"
    if re.fullmatch(r"[+-]?\d+", v):
        return int(v), "number"
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", v):
        return float(v), "number"
    if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
        return v[1:-1], "string"
    return v, "string"


def classify(inner: str) -> str:
    """The kind of a reference: crossfile, kind, namespace, hash_local or local."""
    hashed = inner.startswith("#")
    body = inner[1:] if hashed else inner
    if "/" in body or (not hashed and "#" in body):
        return "crossfile"
    sep = ":" if ":" in body else "." if "." in body else ""
    if sep:
        return "kind" if body.split(sep, 1)[0][:1].isupper() else "namespace"
    return "hash_local" if hashed else "local"


def in_code(text: str, at: int) -> bool:
    """Whether a place of a line is inside inline code."""
    inside, i = False, 0
    while i < min(at, len(text)):
        if text[i] == "`":
            if text.startswith("```", i):
                return True
            i += text.startswith("``", i)
            inside = not inside
        i += 1
    return inside


def references(text: str, line: int, column: int = 0) -> list[dict[str, Any]]:
    """References (not definitions, nor what is in inline code) of one line's text."""
    return [{"target": m[1], "type": classify(m[1]), "line": line, "start_col": column + m.start(), "end_col": column + m.end(), "raw": m[0]}
            for m in REFERENCE.finditer(text) if m[1].startswith("#") and not in_code(text, m.start())]


def outside_examples(text: str) -> list[str]:
    """The lines of a text that aren't in a fence marked ``example`` (nor the fences themselves)."""
    depth, out = 0, []
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("```"):
            if depth:
                depth += 1 if s[3:] else -1
            elif "example" in s[3:]:
                depth = 1
        elif not depth:
            out.append(line)
    return out


class _Reader:
    def __init__(self, markdown: str, seed: int):
        self.lines = markdown.split("\n")
        self.blocks = scan(self.lines)
        self.names = Names(seed)
        self.objects: dict[str, dict[str, Any]] = {}
        self.doubles: list[dict[str, Any]] = []
        self.first_line: dict[str, int] = {}
        self.errors: list[dict[str, Any]] = []
        self.stack: list[tuple[str, int]] = []
        self.anchor = "__self"
        self.array: tuple[str, str] | None = None  # field whose items the next list has
        self.elements: tuple[str, str, str, int] | None = None  # array whose elements the next headings or table are
        self.embedded: tuple[str, str, str, str] | None = None  # field whose value the next fence is
        self.texts: list[dict[str, Any]] = []
        self.order: list[str] = []
        self.pending: list[str] = []
        self.fences: list[dict[str, Any]] = []
        self.open, self.open_line, self.open_level = False, 0, 0
        self.heads = {k: header(b.text, Names(seed)) for k, b in enumerate(self.blocks) if b.kind == "heading"}  # ids generated for a look ahead don't count

    # -- helpers
    def raw(self, a: int, b: int) -> str:
        return "\n".join(self.lines[a:b]).strip()

    def error(self, kind: str, line: int | None, id_: str | None = None, **more: Any) -> None:
        self.errors.append({"__id": id_ or f"error_{len(self.errors)}", "__kind": "__ParsingError", "type": kind, **more, "line": line})

    def comment(self, obj: str, anchor: str, content: str, merge: bool = False) -> None:
        if not content or obj not in self.objects:
            return
        held = self.objects[obj].setdefault("__comments", [])
        if merge and held and held[-1]["after"] == anchor:
            held[-1]["content"] += "\n\n" + content
        else:
            held.append({"after": anchor, "content": content})

    def note(self, obj: str, name: str, syntax: str | None = None, type_: str | None = None, label: str | None = None) -> None:
        for key, value in (("__types", type_), ("__syntax", syntax), ("__labels", label)):
            if value is not None:
                self.objects[obj].setdefault(key, {})[name] = value

    def section_end(self, k: int, level: int) -> int:
        """The block after the section that heading k of that level opens."""
        return next((j for j in range(k + 1, len(self.blocks)) if self.blocks[j].kind == "heading" and self.blocks[j].level <= level), len(self.blocks))

    def line_of(self, k: int) -> int:
        return self.blocks[k].start if k < len(self.blocks) else len(self.lines)

    def child_id(self, parent: str, local: str, field: str | None = None) -> tuple[str, str | None]:
        p = self.objects[parent]
        if p.get("__kind") in ("__Workspace", "__Namespace"):
            return local, None
        if field and "." in field:
            return f"{field}.{local}", local
        if field and field != p["__id"]:
            return f"{p['__id']}.{field}.{local}", local
        return f"{p['__id']}.{local}", local

    def has_fields(self, k: int) -> bool:
        """Whether a field list stands directly below heading k."""
        for b in self.blocks[k + 1:]:
            if b.kind == "heading":
                return False
            if b.kind == "bullets":
                return any(FIELD.match(t.strip().split("\n")[0]) for t in inlines(b))
        return False

    def has_structure_below(self, k: int, level: int) -> bool:
        return any(b.kind == "heading" and re.search(r"\[\[[^\]]+\]\]", b.text) for b in self.blocks[k + 1:self.section_end(k, level)])

    def close_text(self) -> None:
        if self.open and self.pending:
            id_ = f"text_{len(self.texts)}"
            t = {"__id": id_, "__kind": "__TextBlock", "content": "\n\n".join(self.pending), "__line": self.open_line}
            if self.fences:
                t["__code_fences"] = self.fences
            self.texts.append(t)
            self.order.append(id_)
        self.pending, self.fences, self.open, self.open_level = [], [], False, 0

    # -- the walk
    def read(self) -> None:
        k = 0
        while k < len(self.blocks):
            b = self.blocks[k]
            k = self.heading(k, b) if b.kind == "heading" else self.block(k, b)
        self.close_text()

    def heading(self, k: int, b: Block) -> int:
        h, level, line = header(b.text, self.names), b.level, b.start + 1
        while self.stack and self.stack[-1][1] >= level:
            gone, _ = self.stack.pop()
            if self.stack:
                ref = f"[[#{gone}]]"
                up = self.objects.get(self.stack[-1][0], {})
                self.anchor = next((f for f, v in up.items() if not f.startswith("__") and (v == ref or isinstance(v, list) and ref in v)), self.anchor)
        parent = self.stack[-1][0] if self.stack else None
        if h["definitions"]:
            self.error("multiple_definitions", line, definitions=h["definitions"], object=f"[[#{h['id']}]]")
        if self.array:
            self.anchor, self.array = self.array[1], None
        if self.elements and level <= self.elements[3]:
            self.elements = None
        type_, name = h.get("type"), h["id"]
        if type_ and parent:
            nxt = self.field_heading(k, b, h, parent)
            if nxt is not None:
                return nxt
            return k + 1
        if type_ == "object_array":
            o = {"__id": name, "__kind": "__Object", "__level": level, "__line": line, name: [], "__syntax": {name: "headers", "__array_kind": h["array_kind"]}, "__labels": {name: h["label"]}}
            if h["label"]:
                o["__label"] = h["label"]
            self.objects[name] = o
            self.stack.append((name, level))
            self.order.append(name)
            self.elements = (name, name, h["array_kind"], level)
            return k + 1
        if self.elements and level > self.elements[3]:
            owner, field, kind, _ = self.elements
            id_, local = self.child_id(owner, name, field)
            o = {"__id": id_, "__kind": kind, "__parent": f"[[#{self.objects[owner]['__id']}]]", "__parent_field": field, "__line": line}
            self.put(o, local, h["label"], level)
            self.objects[owner][field].append(f"[[#{id_}]]")
        elif parent and "kind" not in h and h["explicit"]:
            return self.inner_heading(k, b, h, parent)
        elif parent and "kind" not in h and level > self.stack[-1][1]:
            return self.comment_heading(k, b, parent)
        else:
            nxt = self.object_heading(k, b, h, parent)
            if nxt is not None:
                return nxt
        self.anchor = "__self"
        return k + 1

    def put(self, o: dict[str, Any], local: str | None, label: str, level: int) -> None:
        if local is not None:
            o["__local_id"] = local
        if label:
            o["__label"] = label
        self.objects[o["__id"]] = o
        self.stack.append((o["__id"], level))

    def text_field(self, k: int, b: Block, h: dict, parent: str) -> int:
        end = self.section_end(k, b.level)
        self.objects[parent][h["id"]] = self.raw(b.end, self.line_of(end))
        self.note(parent, h["id"], "multiline_text", "string", h["label"])
        self.anchor = h["id"]
        return end

    def field_heading(self, k: int, b: Block, h: dict, parent: str) -> int | None:
        name, type_ = h["id"], h["type"]
        if type_ == "text":
            return self.text_field(k, b, h, parent)
        if type_ == "array":
            self.array = (parent, name)
        elif type_ == "object_array":
            self.objects[parent][name] = []
            self.note(parent, name, "headers", None, h["label"])
            self.elements = (parent, name, h["array_kind"], b.level)
        elif type_ in ("yaml", "json"):
            self.embedded = (parent, name, h["label"], type_)
        elif type_ == "map":
            end, found, held = self.section_end(k, b.level), False, {}
            for x in self.blocks[k + 1:end]:
                if x.kind == "bullets" and not found:
                    found = True
                    got = fields_of(x, self.lines, raw=True)
                    held.update(got["fields"])
                    for bad in got["invalid"]:
                        self.error("invalid_map_entry", bad["line"], field=name, object=f"[[#{parent}]]")
                elif x.kind in ("bullets", "para", "fence", "code", "ordered"):
                    self.error("invalid_map_content", x.start + 1, field=name, object=f"[[#{parent}]]")
            self.objects[parent][name] = held
            self.note(parent, name, "map", "map", h["label"])
            self.anchor = name
            return end
        return None

    def inner_heading(self, k: int, b: Block, h: dict, parent: str) -> int:
        """[[id]] without a kind below an object: a nested object or a text field."""
        name, level = h["id"], b.level
        if "." in name:
            self.error("invalid_id_character", b.start + 1, name, reference=f"[[{name}]]")
            return next((j for j in range(k + 1, len(self.blocks)) if self.blocks[j].kind == "heading"), len(self.blocks))
        after = self.blocks[k + 1] if k + 1 < len(self.blocks) else None
        nested = after is not None and (after.kind == "bullets" and self.has_fields(k) or after.kind == "heading" and after.level > level)
        if nested:
            id_, local = self.child_id(parent, name)
            o = {"__id": id_, "__kind": "__Object", "__level": level, "__line": b.start + 1, "__parent": f"[[#{self.objects[parent]['__id']}]]", "__parent_field": name}
            self.objects[parent][name] = f"[[#{id_}]]"
            self.put(o, local, h["label"], level)
            self.anchor = "__self"
            return k + 1
        if after is not None and after.kind == "heading":
            self.objects[parent][name] = ""
            self.note(parent, name, "multiline_text", "string", h["label"])
            self.anchor = "__self"
            return k + 1
        return self.text_field(k, b, h, parent)

    def comment_heading(self, k: int, b: Block, parent: str) -> int:
        """A plain heading below an object is a comment, up to the next that makes an object."""
        j = k + 1
        while j < len(self.blocks):
            x = self.blocks[j]
            if x.kind == "heading":
                if x.level <= b.level:
                    break
                h = self.heads[j]
                if h["explicit"] and "kind" in h:
                    break
                if h["explicit"]:
                    self.error("structured_in_textblock", x.start + 1, reference=f"[[{h['id']}: {h['type']}]]" if "type" in h else f"[[{h['id']}]]")
            j += 1
        self.comment(parent, self.anchor, self.raw(b.start, self.line_of(j)))
        return j

    def object_heading(self, k: int, b: Block, h: dict, parent: str | None) -> int | None:
        level, line, name, kind, type_ = b.level, b.start + 1, h["id"], h.get("kind"), h.get("type")
        if not (h["explicit"] or kind is not None or self.has_fields(k) or level >= 2 and self.has_structure_below(k, level)):
            self.close_text()
            self.pending, self.open, self.open_line, self.open_level = ["#" * level + " " + h["label"]], True, line, level
            return None
        if kind in SYSTEM:
            self.error("explicit_system_type", line, name, reference=f"[[{name}: {kind}]]")
            return next((j for j in range(k + 1, len(self.blocks)) if self.blocks[j].kind == "heading"), len(self.blocks))
        if self.open and len(self.pending) > 1 and h["explicit"] and self.open_level >= 2 and level > self.open_level:
            self.error("structured_in_textblock", line, reference=f"[[{name}:{kind}]]" if kind is not None else f"[[{name}: {type_}]]" if type_ else f"[[{name}]]")
            self.pending += ["", "#" * level + " " + h["label"]]
            return k + 1
        self.close_text()
        o: dict[str, Any] = {"__id": name, "__level": level, "__line": line, "__kind": kind if kind is not None else "__Object"}
        if not h["explicit"]:
            o["__has_explicit_id"] = False
        local = None
        if parent:
            o["__id"], local = self.child_id(parent, name)
            o |= {"__parent": f"[[#{self.objects[parent]['__id']}]]", "__parent_field": name}
            self.objects[parent][name] = f"[[#{o['__id']}]]"
        else:
            self.order.append(name)
            if h["explicit"] and "." in name:
                local = name
        old = self.objects.get(o["__id"])
        if old is not None and "__line" in old:
            first = self.first_line.setdefault(o["__id"], old["__line"] or 0)
            self.doubles.append(old)
            self.error("duplicate_id", line, f"__error_dup_{o['__id']}", message=f"Duplicate ID '{o['__id']}' (first defined on line {first})", object=f"[[#{o['__id']}]]")
        self.put(o, local, h["label"], level)
        if type_ and not parent:  # a field of nothing
            self.error("dangling_field", line, field=name, field_type=type_, object=f"[[#{name}]]")
            o["__syntax"] = {name: {"text": "multiline_text", "array": "markdown_list", "map": "map", "yaml": "yaml_object", "json": "json_object"}[type_]}
            end = self.section_end(k, level)
            if type_ in ("text", "array", "map"):
                end = next((j for j in range(k + 1, end) if j in self.heads and self.heads[j]["explicit"] and self.heads[j].get("type") not in ("text", "array", "map")), end)
            self.comment(name, "__self", self.raw(b.end, self.line_of(end)))
            return end
        return None

    # -- what isn't a heading
    def block(self, k: int, b: Block) -> int:
        now = self.stack[-1][0] if self.stack else None
        if b.kind == "bullets":
            if self.array:
                owner, name = self.array
                self.objects[owner][name] = [value_of(t)[0] for t in inlines(b)]
                self.note(owner, name, "markdown_list")
                self.anchor, self.array = name, None
            elif now:
                self.fields(b, now)
            elif self.open:
                self.pending.append(self.raw(b.start, b.end))
        elif b.kind == "table" and self.open:
            self.pending.append(self.raw(b.start, b.end))
        elif b.kind == "table" and self.elements:
            self.rows(b)
        elif b.kind == "fence" and self.embedded:
            self.embed(b)
        elif b.kind == "ordered":
            self.ordered(b, now)
        elif now and (b.kind in ("para", "quote", "rule", "fence") or b.kind == "table" and (self.anchor != "__self" or self.objects[now].get("__kind") not in ("__Object", ""))):
            return self.prose(k, b, now)
        elif not now and b.kind in ("para", "quote"):
            for text in [b.text] if b.kind == "para" else [x.text for x in b.inner if x.kind == "para"]:
                if not self.open:
                    self.open, self.open_line, self.open_level = True, b.start + 1, 0
                self.pending.append(text)
        elif not now and b.kind == "fence":
            text = f"```{b.info}\n" + b.text.rstrip("\n") + "\n```"
            before = "\n\n".join(self.pending)
            if not self.open:
                self.open, self.open_line, self.open_level = True, b.start + 1, 0
            self.fences.append({"lang": b.info, "offset_line": before.count("\n") + 2 if before else 0, "length_lines": text.count("\n") + 1})
            self.pending.append(text)
        return k + 1

    def fields(self, b: Block, now: str) -> None:
        got = fields_of(b, self.lines)
        fields, invalid, o = got["fields"], got["invalid"], self.objects[now]
        if any(f in o for f in fields):
            self.comment(now, self.anchor, self.raw(b.start, b.end))
            return
        if not fields:
            self.comment(now, self.anchor, self.raw(b.start, b.end), merge=bool(invalid))
            if any(x["key"] for x in invalid):
                self.error("mixed_field_keys", next(x["line"] for x in invalid if x["key"]), object=f"[[#{now}]]")
            for key, line in got["nested"]:
                self.error("nested_subitems", line, field=key, object=f"[[#{now}]]")
            return
        o.update(fields)
        for key, held in (("__types", got["types"]), ("__syntax", got["syntax"])):
            if held:
                o.setdefault(key, {}).update(held)
        grouped: dict[str, list[dict]] = {}
        for x in invalid:
            if not any(x["content"] in c["content"] for c in o.get("__comments", [])):
                grouped.setdefault(x["after"], []).append(x)
        if any(x["key"] for x in invalid) and grouped:
            self.error("mixed_field_keys", next(x for xs in grouped.values() for x in xs)["line"], object=f"[[#{now}]]")
        for anchor, own in grouped.items():
            self.comment(now, anchor, ("\n\n" if any(x["key"] for x in own) else "\n").join(x["content"] for x in own))
        for key, line in got["nested"]:
            self.error("nested_subitems", line, field=key, object=f"[[#{now}]]")
        self.anchor = list(fields)[-1]

    def rows(self, b: Block) -> None:
        owner, field, kind, _ = self.elements
        self.note(owner, field, "table", "array")
        names = b.rows[0]
        for n, row in enumerate(b.rows[1:]):
            id_, local = self.child_id(owner, f"{field}_{n}", field)
            o: dict[str, Any] = {"__id": id_, "__label": "", "__kind": kind, "__parent": f"[[#{self.objects[owner]['__id']}]]", "__parent_field": field}
            if local is not None:
                o["__local_id"] = local
            types = {}
            for i, (name, text) in enumerate(zip(names, row)):
                o[name], types[name] = value_of(text)
                if i == 0 and isinstance(o[name], str):
                    o["__label"] = o[name]
            if types:
                o["__types"] = types
            self.objects[id_] = o
            self.objects[owner][field].append(f"[[#{id_}]]")
        self.elements = None

    def embed(self, b: Block) -> None:
        owner, name, label, type_ = self.embedded
        self.objects[owner][name] = embedded(b.text, type_)
        self.note(owner, name, f"{type_}_object", None, label)
        self.embedded = None

    def ordered(self, b: Block, now: str | None) -> None:
        raw = self.raw(b.start, b.end)
        if self.array:
            owner, name = self.array
            self.objects[owner][name] = []
            self.note(owner, name, "markdown_list")
            self.comment(owner, name, raw, merge=True)
            self.error("ordered_list_in_array", b.start + 1, field=name, object=f"[[#{owner}]]")
            self.anchor, self.array = name, None
        elif now and self.anchor == "__self":
            self.comment(now, self.anchor, "\n".join(f"{i}. {t}" for i, t in enumerate(inlines(b), 1)))
        elif now:
            self.comment(now, self.anchor, raw)
        elif self.open:
            self.pending.append(raw)

    def prose(self, k: int, b: Block, now: str) -> int:
        """A comment: from here to the next paragraph (if it starts with one), field list or heading that counts."""
        level, end, j, paragraphs, stop = self.stack[-1][1], len(self.lines), k, 0, False
        while j < len(self.blocks) and not stop:
            x = self.blocks[j]
            if x.kind == "heading" and (x.level <= level or self.heads[j]["explicit"]):
                end = x.start
                break
            if x.kind == "bullets":
                marked = [i.start for i in x.items if any(FIELD.match(t.split("\n")[0]) for t in item_inlines(i))]
                if marked:
                    end = marked[0]
                    break
            if x.kind == "para" and b.kind == "para":
                paragraphs += 1
                if paragraphs > 1:
                    end = x.start
                    break
            j += 1
        raw = self.raw(b.start, end)
        after = self.blocks[k + 1] if k + 1 < len(self.blocks) else None
        if b.kind == "para" and after is not None and after.kind in ("bullets", "ordered") and after.start == b.end and after.start < end:
            raw = re.sub(r"^([^\n]+)\n", r"\1\n\n", raw, count=1)
        self.comment(now, self.anchor, raw)
        if self.objects[now].get("__types"):
            for x in self.blocks[k:j]:
                if x.kind == "bullets":
                    for item in x.items:
                        plain = CODE.sub("", item.text.strip().split("\n")[0])
                        plain = re.sub(r"\*\*([^*]*)\*\*|\*([^*]*)\*|~~([^~]*)~~", lambda m: m[1] or m[2] or m[3] or "", plain)
                        m = LIKE_FIELD.match(plain)
                        if m and not FIELD.match(plain) and m[1].strip() and not KEY.match(m[1].strip()):
                            self.error("mixed_field_keys", item.start + 1, object=f"[[#{now}]]")
                            break
        return j

    # -- full format
    def positions(self) -> None:
        """Where each field is defined, by bytes of its line."""
        below = {o.get("__parent_field") for o in self.objects.values()}
        for o in self.objects.values():
            found: dict[str, dict[str, int]] = {}
            for name, v in o.items():
                if name.startswith("__") or o.get("__line") is None or isinstance(v, str) and re.fullmatch(r"\[\[#.*\]\]", v.strip(), re.DOTALL) and name in below:
                    continue
                as_item, as_heading = re.compile(rf"^\s*-\s+\**{re.escape(name)}\**\s*:"), re.compile(rf"^#+\s+.*\[\[{re.escape(name)}(?::.*?)?\]\]")
                for i in range(o["__line"] - 1, len(self.lines)):
                    line = self.lines[i]
                    at = line.find(name) if as_item.match(line) else line.find(f"[[{name}") if as_heading.match(line) else -1
                    if at >= 0:
                        found[name] = {"line": i + 1, "col": len(line[:at].encode())}
                        break
            if found:
                o["__positions"] = found

    def locate(self) -> None:
        for o in [*self.objects.values(), *self.texts]:
            if o.get("__line") is None:
                continue
            found: list[dict] = []
            at = o["__line"] - 1 if o["__kind"] != "__TextBlock" else 0

            def line_with(text: str, start: int) -> int | None:
                return next((i for i in range(start, len(self.lines)) if text in self.lines[i]), None)

            for key, v in o.items():
                if key == "__comments":
                    for c in v:
                        if "[[" in c["content"]:
                            for text in outside_examples(c["content"]):
                                i = line_with(text.strip(), at) if "[[" in text else None
                                if i is not None:
                                    found += references(self.lines[i], i + 1)
                                    at = i + 1
                elif key.startswith("__"):
                    continue
                elif isinstance(v, str) and "[[" in v:
                    for text in outside_examples(v):
                        i = line_with(text.strip(), at) if "[[" in text else None
                        if i is not None:
                            found += references(self.lines[i], i + 1)
                            at = i + 1
                elif isinstance(v, list):
                    for x in v:
                        i = line_with(x, o["__line"] - 1) if isinstance(x, str) and "[[" in x else None
                        if i is not None:
                            found += references(x, i + 1, self.lines[i].find(x))
            if found:
                o["__references"] = list({(r["target"], r["line"], r["start_col"], r["end_col"]): r for r in found}.values())


def item_inlines(item) -> list[str]:
    out = []
    for b in item.blocks:
        if b.kind == "para":
            out.append(b.text)
        elif b.kind in ("bullets", "ordered"):
            out += inlines(b)
    return out


def inlines(b: Block) -> list[str]:
    """The texts of a list's items, those of lists in them too."""
    return [t for item in b.items for t in item_inlines(item)]


def fields_of(b: Block, lines: list[str], raw: bool = False) -> dict[str, Any]:
    """Fields of a list with their types and syntax, the items that are none, and fields that only have items below them."""
    out: dict[str, Any] = {"fields": {}, "types": {}, "syntax": {}, "invalid": [], "nested": []}
    last = "__self"
    for n, item in enumerate(b.items):
        text = item.text.strip()
        m = FIELD.match(text.split("\n")[0])
        if m:
            key, value = m[1], text[text.find(":") + 1:].strip()
            if value == "|" or value.startswith("|\n"):
                end = b.items[n + 1].start if n + 1 < len(b.items) else item.end
                own = "\n".join(lines[item.start + 1:end]).rstrip("\n").split("\n")
                dent = min((len(x) - len(x.lstrip()) for x in own if x.strip()), default=0)
                out["fields"][key], out["types"][key], out["syntax"][key] = "\n".join(x[dent:] for x in own), "string", "yaml_multiline"
            elif value == "" and item.nested:
                out["nested"].append((key, item.start + 1))
                continue
            elif raw:
                out["fields"][key], out["types"][key] = value, "string"
            else:
                v, type_ = value_of(value)
                out["fields"][key], out["types"][key] = v, "array" if type_ == "ref_array" else type_
                if type_ in ("array", "ref_array"):
                    out["syntax"][key] = "comma_refs" if type_ == "ref_array" else "yaml_multiline_array" if "\n" in value else "yaml_array"
            last = key
            continue
        like = LIKE_FIELD.match(text.split("\n")[0])
        if like and like[1].strip() and not KEY.match(like[1].strip()):
            out["invalid"].append({"key": like[1].strip(), "content": f"- {text}", "line": item.start + 1, "after": last})
        elif not like and last != "__self" and text:
            out["invalid"].append({"key": "", "content": f"- {text}", "line": item.start + 1, "after": last})
    return out


def embedded(text: str, type_: str) -> Any:
    """The value of a YAML or JSON block, or its text where it can't be read."""
    try:
        if type_ == "json":
            return json.loads(text)
        import yaml

        return json.loads(json.dumps(yaml.safe_load(text), default=str))
    except Exception:  # noqa: BLE001 - whatever is wrong with it, the text is the value
        return text


def parse(markdown: str, seed: int = 666, format: str = "standard") -> list[dict[str, Any]]:
    """All objects of a document in order, its errors last.

    ``format``: minimal (data only), standard (what ``render.rebuild`` needs) or full (lines and references too).
    """
    if format not in FORMATS:
        raise ValueError(f"format is one of {sorted(FORMATS)}")
    r = _Reader(markdown.replace("\r\n", "\n"), seed)
    r.read()
    if format == "full":
        r.locate()
        r.positions()
    found = [*r.objects.values(), *r.doubles]
    if r.texts:
        doc = f"doc_{r.names.suffix()}"
        for o in [*r.texts, *found]:
            o["__container"] = f"[[#{doc}]]"
        found = [{"__id": doc, "__kind": "__Document", "content": [f"[[#{x}]]" for x in r.order]}, *r.texts, *found]
    if r.errors:
        found = sorted(found + r.errors, key=lambda o: (1, o["line"] or 0) if o["__kind"] == "__ParsingError" else (-1, 0) if o["__kind"] == "__Document" else (0, o.get("__line") or 0))
    return [_trimmed(o, FORMATS[format]) for o in found]


def _trimmed(o: dict[str, Any], keep: set[str]) -> dict[str, Any]:
    if o["__kind"] == "__ParsingError":
        return o
    keys = [k for k in _FIRST if k in o] + [k for k in o if not k.startswith("__")] + [k for k in o if k.startswith("__") and k not in _FIRST]
    hidden = _OPTIONAL - keep
    if "__id" not in keep and o.get("__has_explicit_id") is False:
        hidden = hidden | {"__id"}
    if "__kind" not in keep and o["__kind"].startswith("__"):
        hidden = hidden | {"__kind"}
    return {k: o[k] for k in keys if k not in hidden}

"""Documents: what is read, written back, loaded and ignored."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docgraph.sources import load
from docgraph.sources.blocks import scan
from docgraph.sources.parse import classify, parse, references, value_of
from docgraph.sources.render import rebuild, to_html, to_markdown, to_table

DOCUMENT = """# Park [[park: Place]]

Opened long ago.

- area: 12.5
- open: true
- keeper: [[#joan]]
- paths: [[#north]], [[#south]]
- tags: [green, "big one", 3]
- about: |
    Two lines
      and more

Closed on Mondays.

## Rules [[rules: text]]

No fires.

```yaml example
- [[#not]]
```

## Hours [[hours: map]]

- monday: none
- sunday: 9

## Gates [[gates: array]]

- east
- 7

## Data [[data: json]]

```json
{"a": [1, null]}
```

## Trees [[trees: [Tree]]]

| kind | age |
|------|-----|
| oak  | 90  |
| elm  | ~   |

## Benches [[benches: [Bench]]]

### Old [[old]]

- seats: 4

## House [[house]]

- rooms: 3
"""


def by_id(objects):
    return {o["__id"]: o for o in objects}


def test_a_document_of_everything():
    got = by_id(parse(DOCUMENT))
    park = got["park"]
    assert {k: v for k, v in park.items() if not k.startswith("__")} == {
        "area": 12.5, "open": True, "keeper": "[[#joan]]", "paths": ["[[#north]]", "[[#south]]"], "tags": ["green", "big one", 3], "about": "Two lines\n  and more",
        "rules": "No fires.\n\n```yaml example\n- [[#not]]\n```", "hours": {"monday": "none", "sunday": "9"}, "gates": ["east", 7], "data": {"a": [1, None]},
        "trees": ["[[#park.trees.trees_0]]", "[[#park.trees.trees_1]]"], "benches": ["[[#park.benches.old]]"], "house": "[[#park.house]]"}
    assert park["__comments"] == [{"after": "__self", "content": "Opened long ago."}, {"after": "about", "content": "Closed on Mondays."}]
    assert park["__types"]["about"] == "string" and park["__syntax"]["paths"] == "comma_refs" and park["__labels"]["rules"] == "Rules"
    assert got["park.trees.trees_1"]["age"] == "~" and got["park.trees.trees_0"]["__label"] == "oak"
    assert got["park.benches.old"]["__local_id"] == "old" and got["park.house"]["__parent"] == "[[#park]]"
    assert [r["target"] for r in by_id(parse(DOCUMENT, format="full"))["park"]["__references"]] == ["#joan", "#north", "#south"]
    minimal = by_id(parse(DOCUMENT, format="minimal"))["park"]
    assert set(minimal) & {"__types", "__level", "__label", "__syntax"} == set() and minimal["__kind"] == "Place"
    with pytest.raises(ValueError):
        parse("", format="most")


@pytest.mark.parametrize("text, kinds", [
    ("# A [[a: K]] [[b: array]]", ["multiple_definitions"]),
    ("# A [[a: K]]\n\n## M [[m: map]]\n\n- bad key\n- a b: 1\n\ntext", ["invalid_map_entry", "invalid_map_content"]),
    ("# A [[a: K]]\n\n## B [[b.c]]\n\ntext", ["invalid_id_character"]),
    ("# A [[a: K]]\n\n## T\n\n### X [[x]]", ["structured_in_textblock"]),
    ("# A [[a: __TextBlock]]", ["explicit_system_type"]),
    ("# A [[a: K]]\n\n- x: 1\n\n# B [[a: K]]", ["duplicate_id"]),
    ("# A [[a: text]]\n\nbody", ["dangling_field"]),
    ("# A [[a: K]]\n\n- x: 1\n- Ключ: 2", ["mixed_field_keys"]),
    ("# A [[a: K]]\n\n- y: 0\n- x:\n  - one", ["nested_subitems"]),
    ("# A [[a: K]]\n\n## L [[l: array]]\n\n1. one", ["ordered_list_in_array"]),
    ("# A [[a: K]]\n\n## Ü [[u: yaml]]\n\n```yaml\n: : :\n```", []),
    ("", []), ("\n\n", []), ("no heading", []),
])
def test_errors(text, kinds):
    assert [o["type"] for o in parse(text) if o["__kind"] == "__ParsingError"] == kinds


def test_text_without_objects():
    doc, first, second = parse("before\n\n## Only text\n\n- a\n- b\n\n```py x\n1\n```\n", format="full")
    assert doc["__kind"] == "__Document" and doc["__id"].startswith("doc_") and doc["content"] == ["[[#text_0]]", "[[#text_1]]"]
    assert first["content"] == "before" and second["content"] == "## Only text\n\n- a\n- b\n\n```py x\n1\n```"
    assert second["__code_fences"] == [{"lang": "py x", "offset_line": 5, "length_lines": 3}] and second["__line"] == 3


def test_values_and_references():
    assert [value_of(x) for x in ("7", "-1.5", "1e10", "null", "'a b'", "[]", "[[#a]]", "[[[#a]], [x, y]]", "1.2.3", "True")] == [
        (7, "number"), (-1.5, "number"), (1e10, "number"), (None, "null"), ("a b", "string"), ([], "array"), ("[[#a]]", "string"), (["[[#a]]", ["x", "y"]], "array"), ("1.2.3", "string"), ("True", "string")]
    assert [classify(x) for x in ("#a", "a", "#n:a", "#Kind:a", "#a.b", "f/x#a", "x#a")] == ["hash_local", "local", "namespace", "kind", "namespace", "crossfile", "crossfile"]
    assert [(r["target"], r["start_col"]) for r in references("see [[#a]] `[[#b]]` ``[[#c]]`` [[d]]", 3, 10)] == [("#a", 14)]


def test_blocks_keep_their_lines():
    lines = "para\nmore\n***\n> q\n- a\n\n  still a\n- b\n\n1. x\n~~~\n# no\n~~~\n    code\n<!-- c\n-->\nT | U\n--|--\n1 | 2\n\nHead\n===".split("\n")
    assert [(b.kind, b.start, b.end) for b in scan(lines)] == [("para", 0, 2), ("rule", 2, 3), ("quote", 3, 4), ("bullets", 4, 8), ("ordered", 9, 10), ("fence", 10, 13), ("code", 13, 14), ("html", 14, 16), ("table", 16, 19), ("heading", 20, 22)]


def test_a_document_comes_back():
    objects = parse(DOCUMENT)
    assert parse(rebuild(objects)) == objects
    assert rebuild([]) == ""


words = st.text(alphabet="abcxyz Ü-*_`#:|[]", min_size=0, max_size=12).map(str.strip)
names = st.from_regex(r"[a-z][a-z0-9_]{0,6}", fullmatch=True)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(names, st.lists(st.tuples(names, st.one_of(st.integers(-9, 9), st.booleans(), st.none(), st.sampled_from(["plain", "two words", "[[#x]]"]))), max_size=4), words), max_size=5))
def test_round_trip_of_any_objects(parts):
    text = "\n".join(f"## L [[{name}{n}: Kind]]\n\n" + "".join(f"- {k}: {json.dumps(v) if not isinstance(v, str) else v}\n" for k, v in dict(fields).items()) + f"\n{note}\n" for n, (name, fields, note) in enumerate(parts))
    once = [o for o in parse(text) if o["__kind"] != "__ParsingError"]
    assert [o["__id"] for o in once if o["__kind"] == "Kind"] == [f"{name}{n}" for n, (name, _, _) in enumerate(parts)]
    again = [o for o in parse(rebuild(once)) if o["__kind"] != "__ParsingError"]
    if not any(set(note) & set("#|`*-_:[]") for *_, note in parts):
        assert again == once


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab#[]:-|`>1.*\n \t\"'_é", max_size=120))
def test_any_text_is_read(text):
    assert all("__kind" in o for o in parse(text, format="full"))


FILES = {
    "readme.qmd.md": "# W [[w: __Workspace]]\n", "a/readme.qmd.md": "# N [[ns: __Namespace]]\n", "a/b/x.qmd.md": "# X [[x: K]]\n\n- to: [[#y]]\n- far: [[#main:y]]\n",
    "y.qmd.md": "# Y [[y: K]]\n\n- back: [[#x.to]]\n- lost: [[#gone]]\n", "in/readme.qmd.md": "# I [[inner: __Workspace]]\n", "in/x.qmd.md": "# X2 [[x: K]]\n", "bad.qmd.md": "# B [[b: __Workspace]]\n", "nul.qmd.md": None}


def test_a_load_of_texts(spark):
    w = load.relations(spark.createDataFrame(list(FILES.items()), "file string, text string"), "top")
    assert {(r.file, r.workspace, r.namespace) for r in w.files.collect() if r.file in ("a/b/x.qmd.md", "in/x.qmd.md", "y.qmd.md")} == {("a/b/x.qmd.md", "w", "ns"), ("in/x.qmd.md", "inner", ""), ("y.qmd.md", "w", "")}
    assert {r["__global_id"] for r in w.objects.collect()} == {"::w", "w::ns", "w:ns:x", "w::y", "::inner", "inner::x"}
    assert {(r.source_id, r.target_id, r.target_field) for r in w.edges.collect()} == {("w:ns:x", "w::y", ""), ("w::y", "w:ns:x", "to")}
    assert {(r.type, r.object) for r in w.errors.collect()} == {("workspace_in_wrong_file", "b"), ("nested_workspace", "inner")}
    plain = load.relations(spark.createDataFrame([("p.qmd.md", "# P [[p: K]]\n")], "file string, text string"), "top")
    assert {(r["__global_id"], r["__kind"]) for r in plain.objects.collect()} == {("::top", "__Workspace"), ("top::p", "K")}
    empty = load.relations(spark.createDataFrame([], "file string, text string"))
    assert empty.objects.count() == empty.edges.count() == empty.errors.count() == 0


def test_files_of_a_folder(spark, tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "ws" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text or "")
    (tmp_path / "ws" / ".docignore").write_text("# a comment\n\nin/\nb*.qmd.md\n")
    (tmp_path / "ws" / "other.txt").write_text("# Z [[z: K]]")
    files = load.scan(spark, str(tmp_path / "ws"))
    assert sorted(r.file for r in files.collect()) == ["a/b/x.qmd.md", "a/readme.qmd.md", "readme.qmd.md", "y.qmd.md"]  # an empty file has nothing to load
    order = files.orderBy(load.file_order(files["file"])).collect()
    assert [r.file for r in order] == ["readme.qmd.md", "y.qmd.md", "a/readme.qmd.md", "a/b/x.qmd.md"]
    w = load.load(spark, str(tmp_path / "ws"))
    from docgraph.sources.render import write_documents

    out = tmp_path / "out"
    write_documents(load.last_rows(w.rows), str(out)).collect()
    assert parse((out / "a/b/x.qmd.md").read_text()) == parse(FILES["a/b/x.qmd.md"]) and not list(out.rglob("*.md.*"))


def test_results_as_text(spark):
    df = spark.createDataFrame([(1, "a  b\n|c", None), (2, "<x>", True)], "n int, t string, b boolean")
    assert to_table(df) == "n | t      | b\n--+--------+-----\n1 | a b |c | NULL\n2 | <x>    | true"
    assert to_table(df.limit(0)) == "(empty result)" and "a b \\|c" in to_markdown(df) and "&lt;x&gt;" in to_html(df)

"""The engine's dialect pass, guard, scopes, blocks; the tools; a graph kept up to date."""

import json

import pytest

from docgraph.api import TOOLS, Graph, call, resolve_reference
from docgraph.operators import chunks, config, embed, graph, validation
from docgraph.session import Refused, blocks, compat, glob_regex
from docgraph.streaming.refresh import Refresh

TEXTS = {
    "readme.qmd.md": "# Town [[town: __Workspace]]\n",
    "people.qmd.md": "# Ann [[ann: Person]]\n\nLikes trees.\n\n- age: 30\n- friend: [[#bob]]\n- home: [[#house]]\n\n# Bob [[bob: Person]]\n\n- age: 40\n- boss: [[#nobody]]\n",
    "places.qmd.md": "# House [[house: Place]]\n\n- owner: [[#ann.age]]\n\n## Notes [[notes: text]]\n\n" + "A long note on the house. " * 5 + "\n",
    "queries.qmd.md": "# Q [[ages: Query]]\n\n- sql: select json_extract(data, '$.age') as age from objects where __kind = 'Person' order by 1\n",
    "far/readme.qmd.md": "# Far [[far: __Workspace]]\n", "far/x.qmd.md": "# Ann [[ann: Person]]\n\n- age: 5\n"}


@pytest.fixture(scope="module")
def g(spark):
    return Graph.of_texts(spark, TEXTS)


def test_dialect():
    same = "SELECT 'json_extract(a) GLOB x' AS s -- LIKE 'x'\nFROM objects /* total(x) */"
    assert compat(same) == same
    assert compat("select total(a), group_concat(b, '-') from t where c glob 'x*' and d like 'y'") == "select coalesce(sum(a), 0.0D), listagg(b, '-') from t where c RLIKE r'(?s)^x.*$' and d ILIKE 'y'"
    assert compat("a/2 + __line/2 + count(*)/3 + __line/x") == "a/2 + __line div 2 + count(*) div 3 + __line/x"
    assert compat("from objects o, json_each(o.data) j where j.key = ?1") == "from objects o, LATERAL explode(from_json(o.data, 'map<string,string>')) j(key, value) where j.key = :p1"
    import re

    for pattern, text, want in (("[a-c]?*", "bz", True), ("[^a]*", "abc", False), ("a.b", "axb", False), ("*", "", True), ("a*b", "a\nb", True)):
        assert bool(re.match(glob_regex(pattern), text)) == want


def test_scopes_part_the_graph(g):
    every = g.engine.sql("select __global_id from objects").count()
    parts = {w: g.engine.sql("select __global_id from objects", w).count() for w in ("town", "far", "", "none")}
    assert every == sum(parts.values()) and parts["none"] == 0 and parts["far"] == 1
    assert [r.age for r in g.engine.sql("#ages").collect()] == ["30", "40", "5"] and [r.age for r in g.engine.sql("#ages", "town").collect()] == ["30", "40"]
    with pytest.raises(Refused):
        g.engine.sql("#ages", "far")


def test_blocks_of_a_page(g):
    page = "text\n\n```table\nquery: [[#ages]]\n```\n\n```table example\nsql: x\n```\n"
    assert [(a, b) for a, b, _ in blocks(page)] == [(2, 5)]
    assert g.engine.block(blocks(page)[0][2], "town").split("\n")[2:] == ["| 30 |", "| 40 |"]
    assert g.engine.block("sql: |\n  select count(*) as n\n  from objects\nscope: all", "far").split("\n")[2] == f"| {g.objects.count()} |"
    with pytest.raises(Refused):
        g.engine.block("title: none")


def test_tools(g):
    ok = lambda tool, **a: call(g, tool, a)
    assert ok("locate", ref="[[#house]]") == {"success": True, "file": "places.qmd.md", "line": 1, "id": "house", "kind": "Place", "namespace": ""}
    assert ok("locate", ref="nobody")["error"]["code"] == "not-found" and ok("describe", ref="")["error"]["code"] == "invalid-argument"
    assert ok("describe", ref="house.owner") == {"success": True, "object_id": "house", "field": "owner", "value": "[[#ann.age]]", "type": "reference"}
    assert ok("describe", ref="house.__id")["error"]["code"] == "not-found" and ok("describe", ref="house.nothing")["error"]["code"] == "not-found"
    assert [i["__id"] for i in ok("find_references", ref="bob")["items"]] == ["ann"]
    assert [(e["file"], e["old_text"], e["new_text"]) for e in ok("rename", old="house", new="villa")["edits"]] == [("people.qmd.md", "house", "villa"), ("places.qmd.md", "house", "villa")]
    assert ok("rename", old="house", new="no spaces")["error"]["code"] == "invalid-argument"
    page = ok("search", query="", limit=2)
    ids = [i["__global_id"] for i in page["items"]]
    while page["next_cursor"]:
        page = ok("search", query="", limit=2, cursor=page["next_cursor"])
        ids += [i["__global_id"] for i in page["items"]]
    assert ids == sorted(r[0] for r in g.objects.select("__global_id").collect()) and page["total"] == len(ids)
    wrong = {(d["type"], d["object"]) for d in ok("validate")["diagnostics"]}
    assert wrong == {("broken_link", "bob"), ("nested_workspace", "far")}
    assert [n["__global_id"] for n in ok("get_tree")["items"]] and ok("get_tree", mode="file")["success"] and ok("get_tree", mode="x")["error"]["code"] == "invalid-argument"
    got = ok("query_sql", sql="select __id from objects order by __global_id", limit=2, offset=1)
    assert len(got["items"]) == 2 and got["remaining"] == g.objects.count() - 3
    assert ok("query_sql", sql="delete from objects")["error"]["code"] == "not-read-only"
    assert ok("dump", kind="Person", limit=1)["total"] == 3 and ok("dump", namespace="none")["items"] == []
    walked = ok("traverse", start="house", depth=1)
    assert {n["id"] for n in walked["nodes"]} == {"town::ann", "town::house"}
    assert ok("find_path", **{"from": "bob", "to": "house"})["length"] == 2 and ok("find_path", **{"from": "bob", "to": "bob"})["length"] == 0
    assert ok("find_path", **{"from": "bob", "to": "town"})["error"]["code"] == "no-path"
    assert {k["__kind"]: k["count"] for k in ok("describe_metamodel")["kinds"]}["Person"] == 3
    assert ok("nothing")["error"]["code"] == "not-found" and ok("locate", wrong=1)["error"]["code"] == "invalid-argument" and "objects(" in ok("get_guide")["guide"]
    assert set(TOOLS) <= set(dir(g)) and len(TOOLS) == 14
    assert g.resource("object/bob")["fields"]["age"] == 40 and g.resource("what")["error"]["code"] == "not-found"
    assert g.run_sql_query("select count(*) as n from objects", "far/x.qmd.md")["rows"] == [[1]] and g.run_sql_query("select 1", "no.md")["error"]["code"] == "not-found"
    assert resolve_reference(g, "[[#Person:bob]]")["state"] == "resolved" and resolve_reference(g, "ann")["state"] == "ambiguous" and resolve_reference(g, "Place:bob")["state"] == "broken"


def test_search_by_meaning(g):
    e = embed.HashingEmbedder(64)
    store = g.index(e)
    assert {r.chunk_type for r in store["chunks"].collect()} >= {"child", "parent", "combined"}
    found = g.semantic_search("house note long", store, e, 3, 1).collect()
    assert found[0].object_id == "town::house"
    assert "town::house" not in {r.object_id for r in g.semantic_search("house note long", store, e, 3, 0, ["places.qmd.md"]).collect()}
    again = g.index(e, store["chunks"].join(store["vectors"], "chunk_id"))
    assert sorted(map(str, again["vectors"].collect())) == sorted(map(str, store["vectors"].collect()))
    hits = store["chunks"].select("chunk_id", "text")
    assert embed.rerank(hits, "long note on", embed.overlap).orderBy("score", ascending=False).first().chunk_id.startswith("town::house")
    whole = chunks.full_context(store["chunks"].filter("object_id = 'town::house'"), store["chunks"]).first()
    assert whole.chunks == 2 and whole.context.startswith("Place: House")
    up = chunks.parent_context(store["chunks"].filter("chunk_type = 'child' and object_id = 'town::house'").select("chunk_id"), store["chunks"]).first()
    assert up.parent_text.startswith("Place: House")
    assert chunks.delete(store["chunks"], store["chunks"].filter("chunk_id = 'town::house'")).filter("object_id = 'town::house'").count() == 0
    assert {(r.source_id, r.target_id) for r in chunks.explicit_edges(g.refs.selectExpr("__workspace", "__namespace", "__id", "raw", "'f' as source_field"), g.objects).collect()} >= {("town::ann", "town::house")}


def test_sections():
    text = "intro line\n\n# One\n" + "a b c. " * 30 + "\n\n# Two\n" + "\n\n".join("p" * 90 for _ in range(5)) + "\n\nName:\nshort"
    parts = chunks.by_sections(text, 250)
    assert all(len(t) <= 250 for _, t in parts) and [label for label, _ in parts][0] == "preamble"
    assert "".join("".join(t.split()) for _, t in parts) == "".join(text.split())
    assert chunks.by_sections("short", 10) == [("", "short")] and chunks.by_paragraphs("x" * 30, 10) == [("part_0_0", "x" * 30)]
    assert chunks.id_variants("abc17") == "abc17 ABC-17" and chunks.slug("## **A b** (c):") == "a_b"
    o = {"__id": "text_0", "__kind": "__TextBlock", "__file": "a/b.qmd.md", "__global_id": "w:n:text_0", "content": "x" * 40}
    assert [(c["chunk_id"], c["chunk_type"], c["text"]) for c in chunks.chunks_of(o)] == [("w:n:text_0@a_b", "combined", "x" * 40)]
    assert chunks.chunks_of({"__id": "a", "__kind": "K"}) == [] and chunks.text_fields({"a": "x"}, [{"after": "a", "content": "y"}, {"after": "__self", "content": "z"}]) == {"a": "x\n\ny", "__description": "z"}


def test_paths_and_trees_of_any_depth(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", "next") for i in range(70)], "source_id string, target_id string, edge_type string")
    assert graph.find_path(chain, "n000", "n055").first()["length"] == 55
    assert graph.find_path(chain, "n000", "nowhere").count() == 0
    objects = spark.createDataFrame([(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(100)] + [("c1", "c2"), ("c2", "c1"), ("lost", "gone")], "__id string, __parent string")
    got = {r.node: (r.top, r.depth) for r in graph.descendants(objects).collect()}
    assert got["n099"] == ("n000", 99) and got["n000"] == ("n000", 0) and got["lost"] == ("gone", 1) and got["c1"][0] is None


def test_local_ids_of_several_are_warnings(spark):
    o = spark.createDataFrame([("w", "n", f"a{i}.x", f"w:n:a{i}.x", "x", "K", "f", i, None) for i in range(2)] + [("w", "m", "b.y", "w:m:b.y", "y", "K", "f", 9, None)],
                              "__workspace string, __namespace string, __id string, __global_id string, __local_id string, __kind string, __file string, __line int, data string")
    r = spark.createDataFrame([("w", "n", "x"), ("w", "n", "y"), ("w", "n", "z"), ("w", "m", "y")], "__workspace string, __namespace string, raw string")
    assert {(x.raw, x.code, x.severity, x.message) for x in validation.diagnostics(r, o).collect()} == {
        ("x", "REF002", "warning", "ambiguous reference [[#x]]"), ("y", "REF001", "error", "broken reference [[#y]]. Did you mean [[#m:b.y]]?"), ("z", "REF001", "error", "broken reference [[#z]]")}


def test_settings():
    assert config.load("search:\n  top_k: 3", json.dumps({"search": {"depth": 0}, "own": 1})) == config.merged(config.DEFAULTS, {"search": {"top_k": 3, "depth": 0}, "own": 1})
    with pytest.raises(ValueError):
        config.load("- a list")


def test_refresh_takes_the_place_of_files(spark, tmp_path):
    seen = {}
    r = Refresh(spark, f"file://{tmp_path}/state", then=lambda n, w: seen.__setitem__(n, {(x["__id"], x["__label"]) for x in w.objects.collect()}))
    batch = lambda rows: spark.createDataFrame(rows, "file string, text string")
    r.batch(batch([("a.qmd.md", "# A [[a: K]]\n\n- to: [[#b]]\n"), ("readme.qmd.md", "# W [[w: __Workspace]]\n")]), 0)
    after = r.batch(batch([("b.qmd.md", "# B [[b: K]]\n")]), 1)
    assert [(e.source_id, e.target_id) for e in after.edges.collect()] == [("w::a", "w::b")]
    r.batch(batch([("b.qmd.md", None), ("a.qmd.md", "# A2 [[a: K]]\n")]), 2)
    r.batch(batch([("b.qmd.md", None), ("a.qmd.md", "# A2 [[a: K]]\n")]), 2)  # a batch that runs again
    assert seen[0] == {("a", "A"), ("w", "W")} and seen[1] == {("a", "A"), ("b", "B"), ("w", "W")} and seen[2] == {("a", "A2"), ("w", "W")}


def test_refresh_from_a_stream(spark, tmp_path):
    from docgraph.streaming.refresh import documents

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.qmd.md").write_text("# A [[a: K]]\n")
    seen = []
    r = Refresh(spark, f"file://{tmp_path}/state", then=lambda n, w: seen.append({x["__id"] for x in w.objects.collect()}))
    q = r.start(documents(spark, str(folder)), f"{tmp_path}/checkpoint")
    q.processAllAvailable()
    (folder / "b.qmd.md").write_text("# B [[b: K]]\n")
    q.processAllAvailable()
    q.stop()
    assert seen[-1] >= {"a", "b"}


def test_command_line(spark, tmp_path, capsys):
    from docgraph import cli

    for name, text in TEXTS.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    cli._session = lambda: spark
    assert cli.main(["parse", str(tmp_path / "people.qmd.md")]) == 0
    parsed = tmp_path / "people.json"
    parsed.write_text(capsys.readouterr().out)
    assert cli.main(["rebuild", str(parsed)]) == 0 and capsys.readouterr().out == TEXTS["people.qmd.md"]
    assert cli.main(["query", str(tmp_path), "#ages", "-w", "town"]) == 0 and capsys.readouterr().out.split() == ["age", "---", "30", "40"]
    assert cli.main(["query", str(tmp_path), "drop table x"]) == 1 and cli.main(["workspace", "validate", str(tmp_path)]) == 1
    assert cli.main(["workspace", "files", str(tmp_path)]) == 0 and capsys.readouterr().out.split("\n")[-2] == "far/x.qmd.md"

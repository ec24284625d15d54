"""Steps whose cost must follow their input: against plain versions, over several blocks, and by what they move."""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docgraph.operators import chunks, graph, text, validation, vector
from docgraph.sources import load, render
from docgraph.sources.parse import parse
from docgraph.storage import batches_of


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_of_several_blocks_is_exact(spark, monkeypatch):
    for name, n in (("BLOCK", 1024), ("LEAST_BLOCKS", 3), ("TILE", 40_000), ("SAMPLE", 64)):
        monkeypatch.setattr(vector, name, n)
    m = np.random.default_rng(3).normal(size=(2400, 5)).astype(np.float32)
    m[7::10] = m[7]  # ties, of more vectors than are kept
    m[9] = 0
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], "vec_id bigint, embedding array<float>")
    u = vector.unit(m.astype(np.float64))
    s = u @ u.T

    def want(place, floor):
        out = set()
        for a in range(len(s)):
            p = place(s[a])
            order = [b for b in np.lexsort((np.arange(len(p)), p)) if b != a and s[a, b] > floor][:6]
            out |= {(a, int(b), n) for n, b in enumerate(order, 1)}
        return out

    got = vector.knn_all(df, 6).collect()
    assert {(r["query"], r["vec_id"], r["rank"]) for r in got} == want(lambda x: np.round(1 - x, 12), -np.inf) and max(abs(1 - s[r["query"], r["vec_id"]] - r["distance"]) for r in got) < 1e-11
    near = vector.nearest(df, 6, lambda x: -np.round(x, 9), 0.9)
    assert {(r.a, r.b, r["rank"]) for r in near.collect()} == want(lambda x: -np.round(x, 9), 0.9)
    pairs = {(min(a, b), max(a, b)) for a, b, _ in want(lambda x: -np.round(x, 9), 0.9)}
    assert {(r.source_id, r.target_id) for r in vector.inferred_edges(df, 0.9, 6).collect()} == pairs


def test_nearest_of_none_and_one(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id bigint, embedding array<float>")
    assert vector.knn_all(df, 3).count() == 0 and vector.inferred_edges(df.limit(0), 0.5).count() == 0


def test_documents_of_one_partition_are_parsed_in_several(spark):
    texts = {f"f{i}.qmd.md": f"# A{i} [[a{i}: K]]\n\n- to: [[#b]]\n\n# B [[b: K]]\n\n- n: {i}\n" for i in range(1200)}
    df = spark.createDataFrame([(f, x, f[1]) for f, x in texts.items()] + [("none", None, "x")], "file string, text string, first string").coalesce(1)
    rows = load.parse_files(df, keep=("first",))
    assert rows.rdd.getNumPartitions() == 3
    got = {(r.file, r.ordinal): (r.first, json.loads(r.object)) for r in rows.collect()}
    assert got == {(f, n): (f[1], json.loads(json.dumps(o))) for f, x in texts.items() for n, o in enumerate(parse(x, 666, "full"))}
    back = render.documents(load.last_rows(rows.orderBy(F.desc("ordinal"))))
    assert "Pandas" not in plan(back)
    assert {r.file: r.text for r in back.collect()} == {f: render.rebuild(parse(x, 666, "full")) for f, x in texts.items()}


def test_batches_are_cut_by_rows_and_by_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["x" * 10] * 4 + [None] + ["y" * 100] + ["z"] * 3)], ["n", "t"])
    parts = list(batches_of(b, 1, rows=3, most=25))
    assert [p.num_rows for p in parts] == [2, 3, 1, 3] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))


def test_chunks_come_in_small_batches(spark):
    df = spark.range(1200).selectExpr("'d' || id as __id", "'Doc' as __kind", "'' as __label", "'f' as __file", "'w:n:d' || id as __global_id", "to_json(struct(repeat('word ', 20) as text)) as data")

    class Taken:  # extract's own function, applied here
        def __getattr__(self, name):
            return lambda *a: a[0] if name == "mapInArrow" else self

    read = chunks.extract(Taken())
    sizes = [b.num_rows for b in read(iter(df.withColumn("comments", F.lit(None).cast("string")).toArrow().combine_chunks().to_batches()))]
    assert sum(sizes) == 1200 and max(sizes) <= 1000


def test_paths_to_several_ends_are_one_walk(spark):
    e = spark.createDataFrame([("s", "b", "x"), ("s", "a", "x"), ("a", "t", "x"), ("t", "b", "x"), ("t", "u", "x"), ("far", "away", "x"), ("s", "t2", "y")], "source_id string, target_id string, edge_type string")
    got = {r.end: (r.path, r.length) for r in graph.find_paths(e, "s", ["s", "t", "u", "away", "ghost", "t", "b"]).collect()}
    assert got == {"s": (["s"], 0), "b": (["s", "b"], 1), "t": (["s", "a", "t"], 2), "u": (["s", "a", "t", "u"], 3)}
    assert graph.find_path(e, "s", "t2", "x").count() == 0 and graph.find_path(e, "ghost", "ghost").first().path == ["ghost"]


def test_parents_by_level_of_any_file(spark):
    rng = np.random.default_rng(5)
    rows = [(f"f{rng.integers(3)}", int(rng.integers(12)), int(rng.integers(1, 5)), f"g{i:03}") for i in range(300)] + [("f1", None, 2, "x"), ("f1", 3, None, "y"), (None, 3, 1, "z")]
    df = spark.createDataFrame(rows, "__file string, __line bigint, __level bigint, __global_id string")
    whole = [r for r in rows if None not in r]
    want = {r[3]: max(((b[1], b[3]) for b in whole if r in whole and b[0] == r[0] and b[1] < r[1] and b[2] < r[2]), default=(None, None))[1] for r in rows}
    found = graph.level_parents(df)
    assert {r["__global_id"]: r.parent_id for r in found.collect()} == want and "Pandas" not in plan(found)


def test_checks_hold_no_set_of_all_ids(spark):
    o = spark.createDataFrame([("w", "n", "a", "l", None, '{"name":1}'), ("w", "n", "b", "l", "a", "{}"), ("w", "n", "a.name", "m", "gone", "{}"), ("w", "n", "k", None, "b", '{"name":1}'), ("w", "m", "k", "l2", None, "[1]"), ("w", "m", "q", "l2", None, None)],
                              "__workspace string, __namespace string, __id string, __local_id string, __parent string, data string").withColumn("__global_id", F.concat("__namespace", F.lit(":"), "__id"))
    lost = validation.broken_parents(o)
    assert [r["__parent"] for r in lost.collect()] == ["gone"] and "Aggregate" not in plan(lost)
    refs = spark.createDataFrame([("w", "n", "a.name"), ("w", "n", "a.name"), ("w", "n", "b.name"), ("w", "n", "k.name")], "__workspace string, __namespace string, raw string")
    both = validation.ambiguous_fields(refs, o)
    assert [r.raw for r in both.collect()] == ["a.name"] * 2 and "Aggregate" not in plan(both) and "Generate" not in plan(both)
    refs = spark.createDataFrame([("w", "n", "l"), ("w", "n", "x:l"), ("w", "m", "l2"), ("w", "n", "l2"), ("w", "n", "a"), ("w", "n", "m")], "__workspace string, __namespace string, raw string")
    many = validation.ambiguous_locals(refs, o)
    assert sorted((r.raw, r.candidates) for r in many.collect()) == [("l", 2), ("l2", 2), ("x:l", 2)]
    assert validation.ambiguous_locals(refs, o.union(o.filter("__id = 'q'").withColumn("__id", F.lit("l")))).filter("raw = 'l'").count() == 0


def test_search_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    c = spark.createDataFrame([(1, "The cat"), (2, "a dog and the dog"), (3, None), (4, "Dogma")], "chunk_id bigint, text string").mapInArrow(counted, "chunk_id bigint, text string")
    assert {r.chunk_id for r in text.keyword_search(c, "dog the").collect()} == {1, 2} and read.value == 4
    assert {r.chunk_id for r in text.substring_search(c, "dog").collect()} == {2, 4} and read.value == 8

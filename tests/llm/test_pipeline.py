"""The pipeline against its stages' plain versions, and each stage on awkward tables."""

import importlib
import random
from collections import Counter

import pytest

from data import awkward, awkward_rows, key, prints_apart, prose
from docgraph.llm import decontamination, mixing, quality, simhash

corpus_pipeline = importlib.import_module("corpus_pipeline")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, folder, documents, schema, labels, benchmark):
    for name, rows, s in (("documents", documents, schema), ("labels", labels, "doc_id bigint, quality int, toxic int"), ("benchmark", benchmark, "item_id bigint, text string")):
        spark.createDataFrame(rows, s).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    junk = [" ".join(random.Random(i).choices(["BUY", "$$$", "click", "!!!", "win"], k=50)) for i in range(40)]
    good = [prose(i, 60) for i in range(80)]
    copies = [good[i] for i in range(10)] + [good[i].replace(good[i].split()[7], "other", 1) for i in range(10, 20)]
    leaks = [prose(500 + i, 40) + " " + prose(900 + i % 4, 12) for i in range(12)]
    texts = good + copies + leaks + junk + [None, "", "!!"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 112), 0) for i in range(152) if i % 2]
    folder = tables(spark, tmp_path_factory.mktemp("corpus"), rows, COLUMNS, labels, [(k, prose(900 + k, 12)) for k in range(4)])
    return folder, rows


def test_run_is_its_stages_in_turn(spark, corpus):
    folder, rows = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    texts = {r[0]: r for r in rows}
    labels, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("labels", "benchmark"))
    docs = spark.createDataFrame(rows, COLUMNS)
    good = {r.doc_id for r in quality.score_quality(docs, labels).collect() if r["keep"]}
    kept = [r for r in rows if r[0] in good]
    moved = {r.doc_id: r.keeper_id for r in simhash.near_copies(spark.createDataFrame(kept, COLUMNS)).collect()}
    kept = [r for r in kept if moved.get(r[0], r[0]) == r[0]]
    windows = {tuple(decontamination.normal(t).split()[j:j + 8]) for (t,) in bench.select("text").collect() for j in range(5)}
    words = lambda t: decontamination.normal(t).split()
    kept = [r for r in kept if not any(tuple(words(r[1])[j:j + 8]) in windows for j in range(len(words(r[1]))))]
    ids = {r[0] for r in kept}
    assert not ids & set(range(80, 112)) and len(ids & set(range(80))) > 75 and len(ids - set(range(80))) < 3  # copies, leaks and junk are gone
    by_source = Counter()
    for r in got:
        by_source[r.source] += len(r.text)
        assert tuple(r)[:5] == texts[r.doc_id]
    assert {r.doc_id for r in got} <= {r[0] for r in kept}
    total, weights = sum(len(r[1]) for r in kept), {f"src{i}": mixing.WEIGHTS[f"src{i}"] for i in range(3)}
    for s, w in weights.items():
        assert abs(by_source[s] - total * w / sum(weights.values())) < 0.1 * total
    n = len(got)
    assert max(Counter(r.shard for r in got).values()) <= -(-1.05 * n // 64) and n
    assert ORDER == [name for name, _ in corpus_pipeline.STAGES]


ORDER = ["quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights", "sharding"]


def test_stages_on_awkward_tables(spark, tmp_path):
    folder = tables(spark, tmp_path, [], COLUMNS, [(1, 1, 0), (2, 1, None), (None, 1, 0), (6, 0, 0)], [(1, prose(2, 60)), (None, None)])
    every = {key(r) for r in awkward_rows()}
    for name, stage in corpus_pipeline.STAGES:
        for empty in (False, True):
            docs = awkward(spark).limit(0) if empty else awkward(spark)
            out = stage(spark, docs, folder)
            rows = out.collect()
            if name != "sharding":
                assert out.columns == docs.columns and {key(r) for r in rows} <= every
            else:
                assert out.columns.count("shard") == 1 and len(rows) == (0 if empty else 12)
            assert not rows if empty else rows, name


def test_run_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], COLUMNS, [], [])).collect() == []


def test_near_dedup_drops_every_copy_within_the_distance(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"text {i}", "en", "src0", 6) for i in range(120)], COLUMNS)
    rows = [(i, *map(int, p)) for i, p in enumerate(prints_apart(60, simhash.DISTANCE).view("int64"))]
    prints = spark.createDataFrame(rows, "doc_id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    monkeypatch.setattr(simhash, "_print_table", lambda docs: docs.selectExpr("doc_id", "xxhash64(text) as text_hash").join(prints, "doc_id"))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, texts, "").collect()} == set(range(60))

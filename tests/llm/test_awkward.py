"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import os

import pytest

from data import AWKWARD, awkward, awkward_rows, key, prose
from docgraph.llm import decontamination, line_dedup, lm_scoring, mixing, quality, records, secret_scan, sharding, simhash, warc
from docgraph.llm.common import shared_path

LABELS = "doc_id bigint, quality int, toxic int, keep string"
BENCH = "item_id bigint, text string, doc_id int"


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, 1, 0, "x"), (1, 1, 0, "x"), (2, 1, None, "x"), (None, 1, 0, "x"), (6, 0, 0, "x"), (7, None, None, "x"), (7, 1, 0, "x")], LABELS)


def benchmark(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, prose(2, 60), 3), (None, prose(77, 10), 3), (3, None, 3), (4, "", 3), (5, "one", 3)], BENCH)


CAPTURES = "record_id bigint, url string, ts bigint, kind string, status int, headers map<string,string>, payload string, canonical string, State string, source_id int, `_0` int, full string, is_full int"


def captures(spark, rows):
    return spark.createDataFrame([r + ("c", "s", 1, 2, "f", 3) for r in rows], CAPTURES)


OPS = {
    "sharding": lambda s, d, e: sharding.assign_shards(d, 4, 8),
    "find_leaks": lambda s, d, e: decontamination.find_leaks(d, benchmark(s, e)),
    "decontaminate": lambda s, d, e: decontamination.decontaminate(d, benchmark(s, e)),
    "line_dedup": lambda s, d, e: line_dedup.drop_recurring_lines(d, documents=2),
    "records": lambda s, d, e: records.write_records(d, shared_path(s, "r")),
    "secrets": lambda s, d, e: secret_scan.secret_ownership(d),
    "mixing": lambda s, d, e: mixing.mix(d),
    "lm": lambda s, d, e: lm_scoring.score(d),
    "near_copies": lambda s, d, e: simhash.near_copies(d),
    "drop_near_copies": lambda s, d, e: simhash.drop_near_copies(d),
    "score_quality": lambda s, d, e: quality.score_quality(d, labels(s, e)),
    "warc": lambda s, d, e: warc.resolve_revisits(captures(s, [])),
    "keep_quality": lambda s, d, e: quality.keep_quality(d, labels(s, e)),
}


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, name):
    assert OPS[name](spark, spark.createDataFrame([], AWKWARD), True).collect() == []


def lower(cols):
    return [c.lower() for c in cols]


def test_sharding(spark):
    got = OPS["sharding"](spark, awkward(spark), False)
    assert got.columns.count("shard") == 1 and len(got.columns) == len(awkward(spark).columns)
    rows = got.collect()
    assert sorted((key(r[:5]) for r in rows)) == sorted(key(r[:5]) for r in awkward_rows())
    assert max(sum(r["shard"] == s for r in rows) for s in range(4)) <= -(-1.05 * 12 // 4)


def test_decontamination(spark):
    leaks = {(r.doc_id, r.item_id) for r in OPS["find_leaks"](spark, awkward(spark), False).collect()}
    assert leaks == {(2, 1), (7, 1), (7, None), (7, 5)}  # the long text has the first 12 words of two items, and the word 'one'
    kept = OPS["decontaminate"](spark, awkward(spark), False)
    assert kept.columns == awkward(spark).columns
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in awkward_rows() if r[0] not in (2, 7))
    assert sorted(map(key, OPS["decontaminate"](spark, awkward(spark), True).collect())) == sorted(map(key, awkward_rows()))


def test_line_dedup(spark):
    rows = OPS["line_dedup"](spark, awkward(spark), False).collect()
    by = {(r.doc_id, r.source): r for r in rows}
    assert len(rows) == 12 and by[4, "src0"].text is None and by[5, "src0"].text == "" and by[7, "src2"]["dropped"] == 0
    assert [r.text for r in rows if r.doc_id in (1, 8)] == ["", "", ""]
    assert by[2, None].text == prose(2, 60)


def test_records(spark):
    folder = shared_path(spark, "records")
    rows = records.write_records(awkward(spark), folder).collect()
    assert len(rows) == 12 and {r.tokens for r in rows if r.doc_id in (4, 5)} == {0}
    tokens = records.Tokens(records.default_vocabulary())
    seven = next(r for r in rows if r.doc_id == 7)
    with open(os.path.join(folder.removeprefix("file://"), "data", seven["file"]), "rb") as f:
        assert records.read_record(f, seven.start_at).tolist() == tokens.whole.encode_ordinary(awkward_rows()[6][1])


def test_secrets(spark):
    secret = 'api_key = "q8Zr71LmXw0PdTqa"'
    rows = [(None, secret, None, None, None), (1, secret + prose(1, 9) + secret, "en", "a", 1), (1, secret, "en", "a", 1), (2, None, "en", "b", 1), (3, "", "en", "b", 1)]
    got = secret_scan.secret_ownership(spark.createDataFrame([r + (None,) * 12 for r in rows], AWKWARD)).collect()
    assert [(r.kind, r.owners, r.repositories, r.occurrences, r.verdict) for r in got] == [("assigned", 2, 2, 4, "shared")]


def test_mixing(spark):
    got = OPS["mixing"](spark, awkward(spark), False)
    assert got.columns.count("copy") == 1
    texts = {r.text for r in got.collect()}
    assert texts <= {r[1] for r in awkward_rows()}
    assert mixing.mix(spark.createDataFrame([(1, None, None, None, None) + (None,) * 12], AWKWARD)).count() == 0
    weights = {"": 9, "src0": 5, "src1": 3, "src2": 1}  # '' is not the null source, which has the default weight of 1
    everything = mixing.mix(awkward(spark), weights=weights, total=120, unit="docs").collect()
    for source, weight in ((None, 1), ("src0", 5), ("src1", 3), ("src2", 1)):
        assert abs(sum(r.source == source for r in everything) - 120 * weight / 10) < 1, source
    for digits in (3, 5):
        again = mixing.mix(awkward(spark), weights=weights, total=120, unit="docs", digits=digits).collect()
        assert sorted(map(key, again)) == sorted(map(key, everything))


def test_sources_without_characters_take_no_share(spark):
    d = spark.createDataFrame([(1, "x" * 100, "a"), (2, None, "b"), (3, "", "b"), (4, None, None)], "doc_id bigint, text string, source string")
    assert [r.doc_id for r in mixing.mix(d, {"a": 1, "b": 1}, total=1000).collect()] == [1] * 10


def test_lm(spark):
    rows = OPS["lm"](spark, awkward(spark), False).collect()
    assert len(rows) == 12
    assert {(r.tokens, r.log_prob, r.mean_log_prob) for r in rows if r.doc_id in (4, 5)} == {(0, 0.0, None)}
    assert len({r.log_prob for r in rows if r.doc_id in (1, 8)}) == 1 and all(r.log_prob < 0 for r in rows if r.tokens)


def test_near_copies(spark):
    got = OPS["near_copies"](spark, awkward(spark), False).collect()
    assert sorted((r.doc_id, r.keeper_id) for r in got) == [(1, 1), (1, 1), (8, 1)]
    kept = OPS["drop_near_copies"](spark, awkward(spark), False)
    assert kept.columns == awkward(spark).columns
    once = [r for i, r in enumerate(awkward_rows()) if i not in (7, 8)]
    assert sorted(map(key, kept.collect())) == sorted(map(key, once))
    assert [r.keeper_id for r in simhash.near_copies(spark.createDataFrame([(None, prose(1, 60)), (None, prose(1, 60))], "doc_id bigint, text string")).collect()] == [None, None]


def test_quality(spark):
    rows = OPS["score_quality"](spark, awkward(spark), False).collect()
    assert len(rows) == 12 and all((r.score is None) == (r.ngrams == 0) for r in rows)
    assert not any(r.keep for r in rows if r.score is None)
    assert all(not r.keep for r in rows if r.doc_id in (4, 5))
    kept = OPS["keep_quality"](spark, awkward(spark), True)
    assert kept.columns == awkward(spark).columns
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in awkward_rows() if r[1])


def test_warc(spark):
    big = "<p>" + "long " * 200_000
    rows = [(1, "http://a.org/x", 5, "response", 200, {"etag": "t"}, big), (1, "http://a.org/x", 5, "response", 200, {"etag": "t"}, big), (2, "http://www.a.org/x/", 9, "revisit", 304, {"etag": "t"}, None),
            (2, "http://www.a.org/x/", 9, "revisit", 304, {"etag": "t"}, None), (3, None, 9, "revisit", 304, {"etag": "t"}, None), (4, "http://a.org/x", None, "revisit", 304, None, None),
            (5, "http://a.org/y", 1, "response", 200, None, ""), (6, "http://a.org/y", 2, "revisit", 304, None, None), (7, "http://a.org/x", 1, "revisit", 304, {"etag": "t"}, None),
            (None, "http://a.org/x", 7, "revisit", 304, {"etag": "u"}, None), (8, None, None, None, None, None, None), (9, "http://a.org/z", 1, "response", 200, {"etag": "e"}, ""), (10, "http://a.org/z", 3, "revisit", 304, {"etag": 'W/e'}, "ignored")]
    got = warc.resolve_revisits(captures(spark, rows))
    assert got.columns == ["record_id", "canonical", "ts", "state", "source_id", "headers", "payload"]
    by = sorted(((r.record_id or 0, r.state, r.source_id, None if r.payload is None else len(r.payload)) for r in got.collect()), key=str)
    assert by == sorted([(2, "resolved", 1, len(big)), (2, "resolved", 1, len(big)), (3, "orphan", None, None), (4, "orphan", None, None), (6, "unvalidated", 5, None), (7, "orphan", None, None),
                         (0, "mismatch", 1, None), (10, "resolved", 9, 0)], key=str)


def test_secrets_in_very_long_text(spark):
    text = prose(3, 60_000) + ' token: "q8Zr71LmXw0PdTqa" ' + prose(4, 60_000)
    got = secret_scan.secret_ownership(spark.createDataFrame([(1, text, "en", "a", 1) + (None,) * 12], AWKWARD)).collect()
    assert [(r.kind, r.occurrences, r.verdict) for r in got] == [("assigned", 1, "live")]


def test_ids_that_are_no_numbers(spark):
    d = spark.createDataFrame([("x1", prose(1, 60), "src0"), ("x2", prose(1, 60), "src0"), ("7", prose(2, 60), "src1")], "doc_id string, text string, source string")
    assert [r.doc_id for r in decontamination.find_leaks(d, benchmark(spark)).collect()] == [7]
    assert sorted(r["dropped"] for r in line_dedup.drop_recurring_lines(d, documents=2).collect()) == [0, 0, 0]  # two null ids with one text are one document
    assert {r.doc_id for r in lm_scoring.score(d).collect()} == {None, 7}
    assert len(simhash.drop_near_copies(d).collect()) == 2 and {r.doc_id for r in quality.score_quality(d, labels(spark)).collect()} == {None, 7}
    assert len(records.write_records(d, shared_path(spark, "r")).collect()) == 3 and len(sharding.assign_shards(d, 2, 4).collect()) == 3

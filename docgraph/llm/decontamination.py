"""Benchmark decontamination with one Aho-Corasick automaton.

Patterns are the word windows (``words`` long) of all normalised test
questions and answers; a text with fewer words is a pattern whole, however
short.  One of fewer than ``least`` words ("yes", a name) says little alone:
where its item has a longer text too (a question and its answer are rows of one
item_id), it counts only in documents that have a match of that one.  A short
text whose item has no longer one counts wherever it stands.

Each text is normalised the same way and scanned once.  Matches of one item
whose words overlap or touch are one span, given by character offsets into the
original text; the offsets are worked out only for texts with a match; an item
with a null id is one with that id.

Normal form: the words (runs of letters, digits and combining marks) in NFKC
and lower case, so that case, punctuation and white space don't matter.

The automaton is built once in each Python worker from the benchmark's
patterns, which go out as a broadcast; its size is that of the benchmark and
doesn't grow with the documents.  The benchmark's words are counted in Spark
first: one of more than ``most_words`` (some 2 kB of a worker's memory each) is
dealt by item to as many automata as that takes, each over its own scan of the
documents, so that memory stays bounded and nothing is left out.  No document
is shuffled.

Nulls: a null text or item matches nothing, as does an empty one.  A text of
any length is scanned whole.  Items with equal passages each get their spans;
repeated documents each get theirs; a null doc_id stays null.  An empty
benchmark matches nothing, an empty table gives an empty result.  Ids are
whole numbers; an id that is none (a text) counts as null.  Extra columns pass through ``decontaminate`` and are ignored by ``find_leaks``,
whatever their names.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import Columns, batches_of, filtered, table, written

WORD = re.compile(f"[\\w{chr(0x300)}-{chr(0x36F)}]+")  # underscores are taken out of a text before
WORDS, LEAST, MOST_WORDS = 8, 3, 200_000
LEAKS = "doc_id bigint, item_id bigint, start_at int, end_at int"


def normal(text: str) -> str:
    """Words of a text in normal form, each after a line end, and a line end at the end; '' without words."""
    found = WORD.findall(text.replace("_", " "))
    if not found:
        return ""
    joined = "\n" + "\n".join(found) + "\n"
    if not joined.isascii():
        joined = unicodedata.normalize("NFKC", joined).replace(" ", "")
    return joined.lower()


def patterns(items: list[tuple[int, str]], words: int = WORDS, least: int = LEAST) -> dict[str, list[tuple[int, bool]]]:
    """Pattern: the items that have it, and whether it is a short one that counts only with a longer one of its item."""
    split = [(item, normal(text or "").split("\n")[1:-1]) for item, text in items]
    longer = {item for item, own in split if len(own) >= least}
    found: dict[str, dict[int, bool]] = {}
    for item, own in split:
        short = len(own) < least and item in longer
        for i in range(max(1, len(own) - words + 1) if own else 0):
            ids = found.setdefault("\n" + "\n".join(own[i:i + words]) + "\n", {})
            ids[item] = short and ids.get(item, True)
    return {p: list(ids.items()) for p, ids in found.items()}


def automaton(of: dict[str, list[tuple[int, bool]]]) -> ahocorasick.Automaton | None:
    if not of:
        return None
    a = ahocorasick.Automaton()
    for p, ids in of.items():
        a.add_word(p, (p.count("\n") - 1, ids))
    a.make_automaton()
    return a


def spans(text: str | None, a: ahocorasick.Automaton | None) -> list[tuple[int, int, int]]:
    """(item, start, end) of the text's leaks, in order."""
    if not text or a is None:
        return []
    form = normal(text)
    ends: dict[int, list[tuple[int, int]]] = {}
    sure: set[int] = set()
    counted, upto = 0, 1
    for end, (n, ids) in a.iter(form):
        counted += form.count("\n", upto, end + 1)  # words that end at or before this place
        upto = end + 1
        for item, short in ids:
            ends.setdefault(item, []).append((counted - n, counted))
            if not short:
                sure.add(item)
    if not sure:
        return []
    places = [m.span() for m in WORD.finditer(text.replace("_", " "))]
    found = []
    for item, runs in ends.items():
        if item not in sure:
            continue
        runs.sort()
        low, high = runs[0]
        for lo, hi in runs[1:]:
            if lo > high:
                found.append((item, places[low][0], places[high - 1][1]))
                low, high = lo, hi
            high = max(high, hi)
        found.append((item, places[low][0], places[high - 1][1]))
    return sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1:]))


def leaks(text: str | None, a: ahocorasick.Automaton | None) -> bool:
    """Whether the text has any leak."""
    return bool(text) and a is not None and any(not short for _, (_, ids) in a.iter(normal(text)) for _, short in ids)


_built: dict[str, tuple] = {}


def _automaton_of(shared) -> ahocorasick.Automaton | None:
    """The worker's automaton for a broadcast, built once."""
    if shared.value["key"] not in _built:
        _built.clear()
        _built[shared.value["key"]] = (automaton(shared.value["patterns"]),)
    return _built[shared.value["key"]][0]


def _shared(benchmark: DataFrame, words: int, least: int, most_words: int) -> list:
    """A broadcast of patterns for each part of the benchmark of ``most_words`` words; an item is whole in one of them."""
    b = Columns(benchmark, ["item_id", "text"]).only().filter("text is not null").withColumn("item_id", F.col("item_id").try_cast("bigint"))
    held = b.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    parts = max(1, -(-held // most_words))
    found = []
    for part in range(parts):
        items = [(r[0], r[1]) for r in b.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()]
        of = patterns(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])), words, least)
        found.append(benchmark.sparkSession.sparkContext.broadcast({"key": uuid.uuid4().hex, "patterns": of}))
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, item_id and offsets of every passage of the benchmark in the documents."""
    d = Columns(docs, ["doc_id", "text"]).only().withColumn("doc_id", F.col("doc_id").try_cast("bigint"))

    def scanned(shared) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = _automaton_of(shared)
            for b in (part for whole in batches for part in batches_of(whole, 1)):
                out: list[list] = [[], [], [], []]
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item, start, end in spans(text, a):
                        for column, value in zip(out, (doc, item, start, end)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], ["doc_id", "item_id", "start_at", "end_at"])

        return d.mapInArrow(scan, LEAKS)

    return functools.reduce(DataFrame.unionAll, [scanned(shared) for shared in _shared(benchmark, words, least, most_words)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """The documents that hold no passage of the benchmark, as they are."""
    for n, shared in enumerate(_shared(benchmark, words, least, most_words)):
        def clean(b: pa.RecordBatch, shared=shared) -> list[bool]:
            a = _automaton_of(shared)
            return [not leaks(t, a) for part in batches_of(b, 0) for t in part.column(0).to_pylist()]

        docs = filtered(written(docs, "clean") if n else docs, ["text"], clean)  # one automaton in a worker at a time
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontamination": op2_decontamination}
ORACLE_SQL: dict[str, str] = {}

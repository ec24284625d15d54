"""Line dedup with a log-template tree.

Lines are parsed by a tree of fixed depth: by their number of tokens, then by
their leading tokens (one with a digit counts as variable).  Within a leaf,
lines join the first template most like them, if at least ``alike`` of the
positions agree, and positions that differ become variable.  A template found
in ``documents`` distinct documents or more recurs; its lines are dropped from
all of them.  A line of fewer than ``tokens`` tokens only counts if it recurs
as it is, and one of fewer than ``least`` never.

The tree's inner levels are a hash of (count, leading tokens): lines of a leaf
in too few documents can't recur and drop out before any text moves.  What is
left is grouped by leaf, each distinct line once, and templates are found leaf
by leaf, in the lines' order, so that the result doesn't depend on partitions.
Texts are then joined to the numbers of their dropped lines by 128 bits of hash
of the text.

Nulls: a null text stays null, an empty one empty.  Documents are told apart
by doc_id; rows with a null doc_id by their text.  Repeated rows with one
doc_id count once and get the same text.  Lines of any length are compared
whole.  An id that is no whole number counts as null.  Lines are what stands between '\\n'; blank ones are kept.  An empty
table gives an empty result.  Extra columns pass through, whatever their
names; one named like a new column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import Columns, batches_of, table, two_hashes, written

DOCUMENTS, ALIKE, DEPTH = 5, 0.7, 3
VARIABLE = "<*>"
_DIGIT, _DIGITS = re.compile("[0-9]"), re.compile(r"[^ ]*[0-9][^ ]*")


def find_templates(lines: list[str], alike: float = ALIKE) -> list[int]:
    """For each of a leaf's distinct masked lines, sorted, the number of its template."""
    split = [line.split(" ") for line in lines]
    words: dict[str, int] = {VARIABLE: 0}
    coded = np.array([[words.setdefault(w, len(words)) for w in s] for s in split], np.int32)
    templates = np.zeros((16, coded.shape[1]), np.int32)
    n, own = 0, []
    for line in coded:
        agree = ((templates[:n] == line) & (line != 0)).sum(1) if n else np.zeros(0)
        best = int(agree.argmax()) if n else -1
        if n and agree[best] >= alike * len(line):
            templates[best][templates[best] != line] = 0
        else:
            if n == len(templates):
                templates = np.concatenate([templates, np.zeros_like(templates)])
            best, n = n, n + 1
            templates[best] = line
        own.append(best)
    return own


def parsed(text: str, depth: int = DEPTH) -> Iterator[tuple[int, int, str]]:
    """Number, leaf and masked tokens (by single spaces, those with a digit as the variable) of a text's lines."""
    for i, line in enumerate(text.split("\n")):
        found = line.split()
        if found:
            masked = " ".join(found)
            if _DIGIT.search(masked):
                masked = _DIGITS.sub(VARIABLE, masked)
                found = masked.split(" ", depth)
                n = masked.count(" ") + 1
            else:
                n = len(found)
            yield i, xxhash.xxh64_intdigest(f"{n} {' '.join(found[:depth])}") - 2**63, masked


def drop_recurring_lines(docs: DataFrame, documents: int = DOCUMENTS, alike: float = ALIKE, depth: int = DEPTH) -> DataFrame:
    """Documents without their recurring lines; ``dropped`` counts them."""
    cols = Columns(docs, ["doc_id", "text"])
    keyed = cols.df.filter("_1 is not null and _1 != ''").select(*two_hashes("_1"), F.coalesce(F.col("_0").try_cast("bigint"), F.xxhash64("_1")).alias("doc"), "_1")

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, doc = [], []
            for d, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                own = {x[1] for x in parsed(text, depth)}
                leaf += own
                doc += [d] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(doc, pa.int64())], ["leaf", "doc"])

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in batches_of(whole, 3)):
            own = [list(parsed(text, depth)) for text in b.column(3).to_pylist()]
            many = [len(x) for x in own]
            flat = [x for lines in own for x in lines]
            heads = b.select([0, 1, 2]).take(pa.array(np.repeat(np.arange(len(many)), many)))
            yield pa.RecordBatch.from_arrays([*heads.columns, pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.string())],
                                             ["text_hash", "text_hash2", "doc", "no", "leaf", "line"])

    leaves = (keyed.mapInArrow(leaves_of, "leaf bigint, doc bigint").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= documents).select("leaf"))
    lines = keyed.mapInArrow(lines_of, "text_hash bigint, text_hash2 bigint, doc bigint, no int, leaf bigint, line string")
    kept = written(lines.join(leaves, "leaf", "left_semi"), "leaf-lines")

    def per_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
        by_count: dict[int, list[str]] = {}
        for line in sorted(pdf["line"]):
            by_count.setdefault(line.count(" "), []).append(line)
        rows = []
        for n, own in by_count.items():  # one, unless two leaves share a hash
            rows += [(line, f"{n}:{t}") for line, t in zip(own, find_templates(own, alike))]
        return pd.DataFrame({"leaf": pdf["leaf"].iloc[0], "line": [r[0] for r in rows], "template": [r[1] for r in rows]})

    found = kept.select("leaf", "line").distinct().groupBy("leaf").applyInPandas(per_leaf, "leaf bigint, line string, template string")
    of_lines = kept.join(found, ["leaf", "line"]).select("leaf", "template", "doc", "text_hash", "text_hash2", "no")
    often = of_lines.select("leaf", "template", "doc").distinct().groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") >= documents)
    dropped = of_lines.join(often, ["leaf", "template"], "left_semi").groupBy("text_hash", "text_hash2").agg(F.collect_set("no").alias("nos"))
    joined = cols.df.select("*", *two_hashes("_1")).join(dropped, ["text_hash", "text_hash2"], "left")
    changed = F.col("nos").isNotNull() & F.col("_1").isNotNull()
    left = F.array_join(F.filter(F.split("_1", "\n"), lambda x, i: ~F.array_contains("nos", i)), "\n")
    return cols.restore(joined, text=F.when(changed, left).otherwise(F.col("_1")), dropped=F.when(changed, F.size("nos")).otherwise(0))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE_SQL: dict[str, str] = {}

"""A training corpus from the raw documents, in five stages.

Quality rules, near-dedup, benchmark decontamination, mixing of sources to
their target weights, sharding.  Each stage takes what the one before it kept,
written as Parquet and read again, and every stage but the last gives back the
columns of its input; the last adds the shard.  A mixture repeats documents:
rows of one document go to one shard unless that one fills up.

SQL can't express quality rules, fingerprints or an automaton: ORACLE_SQL is
None, and tests hold run() against the stages in turn, applied to plain rows.

Nulls, empty tables, repeated rows and extra columns: as the operators say.  A
document with a null, empty or word-less text ends at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgraph.llm.common import table, written
from docgraph.llm.decontamination import decontaminate
from docgraph.llm.mixing import WEIGHTS, mix
from docgraph.llm.quality import keep_quality
from docgraph.llm.sharding import assign_shards
from docgraph.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, WEIGHTS, out=None)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign_shards(docs)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
          ("mixing to target weights", mixing), ("sharding", sharding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Mixing sources to target weights by systematic sampling.

Every document of source s is expected ``w_s * T / (W * n_s)`` times, where
T is the size wanted, n_s the size of the source (characters, or documents)
and W the sum of the weights of the sources present, so that each source's
share of what comes out is its share of the weights.  Within a source the
expected copies are summed along the documents in the order of a hash of
their id; one offset, drawn from the seed for each source, is added; a
document comes out once for each integer its running sum crosses.  The number
of copies of a document is thus always its expected number rounded down or up,
and of a source in all off by less than one.

The running sum takes two steps: sums of equal slices of the hash in each
source, then sums within a slice.  There are 16 to the ``digits`` slices, as
many as leave each some ``PER_SLICE`` documents of a source that has them all,
so that a task's share doesn't grow with the corpus; the result is the same for
any number of them.  Documents are shuffled once, by source and slice, and
what is joined to them is one row a slice, laid out alike.  All sums are of
whole millionths.

Nulls: a null source is a source of its own (named '' for its offset; its
weight is the default one, also where '' has another); null text has size 0; a
null id hashes as ''.  A source without characters has no share when sizes are
characters: its documents never come out and its weight is the others'.  Equal ids are ordered by a hash of their text; rows equal in both
are alike, and which of them is repeated makes no difference.  An empty table
gives an empty result.  Input columns named like the result's new one are
replaced; other extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.llm.common import Columns, table

UNIT = 1_000_000
SEED = 17
PER_SLICE = 1 << 14
#: Target weights of the query op6_mixing; a source that isn't named has weight 1.
WEIGHTS = {f"src{i}": 1 + i % 4 for i in range(20)}


def mix(docs: DataFrame, weights: Mapping[str, int] | None = None, total: int | None = None, seed: int = SEED, unit: str = "chars", out: str | None = "copy",
        digits: int | None = None) -> DataFrame:
    """Documents as often as the mixture wants them; ``out`` counts a document's copies from 1.

    ``weights``: of the sources by name, 1 for one that isn't named.
    ``total``: the size wanted, in characters or documents (``unit``); by default that of the input.
    """
    cols = Columns(docs, ["doc_id", "source", "text"])
    if digits is None:
        digits = next((d for d in range(3, 7) if 16**d * PER_SLICE >= cols.df.count()), 6)
    size = F.coalesce(F.length("_2"), F.lit(0)) if unit == "chars" else F.lit(1)
    name = F.coalesce(F.col("_1"), F.lit(""))
    digest = F.md5(F.coalesce(F.col("_0").cast("string"), F.lit("")))
    hexed = lambda c: F.conv(c, 16, 10).cast("bigint")
    # a null source and '' are told apart by a flag, so that keys are equal by plain equality and a join needs no second shuffle
    keyed = cols.df.withColumns({"src": F.concat(F.when(F.col("_1").isNull(), "-").otherwise("+"), name), "order": digest, "slice": hexed(F.substring(digest, 1, digits))})
    named = F.substring("src", 2, 1 << 30)
    weight = F.lit(1)
    if weights:
        weight = F.when(F.col("src").startswith("+"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), named), F.lit(1))).otherwise(F.lit(1))
    wide = "decimal(38,0)"

    slices = keyed.groupBy("src", "slice").agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("bigint")).alias("size"))
    sources = slices.groupBy("src").agg(F.sum("size").alias("size")).withColumn("weight", F.when(F.col("size") > 0, weight.cast("bigint")).otherwise(F.lit(0)))
    whole = sources.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes"))  # one row
    wanted = F.lit(total).cast(wide) if total is not None else F.col("sizes").cast(wide)
    expected = F.when(F.expr("size > 0 and weights > 0"), F.expr(f"(wanted * weight * {UNIT}) div (weights * cast(size as {wide}))")).otherwise(F.lit(0))
    offset = hexed(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, 8)) % UNIT
    each = sources.crossJoin(F.broadcast(whole)).withColumn("wanted", wanted).select("src", expected.cast("bigint").alias("each"), offset.alias("offset"))
    before = Window.partitionBy("src").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    places = (slices.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(each, "src")
              .select("src", "slice", F.expr(f"cast((cast(before as {wide}) * each + offset) % {UNIT} as bigint)").alias("start"), "each"))  # only what is below one unit matters to what is crossed later

    within = Window.partitionBy("src", "slice").orderBy("order", F.md5(F.coalesce("_2", F.lit(""))))
    ranked = (keyed.withColumn("nth", F.row_number().over(within)).join(places, ["src", "slice"])
              .withColumn("high", F.col("start") + F.col("nth") * F.col("each"))
              .withColumn("copies", F.expr(f"cast(high div {UNIT} - (high - each) div {UNIT} as int)"))
              .filter("copies > 0")
              .withColumn("copy", F.explode(F.expr("sequence(1, copies)"))))
    return cols.restore(ranked, **({out: F.col("copy")} if out else {}))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS)


def mixing_sql(documents: str = "documents", out: str = ", copy") -> str:
    cases = " ".join(f"WHEN '{s}' THEN {w}" for s, w in WEIGHTS.items())
    return f"""
WITH sized AS (SELECT *, md5(coalesce(cast(doc_id AS VARCHAR), '')) AS ord, md5(coalesce(text, '')) AS tord, coalesce(length(text), 0) AS size FROM {documents}),
sources AS (SELECT source AS s, sum(size)::HUGEINT AS size, (CASE WHEN sum(size) > 0 THEN CASE source {cases} ELSE 1 END ELSE 0 END)::HUGEINT AS weight FROM sized GROUP BY source),
whole AS (SELECT sum(weight)::HUGEINT AS weights, sum(size)::HUGEINT AS sizes FROM sources),
each AS (SELECT s, CASE WHEN size > 0 THEN (sizes * weight * {UNIT}) // (weights * size) ELSE 0 END AS each,
  ('0x' || substr(md5('{SEED}:' || coalesce(s, '')), 1, 8))::BIGINT % {UNIT} AS shift FROM sources, whole),
ranked AS (SELECT sized.*, each, shift + each * row_number() OVER (PARTITION BY source ORDER BY ord, tord) AS high FROM sized JOIN each ON source IS NOT DISTINCT FROM s),
copied AS (SELECT *, (high // {UNIT} - (high - each) // {UNIT})::INT AS copies FROM ranked)
SELECT doc_id, text, lang, source, n_chars{out} FROM (SELECT *, unnest(range(1, copies + 1))::INT AS copy FROM copied WHERE copies > 0)"""


QUERIES = {"op6_mixing": op6_mixing}
ORACLE_SQL = {"op6_mixing": mixing_sql()}

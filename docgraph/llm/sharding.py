"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` places on a ring of 64-bit hashes; a key belongs
to the first place at or after its hash.  No shard takes more than
``ceil((1 + slack) * rows / shards)`` rows: the rows it has no room for go on
clockwise to the next shard that has.  A shard's own keys come before
overflow from others, so that a change moves few keys.

Only counts by arc of the ring (shards * vnodes rows, however many documents
there are) reach the driver.  It settles which ranks of each arc go where;
the keys at those ranks are looked up, and the whole assignment is then a
table of break points on the ring that each row looks its shard up in.  No
document moves between executors.

Nulls: a null key is a key of its own.  Repeated rows and equal keys are
placed together unless a shard fills up among them, and are then split so
that no load exceeds its bound.  Text may be null, empty or of any length: it
is not looked at.  An empty table gives an empty result.  An input column
named like the result's is replaced; other extra columns pass through.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.llm.common import Columns, table

CELL_BITS = 12
NULL_KEY = "\u0000null"


def ring(shards: int, vnodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the virtual nodes in order (signed 64-bit) and the shard of each."""
    at = np.array([xxhash.xxh64_intdigest(f"shard {s} node {v}", 42) for s in range(shards) for v in range(vnodes)], np.uint64).astype(np.int64)
    own = np.repeat(np.arange(shards), vnodes)
    order = np.lexsort((own, at))
    return at[order], own[order]


def settle(counts: np.ndarray, owner: np.ndarray, room: np.ndarray) -> list[list[tuple[int, int]]]:
    """For every arc, (first rank, shard) of its runs of keys, in order of rank.

    Arc i ends at place i; a last arc more is the one from the last place to
    the end of the hashes, and belongs to place 0.  Step 0 gives each shard
    its own arcs' keys in ring order; at step p what is left of an arc tries
    the p-th place clockwise of it.
    """
    n = len(owner)
    room = room.copy()
    runs: list[list[tuple[int, int]]] = [[] for _ in counts]
    done = np.zeros(len(counts), np.int64)
    left = counts.astype(np.int64).copy()
    for step in range(n):
        waiting = np.flatnonzero(left)
        if not len(waiting):
            break
        for arc in waiting:
            shard = owner[(arc + step) % n]
            take = min(left[arc], room[shard])
            if take:
                runs[arc].append((int(done[arc]), int(shard)))
                done[arc] += take
                left[arc] -= take
                room[shard] -= take
    return runs


def _look_up(spark: SparkSession, points: list[tuple[int, str, int]], h: Column, key: Column, df: DataFrame, out: str) -> DataFrame:
    """``df`` with column ``out``: the value of the last of the sorted (hash, key, value) points at or before (h, key).

    The points go out as one row for each of 2^CELL_BITS equal cells of the ring, a table whose size the ring fixes.
    """
    cells: list[list] = [[] for _ in range(1 << CELL_BITS)]
    half, shift = 1 << (CELL_BITS - 1), 64 - CELL_BITS
    for p in points:
        cells[(p[0] >> shift) + half].append(p)
    rows, now = [], points[0][2]
    for c, own in enumerate(cells):
        rows.append((c - half, now, own))
        now = own[-1][2] if own else now
    cell = spark.createDataFrame(rows, "cell bigint, base int, points array<struct<h:bigint,k:string,v:int>>")
    found = F.aggregate("points", F.col("base"), lambda a, p: F.when((p["h"] < h) | ((p["h"] == h) & (p["k"] <= key)), p["v"]).otherwise(a))
    return df.join(F.broadcast(cell), F.shiftright(h, shift) == F.col("cell")).withColumn(out, found).drop("cell", "base", "points")


def assign_shards(docs: DataFrame, shards: int = 64, vnodes: int = 128, slack: float = 0.05, key: str = "doc_id", out: str = "shard") -> DataFrame:
    spark = docs.sparkSession
    cols = Columns(docs, [key])
    keyed = cols.df.withColumn("key", F.coalesce(F.col("_0").cast("string"), F.lit(NULL_KEY))).withColumn("h", F.xxhash64("key"))
    at, owner = ring(shards, vnodes)
    n = len(at)
    starts = [(-(2**63), "", 0)] + [(int(at[i - 1]) + 1, "", i) for i in range(1, n + 1) if at[i - 1] < (at[i] if i < n else 2**63 - 1)]
    h, k = F.col("h"), F.col("key")
    arcs = _look_up(spark, starts, h, k, keyed.select("h", "key"), "arc")
    counts = np.zeros(n + 1, np.int64)
    for r in arcs.groupBy("arc").count().collect():  # at most shards * vnodes rows
        counts[r["arc"]] = r["count"]
    total = int(counts.sum())
    room = np.full(shards, math.ceil((1 + slack) * total / shards), np.int64)
    runs = settle(counts, owner, room)

    split = {a: r for a, r in enumerate(runs) if len(r) > 1}
    points = [(p, k0, runs[a][0][1] if runs[a] else int(owner[a % n])) for p, k0, a in starts]
    ties: list[tuple[int, str, list[tuple[int, int]]]] = []
    if split:
        wanted = spark.createDataFrame([(a, lo) for a, r in split.items() for lo, _ in r[1:]], "arc int, lo bigint")
        shard_of = {(a, lo): s for a, r in split.items() for lo, s in r}
        sums = (arcs.join(F.broadcast(wanted.select("arc").distinct()), "arc", "left_semi").groupBy("arc", "h", "key").count()
                .withColumn("upto", F.sum("count").over(Window.partitionBy("arc").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0))))
        hits = (sums.join(F.broadcast(wanted), "arc").filter("lo >= upto - count and lo < upto")
                .select("arc", "h", "key", "lo", (F.col("lo") - F.col("upto") + F.col("count")).alias("within")).collect())  # one row a run
        by_key: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for r in hits:
            by_key.setdefault((r["h"], r["key"]), []).append((r["within"], shard_of[r["arc"], r["lo"]]))
        for (hh, kk), at_ranks in by_key.items():
            at_ranks.sort()
            points.append((hh, kk, at_ranks[-1][1]) if at_ranks[0][0] == 0 and len(at_ranks) == 1 else (hh, kk + "\u0000", at_ranks[-1][1]))
            if at_ranks[0][0] or len(at_ranks) > 1:  # rows of one key go to several shards
                ties.append((hh, kk, at_ranks))
    points.sort()
    placed = _look_up(spark, points, h, k, keyed, "s")
    if ties:
        tie = spark.createDataFrame([(hh, kk, r) for hh, kk, r in ties], "th bigint, tk string, ranks array<struct<r:bigint,s:int>>")
        both = placed.join(F.broadcast(tie), (h == F.col("th")) & (k == F.col("tk")), "left")
        plain = both.filter("th is null").drop("th", "tk", "ranks")
        tied = (both.filter("th is not null").withColumn("rank", F.row_number().over(Window.partitionBy("h", "key").orderBy(F.lit(0))) - 1)
                .withColumn("s", F.aggregate("ranks", F.col("s"), lambda a, p: F.when(p["r"] <= F.col("rank"), p["s"]).otherwise(a)))
                .drop("th", "tk", "ranks", "rank"))
        placed = plain.unionByName(tied)
    return cols.restore(placed, **{out: F.col("s")})


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard, of 64."""
    return assign_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding}
ORACLE_SQL: dict[str, str] = {}

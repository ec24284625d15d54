"""Walks over edges: traversal, reachability, shortest paths, trees, references, renaming.

Walks go frontier by frontier: each hop is one join of the frontier with the
edges and one anti-join with what was visited; the visited set is written to
the shared folder at every hop, so that plans stay short and an executor's
loss costs one hop.  No set is collected.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.storage import batches_of, discard, written


def steps(edges: DataFrame, direction: str = "outgoing", edge_type: str | None = None) -> DataFrame:
    """src, dst of one hop."""
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    out, back = e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), e.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    return {"outgoing": out, "incoming": back}.get(direction, out.union(back)).distinct()


def walk(starts: DataFrame, hops: DataFrame, depth: int | None) -> DataFrame:
    """id, depth of everything reached from ``starts`` (column id), each at its least depth; to the fixpoint if depth is None."""
    hops = written(hops, "walk")
    visited = frontier = written(starts.select("id").distinct().withColumn("depth", F.lit(0)), "walk")
    n = 0
    while depth is None or n < depth:
        n += 1
        new = written(frontier.join(hops, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(visited.select("id"), "id", "left_anti").withColumn("depth", F.lit(n)), "walk")
        if new.isEmpty():
            break
        visited, frontier = visited.unionByName(new), new
    return visited


def traverse(objects: DataFrame, edges: DataFrame, start: str, direction: str = "outgoing", edge_type: str | None = None, depth: int = 3) -> DataFrame:
    """Objects within ``depth`` (1 to 50) hops of ``start``, with their depth; ids without an object are passed through but not given."""
    if not 1 <= depth <= 50:
        raise ValueError("depth is 1 to 50")
    if direction not in ("outgoing", "incoming", "both"):
        raise ValueError("direction is outgoing, incoming or both")
    spark = objects.sparkSession
    got = walk(spark.createDataFrame([(start,)], "id string"), steps(edges, direction, edge_type), depth)
    return got.join(objects.select(F.col("__global_id").alias("id"), "__kind", "__label"), "id")


def traversed_edges(edges: DataFrame, reached: DataFrame, depth: int, direction: str = "outgoing", edge_type: str | None = None) -> DataFrame:
    """Edges met on expanding the nodes of a walk (those at less than its depth)."""
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    inner = reached.filter(F.col("depth") < depth).select("id")
    out, back = e.join(inner, F.col("source_id") == F.col("id"), "left_semi"), e.join(inner, F.col("target_id") == F.col("id"), "left_semi")
    return {"outgoing": out, "incoming": back}.get(direction, out.union(back)).distinct()


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "outgoing") -> DataFrame:
    """Everything reachable, to the fixpoint; cycles are no matter."""
    return walk(starts, steps(edges, direction), None)


def find_path(edges: DataFrame, start: str, end: str, edge_type: str | None = None) -> DataFrame:
    """One row: the shortest undirected path (of several the least in order) and its length; none if there is no path, however far it goes."""
    return find_paths(edges, start, [end], edge_type).select("path", "length")


def find_paths(edges: DataFrame, start: str, ends: Sequence[str], edge_type: str | None = None) -> DataFrame:
    """end, path, length for each end there is a path to (see find_path), from one walk.

    Each hop keeps one least path a node, found along the nodes' parents.  An
    end is looked for among its own neighbours, so that the last hop, which is
    the widest, isn't taken; an end that no edge has isn't walked to.
    """
    spark = edges.sparkSession
    found = [spark.createDataFrame([(e, [start]) for e in {*ends} if e == start], "end string, path array<string>")]
    e = edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)
    e = written(e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), "walk")
    hops = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    last = written(hops.filter(F.col("dst").isin([x for x in {*ends} if x != start])).distinct(), "walk")
    waiting = {r[0] for r in last.select("dst").distinct().collect()}
    frontier = visited = written(spark.createDataFrame([(start, [start])], "id string, path array<string>"), "walk")
    while waiting:
        hit = written(frontier.join(last.filter(F.col("dst").isin(list(waiting))), F.col("id") == F.col("src")).groupBy(F.col("dst").alias("end")).agg(F.min("path").alias("p")).select("end", F.concat("p", F.array("end")).alias("path")), "walk")
        done = {r[0] for r in hit.select("end").collect()}
        if done:
            found.append(hit)
            waiting -= done
        if not waiting:
            break
        new = frontier.join(hops, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("p"))
        frontier = written(new.join(visited.select("id"), "id", "left_anti").select("id", F.concat("p", F.array("id")).alias("path")), "walk")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return functools.reduce(DataFrame.unionByName, found).select("end", "path", (F.size("path") - 1).alias("length"))


def descendants(objects: DataFrame) -> DataFrame:
    """node, top, depth: the topmost ancestor of every object by parents, and how far it is; null of what hangs on a circle of parents.

    Every round doubles how far each node looks, so a tree takes as many rounds as its depth has bits.
    """
    ids = objects.select(F.col("__id").alias("node")).distinct()
    up_one = objects.filter("__parent is not null").groupBy(F.col("__id").alias("c")).agg(F.min("__parent").alias("p"))
    up = written(ids.join(up_one, F.col("node") == F.col("c"), "left").select("node", F.coalesce("p", "node").alias("top"), F.col("p").isNotNull().cast("int").alias("depth")), "walk")
    for _ in range(max(1, ids.count()).bit_length() + 1):
        far = up.select(F.col("node").alias("via"), F.col("top").alias("further"), F.col("depth").alias("more"))
        next_ = written(up.join(far, F.col("top") == F.col("via"), "left").select(
            "node", F.coalesce("further", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.coalesce("more", F.lit(0)) > 0).alias("moved")), "walk")
        moved = not next_.filter("moved").isEmpty()
        discard(up)
        up = next_
        if not moved:
            return up.drop("moved")
    return up.select("node", F.when(~F.col("moved"), F.col("top")).alias("top"), F.when(~F.col("moved"), F.col("depth")).alias("depth"))


def tree(objects: DataFrame, hidden: tuple[str, ...] = ("__TextBlock", "__Document")) -> DataFrame:
    """node, parent, sort key of the smart tree: parent, else namespace, else root; those with children first, then by label without case."""
    o = objects.filter(~F.coalesce(F.col("__kind"), F.lit("")).isin(*hidden))
    ids = o.select(F.col("__id").alias("p")).distinct()
    n = o.join(ids, F.col("__parent") == F.col("p"), "left").select("__global_id", "__id", "__label", F.coalesce("p", F.when(F.col("__namespace") != "", F.col("__namespace"))).alias("parent"))
    has = n.filter("parent is not null").select(F.col("parent").alias("hp")).distinct()
    w = Window.partitionBy("parent").orderBy(F.col("hp").isNull(), F.lower("__label"), "__global_id")
    return n.join(has, n["__id"] == has["hp"], "left").withColumn("place", F.row_number().over(w)).select("__global_id", "parent", "place")


def level_parents(objects: DataFrame) -> DataFrame:
    """The nearest object on a line before it in its file with a lower level, for each object (of one line the greatest id).

    Of a line's objects of one level only the greatest id can be a parent; these
    pass in order, with a stack, and no file is held.  Objects get the parent
    that their file, line and level have.
    """
    place = ["__file", "__line", "__level"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        stack: list[tuple[int, str]] = []
        waiting: list[tuple[int, str]] = []
        for b in (part for whole in batches for part in batches_of(whole, rows=10_000)):
            parents = []
            for file, line, level, gid in zip(*(b.column(n).to_pylist() for n in range(4))):
                if now != (file, line):
                    if now is None or now[0] != file:
                        stack, waiting = [], []
                    for lv, g in waiting:
                        while stack and stack[-1][0] >= lv:
                            stack.pop()
                        stack.append((lv, g))
                    now, waiting = (file, line), []
                parents.append(next((g for lv, g in reversed(stack) if lv < level), None))
                waiting.append((level, gid))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(parents, pa.string())], [*place, "parent_id"])

    o = objects.select(*place, "__global_id")
    first = o.dropna().groupBy(*place).agg(F.max("__global_id").alias("g")).repartition("__file").sortWithinPartitions("__file", "__line", "g")
    kinds = dict(o.dtypes)
    parents = first.mapInArrow(read, ", ".join(f"{c} {kinds[c]}" for c in place) + ", parent_id string")
    return o.join(parents, place, "left").select("__global_id", "parent_id")


def find_references(edges: DataFrame, objects: DataFrame, target: str) -> DataFrame:
    """Objects that refer to ``target``, one row each, in order of global id."""
    return objects.join(edges.filter(F.col("target_id") == target).select(F.col("source_id").alias("__global_id")).distinct(), "__global_id", "left_semi")


def search(objects: DataFrame, text: str, namespace: str | None = None) -> DataFrame:
    """Objects whose id or label has ``text``, whatever the case."""
    o = objects if namespace is None else objects.filter(F.col("__namespace") == namespace)
    t = F.lower(F.lit(text))
    return o.filter(F.lower("__id").contains(t) | F.lower(F.coalesce("__label", F.lit(""))).contains(t))


def fuzzy(objects: DataFrame, letters: str) -> DataFrame:
    """Objects whose id has the letters in that order."""
    from docgraph.functions.text import subsequence

    return objects.filter(subsequence(F.col("__id"), letters))


def rename_plan(refs: DataFrame, objects: DataFrame, old: str, new: str) -> DataFrame:
    """Edits that rename an object: its definition and the references to it or to what is below it; nothing is written."""
    import re

    if not re.fullmatch(r"[\w.\-]+", new):
        raise ValueError(f"{new!r} isn't an id")
    bounded = rf"(^|[^\w.-])\Q{old}\E(?=$|[^\w-])"
    definition = objects.filter(F.col("__id") == old).select(F.col("__global_id").alias("source_id"), F.lit("definition").alias("what"), F.col("__id").alias("old_text"), F.lit(new).alias("new_text"))
    hit = refs.filter((F.element_at(F.split("raw", ":"), -1) == old) | F.element_at(F.split("raw", ":"), -1).startswith(old + "."))
    edits = hit.select("source_id", F.lit("reference").alias("what"), F.col("raw").alias("old_text"), F.regexp_replace("raw", bounded, f"$1{new}").alias("new_text"))
    return definition.union(edits.distinct())


def page_of(items: DataFrame, key: str, after: str | None, n: int) -> tuple[DataFrame, int]:
    """One keyset page (n + 1 rows at most, the last telling that there are more) and the number of all items."""
    total = items.count()
    return (items if after is None else items.filter(F.col(key) > after)).orderBy(key).limit(n + 1), total

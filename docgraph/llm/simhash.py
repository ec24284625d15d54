"""SimHash near-dedup, exact in the distance of fingerprints.

A text's fingerprint has 256 bits: each the sign of a sum over its words, in
lower case, of +-sqrt(count).  Two texts are near copies if their fingerprints
differ in ``DISTANCE`` bits at most.

All such pairs are found.  The 256 bits are 12 blocks of 20 and one of 16, and
each block has a quota; the quotas sum to ``DISTANCE + 1``.  By the pigeonhole
on a ring two near copies differ, from some block on, in fewer bits than that
block's quota, and in fewer than the quotas' sum over it and the two blocks
after it.  So rows are looked up by each block's value and all values that are
near enough, what is found is checked on 60 bits and then on all 256.  Where a
side is small or a distance large, all pairs are compared instead.

Equal fingerprints are one row throughout, however many documents have them.
Fingerprints are dealt to chunks by a hash, at most ``CHUNK`` in one on average,
and every pair of chunks (and each chunk with itself) is one task: memory and
the largest task are bounded, each row is sent once per chunk.  Time grows with
the square of the distinct fingerprints, by the share of pairs that is looked
up.  A task gives each row's link to the first of its class there, so that a
group of n copies makes of the order of n rows, not n^2.  Groups are the
connected components over all tasks, by minimum labels with pointer jumping;
each round is written to the shared folder.  The document with the least doc_id
of a group stays.

Nulls: a text that is null, empty or without a word has no fingerprint and is
never a copy.  Rows with a null doc_id (or one that is no whole number) take
part and sort last.  Repeated rows are copies of one another: one of them stays,
whichever comes first where they differ in extra columns only.  Long texts count whole.  An
empty table gives an empty result.  Extra columns pass through
``drop_near_copies``, whatever their names, and are ignored by ``near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.llm.common import Columns, batches_of, mix64, span_hashes, table, text_bytes, word_spans, written

DISTANCE = 36
PARTS = 4
CHUNK, CHUNKS, SMALL = 1 << 19, 6, 1 << 12  # rows of a chunk; as many chunks at least, unless they were smaller than SMALL
WIDTHS = [20] * 12 + [16]
AT_ONCE = 1 << 17
NAMES = [f"f{i}" for i in range(PARTS)]
_FP = ", ".join(f"{n} bigint" for n in NAMES)
PRINTS = f"doc_id bigint, text_hash bigint, {_FP}"


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows of PARTS uint64) of the texts, and which of them have one."""
    raw, offsets = text_bytes(texts)
    out = np.zeros((len(texts), PARTS), np.uint64)
    if not len(raw):
        return out, np.zeros(len(texts), bool)
    lower = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    starts, ends, first = word_spans(raw, offsets)
    words = span_hashes(lower, starts, ends)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(texts)), counts)
    words = words[np.lexsort((words, row))]
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    weight = np.sqrt(np.diff(np.concatenate([at, [len(words)]]))).astype(np.float32)
    cut = np.searchsorted(row[at], np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        wide = np.stack([mix64(words[at] + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1)) for i in range(PARTS)], 1)
    bits = wide.view(np.uint8).reshape(len(at), PARTS * 8)
    signs = np.zeros((len(texts), PARTS * 64), bool)
    for i in np.flatnonzero(counts):
        total = np.zeros(PARTS * 64, np.float64)
        for a in range(cut[i], cut[i + 1], 1 << 16):
            b = min(cut[i + 1], a + (1 << 16))
            w = weight[a:b]
            total += 2 * (w @ np.unpackbits(bits[a:b], axis=1).astype(np.float32)).astype(np.float64) - w.sum(dtype=np.float64)
        signs[i] = total > 1e-3 * len(total)
    out = np.packbits(signs, axis=1).view(np.uint64)
    return out, counts > 0


def _hamming_tables() -> tuple[np.ndarray, np.ndarray]:
    """A covering code of 16 bits, which near copies are no longer found by.

    home[v], and visits[v]: the homes of all blocks within 1 bit of v, filled up with -1.
    """
    v = np.arange(1 << 16)
    syndrome = np.zeros(1 << 16, np.int64)
    for i in range(1, 16):
        syndrome ^= np.where(v >> i & 1, i, 0)
    home = np.where(syndrome, v ^ (1 << syndrome), v)
    near = np.sort(np.stack([home, *[home[v ^ (1 << i)] for i in range(16)]], 1), 1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return home, near


HOME, VISITS = _hamming_tables()


def quotas(distance: int) -> list[int] | None:
    """One more than the bits in which each block may differ, ``distance + 1`` in all; none if look-ups would take too many values."""
    every, rest = divmod(distance + 1, len(WIDTHS) - 1)
    if every + (rest > 1) > 3:
        return None
    return [every + (k < rest - 1) for k in range(len(WIDTHS) - 1)] + [min(1, rest)]


def block(prints: np.ndarray, k: int) -> np.ndarray:
    """Bits of block k of all fingerprints."""
    at = sum(WIDTHS[:k])
    word, shift = divmod(at, 64)
    v = prints[:, word] >> np.uint64(shift)
    if shift + WIDTHS[k] > 64:
        v |= prints[:, word + 1] << np.uint64(64 - shift)
    return v & np.uint64((1 << WIDTHS[k]) - 1)


def flips(width: int, most: int) -> np.ndarray:
    """All words of ``width`` bits with ``most`` ones or fewer."""
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(width), n)], np.int32)


def _far(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    far = np.zeros(len(i), np.int16)
    for p in range(PARTS):
        far += np.bitwise_count(x[i, p] ^ y[j, p])
    return far


def all_pairs(x: np.ndarray, y: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and of y within the distance, tile by tile, each with each."""
    step = max(1, (1 << 20) // max(1, len(y)))
    for a in range(0, len(x), step):
        far = np.zeros((len(x[a:a + step]), len(y)), np.int16)
        for p in range(PARTS):
            far += np.bitwise_count(x[a:a + step, None, p] ^ y[None, :, p])
        i, j = np.nonzero(far <= distance)
        yield i + a, j


def looked_up_pairs(x: np.ndarray, y: np.ndarray, distance: int, quota: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and of y (the same array: each pair once at least) within the distance, by look-ups; a pair comes up to once a block."""
    same, n = x is y, len(WIDTHS)
    for k in range(n):
        if not quota[k]:
            continue
        ring = [k, (k + 1) % n, (k + 2) % n]
        most = sum(quota[r] for r in ring) - 1
        sides = []
        for prints in (x,) if same else (x, y):
            value = block(prints, k).astype(np.int32)
            order = np.argsort(value, kind="stable").astype(np.int32)
            window = block(prints, ring[0]) | block(prints, ring[1]) << np.uint64(WIDTHS[ring[0]]) | block(prints, ring[2]) << np.uint64(WIDTHS[ring[0]] + WIDTHS[ring[1]])
            sides.append((value[order], order, window[order]))
        (vx, ox, wx), (vy, oy, wy) = sides[0], sides[-1]
        upto = np.zeros((1 << WIDTHS[k]) + 1, np.int32)
        np.cumsum(np.bincount(vy, minlength=1 << WIDTHS[k]), out=upto[1:])
        masks = flips(WIDTHS[k], quota[k] - 1)
        group = max(1, AT_ONCE // len(vx))
        for g in range(0, len(masks), group):
            some = masks[g:g + group, None]
            keys = vx[None, :] ^ some
            lo = upto.take(keys)
            many = upto.take(keys + 1) - lo
            if same:  # a pair is looked up from its lesser value only
                many *= keys >= vx
            at = np.flatnonzero(many)
            lo, many, row = lo.ravel()[at], many.ravel()[at], at % len(vx)
            total = np.cumsum(many, dtype=np.int64)
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + AT_ONCE, "right")))
                m = many[a:b]
                ends = np.cumsum(m)
                j = np.repeat(lo[a:b] - (ends - m), m) + np.arange(ends[-1])
                near = np.flatnonzero(np.bitwise_count(np.repeat(wx[row[a:b]], m) ^ wy.take(j)) <= most)
                if len(near):
                    p, q = ox[row[a + np.searchsorted(ends, near, "right")]], oy[j[near]]
                    ok = _far(x, p, y, q) <= distance
                    yield p[ok], q[ok]
                a = b


class Classes:
    """Rows joined to classes, each named by its least row."""

    def __init__(self, n: int):
        self.of, self.held, self.many = np.arange(n), [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        other = self.of[i] != self.of[j]
        self.held.append((i[other], j[other]))
        self.many += int(other.sum())
        if self.many > AT_ONCE:
            self.join()

    def join(self) -> None:
        if not self.many:
            self.held = []
            return
        i, j = (np.concatenate([h[k] for h in self.held]) for k in range(2))
        self.held, self.many = [], 0
        while len(i):
            a, b = self.of[i], self.of[j]
            np.minimum.at(self.of, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = self.of[self.of]
                if (further == self.of).all():
                    break
                self.of = further
            other = self.of[i] != self.of[j]
            i, j = i[other], j[other]


def class_links(prints: np.ndarray, home: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Rows, and the first row of the class of each, that join all pairs within the distance of a row at home and one that came; where none came, of two at home."""
    here, came = np.flatnonzero(home), np.flatnonzero(~home)
    x = prints[here]
    y, there = (prints[came], came) if len(came) else (x, here)
    quota = quotas(distance) if len(x) * len(y) > SMALL * SMALL else None
    classes = Classes(len(prints))
    for i, j in looked_up_pairs(x, y, distance, quota) if quota else all_pairs(x, y, distance):
        classes.add(here[i], there[j])
    classes.join()
    moved = np.flatnonzero(classes.of != np.arange(len(prints)))
    return np.stack([classes.of[moved], moved], 1)


def _compare(distance: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by anchor (a pair of chunks): links of every anchor."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            home, node, prints = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            held.clear()
            order = np.argsort(node, kind="stable")  # rows come in any order; a task that runs again has to find the same links
            home, node, prints = home[order], node[order], prints[order]
            links = class_links(prints, home, distance)
            return pa.RecordBatch.from_arrays([pa.array(node[links[:, 0]]), pa.array(node[links[:, 1]])], ["a", "b"])

        for batch in batches:
            anchor, home, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            prints = np.stack([batch.column(3 + k).to_numpy() for k in range(PARTS)], 1).view(np.uint64)
            cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[0][0][0] != anchor[a]:
                    yield flush()
                held.append((anchor[a:b], home[a:b], node[a:b], prints[a:b]))
        if held:
            yield flush()

    return compare


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of edges a - b."""
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))  # edges are found once for both directions
    both = written(edges.select(ways.alias("e")).select("e.a", "e.b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        near = both.join(of_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("lb").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = written(lower.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")), "labels")
        if labels.filter("label != old").isEmpty():
            return labels.select("node", "label")


def _print_table(docs: DataFrame) -> DataFrame:
    """doc_id, hash of the text and fingerprint of every document that has one, written."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in batches_of(b, "text"):
                prints, some = fingerprints(part.column(1))
                rest = part.select(["doc_id", "text_hash"]).filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([*rest.columns, *[pa.array(prints[some, k].view(np.int64)) for k in range(PARTS)]], ["doc_id", "text_hash", *NAMES])

    d = Columns(docs, ["doc_id", "text"]).only().select(F.col("doc_id").try_cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return written(d.mapInArrow(of, PRINTS), "fingerprints")


def chunk_pairs(distinct: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The n fingerprints once per chunk, with the pair of chunks they are for (anchor) and whether theirs is the later (home), and the number of pairs."""
    chunks = max(1, min(CHUNKS, -(-n // SMALL)), -(-n // CHUNK))
    other = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    both = distinct.withColumn("own", F.pmod("node", F.lit(chunks))).withColumn("other", other).withColumn("later", F.greatest("own", "other"))
    anchor = (F.col("later") * (F.col("later") + 1) / 2 + F.least("own", "other")).cast("int")
    return both.select(anchor.alias("anchor"), (F.col("own") == F.col("later")).alias("home"), "node", *NAMES), chunks * (chunks + 1) // 2


def _members(docs: DataFrame, distance: int) -> DataFrame:
    """doc_id, text_hash, group, rank (0 stays) of all documents in groups of two or more."""
    prints = _print_table(docs).withColumn("node", F.xxhash64(*NAMES))
    distinct = written(prints.select("node", *NAMES).distinct(), "distinct-fingerprints")
    placed, tasks = chunk_pairs(distinct, distinct.count())
    edges = placed.repartitionById(tasks, F.col("anchor")).mapInArrow(_compare(distance), "a bigint, b bigint")
    groups = components(edges)
    labelled = prints.join(groups, "node", "left").select("doc_id", "text_hash", F.coalesce("label", "node").alias("group"))
    many = labelled.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    first = Window.partitionBy("group").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash")
    return labelled.join(many, "group", "left_semi").withColumn("rank", F.row_number().over(first) - 1)


def near_copies(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id and keeper_id (least doc_id of the group) of every document in a group of two or more."""
    m = _members(docs, distance)
    return m.select("doc_id", F.first("doc_id").over(Window.partitionBy("group").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("keeper_id"))


def _bit(h: str) -> dict[str, Column]:
    """Place of a hash in a set of 2^25 bits, of 2^19 words."""
    return {"word": F.shiftright(F.col(h).bitwiseAND(F.lit((1 << 25) - 1)), 6), "bit": F.expr(f"shiftleft(1L, cast({h} & 63 as int))")}


def drop_near_copies(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The documents, one of each group of near copies, as they are."""
    m = written(_members(docs, distance), "copies")
    keys = m.groupBy("doc_id", "text_hash").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    out = written(keys.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), (F.col("rank") > 0).alias("out"), ((F.col("rank") == 0) & (F.col("n") > 1)).alias("again")).filter("out or again"), "dropped")
    cols = Columns(docs, ["doc_id", "text"])
    keyed = cols.df.withColumns({"id": F.col("_0").try_cast("bigint"), "th": F.xxhash64("_1")}).withColumns(_bit("th"))
    bits = out.select(*[c.alias(n) for n, c in _bit("h").items()]).groupBy("word").agg(F.bit_or("bit").alias("bits"))  # what isn't among them stays where it is
    marked = keyed.join(F.broadcast(bits), "word", "left").withColumn("perhaps", F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False)))
    perhaps = marked.filter("perhaps")
    same = perhaps["id"].eqNullSafe(out["d"]) & (perhaps["th"] == out["h"])
    kept = marked.filter("not perhaps").select(*cols.df.columns).unionByName(perhaps.join(out, same, "left_anti").select(*cols.df.columns))
    alike = perhaps.join(out.filter("again"), same, "left_semi").groupBy("id", "th").agg(F.first(F.struct(*cols.df.columns)).alias("row"))  # any one of repeated rows, combined in each task first
    return cols.restore(kept.select(*cols.df.columns).unionByName(alike.select("row.*")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash": op8_simhash}
ORACLE_SQL: dict[str, str] = {}

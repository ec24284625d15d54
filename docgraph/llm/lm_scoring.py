"""Language-model scores from a causal self-attention model in numpy over subword ids.

Ids are those of a byte-level BPE.  Every id has an embedding of its own; one
layer of causal self-attention with relative positions, a residual path and a
hidden layer make a vector of what stands before a token.  The next id is found
by a walk down a Huffman tree of all ids (hierarchical softmax): at each node a
learnt vector and a bias give the odds of left and right, so probabilities of
all ids sum to one and an id costs as many dot products as its code has bits.
The biases of the ``TOP`` heaviest nodes depend on the class (of ``CLASSES``,
by frequency) of the id before, by counts; those of the others are the nodes'
own odds.

All of it is learnt from the corpus at hand, and from all of it.  Counts cover
every token.  Documents are dealt to shards of about ``SHARD`` tokens and to
``ROUNDS`` rounds by a hash of themselves, every window of each is trained on
once, and training grows with the corpus.  In a round every shard starts from
the same weights and takes its steps in the order of its documents; then the
weights are averaged, each row of a table by how often a shard touched it.
Sums are of whole numbers, so neither the partitions nor the order in which
tasks end make a difference.

Scoring goes over all documents in windows of ``2 * STEP`` tokens that overlap
by half: the first half is context, the tokens of the second are scored, each
token thus once, given at least STEP tokens before it (or all there are).
Windows of many documents are one batch with one causal mask.

Token ids are written once to the shared folder and read by every pass.  What
is sent per task is bounded by the vocabulary, and summed in Spark.

Nulls: a null or empty text has no tokens, log probability 0 and a null mean.
A long text is scored whole, in as many windows as it takes.  Repeated rows
are scored alike; a null doc_id (or one that is no whole number) stays null.
An empty table gives an empty result.  Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import ctypes
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm.common import Columns, batches_of, table, written
from docgraph.llm.records import default_vocabulary, tokens_of

WIDTH, HIDDEN, STEP, TOP, CLASSES = 16, 32, 16, 64, 256
ROUNDS, SHARD, BATCH, AT_ONCE, RATE, ROW_RATE = 2, 1 << 20, 128, 256, 0.004, 0.05
FIXED = float(1 << 20)
SCORES = "doc_id bigint, tokens bigint, log_prob double, mean_log_prob double"
_AHEAD = np.arange(STEP)[:, None] + STEP - np.arange(2 * STEP)[None, :]
_SEEN = (_AHEAD >= 0).astype(np.float32)
_OFFSET = np.maximum(_AHEAD, 0)


def classes(counts: np.ndarray) -> np.ndarray:
    """The class of every id: the most frequent three quarters of the classes have one id each, the others share the rest by frequency."""
    own = CLASSES * 3 // 4
    order = np.lexsort((np.arange(len(counts)), -counts))
    out = np.zeros(len(counts), np.int16)
    out[order[:own]] = np.arange(min(own, len(counts)))
    if len(counts) > own:
        mass = np.cumsum(counts[order[own:]] + 1.0)
        out[order[own:]] = own + np.minimum((mass - mass[0]) / mass[-1] * (CLASSES - own), CLASSES - own - 1)
    return out


class Tree:
    """A Huffman tree of ids, nodes numbered from the heaviest; an id's path is its nodes from the root and the turn at each (1 for right).

    Paths stand on end: those of nodes below TOP and, apart, those of the others.  As the former form a tree of at most TOP + 1 leaves, there is also
    the ``leaf`` of every id, and of each leaf the nodes (``top``) and turns (``sign``: 1 for right, -1 for left), as wide as the longest: beyond its
    end a path has nodes that are not its own, with sign 0.  ``spare`` is what these would add to a loss.
    """

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        weight = counts.astype(np.int64) + 1
        heap = [(int(w), i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        up, turn, total = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8), np.concatenate([weight, np.zeros(n - 1, np.int64)])
        for node in range(n, 2 * n - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            up[i], up[j], turn[j], total[node] = node, node, 1, a + b
            heapq.heappush(heap, (a + b, node))
        rank = np.empty(n - 1, np.int64)
        rank[np.lexsort((-np.arange(n - 1), -total[n:]))] = np.arange(n - 1)  # a parent is made after its children: of equal ones it comes first
        self.nodes = n - 1
        right = np.zeros(n - 1, np.int64)
        inner = np.flatnonzero(turn)
        np.add.at(right, rank[up[inner] - n], total[inner])
        whole = np.zeros(n - 1, np.int64)
        whole[rank] = total[n:]
        self.odds = np.log(right / (whole - right)).astype(np.float32)
        who, node, bit, depth, at, d = [], [], [], [], np.arange(n), 0
        ids, live = np.arange(n), np.ones(n, bool)
        while live.any():
            ids, at, d = ids[live], at[live], d + 1
            who.append(ids)
            node.append(rank[up[at] - n])
            bit.append(turn[at])
            depth.append(np.full(len(ids), d))
            at = up[at]
            live = at != 2 * n - 2
        who, node, bit, depth = (np.concatenate(x) for x in (who, node, bit, depth))
        order = np.lexsort((-depth, who))
        who, node, bit = who[order], node[order].astype(np.int32), bit[order].astype(np.float32)
        self.parts = []
        for some in (node < TOP, node >= TOP):
            cut = np.concatenate([[0], np.cumsum(np.bincount(who[some], minlength=n))])
            self.parts.append((cut, node[some], bit[some]))
        cut, node, bit = self.parts[0]
        _, example, self.leaf = np.unique(node[cut[1:] - 1] * 2 + bit[cut[1:] - 1].astype(np.int64), return_index=True, return_inverse=True)
        many = np.diff(cut)[example]
        self.top, self.sign = np.zeros((len(many), many.max()), np.int64), np.zeros((len(many), many.max()), np.float32)
        for i, (at, n) in enumerate(zip(cut[example], many)):
            own = node[at:at + n]
            self.top[i] = np.setdiff1d(np.arange(TOP), own)[0] if n < many.max() else 0
            self.top[i, :n], self.sign[i, :n] = own, bit[at:at + n] * 2 - 1
        self.less = (255 - np.diff(self.parts[1][0])).astype(np.uint8)
        self.spare = ((many.max() - many) * np.log(2)).astype(np.float32)

    def entries(self, ids: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the ids' paths: the place of the id among ``ids``, the node and the turn."""
        cut, node, bit = self.parts[part]
        many = cut[ids + 1] - cut[ids]
        place = np.repeat(np.arange(len(ids)), many)
        flat = np.repeat(cut[ids] - (np.cumsum(many) - many), many) + np.arange(len(place))
        return place, node[flat], bit[flat]

    def lower(self, ids: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Of the ids' paths beyond TOP, depth by depth: which of ``ids`` have any, longest first; of how many of these there is a node at each depth; of
        all the nodes the place among these ids, node and sign."""
        cut, node, bit = self.parts[1]
        less = self.less.take(ids)
        deep = len(ids) - np.cumsum(np.bincount(255 - less))[:-1] if len(ids) else np.zeros(0, np.int64)
        order = np.argsort(less, kind="stable")[:deep[0] if len(deep) else 0]
        place = np.arange(deep.sum()) - np.repeat(np.cumsum(deep) - deep, deep)
        at = cut.take(ids.take(order)).take(place)
        at += np.repeat(np.arange(len(deep)), deep)
        return order, deep.tolist(), place, node.take(at), bit.take(at) * 2 - 1


def windows(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (n x 2*STEP; id ``size`` begins a text, ``size + 1`` is nothing) and targets (n x STEP, -1 for none) of all windows, and the row of each.

    ``ids``: the rows' ids on end, row r from starts[r] to starts[r+1].
    """
    many = np.diff(starts)
    count = -(-many // STEP)
    row = np.repeat(np.arange(len(many)), count)
    windows_before, blocks = np.cumsum(count) - count, count + (count > 0)
    blocks_before = np.cumsum(blocks) - blocks  # a text's inputs in blocks of STEP: the first has nothing, a window is a block and the next
    at = np.arange(starts[0], starts[-1])
    inputs = np.full((int(blocks.sum()) + 1) * STEP, size + 1, np.int32)
    inputs[at + np.repeat((blocks_before + 1) * STEP + 1 - starts[:-1], many)] = ids[starts[0]:starts[-1]]
    some = blocks_before[count > 0]
    inputs[some * STEP], inputs[(some + 1) * STEP] = size + 1, size  # where the last token of the text before may have come to stand
    block = np.arange(len(row)) + np.repeat(blocks_before - windows_before, count)
    inputs = inputs.reshape(-1, STEP)
    x = np.concatenate([inputs.take(block, 0), inputs.take(block + 1, 0)], 1)
    y = np.full(len(row) * STEP, -1, np.int32)
    y[at + np.repeat(windows_before * STEP - starts[:-1], many)] = ids[starts[0]:starts[-1]]
    y = y.reshape(-1, STEP)
    return x, y, row


SHAPES = {"Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "rel": (2 * STEP,), "O": (WIDTH, WIDTH), "R": (WIDTH, WIDTH), "A": (WIDTH, HIDDEN), "a": (HIDDEN,), "B": (HIDDEN, WIDTH), "T": (TOP, WIDTH)}


def first_weights(size: int, nodes: int, seed: int = 5) -> dict[str, np.ndarray]:
    """Dense weights, the embeddings E (two more than ids) and the nodes' vectors N (those below TOP are T's)."""
    rng = np.random.default_rng(seed)
    scale = {"rel": 0.0, "a": 0.0, "T": 0.0}
    w = {k: (rng.standard_normal(s) * scale.get(k, 0.25)).astype(np.float32) for k, s in SHAPES.items()}
    return w | {"E": (rng.standard_normal((size + 2, WIDTH)) * 0.5).astype(np.float32), "N": np.zeros((max(nodes, 1), WIDTH), np.float32)}


def joint(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Q with K, and R beside it, as one matrix of a token's embedding; V with O."""
    return np.concatenate([w["Q"] @ w["K"].T * np.float32(WIDTH**-0.5), w["R"]], 1), w["V"] @ w["O"]


def _within(values: np.ndarray, most: float, least: float | None = None) -> None:
    """Values beyond the bounds set to them; as a rule there are none, and looking costs less."""
    if values.max(initial=-np.inf) > most:
        np.minimum(values, most, out=values)
    if least is not None and values.min(initial=np.inf) < least:
        np.maximum(values, least, out=values)


def heads(w: dict[str, np.ndarray], x: np.ndarray, table: np.ndarray | None = None) -> tuple:
    """All steps' values for windows x up to the vector that the odds are made of.

    Queries and values are multiplied through, so that keys are the embeddings themselves; attention s is not yet divided by its sums.  ``table``:
    the first of the joint matrices times each embedding.
    """
    first, second = joint(w)
    keys = w["E"].take(x, 0)
    e = keys[:, STEP:].reshape(-1, WIDTH) if table is None else None
    qr = e @ first if table is None else table.take(x[:, STEP:].ravel(), 0)
    q = qr[:, :WIDTH].reshape(len(x), STEP, WIDTH)
    s = np.matmul(q, keys.transpose(0, 2, 1))
    s += w["rel"][_OFFSET]
    _within(s, 30)
    np.exp(s, out=s)
    s *= _SEEN
    share = 1 / (s.reshape(-1, 2 * STEP) @ np.ones(2 * STEP, s.dtype))[:, None]
    c = np.matmul(s, keys).reshape(-1, WIDTH)
    c *= share
    h = c @ second
    h += qr[:, WIDTH:]
    r = h @ w["A"]
    r += w["a"]
    np.maximum(r, 0, out=r)
    u = r @ w["B"]
    u += h
    return first, second, keys, e, q, s, share, c, h, r, u


def odds(w: dict[str, np.ndarray], m: dict, u: np.ndarray, before: np.ndarray, t: np.ndarray) -> tuple:
    """Of targets t after ids ``before``, given vectors u: log odds of the turns taken.

    Of the upper part of paths, a row for each target, with their places in a matrix of targets by nodes and signs; of the others, as Tree.lower
    has them, with which targets they are of, how many at each depth, node, sign, vector u and the node's.
    """
    tree: Tree = m["tree"]
    leaf = tree.leaf.take(t)
    node, sign = tree.top.take(leaf, 0), tree.sign.take(leaf, 0)
    at = node + np.arange(0, len(t) * TOP, TOP)[:, None]
    l0 = (u @ w["T"].T).ravel().take(at)
    node += (m["class"].take(before).astype(np.int64) * TOP)[:, None]
    l0 += m["base"].ravel().take(node)
    l0 *= sign
    who, deep, p1, n1, s1 = tree.lower(t)
    up, own = u.take(who, 0).take(p1, 0), w["N"].take(n1, 0)
    l1 = np.einsum("ij,ij->i", own, up)
    l1 += tree.odds.take(n1)
    l1 *= s1
    for l in (l0, l1):
        _within(l, 30, -30)
    return (l0, at, sign, leaf), (l1, who, deep, n1, s1, up, own)


def _by_depth(values: np.ndarray, deep: list[int]) -> np.ndarray:
    """Values of the nodes of Tree.lower summed for each of its ids, in their own place."""
    out = values[:deep[0]] if deep else values
    at = len(out)
    for n in deep[1:]:
        out[:n] += values[at:at + n]
        at += n
    return out


def _losses(l: np.ndarray) -> np.ndarray:
    """Of turns with log odds l."""
    out = np.exp(-l)
    out += 1
    return np.log(out, out=out)


def log_probs(w: dict[str, np.ndarray], m: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log probability of each target (0 where there is none)."""
    out = np.zeros(y.size)
    table = m.get("table")
    if table is None:
        table = w["E"] @ joint(w)[0]
    for a in range(0, len(x), AT_ONCE):
        part, t = x[a:a + AT_ONCE], y[a:a + AT_ONCE].ravel()
        live = np.flatnonzero(t >= 0)
        u, t = heads(w, part, table)[-1].take(live, 0), t.take(live)
        (l0, _, _, leaf), (l1, who, deep, *_) = odds(w, m, u, part[:, STEP:].ravel().take(live), t)
        loss = _losses(l0) @ np.ones(l0.shape[1], l0.dtype) - m["tree"].spare.take(leaf)
        loss[who] += _by_depth(_losses(l1), deep)
        out[a * STEP + live] = -loss
    return out.reshape(y.shape)


def _rows_sum(keys: np.ndarray, values: np.ndarray, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the sum of their rows of values and how many they had (of ``many``, how many each row stands for)."""
    there = np.zeros(int(keys.max(initial=0)) + 1, bool)
    there[keys] = True
    found = np.flatnonzero(there)
    rank = np.empty(len(there), np.int64)
    rank[found] = np.arange(len(found))
    place = rank.take(keys)
    columns = place + np.arange(0, WIDTH * len(found), max(1, len(found)))[:WIDTH, None] if len(found) else np.zeros((WIDTH, 0), np.int64)
    sums = np.bincount(columns.ravel(), np.array(values.T, np.float64, order="C").ravel(), minlength=WIDTH * len(found)).reshape(WIDTH, len(found))
    return found, np.array(sums.T, values.dtype, order="C"), np.bincount(place, many, minlength=len(found)).astype(np.int64)


def keep_memory() -> None:
    """Asks the C library to keep freed arrays for the next step: giving each back to the system and taking it again costs more than the sums in it."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 64 << 20)  # from which size on memory is mapped apart
        libc.mallopt(-1, 128 << 20)  # how much is kept at the top
    except (OSError, AttributeError):
        pass


def gradients(w: dict[str, np.ndarray], m: dict, x: np.ndarray, y: np.ndarray, measured: bool = True) -> tuple[float, dict[str, np.ndarray], dict[str, tuple]]:
    """Mean loss over the targets (0 unless ``measured``), its gradients by the dense weights, and (rows, gradients, how often) by the tables E and N."""
    first, second, keys, e, q, s, share, c, h, r, u_all = heads(w, x)
    targets = y.ravel()
    live = np.flatnonzero(targets >= 0)
    t, before, n = targets.take(live), x[:, STEP:].ravel().take(live), max(1, len(live))
    u = u_all.take(live, 0)
    (l0, at, sign, leaf), (l1, who, deep, n1, s1, up, own) = odds(w, m, u, before, t)
    loss = float(_losses(l0).sum() - m["tree"].spare.take(leaf).sum() + _losses(l1).sum()) / n if measured else 0.0
    for l, turned in ((l0, sign), (l1, s1)):
        np.exp(l, out=l)
        l += 1
        l *= -n
        np.divide(turned, l, out=l)
    dz = np.zeros((len(live), TOP), u.dtype)
    dz.ravel()[at] = l0
    g = {"T": dz.T @ u}
    some = dz @ w["T"]
    l1 = l1[:, None]
    some[who] += _by_depth(np.multiply(own, l1, out=own), deep)
    up *= l1
    rows_n = _rows_sum(n1, up)
    du = some
    if len(live) < len(u_all):
        du = np.zeros_like(u_all)
        du[live] = some
    g["B"] = r.T @ du
    dr = du @ w["B"].T
    dr *= r > 0
    g["A"], g["a"] = h.T @ dr, np.ones(len(dr), dr.dtype) @ dr
    dqh = np.empty((len(dr), 2 * WIDTH), dr.dtype)
    dh = np.add(dr @ w["A"].T, du, out=dqh[:, WIDTH:])
    both = c.T @ dh
    g["V"], g["O"] = both @ w["O"].T, w["V"].T @ both
    dc = dh @ second.T
    dc *= share
    less = np.einsum("ij,ij->i", dc, c).reshape(len(x), STEP, 1)
    dc = dc.reshape(len(x), STEP, WIDTH)
    ds = np.matmul(dc, keys.transpose(0, 2, 1))
    ds -= less
    ds *= s
    g["rel"] = np.bincount(_OFFSET.ravel(), np.ones(len(x), ds.dtype) @ ds.reshape(len(x), -1), minlength=2 * STEP).astype(u.dtype)
    np.matmul(ds, keys, out=dqh.reshape(len(x), STEP, -1)[:, :, :WIDTH])
    both = e.T @ dqh
    g["R"], both = both[:, WIDTH:], both[:, :WIDTH] * np.float32(WIDTH**-0.5)
    g["Q"], g["K"] = both @ w["K"], both.T @ w["Q"]
    de = np.matmul(ds.transpose(0, 2, 1), q)
    de += np.matmul(s.transpose(0, 2, 1), dc)
    de[:, STEP:] += (dqh @ first.T).reshape(len(x), STEP, WIDTH)
    # what one window scores is mostly the next one's context: rows of the same ids are added before they are sorted
    again = np.zeros(len(x) + 1, bool)
    again[1:-1] = (x[1:, :STEP] == x[:-1, STEP:]).all(1)
    de[:-1, STEP:] += de[1:, :STEP] * again[1:-1, None, None].astype(de.dtype)
    alone = np.flatnonzero(~again[:-1])
    ids = np.concatenate([x[:, STEP:].ravel(), x[alone, :STEP].ravel()])
    many = np.ones(len(ids), np.int64)
    many[:len(x) * STEP] += np.repeat(again[1:], STEP)
    return loss, g, {"E": _rows_sum(ids, np.concatenate([de[:, STEP:].reshape(-1, WIDTH), de[alone, :STEP].reshape(-1, WIDTH)]), many), "N": rows_n}


class Optimiser:
    """Adam for the dense weights; for the rows of the tables, steps by the root of their summed squares."""

    def __init__(self, w: dict[str, np.ndarray], rate: float = 1.0):
        self.dense, self.rate, self.t, self.seen = np.concatenate([w[k].ravel() for k in SHAPES]), rate, 0, 0
        cuts = np.cumsum([w[k].size for k in SHAPES])[:-1]
        self.w = {k: v.reshape(w[k].shape) for k, v in zip(SHAPES, np.split(self.dense, cuts))} | {k: w[k].copy() for k in "EN"}  # parts of the one vector
        self.m, self.s = (np.zeros(len(self.dense), np.float32) for _ in range(2))
        self.squares, self.touched = ({k: np.zeros(len(w[k]), kind) for k in "EN"} for kind in (np.float32, np.int64))

    def step(self, g: dict[str, np.ndarray], rows: dict[str, tuple], windows: int) -> None:
        self.t, self.seen = self.t + 1, self.seen + windows
        rate = self.rate * RATE * (1 - 0.999**self.t) ** 0.5 / (1 - 0.9**self.t)
        d = np.concatenate([g[k].ravel() for k in SHAPES])
        self.m += 0.1 * (d - self.m)
        self.s += 0.001 * (d * d - self.s)
        self.dense -= (rate * self.m / (np.sqrt(self.s) + 1e-8)).astype(np.float32)
        for k, (at, d, many) in rows.items():
            squares = self.squares[k].take(at) + np.einsum("ij,ij->i", d, d) / WIDTH
            self.squares[k][at] = squares
            self.w[k][at] = self.w[k].take(at, 0) - d * (self.rate * ROW_RATE / (np.sqrt(squares) + 1e-8)).astype(np.float32)[:, None]
            self.touched[k][at] += many

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, weight and values (WIDTH of each, times the weight, in whole numbers) of all that was trained: dense weights first, then rows of E and N."""
        d = flat(self.w)
        keys, many, values = [np.arange(len(d))], [np.full(len(d), self.seen)], [d]
        base = len(d)
        for k in "EN":
            at = np.flatnonzero(self.touched[k])
            keys.append(base + at)
            many.append(self.touched[k][at])
            values.append(self.w[k][at])
            base += len(self.w[k])
        n = np.concatenate(many)
        return np.concatenate(keys), n, np.round(np.concatenate(values).astype(np.float64) * n[:, None] * FIXED).astype(np.int64)


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    """The dense weights as rows of WIDTH."""
    v = np.concatenate([w[k].ravel() for k in SHAPES])
    return np.concatenate([v, np.zeros(-len(v) % WIDTH, np.float32)]).reshape(-1, WIDTH)


def averaged(w: dict[str, np.ndarray], keys: np.ndarray, many: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """Weights with the rows that were trained in place of the old ones."""
    dense = flat(w)
    rows = np.concatenate([dense, w["E"], w["N"]])
    rows[keys] = (values / (many[:, None] * FIXED)).astype(np.float32)
    v, out, at = rows[:len(dense)].ravel(), {}, 0
    for k, s in SHAPES.items():
        out[k] = v[at:at + int(np.prod(s))].reshape(s).copy()
        at += int(np.prod(s))
    return out | {"E": rows[len(dense):len(dense) + len(w["E"])], "N": rows[len(dense) + len(w["E"]):]}


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a binary column on end and where each row starts."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), "<u2"), np.concatenate([[0], np.cumsum([len(h) // 2 for h in held])]).astype(np.int64)


def _sums(df: DataFrame, size: int) -> np.ndarray:
    """Column n summed by the number i; size rows come to the driver at most."""
    got = df.groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("i").to_numpy()] = got.column("n").to_numpy()
    return out


def _rows_of(counts: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], ["i", "n"])


def token_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (2 bytes each) of every document, written."""
    if tokens_of(vocabulary).width != 2:
        raise ValueError("the model is for vocabularies of up to 65 536 ids")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(vocabulary)
        for b in batches:
            for part in batches_of(b, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tokens.of(t) for t in part.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    d = Columns(docs, ["doc_id", "text"]).only().withColumn("doc_id", F.col("doc_id").try_cast("bigint"))
    return written(d.mapInArrow(encode, "doc_id bigint, ids binary"), "token-ids")


def base_odds(counts: np.ndarray, tree: Tree) -> np.ndarray:
    """Log odds of right at the TOP nodes after each class (the last for a text's start), from counts of both turns."""
    own = tree.odds[:TOP].astype(np.float64)
    right = np.zeros(TOP)
    right[:len(own)] = 1 / (1 + np.exp(-own))
    c = counts.reshape(CLASSES + 1, TOP, 2)
    return np.log((c[:, :, 1] + 5 * right + 1e-6) / (c[:, :, 0] + 5 * (1 - right) + 1e-6)).astype(np.float32)


def trained_rows(m: dict, batches: Iterator[pa.RecordBatch], rate: float, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the weights of every shard (column 0; rows come shard by shard, ids in column 1)."""
    own, shard, held = None, None, []
    keep_memory()

    def steps(least: int) -> None:
        while held and sum(len(h[0]) for h in held) >= least:
            x, y = (np.concatenate([h[i] for h in held]) for i in range(2))
            for a in range(0, len(x) - BATCH + 1 if least > 1 else len(x), BATCH):
                own.step(*gradients(own.w, m, x[a:a + BATCH], y[a:a + BATCH], False)[1:], len(x[a:a + BATCH]))
            held[:] = [(x[len(x) - len(x) % BATCH:], y[len(x) - len(x) % BATCH:])] if least > 1 and len(x) % BATCH else []

    for b in batches:
        numbers = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if numbers[lo] != shard:
                if own:
                    steps(1)
                    yield own.rows()
                own, shard = Optimiser(m["weights"], rate), numbers[lo]
            for part in batches_of(b.slice(lo, hi - lo), 1, 1 << 19):
                ids, starts = _ids(part.column(1))
                held.append(windows(ids, starts, size)[:2])
                steps(BATCH)
    if own:
        steps(1)
        yield own.rows()


def learn(tokens: DataFrame, vocabulary: str, rounds: int = ROUNDS, shard: int = SHARD) -> dict:
    """Classes, tree, base odds and weights."""
    size = tokens_of(vocabulary).size

    def count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            counts += np.bincount(_ids(b.column(0))[0], minlength=size)
        yield _rows_of(counts)

    counts = _sums(tokens.select("ids").mapInArrow(count_ids, "i int, n bigint"), size)
    m = {"class": np.append(classes(counts), [CLASSES, CLASSES]).astype(np.int16), "tree": Tree(counts)}
    shared = tokens.sparkSession.sparkContext.broadcast(m)

    def count_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, tree = shared.value["class"], shared.value["tree"]
        leaves = len(tree.top)
        pairs = np.zeros((CLASSES + 1) * leaves, np.int64)
        for b in (part for whole in batches for part in batches_of(whole, 0, 1 << 20)):
            ids, starts = _ids(b.column(0))
            before = np.concatenate([[CLASSES], of[ids[:-1]]]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
            before[starts[:-1][np.diff(starts) > 0]] = CLASSES
            pairs += np.bincount(before * leaves + tree.leaf[ids], minlength=len(pairs))
        turns = np.zeros((CLASSES + 1, TOP * 2), np.int64)
        leaf, depth = np.nonzero(tree.sign)
        np.add.at(turns, (slice(None), tree.top[leaf, depth] * 2 + (tree.sign[leaf, depth] > 0)), pairs.reshape(CLASSES + 1, leaves)[:, leaf])
        yield _rows_of(turns.ravel())

    turns = _sums(tokens.select("ids").mapInArrow(count_turns, "i int, n bigint"), (CLASSES + 1) * TOP * 2)
    m |= {"base": base_odds(turns, m["tree"]), "weights": first_weights(size, m["tree"].nodes)}
    shards = int(max(1, -(-counts.sum() // (shard * max(1, rounds)))))
    dealt = tokens.filter(F.length("ids") > 0).withColumn("deal", F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards * max(1, rounds))))
    values = [f"v{i}" for i in range(WIDTH)]
    schema = "i int, n bigint, " + ", ".join(f"{v} bigint" for v in values)
    for turn in range(rounds):
        start = tokens.sparkSession.sparkContext.broadcast(m)

        def train(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            for keys, many, v in trained_rows(start.value, batches, 1 / (1 + turn), size):
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(many), *(pa.array(v[:, i]) for i in range(WIDTH))], ["i", "n", *values])

        mine = dealt.filter(F.pmod("deal", F.lit(max(1, rounds))) == turn).select(F.floor(F.col("deal") / max(1, rounds)).cast("int").alias("shard"), "ids", "doc_id")
        placed = mine.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids").select("shard", "ids")
        got = placed.mapInArrow(train, schema).groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in values)).toArrow()  # as many rows as the tables have
        if got.num_rows:
            m = m | {"weights": averaged(m["weights"], got.column("i").to_numpy(), got.column("n").to_numpy(), np.stack([got.column(v).to_numpy() for v in values], 1))}
    return m | {"table": m["weights"]["E"] @ joint(m["weights"])[0]}


def score_tokens(m: dict, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the log probabilities of each row's tokens."""
    x, y, row = windows(ids, starts, len(m["class"]) - 2)
    return np.bincount(row, log_probs(m["weights"], m, x, y).sum(1), minlength=len(starts) - 1)


def score(docs: DataFrame, vocabulary: str | None = None, **how) -> DataFrame:
    """Number of tokens, log probability and its mean over tokens, of every document."""
    vocabulary = vocabulary or default_vocabulary()
    tokens = token_table(docs, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(learn(tokens, vocabulary, **how))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for b in batches:
            for part in batches_of(b, "ids", 1 << 19):
                ids, starts = _ids(part.column(1))
                n, total = np.diff(starts), score_tokens(shared.value, ids, starts)
                mean = pd.Series(total / np.maximum(n, 1)).where(n > 0).round(6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(np.round(total, 4)), pa.array(mean, from_pandas=True)], ["doc_id", "tokens", "log_prob", "mean_log_prob"])

    return tokens.mapInArrow(of, SCORES)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
ORACLE_SQL: dict[str, str] = {}

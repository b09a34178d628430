"""Random forest with class weights balanced in every bag (M6).

A bag is a bootstrap of the training rows, each drawn Poisson(1) times. In a bag of n draws,
of which n_c have class c, a draw of class c weighs n / (K n_c), K the classes the bag
holds. The draws are an integer
hash of the row's key (without a key: its number) and the bag's number against the
distribution's cumulative shares: a bag is the same wherever and however often it is
drawn, and SQL can draw it too (:func:`bag_weights`). Trees grow on ``sqrt`` of the features
at every node, to at most ``max_bins`` bins a feature:

* ``exact``: the splits weigh a draw by its bag's class weight.
* otherwise by the one weight of its row, the balanced one over all rows; only the class
  shares of the leaves are balanced in each bag: a node's weighted counts of a class are
  divided by those of the tree's root.

``per_fit`` trees grow together (fewer of very many rows, so that the draws shuffled at a time
stay bounded). Nodes of more than ``TASK_ROWS`` rows are split by passes over the rows, a level a
pass, which add up a histogram of class weights per node and feature. Once every node is
smaller, its rows are shuffled together, a byte a bin, and its subtree grows in one task, which
keeps the histograms of a group of nodes at a time: deep trees have almost as many nodes as rows, and
a histogram for each, as MLlib's forest has it, would be hundreds of times the rows.

Fitted trees are written as rows (bag, id, feature, threshold, left, right, probs) and
forgotten by the driver; a forest is a table. Scoring takes trees in blocks of at most
``BLOCK_NODES`` nodes: every block adds up its trees' class shares for all rows in one
pass and writes them, and the blocks' sums are aggregated per row. So neither the driver nor
a task holds more than one subtree or one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, shared_path
from .bootstrap import HASH_P, HASH_ROUNDS_HI, HASH_ROUNDS_LO, HASH_SEED_MUL
from .sums import columns_of, task_sums

#: Cumulative shares of Poisson(1), as bounds of the draw hash (below 2^31 - 1).
POISSON_BOUNDS = [int(HASH_P * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]
#: Draws of the hashes that share their bits above ``DRAW_SHIFT``, or UNSETTLED where these have several.
DRAW_SHIFT, UNSETTLED = 19, 255
_ENDS = np.searchsorted(POISSON_BOUNDS, np.add.outer(np.arange(1 << 31 - DRAW_SHIFT) << DRAW_SHIFT, [0, (1 << DRAW_SHIFT) - 1]), side="right")
DRAWS_BY_BITS = np.where(_ENDS[:, 0] == _ENDS[:, 1], _ENDS[:, 0], UNSETTLED).astype(np.uint8)
#: Rows of a node whose subtree grows in one task.
TASK_ROWS = 1 << 21
#: Rows and nodes of a subtree whose histograms are added up together.
GROUP_ROWS, GROUP_NODES = 1 << 15, 64
#: Histograms that a group's rows are added to in turn, since adding again to the same number has to wait for it.
LANES = 4
#: Draws of the trees that grow together.
ROUND_DRAWS = 1 << 27
#: Ranks at which a feature's values are taken for its bins.
RANKS = 2000
#: Nodes of the trees that are scored together.
BLOCK_NODES = 1_500_000
#: Levels that scored rows go down before those in leaves are set aside.
LEVELS = 4
NODE_FIELDS = "bag int, id int, feature int, threshold double, left int, right int, probs array<double>"


@dataclass(frozen=True)
class ForestSpec:
    """The forest's parameters; defaults as far as the original sets them."""
    bags: int = 300
    max_depth: int = 30
    min_rows: int = 1               # rows of a leaf
    max_bins: int = 32              # candidate thresholds of a feature
    seed: int = 42
    per_fit: int = 100              # trees grown together
    exact: bool = False             # weights of each bag in the splits too
    parallel: int = 8               # without effect: the bags of a round always grow together


def _mix(x: np.ndarray, rounds) -> np.ndarray:
    for mul, add, shift in rounds:
        x = (x * mul + add) % HASH_P
        x = x ^ (x >> shift)
    return x % HASH_P


def key_hash(keys: np.ndarray) -> np.ndarray:
    return _mix((keys % HASH_P + (keys // HASH_P) % HASH_P * 7) % HASH_P, HASH_ROUNDS_HI)


def draws(hashes: np.ndarray, bags: np.ndarray | int) -> np.ndarray:
    """How often each bag draws the row of each key's hash: Poisson(1)."""
    # a multiplier for each bag: bags that only add to a row's number would draw alike
    u = _mix(hashes * _mix((bags * HASH_SEED_MUL + 1) % HASH_P, HASH_ROUNDS_HI) % HASH_P, HASH_ROUNDS_LO)
    # most are settled by their higher bits
    k = DRAWS_BY_BITS.take(u >> DRAW_SHIFT)
    open_ = np.flatnonzero(k == UNSETTLED)
    k[open_] = np.searchsorted(POISSON_BOUNDS, u.take(open_), side="right")
    return k


def with_draws(rows: DataFrame, key: str, bag: Column, name: str) -> DataFrame:
    """``rows`` and how often the bag draws each, by the integer ``key``. Whole
    Arrow batches at a time: as a column expression the hash, which reads every step twice, is
    too long to compile. A row without a key is drawn as key 0."""
    def draw(keys: pd.Series, bags: pd.Series) -> pd.Series:
        return pd.Series(draws(key_hash(keys.to_numpy(np.int64)), bags.to_numpy(np.int64)).astype(np.int32))

    drawn = F.pandas_udf(draw, "int").asNondeterministic()         # not twice, for a filter and for its value
    return rows.withColumn(name, drawn(F.coalesce(F.col(key).cast("bigint"), F.lit(0).cast("bigint")), bag.cast("bigint")))


def bag_weights(train: DataFrame, label: str, key: str, bags: int) -> DataFrame:
    """(bag, label, n_draws, weight): the balanced weight of a draw of each class in each
    bag. Every row meets every bag, as in the fits; only bag x class sums are shuffled."""
    rows = (train.filter(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("label"), F.col(key).alias("_key"))
            .withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))))
    counts = (with_draws(rows, "_key", F.col("bag"), "k").filter("k > 0").groupBy("bag", "label")
              .agg(F.sum("k").alias("n_draws")))
    total = counts.groupBy("bag").agg(F.sum("n_draws").alias("n"), F.count(F.lit(1)).alias("classes"))     # a row per bag
    return (counts.join(F.broadcast(total), "bag")
            .select("bag", "label", "n_draws", (F.col("n") / (F.col("classes") * F.col("n_draws"))).alias("weight")))


def bin_bounds(data: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """The thresholds of each feature of ``f``: midways between all its values if there are at most ``bins``, else
    between those that cut its distribution in about equal shares. Read from its values at ``RANKS`` ranks."""
    cols = [f"f{j}" for j in range(d)]
    ranks = data.select(*[F.col("f")[j].alias(c) for j, c in enumerate(cols)]).approxQuantile(
        cols, [r / RANKS for r in range(RANKS + 1)], 0.5 / RANKS)
    out = []
    for values in ranks:
        v, counts = np.unique(np.array(values, float), return_counts=True)
        mid = (v[:-1] + v[1:]) / 2
        mid = np.where(np.isfinite(mid), mid, v[:-1])
        if len(v) > bins:
            share, target, cuts = counts.sum() / bins, counts.sum() / bins, []
            until = np.cumsum(counts)
            for i in range(1, len(v)):
                if abs(until[i - 1] - target) < abs(until[i] - target):
                    cuts.append(i - 1)
                    target += share
            mid = mid[cuts]
        out.append(mid[:bins - 1])
    return out


def bin_type(spec: ForestSpec) -> np.dtype:
    return np.dtype("u1" if spec.max_bins <= 256 else "<u2")


def with_bins(data: DataFrame, bounds: list[np.ndarray], kind: np.dtype) -> DataFrame:
    """(key, y, w, x): x the bin of every feature, as ``kind``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = columns_of(b)[3]
                x = np.column_stack([np.searchsorted(t, f[:, j]) for j, t in enumerate(bounds)]).astype(kind)
                ends = np.arange(b.num_rows + 1, dtype=np.int32) * (x.shape[1] * kind.itemsize)
                packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed], names=["key", "y", "w", "x"])

    return data.select("key", "y", "w", "f").mapInArrow(run, "key long, y int, w double, x binary")


def some_rows(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``x[rows]``; a row is taken as one item, several times as fast."""
    if not x.size:
        return x[rows]
    return x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).reshape(-1).take(rows).view(x.dtype).reshape(-1, x.shape[1])


class TopTree:
    """The nodes of a tree that passes over the rows have split: feature (-1: none, -2: its subtree grows in a task), last bin to the left, children, class weights."""

    def __init__(self, weights: np.ndarray):
        self.feature, self.split, self.left, self.right = (np.full(1, -1) for _ in range(4))
        self.weights, self.depth = weights[None], np.zeros(1, int)

    def grow(self, node: int, feature: int, split: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.split[node], self.left[node], self.right[node] = feature, split, a, a + 1
        for c in ("feature", "split", "left", "right"):
            setattr(self, c, np.append(getattr(self, c), [-1, -1]))
        self.weights = np.vstack((self.weights, left, right))
        self.depth = np.append(self.depth, [self.depth[node] + 1] * 2)
        return a, a + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        going = np.flatnonzero(self.feature[at] >= 0)
        while len(going):
            here = at[going]
            value = x.reshape(-1).take(going * x.shape[1] + self.feature.take(here))
            at[going] = here = np.where(value <= self.split.take(here), self.left.take(here), self.right.take(here))
            going = going[self.feature.take(here) >= 0]
        return at


def picked(rng: np.random.Generator, nodes: int, d: int) -> np.ndarray:
    """The features that each of ``nodes`` nodes may split on: sqrt(d) of them."""
    few = max(1, math.ceil(math.sqrt(d)))
    return np.argpartition(rng.random((nodes, d), np.float32), few - 1, axis=1)[:, :few]


def gini_gain(left: list[np.ndarray], total: list[np.ndarray]) -> np.ndarray:
    """How far splits lower the Gini impurity, from the weights of each class; rounded, so that the order in
    which weights were added up doesn't settle ties."""
    right = [t - x for t, x in zip(total, left)]
    n, a, b = sum(total), sum(left), sum(right)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (sum(x * x for x in left) / a + sum(x * x for x in right) / b - sum(x * x for x in total) / n) / n
    gain[~((a > 0) & (b > 0))] = 0.0
    return np.round(gain, 9)


def node_groups(size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first node, last, first row, last) of groups of nodes with at most ``GROUP_ROWS`` rows and ``GROUP_NODES``
    nodes (a larger node is a group of its own); rows lie node by node, ``size`` of each."""
    ends, first = np.cumsum(size), 0
    while first < len(size):
        begun = int(ends[first] - size[first])
        last = min(max(int(np.searchsorted(ends, begun + GROUP_ROWS, side="right")), first + 1), first + GROUP_NODES, len(size))
        yield first, last, begun, int(ends[last - 1])
        first = last


def best_splits(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: np.ndarray, size: np.ndarray, picks: np.ndarray,
                classes: int, spec: ForestSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, last bin to the left, class weights of the two sides) of the best split of each node on its features
    ``picks``, or -1; the first of equals. A group's histograms are added up by one count over its rows per feature."""
    d, few, wide = x.shape[1], picks.shape[1], spec.max_bins
    feature, split, flat = np.full(len(size), -1), np.full(len(size), -1), x.reshape(-1)
    sides = np.zeros((len(size), 2, classes))
    for first, last, begun, ended in node_groups(size):
        m = last - first
        cells, drawn = np.zeros((classes, few, m, wide)), np.zeros((few, m, wide))
        for a in range(begun, ended, GROUP_ROWS):                   # more than one only of a single node
            part = slice(a, min(a + GROUP_ROWS, ended))
            rows = size[first:last] if m > 1 else part.stop - a
            at = np.repeat(np.arange(0, m * wide, wide), rows)
            lane = np.arange(part.stop - a) % LANES * (classes * m * wide)
            at_class = lane + at + y[part].astype(np.int64) * (m * wide)
            start = np.arange(a * d, part.stop * d, d)
            for s in range(few):
                value = x[part, picks[first, s]] if m == 1 else flat.take(start + np.repeat(picks[first:last, s], rows))
                cells[:, s] += np.bincount(at_class + value, w[part], LANES * classes * m * wide).reshape(LANES, classes, m, wide).sum(axis=0)
                if spec.min_rows > 1:
                    drawn[s] += np.bincount(at + value, k[part], m * wide).reshape(m, wide)
        left = cells.cumsum(axis=3)
        gain = gini_gain(list(left), list(left[..., -1:]))
        if spec.min_rows > 1:
            below = drawn.cumsum(axis=2)
            gain[np.minimum(below, below[..., -1:] - below) < spec.min_rows - 0.5] = 0.0
        cut = gain.argmax(axis=2)
        top = np.take_along_axis(gain, cut[..., None], axis=2)[..., 0]
        s, places = top.argmax(axis=0), np.arange(m)
        hit = np.flatnonzero(top[s, places] > 0)
        s, cut = s[hit], cut[s[hit], hit]
        feature[first + hit], split[first + hit] = picks[first + hit, s], cut
        # added up from both ends: a class that a side doesn't hold weighs exactly nothing there
        sides[first + hit, 0] = left[:, s, hit, cut].T
        sides[first + hit, 1] = cells[:, s, hit, ::-1].cumsum(axis=2)[:, np.arange(len(hit)), wide - 2 - cut].T
    return feature, split, sides


def grow_subtree(x: np.ndarray, weights: list[np.ndarray], k: np.ndarray, depth: int, spec: ForestSpec, rng: np.random.Generator):
    """(feature, split, left, right, class weights) of the nodes of a subtree, its root first, from its rows' bins, class
    weights (a row a class) and draws; all nodes of a level at a time. The rows of nodes that go on are moved so that
    they lie node by node, left children first. So a level's cost follows these rows, however many nodes there are."""
    classes, d = len(weights), x.shape[1]
    y = np.zeros(len(x), np.uint8 if classes <= 256 else np.uint16)
    for c, own in enumerate(weights):
        y[own > 0] = c
    w = sum(weights).astype(float)
    x = np.ascontiguousarray(x, bin_type(spec))
    total = np.bincount(y, w, classes)[None]
    # the nodes that go on: their places in the level, in the order of their rows, and how many these are
    place, size, n_nodes, levels = np.flatnonzero((total > 0).sum(axis=1) > 1), np.array([len(x)]), 1, []
    while True:
        feature, split, left, right = (np.full(len(total), -1) for _ in range(4))
        levels.append((feature, split, left, right, total))
        if not len(place) or depth >= spec.max_depth:
            break
        # features are drawn in the order of the places
        picks = picked(rng, len(place), d)[np.argsort(np.argsort(place))]
        f, b, sides = best_splits(x, y, w, k, size, picks, classes, spec)
        feature[place], split[place] = f, b
        grown = np.flatnonzero(feature >= 0)
        left[grown] = n_nodes + 2 * np.arange(len(grown))
        right[grown] = left[grown] + 1
        nodes, depth = 2 * len(grown), depth + 1
        child = left[place][:, None] - n_nodes + [0, 1]
        n_nodes += nodes
        total = np.empty((nodes, classes))
        total[child[f >= 0]] = sides[f >= 0]
        mixed = (sides > 0).sum(axis=2) > 1
        if not mixed.any():
            place = place[:0]
            continue
        value = x.reshape(-1).take(np.arange(0, len(x) * d, d) + np.repeat(np.maximum(f, 0), size))
        up, ends, orders, held = value > np.repeat(b, size), np.append(0, np.cumsum(size)), [], np.zeros((2, len(size)), int)
        for side, there in enumerate((~up, up)):
            orders.append(np.flatnonzero(there & np.repeat(mixed[:, side], size)))
            held[side] = np.diff(np.searchsorted(orders[side], ends))
        order = np.concatenate(orders)
        x, y, w, k = some_rows(x, order), y.take(order), w.take(order), k.take(order) if spec.min_rows > 1 else k
        place, size = child.T[held > 0], held[held > 0]
    return tuple(np.concatenate(c) for c in zip(*levels))


def grow_round(data: DataFrame, bags: range, d: int, classes: int, bounds: list[np.ndarray], spec: ForestSpec, path: str) -> None:
    """Grow the trees of ``bags`` on binned rows and add their nodes to ``path``."""
    spark, count, kind = data.sparkSession, len(bags), bin_type(spec)

    def drawn(batches, wanted=range(count)):
        """(bag's place, rows in it, y, draws, weight before the bag's own, key, bins) of a batch in each bag; key
        and bins are those of all rows"""
        for key, y, w, x in batches:
            hashes, x = key_hash(key), x.view(kind)
            for i in wanted:
                k = draws(hashes, bags[i])
                rows = np.flatnonzero(k)
                k = k.take(rows)
                yield i, rows, y.take(rows), k, k * w.take(rows), key, x

    def totals(batches):
        out = np.zeros((count, 3, classes))
        for i, _, y, k, w, _, _ in drawn(batches):
            for j, v in enumerate((w, k, None)):
                out[i, j] += np.bincount(y, v, classes)
        return out

    root = task_sums(data, count * 3 * classes, totals).reshape(count, 3, classes)
    own = np.ones((count, classes))
    if spec.exact:                                  # n / (K n_c) of the bag's draws
        n, held = root[:, 1].sum(1, keepdims=True), (root[:, 1] > 0).sum(1, keepdims=True)
        own = np.divide(n, held * root[:, 1], out=np.zeros((count, classes)), where=root[:, 1] > 0)
    weighed = root[:, 0] * own
    trees = [TopTree(weighed[i]) for i in range(count)]
    large = [(i, 0) for i in range(count) if root[i, 2].sum() > TASK_ROWS]
    for i in set(range(count)) - {i for i, _ in large}:
        trees[i].feature[0] = -2                                    # the whole tree grows in a task
    while large:
        # one generator a node: its features are the same however nodes are grouped
        picks = [picked(np.random.default_rng([spec.seed, bags[i], node]), 1, d)[0] for i, node in large]
        f, wide, c = len(picks[0]), spec.max_bins, classes + 2
        of: dict[int, list] = {}
        for place, (i, node) in enumerate(large):
            of.setdefault(i, []).append((place, node))

        def histogram(batches):
            out = np.zeros((len(large), f, wide, c))
            for i, rows, y, k, w, _, x in drawn(batches, of):
                x = some_rows(x, rows)
                at = trees[i].place(x)
                for place, node in of[i]:
                    rows = np.flatnonzero(at == node)
                    yc, kc, wc = y.take(rows), k.take(rows), w.take(rows)
                    for s, j in enumerate(picks[place]):
                        b = x[:, j].take(rows).astype(np.int64)
                        out[place, s, :, :classes] += np.bincount(b * classes + yc, wc, wide * classes).reshape(wide, -1) * own[i]
                        out[place, s, :, classes] += np.bincount(b, kc, wide)
                        out[place, s, :, classes + 1] += np.bincount(b, minlength=wide)
            return out

        left = task_sums(data, len(large) * f * wide * c, histogram).reshape(len(large), f, wide, c).cumsum(axis=2)
        following = []
        for place, (i, node) in enumerate(large):
            whole = left[place, 0, -1]
            gain = gini_gain(list(np.moveaxis(left[place, :, :, :classes], -1, 0)), list(whole[:classes]))
            k = left[place, :, :, classes]
            gain[(k < spec.min_rows) | (whole[classes] - k < spec.min_rows)] = 0.0
            s, b = np.unravel_index(gain.argmax(), gain.shape)
            if not gain[s, b] > 0:
                continue
            lower, upper = left[place, s, b], whole - left[place, s, b]
            children = trees[i].grow(node, picks[place][s], b, lower[:classes], upper[:classes])
            for child, part in zip(children, (lower, upper)):
                if part[classes + 1] > TASK_ROWS and (part[:classes] > 0).sum() > 1 and trees[i].depth[child] < spec.max_depth:
                    following.append((i, child))
                    continue
                trees[i].feature[child] = -2
        large = following

    fields = [("w", "<f8", ()), ("y", "<u2", ()), *([("k", "u1", ())] if spec.min_rows > 1 else []), ("x", kind, (d,))]

    def packed(columns: dict[str, np.ndarray]) -> bytes:
        return b"".join(np.ascontiguousarray(columns[name], t).tobytes() for name, t, _ in fields)

    def unpacked(pieces: list[pa.Buffer]) -> dict[str, np.ndarray]:
        """The rows of the pieces, column by column"""
        wide = sum(np.dtype((t, shape)).itemsize for _, t, shape in fields)
        sizes = [p.size // wide for p in pieces]
        out = {name: np.empty((sum(sizes), *shape), t) for name, t, shape in fields}
        done = 0
        for p, n in zip(pieces, sizes):
            at = 0
            for name, t, shape in fields:
                column = np.frombuffer(p, t, n * math.prod(shape), at)
                out[name][done:done + n] = column.reshape(n, *shape)
                at += column.nbytes
            done += n
        return out

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bag, top, first, rows): a batch's rows of a node, packed"""
        for i, rows, y, k, w, key, x in drawn(columns_of(b) for b in batches if b.num_rows):
            if not len(y):
                continue
            x, key = some_rows(x, rows), key.take(rows)
            if len(trees[i].feature) > 1:
                at = trees[i].place(x)
                order = np.argsort(at, kind="stable")
                nodes, starts = np.unique(at[order], return_index=True)
                groups = np.split(order, starts[1:])
            else:
                nodes, groups = np.zeros(1, int), [slice(None)]
            grown = [(top, g) for top, g in zip(nodes, groups) if trees[i].feature[top] == -2]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(grown), pa.int32()), pa.array([top for top, _ in grown], pa.int32()),
                 pa.array([key[g][0] for _, g in grown], pa.int64()),
                 pa.array([packed({"w": w[g], "y": y[g], "k": k[g], "x": x[g]}) for _, g in grown], pa.binary())],
                names=["bag", "top", "first", "rows"])

    def subtree(group: pa.Table) -> pa.Table:
        i, top = group["bag"][0].as_py(), group["top"][0].as_py()
        pieces = [r.as_buffer() for c in group["rows"].chunks for r in c]
        rows = unpacked([pieces[j] for j in np.argsort(group["first"].to_numpy(), kind="stable")])        # the same order in every run
        feature, split, left, right, held = grow_subtree(
            rows["x"], [np.where(rows["y"] == c, rows["w"] * own[i, c], 0.0) for c in range(classes)], rows.get("k"),
            int(trees[i].depth[top]), spec, np.random.default_rng([spec.seed, bags[i], top]))
        return node_table(i, top, feature, split, left, right, held)

    def node_table(i, top, feature, split, left, right, held) -> pa.Table:
        share = np.divide(held, weighed[i], out=np.zeros(held.shape), where=weighed[i] > 0)
        share /= share.sum(axis=1, keepdims=True)
        table = np.full((d, spec.max_bins), np.nan)
        for j, t in enumerate(bounds):
            table[j, :len(t)] = t
        threshold = np.where(feature >= 0, table[feature, split], np.nan)
        return pa.table({"bag": np.full(len(feature), i, np.int32), "top": np.full(len(feature), top, np.int32),
                         "id": np.arange(len(feature), dtype=np.int32), "feature": feature.astype(np.int32),
                         "threshold": pa.array(threshold, from_pandas=True), "left": left.astype(np.int32), "right": right.astype(np.int32),
                         "probs": pa.ListArray.from_arrays(np.arange(0, held.size + 1, classes, dtype=np.int32), share.reshape(-1))})

    grown = shared_path(spark, "subtrees")
    # more tasks than subtrees: few meet in one
    tasks = max(1, min(4 * sum(int((t.feature == -2).sum()) for t in trees), 32 * spark.sparkContext.defaultParallelism))
    (data.mapInArrow(parts, "bag int, top int, first long, rows binary").repartition(tasks, "bag", "top").groupBy("bag", "top")
     .applyInArrow(subtree, "bag int, top int, id int, feature int, threshold double, left int, right int, probs array<double>")
     .write.parquet(grown))
    below = spark.read.parquet(grown)
    # ids: the top's, then those of each subtree, whose root is a node of the top
    start, offsets = {i: len(t.feature) - 1 for i, t in enumerate(trees)}, []
    for r in below.groupBy("bag", "top").count().orderBy("bag", "top").collect():                    # a row per subtree
        offsets.append((r["bag"], r["top"], start[r["bag"]]))
        start[r["bag"]] += r["count"] - 1
    at = F.broadcast(spark.createDataFrame(offsets, "bag int, top int, offset int"))
    shifted = lambda c: F.when(F.col(c) > 0, F.col(c) + F.col("offset")).otherwise(F.col(c)).cast("int").alias(c)
    number = (F.col("bag") + bags[0]).cast("int").alias("bag")
    out = below.join(at, ["bag", "top"]).select(
        number, F.when(F.col("id") > 0, F.col("id") + F.col("offset")).otherwise(F.col("top")).cast("int").alias("id"), "feature", "threshold",
        shifted("left"), shifted("right"), "probs")
    tops = []
    for i, t in enumerate(trees):
        held = np.flatnonzero(t.feature != -2)
        for r in node_table(i, 0, t.feature[held], t.split[held], t.left[held], t.right[held], t.weights[held]).to_pylist() if len(held) else []:
            tops.append((r["bag"], int(held[r["id"]]), r["feature"], r["threshold"], r["left"], r["right"], r["probs"]))
    if tops:
        out = out.unionByName(spark.createDataFrame(tops, NODE_FIELDS).withColumn("bag", number))
    out.repartition("bag").sortWithinPartitions("bag", "id").write.mode("append").parquet(path)
    drop_path(spark, grown)


def fit_forest(train: DataFrame, label: str, spec: ForestSpec = ForestSpec(), key: str | None = None,
               weight: str | None = None, path: str | None = None) -> str:
    """Grow a forest on ``train`` (features vector, label; an integer ``key`` of the rows if exact, else
    their balanced ``weight``) and write its nodes; their path is returned. Rows without a label
    take no part."""
    spark = train.sparkSession
    path = path or shared_path(spark, "forest")
    number = F.coalesce(F.col(key).cast("bigint"), F.lit(0).cast("bigint")) if spec.exact else F.monotonically_increasing_id()
    w = F.lit(1.0) if spec.exact else F.col(weight).cast("double")
    data = (train.filter(F.col(label).isNotNull())
            .select(number.alias("key"), F.col(label).cast("int").alias("y"), w.alias("w"), vector_to_array("features").alias("f"))
            .checkpoint(eager=True))                # written once: the rows' numbers must be the same in every pass
    spark.createDataFrame([], NODE_FIELDS).write.mode("overwrite").parquet(path)
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y"), F.max(F.size("f")).alias("d")).first()
    if not size["n"]:
        return path
    bounds = bin_bounds(data, size["d"], spec.max_bins)
    binned = with_bins(data, bounds, bin_type(spec)).checkpoint(eager=True)
    together = max(1, min(spec.per_fit, ROUND_DRAWS // size["n"]))
    for first in range(0, spec.bags, together):
        grow_round(binned, range(first, min(first + together, spec.bags)), size["d"], size["y"] + 1, bounds, spec, path)
    return path


def tree_blocks(nodes: DataFrame, limit: int = BLOCK_NODES) -> list[list[int]]:
    """Bags in groups of at most ``limit`` nodes (a larger tree is a group of its own)."""
    blocks: list[list[int]] = []
    room = 0
    for r in nodes.groupBy("bag").count().orderBy("bag").collect():                 # a row per bag
        if not blocks or r["count"] > room:
            blocks.append([])
            room = limit
        blocks[-1].append(r["bag"])
        room -= r["count"]
    return blocks


def score_block(rows: DataFrame, nodes: DataFrame, classes: int) -> DataFrame:
    """(_row, probs): the sum of the class shares that the block's trees give to each row
    (_row, features array). Collects the block's nodes."""
    table = nodes.orderBy("bag", "id").toArrow().combine_chunks()
    cols = {c: table[c].to_numpy() for c in ("bag", "id", "feature", "threshold", "left", "right")}
    given = table["probs"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    trees = []
    for t in np.split(np.arange(table.num_rows), np.flatnonzero(np.diff(cols["bag"])) + 1):
        probs = np.zeros((len(t), classes))
        probs[:, :given.shape[1]] = given[t]
        ids, left, right = (cols[c][t] for c in ("id", "left", "right"))
        at = np.zeros(int(ids.max()) + 1, np.int32)
        at[ids] = np.arange(len(t))
        # a leaf leads to itself; children as right, left of the first node, right, left of the second
        leaf, own = left < 0, np.arange(len(t), dtype=np.int32)
        children = np.column_stack([np.where(leaf, own, at[np.where(leaf, 0, c)]) for c in (right, left)]).reshape(-1)
        trees.append((np.where(leaf, 0, cols["feature"][t]), cols["threshold"][t].astype(float), children, leaf, probs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            votes, flat, starts = np.zeros((b.num_rows, classes)), x.reshape(-1), np.arange(b.num_rows) * x.shape[1]
            for feature, threshold, children, leaf, probs in trees:
                at, going, here, start = np.zeros(b.num_rows, np.int64), np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), starts
                while len(going):
                    for _ in range(LEVELS):
                        low = flat.take(start + feature.take(here)) <= threshold.take(here)
                        here = children.take(2 * here + low)
                    at[going] = here
                    inner = np.flatnonzero(~leaf.take(here))
                    going, here, start = going.take(inner), here.take(inner).astype(np.int64), start.take(inner)
                votes += probs.take(at, axis=0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(np.arange(0, b.num_rows * classes + 1, classes, dtype=np.int32), votes.reshape(-1))],
                names=["_row", "probs"])

    return rows.mapInArrow(run, "_row long, probs array<double>")


def predict_forest(path: str, df: DataFrame, classes: int = 3, limit: int = BLOCK_NODES) -> DataFrame:
    """``df`` (with a features vector) and probs, pred_class, pred_prob and p_rain: the mean
    of the trees' class shares, its largest (the first of equals) and 1 - P(class 0)."""
    spark: SparkSession = df.sparkSession
    nodes = spark.read.parquet(path)
    # written once: the rows' numbers must be the same in every pass
    rows = df.withColumn("_row", F.monotonically_increasing_id()).checkpoint(eager=True)
    narrow = rows.select("_row", vector_to_array("features").alias("f"))
    votes = shared_path(spark, "votes")
    blocks = tree_blocks(nodes, limit)
    for k, bags in enumerate(blocks):
        score_block(narrow, nodes.filter(F.col("bag").isin(bags)), classes).write.mode("overwrite").parquet(f"{votes}/block={k}")
    n = sum(map(len, blocks))
    sums = (spark.read.parquet(votes).groupBy("_row").agg(*[F.sum(F.col("probs")[c]).alias(f"_s{c}") for c in range(classes)])
            .checkpoint(eager=True))
    drop_path(spark, votes)
    probs = F.array(*[F.col(f"_s{c}") / n for c in range(classes)])
    out = rows.join(sums, "_row").withColumn("probs", probs).drop("_row", *[f"_s{c}" for c in range(classes)])
    best = F.array_position("probs", F.array_max("probs")).cast("int")
    return (out.withColumn("pred_class", best - 1).withColumn("pred_prob", F.array_max("probs"))
            .withColumn("p_rain", F.lit(1.0) - F.col("probs")[0]))


@dataclass(frozen=True)
class ForestModel:
    """A written forest and the stages that make its features."""
    prep: PipelineModel
    path: str
    classes: int = 3

    def predict(self, df: DataFrame) -> DataFrame:
        return predict_forest(self.path, self.prep.transform(df), self.classes).drop("features")

    def save(self, path: str) -> None:
        self.prep.write().overwrite().save(f"{path}/prep")
        spark = SparkSession.getActiveSession()
        spark.read.parquet(self.path).write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(path: str, classes: int = 3) -> ForestModel:
        return ForestModel(PipelineModel.load(f"{path}/prep"), f"{path}/nodes", classes)

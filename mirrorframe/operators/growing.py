"""Trees over all rows of a table, by MLlib's rules: cuts of each feature between quantiles, variance or Gini, a least leaf size, a depth.

MLlib sends the statistics of every node of a level from every task, and keeps a record of every node, with its class counts, on the driver. Here nodes of over `LOCAL_ROWS` rows are split by
histograms that tasks add up, a level of all trees a pass; the rows of smaller nodes meet in tasks, which grow what is below. A tree is arrays of its nodes, 2**(depth + 1) at most.

MLlib joins leaves of one majority class afterwards; here they stay apart, since values are drawn from them.

The rows of a leaf are a span of places: a node's span is its left child's followed by its right one's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.plans.stages import staged

#: Rows of a node up to which one task grows what is below it.
LOCAL_ROWS = 1 << 20
#: Rows, by a hash of their content, whose quantiles are the cuts (MLlib takes max_bins**2).
CUT_ROWS = 1 << 18
#: Bytes of histograms that a task holds of one tree.
HISTOGRAM_BYTES = 24 << 20
#: Rows that a task looks at together, and bytes of a block of them.
STEP = 1 << 17
BLOCK_BYTES = 1 << 19
#: Trees that share their passes.
TOGETHER = 8


@dataclass
class Target:
    """A tree to grow: the place of its labels, how many features it may use (the first ones), and its number of classes (0: a number)."""

    i: int
    features: int
    classes: int
    rows: int
    mean: float = 0.0
    scale: float = 1.0


@dataclass
class Nodes:
    """A tree that grows: lists by node, in the end arrays; the right child is the one after the left. depth and mean are kept of nodes that all tasks split."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    count: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=lambda: [0])
    mean: list[float] = field(default_factory=list)

    def split(self, node: int, feature: int, cut: int, n_left: int, mean_left: float, mean_right: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for n, mean in ((n_left, mean_left), (self.count[node] - n_left, mean_right)):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.count.append(n)
            self.depth.append(self.depth[node] + 1)
            self.mean.append(mean)
        return self.left[node], self.left[node] + 1


# cuts and bins


def cuts_of(x: np.ndarray, bins: int) -> np.ndarray:
    """At most bins - 1 cuts: between all values if they are few, else between those at equal shares of the rows."""
    values, counts = np.unique(x, return_counts=True)
    if len(values) > bins:
        at = np.searchsorted(np.cumsum(counts), np.arange(1, bins) * (len(x) / bins))
        at = np.unique(at[at < len(values) - 1])
    else:
        at = np.arange(len(values) - 1)
    return (values[at] + values[at + 1]) / 2


def feature_cuts(frame: DataFrame, rows: int, features: list[str], bins: int) -> list[np.ndarray]:
    """Cuts of each feature. frame has _order, a hash of a row's content."""
    share = CUT_ROWS / max(rows, 1)
    some = frame if share >= 1 else frame.filter(F.col("_order") < F.lit(int(share * (1 << 64)) - (1 << 63)))
    parts = [F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("x")) for k, c in enumerate(features)]

    def cut(group: pa.Table) -> pa.Table:
        return pa.table({"k": group["k"][:1], "cuts": pa.array([cuts_of(group["x"].to_numpy(), bins)], pa.list_(pa.float64()))})

    found = some.select(F.inline(F.array(*parts))).groupBy("k").applyInArrow(cut, "k int, cuts array<double>").collect()  # bins a feature
    out = [np.empty(0)] * len(features)
    for r in found:
        out[r.k] = np.array(r.cuts)
    return out


def binned(frame: DataFrame, features: list[str], cuts: list[np.ndarray], labels: list[SparkColumn]) -> DataFrame:
    """A written table of blocks of rows, a row of it being a block: their _order, their labels (NaN where a row has none) and their bins, a byte a feature, as the bytes of arrays (rows), (labels, rows) and (features, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                x = np.stack([np.searchsorted(c, part[f"x_{k}"].to_numpy(zero_copy_only=False)).astype(np.uint8) for k, c in enumerate(cuts)])
                y = np.stack([part[n].to_numpy(zero_copy_only=False) for n in names])
                yield pa.RecordBatch.from_pydict({"_order": [part["_order"].to_numpy().tobytes()], "y": [y.tobytes()], "b": [x.tobytes()]}, schema=schema)

    names = [f"y_{t}" for t in range(len(labels))]
    step = max(1, BLOCK_BYTES // (8 + 8 * len(labels) + len(features)))
    schema = pa.schema([("_order", pa.binary()), ("y", pa.binary()), ("b", pa.binary())])
    columns = [F.col(c).cast("double").alias(f"x_{k}") for k, c in enumerate(features)]
    told = frame.select("_order", *columns, *[y.cast("double").alias(n) for y, n in zip(labels, names, strict=True)])
    return staged(told.mapInArrow(run, "_order binary, y binary, b binary"), "binned")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The arrays of some blocks together, STEP rows or a little more."""
    held: list[tuple] = []

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate(v, axis=-1) for v in zip(*held, strict=True))

    for batch in batches:
        for order, y, b in zip(*(batch[n] for n in ("_order", "y", "b")), strict=True):
            order = np.frombuffer(order.as_buffer(), np.int64)
            held.append((order, np.frombuffer(y.as_buffer()).reshape(-1, len(order)), np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, len(order))))
            if sum(len(h[0]) for h in held) >= STEP:
                yield joined()
                held = []
    if held:
        yield joined()


def _bytes(x: np.ndarray) -> pa.Array:
    """A binary value a row."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(b: pa.Array) -> np.ndarray:
    """The inverse: (rows, features)."""
    offsets = np.frombuffer(b.buffers()[1], np.int32)[b.offset : b.offset + len(b) + 1]
    return np.frombuffer(b.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(b), -1)


# splits


def descend(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The leaf of each row of x (rows, features): right where a value is over its node's cut."""
    at, live = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(live):
        node = at[live]
        f = feature[node]
        inner = f >= 0
        live, node, f = live[inner], node[inner], f[inner]
        at[live] = left[node] + (x[live, f] > cut[node])
    return at


def routed(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, x: np.ndarray) -> dict[int, np.ndarray]:
    """By leaf of a small tree, the rows of x (features, rows) that fall into it."""
    out, open_ = {}, [(0, np.arange(x.shape[1]))]
    while open_:
        node, rows = open_.pop()
        if feature[node] < 0:
            out[node] = rows
        else:
            over = x[feature[node]][rows] > cut[node]
            open_ += [(left[node], rows[~over]), (left[node] + 1, rows[over])]
    return out


def histogram(node: np.ndarray, b: np.ndarray, y: np.ndarray, nodes: int, bins: int, classes: int) -> np.ndarray:
    """(nodes, bins, classes): rows by class; for numbers (nodes, bins, 2): rows and their sum."""
    cell = node * bins + b
    if classes:
        return np.bincount(cell * classes + y, minlength=nodes * bins * classes).reshape(nodes, bins, classes)
    return np.stack([np.bincount(cell, minlength=nodes * bins), np.bincount(cell, y, nodes * bins)], axis=-1).reshape(nodes, bins, 2)


def best_cuts(found: np.ndarray, classes: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """From histograms, by node: the gain of the best cut (impurity times rows; -inf without one) and its bin, the last that goes left."""
    low = np.cumsum(found, axis=1, dtype=np.float64)
    all_ = low[:, -1:]
    n, total = (low.sum(-1), all_.sum(-1)) if classes else (low[..., 0], all_[..., 0])
    square = (lambda x: np.einsum("abc,abc->ab", x, x)) if classes else (lambda x: x[..., 1] ** 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = square(low) / n + square(all_ - low) / (total - n) - square(all_) / total
    gain[(n < least) | (total - n < least)] = -np.inf
    k = gain.argmax(1)
    return gain[np.arange(len(k)), k], k


def sorted_cuts(node: np.ndarray, b: np.ndarray, y: np.ndarray, counts: np.ndarray, classes: int, least: int, alike: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The same where nodes hold few rows: over rows in the order of (node, bin), so that no cell without rows is looked at. alike: how many rows of its node have a row's class.

    A class's k-th row adds 2k - 1 to the sum of squared class counts; that of the right side follows from the left one's and from the sums of `alike`.
    """
    order = np.argsort(b, kind="stable")
    order = order[np.argsort(node[order], kind="stable")]
    at, bins = node[order], b[order]
    start = np.cumsum(counts) - counts
    n = np.arange(1, len(at) + 1) - start[at]
    right = counts[at] - n

    def running(x: np.ndarray) -> np.ndarray:
        upto = np.cumsum(x)
        return upto - (upto - x)[start][at]

    if classes:
        of_class = order[np.argsort(y[order], kind="stable")]
        of_class = of_class[np.argsort(node[of_class], kind="stable")]
        new = np.ones(len(at), bool)
        new[1:] = (node[of_class[1:]] != node[of_class[:-1]]) | (y[of_class[1:]] != y[of_class[:-1]])
        first = np.flatnonzero(new)
        rank = np.empty(len(at), np.int64)
        rank[of_class] = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        low, shared = running(2 * rank[order] + 1), running(alike[order])
        whole = shared[start + counts - 1][at]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low / n + (whole - 2 * shared + low) / right - whole / counts[at]
    else:
        low = running(y[order])
        all_ = low[start + counts - 1][at]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low**2 / n + (all_ - low) ** 2 / right - all_**2 / counts[at]
    ok = (n >= least) & (right >= least)
    ok[:-1] &= bins[1:] != bins[:-1]
    gain = np.where(ok, gain, -np.inf)
    best = np.maximum.reduceat(gain, start)
    hit = np.flatnonzero(ok & (gain == best[at]))
    nodes, first = np.unique(at[hit], return_index=True)
    cut = np.zeros(len(counts), np.int64)
    cut[nodes] = bins[hit[first]]
    return best, cut


def grow(x: np.ndarray, y: np.ndarray, classes: int, root: np.ndarray, depth: np.ndarray, *, deepest: int, least: int, bins: int, scale: float) -> tuple[np.ndarray, ...]:
    """Subtrees of some nodes: feature, cut, left and count by node, the roots first. x (rows, features) of bins, root: the place of each row's root in depth."""
    feature, cut, left = [np.full(len(depth), -1)], [np.zeros(len(depth), np.int64)], [np.zeros(len(depth), np.int64)]
    count = [np.bincount(root, minlength=len(depth))]
    made = len(depth)
    columns = [c for c in range(x.shape[1]) if len(x) and (x[:, c] != x[0, c]).any()]
    x = {c: np.ascontiguousarray(x[:, c]) for c in columns}
    node, size, base = root, count[0], 0  # places and rows of the last level's nodes, and the number of its first
    while len(node) and columns:
        keep = (depth < deepest) & (size >= 2 * least)
        if classes:
            y = y.astype(np.int64)
        if not keep.all():
            rows = keep[node]
            y, node, x = y[rows], node[rows], {c: v[rows] for c, v in x.items()}
        if not len(node):
            break
        ids, size = np.flatnonzero(keep), size[keep]
        dense = np.cumsum(keep) - 1
        node = dense[node].astype(np.uint16 if len(ids) < 1 << 16 else np.int64)
        wide = node.astype(np.int64)
        label, alike = y, None
        by_cells = len(ids) * bins * max(classes, 2) <= 4 * len(node)
        if not classes:
            label = y - (np.bincount(wide, y, len(ids)) / size)[wide]
        elif not by_cells:
            code = y.astype(np.uint16 if classes < 1 << 16 else np.int64)
            order = np.argsort(code, kind="stable")
            order = order[np.argsort(node[order], kind="stable")]
            new = np.append(True, (node[order[1:]] != node[order[:-1]]) | (code[order[1:]] != code[order[:-1]]))
            sizes = np.diff(np.append(np.flatnonzero(new), len(order)))
            alike = np.empty(len(order), np.int64)
            alike[order] = np.repeat(sizes, sizes)
            label = code
        best, of, at = np.full(len(ids), -np.inf), np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        for c in columns:
            gain, k = best_cuts(histogram(wide, x[c], label, len(ids), bins, classes), classes, least) if by_cells else sorted_cuts(node, x[c], label, size, classes, least, alike)
            better = gain > best
            best[better], of[better], at[better] = gain[better], c, k[better]
        split = best > size * (1e-9 if classes else (1e-10 * scale) ** 2)
        if not split.any():
            break
        child = np.cumsum(split) - 1
        for k, c, v in ((feature, of, -1), (cut, at, 0), (left, made + 2 * child, 0)):
            k[-1][ids] = np.where(split, c, v)
        rows = split[wide]
        y, wide, x = y[rows], wide[rows], {c: v[rows] for c, v in x.items()}
        over = np.zeros(len(wide), bool)
        for c in columns:
            mine = of[wide] == c
            over[mine] = x[c][mine] > at[wide[mine]]
        node = 2 * child[wide] + over
        n = 2 * int(split.sum())
        size = np.bincount(node, minlength=n)
        depth = np.repeat(depth[ids][split] + 1, 2)
        feature.append(np.full(n, -1))
        cut.append(np.zeros(n, np.int64))
        left.append(np.zeros(n, np.int64))
        count.append(size)
        made += n
    return tuple(np.concatenate(v) for v in (feature, cut, left, count))


# all rows


def _sums(data: DataFrame, targets: list[Target], trees: list[Nodes], large: list[list[int]], bins: int, least: int) -> list:
    """The best cut of each feature for each of the nodes named: t, node, feature, gain, bin, rows and label sum to the left."""
    tops = [tuple(np.array(v) for v in (n.feature, n.cut, n.left)) for n in trees]
    means = [n.mean for n in trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(nodes), target.features, bins, target.classes or 2)) for nodes, target in zip(large, targets, strict=True)]
        for _, labels, x in _blocks(batches):
            for t, target in enumerate(targets):
                rows_of = routed(*tops[t], x) if large[t] else {}
                known = ~np.isnan(labels[target.i])
                for k, node in enumerate(large[t]):
                    rows = rows_of[node]
                    rows = rows if known.all() else rows[known[rows]]
                    y = labels[target.i][rows]
                    y = y.astype(np.int64) if target.classes else y - means[t][node]
                    for f in range(target.features):
                        held[t][k, f] += histogram(0, x[f][rows].astype(np.int64), y, 1, bins, target.classes)[0]
        for t, found in enumerate(held):
            for k, node in enumerate(large[t]):
                for f in range(targets[t].features):
                    kind = np.int64 if targets[t].classes else np.float64
                    yield pa.RecordBatch.from_pydict({"t": [t], "node": [node], "f": [f], "sums": [found[k, f].astype(kind).tobytes()]}, schema=schema)

    def add(group: pa.Table) -> pa.Table:
        t, node, f = (group[c][0].as_py() for c in ("t", "node", "f"))
        classes = targets[t].classes
        kind = np.int64 if classes else np.float64
        total = sum(np.frombuffer(s, kind) for s in sorted(group["sums"].to_pylist())).reshape(1, bins, -1)  # in an order of their own, not the tasks'
        gain, k = best_cuts(total, classes, least)
        low = total[0, : int(k[0]) + 1].sum(0)
        n, s = (int(low.sum()), 0.0) if classes else (round(low[0]), float(low[1]))
        return pa.table({"t": [t], "node": [node], "f": [f], "gain": [float(gain[0])], "k": [int(k[0])], "n": [n], "s": [s]}, schema=result)

    schema = pa.schema([("t", pa.int32()), ("node", pa.int32()), ("f", pa.int32()), ("sums", pa.binary())])
    result = pa.schema([("t", pa.int32()), ("node", pa.int32()), ("f", pa.int32()), ("gain", pa.float64()), ("k", pa.int32()), ("n", pa.int64()), ("s", pa.float64())])
    tasks = 2 * data.sparkSession.sparkContext.defaultParallelism
    sums = data.coalesce(tasks).mapInArrow(run, "t int, node int, f int, sums binary")
    return sums.groupBy("t", "node", "f").applyInArrow(add, "t int, node int, f int, gain double, k int, n long, s double").collect()  # a row a feature of each large node


def grow_trees(data: DataFrame, targets: list[Target], *, deepest: int, least: int, bins: int) -> list[Nodes]:
    """The trees of all targets over a binned table."""
    out = []
    for s in range(0, len(targets), TOGETHER):
        out += _grow_some(data, targets[s : s + TOGETHER], deepest, least, bins)
    return out


def _grow_some(data: DataFrame, targets: list[Target], deepest: int, least: int, bins: int) -> list[Nodes]:
    trees = [Nodes(count=[t.rows], mean=[t.mean]) for t in targets]
    open_ = [[0] for _ in targets]
    below: list[list[int]] = [[] for _ in targets]
    while True:
        large = []
        for t, (target, tree) in enumerate(zip(targets, trees, strict=True)):
            ready = [k for k in open_[t] if tree.depth[k] < deepest and tree.count[k] >= 2 * least]
            below[t] += [k for k in ready if tree.count[k] <= LOCAL_ROWS]
            open_[t] = [k for k in ready if tree.count[k] > LOCAL_ROWS]
            fit = max(1, HISTOGRAM_BYTES // (8 * bins * max(target.classes, 2) * target.features))
            large.append(open_[t][:fit])
            open_[t] = open_[t][fit:]
        if not any(large):
            break
        best: dict[tuple[int, int], tuple] = {}
        for r in _sums(data, targets, trees, large, bins, least):
            if (r.t, r.node) not in best or (r.gain, -r.f) > best[r.t, r.node][:2]:
                best[r.t, r.node] = (r.gain, -r.f, r.k, r.n, r.s)
        for (t, node), (gain, f, k, n, s) in sorted(best.items()):
            tree, target = trees[t], targets[t]
            if gain > tree.count[node] * (1e-9 if target.classes else (1e-10 * target.scale) ** 2):
                mean = tree.mean[node]
                open_[t] += tree.split(node, -f, k, n, mean + s / n, mean - s / (tree.count[node] - n))
    _grow_below(data, targets, trees, below, deepest, least, bins)
    return trees


def _grow_below(data: DataFrame, targets: list[Target], trees: list[Nodes], below: list[list[int]], deepest: int, least: int, bins: int) -> None:
    """Grow the nodes named; those of a bucket are of one tree and together hold LOCAL_ROWS rows at most."""
    total = sum(tree.count[k] for tree, nodes in zip(trees, below, strict=True) for k in nodes)
    most = min(LOCAL_ROWS, max(LOCAL_ROWS // 8, total // (8 * data.sparkSession.sparkContext.defaultParallelism)))
    of_bucket: list[int] = []
    buckets = [np.full(len(tree.feature), -1) for tree in trees]
    for t, (tree, nodes) in enumerate(zip(trees, below, strict=True)):
        held = most
        for k in nodes:
            if held + tree.count[k] > most:
                of_bucket.append(t)
                held = 0
            held += tree.count[k]
            buckets[t][k] = len(of_bucket) - 1
    if not of_bucket:
        return
    tops = [tuple(np.array(v) for v in (n.feature, n.cut, n.left)) for n in trees]
    depths = [np.array(n.depth) for n in trees]
    parts = ("bucket", "node", "_order", "y", "b")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for order, labels, x in _blocks(batches):
            for t, target in enumerate(targets):
                rows_of = routed(*tops[t], x)
                known = ~np.isnan(labels[target.i])
                for node, rows in rows_of.items():
                    if (bucket := buckets[t][node]) >= 0:
                        rows = rows if known.all() else rows[known[rows]]
                        same = lambda k, n=len(rows): pa.array(np.full(n, k, np.int32))
                        yield pa.RecordBatch.from_arrays([same(bucket), same(node), pa.array(order[rows]), pa.array(labels[target.i][rows]), _bytes(x[: target.features, rows].T)], names=list(parts))

    def train(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        bucket = group["bucket"][0].as_py()
        target = targets[of_bucket[bucket]]
        x = np.concatenate([_matrix(c) for c in group["b"].chunks])
        order, y, node = (group[c].to_numpy() for c in ("_order", "y", "node"))
        order = np.argsort(order, kind="stable")
        roots, at = np.unique(node[order], return_inverse=True)
        y = y[order].astype(np.int64) if target.classes else y[order]
        made = grow(x[order], y, target.classes, at, depths[of_bucket[bucket]][roots], deepest=deepest, least=least, bins=bins, scale=target.scale)
        packed = {n: [v.astype(k).tobytes()] for n, v, k in zip(("roots", "feature", "cut", "left", "count"), (roots, *made), _KINDS, strict=True)}
        return pa.table({"bucket": pa.array([bucket], pa.int32()), **{n: pa.array(v, pa.binary()) for n, v in packed.items()}})

    dealt = data.mapInArrow(deal, "bucket int, node int, _order long, y double, b binary")
    made = dealt.groupBy("bucket").applyInArrow(train, "bucket int, roots binary, feature binary, cut binary, left binary, count binary")
    pieces: list[list[tuple]] = [[] for _ in trees]
    sizes = [len(tree.feature) for tree in trees]
    for r in sorted(made.collect(), key=lambda r: r.bucket):  # the trees: 2**(depth + 1) nodes each at most, 15 bytes a node
        t = of_bucket[r.bucket]
        tree = trees[t]
        roots, feature, cut, left, count = (np.frombuffer(v, k) for v, k in zip((r["roots"], r["feature"], r["cut"], r["left"], r["count"]), _KINDS, strict=True))
        n = len(roots)
        left = np.where(feature >= 0, left - n + sizes[t], 0)
        for k, node in enumerate(roots.tolist()):
            tree.feature[node], tree.cut[node], tree.left[node] = int(feature[k]), int(cut[k]), int(left[k])
        pieces[t].append((feature[n:], cut[n:], left[n:], count[n:]))
        sizes[t] += len(feature) - n
    for tree, own in zip(trees, pieces, strict=True):
        tree.feature, tree.cut, tree.left, tree.count = (np.concatenate([np.array(top, np.int64), *below]) for top, below in zip((tree.feature, tree.cut, tree.left, tree.count), list(zip(*own, strict=True)) or [()] * 4, strict=True))


_KINDS = (np.int32, np.int16, np.uint8, np.int32, np.int32)


def node_table(spark, tree: Nodes, cuts: list[np.ndarray]) -> DataFrame:
    """(node, feature, cut, left, first, size) as a written table: feature -1 for a leaf; first, size: the span of places of a node's rows."""
    feature, k, left, size = (np.array(v, np.int64) for v in (tree.feature, tree.cut, tree.left, tree.count))
    inner = feature >= 0
    cut, first = np.zeros(len(feature)), np.zeros(len(feature), np.int64)
    starts = np.cumsum([0, *map(len, cuts)])
    cut[inner] = np.concatenate(cuts)[starts[feature[inner]] + k[inner]] if inner.any() else 0.0
    level = np.zeros(1, np.int64)
    while len(level := level[feature[level] >= 0]):
        below = left[level]
        first[below], first[below + 1] = first[level], first[level] + size[below]
        level = np.concatenate([below, below + 1])
    table = pa.table({"node": np.arange(len(feature), dtype=np.int32), "feature": feature.astype(np.int32), "cut": cut, "left": left.astype(np.int32), "first": first, "size": size})
    return staged(spark.createDataFrame(table), "tree")


def placing(tree: DataFrame) -> Callable[[SparkColumn, list[str]], SparkColumn]:
    """From a share in [0, 1) and the features, a place in the span of the leaf that a row falls into."""
    spark = tree.sparkSession
    nodes = tree.toArrow().sort_by("node")  # as many as a tree may have
    sent = spark.sparkContext.broadcast({c: nodes[c].to_numpy() for c in ("feature", "cut", "left", "first", "size")})

    @F.arrow_udf("long")
    def place(told: pa.Array) -> pa.Array:
        t = sent.value
        x = told.flatten().to_numpy().reshape(len(told), -1)
        at = descend(t["feature"], t["cut"], t["left"], x[:, 1:])
        return pa.array(t["first"][at] + np.minimum((x[:, 0] * t["size"][at]).astype(np.int64), t["size"][at] - 1))

    return lambda share, features: place(F.array(share, *[F.col(c).cast("double") for c in features]))

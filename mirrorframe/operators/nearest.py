"""Exact nearest-neighbour join of mixed rows by space partitioning.

Rows have numbers (`x`) and hashed categories (`c`); the squared distance is that of the numbers plus 2 for every category that differs. A k-d tree over a bounded
sample of the known rows cuts space at medians, each time along the number or category that adds most to the distance of two rows; its leaves are cells. Every query meets its own cell,
and then only those cells whose bounds (ranges of numbers and of category hashes over all known rows) are nearer than the best so far. The sample shapes the cells; results are exact whatever it holds.

Both rounds are joins by (cell, part): queries of a crowded cell are dealt into parts, so that a task holds one cell's known rows and a bounded number of queries.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorframe.plans.stages import ship, staged

#: Known rows of a cell, as long as cells are fewer than the most; rows of the sample that the tree is built from; queries of a part.
CELL_ROWS, MOST_CELLS, TREE_ROWS, PART_ROWS = 2048, 4096, 100_000, 20_000
#: Rows of each side that are compared in one step.
STEP = 512


class CellTree:
    """A k-d tree over numbers and category hashes whose leaves are cells. Nodes: the place compared (numbers first, then categories; -1 in a leaf), where it is cut, children, and the cell of a leaf."""

    def __init__(self, x: np.ndarray, c: np.ndarray, cells: int):
        self.n_x = x.shape[1]
        place, cut_x, cut_c, child = [-1], [0.0], [0], [(0, 0)]
        heap = [(-len(x), 0, np.arange(len(x)))]
        leaves = 1
        while heap and leaves < cells:
            _, node, rows = heapq.heappop(heap)
            best = self._cut(x[rows], c[rows])
            if best is None:
                continue
            at, cut = best
            low = x[rows, at] <= cut if at < self.n_x else c[rows, at - self.n_x] <= cut
            place[node], child[node] = at, (len(place), len(place) + 1)
            cut_x[node], cut_c[node] = (cut, 0) if at < self.n_x else (0.0, cut)
            for side in (rows[low], rows[~low]):
                heapq.heappush(heap, (-len(side), len(place), side))
                place.append(-1)
                cut_x.append(0.0)
                cut_c.append(0)
                child.append((0, 0))
            leaves += 1
        self.place, self.cut_x, self.cut_c, self.child = np.array(place), np.array(cut_x), np.array(cut_c, np.int64), np.array(child)
        self.cell = np.where(self.place < 0, np.cumsum(self.place < 0) - 1, -1)
        self.cells = leaves

    @staticmethod
    def _cut(x: np.ndarray, c: np.ndarray) -> tuple[int, float | int] | None:
        """The place that two rows differ in most, and a value near its median with rows on both sides."""
        if len(x) < 2:
            return None
        spread = list(2 * x.var(axis=0))
        for k in range(c.shape[1]):
            share = np.unique(c[:, k], return_counts=True)[1] / len(c)
            spread.append(2 * (1 - (share * share).sum()))
        if not spread or max(spread) <= 0:
            return None
        at = int(np.argmax(spread))
        values = np.sort(x[:, at] if at < x.shape[1] else c[:, at - x.shape[1]])
        below = values[values < values[-1]]
        if not len(below):
            return None
        return at, min(values[len(values) // 2], below[-1]).item()

    def find(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[self.place[node[rows]] >= 0]
            at = self.place[node[rows]]
            low = np.zeros(len(rows), bool)
            number = at < self.n_x
            low[number] = x[rows[number], at[number]] <= self.cut_x[node[rows[number]]]
            low[~number] = c[rows[~number], at[~number] - self.n_x] <= self.cut_c[node[rows[~number]]]
            node[rows] = np.where(low, self.child[node[rows], 0], self.child[node[rows], 1])
        return self.cell[node]

    def bound(self, cells: np.ndarray, x_low: np.ndarray, x_high: np.ndarray, c_low: np.ndarray, c_high: np.ndarray) -> None:
        """Set the ranges of the cells that have rows; those of a node cover its children's, and a cell without rows is infinitely far."""
        leaf = np.flatnonzero(self.place < 0)[cells]
        self.x_low, self.x_high = np.full((len(self.place), x_low.shape[1]), np.inf), np.full((len(self.place), x_low.shape[1]), -np.inf)
        top, bottom = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        self.c_low, self.c_high = np.full((len(self.place), c_low.shape[1]), top), np.full((len(self.place), c_low.shape[1]), bottom)
        self.used = np.zeros(len(self.place), bool)
        self.x_low[leaf], self.x_high[leaf], self.c_low[leaf], self.c_high[leaf], self.used[leaf] = x_low, x_high, c_low, c_high, True
        for node in np.flatnonzero(self.place >= 0)[::-1]:
            pair = self.child[node]
            self.x_low[node], self.x_high[node] = self.x_low[pair].min(axis=0), self.x_high[pair].max(axis=0)
            self.c_low[node], self.c_high[node] = self.c_low[pair].min(axis=0), self.c_high[pair].max(axis=0)
            self.used[node] = self.used[pair].any()

    def nearer(self, x: np.ndarray, c: np.ndarray, best: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell but a row's own that may hold a row at less than the squared distance `best`."""
        rows, nodes = np.arange(len(x)), np.zeros(len(x), np.int64)
        out_rows, out_cells = [], []
        while len(rows):
            keep = self.used[nodes]
            rows, nodes = rows[keep], nodes[keep]
            away = np.maximum(np.maximum(self.x_low[nodes] - x[rows], x[rows] - self.x_high[nodes]), 0)
            gap = (away * away).sum(axis=1) + 2 * ((c[rows] < self.c_low[nodes]) | (c[rows] > self.c_high[nodes])).sum(axis=1)
            keep = gap < best[rows]
            rows, nodes = rows[keep], nodes[keep]
            leaf = self.place[nodes] < 0
            out_rows.append(rows[leaf])
            out_cells.append(self.cell[nodes[leaf]])
            rows, nodes = np.repeat(rows[~leaf], 2), self.child[nodes[~leaf]].ravel()
        r, cells = np.concatenate(out_rows or [rows]), np.concatenate(out_cells or [nodes])
        other = cells != home[r]
        return r[other], cells[other]


def _matrix(values: pa.Array | pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return np.asarray(values.flatten(), kind).reshape(-1, width) if width else np.zeros((len(values), 0), kind)


def least_distances(x: np.ndarray, c: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Squared distance of each row of (y, d) to the closest row of (x, c)."""
    out = np.full(len(y), np.inf)
    for s in range(0, len(y), STEP):
        q, e = y[s : s + STEP], d[s : s + STEP]
        for k in range(0, len(x), 8 * STEP):
            p, f = x[k : k + 8 * STEP], c[k : k + 8 * STEP]
            gap = (q * q).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * q @ p.T
            for i in range(c.shape[1]):
                gap += 2 * (e[:, i][:, None] != f[:, i][None, :])
            near = gap.argmin(axis=1)
            # The expanded square loses digits near 0: the winner's is taken again
            own = ((q - p[near]) ** 2).sum(axis=1) + 2 * (e != f[near]).sum(axis=1)
            out[s : s + STEP] = np.minimum(out[s : s + STEP], own)
    return out


def nearest(known: DataFrame, queries: DataFrame, n_x: int, n_c: int) -> DataFrame:
    """known: x (array of double), c (array of bigint), at least one row. queries: id (unique), x, c. (id, distance, cells): the distance to the closest known row, and how many cells were met."""
    ship(known.sparkSession)
    n = known.count()
    cells = min(MOST_CELLS, -(-n // CELL_ROWS))
    every = -(-n // TREE_ROWS)
    shape = (known.filter(F.pmod(F.xxhash64("x", "c"), F.lit(every)) == 0) if cells > 1 else known.limit(1)).select("x", "c").toArrow()
    tree = CellTree(_matrix(shape.column("x"), n_x, float), _matrix(shape.column("c"), n_c, np.int64), cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tree.find(_matrix(batch.column("x"), n_x, float), _matrix(batch.column("c"), n_c, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "cell"])

    known = staged(known.select("x", "c").mapInArrow(place, "x array<double>, c array<bigint>, cell long"), "near-known")
    queries = staged(queries.select("id", "x", "c").mapInArrow(place, "id long, x array<double>, c array<bigint>, cell long"), "near-queries")
    ends = lambda f, name, width: F.array(*[f(F.col(name)[i]) for i in range(width)])
    # A row a cell, at most MOST_CELLS
    boxes = known.groupBy("cell").agg(ends(F.min, "x", n_x).cast("array<double>").alias("xl"), ends(F.max, "x", n_x).cast("array<double>").alias("xh"), ends(F.min, "c", n_c).cast("array<bigint>").alias("cl"), ends(F.max, "c", n_c).cast("array<bigint>").alias("ch")).toArrow()
    tree.bound(boxes.column("cell").to_numpy(), *(_matrix(boxes.column(k), n_x, float) for k in ("xl", "xh")), *(_matrix(boxes.column(k), n_c, np.int64) for k in ("cl", "ch")))

    def met(asked: DataFrame) -> DataFrame:
        """asked: id, x, c, cell. (id, best): the least squared distance in that cell."""
        parts = F.broadcast(staged(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts")), "near-parts"))  # at most MOST_CELLS rows
        part: Column = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
        left = known.join(parts, "cell").select("cell", part, "x", "c")
        right = asked.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").alias("part"), "id", "x", "c")

        def compare(a: pa.Table, b: pa.Table) -> pa.Table:
            sides = [_matrix(t.column(k), w, kind) for t in (a, b) for k, w, kind in (("x", n_x, float), ("c", n_c, np.int64))]
            return pa.table({"id": b.column("id"), "best": least_distances(*sides)})

        return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInArrow(compare, "id long, best double")

    first = staged(queries.join(met(queries), "id", "left").select("id", "x", "c", "cell", F.coalesce("best", F.lit(float("inf"))).alias("best")), "near-first")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, STEP):
                part = batch.slice(s, STEP)
                x, c = _matrix(part.column("x"), n_x, float), _matrix(part.column("c"), n_c, np.int64)
                rows, found = tree.nearer(x, c, part.column("best").to_numpy(), part.column("cell").to_numpy())
                asked = part.select(["id", "x", "c"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(found)], names=["id", "x", "c", "cell"])

    asked = staged(first.mapInArrow(ask, "id long, x array<double>, c array<bigint>, cell long"), "near-asked")
    second = met(asked).groupBy("id").agg(F.min("best").alias("closer"), F.count(F.lit(1)).alias("more"))
    return first.select("id", "best").join(second, "id", "left").select("id", F.sqrt(F.least("best", F.coalesce("closer", "best"))).alias("distance"), (F.coalesce("more", F.lit(0)) + 1).alias("cells"))

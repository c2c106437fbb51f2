"""Correlations of many columns by a blocked Gram pass.

A task gathers, for every pair of column blocks, what products of matrices give over the rows where both columns are finite: counts, sums, and sums of squares and products of the values less a pivot of the
task's own. It leaves co-moments about means, which merge exactly by pairs (Chan's rule); those of a pair of blocks are merged in two steps, some tasks' at a time. The
plan has no expression a pair, and one row a task and pair of blocks moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.plans.stages import ship

#: Columns of a block, rows of a step, and parts that the tasks' results are first merged in.
BLOCK, STEP, PARTS = 64, 4096, 64
#: Relative deviations that count as none.
ROUNDING = 1e-13
#: Counts, means of both sides, squared deviations of both, and products of deviations.
KINDS = 6
_STATS = "i long, j long, part long, stats binary"


def moments(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Sums over rows of all pairs of columns of x and y less their pivots, where both are finite: KINDS matrices."""
    mx, my = np.isfinite(x), np.isfinite(y)
    a, b = np.where(mx, x - px, 0.0), np.where(my, y - py, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    return np.stack([mx.T @ my, a.T @ my, mx.T @ b, (a * a).T @ my, mx.T @ (b * b), a.T @ b])


def centred(s: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Sums about pivots as co-moments about means."""
    n = np.maximum(s[0], 1)
    return np.stack([s[0], px[:, None] + s[1] / n, py[None, :] + s[2] / n, s[3] - s[1] * s[1] / n, s[4] - s[2] * s[2] / n, s[5] - s[1] * s[2] / n])


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Co-moments of two sets of rows together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / np.maximum(n, 1)
    return np.stack([n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def _merge(t: pa.Table) -> np.ndarray:
    """Of one pair of blocks, in the order of the rows' bytes, so that reruns agree."""
    out = None
    for x in sorted(t.column("stats").to_pylist()):
        head = np.frombuffer(x[:16], np.int64)
        own = np.frombuffer(x[16:], float).reshape(KINDS, *head)
        out = own if out is None else merged(out, own)
    return out


def _bytes(x: np.ndarray) -> bytes:
    return np.array(x.shape[1:], np.int64).tobytes() + np.ascontiguousarray(x).tobytes()


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, score) for every pair of columns in their order: the absolute correlation over the rows where both are finite; 0 where either is constant there, or of fewer than 2 rows."""
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, score double")
    ship(df.sparkSession)
    blocks = [slice(k, min(k + BLOCK, len(columns))) for k in range(0, len(columns), BLOCK)]
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, sums = None, None
        for batch in batches:
            for s in range(0, batch.num_rows, STEP):
                x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.slice(s, STEP).columns], axis=1)
                if pivot is None:
                    known = np.isfinite(x)
                    pivot = np.where(known, x, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
                    sums = [0.0] * len(pairs)
                for k, (i, j) in enumerate(pairs):
                    sums[k] = sums[k] + moments(x[:, blocks[i]], x[:, blocks[j]], pivot[blocks[i]], pivot[blocks[j]])
        if pivot is not None:
            stats = [_bytes(centred(s, pivot[blocks[i]], pivot[blocks[j]])) for s, (i, j) in zip(sums, pairs, strict=True)]
            part = int(np.frombuffer(stats[0][16:24], np.uint64)[0] ^ np.abs(pivot).sum().view(np.uint64)) % PARTS
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs]), pa.array([j for _, j in pairs]), pa.array([part] * len(pairs)), pa.array(stats, pa.binary())], names=["i", "j", "part", "stats"])

    def some(t: pa.Table) -> pa.Table:
        return pa.table({"i": t.column("i").slice(0, 1), "j": t.column("j").slice(0, 1), "part": t.column("part").slice(0, 1), "stats": pa.array([_bytes(_merge(t))], pa.binary())})

    def score(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        n, x, y, xx, yy, xy = _merge(t)
        with np.errstate(divide="ignore", invalid="ignore"):
            # Deviations of a constant are rounding errors of its mean
            flat = (n < 2) | (xx <= n * (ROUNDING * x) ** 2) | (yy <= n * (ROUNDING * y) ** 2)
            r = np.where(flat, 0.0, np.abs(xy / np.sqrt(xx * yy)))
        p, q = np.meshgrid(np.arange(len(columns))[blocks[i]], np.arange(len(columns))[blocks[j]], indexing="ij")
        upper = p < q
        names = np.array(columns, object)
        return pa.table({"a": pa.array(names[p[upper]], pa.string()), "b": pa.array(names[q[upper]], pa.string()), "score": pa.array(np.nan_to_num(r[upper]))})

    values = df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"c{k}") for k, c in enumerate(columns)])
    first = values.mapInArrow(run, _STATS).groupBy("i", "j", "part").applyInArrow(some, _STATS)
    found = first.groupBy("i", "j").applyInArrow(score, "a string, b string, score double")
    # A table without rows has no block either; pairs of columns, not rows
    p, q = np.triu_indices(len(columns), 1)
    every = df.sparkSession.createDataFrame(pa.table({"a": pa.array(np.array(columns, object)[p]), "b": pa.array(np.array(columns, object)[q])}))
    return every.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"))

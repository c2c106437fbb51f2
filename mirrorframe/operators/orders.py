"""Which of many columns never exceed which others: a matrix of violations for all pairs in one pass.

A task compares columns of a block of rows with all columns that they haven't exceeded yet; a pair that is broken once is not looked at again, so that work falls to the pairs that hold. Tasks
leave the matrices as bits, which are or-ed by row of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.plans.stages import ship

#: Rows compared at once.
STEP = 1024


def compare_rows(x: np.ndarray, known: np.ndarray, broken: np.ndarray, met: np.ndarray) -> None:
    """Set broken[a, b] where a row has a > b, and met[a, b] where a row has both; met is kept for unbroken pairs alone."""
    for a in range(x.shape[1]):
        others = np.flatnonzero(~broken[a])
        if len(others):
            both = known[:, a, None] & known[:, others]
            broken[a, others] = (both & (x[:, a, None] > x[:, others])).any(axis=0)
            met[a, others] |= both.any(axis=0)


def _words(bits: np.ndarray) -> np.ndarray:
    wide = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64)))
    return np.packbits(wide, axis=1, bitorder="little").view(np.int64)


def orders(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(broken, met) over columns of one type, integers or datetimes: whether a > b in any row, and, for unbroken pairs, whether any row has both."""
    ship(df.sparkSession)
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        broken, met = np.eye(d, dtype=bool), np.zeros((d, d), bool)
        for batch in batches:
            for s in range(0, batch.num_rows, STEP):
                if broken.all():
                    break
                part = batch.slice(s, STEP)
                known = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns], axis=1)
                narrow = [c.cast(pa.int32()) if pa.types.is_date32(c.type) else c for c in part.columns]
                values = np.stack([c.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in narrow], axis=1)
                compare_rows(values, known, broken, met)
        bits = _words(broken), _words(met)
        a, w = np.divmod(np.arange(bits[0].size), bits[0].shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(w), *(pa.array(x.ravel()) for x in bits)], names=["a", "w", "broken", "met"])

    rows = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]).mapInArrow(run, "a long, w long, broken long, met long")
    out = np.zeros((2, d, -(-d // 64)), np.int64)
    for r in rows.groupBy("a", "w").agg(F.bit_or("broken").alias("broken"), F.bit_or("met").alias("met")).collect():  # words of the matrices
        out[:, r.a, r.w] = r.broken, r.met
    broken, met = (np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")[:, :d].astype(bool) for x in out)
    return broken, met

"""Orders between all pairs of columns, against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest

from mirrorframe.operators import orders as O
from mirrorframe.operators import quality as Q
from mirrorframe.operators import repair as R
from mirrorframe.plans.model import Column, ColumnType


def table(rng, d, n):
    """Chains of columns in order with some nulls, pairs that break in one row, and pairs that never meet."""
    rows = []
    for k in range(n):
        base = [rng.randint(0, 9) for _ in range(d)]
        for i in range(0, d - 2, 3):
            base[i + 1] = base[i] + rng.randint(0, 2)
            base[i + 2] = base[i + 1] - (k == n // 2 and i == 3)
        row = [None if rng.random() < 0.1 else v for v in base]
        row[-1], row[-2] = (None, row[-2]) if k % 2 else (row[-1], None)
        rows.append(tuple(row))
    return rows


def plain(rows, a, b):
    both = [(r[a], r[b]) for r in rows if r[a] is not None and r[b] is not None]
    return bool(both) and all(x <= y for x, y in both)


@pytest.mark.parametrize("d", [10, 70])
def test_always_of_many_pairs(spark, d, monkeypatch):
    monkeypatch.setattr(O, "STEP", 40)
    rows = table(random.Random(d), d, 300)
    names = [f"num {k}" for k in range(d)]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` long" for n in names)).repartition(5)
    pairs = [(a, b) for a in names for b in names if a != b]
    assert len(pairs) > R.WIDE
    want = [plain(rows, i, j) for i in range(d) for j in range(d) if i != j]
    assert R.always(df, pairs) == want and any(want) and not all(want)
    assert not any(R.always(df.limit(0), pairs))
    if d == 10:
        bounds = R.count_bounds(df.toDF(*[f"num_{k}" for k in range(d)]), [Column(f"num_{k}", ColumnType.NUMERIC) for k in range(d)])
        assert bounds == [(f"num_{a[4:]}", f"num_{b[4:]}") for (a, b), held in zip(pairs, want, strict=True) if held]


def test_datetimes(spark):
    start = dt.datetime(2024, 1, 1)
    rng = random.Random(1)
    rows = [tuple(start + dt.timedelta(hours=h) for h in sorted(rng.randint(0, 99) for _ in range(9))) for _ in range(50)]
    for kind in ("timestamp_ntz", "timestamp", "date"):
        df = spark.createDataFrame(rows, ", ".join(f"t{k} timestamp_ntz" for k in range(9))).selectExpr(*[f"cast(t{k} as {kind}) t{k}" for k in range(9)])
        assert R.ordered_pairs(df, [Column(f"t{k}", ColumnType.DATETIME) for k in range(9)]) == [(f"t{a}", f"t{b}") for a in range(9) for b in range(a + 1, 9)]


def test_drift_of_many_counts(spark, monkeypatch):
    rng = random.Random(4)
    d = 20
    rows, other = table(rng, d, 200), table(rng, d, 200)
    other[7] = tuple(9 if k == 0 else 0 for k in range(d))
    df = lambda x: spark.createDataFrame(x, ", ".join(f"n_{k} long" for k in range(d)))
    columns = [Column(f"n_{k}", ColumnType.NUMERIC) for k in range(d)]
    got = Q.invariant_drift(df(rows), df(other), columns).collect()
    monkeypatch.setattr(Q, "WIDE", 1000)
    assert got == Q.invariant_drift(df(rows), df(other), columns).collect() and got


def test_early_death():
    x = np.array([[1, 0], [0, 1]])
    broken, met = np.eye(2, dtype=bool), np.zeros((2, 2), bool)
    O.compare_rows(x[:1], np.ones((1, 2), bool), broken, met)
    assert broken[0, 1] and not broken[1, 0] and met[1, 0]
    O.compare_rows(x[1:], np.ones((1, 2), bool), broken, met)
    assert broken.all()

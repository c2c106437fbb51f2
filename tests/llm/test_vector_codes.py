"""Vector codes against plain k-means over all entries."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.llm import vector_codes as V


def plain(vectors, entries, rounds, parts):
    """Codes, errors and codebooks by exhaustive search over Python integers."""
    width = -(-len(vectors[0]) // parts)
    cut = [[tuple((list(v) + [0] * parts)[p * width : (p + 1) * width]) for p in range(parts)] for v in vectors]
    books = [[cut[k][p] for k in range(min(entries, len(cut)))] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((square(x, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [near(v[p], books[p])[1] for v in cut]
            for e in set(held):
                own = [v[p] for v, h in zip(cut, held, strict=True) if h == e]
                books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    found = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    return [bytes(x[1] for x in f) for f in found], [sum(x[0] for x in f) for f in found], books


@pytest.mark.parametrize("scale", [3, 60, 5000])
def test_assign_over_many_rounds(scale):
    """Bounds stay true and codes exact while codebooks move at random, back too; small integers make many ties."""
    rng = np.random.default_rng(scale)
    vectors = rng.integers(-scale, scale, (200, 4, 3))
    history = rng.integers(-scale, scale, (1, 4, 40, 3))
    known, passed = V.Bounds.none(200, 4, 40), 0
    for t in range(8):
        errors, scanned = V.assign(vectors, history, known)
        passed += 200 * 4 * 3 - scanned
        squared = ((vectors[:, :, None] - history[-1][None]) ** 2).sum(axis=3)
        assert (known.code == squared.argmin(axis=2)).all() and (errors == squared.min(axis=2)).all()
        for g in range(3):
            rest = squared.copy()
            np.put_along_axis(rest, known.code[..., None].astype(int), np.iinfo(np.int64).max, axis=2)
            true = np.sqrt(rest[:, :, g * V.GROUP : (g + 1) * V.GROUP].min(axis=2))
            for p in range(4):
                assert (known.low[:, p, g] - V.displacements(history, p)[known.stamp[:, p, g], g] <= true[:, p] + 1e-3).all()
        step = rng.integers(-1, 2, history[-1].shape) * (max(1, scale // 40)) * (rng.random(history[-1].shape[:2]) < 0.3)[..., None]
        # Every other round goes back where it was: net displacement nothing, though drifts add up
        history = np.concatenate([history, (history[-2] if t % 2 else history[-1] + step)[None]])
    assert passed > 0 or scale == 3


def test_net_displacement():
    there = np.zeros((3, 1, 16, 2), np.int64)
    there[1, 0, 0] = [30, 40]
    assert V.displacements(there[:2], 0)[0, 0] == pytest.approx(50) and (V.displacements(there, 0)[[0, 2], 0] == 0).all()


def test_rows(spark):
    rng = np.random.default_rng(1)
    good = [(int(k), [float(x) for x in rng.choice([-1.0, -0.503, 0.001, 0.25, 0.9], 6)], [0, 1, None][k % 3]) for k in rng.permutation(150)]
    nan, inf = math.nan, math.inf
    odd = [(900, None, 1), (901, [], 1), (902, [1.0, None, 0.0], 1), (903, [nan] * 6, 1), (904, [inf] + [0.0] * 5, 1), (905, [1.0] * 7, 1), (7, good[0][1], 2), (None, [0.5] * 6, 5), (906, [1e30, -1e30] + [0.0] * 4, 2)]
    df = spark.createDataFrame([(i, v, x, 1.0, "c") for i, v, x in good + odd], "vec_id long, embedding array<double>, label int, error double, code string").repartition(3)
    kept = good + odd[6:]
    order = sorted(((i is None, i or 0, [max(-V.MOST, min(V.MOST, math.floor(256 * x))) for x in v], i, x) for i, v, x in kept), key=lambda r: r[:3])
    codes, errors, books = plain([r[2] for r in order], 20, 3, 4)
    found, got = V.compress(df, kept=("label",), parts=4, entries=20, rounds=3)
    assert [[tuple(e) for e in b] for b in got.tolist()] == books
    labels = Counter()
    for r, e in zip(order, errors, strict=True):
        labels[r[4]] += e
    rows = V.with_label_totals(found, "label", "label_error").collect()
    assert sorted(map(repr, ((r.id, bytes(r.code), r.error, r.label_error) for r in rows))) == sorted(map(repr, ((r[3], c, e, labels[r[4]]) for r, c, e in zip(order, codes, errors, strict=True))))
    back = {r.id: r.vector for r in V.decompress(found, got, 6).collect()}
    assert back[3] == pytest.approx([x / 256 for p, e in enumerate({r[3]: c for r, c in zip(order, codes, strict=True)}[3]) for x in books[p][e]][:6])
    few, small = V.compress(df.filter("vec_id < 5"), parts=4)
    assert small.shape == (4, 5, 2) and {r.error for r in few.collect()} == {0}
    empty, none = V.compress(df.filter("false"))
    assert empty.count() == 0 and V.with_label_totals(empty.withColumn("label", F.lit(1)), "label", "t").count() == 0 and V.codebook_digest(none)

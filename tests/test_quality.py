import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.operators import gram as G
from mirrorframe.operators import nearest as N
from mirrorframe.operators import quality as Q
from mirrorframe.operators.report import Gates, breaches, to_html, to_json, to_text, verdict
from mirrorframe.plans.model import Column, ColumnType
from mirrorframe.queries import QUERIES

SF = "/root/testdata/sf0.001"
NUM, CAT, TEXT = ColumnType.NUMERIC, ColumnType.CATEGORICAL, ColumnType.TEXT


def one(df):
    return df.first().score


def test_ks_is_monotone_and_exact(spark):
    real = spark.range(100).select(F.col("id").cast("double").alias("x"))
    near, far = real.select((F.col("x") + 0.1).alias("x")), real.select((F.col("x") + 50).alias("x"))
    ks = lambda a, b: one(Q.ks(a, b, [("x", F.col("x"))]))
    assert ks(real, real) == 0 and ks(real, near) == pytest.approx(0.01) and ks(real, far) == pytest.approx(0.5)
    assert math.isnan(ks(real, real.filter("x < 0")))


def test_tvd(spark):
    a = spark.createDataFrame([("a",)] * 5 + [("b",)] * 5, "c string")
    b = spark.createDataFrame([("a",)] * 1 + [("b",)] * 9, "c string")
    assert one(Q.tvd(a, b, ["c"])) == pytest.approx(0.4)
    assert math.isnan(one(Q.tvd(a, b.select(F.lit(None).cast("string").alias("c")), ["c"])))


def test_associations_and_frobenius(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"), F.lit(1.0).alias("k"), (F.col("id") % 2).cast("string").alias("c"))
    columns = [Column("x", NUM), Column("y", NUM), Column("k", NUM), Column("c", CAT)]
    got = {(r.a, r.b): r.score for r in Q.associations(df, columns).collect()}
    assert got[("x", "y")] == pytest.approx(1) and got[("x", "k")] == 0 and got[("c", "k")] == 0 and 0 <= got[("c", "x")] < 0.1
    a = Q.associations(df, columns[:2])
    assert Q.frobenius(a, Q.associations(df.withColumn("y", -F.col("y")), columns[:2]), 2).first()[0] == 0
    assert Q.frobenius(a, Q.associations(df.withColumn("y", F.lit(1.0)), columns[:2]), 2).first()[0] == pytest.approx(1)


def test_dcr(spark):
    real = spark.range(50).select(F.col("id").cast("double").alias("x"), F.lit("a").alias("c"))
    columns = [Column("x", NUM), Column("c", CAT)]
    same = Q.dcr_summary(Q.distances(real, real, columns)).first()
    other = Q.dcr_summary(Q.distances(real, real.withColumn("c", F.lit("b")), columns)).first()
    assert same.dcr_p50 == 0 and other.dcr_min == pytest.approx(math.sqrt(2))
    assert Q.distances(real, real, columns, rows=10).count() == 10
    assert math.isnan(Q.dcr_summary(Q.distances(real.filter("x < 0"), real, columns)).first().dcr_p50)


@pytest.mark.parametrize(("n_x", "n_c"), [(2, 1), (0, 2), (3, 0), (1, 3)])
def test_nearest_rows_by_cells(spark, monkeypatch, n_x, n_c):
    """Every query against brute force, over many cells, with crowded queries, ties, values beyond all known ones and unknown categories."""
    for name, x in (("CELL_ROWS", 20), ("PART_ROWS", 30), ("TREE_ROWS", 300), ("STEP", 16)):
        monkeypatch.setattr(N, name, x)
    rng = np.random.default_rng(n_x)
    x, c = np.round(rng.random((900, n_x)) ** 2, 2), rng.choice([-(2**63), -7, 5, 2**63 - 1], (900, n_c))
    y, d = np.concatenate([np.round(rng.random((200, n_x)) * 1.2, 2), np.zeros((300, n_x))]), np.concatenate([rng.choice([-(2**63), 5, 6], (200, n_c)), np.full((300, n_c), 5)])
    rows = lambda a, b: [(k, p, q) for k, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True))]
    frame = lambda a, b: spark.createDataFrame(rows(a, b), "id long, x array<double>, c array<bigint>")
    got = N.nearest(frame(x, c).drop("id"), frame(y, d), n_x, n_c).orderBy("id").collect()
    want = np.sqrt(((y[:, None] - x[None]) ** 2).sum(axis=2) + 2 * (d[:, None] != c[None]).sum(axis=2)).min(axis=1)
    assert [r.id for r in got] == list(range(500)) and [r.distance for r in got] == pytest.approx(want)
    if n_x:
        assert sum(r.cells for r in got) < 500 * 45 / 3


def test_nearest_of_equal_rows(spark):
    """One known row, copies of queries: one cell, a distance for each copy."""
    real = spark.createDataFrame([(1.0, "a")] * 5, "x double, c string")
    synth = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (9.0, None), (None, "a")], "x double, c string")
    got = Q.distances(real, synth, [Column("x", NUM), Column("c", CAT)], rows=0).collect()
    assert sorted(r.distance for r in got) == pytest.approx([0, 0, 0, math.sqrt(2)]) and {r.cells for r in got} == {1}


def test_dcr_query_takes_all_rows(spark, monkeypatch):
    if not Path(SF).exists():
        pytest.skip("no test data")

    def sampled(*_):
        raise AssertionError("sampled")

    monkeypatch.setattr(Q, "exact_sample", sampled)
    assert QUERIES["dcr_percentiles"](spark, SF).count() == 1


def test_report_of_odd_tables(spark):
    real = spark.createDataFrame([(1, "a", "t1", None), (2, "b", "t2", None), (3, "b", "t3", None)], "num_a long, b string, t string, n double")
    synth = spark.createDataFrame([(1.0, "a", "t1", "x")], "num_a double, b string, t string, c string")
    report = Q.compare(real, synth, [Column("num_a", NUM), Column("b", CAT), Column("t", TEXT), Column("n", NUM)])
    assert ("n", "double", "<missing>") in report.dtype_mismatches and ("c", "<missing>", "string") in report.dtype_mismatches and ("num_a", "bigint", "double") in report.dtype_mismatches
    assert {m["column"]: m["score"] for m in report.marginals}["t"] == 1.0
    parsed = json.loads(to_json(report))
    assert any(m["score"] is None for m in parsed["marginals"])
    assert "types that differ" in to_text(report) and "<script" not in to_html(report)
    assert breaches(report, Gates()) == [] and {b.gate for b in breaches(report, Gates(max_verbatim=0.5))} >= {"max_verbatim", "type of n"}
    assert verdict(0.01) == "excellent" and verdict(0.5) == "poor" and verdict(math.nan) == "unknown"


def test_invariant_drift(spark):
    real = spark.createDataFrame([(1, 2), (2, 3)], "num_a long, num_b long")
    synth = spark.createDataFrame([(5, 2), (2, 3)], "num_a long, num_b long")
    assert [tuple(r) for r in Q.invariant_drift(real, synth, [Column("num_a", NUM), Column("num_b", NUM)]).collect()] == [("num_a", "num_b", 1)]


def test_correlations_of_wide_tables(spark, monkeypatch):
    """All pairs by blocks equal pair by pair: nulls, NaN, constants, columns without values, large offsets."""
    monkeypatch.setattr(G, "BLOCK", 4)
    monkeypatch.setattr(G, "STEP", 50)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 14)) @ rng.normal(size=(14, 14))
    x[:, 3] = 0.1
    x[:, 5] += 1e9
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 8] = np.nan
    x[1:, 9] = np.nan
    x[5, 2] = np.inf
    names = [f"n {k}" for k in range(14)]
    rows = [tuple(None if k % 3 == 0 and np.isnan(v) else float(v) for k, v in enumerate(r)) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(7)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    want = {(r.a, r.b): r.score * ("n 3" not in r) for r in Q.pearson(df, pairs).collect()}
    got = {(r.a, r.b): r.score for r in G.correlations(df, names).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    columns = [Column(n, NUM) for n in names]
    assert {(r.a, r.b): r.score for r in Q.associations(df, columns).collect()} == got
    assert {r.score for r in G.correlations(df.limit(0), names).collect()} == {0.0} and G.correlations(df.limit(0), names).count() == len(pairs) and G.correlations(df, names[:1]).count() == 0


def test_marginals_of_a_counted_table(spark):
    """Marginals from counts of the real side equal those from its rows."""
    rows = [(i, i % 7 / 2 if i % 5 else None, ["a", "b", None][i % 3], f"t{i % 40}", i) for i in range(300)]
    real = spark.createDataFrame(rows, "k long, x double, c string, t string, y long")
    synth = real.filter("k > 100").withColumn("c", F.when(F.col("k") % 2 == 0, "z").otherwise(F.col("c"))).withColumn("x", F.col("x") + 0.3).drop("y")
    columns = [Column("k", ColumnType.KEY), Column("x", NUM), Column("c", CAT), Column("t", TEXT), Column("y", NUM)]
    read = lambda df: sorted(map(repr, df.collect()))
    assert read(Q.marginals(real.filter("false"), synth, columns, Q.counted(real, columns))) == read(Q.marginals(real, synth, columns))
    assert Q.marginals(real, synth, columns[:1], Q.counted(real, columns[:1])).count() == 0

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from mirrorframe.operators import growing, trees
from mirrorframe.operators.trees import TreeSynthesizer
from mirrorframe.plans.infer import infer_table
from mirrorframe.plans.model import Column, ColumnType, Table


@pytest.fixture(scope="module")
def rows(spark):
    """Two features, a number and a category that follow them, without ties."""
    u = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    df = spark.range(3000).select("id", F.floor(u(1) * 40).cast("double").alias("a"), F.floor(u(2) * 25).cast("double").alias("b"), u(3).alias("noise"))
    df = df.withColumn("y", F.sin(F.col("a") / 5) * 4 + F.col("b") / 10 + F.col("noise")).withColumn("c", F.concat(F.lit("c"), F.floor(F.col("a") / 9 + F.col("noise") * 2).cast("string")))
    return df.cache()


@pytest.mark.parametrize("local", [None, 200])
def test_a_number_as_mllib_grows_it(spark, rows, monkeypatch, local):
    """The same leaves, whether tasks add up histograms of most nodes or one grows all of them."""
    if local:
        monkeypatch.setattr(growing, "LOCAL_ROWS", local)
    columns = [Column(c, ColumnType.NUMERIC) for c in ("a", "b", "y")]
    model = TreeSynthesizer(3, max_depth=7).fit(Table("rows", columns, None, rows.select("a", "b", "y")), fit_rows=0)
    mine = model.fitted[2]
    assembled = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(rows)
    theirs = DecisionTreeRegressor(featuresCol="f", labelCol="y", leafCol="leaf", maxDepth=7, maxBins=128, minInstancesPerNode=trees.MIN_LEAF).fit(assembled)
    at = lambda share: mine.place(F.lit(share), ["a", "b"])
    pairs = theirs.transform(assembled).select("leaf", at(0.0).alias("first"), at(1.0).alias("last")).groupBy("leaf", "first", "last").count().collect()
    assert len(pairs) == len({p.leaf for p in pairs}) == len({p["first"] for p in pairs}) > 40
    assert all(p.last - p["first"] + 1 == p["count"] for p in pairs)
    pool = mine.pool.orderBy("pos").collect()
    assert [r.pos for r in pool] == list(range(3000)) and sorted(r.e.v for r in pool) == sorted(r.y for r in rows.collect())


@pytest.mark.parametrize("local", [None, 200])
def test_a_category_as_mllib_grows_it(spark, rows, monkeypatch, local):
    """The same splits; MLlib then joins leaves of one majority, which here stay apart."""
    if local:
        monkeypatch.setattr(growing, "LOCAL_ROWS", local)
    df = rows.select("a", "b", "c")
    found = infer_table("rows", df)
    mine = TreeSynthesizer(3, max_depth=3).fit(found, fit_rows=0).fitted[2]
    assembled = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(df.withColumn("y", F.substring("c", 2, 3).cast("double")))
    theirs = DecisionTreeClassifier(featuresCol="f", labelCol="y", leafCol="leaf", maxDepth=3, maxBins=128, minInstancesPerNode=trees.MIN_LEAF).fit(assembled)
    pairs = theirs.transform(assembled).select("leaf", mine.place(F.lit(0.0), ["a", "b"]).alias("first")).distinct().collect()
    assert len(pairs) == len({p["first"] for p in pairs}) == 8 >= len({p.leaf for p in pairs}) >= 4


@pytest.mark.parametrize("classes", [0, 6])
def test_both_searches_find_the_same_cuts(classes):
    r = np.random.default_rng(5)
    node, b = r.integers(0, 30, 4000), r.integers(0, 20, 4000).astype(np.uint8)
    y = r.integers(0, classes, 4000) if classes else r.normal(size=4000)
    counts = np.bincount(node, minlength=30)
    alike = None
    if classes:
        of = np.bincount(node * classes + y, minlength=30 * classes)
        alike = of[node * classes + y]
    gain, at = growing.best_cuts(growing.histogram(node, b, y, 30, 20, classes), classes, 5)
    gain2, at2 = growing.sorted_cuts(node.astype(np.uint16), b, y.astype(np.uint16) if classes else y, counts, classes, 5, alike)
    assert np.allclose(gain, gain2) and (at == at2).all()


def test_pools_are_never_broadcast(spark):
    """Many rows of few values are a small file: they were broadcast for its size, and the driver built all of them."""
    df = spark.range(4000).select((F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("c"))
    made = TreeSynthesizer(3).fit(infer_table("small", df), fit_rows=0).sample(spark, 500)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert made.count() == 500 and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_all_rows_are_not_fitted_by_mllib(spark, monkeypatch):
    """MLlib's records of nodes and classes filled the driver; a tree over all rows comes as arrays."""
    made = []
    for name in ("DecisionTreeClassifier", "DecisionTreeRegressor"):
        monkeypatch.setattr(trees, name, lambda *a, name=name, **k: made.append(name))
    df = spark.range(3000).select((F.col("id") % 11).cast("double").alias("x"), F.concat(F.lit("c"), (F.col("id") % 120).cast("string")).alias("c"))
    model = TreeSynthesizer(3).fit(infer_table("classes", df), fit_rows=0)
    assert made == [] and model.fitted[1].tree.columns == ["node", "feature", "cut", "left", "first", "size"]
    assert model.sample(spark, 300).join(df, "c", "left_anti").count() == 0

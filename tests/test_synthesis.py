import datetime as dt
from pathlib import Path

from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from mirrorframe.functions.ranges import positions
from mirrorframe.operators import trees
from mirrorframe.operators.constraints import Derived, Range
from mirrorframe.operators.hierarchy import HierarchySynthesizer
from mirrorframe.operators.pipeline import generate
from mirrorframe.operators.quality import average_marginal, marginals
from mirrorframe.operators.trees import TreeSynthesizer, fit_row_cap
from mirrorframe.plans import infer
from mirrorframe.plans.infer import infer_table
from mirrorframe.plans.model import Dataset, Reference
from mirrorframe.queries import QUERIES
from mirrorframe.sources import artifact

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(i, 18 + i * 7 % 53 if i % 10 else None, ["SE", "NO", "DK"][i * i % 3], i % 3 == 0, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i * 5), float(i % 17)) for i in range(1, 401)]
    return spark.createDataFrame(rows, "user_id long, age long, country string, premium boolean, created timestamp_ntz, score double")


def test_generate(spark, mixed):
    made = generate(mixed, 300, seed=3)
    out = made.data.drop("row_id")
    assert out.dtypes == mixed.dtypes and out.count() == 300
    rows = out.collect()
    assert sorted(r.user_id for r in rows) == list(range(1, 301))
    pool = {r.age for r in mixed.collect()}
    assert {r.age for r in rows} <= pool and abs(sum(r.age is None for r in rows) / 300 - 0.1) < 0.07
    assert average_marginal(marginals(mixed, out, made.table.columns)).first()[0] < 0.15


def test_same_seed_same_rows_whatever_the_partitions(spark, mixed):
    a, b, c = (sorted(map(str, generate(mixed.repartition(n), 60, seed=s).data.collect())) for n, s in ((1, 5), (6, 5), (1, 6)))
    assert a == b and a != c


def test_constraints_and_keys(spark, mixed):
    made = generate(mixed, 80, seed=3, constraints=[Range("age", 20, 60), Derived("double_score", "score * 2")])
    rows = made.data.collect()
    assert len(rows) == 80 and all(20 <= r.age <= 60 and r.double_score == 2 * r.score for r in rows)
    assert sorted(r.user_id for r in rows) == list(range(1, 81)) and made.report.violations["range(age)"] > 0


def test_full_fit(spark, mixed):
    out = generate(mixed, 50, seed=1, fit_rows=0).data
    assert out.count() == 50


def test_artifact_round_trip(spark, mixed, tmp_path):
    table = infer_table("mixed", mixed)
    model = TreeSynthesizer(9).fit(table)
    artifact.save(spark, model, f"file://{tmp_path}/m")
    again, manifest, _ = artifact.load(spark, f"file://{tmp_path}/m")
    assert manifest.columns == mixed.columns
    rows = lambda m: sorted(map(str, m.sample(spark, 40).collect()))
    assert rows(model) == rows(again)
    with pytest.raises(artifact.ArtifactError):
        artifact.load(spark, f"file://{tmp_path}/none")


def test_hierarchy(spark):
    users = spark.range(1, 61).select(F.col("id").alias("user_id"), F.element_at(F.array(F.lit("SE"), F.lit("NO")), (F.col("id") % 2 + 1).cast("int")).alias("country"))
    orders = users.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("user_id") % 4).cast("int")))).filter("k > 0").select((F.col("user_id") * 10 + F.col("k")).alias("order_id"), F.col("user_id").cast("int").alias("user_id"), (F.col("k") * 10.0).alias("amount"))
    child = replace(infer_table("orders", orders), references=(Reference("user_id", "users", "user_id"),))
    data = Dataset({"users": infer_table("users", users), "orders": child})
    model = HierarchySynthesizer(4).fit(data)
    made = model.sample(spark, {"users": 100})
    assert made["users"].count() == 100 and made["orders"].dtypes == orders.dtypes
    assert made["orders"].join(made["users"], "user_id", "left_anti").count() == 0
    assert abs(made["orders"].count() / 100 - orders.count() / 60) < 0.5
    some = model.sample_where(spark, {"users": 20}, "users", "country == 'SE'")
    assert some["users"].count() == 20 and {r.country for r in some["users"].collect()} == {"SE"}
    assert some["orders"].join(some["users"], "user_id", "left_anti").count() == 0


@pytest.mark.parametrize("name", ["cart_generate", "cart_fidelity", "reject_resample", "multi_table_generate"])
def test_queries_fit_all_rows(spark, monkeypatch, name):
    if not Path(SF).exists():
        pytest.skip("no test data")

    class Seen(Exception):
        pass

    def fit(self, table, *, fit_rows=None):
        raise Seen(fit_rows)

    monkeypatch.setattr(TreeSynthesizer, "fit", fit)
    with pytest.raises(Seen) as seen:
        QUERIES[name](spark, SF)
    assert seen.value.args == (0,)


def test_fit_row_cap():
    assert fit_row_cap(10, 50_000) is None and fit_row_cap(10, 200_000) == 50 and fit_row_cap(10**6, 200_000) == 100_000


@pytest.mark.parametrize("levels", [101, 500])
def test_wide_category(spark, levels):
    """A category of over 100 levels is fitted, and its values come back."""
    df = spark.range(levels * 24).select((F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("c"), (F.col("id") % levels).cast("string")).alias("c"))
    found = infer_table("wide", df)
    assert len(found["c"].categories) == levels
    made = TreeSynthesizer(3).fit(found, fit_rows=0).sample(spark, 300)
    assert made.count() == 300 and made.join(df, "c", "left_anti").count() == 0


@given(st.recursive(st.just(()), lambda t: st.tuples(t, t), max_leaves=12), st.lists(st.integers(0, 3), min_size=12, max_size=12))
def test_leaf_spans(tree, counts):
    """Every leaf draws from its own entries or those of the nearest node above that has some."""
    depths, paths = [], []

    def walk(node, path):
        if not node:
            depths.append(len(path))
            paths.append(path)
        for side, child in enumerate(node):
            walk(child, (*path, side))

    walk(tree, ())
    counts = np.array(counts[: len(depths)])
    first, size = trees.leaf_spans(np.array(depths), counts)
    entries = [leaf for leaf, n in enumerate(counts) for _ in range(n)]
    for leaf, path in enumerate(paths):
        for k in range(len(path), -1, -1):
            want = [x for x in entries if paths[x][:k] == path[:k]]
            if want:
                break
        assert entries[first[leaf] : first[leaf] + size[leaf]] == want


def test_a_leaf_of_most_rows(spark):
    """A leaf of 90% of the rows: its entries spread over tasks, draws stay within leaves, and rows of an emptied leaf stay."""
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(100).cast("double").alias("x"), F.col("id").cast("double").alias("y")).withColumn("y", F.when(F.col("x") == 100, F.lit(5.0)).otherwise(F.col("x") * 1000))
    frame = df.withColumn("_order", F.md5(F.monotonically_increasing_id().cast("string")))
    assembled = VectorAssembler(inputCols=["x"], outputCol="f").transform(frame)
    model = DecisionTreeRegressor(featuresCol="f", labelCol="y", leafCol="_leaf", maxDepth=4).fit(assembled)
    leaves = model.transform(assembled).select(F.col("_leaf").cast("long").alias("_leaf"), "_order", F.struct(F.col("y").alias("v"), F.col("x").alias("of")).alias("e"))
    hot = leaves.groupBy("_leaf").count().orderBy(F.desc("count")).first()
    assert hot["count"] == 18_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = positions(leaves, ["_leaf", "_order"]).filter(F.col("_leaf") == hot._leaf).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) >= 3 and max(r["count"] for r in dealt) < 9_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pool, spans = trees.leaf_pool(model, leaves, "_order")
    drawn = spans.withColumn("pos", F.explode(F.sequence("_first", F.col("_first") + F.col("_size") - 1))).join(pool, "pos").select("_leaf", "e.of")
    real = leaves.select("_leaf", "e.of").distinct()
    assert sorted(drawn.distinct().collect()) == sorted(real.collect()) and drawn.count() == 20_000
    _, fewer = trees.leaf_pool(model, leaves.filter(F.col("_leaf") != hot._leaf), "_order")
    assert fewer.count() == spans.count() and fewer.filter("_size = 0").count() == 0


def test_levels_as_a_table(spark, tmp_path, monkeypatch):
    """A category whose levels aren't listed is inferred, fitted, saved and sampled; the driver gets none of them."""
    monkeypatch.setattr(infer, "MOST_LISTED", 50)
    monkeypatch.setattr(trees, "CLASSES", 50)
    df = spark.range(6000).select((F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 40 > 0, F.concat(F.lit("c"), (F.col("id") % 280).cast("string"))).alias("c"), (F.col("id") % 280).cast("double").alias("y"))
    found = infer_table("wide", df)
    assert found["c"].type == "categorical" and found["c"].categories is None
    names = sorted(r.c for r in df.select("c").distinct().collect() if r.c)
    assert [(r.value, r.code) for r in found["c"].levels.orderBy("code").collect()] == [(c, k) for k, c in enumerate(names)]
    model = TreeSynthesizer(3).fit(found, fit_rows=0)
    made = model.sample(spark, 2000)
    assert made.count() == 2000 and made.filter("c is not null").join(df, "c", "left_anti").count() == 0
    assert 10 < made.filter("c is null").count() < 120
    near = made.join(df.groupBy("c").agg(F.min("x").alias("of_x")), "c").agg(F.avg((F.col("x") == F.col("of_x")).cast("int"))).first()[0]
    assert near > 0.5  # x decides c modulo 7; drawn alone it would be right in a seventh
    artifact.save(spark, model, f"file://{tmp_path}/m")
    again, _, _ = artifact.load(spark, f"file://{tmp_path}/m")
    assert again.fitted[1].column.levels.count() == len(names)
    assert sorted(map(str, again.sample(spark, 50).collect())) == sorted(map(str, model.sample(spark, 50).collect()))

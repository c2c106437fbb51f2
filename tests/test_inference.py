import datetime as dt

import pytest

from pyspark.sql import functions as F

from mirrorframe.plans import infer
from mirrorframe.plans.infer import infer_table, is_count_name, is_key_name
from mirrorframe.plans.model import ColumnType, Dataset, Reference, Table
from mirrorframe.sources.normalize import normalise, promotions, trim


@pytest.mark.parametrize("name, expected", [("id", True), ("UUID", True), ("user_id", True), ("USER_KEY", True), ("userId", True), ("userID", True), ("paid", False), ("custkey", False), ("valid", False)])
def test_key_names(name, expected):
    assert is_key_name(name) is expected


@pytest.mark.parametrize("name, expected", [("num_seats", True), ("n_x", True), ("total_y", True), ("seat_count", True), ("seat_count_l30d", True), ("counter", False), ("seats", False)])
def test_count_names(name, expected):
    assert is_count_name(name) is expected


def test_mixed_table(spark):
    rows = [(i, 20 + i % 50 if i % 10 else None, 150.0 + i, "SE NO DK".split()[i % 3], i % 3 == 0, dt.datetime(2024, 1, 1 + i % 28), i % 2, f"text {i}") for i in range(1, 201)]
    df = spark.createDataFrame(rows, "user_id long, age long, height double, country string, premium boolean, created timestamp_ntz, flag int, note string")
    t = infer_table("mixed", df)
    kinds = {c.name: c.type for c in t.columns}
    assert kinds == {"user_id": ColumnType.KEY, "age": ColumnType.NUMERIC, "height": ColumnType.NUMERIC, "country": ColumnType.CATEGORICAL, "premium": ColumnType.CATEGORICAL, "created": ColumnType.DATETIME, "flag": ColumnType.CATEGORICAL, "note": ColumnType.TEXT}
    assert t.primary_key == "user_id" and t["age"].nullable and not t["height"].nullable
    assert t["country"].categories == ("DK", "NO", "SE") and t["premium"].categories == (False, True)


def test_key_edges(spark):
    one_null = infer_table("t", spark.createDataFrame([(1,), (2,), (None,)], "id long")).columns[0]
    assert one_null.type is ColumnType.KEY and one_null.nullable
    assert infer_table("t", spark.createDataFrame([("a",), (None,)], "id string")).columns[0].type is not ColumnType.KEY
    assert infer_table("t", spark.createDataFrame([(0,), (0,)], "f int")).columns[0].type is ColumnType.NUMERIC
    empty = infer_table("t", spark.createDataFrame([], "id long, s string"))
    assert [c.type for c in empty.columns] == [ColumnType.NUMERIC, ColumnType.CATEGORICAL] and empty.primary_key is None


def test_trim_and_null_texts(spark):
    df = spark.createDataFrame([(" Private",), (" ?",), ("State-gov",), ("?",), (None,)], "s string")
    assert [r.s for r in trim(df).collect()] == ["Private", None, "State-gov", None, None]


def test_promotions(spark):
    df = spark.createDataFrame([(" 77516", " 1.5", "123", "2024-01-02", None), ("?", "2", "abc", "2024-01-03 04:05:06", None)], "i string, d string, m string, t string, n string")
    assert promotions(trim(df)) == {"i": "bigint", "d": "double", "t": "timestamp_ntz", "n": "bigint"}
    out = normalise(df).collect()
    assert out[0].i == 77516 and out[1].i is None and out[1].t == dt.datetime(2024, 1, 3, 4, 5, 6)


def test_topological_order():
    data = lambda **above: Dataset({n: Table(n, [], None, None, tuple(Reference("x", p, "x") for p in above.get(n, ""))) for n in "abc"})
    assert data(a="c", b="a").topological_order() == ["c", "a", "b"]
    for above in ({"a": "c", "c": "a"}, {"b": "b"}):
        with pytest.raises(ValueError, match="cycle"):
            data(**above).topological_order()
    with pytest.raises(ValueError, match="unknown"):
        data(a="z").topological_order()


def test_sketched_counts_give_the_same_types(spark, monkeypatch):
    """Columns on every side of every rule: types as with exact counts, which only open columns get."""
    n = 4000
    levels = {"few": 3, "fifty": 50, "fifty_one": 51, "share": int(n * infer.CATEGORY_RATIO), "share_over": int(n * infer.CATEGORY_RATIO) + 1, "half": n // 2, "over_half": n // 2 + 1, "most": n - 1, "every": n}
    text = [F.concat(F.lit("v"), (F.col("id") % k).cast("string")).alias(name) for name, k in levels.items()]
    keys = [F.concat(F.lit("v"), (F.col("id") % k).cast("string")).alias(f"{name}_id") for name, k in levels.items()] + [(F.col("id") % k).alias(f"{name}_key") for name, k in levels.items()]
    df = spark.range(n).select(*text, *keys, F.when(F.col("id") > 0, F.col("id")).alias("null_id"), F.when(F.col("id") > 1, F.col("id")).alias("nulls_id"), F.when(F.col("id") > 0, F.lit("x").substr(1, 1)).alias("one"), F.lit(None).cast("string").alias("none"))
    stats = infer.stats_of(df)
    exact = {f.name: infer.classify(f.name, f.dataType, stats[f.name]) for f in df.schema.fields}
    found = infer.infer_table("t", df)
    assert {c.name: c.type for c in found.columns} == exact
    asked = []
    monkeypatch.setattr(infer, "_short", lambda f: asked.append(f.name) or F.col(f"`{f.name}`"))
    infer.verified_stats(df)
    assert "few" not in asked and "every" not in asked and "over_half_key" not in asked and {"every_id", "every_key", "most_key", "share", "share_over", "null_id"} <= set(asked)

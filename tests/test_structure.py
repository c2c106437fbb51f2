import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions import features as E
from mirrorframe.operators import repair as R
from mirrorframe.operators.trees import key_values
from mirrorframe.plans.model import Column, ColumnType

N = ColumnType.NUMERIC


def test_missing_flag(spark):
    df = spark.createDataFrame([(None, 1), (10, 0), (None, 1), (3, 0)], "src int, src_missing int")
    columns = [Column("src", N), Column("src_missing", N)]
    assert R.missing_flags(df, columns) == [("src", "src_missing")]
    broken = spark.createDataFrame([(None, 0), (10, 1), (None, 0), (3, 0)], "src int, src_missing int")
    assert [r.src_missing for r in R.repair_flags(broken, [("src", "src_missing")]).collect()] == [1, 0, 1, 0]
    assert R.changes(broken, R.Rules(flags=[("src", "src_missing")])).first().changed == 3


def test_count_bound(spark):
    real = spark.createDataFrame([(1, 2), (2, 2), (3, 9)], "num_viewers long, num_seats long")
    assert R.count_bounds(real, [Column("num_viewers", N), Column("num_seats", N)]) == [("num_viewers", "num_seats")]
    df = spark.createDataFrame([(5, 3), (2, 2), (10, 8)], "num_viewers long, num_seats long")
    assert [r.num_viewers for r in R.repair_bounds(df, [("num_viewers", "num_seats")]).collect()] == [3, 2, 8]


def test_ordered_pair_in_either_order(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, t + dt.timedelta(minutes=10)), (t, None)], "pickup timestamp_ntz, dropoff timestamp_ntz")
    for names in (("pickup", "dropoff"), ("dropoff", "pickup")):
        assert R.ordered_pairs(df.select(*names), [Column(n, ColumnType.DATETIME) for n in names]) == [("pickup", "dropoff")]


def test_encoders(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), (None, 3.0), ("c", None)], "s string, x double")
    assert [r.x for r in E.impute(df, ["x"]).collect()] == [1.0, 2.0, 3.0, 2.0]
    table = E.codes(df.filter("s is null or s <> 'c'"), "s")
    got = {r.s: r.code for r in E.encode_labels(df, "s", table, "code").collect()}
    assert got["c"] == -1 and got["a"] < got["b"] and sorted(got.values()) == [-1, 0, 1, 2]
    with pytest.raises(E.SentinelError):
        E.fill_missing(spark.createDataFrame([(E.MISSING,)], "s string"), "s")
    assert [r[0] for r in df.select(E.min_max(F.lit(5.0), F.lit(1.0), F.lit(1.0))).collect()] == [0.0] * 4


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),), (None,)], "d date")
    kind = df.schema["d"].dataType
    row = df.select(*[E.calendar(F.col("d"), f, kind).alias(f) for f in ("dow", "month", "week_of_year", "quarter", "day_of_month")]).collect()
    assert tuple(row[0]) == (1, 12, 1, 4, 30) and tuple(row[1]) == (None,) * 5
    with pytest.raises(TypeError):
        E.calendar(F.col("d"), "hour", kind)


def test_keys(spark):
    df = spark.range(3)
    made = df.select(key_values("customer_uuid", T.LongType(), F.col("id"), 1).alias("i"), key_values("customer_uuid", T.StringType(), F.col("id"), 1).alias("u"), key_values("code", T.StringType(), F.col("id"), 1).alias("c")).collect()
    assert [r.i for r in made] == [1, 2, 3] and [r.c for r in made] == ["code_1", "code_2", "code_3"]
    assert len({r.u for r in made}) == 3 and all(len(r.u) == 32 and r.u[12] == "4" and r.u[16] in "89ab" for r in made)

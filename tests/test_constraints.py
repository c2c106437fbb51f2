import pytest
from pyspark.sql import functions as F

from mirrorframe.functions.rng import exact_sample, uniform
from mirrorframe.operators.constraints import Derived, ExhaustedError, Inequality, Range, Where, apply, count_violations, factors, parse_constraint, precheck, reject_resample, where_table
from mirrorframe.operators.relations import IntegrityError, check_foreign_key, check_primary_key, child_counts, expand


def mask(df, rule):
    return [r[0] for r in df.select(rule.violated(df.schema)).collect()]


def test_masks(spark):
    df = spark.createDataFrame([(-1, 1, 2), (0, 5, 5), (None, None, 3), (11, 3, None)], "x int, a int, b int")
    assert mask(df, Range("x", 0, 10)) == [True, False, True, True]
    assert mask(df, Range("x")) == [False] * 4
    assert mask(df, Inequality("a", "<", "b")) == [False, True, True, True]
    assert mask(df, Where("x >= 0 and a == 5")) == [True, False, True, True]


def test_apply_and_counts(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 20)], "qty int, price int")
    out = apply(df, [Derived("total", "qty * price"), Range("total", None, 50)])
    assert sorted(r.total for r in out.collect()) == [10, 40]
    assert [r.violations for r in count_violations(df, [Range("qty", 2, 3)]).collect()] == [2]


def test_parse():
    assert parse_constraint({"kind": "range", "column": "x", "min": 1}) == Range("x", 1)
    for bad in ({"kind": "nope"}, {"kind": "range", "colum": "x"}, {"kind": "inequality", "left": "a", "op": "~", "right": "b"}):
        with pytest.raises(ValueError):
            parse_constraint(bad)


def test_factors():
    assert factors() == [1.5, 2.25, 3.375] and factors(1.0) == [1.5]


def test_reject_resample(spark):
    def rows(first, n):
        return spark.range(first, first + n).select(F.col("id").alias("row_id"), F.floor(uniform(1, "x", F.col("id")) * 100).alias("x"))

    out, report = reject_resample(rows, 50, [Range("x", 0, 59)])
    got = out.collect()
    assert len(got) == 50 and all(r.x <= 59 for r in got) and len({r.row_id for r in got}) == 50 and report.violations["range(x)"] > 0
    with pytest.raises(ExhaustedError):
        reject_resample(rows, 50, [Range("x", 1000, None)])


def test_precheck_and_where_table(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "plan string, n int")
    assert precheck(df, "plan == 'a'") == 1
    with pytest.raises(ExhaustedError):
        precheck(df, "n > 5")
    assert where_table("n > 1", {"t": ["n"], "u": ["m"]}) == "t"
    with pytest.raises(ValueError):
        where_table("n > m", {"t": ["n"], "u": ["m"]})


def test_keys(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    orders = spark.createDataFrame([(1, 1), (2, 1), (3, None), (4, 9)], "order_id int, user_id int")
    check_primary_key("users", users, "user_id")
    with pytest.raises(IntegrityError, match="unique"):
        check_primary_key("orders", orders.filter("user_id = 1"), "user_id")
    with pytest.raises(IntegrityError, match="FK violation"):
        check_foreign_key("orders", orders, "user_id", users, "user_id")
    counts = child_counts(users, "user_id", orders, "user_id")
    assert sorted(map(tuple, counts.collect())) == [(1, 2), (2, 0), (3, 0)]
    assert expand(counts, "n").count() == 2


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a, b = (sorted(r.id for r in exact_sample(df.repartition(n), 20, 5, "id").collect()) for n in (1, 7))
    assert a == b and len(a) == 20


def test_report_in_words():
    from mirrorframe.cli import report_lines
    from mirrorframe.operators.constraints import ConstraintReport

    assert report_lines(ConstraintReport(10, 10, 1, {})) == ["kept 10 of 10 rows asked for in 1 attempt"]
    assert report_lines(ConstraintReport(10, 8, 3, {"range(a)": 2, "where(b)": 5, "c": 0}))[1:] == ["  5 rows broke where(b)", "  2 rows broke range(a)"]


def test_attempts_that_cannot_suffice_are_left_out(spark):
    """An eighth of the rows is kept: by 1.5, 2.25, ... times what is missing it took five attempts, each a join with every pool."""
    asked = []

    def make(first, size):
        asked.append(size)
        return spark.range(first, first + size).select(F.col("id").alias("row_id"), (F.col("id") % 8).alias("x"))

    rows, report = reject_resample(make, 800, [Range("x", 0, 0)], most=60.0)
    assert sorted(r.row_id for r in rows.collect()) == [8 * k for k in range(800)]
    assert report.attempts == len(asked) == 2 and asked[0] == 1200

import math

import pytest

from mirrorframe.functions.expressions import ExpressionError, compile_boolean, compile_numeric, derive, referenced


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(1, 4.0, "x", True), (2, 5.0, "y", False), (3, 6.0, None, None)], "a int, b double, s string, f boolean")


def values(frame, text):
    return [r[0] for r in frame.select(compile_numeric(text, frame.schema)).collect()]


def test_arithmetic(frame):
    assert values(frame, "a + b + 1") == [6, 8, 10]
    assert values(frame, "-a") == [-1, -2, -3]
    assert values(frame, "b / a") == [4, 2.5, 2]


def test_division_by_zero(frame):
    got = values(frame, "(a - 2) / (b - b)")
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2] == math.inf


def test_derived_columns_chain(frame):
    out = derive(frame, [("sum", "a * 2"), ("scaled", "sum + 1")]).select("sum", "scaled").collect()
    assert [tuple(r) for r in out] == [(2, 3), (4, 5), (6, 7)]


@pytest.mark.parametrize("text, expected", [("s == 'x'", [1]), ("a >= 2 and b < 6", [2]), ("a == 1 or f == False", [1, 2]), ("s != 'x'", [2])])
def test_boolean(frame, text, expected):
    assert [r.a for r in frame.filter(compile_boolean(text, frame.schema)).collect()] == expected


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "f(a)", "a[0]", "lambda: 1", "a ** 2", "a % 2", "not f", "1 < a < 3", "a if f else b", "[a]", "a; b", "", "a == ", "a"])
def test_outside_the_grammar(frame, text):
    with pytest.raises(ExpressionError):
        compile_boolean(text, frame.schema)


def test_unknown_column_lists_the_known(frame):
    with pytest.raises(ExpressionError, match="a, b, f, s"):
        compile_numeric("nope + 1", frame.schema)


def test_type_clash(frame):
    with pytest.raises(ExpressionError):
        compile_boolean("s == 1", frame.schema)


def test_referenced():
    assert referenced("b + a > 1 and b < 2") == ["b", "a"]

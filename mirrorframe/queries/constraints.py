"""Expressions and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.functions.expressions import compile_boolean, derive
from mirrorframe.operators.constraints import Derived, Inequality, Range, Where, apply, count_violations, precheck
from mirrorframe.queries.registry import query, table

_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_WHERE = "l_returnflag == 'R' and l_quantity > 10 or l_linestatus != 'O'"


@query(f"SELECT {', '.join(_ID)}, net * (1 + l_tax) AS gross, net / l_quantity AS each FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)")
def derived_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived columns, the later ones over the earlier."""
    df = derive(table(spark, sf_dir, "lineitem"), [("net", "l_extendedprice * (1 - l_discount)"), ("gross", "net * (1 + l_tax)"), ("each", "net / l_quantity")])
    return df.select(*_ID, "gross", "each")


@query("SELECT o_orderkey, round(CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN o_totalprice - 150000 > 0 THEN 1e300 ELSE -1e300 END ELSE (o_totalprice - 150000) / (o_custkey % 3) END, 6) AS ratio FROM orders")
def division_by_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division that meets zeros gives infinities, shown here as large numbers."""
    df = table(spark, sf_dir, "orders").withColumn("d", F.col("o_custkey") % 3)
    df = derive(df, [("ratio", "(o_totalprice - 150000) / d")])
    inf = F.lit(float("inf"))
    return df.select("o_orderkey", F.round(F.when(F.col("ratio") == inf, 1e300).when(F.col("ratio") == -inf, -1e300).otherwise(F.col("ratio")), 6).alias("ratio"))


_NULLED = "SELECT nullif(l_quantity, 7) AS l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem"


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select(F.nullif("l_quantity", F.lit(7.0)).alias("l_quantity"), "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


@query(f"SELECT 0::BIGINT AS position, 'range(l_quantity)' AS label, count(*) FILTER (WHERE coalesce(l_quantity < 5, true) OR coalesce(l_quantity > 45, true)) AS violations, count(*) AS rows FROM ({_NULLED}) UNION ALL SELECT 1, 'range(l_discount)', count(*) FILTER (WHERE coalesce(l_discount > 0.08, true)), count(*) FROM ({_NULLED})")
def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of values out of range; nulls violate."""
    return count_violations(_lineitem(spark, sf_dir), [Range("l_quantity", 5, 45), Range("l_discount", None, 0.08)])


@query(f"SELECT 0::BIGINT AS position, 'l_discount < l_tax' AS label, count(*) FILTER (WHERE coalesce(NOT (l_discount < l_tax), true)) AS violations, count(*) AS rows FROM ({_NULLED}) UNION ALL SELECT 1, 'l_quantity <= l_extendedprice', count(*) FILTER (WHERE coalesce(NOT (l_quantity <= l_extendedprice), true)), count(*) FROM ({_NULLED})")
def inequality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of broken inequalities; nulls violate."""
    return count_violations(_lineitem(spark, sf_dir), [Inequality("l_discount", "<", "l_tax"), Inequality("l_quantity", "<=", "l_extendedprice")])


@query(f"""SELECT 0::BIGINT AS position, 'where l_returnflag == ''R'' and l_quantity > 10 or l_linestatus != ''O''' AS label, count(*) FILTER (WHERE coalesce(NOT (l_returnflag = 'R' AND l_quantity > 10 OR l_linestatus <> 'O'), true)) AS violations, count(*) AS rows FROM ({_NULLED})""")
def where_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that don't satisfy a boolean expression."""
    return count_violations(_lineitem(spark, sf_dir), [Where(_WHERE)])


@query(f"SELECT l_returnflag, count(*) AS n, round(sum(net), 4) AS net FROM (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM ({_NULLED})) WHERE l_quantity BETWEEN 5 AND 45 AND l_discount < l_tax AND net > 1000 GROUP BY l_returnflag")
def apply_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a table under four kinds of constraint."""
    rules = [Derived("net", "l_extendedprice * (1 - l_discount)"), Range("l_quantity", 5, 45), Inequality("l_discount", "<", "l_tax"), Where("net > 1000")]
    return apply(_lineitem(spark, sf_dir), rules).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net"), 4).alias("net"))


@query("SELECT count(*) AS matches FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def where_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows that support a condition."""
    return spark.createDataFrame([(precheck(table(spark, sf_dir, "orders"), "o_orderstatus == 'F' and o_totalprice >= 100000"),)], "matches bigint")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE nullif(o_orderstatus, 'P') <> 'O' OR o_totalprice / 1000 > 200 + 2 * 25")
def row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row filter where null counts as false."""
    df = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return df.filter(compile_boolean("o_orderstatus != 'O' or o_totalprice / 1000 > 200 + 2 * 25", df.schema)).select("o_orderkey", "o_totalprice")

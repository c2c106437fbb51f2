"""Feature encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.functions.features import MISSING, calendar, codes, encode_labels, fill_missing, from_epoch, impute, min_max, one_hot, to_epoch
from mirrorframe.operators.quality import null_rates as rates
from mirrorframe.plans.model import CALENDAR
from mirrorframe.queries.registry import query, table

_CUSTOMER = "SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer"
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))


@query(f"SELECT 'c_acctbal' AS \"column\", round(avg((c_acctbal IS NULL)::INT), 6) AS rate FROM ({_CUSTOMER}) UNION ALL SELECT 'c_mktsegment', round(avg((c_mktsegment IS NULL)::INT), 6) FROM ({_CUSTOMER})")
def null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of nulls."""
    return rates(_customer(spark, sf_dir), ["c_acctbal", "c_mktsegment"]).select("column", F.round("rate", 6).alias("rate"))


@query(f"WITH c AS ({_CUSTOMER}) SELECT c_custkey, round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM c)), 6) AS c_acctbal FROM c")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of a number replaced by its median."""
    return impute(_customer(spark, sf_dir), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


@query(f"SELECT c_custkey, coalesce(c_mktsegment, '{MISSING}') AS c_mktsegment FROM ({_CUSTOMER})")
def sentinel_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of a category replaced by a text of their own."""
    return fill_missing(_customer(spark, sf_dir), "c_mktsegment").select("c_custkey", "c_mktsegment")


@query(f"WITH c AS ({_CUSTOMER}), v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT coalesce(c_mktsegment, '{MISSING}') AS value FROM c WHERE c_custkey % 2 = 0 AND coalesce(c_mktsegment, '') <> 'MACHINERY')) SELECT c_custkey, coalesce(code, -1) AS code FROM c LEFT JOIN v ON value = coalesce(c_mktsegment, '{MISSING}')")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes learnt on some rows, -1 for values that those don't have."""
    df = _customer(spark, sf_dir)
    learnt = codes(df.filter("c_custkey % 2 = 0 and coalesce(c_mktsegment, '') <> 'MACHINERY'"), "c_mktsegment")
    return encode_labels(df, "c_mktsegment", learnt, "code").select("c_custkey", "code")


@query("WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey, round(least(1, greatest(0, (o_totalprice - lo) / (hi - lo))), 6) AS scaled FROM orders, b WHERE o_orderkey % 2 = 1")
def min_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values scaled by the bounds of other rows and cut to them."""
    o = table(spark, sf_dir, "orders")
    b = o.filter("o_orderkey % 2 = 0").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).first()
    return o.filter("o_orderkey % 2 = 1").select("o_orderkey", F.round(min_max(F.col("o_totalprice"), F.lit(b.lo), F.lit(b.hi)), 6).alias("scaled"))


@query("SELECT c_custkey, " + ", ".join(f"coalesce((c_mktsegment = '{s}')::INT, 0)::DOUBLE AS is_{s.lower()}" for s in _SEGMENTS) + f" FROM ({_CUSTOMER})")
def one_hot_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column a category."""
    hot = one_hot(F.col("c_mktsegment"), _SEGMENTS)
    return _customer(spark, sf_dir).select("c_custkey", *[h.alias(f"is_{s.lower()}") for s, h in zip(_SEGMENTS, hot, strict=True)])


_SQL_CALENDAR = {"hour": "hour", "minute": "minute", "dow": "isodow", "month": "month", "day_of_month": "day", "week_of_year": "week", "quarter": "quarter"}


@query("SELECT event_id, " + ", ".join(f"{f}(ts)::INT AS {n}" for n, f in _SQL_CALENDAR.items()) + " FROM events")
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven calendar features."""
    return table(spark, sf_dir, "events").select("event_id", *[calendar(F.col("ts"), f).alias(f) for f in CALENDAR])


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS epoch, date_trunc('second', ts) AS back FROM events")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since 1970 and back."""
    df = table(spark, sf_dir, "events").select("event_id", "ts", to_epoch(F.col("ts")).alias("epoch"))
    return df.select("event_id", "epoch", from_epoch(F.col("epoch"), df.schema["ts"].dataType).alias("back"))

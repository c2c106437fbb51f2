"""Sampling, keys, masks and rules between columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions.rng import exact_sample as sample_n
from mirrorframe.operators import repair as R
from mirrorframe.operators.resample import resample
from mirrorframe.operators.trees import key_values
from mirrorframe.plans.model import Column, ColumnType
from mirrorframe.queries.registry import query, sql_uniform, table


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('11:' || o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly 500 rows: the size is what this operator is asked for."""
    return sample_n(table(spark, sf_dir, "orders"), 500, 11, "o_orderkey").select("o_orderkey", "o_totalprice")


@query(f"WITH p AS (SELECT o_totalprice, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT c_custkey AS row_id, o_totalprice, o_orderstatus FROM customer JOIN p ON pos = floor({sql_uniform(3, 'resample', 'c_custkey')} * (SELECT count(*) FROM orders))")
def empirical_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows drawn with replacement."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"))
    return resample(table(spark, sf_dir, "orders"), ["o_orderkey"], ["o_totalprice", "o_orderstatus"], ids, 3, "resample")


_U = "md5('3:key/row_uuid:' || c_custkey::VARCHAR)"


@query(f"SELECT c_custkey AS row_id, (c_custkey + 1)::INT AS id, 'code_' || (c_custkey + 1)::VARCHAR AS code, substr(h, 1, 12) || '4' || substr(h, 14, 3) || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 15) AS row_uuid FROM (SELECT c_custkey, {_U} AS h FROM customer)")
def generate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer, text and UUID keys."""
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"))
    kinds = [("id", T.IntegerType()), ("code", T.StringType()), ("row_uuid", T.StringType())]
    return df.select("row_id", *[key_values(n, k, F.col("row_id"), 3).alias(n) for n, k in kinds])


_EVENTS = "SELECT event_id, ts AS started, ts + INTERVAL 10 MINUTE * (event_id % 3) AS ended, ts - INTERVAL 5 MINUTE * (event_id % 7 - 3) AS other FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("started"), F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(10 * (event_id % 3) as int))").alias("ended"), F.expr("ts - make_interval(0, 0, 0, 0, 0, cast(5 * (event_id % 7 - 3) as int))").alias("other"))


_TIMES = [Column(c, ColumnType.DATETIME) for c in ("started", "ended", "other")]


@query(f"SELECT low, high FROM (SELECT 'started' AS low, 'ended' AS high, bool_and(started <= ended) AS held FROM ({_EVENTS}) UNION ALL SELECT 'started', 'other', bool_and(started <= other) FROM ({_EVENTS}) UNION ALL SELECT 'other', 'started', bool_and(other <= started) FROM ({_EVENTS}) UNION ALL SELECT 'ended', 'other', bool_and(ended <= other) FROM ({_EVENTS}) UNION ALL SELECT 'other', 'ended', bool_and(other <= ended) FROM ({_EVENTS})) WHERE held")
def ordered_pairs_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datetime pairs in one order in every row."""
    return spark.createDataFrame(R.ordered_pairs(_events(spark, sf_dir), _TIMES), "low string, high string")


@query(f"SELECT event_id, started, greatest(started, other) AS other FROM ({_EVENTS})")
def ordered_pairs_enforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later of a pair is moved up."""
    return R.enforce_ordered(_events(spark, sf_dir), [("started", "other")]).select("event_id", "started", "other")


_FLAGS = "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS amount, (event_id % 4 = 0)::INT AS amount_missing, (event_id % 5 = 0)::INT AS is_amount_missing FROM events"


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.when(e % 4 != 0, F.col("value")).alias("amount"), (e % 4 == 0).cast("int").alias("amount_missing"), (e % 5 == 0).cast("int").alias("is_amount_missing"))


@query(f"SELECT source, flag FROM (SELECT 'amount' AS source, 'amount_missing' AS flag, bool_and(amount_missing = (amount IS NULL)::INT) AS held FROM ({_FLAGS}) UNION ALL SELECT 'amount', 'is_amount_missing', bool_and(is_amount_missing = (amount IS NULL)::INT) FROM ({_FLAGS})) WHERE held")
def missing_flag_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that say whether another column is null."""
    df = _flags(spark, sf_dir)
    return spark.createDataFrame(R.missing_flags(df, [Column(c, ColumnType.NUMERIC) for c in df.columns]), "source string, flag string")


@query(f"SELECT event_id, amount, (amount IS NULL)::INT AS is_amount_missing FROM ({_FLAGS})")
def missing_flag_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags set from their sources."""
    return R.repair_flags(_flags(spark, sf_dir), [("amount", "is_amount_missing")]).select("event_id", "amount", "is_amount_missing")


_COUNTS = "SELECT l_orderkey AS k, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, 3::BIGINT AS n_limit FROM lineitem GROUP BY l_orderkey"
_NAMES = ["n_lines", "n_parts", "n_returned", "n_limit"]


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("l_partkey").alias("n_parts"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.lit(3).cast("bigint").alias("n_limit"))


@query("SELECT low, high FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS low, '{b}' AS high, bool_and({a} <= {b}) AS held FROM ({_COUNTS})" for a in _NAMES for b in _NAMES if a != b) + ") WHERE held")
def count_bounds_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that never exceed another."""
    return spark.createDataFrame(R.count_bounds(_counts(spark, sf_dir), [Column(c, ColumnType.NUMERIC) for c in _NAMES]), "low string, high string")


@query(f"SELECT k, least(n_lines, n_limit) AS n_lines, least(n_returned, n_lines, n_limit) AS n_returned FROM ({_COUNTS})")
def count_bounds_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts cut to their bounds, along chains."""
    return R.repair_bounds(_counts(spark, sf_dir), [("n_returned", "n_lines"), ("n_lines", "n_limit")]).select("k", "n_lines", "n_returned")


@query(f"SELECT 'flag is_amount_missing' AS rule, count(*) FILTER (WHERE is_amount_missing <> (amount IS NULL)::INT) AS changed FROM ({_FLAGS})")
def repair_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values a repair changes."""
    return R.changes(_flags(spark, sf_dir), R.Rules(flags=[("amount", "is_amount_missing")]))

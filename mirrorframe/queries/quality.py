"""Fidelity and privacy metrics. Rows with even keys stand for the real table, odd ones for the synthetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.operators import quality as Q
from mirrorframe.plans.model import Column, ColumnType
from mirrorframe.queries.registry import query, table

NUM, CAT, DT, TEXT = ColumnType.NUMERIC, ColumnType.CATEGORICAL, ColumnType.DATETIME, ColumnType.TEXT


def _halves(spark: SparkSession, sf_dir: str, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, name)
    return df.filter(F.col(key) % 2 == 0), df.filter(F.col(key) % 2 == 1)


def _ks_sql(t: str, key: str, c: str, label: str, x: str | None = None) -> str:
    x = x or c
    return f"""SELECT '{label}' AS "column", round(max(abs(cr / nr - cs / ns)), 6) AS score FROM (
SELECT sum(r) OVER (ORDER BY v)::DOUBLE AS cr, sum(s) OVER (ORDER BY v)::DOUBLE AS cs, sum(r) OVER ()::DOUBLE AS nr, sum(s) OVER ()::DOUBLE AS ns FROM (
SELECT ({x})::DOUBLE AS v, count(*) FILTER (WHERE {key} % 2 = 0) AS r, count(*) FILTER (WHERE {key} % 2 = 1) AS s FROM {t} WHERE {x} IS NOT NULL GROUP BY 1))"""


def _tvd_sql(t: str, key: str, c: str) -> str:
    return f"""SELECT '{c}' AS "column", round(0.5 * sum(abs(r / nr - s / ns)), 6) AS score FROM (SELECT r, s, sum(r) OVER ()::DOUBLE AS nr, sum(s) OVER ()::DOUBLE AS ns FROM (
SELECT {c}, count(*) FILTER (WHERE {key} % 2 = 0) AS r, count(*) FILTER (WHERE {key} % 2 = 1) AS s FROM {t} WHERE {c} IS NOT NULL GROUP BY 1))"""


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in (names or ("score",)) else F.col(f"`{c}`") for c in df.columns])


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(_ks_sql("lineitem", "l_orderkey", c, c) for c in _NUMBERS))
def marginal_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kolmogorov-Smirnov distances of four columns."""
    real, synth = _halves(spark, sf_dir, "lineitem", "l_orderkey")
    return _round(Q.ks(real, synth, [(c, F.col(c)) for c in _NUMBERS]).select("column", "score"))


@query(" UNION ALL ".join(_tvd_sql("orders", "o_orderkey", c) for c in ("o_orderstatus", "o_orderpriority")))
def marginal_tvd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total variation distances of two columns."""
    real, synth = _halves(spark, sf_dir, "orders", "o_orderkey")
    return _round(Q.tvd(real, synth, ["o_orderstatus", "o_orderpriority"]).select("column", "score"))


_ORDERS = [Column("o_totalprice", NUM), Column("o_orderdate", DT), Column("o_orderstatus", CAT), Column("o_orderpriority", CAT)]
_EPOCH = "floor(epoch(o_orderdate))"
_MARGINALS = f"""SELECT "column", 'ks' AS metric, score FROM ({_ks_sql('orders', 'o_orderkey', 'o_totalprice', 'o_totalprice')} UNION ALL {_ks_sql('orders', 'o_orderkey', 'o_orderdate', 'o_orderdate', _EPOCH)})
UNION ALL SELECT "column", 'tvd', score FROM ({_tvd_sql('orders', 'o_orderkey', 'o_orderstatus')} UNION ALL {_tvd_sql('orders', 'o_orderkey', 'o_orderpriority')})"""


@query(f'SELECT "column", metric, score, 0.0::DOUBLE AS real_null_rate, 0.0::DOUBLE AS synth_null_rate FROM ({_MARGINALS})')
def marginals_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginals of columns of all types."""
    return _round(Q.marginals(*_halves(spark, sf_dir, "orders", "o_orderkey"), _ORDERS))


@query(f"SELECT round(avg(score), 5) AS avg_marginal FROM ({_MARGINALS})")
def avg_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the marginals."""
    scores = _round(Q.marginals(*_halves(spark, sf_dir, "orders", "o_orderkey"), _ORDERS))
    return Q.average_marginal(scores).select(F.round("avg_marginal", 5).alias("avg_marginal"))


@query("""SELECT 'text' AS "column", round(avg((text IN (SELECT text FROM documents WHERE doc_id % 2 = 0))::INT), 6) AS rate FROM documents WHERE doc_id % 2 = 1""")
def verbatim_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts that the other half has word for word."""
    return _round(Q.verbatim_rate(*_halves(spark, sf_dir, "documents", "doc_id"), "text"), "rate")


@query(" UNION ALL ".join(f"SELECT 'ts' AS \"column\", '{n}' AS feature, score FROM ({_ks_sql('events', 'event_id', 'ts', 'ts', f + '(ts)')})" for n, f in (("hour", "hour"), ("dow", "isodow"), ("month", "month"))))
def calendar_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of calendar features."""
    return _round(Q.calendar_ks(*_halves(spark, sf_dir, "events", "event_id"), [Column("ts", DT)]))


_PAIRS = [(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS score FROM (SELECT nullif(l_quantity, 7) AS l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)" for a, b in _PAIRS) + " UNION ALL SELECT 'l_tax', 'constant', 0.0")
def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute correlations over rows where both are there; a constant correlates with nothing."""
    df = table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.nullif("l_quantity", F.lit(7.0))).withColumn("constant", F.lit(1.0))
    return _round(Q.pearson(df, [*_PAIRS, ("l_tax", "constant")]))


def _v_sql(t: str, a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(sqrt(greatest(0, (sum(n * n / (nx * ny)) - 1) / (least(max(kx), max(ky)) - 1))), 6) AS score FROM (
SELECT n::DOUBLE AS n, sum(n) OVER (PARTITION BY x)::DOUBLE AS nx, sum(n) OVER (PARTITION BY y)::DOUBLE AS ny, (SELECT count(DISTINCT {a}) FROM {t}) AS kx, (SELECT count(DISTINCT {b}) FROM {t}) AS ky FROM (SELECT {a} AS x, {b} AS y, count(*) AS n FROM {t} GROUP BY 1, 2))"""


@query(_v_sql("lineitem", "l_returnflag", "l_linestatus") + " UNION ALL " + _v_sql("lineitem", "l_returnflag", "l_linenumber"))
def cramers_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association of categories."""
    return _round(Q.cramers_v(table(spark, sf_dir, "lineitem"), [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber")]))


def _eta_sql(t: str, a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, round(sqrt(sum(n * (m - (SELECT avg({b}) FROM {t})) ** 2) / (SELECT var_pop({b}) * count(*) FROM {t})), 6) AS score FROM (SELECT count(*) AS n, avg({b}) AS m FROM {t} GROUP BY {a})"


@query(_eta_sql("orders", "o_orderpriority", "o_totalprice") + " UNION ALL " + _eta_sql("orders", "o_orderstatus", "o_totalprice"))
def correlation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Association of categories with a number."""
    return _round(Q.correlation_ratio(table(spark, sf_dir, "orders"), [("o_orderpriority", "o_totalprice"), ("o_orderstatus", "o_totalprice")]))


_PART = [Column("p_brand", CAT), Column("p_type", CAT), Column("p_size", NUM), Column("p_retailprice", NUM)]


def _matrix_sql(t: str) -> str:
    return f"""{_v_sql(t, 'p_brand', 'p_type')} UNION ALL SELECT 'p_size', 'p_retailprice', round(abs(corr(p_size, p_retailprice)), 6) FROM {t}
UNION ALL {_eta_sql(t, 'p_brand', 'p_size')} UNION ALL {_eta_sql(t, 'p_brand', 'p_retailprice')} UNION ALL {_eta_sql(t, 'p_type', 'p_size')} UNION ALL {_eta_sql(t, 'p_type', 'p_retailprice')}"""


@query(_matrix_sql("part"))
def association_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of columns."""
    return _round(Q.associations(table(spark, sf_dir, "part"), _PART))


@query(f"WITH real_part AS (SELECT * FROM part WHERE p_partkey % 2 = 0), synth_part AS (SELECT * FROM part WHERE p_partkey % 2 = 1), r AS ({_matrix_sql('real_part')}), s AS ({_matrix_sql('synth_part')}) SELECT round(sqrt(2 * sum((r.score - s.score) ** 2)) / sqrt(12), 4) AS distance FROM r JOIN s USING (a, b)")
def frobenius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of two association matrices."""
    real, synth = _halves(spark, sf_dir, "part", "p_partkey")
    return Q.frobenius(_round(Q.associations(real, _PART)), _round(Q.associations(synth, _PART)), 4).select(F.round("distance", 4).alias("distance"))


@query("""WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_nationkey) AS nlo, max(c_nationkey) AS nhi FROM customer WHERE c_custkey % 2 = 0),
e AS (SELECT c_custkey, c_mktsegment AS s, least(1, greatest(0, (c_acctbal - lo) / (hi - lo))) AS x, least(1, greatest(0, (c_nationkey - nlo)::DOUBLE / (nhi - nlo))) AS y FROM customer, b),
d AS (SELECT q.c_custkey, sqrt(min((q.x - r.x) ** 2 + (q.y - r.y) ** 2 + CASE WHEN q.s <> r.s THEN 2 ELSE 0 END)) AS distance FROM e q, e r WHERE q.c_custkey % 2 = 1 AND r.c_custkey % 2 = 0 GROUP BY q.c_custkey)
SELECT round(min(distance), 5) AS dcr_min, round(quantile_cont(distance, 0.05), 5) AS dcr_p5, round(quantile_cont(distance, 0.25), 5) AS dcr_p25, round(quantile_cont(distance, 0.5), 5) AS dcr_p50, round(avg(distance), 5) AS dcr_mean FROM d""")
def dcr_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the closest record."""
    real, synth = _halves(spark, sf_dir, "customer", "c_custkey")
    found = Q.distances(real, synth, [Column("c_acctbal", NUM), Column("c_nationkey", NUM), Column("c_mktsegment", CAT)], rows=0)
    return _round(Q.dcr_summary(found).select(*[F.round(c, 5).alias(c) for c in ("dcr_min", "dcr_p5", "dcr_p25", "dcr_p50", "dcr_mean")]))


@query("""SELECT 'o_custkey' AS column_name, 'bigint' AS real_type, 'string' AS synth_type, count(o_custkey) AS real_values, count(o_custkey) FILTER (WHERE o_orderkey % 2 = 0) AS synth_values FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', '<missing>', count(o_orderstatus), 0 FROM orders UNION ALL SELECT 'extra', '<missing>', 'int', 0, count(*) FILTER (WHERE o_orderkey % 2 = 0) FROM orders""")
def dtype_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns whose types differ or that one side lacks, with the values that either side has of them."""
    real = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    synth = real.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.lit(1).alias("extra"))
    found = spark.createDataFrame(Q.dtype_mismatches(real, synth), "column_name string, real_type string, synth_type string")
    values = lambda df: df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "n")
    real_n, synth_n = values(real).withColumnRenamed("n", "real_values"), values(synth).withColumnRenamed("n", "synth_values")
    return found.join(real_n, "column_name", "left").join(synth_n, "column_name", "left").fillna(0, ["real_values", "synth_values"])


_COUNTS = "SELECT l_orderkey AS k, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, CASE WHEN l_orderkey % 2 = 0 THEN count(*) ELSE count(*) - l_orderkey % 5 END AS total_seen FROM lineitem GROUP BY l_orderkey"
_N = ["n_lines", "n_returned", "total_seen"]


@query("SELECT low, high, violations FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS low, '{b}' AS high, count(*) FILTER (WHERE k % 2 = 0 AND {a} > {b}) AS held, count(*) FILTER (WHERE k % 2 = 1 AND {a} > {b}) AS violations FROM ({_COUNTS})" for a in _N for b in _N if a != b) + ") WHERE held = 0 AND violations > 0")
def invariant_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders between counts that hold in one half and not in the other."""
    k = F.col("l_orderkey")
    df = table(spark, sf_dir, "lineitem").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    df = df.withColumn("total_seen", F.when(F.col("k") % 2 == 0, F.col("n_lines")).otherwise(F.col("n_lines") - F.col("k") % 5))
    return Q.invariant_drift(df.filter("k % 2 = 0"), df.filter("k % 2 = 1"), [Column(c, NUM) for c in _N])

"""Schema inference, cleaning and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.operators.relations import child_counts, draw_counts, expand, key_counts, orphans, prune
from mirrorframe.plans.infer import infer_table, is_key_name, stats_of
from mirrorframe.plans.model import Dataset, Reference, Table
from mirrorframe.queries.registry import query, sql_bits, table
from mirrorframe.sources.normalize import promotions, trim

#: Physical kinds of the columns that the SQL of infer_types is written for.
_KINDS = {
    "customer": {"c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "num", "c_mktsegment": "str"},
    "events": {"event_id": "int", "ts": "ts", "user_id": "int", "event_type": "str", "value": "num", "props": "str"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
    "part": {"p_partkey": "int", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int", "p_retailprice": "num"},
}


def _type_sql(t: str, c: str, kind: str) -> str:
    key = is_key_name(c)
    d = f"count(DISTINCT {c})"
    if kind == "ts":
        rule = "'datetime'"
    elif kind == "str":
        ratio = f"({d}::DOUBLE / greatest(count({c}), 1))"
        rule = f"CASE WHEN {key} AND count(*) > 0 AND count({c}) = count(*) AND {d} = count(*) THEN 'key' WHEN {ratio} > 0.5 THEN 'text' WHEN {d} <= 50 OR {ratio} <= 0.05 THEN 'categorical' ELSE 'text' END"
    else:
        flag = f"WHEN min({c}) = 0 AND max({c}) = 1 AND {d} = 2 THEN 'categorical' " if kind == "int" else ""
        rule = f"CASE WHEN {key} AND count(*) > 0 AND {d} + CASE WHEN count({c}) < count(*) THEN 1 ELSE 0 END = count(*) THEN 'key' {flag}ELSE 'numeric' END"
    return f"SELECT '{t}' AS table_name, '{c}' AS column_name, {rule} AS type, count({c}) < count(*) AS nullable FROM {t}"


@query(" UNION ALL ".join(_type_sql(t, c, k) for t, own in _KINDS.items() for c, k in own.items()))
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic types of four tables."""
    rows = [(t, c.name, str(c.type), c.nullable) for t in _KINDS for c in infer_table(t, table(spark, sf_dir, t)).columns]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, nullable boolean")


@query("SELECT 'o_orderstatus' AS column_name, count(*) AS n_rows, count(o_orderstatus) AS n_nonnull, count(DISTINCT o_orderstatus) AS n_distinct FROM orders UNION ALL SELECT 'o_orderpriority', count(*), count(nullif(o_orderpriority, '5-LOW')), count(DISTINCT nullif(o_orderpriority, '5-LOW')) FROM orders")
def infer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts behind the rules, with nulls put in."""
    df = table(spark, sf_dir, "orders").select("o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"))
    return spark.createDataFrame([(c, s["rows"], s["nonnull"], s["distinct"]) for c, s in stats_of(df).items()], "column_name string, n_rows bigint, n_nonnull bigint, n_distinct bigint")


@query("SELECT event_type AS value, list_sort(list(DISTINCT event_type))[1] IS NOT NULL AS listed FROM events GROUP BY event_type")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of an inferred column."""
    found = infer_table("events", table(spark, sf_dir, "events"))["event_type"].categories
    return spark.createDataFrame([(v, True) for v in found], "value string, listed boolean")


_NULLS = "'?', 'NA', 'N/A', 'na', 'n/a', 'none', 'None', 'NULL', 'null', ''"
_DIRTY = "CASE WHEN p_size % 7 = 0 THEN ' ? ' WHEN p_size % 11 = 0 THEN 'N/A' ELSE '  ' || p_brand || chr(9) END"


@query(f"SELECT p_partkey, CASE WHEN t IN ({_NULLS}) THEN NULL ELSE t END AS brand FROM (SELECT p_partkey, regexp_replace({_DIRTY}, '^\\s+|\\s+$', '', 'g') AS t FROM part)")
def normalize_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimming and null texts."""
    dirty = F.when(F.col("p_size") % 7 == 0, " ? ").when(F.col("p_size") % 11 == 0, "N/A").otherwise(F.concat(F.lit("  "), "p_brand", F.lit("\t")))
    return trim(table(spark, sf_dir, "part").select("p_partkey", dirty.alias("brand")))


def _promoted(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, CASE WHEN count({c}) = count(CASE WHEN regexp_full_match({c}, '[+-]?[0-9]+') THEN try_cast({c} AS BIGINT) END) THEN 'bigint'
WHEN count({c}) = count(try_cast({c} AS DOUBLE)) THEN 'double' WHEN count({c}) = count(CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ].*)?$') THEN try_cast({c} AS TIMESTAMP) END) THEN 'timestamp_ntz' ELSE 'string' END AS type FROM s"""


@query("WITH s AS (SELECT o_orderkey::VARCHAR AS k, o_totalprice::VARCHAR AS p, o_orderdate::DATE::VARCHAR AS d, o_orderpriority AS x FROM orders) " + " UNION ALL ".join(_promoted(c) for c in "kpdx"))
def promote_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that text columns can take."""
    o = table(spark, sf_dir, "orders")
    s = o.select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("string").alias("p"), F.col("o_orderdate").cast("date").cast("string").alias("d"), F.col("o_orderpriority").alias("x"))
    found = promotions(s)
    return spark.createDataFrame([(c, found.get(c, "string")) for c in s.columns], "column_name string, type string")


@query("SELECT count(*) AS rows, count(o_orderkey) AS nonnull, count(DISTINCT o_orderkey) AS distinct_keys FROM orders")
def pk_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, non-null and distinct keys."""
    return key_counts(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY l_orderkey")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of orders that are gone."""
    left = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", left, "o_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS key, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def child_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of every order, 0 included."""
    return child_counts(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT key, unnest(generate_series(1, n))::BIGINT AS child_no FROM (SELECT c_custkey AS key, (c_custkey % 4)::BIGINT AS n FROM customer) WHERE n > 0")
def fk_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents repeated once a child."""
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 4).alias("n"))
    return expand(parents, "n").select("key", F.col("child_no").cast("bigint").alias("child_no"))


@query(f"""WITH counts AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey),
pool AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS pos FROM counts)
SELECT s_suppkey AS key, pool.n FROM supplier JOIN pool ON pos = floor({sql_bits(5, "children", "s_suppkey")} / 281474976710656.0 * (SELECT count(*) FROM counts))""")
def draw_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child counts drawn from the observed ones for new parents."""
    counts = child_counts(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")
    return draw_counts(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), counts, 5, "children", "key").select("key", "n")


@query("""WITH c AS (SELECT * FROM customer WHERE c_acctbal > 5000), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS table_name, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def prune_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left in three tables after the first is filtered."""
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}
    refers = {"customer": (), "orders": (Reference("o_custkey", "customer", "c_custkey"),), "lineitem": (Reference("l_orderkey", "orders", "o_orderkey"),)}
    data = Dataset({n: Table(n, [], None, d, refers[n]) for n, d in frames.items()})
    left = prune(data, frames | {"customer": frames["customer"].filter("c_acctbal > 5000")})
    parts = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n, d in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

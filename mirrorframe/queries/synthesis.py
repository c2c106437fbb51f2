"""Generation. Values depend on fitted trees; queries named *_contract return what must hold of them, which SQL takes from the real tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.operators.constraints import Range, Where
from mirrorframe.operators.hierarchy import HierarchySynthesizer
from mirrorframe.operators.pipeline import generate
from mirrorframe.operators.quality import average_marginal, marginals
from mirrorframe.plans.infer import infer_table
from mirrorframe.operators.trees import TreeSynthesizer
from mirrorframe.plans.model import Column, ColumnType, Dataset, Reference, Table
from mirrorframe.plans.stages import staged
from mirrorframe.queries.registry import query, sql_uniform, table


def _orders(spark: SparkSession, sf_dir: str) -> Table:
    found = infer_table("orders", table(spark, sf_dir, "orders"))
    columns = [Column(c.name, ColumnType.KEY) if c.name == "o_orderkey" else c for c in found.columns]
    return Table("orders", columns, "o_orderkey", found.data)


@query()
def cart_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many synthetic orders as there are real ones."""
    source = _orders(spark, sf_dir)
    return generate(source, source.data.count(), seed=42, fit_rows=0, strip_pii=False).data.drop("row_id")


@query()
def cart_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean marginal of synthetic events against the real ones."""
    source = infer_table("events", table(spark, sf_dir, "events"))
    made = generate(source, source.data.count(), seed=42, fit_rows=0, strip_pii=False)
    return average_marginal(marginals(source.data, staged(made.data, "made"), source.columns))


@query()
def reject_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic orders under constraints, half as many as the real table has of them."""
    source = _orders(spark, sf_dir)
    n = source.data.filter("o_totalprice <= 200000 and o_orderstatus = 'F'").count() // 4
    made = generate(source, max(n, 1), seed=7, fit_rows=0, constraints=[Range("o_totalprice", 0, 200000), Where("o_orderstatus == 'F'")], max_oversample=60.0, strip_pii=False)
    return made.data.drop("row_id")


def _linked(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    customer = infer_table("customer", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"))
    orders = infer_table("orders", table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    data = Dataset({"customer": Table("customer", customer.columns, "c_custkey", customer.data), "orders": Table("orders", orders.columns, "o_orderkey", orders.data, (Reference("o_custkey", "customer", "c_custkey"),))})
    return HierarchySynthesizer(42).fit(data, fit_rows=0).sample(spark, {"customer": customer.data.count()})


@query()
def multi_table_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic customers with their orders; one row per order."""
    made = _linked(spark, sf_dir)
    return made["orders"].join(made["customer"], F.col("o_custkey") == F.col("c_custkey"))


@query("SELECT DISTINCT o_orderstatus, n AS rows, n AS keys, 1::BIGINT AS least_key, n AS largest_key, 0::BIGINT AS unseen_prices, 0::BIGINT AS unseen_dates FROM orders, (SELECT count(*) AS n FROM orders)")
def cart_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of as many synthetic orders as real ones: the levels of a category, numbers of rows and of different keys, and values that no real order has."""
    made, real = cart_generate(spark, sf_dir), table(spark, sf_dir, "orders")
    made = staged(made, "made")
    one = lambda x: made.agg(x).scalar()
    unseen = lambda c: made.select(c).join(real.select(c).distinct(), c, "left_anti").agg(F.count(F.lit(1))).scalar()
    of_keys = [one(f("o_orderkey")).alias(k) for k, f in (("keys", F.count_distinct), ("least_key", F.min), ("largest_key", F.max))]
    return made.select("o_orderstatus").distinct().select("o_orderstatus", one(F.count(F.lit(1))).alias("rows"), *of_keys, unseen("o_totalprice").alias("unseen_prices"), unseen("o_orderdate").alias("unseen_dates"))


_BAND = "least(floor(o_totalprice / 100000), 4)"


@query(f"SELECT n AS rows, band, true AS related, true AS share_near FROM (SELECT DISTINCT {_BAND}::BIGINT::VARCHAR AS band FROM orders), (SELECT count(*) AS n FROM orders)")
def conditional_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of as many synthetic rows as orders, with a price and its band: bands, whether 90% of a band's prices lie in it (drawn alone a fifth would; MLlib's 128 bins mix at most two of a band's 25), and whether its share is within 0.03 of the real one."""
    data = table(spark, sf_dir, "orders").select("o_totalprice", F.expr(_BAND).cast("bigint").cast("string").alias("band"))
    source = infer_table("prices", data)
    model = TreeSynthesizer(5).fit(source, fit_rows=0)
    made = staged(model.sample(spark, data.count()), "made")
    share = lambda df, name: df.groupBy("band").agg((F.count(F.lit(1)) / df.agg(F.count(F.lit(1))).scalar()).alias(name))
    right = made.groupBy("band").agg((F.avg((F.expr(_BAND).cast("bigint").cast("string") == F.col("band")).cast("double")) >= 0.9).alias("related"))
    both = right.join(share(made, "made_share"), "band").join(share(data, "real_share"), "band")
    return both.select(made.agg(F.count(F.lit(1))).scalar().alias("rows"), "band", "related", (F.abs(F.col("made_share") - F.col("real_share")) <= 0.03).alias("share_near"))


@query("SELECT count(*) > 0 AS near, 5::BIGINT AS columns FROM events")
def fidelity_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether synthetic events stay within 0.05 on the mean marginal, and the number of columns compared."""
    source = infer_table("events", table(spark, sf_dir, "events"))
    made = generate(source, source.data.count(), seed=42, fit_rows=0, strip_pii=False)
    found = staged(marginals(source.data, staged(made.data, "made"), source.columns), "marginals")
    return average_marginal(found).select((F.col("avg_marginal") <= 0.05).alias("near"), found.agg(F.count(F.lit(1))).scalar().alias("columns"))


@query("SELECT greatest(count(*) FILTER (WHERE o_totalprice <= 200000 AND o_orderstatus = 'F') // 4, 1)::BIGINT AS rows, 0::BIGINT AS violations, greatest(count(*) FILTER (WHERE o_totalprice <= 200000 AND o_orderstatus = 'F') // 4, 1)::BIGINT AS keys FROM orders")
def reject_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, violations and different keys of synthetic orders under constraints."""
    broken = ~F.coalesce(F.col("o_totalprice").between(0, 200000) & (F.col("o_orderstatus") == "F"), F.lit(False))
    return reject_resample(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"), F.count_if(broken).alias("violations"), F.count_distinct("o_orderkey").alias("keys"))


@query("""SELECT count(*) AS parents, 0::BIGINT AS orphans, true AS keys_differ, true AS as_many_children, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS levels FROM customer""")
def multi_table_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of synthetic customers and orders: parents, orders without one, whether keys are unique, whether children per parent are within a quarter of the real mean, and levels of a category."""
    made = _linked(spark, sf_dir)
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    real = count(table(spark, sf_dir, "orders"))
    orphans = count(made["orders"].join(made["customer"].hint("merge"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"))
    own = made["orders"].agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderkey").alias("keys"), F.count_distinct("o_orderstatus").alias("levels"))
    return own.select(count(made["customer"]).alias("parents"), orphans.alias("orphans"), (F.col("rows") == F.col("keys")).alias("keys_differ"), (F.abs(F.col("rows") - real) <= real / 4).alias("as_many_children"), "levels")


@query("""WITH v AS (SELECT l_quantity AS x, count(*) AS n, sum(l_extendedprice) AS s, sum(l_extendedprice * l_extendedprice) AS q FROM lineitem GROUP BY 1),
c AS (SELECT x, lead(x) OVER w AS later, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(q) OVER w AS ql, sum(n) OVER () AS n, sum(s) OVER () AS s, sum(q) OVER () AS q FROM v WINDOW w AS (ORDER BY x)),
g AS (SELECT (x + later) / 2 AS split, nl, ((q - s * s / n) - (ql - sl * sl / nl) - ((q - ql) - (s - sl) * (s - sl) / (n - nl))) / n AS gain FROM c WHERE nl < n)
SELECT split::DOUBLE AS split, nl::BIGINT AS n_left FROM g ORDER BY gain DESC, split LIMIT 1""")
def cart_best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root split of the tree that is fitted for prices on quantities, and how many rows it sends left."""
    data = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    columns = [Column(c, ColumnType.NUMERIC) for c in data.columns]
    model = TreeSynthesizer(0, max_depth=1).fit(Table("lineitem", columns, None, data), fit_rows=0)
    split = model.fitted[1].tree.filter("node = 0").first().cut
    return data.agg(F.lit(split).alias("split"), F.count_if(F.col("l_quantity") <= split).alias("n_left"))


@query(f"SELECT row_id, {sql_uniform(9, 'sample/balance/null', 'row_id')} < (SELECT count(*) FILTER (WHERE c_acctbal < 0) / count(*) FROM customer) AS is_null FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer)")
def null_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of as many synthetic rows as customers are null in a column that is null where a balance is negative."""
    data = table(spark, sf_dir, "customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    model = TreeSynthesizer(9).fit(Table("customer", [Column("balance", ColumnType.NUMERIC, nullable=True)], None, data), fit_rows=0)
    return model.sample(spark, data.count()).select("row_id", F.col("balance").isNull().alias("is_null"))

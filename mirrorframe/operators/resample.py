"""Empirical resampling with replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions.ranges import positions, running_total
from mirrorframe.functions.rng import below


def value_pool(df: DataFrame, column: str) -> DataFrame:
    """(value, first, last): the values of a column in ascending order with the places each takes among all rows."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(counts, ["value"], F.col("_n"), "_upto")
    return upto.select("value", (F.col("_upto") - F.col("_n")).alias("first"), (F.col("_upto") - 1).alias("last"))


def resample(pool: DataFrame, order: list[str], columns: list[str], ids: DataFrame, seed: int, stream: str) -> DataFrame:
    """For each row_id in ids, the columns of a pool row drawn with replacement."""
    numbered = positions(pool, order).select("pos", *columns)
    n = pool.count()
    return ids.withColumn("pos", below(seed, stream, F.col("row_id"), n)).join(numbered, "pos").drop("pos")

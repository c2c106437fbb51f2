"""Numbering and running totals over a global order, range by range: no window sees more rows than a range of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mirrorframe.plans.stages import staged


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos: the place from 0 of each row in the order given. Ranges are numbered side by side, each from where the one before ended."""
    return running_total(df, order, F.lit(1), "pos").withColumn("pos", F.col("pos") - 1)


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the total of value (whole numbers) over all rows up to each one in the order given. Ranges are summed side by side; a row a range meets in one task."""
    ranged = staged(df.repartitionByRange(*order).withColumns({"_part": F.spark_partition_id(), "_value": value.cast("long")}), "ranges")
    sums = ranged.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_value").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.join(before, "_part").withColumn(name, (own + F.col("_before")).cast("long")).drop("_part", "_before", "_value")

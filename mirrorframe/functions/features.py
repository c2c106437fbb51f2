"""Feature encoding: imputation, label codes, calendar features, epochs, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions.ranges import positions

#: Stands for a missing category.
MISSING = "__mf_missing__"


class SentinelError(ValueError):
    """A column holds the text that stands for a missing value."""


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c.cast("double")), None).otherwise(c)


def null_rate(c: Column) -> Column:
    """Aggregate: share of rows that are null."""
    return F.avg(c.isNull().cast("double"))


def median(c: Column) -> Column:
    """Aggregate: exact median of the non-null, non-NaN values; 0 if there are none."""
    return F.coalesce(F.percentile(nan_to_null(c.cast("double")), F.lit(0.5)), F.lit(0.0))


def impute(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and NaN of numeric columns replaced by the column's median, as doubles."""
    at = df.agg(*[median(F.col(c)).alias(c) for c in columns])
    out = df.crossJoin(F.broadcast(at.select(*[F.col(c).alias(f"_m_{c}") for c in columns])))  # one row
    return out.select(*[F.coalesce(nan_to_null(F.col(c).cast("double")), F.col(f"_m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_missing(df: DataFrame, column: str) -> DataFrame:
    """Nulls of a category replaced by MISSING; a real value of that text is an error."""
    if df.filter(F.col(column).cast("string") == MISSING).limit(1).count():
        raise SentinelError(f"{column} holds {MISSING!r}")
    return df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit(MISSING)))


def codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the rank of each distinct value in ascending order, from 0."""
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("value")).distinct()
    return positions(values, ["value"]).withColumnRenamed("pos", "code")


def encode_labels(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """Adds the code of each value, -1 for one that the table doesn't have."""
    key = F.coalesce(F.col(column).cast("string"), F.lit(MISSING))
    return df.withColumn("_v", key).join(table.select(F.col("value").alias("_v"), F.col("code").alias("_c")), "_v", "left").withColumn(out, F.coalesce("_c", F.lit(-1)).cast("long")).drop("_v", "_c")


_CALENDAR = {"hour": F.hour, "minute": F.minute, "dow": lambda c: F.weekday(c) + 1, "month": F.month, "day_of_month": F.dayofmonth, "week_of_year": F.weekofyear, "quarter": F.quarter}


def calendar(c: Column, feature: str, kind: T.DataType | None = None) -> Column:
    """A calendar feature of a date or timestamp; ISO weekdays 1 to 7 and ISO weeks. Null for null."""
    if feature not in _CALENDAR:
        raise ValueError(f"unknown calendar feature {feature!r}")
    if isinstance(kind, T.DateType) and feature in ("hour", "minute"):
        raise TypeError(f"a date has no {feature}")
    return _CALENDAR[feature](c).cast("int")


def to_epoch(c: Column) -> Column:
    """Seconds since 1970 in UTC; fractions are dropped."""
    return F.unix_timestamp(c.cast("timestamp")).cast("long")


def from_epoch(c: Column, kind: T.DataType) -> Column:
    """The inverse, in the type of the source column."""
    return F.timestamp_seconds(c).cast(kind)


def min_max(c: Column, low: Column, high: Column) -> Column:
    """Scaled to 0 to 1 by the given bounds and cut to them; 0 where the bounds are equal."""
    span = high - low
    return F.when(span == 0, F.when(c.isNull(), None).otherwise(F.lit(0.0))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(c - low, span))))


def one_hot(c: Column, categories: list) -> list[Column]:
    """One 0/1 double per category."""
    return [F.coalesce((c == F.lit(v)).cast("double"), F.lit(0.0)) for v in categories]

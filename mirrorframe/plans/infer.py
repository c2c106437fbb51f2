"""Semantic types from one aggregate pass over a table."""

from __future__ import annotations

import re

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions.features import codes
from mirrorframe.plans.model import Column, ColumnType, Table, is_datetime, is_integral, is_numeric
from mirrorframe.plans.stages import staged

#: A string column is text above this share of distinct values, and a category with at most so many distinct values or so low a share.
TEXT_RATIO = 0.5
MAX_CATEGORIES = 50
CATEGORY_RATIO = 0.05
#: Relative error of sketched distinct counts, and how many of it a count is trusted within.
SKETCH_ERROR = 0.02
SURE = 6
#: Levels of a category up to which they are listed with the column; more stay in a table.
MOST_LISTED = 1000


def is_key_name(name: str) -> bool:
    """id, uuid, *_id, *_key in any case, or camel case that ends in Id or ID."""
    low = name.lower()
    return low in ("id", "uuid") or low.endswith(("_id", "_key")) or name.endswith(("Id", "ID"))


def is_count_name(name: str) -> bool:
    """NUM_*, N_*, TOTAL_*, *_COUNT or *_COUNT_* in any case."""
    return bool(re.match(r"(NUM_|N_|TOTAL_)|.*_COUNT(_|$)", name.upper()))


def stats_of(df: DataFrame, *, sketched: bool = False) -> dict[str, dict]:
    """Per column: rows, nonnull, distinct (where a rule needs it), low and high for numbers. One job.

    Distinct counts of numbers only matter for key-like names, and of strings always. They are exact; sketched ones have a relative error of about SKETCH_ERROR, and the scan keeps
    one row: exact counts of many columns send every row once a column.
    """
    aggs: list[SparkColumn] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"nonnull_{i}"))
        if is_numeric(f.dataType):
            aggs += [F.min(c).cast("double").alias(f"low_{i}"), F.max(c).cast("double").alias(f"high_{i}")]
            aggs.append(F.count_if(~c.cast("double").isin(0.0, 1.0)).alias(f"other_{i}"))
        if _counted(f):
            aggs.append((F.approx_count_distinct(c, SKETCH_ERROR) if sketched else F.count_distinct(_short(f))).alias(f"distinct_{i}"))
    row = df.agg(*aggs).first().asDict()
    names = ("nonnull", "low", "high", "other", "distinct")
    return {f.name: {"rows": row["rows"], **{k: row.get(f"{k}_{i}") for k in names}} for i, f in enumerate(df.schema.fields)}


def _counted(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.StringType) or is_numeric(f.dataType) and is_key_name(f.name)


def _short(f: T.StructField) -> SparkColumn:
    c = F.col(f"`{f.name}`")
    return F.when(F.length(c) > 32, F.md5(c)).otherwise(c) if isinstance(f.dataType, T.StringType) else c  # whole texts aren't shuffled


def verified_stats(df: DataFrame) -> dict[str, dict]:
    """stats_of with sketched distinct counts, but exact ones of the columns whose type, or listing of levels, the error of the sketch could change."""
    stats = stats_of(df, sketched=True)
    open_ = [f for f in df.schema.fields if _counted(f) and _undecided(f, stats[f.name])]
    if open_:
        row = df.agg(*[F.count_distinct(_short(f)).alias(f"d{i}") for i, f in enumerate(open_)]).first()
        for i, f in enumerate(open_):
            stats[f.name]["distinct"] = row[f"d{i}"]
    return stats


def _undecided(f: T.StructField, s: dict) -> bool:
    """Whether a distinct count anywhere within SURE errors of the sketched one would be judged otherwise."""
    low, high = (int(s["distinct"] * (1 + sign * SURE * SKETCH_ERROR)) for sign in (-1, 1))
    # Counts beyond what there are don't occur; the rules change at these values alone
    high = min(high + 1, s["nonnull"] + (is_numeric(f.dataType) and s["nonnull"] < s["rows"]))
    edges = [low, high, *(x for x in (MAX_CATEGORIES, MAX_CATEGORIES + 1, MOST_LISTED, MOST_LISTED + 1, s["rows"], s["rows"] - 1) if low <= x <= high)]
    return len({(classify(f.name, f.dataType, {**s, "distinct": x}), x <= MOST_LISTED) for x in edges}) > 1


def classify(name: str, kind: T.DataType, s: dict) -> ColumnType:
    """The rules over a column's stats. A null counts as a value of a numeric key, and disqualifies none; strings must be unique among non-nulls of a column without nulls."""
    rows, nonnull, distinct = s["rows"], s["nonnull"], s["distinct"] or 0
    if is_datetime(kind):
        return ColumnType.DATETIME
    if isinstance(kind, T.BooleanType):
        return ColumnType.CATEGORICAL
    if is_numeric(kind):
        if is_key_name(name) and rows > 0 and distinct + (nonnull < rows) == rows:
            return ColumnType.KEY
        flag = is_integral(kind) and nonnull > 0 and s["other"] == 0 and (s["low"], s["high"]) == (0.0, 1.0)
        return ColumnType.CATEGORICAL if flag else ColumnType.NUMERIC
    if isinstance(kind, T.StringType):
        if is_key_name(name) and rows > 0 and nonnull == rows and distinct == rows:
            return ColumnType.KEY
        ratio = distinct / max(nonnull, 1)
        return ColumnType.CATEGORICAL if ratio <= TEXT_RATIO and (distinct <= MAX_CATEGORIES or ratio <= CATEGORY_RATIO) else ColumnType.TEXT
    return ColumnType.TEXT


def infer_table(name: str, df: DataFrame) -> Table:
    """A Table with inferred columns; the first key in input order is the primary key. The driver gets the levels of a category up to MOST_LISTED; the dictionary of one with more is written as a table."""
    stats = verified_stats(df)
    kinds = {f.name: classify(f.name, f.dataType, stats[f.name]) for f in df.schema.fields}
    levelled = [f for f in df.schema.fields if kinds[f.name] is ColumnType.CATEGORICAL and not isinstance(f.dataType, T.BooleanType)]
    listed = [f for f in levelled if (stats[f.name]["distinct"] or 0) <= MOST_LISTED]
    found = df.agg(*[F.sort_array(F.collect_set(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(listed)]).first() if listed else None
    categories = {f.name: tuple(found[f"c{i}"]) for i, f in enumerate(listed)}
    wide = {f.name: level_table(df, f.name) for f in levelled if f not in listed}
    columns = []
    for f in df.schema.fields:
        c = (False, True) if isinstance(f.dataType, T.BooleanType) else categories.get(f.name)
        columns.append(Column(f.name, kinds[f.name], nullable=stats[f.name]["nonnull"] < stats[f.name]["rows"], categories=c, levels=wide.get(f.name)))
    return Table(name, columns, next((c.name for c in columns if c.type is ColumnType.KEY), None), df)


def level_table(df: DataFrame, column: str) -> DataFrame:
    """(value, code) of the levels of a column as a written table; nulls have none. Codes go by range, without one task for all levels."""
    c = F.col(f"`{column}`")
    return staged(codes(df.filter(c.isNotNull()).select(c.alias("c")), "c"), "levels")

"""Structure between columns: ordered datetimes, flags of missing values, bounds between counts. Detected on the real table, enforced on the synthetic one."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.operators.orders import orders
from mirrorframe.plans.infer import is_count_name
from mirrorframe.plans.model import Column, ColumnType, is_integral, is_numeric

PASSES = 3
#: Pairs beyond which orders are found by a matrix.
WIDE = 60


@dataclass
class Rules:
    """(low, high) datetimes, (source, flag) missing flags, (low, high) counts."""

    ordered: list[tuple[str, str]] = field(default_factory=list)
    flags: list[tuple[str, str]] = field(default_factory=list)
    bounds: list[tuple[str, str]] = field(default_factory=list)


def always(df: DataFrame, pairs: list[tuple[str, str]]) -> list[bool]:
    """For each pair whether low <= high in every row where both are there, and there is such a row. One pass; many pairs of one type go by a matrix, not by an expression each."""
    if not pairs:
        return []
    names = list(dict.fromkeys(c for p in pairs for c in p))
    if len(pairs) > WIDE and len({df.schema[c].dataType for c in names}) == 1:
        broken, met = orders(df, names)
        at = {c: k for k, c in enumerate(names)}
        return [bool(met[at[a], at[b]] and not broken[at[a], at[b]]) for a, b in pairs]
    a, b = (lambda p: F.col(f"`{p[0]}`")), (lambda p: F.col(f"`{p[1]}`"))
    row = df.agg(*[F.coalesce(F.bool_and(a(p) <= b(p)), F.lit(False)).alias(f"v{i}") for i, p in enumerate(pairs)]).first()
    return [row[f"v{i}"] for i in range(len(pairs))]


def ordered_pairs(df: DataFrame, columns: list[Column]) -> list[tuple[str, str]]:
    """Datetime pairs in one order in every row, in either direction; the first direction that holds counts."""
    own = [c.name for c in columns if c.type is ColumnType.DATETIME]
    pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
    held = always(df, pairs + [(b, a) for a, b in pairs])
    n = len(pairs)
    return [(a, b) if held[i] else (b, a) for i, (a, b) in enumerate(pairs) if held[i] or held[n + i]]


def enforce_ordered(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """High becomes low where it lies before it."""
    for low, high in pairs:
        a, b = F.col(f"`{low}`"), F.col(f"`{high}`")
        df = df.withColumn(high, F.when(a.isNotNull() & b.isNotNull() & (b < a), a).otherwise(b))
    return df


def flag_source(flag: str, names: list[str]) -> list[str]:
    """Columns that a name like X_missing, X_missing_suffix or is_X_missing can refer to."""
    up, by = flag.upper(), {n.upper(): n for n in names}
    found = []
    if m := re.fullmatch(r"IS_(.+)_MISSING", up):
        found.append(m[1])
    if m := re.fullmatch(r"(.+)_MISSING(_.+)?", up):
        found += [m[1] + (m[2] or ""), m[1]]
    return [by[x] for x in dict.fromkeys(found) if x in by and by[x] != flag]


def missing_flags(df: DataFrame, columns: list[Column]) -> list[tuple[str, str]]:
    """(source, flag) where the flag equals the source being null in every row. One pass for all candidates."""
    names, kinds = [c.name for c in columns], {f.name: f.dataType for f in df.schema.fields}
    pairs = [(s, c.name) for c in columns if is_numeric(kinds[c.name]) or kinds[c.name].simpleString() == "boolean" for s in flag_source(c.name, names)]
    if not pairs:
        return []
    row = df.agg(*[F.coalesce(F.bool_and(F.coalesce(F.col(f"`{f}`").cast("int") == F.col(f"`{s}`").isNull().cast("int"), F.lit(False))), F.lit(False)).alias(f"v{i}") for i, (s, f) in enumerate(pairs)]).first()
    out: dict[str, str] = {}
    for i, (s, f) in enumerate(pairs):
        if row[f"v{i}"] and f not in out:
            out[f] = s
    return [(s, f) for f, s in out.items()]


def repair_flags(df: DataFrame, flags: list[tuple[str, str]]) -> DataFrame:
    """Flags set from their sources."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({f: F.col(f"`{s}`").isNull().cast("int").cast(kinds[f]) for s, f in flags}) if flags else df


def count_bounds(df: DataFrame, columns: list[Column]) -> list[tuple[str, str]]:
    """(low, high) of integer count columns with low <= high in every row where both are there."""
    own = [c.name for c in columns if c.type is ColumnType.NUMERIC and is_count_name(c.name) and is_integral(df.schema[c.name].dataType)]
    pairs = [(a, b) for a in own for b in own if a != b]
    return [p for p, held in zip(pairs, always(df, pairs), strict=True) if held]


def repair_bounds(df: DataFrame, bounds: list[tuple[str, str]]) -> DataFrame:
    """Low becomes high where it exceeds it; some passes, as bounds chain."""
    for _ in range(PASSES if bounds else 0):
        for low, high in bounds:
            a, b = F.col(f"`{low}`"), F.col(f"`{high}`")
            df = df.withColumn(low, F.when(a > b, b.cast(df.schema[low].dataType)).otherwise(a))
    return df


def detect(df: DataFrame, columns: list[Column]) -> Rules:
    own = [c for c in columns if c.name in df.columns]
    return Rules(ordered_pairs(df, own), missing_flags(df, own), count_bounds(df, own))


def repair(df: DataFrame, rules: Rules) -> DataFrame:
    """Flags and bounds; ordered pairs are enforced while sampling."""
    return repair_bounds(repair_flags(df, rules.flags), rules.bounds)


def changes(before: DataFrame, rules: Rules) -> DataFrame:
    """(rule, changed): values that each repair changes. One pass."""
    items = [(f"flag {f}", F.coalesce(F.col(f"`{f}`").cast("int") != F.col(f"`{s}`").isNull().cast("int"), F.lit(True))) for s, f in rules.flags]
    items += [(f"bound {a} <= {b}", F.coalesce(F.col(f"`{a}`") > F.col(f"`{b}`"), F.lit(False))) for a, b in rules.bounds]
    items += [(f"order {a} <= {b}", F.coalesce(F.col(f"`{a}`") > F.col(f"`{b}`"), F.lit(False))) for a, b in rules.ordered]
    if not items:
        return before.sparkSession.createDataFrame([], "rule string, changed bigint")
    row = before.agg(*[F.count_if(x).alias(f"v{i}") for i, (_, x) in enumerate(items)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"v{i}").alias("changed")) for i, (n, _) in enumerate(items)])))

"""Fidelity and privacy of a synthetic table against the real one. Every metric is a DataFrame; the report is assembled from a few rows."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mirrorframe.functions.features import calendar, finite, to_epoch
from mirrorframe.functions.rng import exact_sample, row_identity
from mirrorframe.operators.gram import correlations
from mirrorframe.operators.nearest import nearest
from mirrorframe.operators.orders import orders
from mirrorframe.plans.infer import is_count_name
from mirrorframe.plans.model import Column, ColumnType, calendar_of, is_integral
from mirrorframe.plans.stages import staged

#: Rows of each side that distance to closest record compares by default: the metric's own sample size.
DCR_ROWS = 50_000
#: Numeric columns beyond which correlations go by matrices instead of expressions, four a pair.
WIDE = 12


def _sides(real: DataFrame, synth: DataFrame, values: list[tuple[str, SparkColumn]]) -> DataFrame:
    """Long form: side (0 real, 1 synthetic), column, value (double). Non-finite values are dropped. One scan of each table."""
    def long(df: DataFrame, side: int) -> DataFrame:
        parts = [F.struct(F.lit(name).alias("column"), c.try_cast("double").alias("value")) for name, c in values]
        return df.select(F.inline(F.array(*parts))).filter(finite(F.col("value"))).withColumn("side", F.lit(side))

    return long(real, 0).unionByName(long(synth, 1))


@dataclass(frozen=True)
class Counted:
    """What the marginals need of a real table, as written tables: (column, value, n) of its numbers and categories, its distinct texts by column, and (column, rate) of its nulls."""

    numbers: DataFrame
    categories: DataFrame
    texts: dict[str, DataFrame]
    rates: DataFrame


def _long(df: DataFrame, parts: list[tuple[str, SparkColumn]]) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(name).alias("column"), c.alias("value")) for name, c in parts])))


def _with_known(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """(column, value, r, s) from counts of the real side and rows of the other."""
    own = fresh.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    both = known.select("column", "value", F.col("n").alias("r"), F.lit(0).cast("long").alias("s")).unionByName(own.select("column", "value", F.lit(0).cast("long").alias("r"), F.col("n").alias("s")))
    return both.groupBy("column", "value").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))


def ks(real: DataFrame, synth: DataFrame, values: list[tuple[str, SparkColumn]], known: DataFrame | None = None) -> DataFrame:
    """(column, score): the largest difference of the two distribution functions, for all columns at once; NaN if a side is empty.

    Values are counted first. The running shares then go by value ranges of each column: ranges are cut by a hash-free rule (a column's quantile grid),
    so a column of many distinct values spreads over tasks.
    """
    names = [n for n, _ in values]
    if not names:
        return real.sparkSession.createDataFrame([], "column string, score double")
    counts = _sides(real, synth, values).groupBy("column", "value").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("s"))
    if known is not None:
        counts = _with_known(known, _long(synth, [(n, c.try_cast("double")) for n, c in values]).filter(finite(F.col("value"))))
    counts = staged(counts, "ks-counts")
    grid = counts.groupBy("column").agg(F.percentile_approx("value", F.array(*[F.lit(i / 64) for i in range(1, 64)]), 1000).alias("grid"), F.sum("r").alias("n_r"), F.sum("s").alias("n_s"))
    cut = counts.join(F.broadcast(grid), "column")  # one row a column
    cut = cut.withColumn("range", F.size(F.filter("grid", lambda g: g < F.col("value")))).drop("grid")
    totals = cut.groupBy("column", "range").agg(F.sum("r").alias("tr"), F.sum("s").alias("ts"))
    before = W.partitionBy("column").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("column", "range", F.coalesce(F.sum("tr").over(before), F.lit(0)).alias("br"), F.coalesce(F.sum("ts").over(before), F.lit(0)).alias("bs"))
    inside = W.partitionBy("column", "range").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    run = cut.join(totals, ["column", "range"]).withColumn("cr", F.col("br") + F.sum("r").over(inside)).withColumn("cs", F.col("bs") + F.sum("s").over(inside))
    score = F.max(F.abs(F.try_divide(F.col("cr").cast("double"), F.col("n_r")) - F.try_divide(F.col("cs").cast("double"), F.col("n_s"))))
    found = run.groupBy("column").agg(score.alias("score"), F.min("n_r").alias("n_r"), F.min("n_s").alias("n_s"))
    every = real.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("column"))
    empty = F.col("n_r").isNull() | (F.col("n_r") == 0) | (F.col("n_s") == 0)
    return every.join(found, "column", "left").select("column", F.when(empty, F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))


def tvd(real: DataFrame, synth: DataFrame, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """(column, score): half the summed differences of category shares, for all columns at once; NaN if a side has no values."""
    if not columns:
        return real.sparkSession.createDataFrame([], "column string, score double")

    def long(df: DataFrame, side: int) -> DataFrame:
        parts = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
        return df.select(F.inline(F.array(*parts))).filter("value is not null").withColumn("side", F.lit(side))

    both = long(real, 0).unionByName(long(synth, 1))
    counts = both.groupBy("column", "value").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("s"))
    if known is not None:
        counts = _with_known(known, long(synth, 1))
    counts = staged(counts, "tvd-counts")
    totals = counts.groupBy("column").agg(F.sum("r").alias("n_r"), F.sum("s").alias("n_s"))
    gap = F.abs(F.try_divide(F.col("r").cast("double"), F.col("n_r")) - F.try_divide(F.col("s").cast("double"), F.col("n_s")))
    found = counts.join(F.broadcast(totals), "column").groupBy("column").agg((F.sum(gap) * 0.5).alias("score"), F.min("n_r").alias("n_r"), F.min("n_s").alias("n_s"))
    every = real.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column"))
    empty = F.col("n_r").isNull() | (F.col("n_r") == 0) | (F.col("n_s") == 0)
    return every.join(found, "column", "left").select("column", F.when(empty, F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))


def verbatim_rate(real: DataFrame, synth: DataFrame, column: str) -> DataFrame:
    """(column, rate): share of the synthetic non-null texts that the real table has; null without any. Texts meet by hash-partitioned semi join."""
    known = real.filter(F.col(column).isNotNull()).select(F.col(column).alias("_known")).distinct()
    per_text = synth.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    marked = per_text.join(known.withColumn("_hit", F.lit(True)), per_text.text == F.col("_known"), "left")
    return marked.agg(F.lit(column).alias("column"), F.try_divide(F.sum(F.when(F.col("_hit"), F.col("n")).otherwise(0)).cast("double"), F.sum("n")).alias("rate")).select("column", "rate")


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, rate) in one pass."""
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"r{i}") for i, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("rate")) for i, c in enumerate(columns)])))


def _numbers(columns: list[Column]) -> list[tuple[str, SparkColumn]]:
    return [(c.name, F.col(f"`{c.name}`") if c.type is ColumnType.NUMERIC else to_epoch(F.col(f"`{c.name}`"))) for c in columns if c.type in (ColumnType.NUMERIC, ColumnType.DATETIME)]


def counted(real: DataFrame, columns: list[Column]) -> Counted:
    """The real side of marginals, counted once for many comparisons."""
    own = [c for c in columns if c.type is not ColumnType.KEY]
    count = lambda df: staged(df.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "known-counts")
    none = real.sparkSession.createDataFrame([], "column string, value double"), real.sparkSession.createDataFrame([], "column string, value string")
    numbers, categories = _numbers(own), [(c.name, F.col(f"`{c.name}`").cast("string")) for c in own if c.type is ColumnType.CATEGORICAL]
    return Counted(
        count(_long(real, [(n, c.try_cast("double")) for n, c in numbers]).filter(finite(F.col("value"))) if numbers else none[0]),
        count(_long(real, categories).filter("value is not null") if categories else none[1]),
        {c.name: staged(real.select(F.col(f"`{c.name}`")).distinct(), "known-texts") for c in own if c.type is ColumnType.TEXT},
        staged(null_rates(real, [c.name for c in own]), "known-rates") if own else none[0].select("column", F.col("value").alias("rate")),
    )


def marginals(real: DataFrame, synth: DataFrame, columns: list[Column], known: Counted | None = None) -> DataFrame:
    """(column, metric, score, real_null_rate, synth_null_rate) of every column but keys: KS for numbers and datetimes, TVD for categories, verbatim rate for texts. known: of real and at least these columns, which is then not read."""
    own = [c for c in columns if c.type is not ColumnType.KEY and c.name in synth.columns]
    of = lambda table, kinds: table.filter(F.col("column").isin([c.name for c in own if c.type in kinds])) if known else None
    numbers, categories = of(known and known.numbers, (ColumnType.NUMERIC, ColumnType.DATETIME)), of(known and known.categories, (ColumnType.CATEGORICAL,))
    out = ks(real, synth, _numbers(own), numbers).withColumn("metric", F.lit("ks")).unionByName(tvd(real, synth, [c.name for c in own if c.type is ColumnType.CATEGORICAL], categories).withColumn("metric", F.lit("tvd")))
    for c in own:
        if c.type is ColumnType.TEXT:
            out = out.unionByName(verbatim_rate(known.texts[c.name] if known else real, synth, c.name).select("column", F.col("rate").alias("score"), F.lit("verbatim").alias("metric")))
    names = [c.name for c in own]
    if not names:
        return out.select("column", "metric", "score", F.lit(None).cast("double").alias("real_null_rate"), F.lit(None).cast("double").alias("synth_null_rate"))
    of_real = known.rates if known else null_rates(real, names)
    rates = of_real.withColumnRenamed("rate", "real_null_rate").join(null_rates(synth, names).withColumnRenamed("rate", "synth_null_rate"), "column")
    return out.join(F.broadcast(rates), "column").select("column", "metric", "score", "real_null_rate", "synth_null_rate")


def average_marginal(scores: DataFrame) -> DataFrame:
    """(avg_marginal): mean of the finite KS and TVD scores, 0 without any."""
    return scores.filter(F.col("metric").isin("ks", "tvd") & finite(F.col("score"))).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_marginal"))


def calendar_ks(real: DataFrame, synth: DataFrame, columns: list[Column]) -> DataFrame:
    """(column, feature, score) for each calendar feature of each datetime; the default set where a column's own is disabled."""
    values = []
    for c in columns:
        if c.type is ColumnType.DATETIME and c.name in synth.columns:
            kind = real.schema[c.name].dataType
            for f in calendar_of(c, kind) or calendar_of(Column(c.name, c.type), kind):
                values.append((f"{c.name}\t{f}", calendar(F.col(f"`{c.name}`"), f, kind)))
    cut = F.split("column", "\t")
    return ks(real, synth, values).select(cut[0].alias("column"), cut[1].alias("feature"), "score")


def pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, score): absolute correlation of each pair over the rows where both are finite; 0 where either is constant or fewer than 2 rows. One pass for all pairs."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
        ok = finite(x) & finite(y)
        x, y = F.when(ok, x), F.when(ok, y)
        aggs += [F.count(x).alias(f"n{i}"), F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"x{i}"), F.stddev_pop(y).alias(f"y{i}")]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, score double")
    row = df.agg(*aggs)
    score = lambda i: F.when((F.col(f"n{i}") < 2) | (F.col(f"x{i}") == 0) | (F.col(f"y{i}") == 0), F.lit(0.0)).otherwise(F.abs(F.try_divide(F.col(f"c{i}"), F.col(f"x{i}") * F.col(f"y{i}"))))
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(score(i), F.lit(0.0)).alias("score")) for i, (a, b) in enumerate(pairs)])))


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, score) of category pairs, without corrections; 0 where a side has fewer than 2 levels. Contingency counts of all pairs in one pass, in long form."""
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, score double")
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").cast("string").alias("x"), F.col(f"`{b}`").cast("string").alias("y")) for a, b in pairs]
    cells = staged(df.select(F.inline(F.array(*parts))).filter("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")), "cells")
    rows = cells.groupBy("a", "b", "x").agg(F.sum("n").alias("nx"))
    cols = cells.groupBy("a", "b", "y").agg(F.sum("n").alias("ny"))
    shape = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("kx"), F.sum("nx").alias("total")).join(cols.groupBy("a", "b").agg(F.count(F.lit(1)).alias("ky")), ["a", "b"])
    # chi2 / n = sum n_xy^2 / (n_x n_y) - 1, and only cells with counts matter
    ratio = cells.join(rows, ["a", "b", "x"]).join(cols, ["a", "b", "y"]).groupBy("a", "b").agg((F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))) - 1).alias("phi2"))
    found = shape.join(ratio, ["a", "b"]).select("a", "b", F.when((F.col("kx") < 2) | (F.col("ky") < 2), F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("phi2"), F.least("kx", "ky") - 1)))).alias("score"))
    every = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])))
    return every.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"))


def correlation_ratio(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, score) of (category, number) pairs: the root of the share of variance between categories."""
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, score double")
    parts = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").cast("string").alias("x"), F.col(f"`{b}`").cast("double").alias("y")) for a, b in pairs]
    long = df.select(F.inline(F.array(*parts))).filter(F.col("x").isNotNull() & finite(F.col("y")))
    groups = long.groupBy("a", "b", "x").agg(F.count("y").cast("double").alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v"))
    overall = groups.groupBy("a", "b").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    joined = groups.join(F.broadcast(overall), ["a", "b"])
    between = F.sum(F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean")))
    found = joined.groupBy("a", "b").agg(between.alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.min("total").alias("total"))
    score = F.when(F.col("total") < 2, F.lit(0.0)).otherwise(F.coalesce(F.sqrt(F.try_divide(F.col("between"), F.col("between") + F.col("within"))), F.lit(0.0)))
    every = df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])))
    return every.join(found.select("a", "b", score.alias("score")), ["a", "b"], "left").select("a", "b", F.coalesce("score", F.lit(0.0)).alias("score"))


def associations(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(a, b, score) for every pair of modelled columns in table order: correlation, Cramer's V or correlation ratio by their types. Datetimes count as numbers."""
    own = [c for c in columns if c.type in (ColumnType.NUMERIC, ColumnType.DATETIME, ColumnType.CATEGORICAL)]
    df = df.select(*[to_epoch(F.col(f"`{c.name}`")).alias(c.name) if c.type is ColumnType.DATETIME else F.col(f"`{c.name}`") for c in own]) if own else df
    number = {c.name: c.type is not ColumnType.CATEGORICAL for c in own}
    names = [c.name for c in own]
    every = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    mixed = [(a, b) if not number[a] else (b, a) for a, b in every if number[a] != number[b]]
    numbers = [c for c in names if number[c]]
    out = correlations(df, numbers) if len(numbers) > WIDE else pearson(df, [(a, b) for a, b in every if number[a] and number[b]])
    out = out.unionByName(cramers_v(df, [(a, b) for a, b in every if not number[a] and not number[b]]))
    return out.unionByName(correlation_ratio(df, mixed))


def frobenius(real: DataFrame, synth: DataFrame, n_columns: int) -> DataFrame:
    """(distance): of two association lists with unit diagonals, divided by the root of twice the number of pairs; 0 for fewer than 2 columns."""
    pairs = n_columns * (n_columns - 1) // 2
    both = real.join(synth.withColumnRenamed("score", "other"), ["a", "b"])
    gap = F.coalesce(F.sum((F.col("score") - F.col("other")) * (F.col("score") - F.col("other"))), F.lit(0.0))
    return both.agg((F.sqrt(gap * 2.0) / math.sqrt(2 * pairs) if pairs else F.lit(0.0)).alias("distance"))


def _features(real: DataFrame, columns: list[Column]) -> list[tuple[Column, SparkColumn]]:
    return [(c, to_epoch(F.col(f"`{c.name}`")).cast("double") if c.type is ColumnType.DATETIME else F.col(f"`{c.name}`").cast("double") if c.type is ColumnType.NUMERIC else F.col(f"`{c.name}`").cast("string")) for c in columns if c.type in (ColumnType.NUMERIC, ColumnType.DATETIME, ColumnType.CATEGORICAL)]


def distances(real: DataFrame, synth: DataFrame, columns: list[Column], *, rows: int = DCR_ROWS, seed: int = 0, real_key: SparkColumn | None = None, synth_key: SparkColumn | None = None) -> DataFrame:
    """(distance, cells) of each sampled synthetic row to its closest sampled real row; with rows=0 of all synthetic rows to all real ones. cells: how many cells of real rows it was compared with.

    Numbers are scaled by the real bounds and cut to 0 to 1, nulls take the real median; a different category adds 2 to the squared
    distance, as one-hot columns do. Equal rows of a side are compared once.
    """
    own = [(c, x) for c, x in _features(real, columns) if c.name in synth.columns]
    numbers, categories = [(c, x) for c, x in own if c.type is not ColumnType.CATEGORICAL], [(c, x) for c, x in own if c.type is ColumnType.CATEGORICAL]
    if rows:
        real = exact_sample(real, rows, seed, real_key if real_key is not None else row_identity(real))
        synth = exact_sample(synth, rows, seed + 1, synth_key if synth_key is not None else row_identity(synth))
    real = staged(real, "dcr-real")
    low_high = real.agg(*[f(F.when(finite(x), x)).alias(f"{k}{i}") for i, (_, x) in enumerate(numbers) for k, f in (("l", F.min), ("h", F.max), ("m", F.median))], F.count(F.lit(1)).alias("n")).first()
    if not low_high["n"] or not own:
        return synth.sparkSession.createDataFrame([], "distance double, cells long")

    def encode(df: DataFrame) -> DataFrame:
        out = []
        for i, (_, x) in enumerate(numbers):
            low, high, mid = (float(low_high[f"{k}{i}"] if low_high[f"{k}{i}"] is not None else 0.0) for k in "lhm")
            span = high - low
            filled = F.when(finite(x), x).otherwise(F.lit(mid))
            out.append(F.lit(0.0) if span == 0 else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (filled - low) / span)))
        hashed = [F.xxhash64(F.coalesce(x, F.lit("\0"))) for _, x in categories]
        return df.select(F.array(*out).cast("array<double>").alias("x"), F.array(*hashed).cast("array<bigint>").alias("c"))

    # Numbered once and written, so that the numbers stay
    asked = staged(encode(synth).groupBy("x", "c").agg(F.count(F.lit(1)).alias("times")).withColumn("id", F.monotonically_increasing_id()), "dcr-synth")
    found = nearest(staged(encode(real).distinct(), "dcr-known"), asked, len(numbers), len(categories))
    return asked.select("id", "times").join(found, "id").select("distance", "cells", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("distance", "cells")


def dcr_summary(found: DataFrame) -> DataFrame:
    """(dcr_min, dcr_p5, dcr_p25, dcr_p50, dcr_mean); NaN without rows."""
    p = F.percentile("distance", F.array(F.lit(0.05), F.lit(0.25), F.lit(0.5)))
    row = found.agg(F.min("distance").alias("dcr_min"), p.alias("p"), F.avg("distance").alias("dcr_mean"))
    nan = F.lit(float("nan"))
    return row.select(F.coalesce("dcr_min", nan).alias("dcr_min"), *[F.coalesce(F.col("p")[i], nan).alias(n) for i, n in enumerate(("dcr_p5", "dcr_p25", "dcr_p50"))], F.coalesce("dcr_mean", nan).alias("dcr_mean"))


def dtype_mismatches(real: DataFrame, synth: DataFrame) -> list[tuple[str, str, str]]:
    """(column, real type, synthetic type) where they differ; <missing> for a column that one side lacks."""
    a, b = dict(real.dtypes), dict(synth.dtypes)
    return [(c, a.get(c, "<missing>"), b.get(c, "<missing>")) for c in [*a, *(x for x in b if x not in a)] if a.get(c) != b.get(c)]


def invariant_drift(real: DataFrame, synth: DataFrame, columns: list[Column], top: int = 50) -> DataFrame:
    """(low, high, violations): pairs of integer count columns with low <= high in every real row and not in every synthetic one, worst first."""
    own = [c.name for c in columns if c.type is ColumnType.NUMERIC and is_count_name(c.name) and c.name in synth.columns and is_integral(real.schema[c.name].dataType)]
    pairs = [(a, b) for a in own for b in own if a != b]
    if len(own) > WIDE and len({real.schema[c].dataType for c in own}) == 1:  # those that hold in the real rows are few
        broken, _ = orders(real, own)
        pairs = [(own[i], own[j]) for i, j in np.argwhere(~broken).tolist()]
    if not pairs:
        return real.sparkSession.createDataFrame([], "low string, high string, violations bigint")

    def broken(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(*[F.count_if(F.col(f"`{a}`") > F.col(f"`{b}`")).alias(f"v{i}") for i, (a, b) in enumerate(pairs)])
        return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), F.col(f"v{i}").alias(name)) for i, (a, b) in enumerate(pairs)])))

    both = broken(real, "held").join(broken(synth, "violations"), ["low", "high"])
    return both.filter("held = 0 and violations > 0").select("low", "high", "violations").orderBy(F.desc("violations"), "low", "high").limit(top)


@dataclass
class QualityReport:
    """What a comparison found; the metrics' own rows, few in number."""

    marginals: list[dict] = field(default_factory=list)
    calendar: list[dict] = field(default_factory=list)
    avg_marginal: float = 0.0
    correlation_distance: float = 0.0
    associations_real: list[dict] = field(default_factory=list)
    associations_synth: list[dict] = field(default_factory=list)
    dcr: dict[str, float] = field(default_factory=dict)
    dtype_mismatches: list[tuple[str, str, str]] = field(default_factory=list)
    invariants: list[dict] = field(default_factory=list)
    n_real: int = 0
    n_synth: int = 0

    def worst(self, n: int = 10) -> list[dict]:
        """Marginals by score, largest first, those without a number last."""
        bad = lambda m: m["score"] is None or not math.isfinite(m["score"])
        return sorted(self.marginals, key=lambda m: (bad(m), 0 if bad(m) else -m["score"], m["column"]))[:n]


def compare(real: DataFrame, synth: DataFrame, columns: list[Column], *, dcr_rows: int = DCR_ROWS, seed: int = 0) -> QualityReport:
    """All metrics. Each family is a job or two over both tables."""
    shared = [c for c in columns if c.name in synth.columns and dict(synth.dtypes)[c.name] == dict(real.dtypes)[c.name]]
    scores = staged(marginals(real, synth, shared), "marginals")
    rows = lambda df: [r.asDict() for r in df.collect()]  # noqa: E731  a row a column or pair
    modelled = [c for c in shared if c.type in (ColumnType.NUMERIC, ColumnType.DATETIME, ColumnType.CATEGORICAL)]
    a, b = staged(associations(real, modelled), "assoc"), staged(associations(synth, modelled), "assoc")
    others = [{"column": c, "metric": "dtype", "score": float("nan"), "real_null_rate": None, "synth_null_rate": None} for c, _, _ in dtype_mismatches(real, synth)]
    return QualityReport(
        marginals=rows(scores) + others,
        calendar=rows(calendar_ks(real, synth, shared)),
        avg_marginal=average_marginal(scores).first()[0],
        correlation_distance=frobenius(a, b, len(modelled)).first()[0],
        associations_real=rows(a),
        associations_synth=rows(b),
        dcr=dcr_summary(distances(real, synth, modelled, rows=dcr_rows, seed=seed)).first().asDict(),
        dtype_mismatches=dtype_mismatches(real, synth),
        invariants=rows(invariant_drift(real, synth, shared)),
        n_real=real.count(),
        n_synth=synth.count(),
    )

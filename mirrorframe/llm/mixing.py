"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every document is shuffled inside its source by a seeded hash. Its virtual finish time is the number of
tokens of its source up to and including it, divided by the source's target. Ordering all documents by
finish time serves each source at the rate of its target; the mix is the prefix of that order that
fits the total budget. A source may be passed through up to `cap` times, so each document has `cap`
candidate copies.

Scale: only (id, source, size) move. Prefix sums are two-level. Rows go to hash buckets of about
sqrt(n) rows inside each source (so a hot source is spread over many tasks), bucket totals are
cumulated in one small window, and each bucket is cumulated on its own. The global order uses buckets
of equal width in virtual time in the same way; equal widths hold nearly equal numbers of tokens since every
source proceeds at a constant rate.

Defined results: null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last
in order; identical rows each get a row and are taken alike; documents of equal hash go by id and size; very long texts
are single documents like others; an empty table gives an empty result; other columns are ignored by the plan and kept by the mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mirrorframe.llm.common import WORD, column_or_null, free_name, keyed, stage, table


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: int) -> DataFrame:
    """One row per source: rank, source_size, n, target.

    Sources in code point order (null last) take the weights in turn and share `share` of all sizes. A target
    stops at `cap` times its source's size and the excess is shared by weight again: with the sources in ascending
    order of cap over weight, the capped ones are a prefix, and the common level of the others is
    the largest of the levels that the prefixes leave. The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    every = W.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", F.row_number().over(order)).withColumn("w", w)
    per = per.withColumn("most", F.col("source_size") * float(cap)).withColumn("budget", F.sum("source_size").over(every) * share)
    rising = W.orderBy(F.col("most") / F.col("w"), "rank")
    before = F.coalesce(F.sum("most").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing))
    per = per.withColumn("level", (F.col("budget") - before) / left).withColumn("level", F.max("level").over(every))
    return per.select("source", "rank", "source_size", "n", F.least("most", F.col("w") * F.col("level")).alias("target"))


def _prefix(df: DataFrame, keys: list[str], bucket: str, order: list[Column | str], size: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `size` over the rows up to and including this one, ordered by bucket and `order` inside each `keys`."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(size).alias("_sum"))
    over = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    own = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.join(totals, [*keys, bucket]).withColumn(out, F.col("_before") + F.sum(size).over(own)).drop("_before")


def weighted_mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, seed: int = 17
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies (how often the mix takes it), taken, and first_finish, the virtual finish time of its first copy."""
    sizes = docs.select(
        column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, source_col, "string").alias("source"), F.regexp_count(F.coalesce(column_or_null(docs, text_col, "string"), F.lit("")), F.lit(WORD)).cast("long").alias("size")
    )
    sizes = stage(sizes, "mix-sizes")
    targets = stage(source_targets(sizes, weights, share, cap), "mix-targets")
    n, total = targets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    budget, bucket_rows = math.floor(total * share), max(256, math.isqrt(n))

    docs_t = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("d.id", "d.source", "d.size", "t.rank", "t.source_size", "t.n", "t.target")
    # 60 bits of MD5, which SQL engines share
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "size")
    docs_t = docs_t.withColumn("h", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")).withColumn("b", F.floor(F.col("h") / float(1 << 60) * F.ceil(F.col("n") / bucket_rows)))
    docs_t = stage(_prefix(docs_t, ["rank"], "b", ["h", "id", "size"], "size", "served").drop("b", "n"), "mix-served")

    finish = F.when(F.col("target") > 0, (F.col("served") + F.col("epoch") * F.col("source_size")) / F.col("target")).otherwise(0.0)
    copies = docs_t.select("rank", "h", "id", "size", "served", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("epoch")).withColumn("finish", finish)
    width = max(1, math.ceil(cap * n / bucket_rows))
    copies = copies.select("rank", "h", "id", "size", "finish", "epoch", F.floor(F.col("finish") * width).alias("g"))
    # The place where the budget ends: first the bucket of virtual time, then the copy inside it.
    order = ["finish", "rank", "epoch", "h", "id", "size"]
    totals = copies.groupBy("g").agg(F.sum("size").alias("_sum"))
    totals = totals.withColumn("_upto", F.sum("_sum").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, 0)))
    cut = totals.filter(F.col("_upto") > budget).agg(F.min(F.struct("g", (F.col("_upto") - F.col("_sum")).alias("before"))).alias("c")).first().c
    taken: Column = F.lit(0)
    for e in range(cap):
        at = F.when(F.col("target") > 0, (F.col("served") + F.lit(e) * F.col("source_size")) / F.col("target")).otherwise(0.0)
        if cut is None:
            last = None
        elif e == 0:
            inside = copies.filter(F.col("g") == cut.g)
            upto = F.sum("size").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) + cut.before
            first_out = inside.withColumn("_upto", upto).filter(F.col("_upto") > budget)
            last = first_out.agg(F.min(F.struct("finish", "rank", "epoch", "h", "id")).alias("x")).first().x
        if cut is None:
            taken = taken + F.lit(1)
        else:
            here = F.struct(at.alias("finish"), F.col("rank"), F.lit(e).alias("epoch"), F.col("h"), F.col("id"))
            stop = F.struct(F.lit(last.finish).alias("finish"), F.lit(last["rank"]).alias("rank"), F.lit(last.epoch).alias("epoch"), F.lit(last.h).alias("h"), F.lit(last.id).cast("long").alias("id"))
            taken = taken + F.when(here < stop, 1).otherwise(0)
    first_finish = F.when(F.col("target") > 0, F.col("served") / F.col("target")).otherwise(0.0)
    return docs_t.select("id", "source", "size", "source_size", "target", taken.alias("copies"), first_finish.alias("first_finish")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of the mix with the columns of docs, each as often as the mix takes it, range-sorted by virtual finish time. Rows that repeat an id are documents of their own."""
    key = free_name(docs, "_row")
    rows, _ = keyed(docs, id_col, key)
    plan = weighted_mix(rows, id_col=key, **how).filter("copies > 0")
    rate = F.try_divide("target", "source_size")
    plan = plan.select("id", F.struct("copies", "first_finish", rate.alias("rate")).alias("plan"))
    held, epoch, at = (free_name(docs, x) for x in ("_plan", "_epoch", "_at"))
    out = rows.join(plan.select(F.col("id").alias(key), F.col("plan").alias(held)), key)
    out = out.withColumn(epoch, F.explode(F.sequence(F.lit(0), F.col(held)["copies"] - 1)))
    out = out.withColumn(at, F.col(held)["first_finish"] + F.coalesce(F.try_divide(F.col(epoch), F.col(held)["rate"]), F.lit(0.0)))
    return out.repartitionByRange(at, key).sortWithinPartitions(at, key).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the mix of all documents at weights 3, 1, 2 and 150% of all words."""
    mix = weighted_mix(table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: The whole queue in SQL: one global order, without buckets.
ORACLE = rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s GROUP BY source),
weighed AS (SELECT *, list_extract([3.0::DOUBLE, 1.0, 2.0], ((rank - 1) % 3 + 1)::INT) AS w, source_size * 2.0::DOUBLE AS most, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM per),
levels AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY most / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, rank, source_size, budget, least(most, w * max(level) OVER ()) AS target FROM levels),
placed AS (SELECT doc_id, size, rank, source_size, target, budget, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT AS h FROM s JOIN targets ON s.source IS NOT DISTINCT FROM targets.source),
served AS (SELECT *, (sum(size) OVER (PARTITION BY rank ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS served FROM placed),
copies AS (SELECT *, CASE WHEN target > 0 THEN (served + epoch * source_size)::DOUBLE / target ELSE 0 END AS finish FROM served, (VALUES (0), (1)) e(epoch)),
queued AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, epoch, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM copies)
SELECT doc_id, size, source_size, target, (count(*) FILTER (WHERE upto <= floor(budget)) * size)::BIGINT AS taken FROM queued GROUP BY doc_id, size, source_size, target
"""

"""Keys and foreign keys: checks, child counts, expansion, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions.rng import below
from mirrorframe.plans.model import Dataset


class IntegrityError(ValueError):
    """A key is null or repeats, or a foreign key points nowhere."""


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, nonnull, distinct_keys."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count(key).alias("nonnull"), F.count_distinct(key).alias("distinct_keys"))


def check_primary_key(name: str, df: DataFrame, key: str) -> None:
    row = key_counts(df, key).first()
    if row.nonnull < row["rows"]:
        raise IntegrityError(f"{name}.{key} has {row['rows'] - row.nonnull} nulls")
    if row.distinct_keys < row["rows"]:
        raise IntegrityError(f"{name}.{key} isn't unique")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of the child whose non-null key the parent doesn't have."""
    known = parent.select(F.col(pk).alias("_pk"))
    return child.filter(F.col(fk).isNotNull()).join(known, F.col(fk) == F.col("_pk"), "left_anti")


def check_foreign_key(child_name: str, child: DataFrame, fk: str, parent: DataFrame, pk: str) -> None:
    lost = orphans(child, fk, parent, pk)
    row = lost.agg(F.count(F.lit(1)).alias("n")).first()
    if row.n:
        some = [r[0] for r in lost.select(fk).distinct().orderBy(fk).limit(5).collect()]
        raise IntegrityError(f"FK violation: {row.n} rows of {child_name}.{fk} have no parent, for example {some}")


def child_counts(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """(key, n): children of each parent, 0 included; null keys of children don't count."""
    per = child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("n"))
    return parent.select(F.col(pk).alias("key")).join(per, F.col("key") == F.col("_fk"), "left").select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def expand(parents: DataFrame, n: str) -> DataFrame:
    """Each parent row once per child, with child_no from 1; none for 0."""
    return parents.filter(F.col(n) > 0).withColumn("child_no", F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))


def draw_counts(parents: DataFrame, counts: DataFrame, seed: int, stream: str, key: str) -> DataFrame:
    """Adds n: the child count at a drawn place among all observed ones in ascending order. Places are numbered and joined by equality; never broadcast, as counts are small files of any number of rows."""
    from mirrorframe.functions.ranges import positions

    numbered = positions(counts.select("n"), ["n"]).select(F.col("pos").alias("_at"), "n")
    return parents.withColumn("_at", below(seed, stream, F.col(key), counts.count())).join(numbered.hint("merge"), "_at").drop("_at")


def prune(dataset: Dataset, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Children whose parent is gone are dropped, table after table; null keys stay."""
    out = dict(tables)
    for name in dataset.topological_order():
        for r in dataset.tables[name].references:
            keys = out[r.table].select(F.col(r.key).alias("_pk")).distinct()
            kept = out[name].filter(F.col(r.column).isNotNull()).join(keys, F.col(r.column) == F.col("_pk"), "left_semi")
            out[name] = kept.unionByName(out[name].filter(F.col(r.column).isNull()))
    return out

"""What several operators share: reading tables, stage tables in the shared folder, row keys and word patterns."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.plans.stages import new_path, ship, staged

__all__ = ["WORD", "column_or_null", "free_name", "give_back", "keyed", "new_path", "released", "remembered", "ship", "stage", "table"]

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Write to the shared folder and read back.
stage = staged
#: What operators remember in a worker process, by module.
_REMEMBERED: dict[str, dict] = {}


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks and stages, and an executor pays for what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def remembered(module: str) -> dict:
    """What the operators of a module remember in this process, from task to task."""
    return _REMEMBERED.setdefault(module, {})


def forget_others(module: str) -> None:
    """Drop what operators of other modules remember here: the worker that served one stage serves the next, and all of an executor's workers count."""
    for other in _REMEMBERED.keys() - {module}:
        del _REMEMBERED[other]


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that drops what other operators remember before its task, and gives memory back when that is done."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        forget_others(run.__module__)
        yield from run(batches)
        give_back()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a scale factor folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column, or a typed null where the table has none of that name."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one with underscores in front that the table has no column of (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keyed(docs: DataFrame, id_col: str, key: str, *, nulls_first: bool = False) -> tuple[DataFrame, bool]:
    """docs with a column `key` (long) that no two rows share and that ascends with the ids, and whether the ids themselves serve as keys.

    They do where they are unique and not null. Else rows are range-sorted by id (nulls last by default; rows of one
    id in the order of a hash of the row without its maps), numbered and written, so that the numbers stay.
    """
    ids = docs.select(column_or_null(docs, id_col, "long").alias("id"))
    if not ids.groupBy("id").count().filter("count > 1 or id is null").limit(1).count():
        return docs.withColumn(key, column_or_null(docs, id_col, "long")), True
    own, tie = free_name(docs, "_own"), free_name(docs, "_tie")
    row = docs.withColumns({own: column_or_null(docs, id_col, "long"), tie: F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])})
    order = [F.col(own).asc_nulls_first() if nulls_first else F.col(own).asc_nulls_last(), F.col(tie)]
    dealt = row.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(dealt.withColumn(key, F.monotonically_increasing_id()).select(*[F.col(f"`{c}`") for c in docs.columns], key), "keyed"), False

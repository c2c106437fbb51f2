"""Counter-based random numbers: functions of (seed, stream, id), so no result depends on how rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bits48(seed: int, stream: str, key: Column) -> Column:
    """A 48-bit integer (long)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{stream}:"), key.cast("string"))), 1, 12), 16, 10).cast("long")


def uniform(seed: int, stream: str, key: Column) -> Column:
    """A double in [0, 1)."""
    return bits48(seed, stream, key) / F.lit(float(1 << 48))


def below(seed: int, stream: str, key: Column, n: Column | int) -> Column:
    """A long in [0, n)."""
    return F.floor(uniform(seed, stream, key) * n)


def exact_sample(df: DataFrame, n: int, seed: int, key: Column | str) -> DataFrame:
    """Exactly n rows (all if there are fewer) without replacement, by the order of a hash of key.

    n is the caller's cap, not the size of the data. A bound on the hash, a little above the share that n needs of the rows counted, keeps
    tasks from sending more rows than that to the one that orders them; where it is too low by chance it is dropped.
    """
    key = F.col(key) if isinstance(key, str) else key
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    share = (n + 6 * n**0.5 + 10) / max(df.count(), 1)
    if share < 1:
        some = df.filter(h < f"{int(share * (1 << 48)):012x}")
        df = some if some.count() >= n else df
    return df.orderBy(h, key).limit(n)


def row_identity(df: DataFrame) -> Column:
    """A text that stands for a row's content, for tables without a key; nulls differ from every value."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def uuid4_hex(seed: int, stream: str, key: Column) -> Column:
    """32 hex digits with the version and variant of a random UUID."""
    h = F.md5(F.concat(F.lit(f"{seed}:{stream}:"), key.cast("string")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 12), F.lit("4"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))

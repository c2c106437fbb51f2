"""Cleaning of text columns after a file scan: trimming, null markers, promotion to numbers and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for null.
NULL_TEXTS = ["?", "NA", "N/A", "na", "n/a", "none", "None", "NULL", "null", ""]
DATETIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?.*)?$"
INTEGER = r"^[+-]?\d+$"


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def trim(df: DataFrame) -> DataFrame:
    """White space off both ends of strings, and null for the texts that stand for it."""
    own = set(_strings(df))
    cut = lambda c: F.regexp_replace(F.col(f"`{c}`"), r"^\s+|\s+$", "")
    return df.select(*[F.when(cut(c).isin(NULL_TEXTS), None).otherwise(cut(c)).alias(c) if c in own else F.col(f"`{c}`") for c in df.columns])


def promotions(df: DataFrame) -> dict[str, str]:
    """Type each string column can become without new nulls: bigint, then double, then timestamp. One job for all columns."""
    own = _strings(df)
    if not own:
        return {}
    aggs = []
    for i, c in enumerate(own):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"n{i}"), F.count(F.when(x.rlike(INTEGER), x.try_cast("bigint"))).alias(f"i{i}"), F.count(x.try_cast("double")).alias(f"d{i}"), F.count(F.when(x.rlike(DATETIME), F.try_to_timestamp(x))).alias(f"t{i}")]
    row = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(own):
        for key, kind in (("i", "bigint"), ("d", "double"), ("t", "timestamp_ntz")):
            if row[f"{key}{i}"] == row[f"n{i}"]:
                out[c] = kind
                break
    return out


def promote(df: DataFrame) -> DataFrame:
    """String columns in the types that promotions() finds."""
    found = promotions(df)
    as_type = lambda c: F.try_to_timestamp(F.col(f"`{c}`")).cast("timestamp_ntz") if found[c] == "timestamp_ntz" else F.col(f"`{c}`").try_cast(found[c])
    return df.select(*[as_type(c).alias(c) if c in found else F.col(f"`{c}`") for c in df.columns])


def normalise(df: DataFrame) -> DataFrame:
    return promote(trim(df))

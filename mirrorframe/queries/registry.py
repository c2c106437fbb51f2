"""Registration of queries and small helpers for their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_bits(seed: int, stream: str, key: str) -> str:
    """The 48-bit integer of functions.rng in SQL."""
    return f"('0x' || substr(md5('{seed}:{stream}:' || ({key})::VARCHAR), 1, 12))::BIGINT"


def sql_uniform(seed: int, stream: str, key: str) -> str:
    return f"({sql_bits(seed, stream, key)} / 281474976710656.0)"

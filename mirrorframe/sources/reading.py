"""Reading any supported source into a DataFrame."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.plans.stages import ship
from mirrorframe.sources.arrow_files import ArrowSource
from mirrorframe.sources.duckdb_tables import DuckDbSource
from mirrorframe.sources.normalize import normalise
from mirrorframe.sources.splits import read_csv, read_json
from mirrorframe.sources.uri import DatabaseUri, FilePath, ProbeError, SourceError, base_query, count_sql, enforce_limit, redact, sample_sql, suffix

#: Characters of an object in which the names of its columns are looked for.
HEAD = 1 << 16


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder by its suffix. Text formats are cleaned and typed; Parquet and Arrow are taken as they are. CSV and JSON files split, whatever their records hold."""
    kind = suffix(path)
    if kind in (".csv", ".tsv"):
        return normalise(read_csv(spark, path, "\t" if kind == ".tsv" else ","))
    if kind == ".parquet":
        return spark.read.parquet(path)
    if kind == ".json":
        return normalise(_in_file_order(*read_json(spark, path)))
    if kind in (".ndjson", ".jsonl"):
        return normalise(_in_file_order(spark.read.json(path), spark.read.text(path)))
    ship(spark)
    spark.dataSource.register(ArrowSource)
    return spark.read.format("arrow_file").load(path)


def _in_file_order(df: DataFrame, lines: DataFrame) -> DataFrame:
    """Columns in the order of the first object of the lines, where Spark sorts them; columns of later objects follow. An object of over HEAD characters keeps Spark's order."""
    head = lines.select(F.substring("value", 1, HEAD).alias("head")).filter(F.col("head").contains("{")).first()
    try:
        names = list(json.JSONDecoder().raw_decode(head[0], head[0].index("{"))[0]) if head else []
    except ValueError:
        names = []
    return df.select(*[c for c in names if c in df.columns], *[c for c in df.columns if c not in names])


def _jdbc(spark: SparkSession, spec: DatabaseUri, sql: str) -> DataFrame:
    url = "jdbc:" + spec.uri.replace("postgres://", "postgresql://", 1)
    reader = spark.read.format("jdbc").option("url", url).option("query", sql)
    return (reader.option("queryTimeout", spec.timeout) if spec.timeout else reader).load()


def read_database(spark: SparkSession, spec: DatabaseUri, *, fit_rows: int | None = None, seed: int = 0) -> DataFrame:
    """A table or query: its size is asked first, and a sample is taken inside the database."""
    base, size = base_query(spec), count_sql(spec.scheme, spec.table, spec.query)
    if spec.scheme == "duckdb":
        ship(spark)
        spark.dataSource.register(DuckDbSource)
        path = spec.uri.split("://", 1)[1]
        read = lambda sql, paged=False: spark.read.format("duckdb").option("database", path).option("query", sql).option("paged", str(paged).lower()).option("timeout", spec.timeout or 0).load()
    else:
        read = lambda sql, paged=False: _jdbc(spark, spec, sql)
    try:
        estimate = read(size).first()[0]
    except Exception as e:
        raise ProbeError(f"can't count the rows of {redact(spec.uri)}") from e
    enforce_limit(estimate, fit_rows)
    return read(sample_sql(spec.scheme, base, fit_rows, seed, estimate), bool(spec.table) and not fit_rows)


def read(spark: SparkSession, spec: FilePath | DatabaseUri, *, fit_rows: int | None = None, seed: int = 0) -> DataFrame:
    if isinstance(spec, FilePath):
        return read_file(spark, spec.path)
    if isinstance(spec, DatabaseUri):
        return read_database(spark, spec, fit_rows=fit_rows, seed=seed)
    raise SourceError(f"unknown source {spec!r}")

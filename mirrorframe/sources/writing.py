"""Writing a DataFrame to any supported sink. Sinks are folders of part files, as Spark writes them; one_file asks for a single file on the driver's disk."""

from __future__ import annotations

import warnings
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.plans.model import is_datetime
from mirrorframe.plans.stages import ship
from mirrorframe.sources.uri import DuckDbSink, FilePath, SinkError, suffix


def _warn_lossy(df: DataFrame) -> None:
    times = [f.name for f in df.schema.fields if is_datetime(f.dataType)]
    if times:
        warnings.warn(f"JSON holds {', '.join(times)} as text", stacklevel=3)


def write_file(df: DataFrame, path: str, *, one_file: bool = False) -> None:
    kind = suffix(path)
    if kind in (".arrow", ".feather", ".ipc"):
        _write_arrow(df, path)
        return
    if kind in (".json", ".ndjson", ".jsonl"):
        _warn_lossy(df)
    if one_file:
        _write_one(df, path, kind)
        return
    w = df.write.mode("overwrite")
    if kind in (".csv", ".tsv"):
        w.csv(path, header=True, sep="\t" if kind == ".tsv" else ",", escape='"')
    elif kind == ".parquet":
        w.parquet(path)
    else:
        w.json(path, ignoreNullFields=False)


def _write_arrow(df: DataFrame, path: str) -> None:
    """One IPC file, written batch by batch as partitions arrive on the driver, so the driver holds one partition at a time."""
    import pyarrow as pa

    ship(df.sparkSession)
    batches = df.mapInArrow(_serialised, "batch binary").toLocalIterator()
    first = None
    with pa.OSFile(path, "wb") as out:
        writer = None
        for row in batches:
            table = pa.ipc.open_stream(row.batch).read_all()
            if writer is None:
                first = table.schema
                writer = pa.ipc.new_file(out, first)
            writer.write_table(table)
        if writer is None:
            empty = df.limit(0).toArrow()
            writer = pa.ipc.new_file(out, empty.schema)
        writer.close()


def _serialised(batches):
    import pyarrow as pa

    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])


def _write_one(df: DataFrame, path: str, kind: str) -> None:
    import csv
    import json

    if kind == ".parquet":
        import pyarrow.parquet as pq

        pq.write_table(df.toArrow(), path)
        return
    with Path(path).open("w", newline="", encoding="utf-8") as out:
        if kind in (".csv", ".tsv"):
            w = csv.writer(out, delimiter="\t" if kind == ".tsv" else ",")
            w.writerow(df.columns)
            text = df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns])
            for r in text.toLocalIterator():
                w.writerow(["" if v is None else v for v in r])
            return
        rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()
        if kind == ".json":
            out.write("[" + ",\n".join(json.dumps(json.loads(r.j)) for r in rows) + "]\n")
        else:
            out.writelines(r.j + "\n" for r in rows)


def write_duckdb(df: DataFrame, sink: DuckDbSink) -> None:
    """CREATE OR REPLACE TABLE, filled partition by partition."""
    import duckdb
    import pyarrow as pa

    ship(df.sparkSession)
    with duckdb.connect(sink.path) as c:
        name = '"' + sink.table.replace('"', '""') + '"'
        made = False
        for row in df.mapInArrow(_serialised, "batch binary").toLocalIterator():
            part = pa.ipc.open_stream(row.batch).read_all()  # noqa: F841  read by name in SQL
            c.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM part" if not made else f"INSERT INTO {name} SELECT * FROM part")
            made = True
        if not made:
            part = df.limit(0).toArrow()  # noqa: F841
            c.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM part")


def write(df: DataFrame, sink: FilePath | DuckDbSink, *, one_file: bool = False) -> None:
    if isinstance(sink, FilePath):
        write_file(df, sink.path, one_file=one_file)
    elif isinstance(sink, DuckDbSink):
        write_duckdb(df, sink)
    else:
        raise SinkError(f"unknown sink {sink!r}")


def write_dataset(tables: dict[str, DataFrame], folder: str, suffixes: dict[str, str] | None = None, *, one_file: bool = False) -> None:
    """Each table below a folder, in the format of its source file, .csv by default."""
    if one_file:
        Path(folder).mkdir(parents=True, exist_ok=True)
    for name, df in tables.items():
        write_file(df, f"{folder.rstrip('/')}/{name}{(suffixes or {}).get(name, '.csv')}", one_file=one_file)

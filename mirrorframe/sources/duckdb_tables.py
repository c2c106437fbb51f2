"""DuckDB queries as a Spark data source. The file must be readable where tasks run; each partition reads a range of row numbers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Timer

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

CHUNK = 250_000


class RangePartition(InputPartition):
    def __init__(self, offset: int | None):
        self.offset = offset


class DuckDbReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.query, self.paged = options["database"], options["query"], options.get("paged", "false") == "true"
        self.timeout = float(options.get("timeout", 0))

    @contextmanager
    def _connect(self):
        """A connection whose queries are interrupted after the timeout, where there is one."""
        import duckdb

        with duckdb.connect(self.path, read_only=True) as c:
            timer = Timer(self.timeout, c.interrupt) if self.timeout else None
            if timer:
                timer.start()
            try:
                yield c
            except duckdb.InterruptException:
                raise TimeoutError(f"the query took more than {self.timeout:g} seconds") from None
            finally:
                if timer:
                    timer.cancel()

    def partitions(self) -> list[InputPartition]:
        if not self.paged:  # a query without a stable order is read in one pass
            return [RangePartition(None)]
        with self._connect() as c:
            n = c.execute(f"SELECT count(*) FROM ({self.query})").fetchone()[0]
        return [RangePartition(o) for o in range(0, max(n, 1), CHUNK)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        page = "" if partition.offset is None else f" WHERE rowid >= {partition.offset} AND rowid < {partition.offset + CHUNK}"
        with self._connect() as c:
            yield from c.execute(self.query + page).to_arrow_reader(20_000)


class DuckDbSource(DataSource):
    """spark.read.format("duckdb").option("database", path).option("query", sql).load()"""

    @classmethod
    def name(cls) -> str:
        return "duckdb"

    def schema(self) -> StructType:
        import duckdb

        with duckdb.connect(self.options["database"], read_only=True) as c:
            return from_arrow_schema(c.execute(f"SELECT * FROM ({self.options['query']}) LIMIT 0").to_arrow_table().schema, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return DuckDbReader(dict(self.options))

"""Arrow IPC (Feather) files as a Spark data source: one partition a record batch, so large files are read side by side."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


class BatchPartition(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


def _open(path: str) -> pa.ipc.RecordBatchFileReader:
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return pa.ipc.open_file(fs.open_input_file(inner))


class ArrowReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [BatchPartition(self.path, i) for i in range(_open(self.path).num_record_batches)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield _open(partition.path).get_batch(partition.number)


class ArrowSource(DataSource):
    """spark.read.format("arrow_file").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "arrow_file"

    def schema(self) -> StructType:
        return from_arrow_schema(_open(self.options["path"]).schema, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowReader(self.options["path"])

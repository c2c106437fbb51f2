"""CSV files with line breaks in quotes, and JSON files of any layout, read by many tasks.

A file is cut by bytes into blocks, and each block into pieces, at every line break (CSV) or closing brace (JSON): that is Spark's text source with a separator. Whether a
piece ends a record depends on all that stands before it, but only through a small state: inside quotes or not, and for JSON the depth of brackets. So a first pass
gives for each block where it would leave each of the two possible states; these steps are composed in file order, a row a block, and a second pass, which then knows the state that its
block begins in, puts pieces together to records. Records that lie across blocks leave them as fragments, two a block at most, and are joined by file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from mirrorframe.plans.stages import new_path, ship, staged

#: Bytes of a CSV file up to which one task reads it whole: putting records together takes more work than reading them, and pays with tens of tasks.
WHOLE_BYTES = 1 << 30
#: Blocks whose states the driver holds; files of more are read a file a task.
MOST_BLOCKS = 200_000
#: A state: inside quotes, and the depth of brackets (0 in CSV).
State = tuple[bool, int]
RECORD, HEAD, TAIL = 0, 1, 2
_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_REST = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)


def after_line(line: str, state: State, sep: str) -> State:
    """The state behind a CSV line. Quotes open a field at its start alone, are doubled inside, and what follows the closing one belongs to the field."""
    inside, at = state[0], 0
    if '"' not in line:
        return state
    while True:
        if inside:
            end = line.find('"', at)
            while end >= 0 and line.startswith('"', end + 1):
                end = line.find('"', end + 2)
            if end < 0:
                return True, 0
            inside, at = False, end
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return False, 0
        at += 1


def after_piece(piece: str, state: State) -> State:
    """The state behind a piece of JSON and the closing brace that follows it."""
    inside, depth = state
    if inside:
        found = _REST.match(piece)
        if not found:
            return state
        piece = piece[found.end() :]
    if '"' in piece:
        piece = _STRING.sub("", piece)
        if '"' in piece:
            piece = piece[: piece.index('"')]
            return True, depth + sum(piece.count(x) for x in "{[") - sum(piece.count(x) for x in "}]")
    return False, depth + sum(piece.count(x) for x in "{[") - sum(piece.count(x) for x in "}]") - 1


def _blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """(file, start) and pieces, as they come; a block may come in several runs."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
        codes = files.indices.to_numpy()
        cuts = [0, *(1 + np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1]))).tolist(), batch.num_rows]
        values = batch.column("value").to_pylist()
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield (files.dictionary[int(codes[s])].as_py(), int(starts[s])), values[s:e]


def _steps(blocks: DataFrame, after: Callable[[str, State], State]) -> list:
    """A row a block: where it leaves each state that it may begin in (depth 0), whether a piece within it leaves a record open, and whether it begins with a bracket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], list] = {}
        for key, pieces in _by_block(batches):
            states, opened, bracket = known.setdefault(key, [[(False, 0), (True, 0)], [False, False], next((x for x in pieces if x.strip()), "").lstrip("\ufeff \t\r\n").startswith("[")])[:3]
            for piece in pieces:
                for k in (0, 1):
                    states[k] = after(piece, states[k])
                    opened[k] |= states[k][0]
            known[key][2] = bracket
        rows = [(f, s, states[0][0], states[0][1], states[1][0], states[1][1], opened[0], opened[1], b) for (f, s), (states, opened, b) in known.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(_STEP.names, r, strict=True)) for r in rows], schema=_STEP)

    return blocks.mapInArrow(run, "file string, start long, inside0 boolean, depth0 long, inside1 boolean, depth1 long, opened0 boolean, opened1 boolean, bracket boolean").limit(MOST_BLOCKS + 1).collect()


_STEP = pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside0", pa.bool_()), ("depth0", pa.int64()), ("inside1", pa.bool_()), ("depth1", pa.int64()), ("opened0", pa.bool_()), ("opened1", pa.bool_()), ("bracket", pa.bool_())])


def _entries(steps: list) -> tuple[dict[tuple[str, int], State], dict[str, int], bool]:
    """The state each block begins in, the depth of the records of each file, and whether any record of CSV lies on several lines."""
    out: dict[tuple[str, int], State] = {}
    base: dict[str, int] = {}
    state, several = (False, 0), False
    for r in sorted(steps, key=lambda r: (r.file, r.start)):
        if r.file not in base:
            base[r.file], state = int(r.bracket), (False, 0)
        out[r.file, r.start] = state
        several |= r.opened1 if state[0] else r.opened0
        state = (r.inside1, state[1] + r.depth1) if state[0] else (r.inside0, state[1] + r.depth0)
    return out, base, several


def _records(blocks: DataFrame, entries: dict[tuple[str, int], State], base: dict[str, int], after: Callable[[str, State], State], glue: str) -> DataFrame:
    """(record, first): the text of every record, and whether it is its file's first. Pieces are joined by glue; for JSON glue ends each piece too."""
    json = glue == "}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, held, kind, number = None, (False, 0), [], RECORD, 0
        rows: list[tuple] = []

        def put(what: int) -> None:
            text = glue.join(held) + (glue if json else "")
            rows.append((what, now[0], now[1], text, what == RECORD and now[1] == 0 and number == 0))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["kind", "file", "start", "record", "first"])
            rows.clear()
            return out

        for key, pieces in _by_block(batches):
            if key != now:
                if held:
                    put(HEAD if kind == HEAD else TAIL)
                now, state, held, number = key, entries[key], [], 0
                top = (False, base[key[0]] if json else 0)
                kind = HEAD if state != top and not (json and key[1] == 0) else RECORD
            for piece in pieces:
                if json and not held and kind == RECORD:
                    if state[1] < top[1]:  # the file's own bracket
                        at = piece.find("[")
                        if at < 0:
                            continue
                        piece, state = piece[at + 1 :], (False, 1)
                    if "{" not in piece:
                        continue
                    piece = piece[piece.index("{") :]
                state = after(piece, state)
                held.append(piece)
                if state == top:
                    put(kind)
                    held, kind, number = [], RECORD, number + 1
            if len(rows) >= 1000:
                yield flush()
        if held:
            put(HEAD if kind == HEAD else TAIL)
        if rows:
            yield flush()

    found = staged(blocks.mapInArrow(run, "kind int, file string, start long, record string, first boolean"), "records")
    whole = found.filter(F.col("kind") == RECORD).select("record", "first")
    # A tail begins a record, heads go on with it; of a block the head comes first
    order = W.partitionBy("file").orderBy("start", "kind")
    parts = found.filter(F.col("kind") != RECORD).withColumn("which", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    parts = parts.groupBy("file", "which").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"))
    joined = parts.select(F.array_join(F.transform("parts", lambda p: p["record"]), "" if json else glue).alias("record"), F.lit(False).alias("first"))
    return whole.unionByName(joined)


def read_csv(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """The rows of CSV files with a header each, as strings. Files of WHOLE_BYTES at most are read by a task each. Larger ones whose records are all on one line go to Spark's reader, which splits them. Lines end with LF or CR LF, which both become LF inside values; text is UTF-8."""
    ship(spark)
    options = {"header": True, "sep": sep, "escape": '"', "inferSchema": False}
    whole = spark.read.options(**options, multiLine=True).csv(path)  # looks at the first record only
    if spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] <= WHOLE_BYTES:  # the sizes alone are read
        return whole
    blocks, after = _blocks(spark, path, "\n"), lambda line, state: after_line(line, state, sep)
    steps = _steps(blocks, after)
    if len(steps) > MOST_BLOCKS:
        return whole
    entries, base, several = _entries(steps)
    if not several:
        return spark.read.options(**options).csv(path)
    text = F.col("record")
    plain = F.when(text.endswith("\r"), F.regexp_replace(F.regexp_replace(text, r"\r\z", ""), r"\r\n", "\n")).otherwise(text)  # of a record that ends with CR LF, those inside too are LF
    records = _records(blocks, entries, base, after, "\n").filter("not first").select(plain.alias("record")).filter("record <> ''")
    kind = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(whole.columns))])
    parsed = records.select(F.from_csv("record", F.lit(kind.simpleString()[7:-1].replace(":", " ")), {"sep": sep, "escape": '"', "multiLine": "true"}).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(name) for i, name in enumerate(whole.columns)])


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The objects of JSON files (arrays of objects, or objects one after another, over lines or not), and the same as text, one object a row, written to the shared folder."""
    ship(spark)
    blocks = _blocks(spark, path, "}")
    steps = _steps(blocks, after_piece)
    if len(steps) > MOST_BLOCKS:
        return spark.read.option("multiLine", True).json(path), spark.read.text(path)
    entries, base, _ = _entries(steps)
    records = _records(blocks, entries, base, after_piece, "}")
    lines = new_path(spark, "json-lines")
    # A line break is white space in JSON, and can't stand in a string
    records.select(F.translate("record", "\r\n", "  ").alias("value")).write.text(lines)
    return spark.read.json(lines), spark.read.text(lines)

"""Fill-in-middle transformation over lines by an indexable skip list.

A text's units are its lines, each with its line break. The lines are the lowest lane of a skip list; a quarter of the links of a lane, chosen by a
hash of place and lane, start links of the lane above. Every link carries two widths: the units and the code points it spans. A cut rank is reached
from the top lane by going along while the units passed stay within the rank, then one lane down; the code points passed on the way are the
place of the cut. Both cuts of a text take a logarithmic number of steps, without walking its lines.

Cuts and forms are drawn from the SHA-256 of `seed:id`, so that they don't depend on how rows are dealt. Nothing is shuffled.

Defined results: null texts are empty; empty texts and texts that hold a mark stay plain; a null id is drawn as the empty string; rows of one
id are drawn alike and transformed one by one; a text without a line break is one unit; very long texts are handled alone in their batch;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import column_or_null, released, ship, table

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Percent of the texts that are transformed, and of these, of the form with the suffix first.
TRANSFORMED = 100
SUFFIX_FIRST = 50
SEED = 7
STEP = np.uint64(0x9E3779B97F4A7C15)


class Lanes:
    """A skip list over links of one unit each, with code-point widths."""

    def __init__(self, widths: np.ndarray):
        units = np.ones(len(widths), np.int64)
        self.lanes = [(units, widths, None)]
        while len(units) > 4:
            places = np.arange(len(units), dtype=np.uint64) + np.uint64(len(self.lanes))
            chosen = ((places * STEP) >> np.uint64(61)) < 2
            chosen[0] = True
            starts = np.flatnonzero(chosen)
            units, widths = np.add.reduceat(units, starts), np.add.reduceat(widths, starts)
            self.lanes.append((units, widths, starts))

    def reach(self, rank: int) -> int:
        """Code points before the unit of this rank; of all where the rank is their number."""
        at = points = 0
        for units, widths, starts in reversed(self.lanes):
            while at < len(units) and units[at] <= rank:
                rank -= int(units[at])
                points += int(widths[at])
                at += 1
            if not rank:
                break
            if starts is not None:
                at = int(starts[at])
        return points


def line_widths(text: str) -> np.ndarray:
    """Code points of each line with its line break."""
    if not text:
        return np.zeros(0, np.int64)
    widths = np.fromiter(map(len, text.split("\n")), np.int64) + 1
    if text.endswith("\n"):
        return widths[:-1]
    widths[-1] -= 1
    return widths


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """One row per row of docs: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null where plain), output (the transformed text)."""
    ship(docs.sparkSession)
    p, s, m = marks

    def one(text: str, draws: tuple[int, ...]) -> tuple[int, str, int | None, int | None, str]:
        widths = line_widths(text)
        n = len(widths)
        if not n or any(x in text for x in marks) or draws[2] % 100 >= transformed:
            return n, "plain", None, None, text
        lanes = Lanes(widths)
        first, second = (lanes.reach(rank) for rank in sorted(d % (n + 1) for d in draws[:2]))
        prefix, middle, suffix = text[:first], text[first:second], text[second:]
        if draws[3] % 100 < suffix_first:
            return n, "spm", first, second - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return n, "psm", first, second - first, f"{p}{prefix}{s}{suffix}{m}{middle}"

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                draws = zip(*(part.column(f"h{i}").to_pylist() for i in range(1, 5)), strict=True)
                done = list(zip(*(one(x or "", d) for x, d in zip(part.column("text").to_pylist(), draws, strict=True)), strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x, kind) for x, kind in zip(done, kinds, strict=True))], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = column_or_null(docs, id_col, "long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    source = docs.select(own.alias("id"), column_or_null(docs, text_col, "string").alias("text"), *draws)
    return source.mapInArrow(run, "id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(rf"\Q{x}\E" for x in marks))
    # Behind the first mark, the second and the third
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all documents in fill-in-middle form, and of what is restored from it."""
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


_P, _S, _M = MARKS
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, CASE WHEN t = '' THEN 0 WHEN ends_with(t, chr(10)) THEN len(lines) - 1 ELSE len(lines) END::BIGINT AS n,
 ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '{_P}') OR contains(t, '{_S}') OR contains(t, '{_M}') OR h3 % 100 >= {TRANSFORMED} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
 [length(x) + 1 for x in lines] AS w, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
c AS (SELECT *, least(coalesce(list_sum(w[1:a]), 0), length(t))::BIGINT AS p, least(coalesce(list_sum(w[1:b]), 0), length(t))::BIGINT AS q FROM f),
o AS (SELECT *, substr(t, 1, p) AS prefix, substr(t, p + 1, q - p) AS middle, substr(t, q + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{_P}' || prefix || '{_S}' || suffix || '{_M}' || middle ELSE '{_S}' || suffix || '{_P}' || prefix || '{_M}' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""

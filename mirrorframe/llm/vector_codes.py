"""Vector code compression: one codebook for each part of a vector, learnt by exact k-means under norm-of-sum bounds.

Components become integers, so that sums, distances and codes don't depend on the order of rows. Each round is a pass over a written state table: a task
assigns the parts of its vectors and writes codes and bounds; a second pass sums parts by entry, a few rows a task, and the driver, which
holds nothing but codebooks, makes the next ones.

Bounds. Entries fall into groups of `GROUP`. For each part of a vector and each group, the state has a lower bound on the distance to all of the group's entries
but the assigned one, rounded down to whole units, and the round in which it was true (its stamp). All earlier codebooks are kept, so that at round t a bound of stamp T
loses the largest norm among the group's net displacements, |C_t - C_T|: the norm of the sum of the moves, which is at most the sum of
their norms that drifts added up by round would take off. Groups whose bound still exceeds the exact distance to the assigned entry are passed over; the others are scanned
again exactly and get new bounds and stamps. A tie needs a scan, and goes to the lower index.

Bounded: codebooks and their history have entries x components x rounds integers; sums are parts x entries x components rows. The state is read and
written once a round.

Defined results: rows whose vector is null, empty, or holds a null or a component that isn't finite are dropped, as are those of another length than the
vector of the smallest id; ids order nulls last, rows of one id by their vectors, and each row counts; lengths that parts don't divide
are filled up with zeros; components beyond 2^18 count as 2^18; with fewer vectors than entries, codebooks have one entry a vector; an empty table gives an empty result;
other columns are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import column_or_null, released, ship, stage, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that share a bound.
GROUP = 16
#: Largest integer component: squared distances of parts fit 64 bits.
MOST = 1 << 26
#: Buckets that rows of one label are summed and joined in.
SPREAD = 64
#: Margins of the bounds against rounding.
RELATIVE, ABSOLUTE = 1e-9, 1e-6
#: Vectors a step.
STEP = 1024


def lower_bound(squared: np.ndarray) -> np.ndarray:
    """Distances rounded down to whole units of 16 bits."""
    return np.minimum(np.sqrt(squared.astype(np.float64)) * (1 - RELATIVE), 65535).astype(np.uint16)


class Bounds:
    """What is known of the parts of some vectors: codes (vectors x parts), bounds and stamps (vectors x parts x groups)."""

    def __init__(self, code: np.ndarray, low: np.ndarray, stamp: np.ndarray):
        self.code, self.low, self.stamp = code, low, stamp

    @classmethod
    def none(cls, n: int, parts: int, entries: int) -> Bounds:
        groups = -(-entries // GROUP)
        return cls(np.zeros((n, parts), np.uint8), np.zeros((n, parts, groups), np.uint16), np.zeros((n, parts, groups), np.uint8))


def displacements(history: np.ndarray, part: int) -> np.ndarray:
    """For each stamp and group, the largest net displacement of an entry since."""
    moved = np.sqrt(((history[-1, part] - history[:, part]).astype(np.float64) ** 2).sum(axis=2))
    return np.maximum.reduceat(moved, np.arange(0, moved.shape[1], GROUP), axis=1) * (1 + RELATIVE)


def assign(vectors: np.ndarray, history: np.ndarray, known: Bounds) -> tuple[np.ndarray, int]:
    """Assign parts (vectors x parts x components) to the last of the codebooks (rounds x parts x entries x components), and set codes, bounds and stamps of known.

    Returns the squared distances (vectors x parts) and how many groups were scanned.
    """
    now, n = len(history) - 1, len(vectors)
    errors, scanned = np.zeros(vectors.shape[:2], np.int64), 0
    for p in range(vectors.shape[1]):
        x, book = vectors[:, p], history[-1, p]
        groups = range(0, len(book), GROUP)
        was = known.code[:, p].astype(np.int64)
        own = ((x - book[was]) ** 2).sum(axis=1)
        low = known.low[:, p] - displacements(history, p)[known.stamp[:, p], np.arange(len(groups))]
        if now:
            need = low <= np.sqrt(own.astype(np.float64))[:, None] * (1 + RELATIVE) + ABSOLUTE
        else:
            need = np.ones((n, len(groups)), bool)
        best, code, found = own.copy(), was.copy(), []
        for g, first in enumerate(groups):
            rows = np.flatnonzero(need[:, g])
            squared = ((x[rows, None, :] - book[None, first : first + GROUP]) ** 2).sum(axis=2)
            at = squared.argmin(axis=1)
            least, entry = squared[np.arange(len(rows)), at], at + first
            better = (least < best[rows]) | ((least == best[rows]) & (entry < code[rows]))
            best[rows[better]], code[rows[better]] = least[better], entry[better]
            found.append((rows, squared))
            scanned += len(rows)
        for g, (first, (rows, squared)) in enumerate(zip(groups, found, strict=True)):
            inside = code[rows] - first
            held = (inside >= 0) & (inside < squared.shape[1])
            squared[held, inside[held]] = np.iinfo(np.int64).max
            known.low[rows, p, g], known.stamp[rows, p, g] = lower_bound(squared.min(axis=1)), now
            # The entry that was left joins those that its group's bound covers
            left = np.flatnonzero((code != was) & (was // GROUP == g) & ~need[:, g])
            known.low[left, p, g] = np.minimum(np.maximum(low[left, g], 0).astype(np.uint16), lower_bound(own[left]))
            known.stamp[left, p, g] = now
        errors[:, p], known.code[:, p] = best, code
    return errors, scanned


def _parts(column: pa.Array, n: int, parts: int, size: int) -> np.ndarray:
    """Vectors x parts x components, filled up with zeros."""
    flat = column.flatten().to_numpy().reshape(n, size)
    return np.pad(flat.astype(np.int64), ((0, 0), (0, -size % parts))).reshape(n, parts, -1)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _assigned(state: DataFrame, history: np.ndarray, size: int, kept: list[str]) -> DataFrame:
    """state with codes, bounds and stamps under the last codebooks, and each vector's error."""
    parts, entries, first = history.shape[1], history.shape[2], len(history) == 1

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                n, known = part.num_rows, Bounds.none(part.num_rows, parts, entries)
                if not first:
                    read = lambda name, kind, shape: np.frombuffer(b"".join(part.column(name).to_pylist()), kind).reshape(shape).copy()  # noqa: B023, E731
                    known = Bounds(read("code", np.uint8, known.code.shape), read("low", np.uint16, known.low.shape), read("stamp", np.uint8, known.stamp.shape))
                errors, _ = assign(_parts(part.column("v"), n, parts, size), history, known)
                columns = [part.column(c) for c in [*kept, "v"]]
                yield pa.RecordBatch.from_arrays([*columns, _binary(known.code), _binary(known.low), _binary(known.stamp), pa.array(errors.sum(axis=1))], names=[*kept, "v", "code", "low", "stamp", "error"])

    kinds = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in [*kept, "v"])
    return state.mapInArrow(run, f"{kinds}, code binary, low binary, stamp binary, error long")


def _next(state: DataFrame, books: np.ndarray, size: int) -> np.ndarray:
    """The codebooks of the means, rounded down; entries without parts stay."""
    parts, entries, width = books.shape

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                x = _parts(part.column("v"), part.num_rows, parts, size)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                place = (np.arange(parts) * entries + code).ravel()
                order = np.argsort(place, kind="stable")
                used, starts = np.unique(place[order], return_index=True)
                one = np.concatenate([np.ones((len(place), 1), np.int64), x.reshape(len(place), width)], axis=1)
                sums[used] += np.add.reduceat(one[order], starts, axis=0)
        used = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width + 1)), pa.array(np.tile(np.arange(width + 1), len(used))), pa.array(sums[used].ravel())], names=["entry", "place", "total"])

    rows = state.select("v", "code").mapInArrow(run, "entry long, place long, total long").groupBy("entry", "place").agg(F.sum("total").alias("total")).collect()
    sums = np.zeros((parts * entries, width + 1), np.int64)
    for r in rows:
        sums[r.entry, r.place] = r.total
    out, used = books.reshape(-1, width).copy(), sums[:, 0] > 0
    out[used] = np.floor_divide(sums[used, 1:], sums[used, :1])
    return out.reshape(books.shape)


def integers(vector: Column) -> Column:
    """floor(SCALE * x) of every component; null where the vector is null or empty or holds a null or a component that isn't finite."""
    whole = F.size(vector) > 0
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int")
    return F.when(whole & finite, F.transform(vector, small))


def compress(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", kept: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, the kept columns, code (a byte a part), error) of every vector, as a written table, and the codebooks: parts x entries x components."""
    ship(df.sparkSession)
    if not 0 < entries <= 256:
        raise ValueError("codes are bytes: from 1 to 256 entries")
    vector = column_or_null(df, vector_col, "array<double>")
    columns = ["id", *kept]
    rows = df.select(column_or_null(df, id_col, "long").alias("id"), *[F.col(f"`{c}`") for c in kept], integers(vector).alias("v")).filter("v is not null")
    state = stage(rows, "vector-parts")
    ordered = lambda x, n: x.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(n).collect()
    first = ordered(state, 1)
    size = len(first[0].v) if first else 0
    state = state.filter(F.size("v") == size)
    start = ordered(state, entries) if first else []
    flat = np.array([r.v for r in start], np.int64).reshape(len(start), size)
    books = np.pad(flat, ((0, 0), (0, -size % parts))).reshape(len(start), parts, -(-size // parts)).transpose(1, 0, 2)
    history = books[None]
    if not start:
        return state.select(*columns, F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), books
    for _ in range(rounds):
        state = stage(_assigned(state, history, size, columns), "vector-bounds")
        history = np.concatenate([history, _next(state, history[-1], size)[None]])
    return stage(_assigned(state, history, size, columns).select(*columns, "code", "error"), "vector-codes"), history[-1]


def decompress(codes: DataFrame, books: np.ndarray, size: int, *, code_col: str = "code") -> DataFrame:
    """codes with `vector`: the entries that the code names, `size` components."""
    ship(codes.sparkSession)
    parts = len(books)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(code_col).to_pylist()), np.uint8).reshape(-1, parts)
            found = books[np.arange(parts), code].reshape(len(code), -1)[:, :size] / SCALE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found.astype(np.float32)), pa.list_(pa.float32()))], names=[*batch.schema.names, "vector"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema)
    return codes.mapInArrow(run, f"{kinds}, vector array<float>")


def with_label_totals(codes: DataFrame, label_col: str, total: str) -> DataFrame:
    """codes with the sum of error over the rows of equal labels (nulls together). Rows of one label are summed and joined in `SPREAD` buckets, so that none needs one task."""
    rows = codes.withColumn("_bucket", F.pmod(F.xxhash64("id", "code"), F.lit(SPREAD)))
    per = rows.groupBy(F.col(label_col).alias("_label"), F.col("_bucket").alias("_b")).agg(F.sum("error").alias("_sum"))
    totals = per.groupBy(F.col("_label").alias("_l")).agg(F.sum("_sum").alias(total))
    per = per.join(totals, F.col("_label").eqNullSafe(F.col("_l"))).select("_label", "_b", total)
    return rows.join(per, F.col(label_col).eqNullSafe(F.col("_label")) & (F.col("_bucket") == F.col("_b"))).drop("_label", "_bucket", "_b")


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors and a digest of the codebooks."""
    codes, books = compress(table(spark, sf_dir, "embeddings"), kept=("label",))
    out = with_label_totals(codes, "label", "label_error")
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL: the assignment to codebook k."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, p, m.e AS e, m.d AS d, x FROM (SELECT vec_id, parts.p AS p, any_value(parts.x) AS x, min({{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(parts.x, b{k}.x)]), 'e': e}}) AS m
 FROM parts JOIN b{k} ON parts.p = b{k}.p GROUP BY vec_id, parts.p))"""


def _means(k: int) -> str:
    """SQL: codebook k + 1."""
    return f"""b{k + 1} AS MATERIALIZED (SELECT b{k}.p AS p, b{k}.e AS e, coalesce(m.x, b{k}.x) AS x FROM b{k} LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(x[i]) / count(*))::BIGINT AS y FROM a{k}, range(1, len(x) + 1) t(i) GROUP BY p, e, i) GROUP BY p, e) m ON m.p = b{k}.p AND m.e = b{k}.e)"""


ORACLE = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT vec_id, r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, r AS e, x FROM parts WHERE r < {ENTRIES}),
{", ".join(f"{_round(k)}, {_means(k)}" for k in range(ROUNDS))}, {_round(ROUNDS)},
codes AS (SELECT vec_id, string_agg(lower(printf('%02x', e::INT)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id),
totals AS (SELECT label, sum(error)::BIGINT AS label_error FROM codes JOIN k USING (vec_id) GROUP BY label),
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS s FROM b{ROUNDS})
SELECT vec_id, code, error, label_error, s AS codebooks_sha256 FROM codes JOIN k USING (vec_id) JOIN totals ON k.label IS NOT DISTINCT FROM totals.label CROSS JOIN sha
"""

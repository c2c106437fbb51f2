"""Suffix-array dedup: removes every byte that a MATCH-byte string covers which also starts earlier, and keeps the first copy.

Earlier copies are found by longest-previous-factor arrays: in suffix order, the nearest smaller positions before and after a suffix
are where its longest earlier match starts. A suffix array over the whole corpus isn't needed to find matches of MATCH
bytes, so the corpus is first cut down to the places that can match.

1. Every window of MATCH bytes has an anchor: the leftmost least hash of its GRAM-byte strings. Equal windows have equal anchors at equal
   offsets. Windows of one anchor form a run (at most MATCH - GRAM + 1 windows). Runs meet by anchor, packed many to a row.
2. Runs of equal text (128 bits of hash) fold: all but the first are covered whole. Copies end here and are never expanded.
3. Where an anchor has several different runs, their texts are fetched, and one suffix array and LPF array over
   those of many anchors finds the windows with an earlier copy. An anchor with more than HOT different runs goes by single windows, of which equal
   ones fold in the same way, so that it never meets in one suffix array. Groups read runs as a stream and let go of an anchor once it is hot,
   with all of its runs to come, so a passage in very many surroundings takes no more memory than a rare one.
4. Covered windows are collected by document and cut from the texts.

Plan: one exchange of packed runs, two of compressed texts (fetch and cut), small ones of spans. A task folds equal runs, and equal windows of
hot anchors, before they leave it, so groups of copies shrink to one a task.

Defined results: null and empty texts are kept as empty, with no spans; rows that repeat an id, and rows of null id (the smallest), are documents of
their own, rows of one id in the order of a hash of id and text; very long texts are worked on in slices; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import column_or_null, free_name, keyed, released, ship, stage, table

MATCH = 100
GRAM = 40
WINDOWS = MATCH - GRAM + 1
#: Different runs of one anchor beyond which they go by single windows.
HOT = 2000
#: Runs or windows that a task gathers before it folds them.
HELD = 1 << 18
#: Bytes of text whose runs leave a task together, that are hashed at once, aimed at for a group of runs, and for a group of their texts.
SLICE, PIECE, GROUP, TEXTS = 1 << 20, 1 << 18, 8 << 20, 2 << 20
_rng = np.random.Generator(np.random.PCG64(77003))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
ODD = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
#: A run: its anchor's hash, its text's hash, document, first window, windows.
RUN = np.dtype([("anchor", "<u8"), ("run", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "<u1")])
SPANS, RUNS, HOT_RUNS = 0, 1, 2


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * ODD[14]
    h = (h ^ (h >> np.uint64(29))) * ODD[15]
    return h ^ (h >> np.uint64(32))


def runs_of(data: np.ndarray, ends: np.ndarray, docs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of all windows of texts laid end to end. ends: where each text ends; offsets: where it starts in its document."""
    n = len(data)
    if n < MATCH:
        return np.zeros(0, RUN)
    h = {1: BYTE[data]}
    size = 1
    while size < 64:  # hashes of 2, 4 ... 64 bytes
        a = h[size]
        h[2 * size] = (a[:-size] * ODD[size.bit_length()]) + (a[size:] ^ (a[size:] >> np.uint64(31)))
        size *= 2
    gram = mix(h[32][: n - GRAM + 1] * ODD[0] + h[8][32 : 32 + n - GRAM + 1])
    best, at = gram, np.arange(len(gram), dtype=np.int32)
    width = 1
    while width < WINDOWS:  # least gram, leftmost on ties, of windows that double
        step = min(width, WINDOWS - width)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        width += step
    count = n - MATCH + 1
    starts = np.concatenate([[0], ends[:-1]])
    which = np.repeat(np.arange(len(ends)), ends - starts)[:count]
    ok = np.arange(count) + MATCH <= ends[which]
    new = np.ones(count, bool)
    new[1:] = (at[1:] != at[:-1]) | (which[1:] != which[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new & ok)
    stop = np.append(np.flatnonzero(new | ~ok), count)
    last = stop[np.searchsorted(stop, first, side="right")]  # the window after the run
    out = np.zeros(len(first), RUN)
    p, end = at[first], last - 1 + MATCH
    out["anchor"] = gram[p]
    mid = np.minimum(first + 64, end - 64)
    whole = h[64]
    out["run"] = mix(whole[first] * ODD[1] + whole[mid] * ODD[2] + whole[end - 64] * ODD[3] + (end - first).astype(np.uint64) * ODD[4] + (p - first).astype(np.uint64) * ODD[5])
    w = which[first]
    out["doc"], out["start"], out["n"] = docs[w], first - starts[w] + offsets[w], last - first
    return out


def fold(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First run of each text, in the order of anchors, and the other runs."""
    order = np.lexsort((runs["start"], runs["doc"], runs["run"], runs["anchor"]))
    runs = runs[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs["anchor"][1:] != runs["anchor"][:-1]) | (runs["run"][1:] != runs["run"][:-1])
    return runs[first], runs[~first]


def pack(runs: np.ndarray) -> bytes:
    """The fields one after the other."""
    return b"".join(runs[k].tobytes() for k in RUN.names)


def unpack(blobs: list[bytes]) -> np.ndarray:
    parts = []
    for blob in blobs:
        n = len(blob) // RUN.itemsize
        out, at = np.zeros(n, RUN), 0
        for k in RUN.names:
            kind = RUN[k]
            out[k] = np.frombuffer(blob, kind, n, at)
            at += n * kind.itemsize
        parts.append(out)
    return np.concatenate(parts) if parts else np.zeros(0, RUN)


def _packed(runs: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Folded runs by group, and what folding covers as group -1 - (some group)."""
    first, covered = fold(runs)
    for some, sign in ((first, 0), (covered, -1)):
        if len(some):
            group = (mix(some["anchor"]) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            some, group = some[order], group[order]
            cuts = np.flatnonzero(np.diff(group)) + 1
            ids = group[np.concatenate([[0], cuts])]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([sign] * len(ids), pa.int32()), pa.array([pack(x) for x in np.split(some, cuts)], pa.binary())], names=["group", "kind", "runs"])


def _dealt(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Runs of texts by group, folded and packed over SLICE bytes of text; their hashes take memory for PIECE bytes."""
    raw, ids, offsets, found = [], [], [], []
    size = done = 0

    def hashed() -> None:
        nonlocal raw, ids, offsets, size, done
        if raw:
            ends = np.cumsum([len(x) for x in raw])
            found.append(runs_of(np.frombuffer(b"".join(raw), np.uint8), ends, np.array(ids, np.int64), np.array(offsets, np.int64)))
        raw, ids, offsets, size, done = [], [], [], 0, done + size

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal found, done
        some = np.concatenate([np.zeros(0, RUN), *found])
        found, done = [], 0
        if len(some):
            yield from _packed(some, groups)

    for batch in batches:
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            whole = text.as_py()
            whole = whole.encode() if whole else b""
            for s in range(0, max(1, len(whole) - MATCH + 1), PIECE):
                part = whole[s : s + PIECE + MATCH - 1]
                raw.append(part)
                ids.append(i)
                offsets.append(s)
                size += len(part)
                if size >= PIECE:
                    hashed()
                if done >= SLICE:
                    yield from flush()
    hashed()
    yield from flush()


def _found(kind: int, runs: np.ndarray) -> pa.Table:
    return pa.table({"kind": np.full(len(runs), kind, np.int32), "id": runs["doc"].astype(np.int64), "start": runs["start"].astype(np.int64), "n": runs["n"].astype(np.int64), "anchor": runs["anchor"].view(np.int64) if runs["anchor"].flags.c_contiguous else runs["anchor"].copy().view(np.int64)})


class Fold:
    """Folds runs that come in parts. `held` is the first run of each text so far; `put` and `settle` give those that turn out covered."""

    def __init__(self, most: int):
        self.most, self.held, self.fresh, self.waiting = most, np.zeros(0, RUN), [], 0

    def put(self, runs: np.ndarray) -> bool:
        """Whether enough wait to settle."""
        if len(runs):
            self.fresh.append(runs)
            self.waiting += len(runs)
        return self.waiting >= self.most

    def settle(self) -> np.ndarray:
        self.held, covered = fold(np.concatenate([self.held, *self.fresh]))
        self.fresh, self.waiting = [], 0
        return covered


def _resolve(batches: Iterator[pa.RecordBatch], hot: int, held: int) -> Iterator[pa.RecordBatch]:
    """Of one group of runs: SPANS that an earlier equal run covers, and RUNS (or HOT_RUNS) whose anchor has other runs.

    An anchor with over `hot` runs is let go with all of its runs to come: their windows meet later. Only runs of other anchors are held.
    """
    cold, let_go = Fold(held), np.zeros(0, np.uint64)

    def settle() -> Iterator[pa.RecordBatch]:
        nonlocal let_go
        yield from _found(SPANS, cold.settle()).to_batches()
        again = np.isin(cold.held["anchor"], let_go)
        _, n = np.unique(cold.held["anchor"], return_counts=True)
        over = again | (np.repeat(n, n) > hot)
        if over.any():
            yield from _found(HOT_RUNS, cold.held[over]).to_batches()
            let_go = np.union1d(let_go, cold.held["anchor"][over])
            cold.held = cold.held[~over]

    for batch in batches:
        kinds, blobs = batch.column("kind").to_pylist(), batch.column("runs").to_pylist()
        covered = unpack([b for k, b in zip(kinds, blobs, strict=True) if k])
        if len(covered):
            yield from _found(SPANS, covered).to_batches()
        if cold.put(unpack([b for k, b in zip(kinds, blobs, strict=True) if not k])):
            yield from settle()
    yield from settle()
    _, n = np.unique(cold.held["anchor"], return_counts=True)
    yield from _found(RUNS, cold.held[np.repeat(n, n) > 1]).to_batches()


FOUND = "kind int, id long, start long, n long, anchor long"


def find_runs(docs: DataFrame, groups: int, hot: int = HOT, held: int = HELD) -> DataFrame:
    """docs: id, text. Runs of all documents, met by anchor: FOUND."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(batches, groups)

    @released
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _resolve(batches, hot, held)

    return docs.mapInArrow(run, "group long, kind int, runs binary").groupBy("group").applyInArrow(resolve, FOUND)


def longest_previous_factor(data: np.ndarray, positions: np.ndarray, cap: int = MATCH) -> np.ndarray:
    """For each of the ascending positions, which all have `cap` bytes after them, the length up to `cap` of the longest match with one of the earlier positions.

    Suffixes are sorted by prefixes that double. PSV and NSV (nearest smaller positions in suffix order) come from
    pointer jumping, which keeps the least common prefix on the way.
    """
    if len(positions) < 2:
        return np.zeros(len(positions), np.int64)
    padded = np.concatenate([data, np.zeros(128, np.uint8)])
    n = len(data)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    ranks = {8: np.unique(key, return_inverse=True)[1].astype(np.int64)}
    size = 8
    while 2 * size <= cap:
        a = ranks[size]
        later = np.concatenate([a[size:] + 1, np.zeros(min(size, n), np.int64)])[:n]
        ranks[2 * size] = np.unique(a * (n + 2) + later, return_inverse=True)[1].astype(np.int64)
        size *= 2
    top = ranks[size]
    order = np.lexsort((positions, top[np.minimum(positions + cap - size, n - 1)], top[positions]))
    sa = positions[order]

    # Common prefixes of neighbours in suffix order, by halving
    i, j = sa[1:].copy(), sa[:-1].copy()
    lcp = np.zeros(len(i), np.int64)
    tail = (top[sa[1:]] == top[sa[:-1]]) & (top[np.minimum(sa[1:] + cap - size, n - 1)] == top[np.minimum(sa[:-1] + cap - size, n - 1)])
    for s in sorted(ranks, reverse=True):
        same = (lcp + s <= cap) & (ranks[s][np.minimum(i + lcp, n - 1)] == ranks[s][np.minimum(j + lcp, n - 1)])
        lcp += s * same
    for _ in range(8):
        same = (lcp < cap) & (padded[i + lcp] == padded[j + lcp])
        if not same.any():
            break
        lcp += same
    lcp[tail] = cap

    def nearest(sa_: np.ndarray, lcp_: np.ndarray) -> np.ndarray:
        """Common prefix with the nearest smaller position before, in suffix order; 0 where there is none."""
        m = len(sa_)
        link, low = np.arange(-1, m - 1), np.concatenate([[0], lcp_])
        todo = np.arange(1, m)
        while len(todo):
            to = link[todo]
            todo = todo[(to >= 0) & (low[todo] > 0)]
            todo = todo[sa_[link[todo]] > sa_[todo]]
            to = link[todo]
            new_low, new_link = np.minimum(low[todo], low[to]), link[to]
            low[todo], link[todo] = new_low, new_link
        low[link < 0] = 0
        return low

    before = nearest(sa, lcp)
    after = nearest(sa[::-1], lcp[::-1])[::-1]
    out = np.zeros(len(positions), np.int64)
    out[order] = np.maximum(before, after)
    return out


def zipped(docs: DataFrame) -> DataFrame:
    """docs: id, text. id and the text's UTF-8 bytes, compressed to move."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([z.compress((x or "").encode()) for x in part.column("text").to_pylist()], pa.binary())], names=["id", "body"])

    return docs.mapInArrow(run, "id long, body binary")


def windows_at(text: np.ndarray, at: np.ndarray, doc: int) -> np.ndarray:
    """Single windows of a text as runs, with two hashes of their bytes for anchor and run."""
    out = np.zeros(len(at), RUN)
    powers, powers2 = (np.multiply.accumulate(np.full(MATCH, ODD[k], np.uint64)) for k in (6, 7))
    for s in range(0, len(at), 4096):
        value = BYTE[text[at[s : s + 4096, None] + np.arange(MATCH)]]
        out["anchor"][s : s + 4096], out["run"][s : s + 4096] = mix((value * powers).sum(axis=1)), mix((value * powers2).sum(axis=1))
    out["doc"], out["start"], out["n"] = doc, at, 1
    return out


def _spans(windows: np.ndarray) -> pa.Table:
    """SPANS of single windows; windows next to each other make one."""
    found = windows[np.lexsort((windows["start"], windows["doc"]))]
    doc, start = found["doc"].astype(np.int64), found["start"].astype(np.int64)
    new = np.ones(len(found), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return pa.table({"kind": np.full(len(at), SPANS, np.int32), "id": doc[at], "start": start[at], "n": np.diff(np.append(at, len(found))).astype(np.int64), "anchor": np.zeros(len(at), np.int64)})


def fetch(docs: DataFrame, wanted: DataFrame, groups: int, held: int = HELD) -> DataFrame:
    """Texts of the wanted runs, by group: RUNS are (id, start, n, text), HOT_RUNS packed single windows of hot anchors, SPANS those that a window of the same task covers."""
    asked = wanted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "n", "anchor", "kind"))).alias("asked"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, windows = zstandard.ZstdDecompressor(), Fold(held)

        def made(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in rows], pa.int64()) for k in range(5)] + [pa.array([x[5] for x in rows], pa.binary())], names=["group", "kind", "id", "start", "n", "body"])

        def leave() -> Iterator[pa.RecordBatch]:
            rows = [(s["id"] % groups, SPANS, s["id"], s["start"], s["n"], b"") for s in _spans(windows.settle()).to_pylist()]
            group = (windows.held["anchor"] % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                rows.append((group[part[0]], HOT_RUNS, 0, 0, 0, pack(windows.held[part])))
            windows.held = windows.held[:0]
            yield from made(rows)

        for batch in batches:
            for r in range(batch.num_rows):
                doc, body, asks = (batch.column(k)[r].as_py() for k in ("id", "body", "asked"))
                body = z.decompress(body)
                some = [a for a in asks if a["kind"] == RUNS]
                yield from made([(mix(np.array([a["anchor"]], np.int64).view(np.uint64))[0] % np.uint64(groups), RUNS, doc, a["start"], a["n"], body[a["start"] : a["start"] + a["n"] + MATCH - 1]) for a in some])
                hot = [np.arange(a["start"], a["start"] + a["n"]) for a in asks if a["kind"] == HOT_RUNS]
                if hot and windows.put(windows_at(np.frombuffer(body, np.uint8), np.concatenate(hot), doc)):
                    yield from leave()
        yield from leave()

    return zipped(docs).join(asked, "id").mapInArrow(run, "group long, kind long, id long, start long, n long, body binary")


def _match(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    """Spans of one group of fetched runs and single windows."""
    windows, parts = Fold(held), []
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        known = batch.filter(pa.array(kind == SPANS))
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([known.column("kind").cast(pa.int32()), known.column("id"), known.column("start"), known.column("n"), pa.array(np.zeros(known.num_rows, np.int64))], names=["kind", "id", "start", "n", "anchor"])
        if windows.put(unpack(batch.filter(pa.array(kind == HOT_RUNS)).column("body").to_pylist())):
            yield from _spans(windows.settle()).to_batches()
        parts.append(batch.filter(pa.array(kind == RUNS)))
    yield from _spans(windows.settle()).to_batches()
    t = pa.Table.from_batches(parts).sort_by([("id", "ascending"), ("start", "ascending")])
    if t.num_rows:
        bodies = t.column("body").to_pylist()
        n, start, ids = (t.column(k).to_numpy() for k in ("n", "start", "id"))
        lengths = np.fromiter(map(len, bodies), np.int64, len(bodies))
        begins = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(bodies), np.uint8)
        total = np.cumsum(n)
        inner = np.arange(total[-1]) - np.repeat(total - n, n)
        lpf = longest_previous_factor(data, np.repeat(begins, n) + inner)
        hit = lpf >= MATCH
        found = np.zeros(int(hit.sum()), RUN)
        found["doc"], found["start"], found["n"] = np.repeat(ids, n)[hit], (np.repeat(start, n) + inner)[hit], 1
        yield from _spans(found).to_batches()


def _union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that (first window, windows) cover."""
    out: list[list[int]] = []
    for start, n in sorted(spans):
        end = start + n + MATCH - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def whole_characters(piece: bytes, first: bool, last: bool) -> bytes:
    """A piece of a text between two cuts, without the bytes of characters that a cut goes through; its start is the text's own if first, its end if last."""
    start, end = 0, len(piece)
    while not first and start < min(3, end) and piece[start] & 0xC0 == 0x80:
        start += 1
    for back in range(1, 1 + min(3, end - start) if not last else 1):
        lead = piece[end - back]
        if lead >= 0xC0:
            if back < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                end -= back
            break
        if lead < 0x80:
            break
    return piece[start:end]


def cut_repeats(source: DataFrame, hot: int = HOT, held: int = HELD, whole: bool = False) -> DataFrame:
    """source: id (unique, in the order that decides which copy is first), text. id, n_bytes, n_removed, removed, kept. whole: kept has no parts of characters that are cut."""
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, texts = (max(8, -(-size // x)) for x in (GROUP, TEXTS))

    @released
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _match(batches, held)

    found = stage(find_runs(source, groups, hot, held), "repeat-runs")
    wanted = found.filter(F.col("kind") != SPANS)
    matched = stage(fetch(source, wanted, texts, held).groupBy("group").applyInArrow(match, FOUND), "repeat-matches")
    spans = found.filter(F.col("kind") == SPANS).unionByName(matched).groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                sizes, removed, kept = [], [], []
                for body, own in zip(part.column("body").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    body = z.decompress(body)
                    out = _union_of([(x["start"], x["n"]) for x in own or []])
                    edges = [0, *(e for pair in out for e in pair), len(body)]
                    pieces = [(body[a:b], a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    kept.append(b"".join(whole_characters(x, a == 0, b == len(body)) if whole else x for x, a, b in pieces))
                    sizes.append(len(body))
                    removed.append([{"start": a, "end": b} for a, b in out])
                n = [sum(x["end"] - x["start"] for x in out) for out in removed]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "removed", "kept"])

    joined = zipped(source).join(spans, "id", "left").select("id", "body", "spans")
    return joined.mapInArrow(cut, "id long, n_bytes long, n_removed long, removed array<struct<start: bigint, end: bigint>>, kept binary")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, held: int = HELD) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, removed (maximal removed byte ranges), kept (the remaining bytes, binary). hot and held bound memory; results don't depend on them."""
    ship(docs.sparkSession)
    source, plain = keyed(docs.select(column_or_null(docs, id_col, "long").alias("own"), column_or_null(docs, text_col, "string").alias("text")), "own", "id", nulls_first=True)
    out = cut_repeats(source.select("id", "text"), hot, held)
    if plain:
        return out
    return out.join(source.select(F.col("id").alias("key"), "own"), F.col("id") == F.col("key")).select(F.col("own").alias("id"), "n_bytes", "n_removed", "removed", "kept")


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with their texts cut (and their lengths set anew, where there is such a column); documents that lose everything go.

    A cut inside a character drops its other bytes and nothing else: replacement characters of a text stay. Texts move once, as what is left of them.
    """
    ship(docs.sparkSession)
    key, cut, null = (free_name(docs, x) for x in ("_row", "_cut", "_null"))
    rows, _ = keyed(docs, id_col, key, nulls_first=True)
    pieces = cut_repeats(rows.select(F.col(key).alias("id"), column_or_null(docs, text_col, "string").alias("text")), whole=True).select(F.col("id").alias(key), F.struct("n_removed", F.make_valid_utf8("kept").alias("text")).alias(cut))
    others = rows.withColumn(null, F.col(f"`{text_col}`").isNull()).drop(text_col)
    joined = others.join(pieces, key).filter((F.col(cut)["n_removed"] == 0) | (F.length(F.col(cut)["text"]) > 0))
    joined = joined.withColumn(text_col, F.when(~F.col(null), F.col(cut)["text"]))
    if length_col in docs.columns:
        joined = joined.withColumn(length_col, F.length(f"`{text_col}`").cast(docs.schema[length_col].dataType))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all documents without their repeats of 100 bytes and more."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of every text by the MD5 of its bytes; a window that isn't the first of its kind covers its bytes.
ORACLE = rf"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * MATCH})) AS g FROM (SELECT doc_id, h, unnest(range(n - {MATCH - 1})) AS i FROM d WHERE n >= {MATCH})),
later AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {MATCH} AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, i, CASE WHEN i - lag(i, 1, -{MATCH + 1}) OVER (PARTITION BY doc_id ORDER BY i) > {MATCH} THEN 1 ELSE 0 END AS fresh FROM later)) GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS was FROM runs),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""

"""N-gram Jaccard join by prefix trees.

A document's set holds the 64-bit hashes of its distinct word shingles. The global order of shingles goes by frequency class (the logarithm of the number of documents, exact
counts over all of them) and then by hash. All pairs of a likeness of `PERCENT` or more come together as follows.

1. Counting. Tasks cut their documents into chunks and send each chunk's shingles, sorted and packed, to buckets of the hash range. A bucket counts, and returns the
   shingles of two documents or more, as keys of the global order, to their chunks. A shingle that a chunk has more than `OFTEN` times is sent once with its count; its owners stay
   with the chunk's head. Shingles of one document match nothing and move no further.
2. Screening. With n shingles, a partner shares at least PERCENT% of them; documents that share fewer with all others together are done. Equal sets fold to
   their least id.
3. Clusters. In the global order, rarest first, two linked sets share a key among the first n - ceil(PERCENT% of n) + 1 (shingles of one document count as the first).
   Each such key links its documents to their least id, so that no pairs are made; the components of these links are clusters, and links never leave one.
4. Prefix trees. A cluster's sets, most frequent key first, are stored in a path-compressed trie. A set goes down the trie from the root with the overlap so far, which all sets
   below a node share, and leaves a subtree whose remaining lengths, its own and the subtree's longest, can't reach the needed overlap, whose sizes are out of range, or
   whose documents are all in its own component already: copies of copies are never compared pair by pair.
   Where an end is reached, the overlap is exact and decides the link.
5. Clusters over `BLOCK` documents or `BLOCK_BYTES` are dealt into blocks that each join themselves and share some pilots, which ties a family's blocks together. If a cluster is then
   in more than one component, each document outside its largest component goes down the tries of all blocks of its size class and the two beside it.

Every comparison is exact on the full sets, and no cap drops one. A family below the threshold that holds together by rare keys costs, in step 5, its members times those outside
the largest component, less what tries prune.

Defined results: a text with fewer words than a shingle is one shingle of all of them; null and empty texts have the empty set and link with nothing; rows that repeat an
id, and rows of null id, are documents of their own, of which those with an id come first (a component has the smallest id among its rows, null where none
has one); a very long text is a chunk of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import WORD, column_or_null, keyed, released, ship, stage, table
from mirrorframe.llm.components import components
from mirrorframe.llm.near_dedup import mix, shingle_set

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Documents and text bytes of a chunk; text bytes for each bucket.
CHUNK, CHUNK_BYTES, BUCKET_BYTES = 4096, 8 << 20, 16 << 20
OFTEN = 64
#: Documents and bytes of sets in a block of a large cluster, and expected pilots of a cluster.
BLOCK, BLOCK_BYTES, PILOTS = 512, 8 << 20, 32
#: Bits of a key that hold the hash; the frequency class is above them.
HASH_BITS = np.uint64(58)
LOST_BITS = np.uint64(6)
EVERY = 0xFFFF


def packed(x: np.ndarray) -> bytes:
    """Bytes of an array by significance, compressed: sorted hashes share their first bytes."""
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(x: bytes, kind: type) -> np.ndarray:
    """The array that was packed."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _head_and_grams(ids: list[int], texts: list[str | None], buckets: int, often: int) -> dict[str, list]:
    """Rows of one chunk: its head (ids, set sizes and owners of frequent grams), and its grams by bucket."""
    sets = [shingle_set(x) for x in texts]
    sizes = [len(x) for x in sets]
    grams, owners = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owners = grams[order], owners[order]
    starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(grams)))
    frequent = np.repeat(counts > often, counts)
    head = (packed(grams[frequent]), packed(owners[frequent]))
    first = np.zeros(len(grams), bool)
    first[starts] = True
    sent = ~frequent | first
    marks = np.where(frequent, EVERY, owners).astype(np.uint16)[sent]
    weights = np.repeat(counts, counts).astype(np.uint32)[sent]
    grams = grams[sent]
    place = ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    out = {"bucket": [ids[0] % buckets], "chunk": [ids[0]], "ids": [ids], "sizes": [sizes], "grams": [head[0]], "owners": [head[1]], "counts": [None]}
    cuts = np.searchsorted(place, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        s = slice(cuts[b], cuts[b + 1])
        many = weights[s][marks[s] == EVERY]
        for name, x in zip(out, (b, ids[0], None, None, packed(grams[s]), packed(marks[s]), packed(many) if len(many) else None), strict=True):
            out[name].append(x)
    return out


_DEALT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("grams", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])


def _chunks(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[tuple[list[int], list[str | None]]]:
    """Documents some at a time; a chunk is named by its first id."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for i, x in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if ids and (len(ids) == size or held + len(x or "") > most):
                    yield ids, texts
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(x)
                held += len(x or "")
    if ids:
        yield ids, texts


def _counted(t: pa.Table) -> pa.Table:
    """Of one bucket: heads as they are, and of each chunk the grams of two documents or more, as keys of the global order."""
    heads = pc.is_valid(t.column("ids"))
    rows = t.filter(pc.invert(heads))
    out = t.filter(heads).select(["chunk", "ids", "sizes", "grams", "owners"])
    if not rows.num_rows:
        return out
    grams = [unpacked(x, np.uint64) for x in rows.column("grams").to_pylist()]
    marks = [unpacked(x, np.uint16) for x in rows.column("owners").to_pylist()]
    ends = np.cumsum([len(x) for x in grams])
    every, owner = np.concatenate(grams), np.concatenate(marks)
    weight = np.ones(len(every), np.int64)
    many = [unpacked(x, np.uint32) for x in rows.column("counts").to_pylist() if x]
    if many:
        weight[owner == EVERY] = np.concatenate(many)
    order = np.argsort(every, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
    df = np.zeros(len(every), np.int64)
    df[order] = np.repeat(np.add.reduceat(weight[order], starts), np.diff(np.append(starts, len(every))))
    keys = (np.floor(np.log2(df)).astype(np.uint64) << HASH_BITS) | (every >> LOST_BITS)
    kept, names = {"chunk": [], "grams": [], "owners": []}, rows.column("chunk").to_pylist()
    for chunk, a, b in zip(names, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        shared = df[a:b] > 1
        if shared.any():
            kept["chunk"].append(chunk)
            kept["grams"].append(packed(keys[a:b][shared]))
            kept["owners"].append(packed(owner[a:b][shared]))
    n = len(kept["chunk"])
    return pa.concat_tables([out, pa.table([pa.array(kept["chunk"], pa.int64()), pa.nulls(n, out.schema.field("ids").type), pa.nulls(n, out.schema.field("sizes").type), pa.array(kept["grams"], pa.binary()), pa.array(kept["owners"], pa.binary())], names=out.column_names).cast(out.schema)])


def _ordered(t: pa.Table, percent: int) -> pa.Table:
    """Of one chunk: its documents with their set sizes, and the sorted keys of those that share enough, with what names an equal set."""
    head = t.filter(pc.is_valid(t.column("ids"))).to_pylist()[0]
    rows = t.filter(pc.is_null(t.column("ids")))
    keys = np.concatenate([np.zeros(0, np.uint64), *(unpacked(x, np.uint64) for x in rows.column("grams").to_pylist())])
    owners = np.concatenate([np.zeros(0, np.uint16), *(unpacked(x, np.uint16) for x in rows.column("owners").to_pylist())])
    low = (np.uint64(1) << HASH_BITS) - np.uint64(1)
    often, of = unpacked(head["grams"], np.uint64) >> LOST_BITS, unpacked(head["owners"], np.uint16)
    whole = np.sort(keys[owners == EVERY])
    if len(often):
        whole = whole[np.argsort(whole & low, kind="stable")]
        keys = np.concatenate([keys[owners != EVERY], whole[np.searchsorted(whole & low, often)]])
        owners = np.concatenate([owners[owners != EVERY], of])
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order].astype(np.int64)
    n = np.array(head["sizes"], np.int64)
    held = np.bincount(owners, minlength=len(n))
    ends = np.cumsum(held)
    enough = (n > 0) & (100 * held >= percent * n)
    out = {"id": head["ids"], "n": head["sizes"], "keys": [None] * len(n), "name": head["ids"], "name2": [-1] * len(n)}
    out["name"] = list(out["name"])
    for k in np.flatnonzero(enough).tolist():
        own = keys[ends[k] - held[k] : ends[k]]
        out["keys"][k] = own.tobytes()
        if held[k] == n[k]:
            out["name"][k], out["name2"][k] = (int(x.sum().view(np.int64)) for x in (mix(own), mix(own ^ np.uint64(0x5851F42D4C957F2D))))
    return pa.table(out, schema=pa.schema([("id", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("name", pa.int64()), ("name2", pa.int64())]))


def ordered_sets(source: DataFrame, percent: int = PERCENT) -> DataFrame:
    """source: id (unique), text. id, n (set size), keys (shared shingles as sorted keys of the global order; null where no partner is possible), name and name2 (equal for equal sets)."""
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(8, -(-size // BUCKET_BYTES))
    chunk, most, often = CHUNK, CHUNK_BYTES, OFTEN

    @released
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _chunks(batches, chunk, most):
            yield pa.RecordBatch.from_pydict(_head_and_grams(ids, texts, buckets, often), schema=_DEALT)

    dealt = source.select("id", "text").mapInArrow(deal, "bucket long, chunk long, ids array<long>, sizes array<long>, grams binary, owners binary, counts binary")
    counted = dealt.groupBy("bucket").applyInArrow(_counted, "chunk long, ids array<long>, sizes array<long>, grams binary, owners binary")
    return counted.groupBy("chunk").applyInArrow(lambda t: _ordered(t, percent), "id long, n long, keys binary, name long, name2 long")


class Node:
    """A node of the trie: the keys on the way from its parent, the sets below it, those that end here, and bounds on what is below."""

    __slots__ = ("ends", "first", "high", "last", "longest", "low", "path", "start", "stop", "under")

    def __init__(self, path: np.ndarray, start: int, stop: int, first: int, last: int):
        self.path, self.start, self.stop, self.first, self.last = path, start, stop, first, last
        self.ends: list[int] = []
        self.under: list[Node] = []


class PrefixTree:
    """Ranked sets (ascending ranks, sorted as sequences) with their full sizes."""

    def __init__(self, ranks: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        shared = [0] * len(ranks)
        for k in range(1, len(ranks)):
            a, b = ranks[k - 1], ranks[k]
            m = min(len(a), len(b))
            apart = np.flatnonzero(a[:m] != b[:m])
            shared[k] = int(apart[0]) if len(apart) else m
        shared, lengths = np.array(shared, np.int64), np.fromiter(map(len, ranks), np.int64, len(ranks))
        self.root = Node(ranks[0][:0], 0, 0, 0, len(ranks))
        todo = [self.root]
        while todo:
            node = todo.pop()
            span = slice(node.first, node.last)
            node.low, node.high, node.longest = int(sizes[span].min()), int(sizes[span].max()), int(lengths[span].max())
            k = node.first
            while k < node.last and lengths[k] == node.stop:
                node.ends.append(k)
                k += 1
            if k == node.last:
                continue
            cuts = [k, *(k + 1 + np.flatnonzero(shared[k + 1 : node.last] <= node.stop)).tolist(), node.last]
            for a, b in zip(cuts, cuts[1:], strict=False):
                stop = int(lengths[a]) if b == a + 1 else min(int(shared[a + 1 : b].min()), int(lengths[a]))
                node.under.append(Node(ranks[a][node.stop : stop], node.stop, stop, a, b))
            todo += node.under


def links_of(left: list[np.ndarray], left_sizes: np.ndarray, right: list[np.ndarray] | None, right_sizes: np.ndarray, left_labels: np.ndarray, right_labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components, as places in left and right; right is None where left is joined with itself. Sets are sorted keys; labels name components so far.

    Links within a component are passed over, so that the links found with the labels given span the components of all links.
    """
    own = right is None
    values = np.unique(np.concatenate([*left, *(right or [])]))[::-1]
    ranked = lambda sets: [np.searchsorted(-values.view(np.int64), -x[::-1].view(np.int64)) for x in sets]
    probes = ranked(left)
    stored = probes if own else ranked(right)
    order = sorted(range(len(stored)), key=lambda k: stored[k].astype(">u4").tobytes())
    sizes = np.asarray(left_sizes if own else right_sizes)[order]
    tree = PrefixTree([stored[k] for k in order], sizes)
    labels = np.asarray(left_labels if own else right_labels)[order].copy()
    mine, place = np.asarray(left_labels).copy(), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found = []
    mask = np.zeros(len(values), bool)
    for k, probe in enumerate(probes):
        n, mask[probe] = int(left_sizes[k]), True
        at = int(place[k]) if own else len(order)
        todo = [(tree.root, 0)]
        while todo:
            node, overlap = todo.pop()
            label = labels[at] if own else mine[k]
            if node.first >= at or 100 * node.high < percent * n or percent * node.low > 100 * n:
                continue
            need = -(-percent * (n + node.low) // (100 + percent))
            ahead = len(probe) if not len(node.path) else len(probe) - int(np.searchsorted(probe, node.path[0]))
            if overlap + min(node.longest - node.start, ahead) < need or (labels[node.first : node.last] == label).all():
                continue
            overlap += int(np.count_nonzero(mask[node.path]))
            for end in node.ends:
                if end < at and labels[end] != label and 100 * overlap >= percent * (n + int(tree.sizes[end]) - overlap):
                    found.append((k, order[end]))
                    gone = labels[end]
                    labels[labels == gone] = label
                    mine[mine == gone] = label
            todo += [(x, overlap) for x in node.under]
        mask[probe] = False
    return found


def _decoded(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("keys")]


def _stars(names: np.ndarray, found: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Links from the least name of each component of the found pairs of places to its other ones."""
    top: dict[int, int] = {}

    def of(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for x, y in found:
        a, b = sorted((of(int(names[x])), of(int(names[y]))))
        top[b] = a
    pairs = sorted({(of(x), x) for x in top} - {(x, x) for x in top})
    return [a for a, _ in pairs], [b for _, b in pairs]


def _within(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of one group of blocks: links of each block."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cluster", "ascending"), ("block", "ascending"), ("id", "ascending")])
        ids, sets, sizes = t.column("id").to_numpy(), _decoded(t), t.column("n").to_numpy()
        names = np.stack([t.column("cluster").to_numpy(), t.column("block").to_numpy()], axis=1)
        cuts = [0, *(1 + np.flatnonzero((names[1:] != names[:-1]).any(axis=1))).tolist(), len(ids)]
        a, b = [], []
        for s, e in zip(cuts, cuts[1:], strict=False):
            least, others = _stars(ids[s:e], links_of(sets[s:e], sizes[s:e], None, sizes[s:e], np.arange(e - s), np.arange(e - s), percent))
            a += least
            b += others
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _across(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of one pair of blocks: links of components."""

    def run(t: pa.Table) -> pa.Table:
        outside = t.column("outside").to_numpy(zero_copy_only=False)
        comps, sizes, sets = t.column("c").to_numpy(), t.column("n").to_numpy(), _decoded(t)
        x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
        found = links_of([sets[k] for k in x], sizes[x], [sets[k] for k in y], sizes[y], comps[x], comps[y], percent) if len(x) and len(y) else []
        least, others = _stars(comps, [(x[i], y[j]) for i, j in found])
        return pa.table({"a": pa.array(least, pa.int64()), "b": pa.array(others, pa.int64())})

    return run


def _clusters(reps: DataFrame, percent: int) -> DataFrame:
    """(id, cluster) of the documents that share a key of their first ones with another."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("keys")]
            first = [x[: max(0, n - -(-percent * n // 100) + 1 - (n - len(x)))] for x, n in zip(sets, sizes.tolist(), strict=True)]
            keys = np.concatenate(first) if first else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(ids, [len(x) for x in first]))], names=["key", "id"])

    firsts = reps.select("id", "n", "keys").mapInArrow(run, "key long, id long")
    leaders = firsts.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("most")).filter("a < most").select("key", "a")
    return components(firsts.join(leaders, "key").select("a", F.col("id").alias("b")).distinct(), "gram-clusters").withColumnRenamed("component", "cluster")


def _blocks(count: str, size: str):
    return F.ceil(F.greatest(F.col(count) / BLOCK, F.col(size) / BLOCK_BYTES))


def _links(reps: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Components of the reps: id, component."""
    sized = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes"))
    sized = stage(sized.withColumn("blocks", _blocks("members", "bytes")), "gram-sizes")
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bins = max(8, -(-total // BLOCK_BYTES))
    dealt = members.select("id", "cluster").join(sized.select("cluster", "members", "blocks"), "cluster")
    pilot = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("members") / PILOTS)) == 0
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    block = F.explode(F.when(pilot, everywhere).otherwise(F.array(F.pmod(F.xxhash64("id"), "blocks")))).alias("block")
    placed = dealt.select("id", "cluster", block).withColumn("bin", F.pmod(F.xxhash64("cluster", "block"), F.lit(bins)))
    sets = reps.select("id", "n", "keys")
    near = components(placed.join(sets, "id").groupBy("bin").applyInArrow(_within(percent), "a long, b long"), "gram-near")
    large = members.join(sized.filter("blocks > 1").select("cluster"), "cluster").join(near, "id", "left").select("id", "cluster", "n", "bytes", F.coalesce("component", "id").alias("c"))
    large = stage(large, "gram-large")
    if large.isEmpty():
        return near
    step = math.log(100 / min(percent, 99)) * 1.0001
    large = large.withColumn("k", F.floor(F.log("n") / step))
    most = large.groupBy("cluster", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("cluster").agg(F.max_by("c", F.struct("m", "c")).alias("main"))
    large = large.join(most, "cluster").withColumn("outside", F.col("c") != F.col("main"))
    lefts = large.filter("outside").withColumn("k", F.explode(F.array(F.col("k") - 1, F.col("k"), F.col("k") + 1)))
    of = lambda df, name: df.groupBy("cluster", "k").agg(F.count(F.lit(1)).alias("members"), F.sum("bytes").alias("bytes")).select("cluster", "k", _blocks("members", "bytes").alias(name))
    counts = of(lefts, "ls").join(of(large, "rs"), ["cluster", "k"])
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = lefts.join(counts, ["cluster", "k"]).select("id", "cluster", "k", "c", F.lit(True).alias("outside"), place("ls").alias("l"), each("rs").alias("r"))
    right = large.join(counts, ["cluster", "k"]).select("id", "cluster", "k", "c", F.lit(False).alias("outside"), each("ls").alias("l"), place("rs").alias("r"))
    pairs = left.unionByName(right).join(sets, "id").groupBy("cluster", "k", "l", "r").applyInArrow(_across(percent), "a long, b long").distinct()
    more = components(pairs, "gram-across").select(F.col("id").alias("c"), F.col("component").alias("further"))
    out = near.unionByName(large.filter("id = c").join(near.select("id"), "id", "left_anti").select("id", F.col("c").alias("component")))
    return out.withColumnRenamed("component", "c").join(more, "c", "left").select("id", F.coalesce("further", "c").alias("component"))


def classes(source: DataFrame, percent: int = PERCENT) -> DataFrame:
    """source: id (unique), text. id, n_shingles and component (the smallest id reachable)."""
    every = stage(ordered_sets(source, percent), "gram-sets")
    folds = every.filter("keys is not null").groupBy("name", "name2", "n").agg(F.min("id").alias("rep"))
    reps = stage(every.filter("keys is not null").join(folds.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "keys"), "gram-reps")
    members = stage(_clusters(reps, percent).join(reps.select("id", "n", F.octet_length("keys").alias("bytes")), "id"), "gram-members")
    comps = _links(reps, members, percent)
    of_rep = folds.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("name", "name2", "n", F.coalesce("component", "rep").alias("component"))
    out = every.select("id", "n", "name", "name2").join(of_rep, ["name", "name2", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def gram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id. percent: from 1 to 100."""
    ship(docs.sparkSession)
    source, plain = keyed(docs.select(column_or_null(docs, id_col, "long").alias("own"), column_or_null(docs, text_col, "string").alias("text")), "own", "id")
    found = classes(source.select("id", "text"), percent)
    if plain:
        return found.withColumnRenamed("component", "component_id")
    names = source.select(F.col("id").alias("key"), "own")
    found = found.join(names, F.col("id") == F.col("key")).select(F.col("own").alias("id"), "n_shingles", "component")
    return found.join(names, F.col("component") == F.col("key")).select("id", "n_shingles", F.col("own").alias("component_id"))


def op11_gram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents linked at 80% of their five-word shingles."""
    return gram_join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: All pairs that share a shingle, and the smallest id reachable.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + {SHINGLE - 1}], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
near AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT near.doc_id, edges.b FROM near JOIN edges ON near.other = edges.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM near GROUP BY doc_id) USING (doc_id)
"""

"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds the hashes of its distinct word shingles. Documents of one set are folded first and represented
by their smallest key. Each representative has `COORDINATES` minwise tokens. A tree starts at a node
that holds everything; a node chooses coordinates by a hash of its path, each with probability 1 / (threshold * COORDINATES), and a
document goes to one child for every chosen coordinate, named by its minwise token there. Similar pairs stay together in an
expected 1 or more children, dissimilar ones die out, and independent trees repeat this to the target recall.

What a node does at the start depth:
1. every member is compared to the node's smallest key (links that hold join components);
2. a node whose members are all in one component is done, however large: copies are never expanded into pairs;
3. else members of different components are compared exhaustively. Nodes of up to `SMALL` members do so pair by pair. Larger ones are met again and again by
   much the same documents, in many trees; those with one main component (the largest among their members) are therefore merged, and every document outside
   it is compared to every member once, in pairs of blocks of bounded count and bytes that are keys of their own. A block pair has the full sets of both sides
   and returns one link for each two components. No node branches deeper: a pair at the threshold is parted at every level with some
   probability, and a fixed number of trees would miss it more and more often.
A comparison takes the full sets of both. Single pairs must pass two lossless or nearly lossless tests before their sets are fetched: the sizes of the sets allow the
threshold, and a sketch of one bit of each minwise token agrees. Bits agree with probability (1 + J) / 2, so at the threshold 16 of 128 differ on average, and more than
`MAX_BITS` with a probability of one in a million. No cap drops a candidate. The work of a large node is its members times those outside its largest component.

Plan: the text is read once for the sets' summaries and once more, for candidate documents only, for the full sets. Everything
that moves is keyed by node, by document or by a pair of blocks; the skew of a hot node is left to partial aggregation (its smallest key and size) and
to skewed-join splitting. Components come from contraction of the links (llm/components.py), then of the links between those components.

Defined results: a text with fewer words than a shingle is one shingle of all of them; null and empty texts have the empty set, link with
nothing and are kept; rows that repeat an id, and rows of null id, are documents of their own, of which those with an id come first
(a component has the smallest id among its rows, null where none has one); very long texts have large sets and blocks of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import WORD, column_or_null, free_name, keyed, released, ship, stage, table
from mirrorframe.llm.components import components

SHINGLE = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
COORDINATES = 128
#: At the threshold a pair survives START_DEPTH levels of one tree with probability 0.37; 20 trees miss 1 in 10,000.
TREES = 20
START_DEPTH = 3
#: Members of a node that compares pair by pair; documents and bytes of sets in a block of larger nodes.
SMALL = 32
BLOCK = 512
BLOCK_BYTES = 8 << 20
MAX_BITS = 34
_rng = np.random.Generator(np.random.PCG64(20240611))
#: From a rule: random odd multipliers and byte values of the hashes.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
FACTORS = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
FACTORS_2 = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_POWERS = np.multiply.accumulate(np.full(4096, STEP, np.uint64))


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. Words are runs of anything but ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    global _POWERS
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    if lengths.max() > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.full(2 * int(lengths.max()), STEP, np.uint64))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    raw = BYTE[np.frombuffer(b"".join(words), np.uint8)]
    raw *= _POWERS[np.arange(len(raw)) - np.repeat(starts, lengths)]
    w = mix(np.add.reduceat(raw, starts) + lengths.astype(np.uint64))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h + w[i : len(w) - k + 1 + i] * PLACE[i])
    return np.unique(h)


def signature(found: np.ndarray) -> np.ndarray:
    """The least of COORDINATES hashes of the set, as 32-bit tokens."""
    out = np.full(COORDINATES, (1 << 64) - 1, np.uint64)
    for s in range(0, len(found), 2048):
        part = found[s : s + 2048]
        np.minimum(out, (part[None, :] * FACTORS[:, None] + FACTORS_2[:, None]).min(axis=1), out)
    return (out >> np.uint64(32)).astype(np.uint32)


def children(signatures: np.ndarray, owners: np.ndarray, paths: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """One level down. owners: rows of signatures; paths: their nodes. (owner, child path) for each coordinate a path chooses."""
    limit = np.uint64(int(rate * 2.0**64))
    keep_o, keep_p = [], []
    for s in range(0, len(paths), 4096):
        o, p = owners[s : s + 4096], paths[s : s + 4096]
        picked = mix(p[:, None] ^ (FACTORS[None, :] * np.uint64(3))) < limit
        r, c = np.nonzero(picked)
        keep_o.append(o[r])
        keep_p.append(mix(p[r] * PLACE[0] + FACTORS[c]) ^ mix(signatures[o[r], c].astype(np.uint64) * PLACE[1]))
    return (np.concatenate(keep_o), np.concatenate(keep_p)) if keep_o else (owners[:0], paths[:0])


def summaries(docs: DataFrame) -> DataFrame:
    """docs: id, text. id, n (set size), two hashes that name the set, its minwise tokens (binary) and their sketch."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingle_set(x) for x in part.column("text").to_pylist()]
                names = np.array([[(x * PLACE[2]).sum(), mix(x + PLACE[3]).sum()] if len(x) else [0, 0] for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
                tokens = np.stack([signature(x) for x in sets]) if sets else np.zeros((0, COORDINATES), np.uint32)
                bits = sketch(tokens)
                columns = [part.column("id"), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(c.copy()) for c in (names[:, 0], names[:, 1])), pa.array([t.tobytes() for t in tokens], pa.binary()), *(pa.array(c.copy()) for c in (bits[:, 0], bits[:, 1]))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "name", "name2", "tokens", "s1", "s2"])

    return docs.mapInArrow(run, "id long, n long, name long, name2 long, tokens binary, s1 long, s2 long")


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One bit of each token: two longs a row."""
    return np.packbits((tokens & 1).astype(np.uint8), axis=1).view(np.int64)


def close(a: str, b: str) -> Column:
    """Whether set sizes and sketches of two structs (n, s1, s2) allow a link."""
    x, y = F.col(a), F.col(b)
    sizes = F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * PERCENT
    return sizes & (F.bit_count(x["s1"].bitwiseXOR(y["s1"])) + F.bit_count(x["s2"].bitwiseXOR(y["s2"])) <= MAX_BITS)


def start_nodes(reps: DataFrame, trees: int, depth: int) -> DataFrame:
    """reps: id, tokens. (node, id) at the start depth of every tree; nodes depend on a document's own tokens alone."""
    rate = 100.0 / PERCENT / COORDINATES

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * STEP)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                tokens = np.frombuffer(b"".join(part.column("tokens").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                owners, paths = np.repeat(np.arange(len(tokens)), trees), np.tile(roots, len(tokens))
                for _ in range(depth):
                    owners, paths = children(tokens, owners, paths, rate)
                ids = part.column("id").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(ids[owners])], names=["node", "id"])

    return reps.select("id", "tokens").mapInArrow(run, "node long, id long")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, grams) of the documents in ids: the sorted shingle hashes, binary."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([shingle_set(x).tobytes() for x in part.column("text").to_pylist()], pa.binary())], names=["id", "grams"])

    return docs.join(ids.hint("shuffle_hash"), "id", "left_semi").mapInArrow(run, "id long, grams binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a written table): a, b, and what else. Those whose full sets are linked."""
    if pairs.isEmpty():
        return pairs
    kept = pairs.columns

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= PERCENT * (len(both) - same))
            yield batch.select(kept).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b")
    return both.select(*kept, "grams_a", "grams_b").mapInArrow(run, pairs.schema)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every left with every right set: products of 0/1 matrices over the values that both sides have, some columns at a time."""
    out = np.zeros((len(left), len(right)), np.float64)
    flat = [np.concatenate(x) for x in (left, right)]
    common = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    if not len(common):
        return out
    entries = []
    for sets, values in zip((left, right), flat, strict=True):
        who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        held = common[at] == values
        who, at = who[held], at[held]
        order = np.argsort(at, kind="stable")
        entries.append((who[order], at[order]))
    step = 2048
    for start in range(0, len(common), step):
        sides = []
        for (who, at), sets in zip(entries, (left, right), strict=True):
            a, b = np.searchsorted(at, [start, start + step])
            m = np.zeros((len(sets), min(step, len(common) - start)), np.float32)
            m[who[a:b], at[a:b] - start] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _compare(t: pa.Table) -> pa.Table:
    """Of one pair of blocks: two components for each link between different ones."""
    outside = np.array(t.column("outside").to_pylist(), bool)
    comps = t.column("c").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("grams")]
    left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
    found = np.zeros((0, 2), np.int64)
    if len(left) and len(right):
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        same = overlaps([sets[i] for i in left], [sets[i] for i in right])
        linked = (100 * same >= PERCENT * (n[left][:, None] + n[right][None, :] - same)) & (comps[left][:, None] != comps[right][None, :])
        i, j = np.nonzero(linked)
        found = np.unique(np.sort(np.stack([comps[left[i]], comps[right[j]]], axis=1), axis=1), axis=0)
    return pa.table({"a": pa.array(found[:, 0].copy(), pa.int64()), "b": pa.array(found[:, 1].copy(), pa.int64())})


def _shared_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of two documents or more, with their size and smallest id."""
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("leader")).filter("members > 1")
    return nodes.join(shared, "node").select("node", "id", "members", "leader")


def _screened(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs: a, b, and what else. Those that set sizes and sketches allow."""
    of = lambda x: sketches.select(F.col("id").alias(x), F.struct("n", "s1", "s2").alias(f"of_{x}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(close("of_a", "of_b")).select(*pairs.columns)


def _open_nodes(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """Nodes that hold more than one component, with c (the component of each id so far), main (the node's largest one) and members."""
    labelled = nodes.join(comps, "id", "left").select("node", "id", F.coalesce("component", "id").alias("c"))
    per = labelled.groupBy("node", "c").agg(F.count(F.lit(1)).alias("k"))
    sizes = per.groupBy("node").agg(F.sum("k").alias("members"), F.max("k").alias("most"), F.max_by("c", F.struct("k", -F.col("c"))).alias("main")).filter("members > most")
    return labelled.join(sizes.select("node", "members", "main"), "node")


def _pairs_of_small(open_nodes: DataFrame) -> DataFrame:
    """Pairs of members of a small node in different components: a, b and their components. One of a pair at least is outside the largest component."""
    small = open_nodes.filter(F.col("members") <= SMALL)
    right = small.filter("c <> main").select("node", F.col("id").alias("id2"), F.col("c").alias("c2"))
    pairs = small.join(right, "node").filter((F.col("c") != F.col("c2")) & ((F.col("c") == F.col("main")) | (F.col("id") < F.col("id2"))))
    ordered = F.when(F.col("id") < F.col("id2"), F.struct(F.col("id").alias("a"), F.col("id2").alias("b"), F.col("c").alias("ca"), F.col("c2").alias("cb"))).otherwise(F.struct(F.col("id2").alias("a"), F.col("id").alias("b"), F.col("c2").alias("ca"), F.col("c").alias("cb")))
    return pairs.select(ordered.alias("p")).select("p.*").distinct()


def _links_of_large(open_nodes: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b: components) found by comparing, for each main component of large nodes, those outside it with all of their members."""
    members = stage(open_nodes.filter(F.col("members") > SMALL).select("main", "id", "c").distinct().join(sketches.select("id", "n"), "id"), "near-large")
    count = lambda of: F.ceil(F.greatest(F.count(F.when(of, 1)) / BLOCK, F.sum(F.when(of, F.col("n") * 8)) / BLOCK_BYTES))
    sizes = members.groupBy("main").agg(count(F.lit(True)).alias("rights"), count(F.col("c") != F.col("main")).alias("lefts"))
    dealt = members.join(sizes, "main")
    place = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    left = dealt.filter("c <> main").select("main", "id", "c", F.lit(True).alias("outside"), place("lefts").alias("l"), every("rights").alias("r"))
    right = dealt.select("main", "id", "c", F.lit(False).alias("outside"), every("lefts").alias("l"), place("rights").alias("r"))
    return left.unionByName(right).join(sets, "id").groupBy("main", "l", "r").applyInArrow(_compare, "a long, b long").distinct()


def classes(source: DataFrame, *, trees: int = TREES, start_depth: int = START_DEPTH) -> DataFrame:
    """source: id (unique), text. id, n_shingles and component (the smallest id reachable)."""
    every = stage(summaries(source), "near-summaries")
    # Documents of one set: the smallest id stands for all
    folds = every.filter("n > 0").groupBy("name", "name2", "n").agg(F.min("id").alias("rep"))
    reps = stage(every.join(folds.select("rep"), F.col("id") == F.col("rep"), "left_semi").select("id", "n", "tokens", "s1", "s2"), "near-reps")
    sketches = reps.select("id", "n", "s1", "s2")
    # Nodes of one document have nothing to compare
    nodes = stage(_shared_nodes(start_nodes(reps, trees, start_depth)), "near-nodes")
    sets = stage(full_sets(source, nodes.select("id").distinct()), "near-sets")
    star = nodes.filter("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    compared = stage(_screened(star, sketches), "near-pairs")
    comps = components(confirmed(compared, sets))
    open_nodes = stage(_open_nodes(nodes, comps), "near-open")
    few = stage(_screened(_pairs_of_small(open_nodes).join(compared, ["a", "b"], "left_anti"), sketches), "near-across")
    more = confirmed(few, sets).select(F.col("ca").alias("a"), F.col("cb").alias("b")).union(_links_of_large(open_nodes, sketches, sets))
    merged = components(more, "merged").select(F.col("id").alias("c1"), F.col("component").alias("c2"))
    of_rep = folds.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("name", "name2", "n", F.coalesce("component", "rep").alias("c1"))
    of_rep = of_rep.join(merged, "c1", "left").select("name", "name2", "n", F.coalesce("c2", "c1").alias("component"))
    out = every.select("id", "n", "name", "name2").join(of_rep, ["name", "name2", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept (one row of each component)."""
    ship(docs.sparkSession)
    source, plain = keyed(docs.select(column_or_null(docs, id_col, "long").alias("own"), column_or_null(docs, text_col, "string").alias("text")), "own", "id")
    found = classes(source.select("id", "text"), **how)
    kept = (F.col("id") == F.col("component")).alias("kept")
    if plain:
        return found.select("id", "n_shingles", F.col("component").alias("component_id"), kept)
    names = source.select(F.col("id").alias("key"), "own")
    found = found.select("*", kept).join(names, F.col("id") == F.col("key")).select(F.col("own").alias("id"), "n_shingles", "component", "kept")
    return found.join(names, F.col("component") == F.col("key")).select("id", "n_shingles", F.col("own").alias("component_id"), "kept")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs."""
    ship(docs.sparkSession)
    key = free_name(docs, "_row")
    rows, _ = keyed(docs, id_col, key)
    found = classes(rows.select(F.col(key).alias("id"), column_or_null(docs, text_col, "string").alias("text")), **how)
    kept = found.filter("id = component").select(F.col("id").alias(key))
    return rows.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: All pairs that share a shingle, and the smallest id reachable.
ORACLE = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + {SHINGLE - 1}], ' ')) AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= {PERCENT} * (p.n + q.n - k)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
near AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT near.doc_id, edges.b FROM near JOIN edges ON near.other = edges.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM near GROUP BY doc_id) USING (doc_id)
"""

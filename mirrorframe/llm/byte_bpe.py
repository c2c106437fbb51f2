"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the tokenizer's pattern, and each piece is encoded by itself. A segment tree over the byte
positions of a piece holds, in each node, the least rank of a pair of neighbouring live tokens below it, leftmost on ties. The
root names the next merge; a merge changes the pairs of at most three live positions, each a point update of logarithmic
cost. Many short pieces are worked on at once: their trees are the rows of one NumPy array per level. Long
pieces get a tree of their own.

Pieces repeat, so each worker process remembers the ids of pieces in a table of bounded size. Rows are independent: no
shuffle, and a lost executor costs the repetition of its tasks.

Defined results: null and empty texts encode to no ids; a null id array decodes to empty bytes; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored by encode() and kept by decode().
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import column_or_null, released, remembered, table

NONE = np.int64(1 << 40)
#: Pieces of up to this many bytes are encoded together.
SHORT = 64
#: Pieces that a worker process remembers at most.
REMEMBERED = 300_000
#: Letters and numbers of Latin-1, for a faster form of the pattern where a text has no other characters.
LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"


class Bpe:
    """Ranks of a byte-level BPE: a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        # White space is the Unicode property, which differs from the module's own
        self.ranks, self.pattern = ranks, regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        known = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    known[a << 24 | b] = rank
        # A hash table with linear probing over the pairs, for look-ups by the array
        self.bits = max(4, (4 * len(known)).bit_length())
        self.keys, self.values = np.full((1 << self.bits) + 64, -1, np.int64), np.full((1 << self.bits) + 64, NONE, np.int64)
        self.probes = 1
        for key, rank in known.items():
            at = self._slot(key)
            n = 1
            while self.keys[at] >= 0:
                at, n = at + 1, n + 1
            self.keys[at], self.values[at], self.probes = key, rank, max(self.probes, n)
        self.known = known
        self.seen: dict[str, bytes] = {}
        gpt = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
        space = r"\t-\r\x20\x85\xa0"
        self.latin = re.compile(f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{LETTERS}{NUMBERS}]+|[{space}]+(?![^{space}])|[{space}]+") if pattern == gpt else None

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, NONE where they don't merge."""
        key = left << 24 | right
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)
        out = np.full(len(key), NONE, np.int64)
        for step in range(self.probes):
            hit = self.keys[at + step] == key
            out[hit] = self.values[at[hit] + step]
        return out

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of 1 to SHORT bytes, as little-endian unsigned 32-bit integers."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = 1 << max(1, int(lengths.max() - 1).bit_length())
        rows = len(pieces)
        ids = np.zeros((rows, width), np.int64)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.arange(1, width + 1), lengths[:, None])  # next live position, the length at the end
        before = np.broadcast_to(np.arange(-1, width - 1), (rows, width)).copy()
        live = np.arange(width) < lengths[:, None]
        leaf = np.full((rows, width), NONE, np.int64)
        r, c = np.nonzero(after[:, :] < lengths[:, None])
        keep = live[r, c]
        r, c = r[keep], c[keep]
        leaf[r, c] = self.pairs(ids[r, c], ids[r, after[r, c]])
        # A node holds rank * width + position: its minimum is the least rank, leftmost on ties
        tree = [leaf * width + np.arange(width)]
        while tree[-1].shape[1] > 1:
            tree.append(np.minimum(tree[-1][:, 0::2], tree[-1][:, 1::2]))
        bound = NONE * width
        todo = np.nonzero(tree[-1][:, 0] < bound)[0]

        def put(rows_: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            tree[0][rows_, at] = rank * width + at
            for level in range(1, len(tree)):
                at = at >> 1
                below = tree[level - 1]
                tree[level][rows_, at] = np.minimum(below[rows_, 2 * at], below[rows_, 2 * at + 1])

        while len(todo):
            best = tree[-1][todo, 0]
            at, rank = best % width, best // width
            gone = after[todo, at]
            nxt = after[todo, gone]
            ids[todo, at] = rank
            live[todo, gone] = False
            after[todo, at] = nxt
            put(todo, gone, np.full(len(todo), NONE))
            inner = nxt < lengths[todo]
            new = np.full(len(todo), NONE, np.int64)
            t, a, x = todo[inner], at[inner], nxt[inner]
            before[t, x] = a
            new[inner] = self.pairs(ids[t, a], ids[t, x])
            put(todo, at, new)
            prev = before[todo, at]
            has = prev >= 0
            t, a, x = todo[has], prev[has], at[has]
            put(t, a, self.pairs(ids[t, a], ids[t, x]))
            todo = todo[tree[-1][todo, 0] < bound]
        flat = ids[live].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_long(self, piece: bytes) -> bytes:
        """Ids of one piece of any length, by a tree of its own."""
        n = len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), n], list(range(-1, n - 1))
        known, none = self.known, int(NONE)
        size = 1 << (n - 1).bit_length()
        ranks = [known.get(ids[i] << 24 | ids[i + 1], none) for i in range(n - 1)] + [none] * (size - n + 1)
        # nodes hold positions; a node's value is that of the better child, the left one on ties
        tree = [0] * size + list(range(size))
        for v in range(size - 1, 0, -1):
            a, b = tree[2 * v], tree[2 * v + 1]
            tree[v] = a if ranks[a] <= ranks[b] else b

        def update(i: int) -> None:
            v = (i + size) >> 1
            while v:
                a, b = tree[2 * v], tree[2 * v + 1]
                tree[v] = a if ranks[a] <= ranks[b] else b
                v >>= 1

        while ranks[i := tree[1]] < none:
            gone = after[i]
            nxt = after[gone]
            ids[i], ids[gone], after[i] = ranks[i], -1, nxt
            ranks[gone] = none
            update(gone)
            if nxt < n:
                before[nxt] = i
                ranks[i] = known.get(ids[i] << 24 | ids[nxt], none)
            else:
                ranks[i] = none
            update(i)
            if (p := before[i]) >= 0:
                ranks[p] = known.get(ids[p] << 24 | ids[i], none)
                update(p)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if self.latin is not None:
            try:
                text.encode("latin-1")
                return self.latin.findall(text)
            except UnicodeEncodeError:
                pass
        return self.pattern.findall(text)

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't known yet."""
        short: list[tuple[str, bytes]] = []
        for p in pieces:
            raw = p.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.seen[p] = rank.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                short.append((p, raw))
            else:
                self.seen[p] = self.encode_long(raw)
        short.sort(key=lambda x: len(x[1]))
        for start in range(0, len(short), 4096):
            part = short[start : start + 4096]
            for (p, _), ids in zip(part, self.encode_short([raw for _, raw in part]), strict=True):
                self.seen[p] = ids

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(x) if x else [] for x in texts]
        new = set().union(*cut) - self.seen.keys() if cut else set()
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen.clear()
            new = set().union(*cut)
        self.learn(new)
        get = self.seen.__getitem__
        return [b"".join(map(get, x)) for x in cut]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load(name: str, pattern: str) -> Bpe:
    """The tokenizer of a ranks file that SparkContext.addFile has sent to every node, built once a process."""
    loaded = remembered(__name__)
    if (name, pattern) not in loaded:
        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        loaded[name, pattern] = Bpe(ranks, pattern)
    return loaded[name, pattern]


def _send(spark: SparkSession, path: str) -> str:
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode(docs: DataFrame, *, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids: the text's token ids as little-endian unsigned 32-bit integers, binary."""
    name = _send(docs.sparkSession, ranks_path)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.encode(part.column(1).to_pylist()), pa.binary())], names=["id", "ids"])

    source = docs.select(column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, text_col, "string").alias("text"))
    return source.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode(df: DataFrame, *, ranks_path: str, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (binary): the bytes of the ids, which are UTF-8 for ids of whole texts."""
    name = _send(df.sparkSession, ranks_path)
    keep = [c for c in df.columns if c != "decoded"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(name, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = [bpe.decode(x or b"") for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(made, pa.binary())], names=[*keep, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    return df.select(*keep).mapInArrow(run, f"{kept}, decoded binary")


def token_digest(docs: DataFrame, *, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each document's encoding and its decoding."""
    back = decode(encode(docs, ranks_path=ranks_path, id_col=id_col), ranks_path=ranks_path)
    return back.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded by the multilingual byte-level ranks."""
    return token_digest(table(spark, sf_dir, "documents"), ranks_path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


"""Token-ID binary output: shards of separately compressed documents under one shared zstandard dictionary.

The dictionary is trained on serialized id arrays of a sample of documents (about `sample_docs` and at most twice as many, by a hash
of the id; it only affects compression). A shard is one row of a Parquet table: its range of ids, the SHA-256 of its dictionary, an offset index and the
concatenated frames. Ids are unsigned 16-bit where the vocabulary allows, 32-bit otherwise. A look-up (`read_documents`) finds a document in the
index, checks the dictionary's hash and decompresses that document alone. Parquet's statistics on the ids of a
shard let it skip all other shards.

Plan: tokenizing happens once and its compressed result is written to the shared folder; those frames are range-sorted by id and cut
into shards of bounded size; the start of each shard is a prefix sum over one row a shard. Nothing but the
dictionary passes the driver.

Defined results: null and empty texts have the end id alone; a null id comes first; rows that repeat an id are stored one after the other;
very long texts are worked on alone; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mirrorframe.llm.common import column_or_null, new_path, released, remembered, stage, table

#: Bytes of frames after which a shard is closed.
SHARD_BYTES = 4 << 20
DICT_BYTES = 64 << 10
#: Chunks whose ids a worker process remembers at most.
REMEMBERED = 1_200_000


class ChunkEncoder:
    """Encodes texts by their chunks between blanks, which this kind of tokenizer never joins; ids of known chunks are remembered.

    So that chunks meet again, ASCII letters are lower-cased (where no combining mark could join them) and a comma or full stop after a letter is a chunk of its own, as the
    tokenizer does both later itself. A text that spells an added token, in any case, goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        added = [re.escape(x.content.lower()) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.spelled = f"(?i){'|'.join(added)}" if added else ""
        self.forget()

    def forget(self) -> None:
        """Known chunks by number; their ids lie end to end in `pool`."""
        self.seen: dict[str, int] = {}
        self.starts, self.sizes, self.pool, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.kind), 0

    def learn(self, chunks: list[str]) -> None:
        known, more = len(self.seen), len(chunks)
        found = [e.ids for s in range(0, more, 1 << 15) for e in self.tokenizer.encode_batch_fast(chunks[s : s + (1 << 15)], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, more)
        total = int(sizes.sum())
        while known + more > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), self.kind, total)
        self.sizes[known : known + more] = sizes
        self.starts[known : known + more] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        self.seen.update(zip(chunks, range(known, known + more), strict=True))

    def numbers(self, distinct: list[str]) -> np.ndarray:
        """Numbers of distinct chunks, learnt where they are new."""
        at = list(map(self.seen.get, distinct))
        new = [x for x, k in zip(distinct, at, strict=True) if k is None]
        if len(self.seen) + len(new) > REMEMBERED and self.seen:
            self.forget()
            return self.numbers(distinct)
        if new:
            first = len(self.seen)
            self.learn(new)
            fresh = iter(range(first, first + len(new)))
            at = [next(fresh) if k is None else k for k in at]
        return np.array(at, np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """Ids of each text and the end id."""
        last = np.array([end_id], self.kind).tobytes()
        texts = pc.fill_null(texts, "")
        spelled = np.flatnonzero(pc.match_substring_regex(texts, self.spelled).to_numpy(zero_copy_only=False)) if self.spelled else []
        plain = pc.if_else(pc.match_substring_regex(texts, r"\pM"), texts, pc.ascii_lower(texts))
        plain = pc.replace_substring_regex(pc.replace_substring(plain, "\n", " "), r"(\pL)([,.])", r"\1 \2")
        chunks = pc.split_pattern(plain, " ")
        words = pc.dictionary_encode(chunks.flatten())
        number = self.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
        n = self.sizes[number]
        ends = np.cumsum(n)
        # Gather the ids of all chunks by their places in the pool
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[number] - ends + n, n)]
        edges = np.concatenate([[0], ends])[chunks.offsets.to_numpy()]
        out = [ids[a:b].tobytes() + last for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        for i in spelled:
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.kind).tobytes() + last
        return out


def slices(column: pa.Array, rows: int, chars: int) -> Iterator[slice]:
    """Runs of at most `rows` texts and, unless one alone is longer, `chars` bytes."""
    n = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = size = 0
    for i, x in enumerate(n):
        if i > start and (i - start == rows or size + x > chars):
            yield slice(start, i)
            start, size = i, 0
        size += x
    if start < len(n):
        yield slice(start, len(n))


def loaded(name: str) -> ChunkEncoder:
    """The tokenizer file that SparkContext.addFile has sent to every node, built once a process."""
    encoders = remembered(__name__)
    if name not in encoders:
        encoders[name] = ChunkEncoder(SparkFiles.get(name))
    return encoders[name]


def _fits(path: str) -> bool:
    """Whether blanks always part tokens and are dropped, and case and full stops don't matter, as the chunk encoder needs."""
    own = ChunkEncoder(path)
    probe = ["a b", "Don't STOP\nnow", "x  ' s", "é 9 9,9 \n ok", "An end. Or,not...so.", "É.À, H\u0331,x"]
    return all(own.tokenizer.encode(p, add_special_tokens=False).ids == np.frombuffer(x, own.kind).tolist()[:-1] for p, x in zip(probe, own.encode(pa.array(probe), 0), strict=True))


def train_dictionary(docs: DataFrame, name: str, end_id: int, sample_docs: int) -> bytes:
    """A zstandard dictionary from the id arrays of the sample; empty where the sample is too small for one."""
    share = sample_docs / max(1, docs.count())
    picked = docs.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * sample_docs)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(name)
        for batch in batches:
            for at in slices(batch.column("text"), 4096, 8 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(encoder.encode(batch.column("text").slice(at.start, at.stop - at.start), end_id), pa.binary())], names=["raw"])

    rows = [bytes(r.raw) for r in picked.mapInArrow(run, "raw binary").collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_tokens(docs: DataFrame, path: str, *, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1000) -> bytes:
    """Write the ids of all documents, in ascending id order, as shards below `path`; returns the dictionary, also kept in `path`/dictionary."""
    spark = docs.sparkSession
    if not _fits(tokenizer_path):
        raise ValueError("this tokenizer doesn't work chunk by chunk")
    spark.sparkContext.addFile(tokenizer_path)
    name = tokenizer_path.rsplit("/", 1)[-1]
    source = docs.select(column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, text_col, "string").alias("text"))
    shared = train_dictionary(source, name, end_id, sample_docs)
    sha = hashlib.sha256(shared).hexdigest()
    spark.createDataFrame([(sha, bytearray(shared))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    @released
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(name)
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in slices(batch.column("text"), 4096, 8 << 20):
                part = batch.slice(at.start, at.stop - at.start)
                raw = encoder.encode(part.column("text"), end_id)
                n = [len(x) // encoder.kind.itemsize for x in raw]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array([pack.compress(x) for x in raw], pa.binary())], names=["id", "n", "frame"])

    frames = stage(source.mapInArrow(compress, "id long, n long, frame binary"), "token-frames")

    @released
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, bytes]] = []
        size = number = 0
        kinds = {"part": pa.int64(), "number": pa.int64(), "first_id": pa.int64(), "last_id": pa.int64(), "n_docs": pa.int64(), "n_tokens": pa.int64(), "dict_sha256": pa.string(), "index": pa.binary(), "frames": pa.binary()}
        context = TaskContext.get()
        part_id = context.partitionId() if context else 0

        def close() -> pa.RecordBatch:
            ids = np.array([(x or 0) for x, _, _ in held], "<i8")
            nulls = np.array([x is None for x, _, _ in held], "<i8")
            n = np.array([x for _, x, _ in held], "<i8")
            offsets = np.cumsum([0, *(len(x) for _, _, x in held)], dtype="<i8")[:-1]
            index = np.stack([ids, nulls, offsets, n], axis=1).astype("<i8").tobytes()
            row = {"part": part_id, "number": number, "first_id": held[0][0], "last_id": held[-1][0], "n_docs": len(held), "n_tokens": int(n.sum()), "dict_sha256": sha, "index": index, "frames": b"".join(x for _, _, x in held)}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], names=list(kinds))

        for batch in batches:
            for one in zip(*(batch.column(k).to_pylist() for k in ("id", "n", "frame")), strict=True):
                held.append(one)
                size += len(one[2])
                if size >= SHARD_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    ordered = frames.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "n", "frame")
    ordered.mapInArrow(shards, "part long, number long, first_id long, last_id long, n_docs long, n_tokens long, dict_sha256 string, index binary, frames binary").write.option("compression", "uncompressed").parquet(f"{path}/shards")
    return shared


def _dictionary(spark: SparkSession, path: str) -> tuple[bytes, str]:
    kept = spark.read.parquet(f"{path}/dictionary").first()
    shared, sha = bytes(kept.dictionary), kept.dict_sha256
    if hashlib.sha256(shared).hexdigest() != sha:
        raise ValueError("the dictionary is damaged")
    return shared, sha


def _with_starts(shards: DataFrame) -> DataFrame:
    """shards with start, the number of ids in all shards before; the window runs over one small row a shard, and those rows go to the shards, whose frames stay where they are."""
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return shards.drop("n_tokens").join(F.broadcast(shards.select("part", "number", "n_tokens").select("part", "number", before.alias("start"))), ["part", "number"])


def _unpacked(shards: DataFrame, path: str, wide: bool, wanted: list[int | None] | None = None) -> DataFrame:
    """The documents of shards with starts; those of the wanted ids alone are decompressed where some are given."""
    shared, sha = _dictionary(shards.sparkSession, path)
    kind = np.dtype("<u4" if wide else "<u2")
    some = None if wanted is None else (np.array(sorted({x for x in wanted if x is not None}), np.int64), None in wanted)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared)) if shared else zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                start, said, index = (batch.column(k)[row].as_py() for k in ("start", "dict_sha256", "index"))
                if said != sha:
                    raise ValueError(f"a shard needs the dictionary {said}")
                frames = batch.column("frames")[row].as_buffer()
                ids, nulls, offsets, n = np.frombuffer(index, "<i8").reshape(-1, 4).T
                firsts, ends = start + np.cumsum(n) - n, np.append(offsets[1:], len(frames))
                take = np.arange(len(n)) if some is None else np.flatnonzero(np.where(nulls == 1, some[1], np.isin(ids, some[0])))
                for s in range(0, len(take), 1024):
                    at = take[s : s + 1024]
                    raw = [np.frombuffer(unpack.decompress(frames[a:b]), kind).astype("<u4").tobytes() for a, b in zip(offsets[at].tolist(), ends[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64(), mask=nulls[at] == 1), pa.array(firsts[at], pa.int64()), pa.array(n[at], pa.int64()), pa.array(raw, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    return shards.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def read_tokens(spark: SparkSession, path: str, *, wide: bool = False) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers), from the files below `path`.

    Raises where a shard was written under another dictionary than the one in `path`.
    """
    return _unpacked(_with_starts(spark.read.parquet(f"{path}/shards")), path, wide)


def read_documents(spark: SparkSession, path: str, ids: list[int | None], *, wide: bool = False) -> DataFrame:
    """read_tokens for a list of ids: other shards are passed over by their statistics, and only the frames of these documents are decompressed. Every row of a repeated id is returned."""
    shards, known = spark.read.parquet(f"{path}/shards"), [x for x in ids if x is not None]
    holds = F.lit(False)
    if known:
        within = F.exists(F.array(*[F.lit(x).cast("long") for x in sorted(set(known))]), lambda x: (x <= F.col("last_id")) & (F.col("first_id").isNull() | (x >= F.col("first_id"))))
        holds = (F.col("last_id") >= min(known)) & (F.col("first_id").isNull() | (F.col("first_id") <= max(known))) & within
    return _unpacked(_with_starts(shards).filter(holds | F.col("first_id").isNull() if None in ids else holds), path, wide, list(ids))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written to the shared folder and read back."""
    path = new_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


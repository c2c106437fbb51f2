"""Language ID by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 that depends on its code point alone. An n-gram's vector binds its letters: the element-wise
product of their vectors, each rotated by its distance from the end. A document's vector bundles (adds up) those of its
n-grams; a language's prototype bundles those of all documents it is learnt from. A document gets the language
whose prototype has the largest cosine with it.

Bundling is linear, so prototypes come from n-gram counts by language: each task counts its own, Spark adds the counts up, and each
task bundles its part of them; the parts of a language are added up in one group, of one vector a task. What reaches the driver is one vector per
language. Documents are worked on in blocks of bounded size: counts of the block's n-grams times their vectors, one matrix product.

Defined results: a null text or one without a letter is `und` with score 0; ties go to the language that sorts first; without any learnt
language every document is `und`; repeated rows get equal results; very long texts are blocks of their own; an empty table gives an empty result; held_out is
null for a null doc_id, which is never learnt from; other columns stay as they are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import column_or_null, free_name, released, remembered, table

#: Production parameters: length of the vectors, letters in an n-gram, documents and characters in a block.
SIZE = 1024
N = 3
BLOCK = 64
BLOCK_CHARS = 1 << 19
#: Rows of the table of n-gram vectors that a worker process keeps at most.
REMEMBERED = 60_000
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; built once a process."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str | None) -> np.ndarray:
    """Codes of the text's n-grams: lower-cased letters, 21 bits each, every run of other characters as one blank; empty without a letter."""
    if not text:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[x]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    x = np.where(is_letter, x, 32)[is_letter | np.concatenate([[True], is_letter[:-1]])].astype(np.uint64)
    out = x[: len(x) - N + 1]
    for i in range(1, N):
        out = out << np.uint64(21) | x[i : len(x) - N + 1 + i]
    return out


class Space:
    """Vectors of n-grams, remembered up to a bound."""

    def __init__(self, size: int):
        self.size, self.letters = size, {}
        self.row: dict[int, int] = {}
        self.vectors = np.zeros((1024, size), np.int8)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([point, self.size])).integers(0, 2, self.size, dtype=np.int8)
            self.letters[point] = bits * 2 - 1
        return self.letters[point]

    def bind(self, code: int) -> np.ndarray:
        out = np.ones(self.size, np.int8)
        for i in range(N):
            out = out * np.roll(self.letter(code >> 21 * i & 0x1FFFFF), i)
        return out

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of distinct codes, as rows of floats."""
        known = codes.tolist()
        if len(self.row) + len(known) > max(REMEMBERED, len(known)):
            self.row.clear()
        for code in known:
            if code not in self.row:
                at = self.row[code] = len(self.row)
                if at >= len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                self.vectors[at] = self.bind(code)
        return self.vectors[[self.row[c] for c in known]].astype(np.float32)

    def bundle(self, docs: list[np.ndarray]) -> np.ndarray:
        """One row per document: the sum of its n-grams' vectors."""
        every = np.concatenate(docs)
        if not len(every):
            return np.zeros((len(docs), self.size), np.float32)
        codes, at = np.unique(every, return_inverse=True)
        who = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
        counts = np.bincount(who * len(codes) + at, minlength=len(docs) * len(codes)).reshape(len(docs), len(codes)).astype(np.float32)
        # A few thousand n-grams at a time bound the memory of very long or odd documents
        return sum(counts[:, s : s + 8192] @ self.of(codes[s : s + 8192]) for s in range(0, len(codes), 8192))


def space(size: int) -> Space:
    """One space a process."""
    spaces = remembered(__name__)
    if size not in spaces:
        spaces[size] = Space(size)
    return spaces[size]


def learn(rows: DataFrame, *, size: int = SIZE) -> dict[str, np.ndarray]:
    """rows: text, lang. Unit prototype of each language."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                own: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    own.setdefault(lang, []).append(grams(text))
                for lang, found in own.items():
                    codes, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counts = rows.filter("text is not null and lang is not null").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))

    @released
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = space(size), {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            codes, n = batch.column("code").to_numpy().view(np.uint64), batch.column("n").to_numpy().astype(np.float64)
            for lang in set(langs.tolist()):
                mine = np.flatnonzero(langs == lang)
                for s in range(0, len(mine), 4096):
                    at = mine[s : s + 4096]
                    sums[lang] = sums.get(lang, 0) + n[at] @ own.of(codes[at])
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.astype("<f8").tobytes() for x in sums.values()], pa.binary())], names=["lang", "part"])

    def add(t: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x, "<f8") for x in t.column("part").to_pylist())
        return pa.table({"lang": t.column("lang").slice(0, 1), "whole": pa.array([whole.tobytes()], pa.binary())})

    wholes = counts.mapInArrow(bundle, "lang string, part binary").groupBy("lang").applyInArrow(add, "lang string, whole binary")
    out = {row.lang: np.frombuffer(bytes(row.whole), "<f8") for row in wholes.collect()}
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v))}


def blocks(texts: list[str | None]) -> Iterator[slice]:
    """Runs of at most BLOCK texts and, unless one alone is longer, BLOCK_CHARS characters."""
    start = chars = 0
    for i, x in enumerate(texts):
        n = len(x or "")
        if i > start and (i - start == BLOCK or chars + n > BLOCK_CHARS):
            yield slice(start, i)
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield slice(start, len(texts))


def language_of(spark: SparkSession, text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """struct(lang, score) of a text column; score is the cosine cut to 0 to 1. Only the text moves to Python, and only the result back."""
    names = list(prototypes)
    shared = spark.sparkContext.broadcast(np.stack([prototypes[k] for k in names]).astype(np.float32) if names else np.zeros((0, SIZE), np.float32))

    @F.arrow_udf("struct<lang: string, score: double>")
    @released
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, against = space(shared.value.shape[1]), shared.value
        for batch in batches:
            texts = batch.to_pylist()
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            for part in blocks(texts) if names else ():
                found = [grams(x) for x in texts[part]]
                vectors = own.bundle(found)
                cosines = vectors @ against.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
                for i, b in enumerate(cosines.argmax(axis=1).tolist()):
                    if len(found[i]):
                        langs[part.start + i], scores[part.start + i] = names[b], float(np.clip(cosines[i, b], 0, 1))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return run(text)


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its score; columns of those names are replaced."""
    found = language_of(docs.sparkSession, column_or_null(docs, text_col, "string"), prototypes)
    keep = [c for c in docs.columns if c.lower() not in (lang_col.lower(), score_col.lower())]
    held = free_name(docs, "found")
    both = docs.select(*[F.col(f"`{c}`") for c in keep], found.alias(held))
    return both.select(*[F.col(f"`{c}`") for c in keep], F.col(f"{held}.lang").alias(lang_col), F.col(f"{held}.score").alias(score_col))


def with_language(docs: DataFrame, prototypes: dict[str, np.ndarray], *, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a language (is not `und`), with the columns of docs."""
    return docs.filter(language_of(docs.sparkSession, column_or_null(docs, text_col, "string"), prototypes)["lang"] != "und")


def learnable(docs: DataFrame) -> DataFrame:
    """Rows to learn from: crc32(doc_id as text) mod 5 is not 0, and a language is given."""
    return docs.filter((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull()).select("text", "lang")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(learnable(docs)))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, mixing by weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes every
stage as Parquet in the shared folder and reads it back as the next one's docs.

Defined results: every row is a document of its own, also where ids repeat or are null; names of further columns don't matter, and their values
stay as they are. Null texts and texts without a letter go in the first stage. Of repeated rows one is left after the second. An empty
table passes through. Where no language can be learnt (no row has one), no text has a language and all go.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mirrorframe.llm.byte_bpe import token_digest
from mirrorframe.llm.common import ship, stage, table
from mirrorframe.llm.languages import learn, learnable, with_language
from mirrorframe.llm.mixing import mixed_documents
from mirrorframe.llm.near_dedup import without_near_duplicates
from mirrorframe.llm.repeats import without_repeats


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is found; texts without a letter go."""
    ship(spark)
    return with_language(docs, learn(learnable(docs)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    ship(spark)
    return without_near_duplicates(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur earlier; documents that lose everything go."""
    ship(spark)
    return without_repeats(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights, documents as often as it takes them."""
    ship(spark)
    return mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    ship(spark)
    return token_digest(docs, ranks_path=public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("language", language_stage), ("near_dedup", near_dedup_stage), ("repeats", repeats_stage), ("mix", mix_stage), ("bpe", bpe_stage)]

#: Language profiles, byte-level BPE and the hash order of the mix can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

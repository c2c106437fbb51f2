"""Document fingerprints by consistent weighted sampling, with DataFrame operations only.

The weighted terms of a text are its lower-cased words with their counts. For sample k, a term of weight w draws r
and c from Gamma(2, 1) and b from [0, 1), all functions of (term, k); t = floor(ln w / r + b),
ln a = ln c - r * (t - b + 1), and the sample is the (term, t) of least a. Two texts agree in a sample with probability equal to their
generalised Jaccard similarity, so the share of equal samples estimates it.

Plan: the texts are dealt by id once; the start of each next document joins them there, and term counts, samples and
comparisons all run inside that partitioning, without another exchange of terms. The least ln a is a function of its (term, t) and k alone and so stands for them: one min() over doubles
per sample, inside code generation.

Defined results: null and empty texts are equal and have the fingerprint of no terms; it is all dashes, like itself (1.0) and unlike any
other (0.0). One row is returned per id: where an id repeats, its least text counts. A null id comes
first in order. Very long texts are split into words like others. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mirrorframe.llm.common import column_or_null, stage, table

#: Production parameter: the standard error of a likeness is at most 0.5 / sqrt(SAMPLES), 0.08 here.
SAMPLES = 40
#: Stands for a null id.
NO_ID = -(1 << 63)


def samples(terms: DataFrame, keys: list[str], k: int = SAMPLES) -> DataFrame:
    """terms: keys, term (long), ln_w. One row per keys with s0 .. s{k-1}: the least ln a, which names its (term, t)."""
    out = []
    for i in range(k):
        h = F.xxhash64("term", F.lit(i))
        g = F.xxhash64(h)
        u = lambda x, n: (x.bitwiseAND((1 << n) - 1).cast("double") + 0.5) / float(1 << n)
        r = -F.log(u(h, 14) * u(F.shiftrightunsigned(h, 14), 14))
        c = -F.log(u(g, 32) * u(F.shiftrightunsigned(g, 32), 32))
        b = u(F.shiftrightunsigned(h, 28), 36)
        t = F.floor(F.col("ln_w") / r + b)
        out.append(F.min(F.log(c) - r * (t - b + 1.0)).alias(f"s{i}"))
    return terms.groupBy(*keys).agg(*out)


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal samples. Texts without terms have one sample value that no other text has."""
    same = [F.when(x == y, 1).otherwise(0) for x, y in zip(a, b, strict=True)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return total / float(len(same))


def following(docs: DataFrame) -> DataFrame:
    """id, n_chars, next_id for each id in ascending order; the first follows the last. Range-partitioned, so no task sees all rows."""
    ids = docs.select("id", F.length("text").cast("long").alias("n_chars")).repartitionByRange("id")
    ids = stage(ids.withColumn("part", F.spark_partition_id()), "ids")
    firsts = ids.groupBy("part").agg(F.min(F.struct("id")).alias("first"))
    firsts = firsts.select("part", F.lead("first").over(W.orderBy("part")).alias("later"), F.min("first").over(W.partitionBy()).alias("least"))
    own = F.lead(F.struct("id")).over(W.partitionBy("part").orderBy(F.col("id")))
    nexts = ids.withColumn("own", own).join(firsts, "part")
    return nexts.select("id", "n_chars", F.coalesce("own", "later", "least")["id"].alias("next_id"))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES) -> DataFrame:
    """One row per id: id, n_chars, edited_sha256, fingerprint, edited_fingerprint (k samples of 8 hex digits), near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of the next document.
    """
    # One plain key: null-safe joins would hide the partitioning by id from what follows
    texts = docs.select(F.coalesce(column_or_null(docs, id_col, "long"), F.lit(NO_ID)).alias("id"), F.coalesce(column_or_null(docs, text_col, "string"), F.lit("")).alias("text"))
    if texts.groupBy("id").count().filter("count > 1").limit(1).count():
        texts = texts.groupBy("id").agg(F.min("text").alias("text"))
    nexts = stage(following(texts), "next")
    dealt = texts.repartition("id")
    asked = nexts.select(F.col("id").alias("for_id"), F.col("next_id").alias("asked_id"), F.expr("n_chars div 2").alias("half"))
    heads = dealt.join(asked.hint("shuffle_hash"), F.col("id") == F.col("asked_id")).select("for_id", "half", F.expr("substring(text, 1, cast(half as int))").alias("head"))
    both = dealt.join(heads.hint("shuffle_hash"), F.col("id") == F.col("for_id"))
    both = both.select("id", "text", F.concat(F.expr("substring(text, 1, char_length(text) - cast(half as int))"), "head").alias("edited"))

    words = both.select("id", F.posexplode(F.array("text", "edited")).alias("version", "text"))
    words = words.select("id", "version", F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
    terms = words.select("id", "version", F.xxhash64("word").alias("term")).groupBy("id", "version", "term").agg(F.log(F.count(F.lit(1)).cast("double")).alias("ln_w"))
    sets = samples(terms, ["id", "version"], k)
    packed = F.concat(*[F.lpad(F.lower(F.hex(F.hash(f"s{i}").cast("long").bitwiseAND((1 << 32) - 1))), 8, "0") for i in range(k)])
    sets = sets.select("id", "version", packed.alias("s")).groupBy("id").agg(*[F.max(F.when(F.col("version") == v, F.col("s"))).alias(x) for v, x in ((0, "a"), (1, "b"))])
    per_id = both.select("id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"))
    joined = per_id.join(sets.withColumnRenamed("id", "of").hint("shuffle_hash"), F.col("id") == F.col("of"), "left")
    joined = joined.select("id", "n_chars", "edited_sha256", *[F.coalesce(x, F.lit("-" * 8 * k)).alias(x) for x in "ab"])
    cut = lambda x, i: F.substring(F.col(x), 8 * i + 1, 8)
    near = lambda x, y: likeness([cut(x, i) for i in range(k)], [cut(y, i) for i in range(k)])
    prints = stage(joined.select("id", "n_chars", "edited_sha256", F.col("a").alias("fingerprint"), F.col("b").alias("edited_fingerprint"), near("a", "b").alias("near_edited")), "prints")

    asks = prints.join(nexts.select(F.col("id").alias("of"), "next_id"), F.col("id") == F.col("of")).drop("of")
    other = prints.select(F.col("id").alias("other_id"), F.col("fingerprint").alias("other"))
    return asks.join(other, F.col("next_id") == F.col("other_id")).select(F.nullif("id", F.lit(NO_ID)).alias("id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", near("fingerprint", "other").alias("near_next"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

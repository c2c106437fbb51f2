"""Text policies and personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.functions import pii
from mirrorframe.functions.text import TextPolicy, apply_policy, domain_share, fake_domain
from mirrorframe.plans.model import Column, ColumnType
from mirrorframe.queries.registry import query, sql_uniform, table

_TEXT = [Column("text", ColumnType.TEXT)]


@query("SELECT doc_id, 'hash_' || substr(sha256('pepper:text:' || text), 1, 16) AS text FROM documents")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts replaced by salted hashes."""
    return apply_policy(table(spark, sf_dir, "documents"), _TEXT, TextPolicy.HASH, salt="pepper", key=F.col("doc_id")).select("doc_id", "text")


@query(f"SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN 'text_' || lpad(floor({sql_uniform(4, 'text/text', 'conv_id * 1000 + turn')} * 100000000)::BIGINT::VARCHAR, 8, '0') END AS text FROM conversations")
def text_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts replaced by made-up ones; nulls stay."""
    df = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("turn") % 3 != 0, F.col("text")))
    return apply_policy(df, _TEXT, TextPolicy.FAKE, seed=4, key=F.col("conv_id") * 1000 + F.col("turn")).select("conv_id", "turn", "text")


@query("SELECT doc_id, lang, source FROM documents")
def text_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns dropped."""
    return apply_policy(table(spark, sf_dir, "documents"), _TEXT, TextPolicy.DROP, key=F.col("doc_id")).select("doc_id", "lang", "source")


_HOST = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(f"SELECT page_id, 'host-' || floor({sql_uniform(2, 'text/host', 'page_id')} * 1000000)::BIGINT::VARCHAR || '.example' AS host FROM pages")
def domain_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names replaced by made-up ones."""
    df = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    return df.select("page_id", fake_domain("host", 2, F.col("page_id")).alias("host"))


@query(f"SELECT 'host' AS name, round(avg(regexp_matches(v, '^([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{{2,}}$')::INT), 6) AS share FROM (SELECT {_HOST} AS v FROM pages ORDER BY md5('0:' || {_HOST}), {_HOST} LIMIT 100) UNION ALL SELECT 'url', round(avg(regexp_matches(v, '^([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\\.)+[A-Za-z]{{2,}}$')::INT), 6) FROM (SELECT url AS v FROM pages ORDER BY md5('0:' || url), url LIMIT 100)")
def domain_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of domain names among 100 values: the detector's own sample size."""
    df = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    share = lambda c: domain_share(df, c).select(F.lit(c).alias("name"), F.round("share", 6).alias("share"))
    return share("host").unionByName(share("url"))


_SIMPLE = ["EMAIL_ADDRESS", "URL", "IP_ADDRESS", "US_SSN", "PHONE_NUMBER"]


@query(" UNION ALL ".join(f"SELECT '{e}' AS entity, round(avg(CASE WHEN regexp_matches(text, '{pii.PATTERNS[e][0]}') THEN {pii.PATTERNS[e][1]} ELSE 0 END), 6) AS score, count(*) FILTER (WHERE regexp_matches(text, '{pii.PATTERNS[e][0]}')) AS hits, count(*) AS \"values\" FROM documents" for e in _SIMPLE))
def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in whole texts, by pattern."""
    found = pii.scan(table(spark, sf_dir, "documents"), "text", _SIMPLE)
    return found.select("entity", F.round("score", 6).alias("score"), "hits", "values")


@query("SELECT o_orderkey, (sum(CASE WHEN (n - i) % 2 = 1 THEN CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END ELSE d END) % 10) = 0 AS valid FROM (SELECT o_orderkey, length(c) AS n, unnest(generate_series(1, length(c))) AS i, substr(c, unnest(generate_series(1, length(c))), 1)::INT AS d FROM (SELECT o_orderkey, lpad((o_orderkey * 7919 + o_custkey)::VARCHAR, 16, '4') AS c FROM orders)) GROUP BY o_orderkey")
def card_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Luhn check of 16-digit numbers made from keys."""
    number = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 16, "4")
    return table(spark, sf_dir, "orders").select("o_orderkey", pii.luhn(number).alias("valid"))

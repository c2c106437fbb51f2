import pytest
from pyspark.sql import functions as F

from mirrorframe.functions import pii
from mirrorframe.functions.text import TextPolicy, apply_policy, is_domain_like, slug
from mirrorframe.plans.infer import infer_table
from mirrorframe.plans.model import Column, ColumnType

TEXT = [Column("text", ColumnType.TEXT)]


def test_policies(spark):
    df = spark.createDataFrame([(1, "hello"), (2, None), (3, "hello")], "id int, text string")
    got = [r.text for r in apply_policy(df, TEXT, TextPolicy.HASH, salt="s", key=F.col("id")).collect()]
    assert got[0] == got[2] and got[1] is None and got[0].startswith("hash_") and len(got[0]) == 21
    fake = [r.text for r in apply_policy(df, TEXT, "fake", seed=1, key=F.col("id")).collect()]
    assert fake[1] is None and fake[0] != fake[2] and fake[0].startswith("text_")
    assert apply_policy(df, TEXT, "drop", key=F.col("id")).columns == ["id"]
    assert apply_policy(df, TEXT, "sample", key=F.col("id")) is df
    assert slug("Company Name!") == "company-name"


def test_domains(spark):
    df = spark.createDataFrame([("a.example.com", "x y"), ("b.org", "z")], "h string, t string")
    assert is_domain_like(df, "h") and not is_domain_like(df, "t")


@pytest.mark.parametrize("entity, good, bad", [("EMAIL_ADDRESS", "mail a.b@c.example now", "a@b"), ("IP_ADDRESS", "at 10.0.0.255", "10.0.0.256"), ("US_SSN", "123-45-6789", "1123-45-6789"), ("PHONE_NUMBER", "+1 (212) 555-0100", "12 34"), ("CREDIT_CARD", "4111 1111 1111 1111", "4111 1111 1111 1112"), ("IBAN_CODE", "GB82WEST12345698765432", "GB82WEST12345698765433"), ("URL", "see https://x.example/a", "x.example")])
def test_entities(spark, entity, good, bad):
    df = spark.createDataFrame([(good,), (bad,)], "v string")
    assert [r[0] > 0 for r in df.select(pii.score(F.col("v"), entity)).collect()] == [True, False]


def test_strip_and_restore(spark):
    df = spark.createDataFrame([(i, f"user{i}@mail.example", i % 50) for i in range(30)], "id long, email string, age int")
    table = infer_table("t", df)
    found = pii.detect(df, table.columns)
    assert [(d.column, d.entity) for d in found] == [("email", "EMAIL_ADDRESS")]
    left = pii.strip(table, found)
    assert left.data.columns == ["id", "age"]
    back = pii.restore(left.data, found, df.columns, seed=1, key=F.col("id"))
    assert back.columns == df.columns and back.filter(F.col("email").rlike(pii.PATTERNS["EMAIL_ADDRESS"][0])).count() == 30

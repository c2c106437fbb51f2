"""Personal data: detection by patterns, removal before a fit, and plausible replacements afterwards.

Names of persons and places need a language model and are not detected.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions.rng import below, exact_sample
from mirrorframe.plans.model import Column, ColumnType, Table

SAMPLE = 200
THRESHOLD = 0.6
#: Patterns that a value is searched for, and the score of a hit. They work alike in Java and RE2.
PATTERNS: dict[str, tuple[str, float]] = {
    "EMAIL_ADDRESS": (r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0),
    "URL": (r"https?://[A-Za-z0-9.-]+", 0.95),
    "IP_ADDRESS": (r"(^|[^0-9.])((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])($|[^0-9.])", 0.95),
    "US_SSN": (r"(^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9-])", 0.85),
    "PHONE_NUMBER": (r"(^|[^0-9])(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}($|[^0-9])", 0.75),
    "CREDIT_CARD": (r"(^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3,4}($|[^0-9])", 1.0),
    "IBAN_CODE": (r"(^|[^A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}($|[^A-Z0-9])", 1.0),
}
#: Characters without which a pattern can't match.
NEEDS = {"EMAIL_ADDRESS": "@", "URL": "://"}


@dataclass(frozen=True)
class Detection:
    column: str
    entity: str
    score: float


def luhn(digits: SparkColumn) -> SparkColumn:
    """Whether a text of digits passes the Luhn check."""
    turned = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return (F.length(digits) >= 13) & (total % 10 == 0)


def iban_valid(code: SparkColumn) -> SparkColumn:
    """Whether a code passes the mod-97 check."""
    moved = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    value = lambda i: F.substring(moved, i, F.lit(1))
    step = lambda a, i: F.when(value(i).rlike("[0-9]"), (a * 10 + F.coalesce(value(i).try_cast("int"), F.lit(0))) % 97).otherwise((a * 100 + F.ascii(value(i)) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def holds(c: SparkColumn, entity: str) -> SparkColumn:
    """Whether a value holds an entity. Patterns run only where the value has the characters they need."""
    hit = c.rlike(PATTERNS[entity][0])
    if entity in NEEDS:
        hit = c.contains(NEEDS[entity]) & hit
    if entity == "CREDIT_CARD":
        hit = hit & luhn(F.regexp_replace(F.regexp_extract(c, r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3,4}", 0), "[^0-9]", ""))
    if entity == "IBAN_CODE":
        hit = hit & iban_valid(F.regexp_extract(c, r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 0))
    return hit


def score(c: SparkColumn, entity: str) -> SparkColumn:
    """Score of an entity in a value, 0 without a hit."""
    return F.when(holds(c, entity), PATTERNS[entity][1]).otherwise(0.0)


def scan(df: DataFrame, column: str, entities: Sequence[str] = tuple(PATTERNS)) -> DataFrame:
    """(entity, score, hits, values) of a column over all its non-null values, in one pass that tries each pattern once. The score is the mean of the values'."""
    c = F.col(f"`{column}`")
    row = df.filter(c.isNotNull()).agg(F.count(F.lit(1)).alias("values"), *[F.count_if(holds(c, e)).alias(e) for e in entities])
    mean = lambda e: F.coalesce(F.try_divide(F.col(e) * PATTERNS[e][1], F.col("values")), F.lit(0.0))
    return row.select(F.inline(F.array(*[F.struct(F.lit(e).alias("entity"), mean(e).alias("score"), F.col(e).alias("hits"), F.col("values")) for e in entities])))


def detect(df: DataFrame, columns: list[Column], seed: int = 0) -> list[Detection]:
    """Text and key columns whose sampled values (SAMPLE of them) score THRESHOLD or more for an entity; the best one per column."""
    out = []
    for c in columns:
        if c.type in (ColumnType.TEXT, ColumnType.CATEGORICAL, ColumnType.KEY) and dict(df.dtypes).get(c.name) == "string":
            some = exact_sample(df.filter(F.col(f"`{c.name}`").isNotNull()).select(F.col(f"`{c.name}`").alias("v")), SAMPLE, seed, "v")
            best = scan(some, "v").orderBy(F.desc("score"), "entity").first()
            if best and min(best.score, 1.0) >= THRESHOLD:
                out.append(Detection(c.name, best.entity, min(best.score, 1.0)))
    return out


def strip(table: Table, found: list[Detection]) -> Table:
    """The table without the columns found."""
    gone = {d.column for d in found}
    kept = [c for c in table.columns if c.name not in gone]
    key = table.primary_key if table.primary_key not in gone else None
    return Table(table.name, kept, key, table.data.drop(*gone))


def replacement(entity: str, seed: int, column: str, key: SparkColumn) -> SparkColumn:
    """A made-up value of an entity."""
    n = below(seed, f"pii/{column}", key, 1_000_000_000)
    part = lambda at, size, top: F.floor(n / at) % top
    digits = lambda size: F.lpad((n % 10**size).cast("string"), size, "0")
    made = {
        "EMAIL_ADDRESS": F.concat(F.lit("user"), n.cast("string"), F.lit("@mail.example")),
        "URL": F.concat(F.lit("https://site"), n.cast("string"), F.lit(".example/")),
        "IP_ADDRESS": F.concat_ws(".", F.lit("10"), part(1, 0, 256), part(256, 0, 256), part(65536, 0, 256)),
        "US_SSN": F.concat_ws("-", F.lit("900"), F.lpad(part(10000, 0, 100).cast("string"), 2, "0"), digits(4)),
        "PHONE_NUMBER": F.concat_ws("-", F.lit("555"), F.lpad(part(10000, 0, 1000).cast("string"), 3, "0"), digits(4)),
        "CREDIT_CARD": F.concat(F.lit("0000000"), digits(9)),
        "IBAN_CODE": F.concat(F.lit("XX00TEST"), digits(9)),
    }
    return made[entity]


def restore(df: DataFrame, found: list[Detection], order: list[str], *, seed: int, key: SparkColumn) -> DataFrame:
    """The columns found with made-up values, in the original order."""
    df = df.withColumns({d.column: replacement(d.entity, seed, d.column, key) for d in found})
    return df.select(*[c for c in order if c in df.columns])

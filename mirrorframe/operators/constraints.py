"""Constraints over rows: violation masks, counts, filtering, and generation by reject and resample."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions.expressions import compile_boolean, derive, referenced
from mirrorframe.functions.ranges import positions
from mirrorframe.plans.stages import staged

_OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
FIRST_FACTOR = 1.5
GROWTH = 1.5
DEFAULT_MAX_FACTOR = 4.0
#: By how much an attempt should exceed what the share of rows kept so far asks for.
SURE_FACTOR = 1.1
THIN_SUPPORT = 100


@dataclass(frozen=True)
class Derived:
    """column = a numeric expression over earlier columns."""

    column: str
    expression: str


@dataclass(frozen=True)
class Range:
    """min <= column <= max; a null violates if there is a bound."""

    column: str
    min: float | None = None
    max: float | None = None

    @property
    def label(self) -> str:
        return f"range({self.column})"

    def violated(self, schema: T.StructType) -> Column:
        c = F.col(f"`{self.column}`")
        out = F.lit(False)
        if self.min is not None:
            out = out | F.coalesce(c < self.min, F.lit(True))
        if self.max is not None:
            out = out | F.coalesce(c > self.max, F.lit(True))
        return out

    def names(self) -> list[str]:
        return [self.column]


@dataclass(frozen=True)
class Inequality:
    """left op right over two columns; a null violates."""

    left: str
    op: str
    right: str

    def __post_init__(self) -> None:
        if self.op not in _OPS:
            raise ValueError(f"unknown comparison {self.op!r}")

    @property
    def label(self) -> str:
        return f"{self.left} {self.op} {self.right}"

    def violated(self, schema: T.StructType) -> Column:
        return F.coalesce(~_OPS[self.op](F.col(f"`{self.left}`"), F.col(f"`{self.right}`")), F.lit(True))

    def names(self) -> list[str]:
        return [self.left, self.right]


@dataclass(frozen=True)
class Where:
    """A boolean expression; null violates."""

    expression: str

    @property
    def label(self) -> str:
        return f"where {self.expression}"

    def violated(self, schema: T.StructType) -> Column:
        return F.coalesce(~compile_boolean(self.expression, schema), F.lit(True))

    def names(self) -> list[str]:
        return referenced(self.expression)


Constraint = Derived | Range | Inequality | Where


def parse_constraint(spec: dict) -> Constraint:
    """A constraint from its TOML table: kind and that kind's fields."""
    rest = {k: v for k, v in spec.items() if k != "kind"}
    kinds = {"derived": Derived, "range": Range, "inequality": Inequality, "where": Where}
    if spec.get("kind") not in kinds:
        raise ValueError(f"unknown constraint kind {spec.get('kind')!r}")
    try:
        return kinds[spec["kind"]](**rest)
    except TypeError as e:
        raise ValueError(f"bad {spec['kind']} constraint: {e}") from e


def split(constraints: list[Constraint]) -> tuple[list[tuple[str, str]], list[Range | Inequality | Where]]:
    """Derived columns, and the checks."""
    return [(c.column, c.expression) for c in constraints if isinstance(c, Derived)], [c for c in constraints if not isinstance(c, Derived)]


def violations(df: DataFrame, checks: list) -> Column:
    """True where any check is violated."""
    out = F.lit(False)
    for c in checks:
        out = out | c.violated(df.schema)
    return out


def count_violations(df: DataFrame, checks: list) -> DataFrame:
    """One row per check: position, label, violations, rows. All counts in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c.violated(df.schema)).alias(f"v{i}") for i, c in enumerate(checks)])
    parts = [F.struct(F.lit(i).cast("long").alias("position"), F.lit(c.label).alias("label"), F.col(f"v{i}").alias("violations"), F.col("rows")) for i, c in enumerate(checks)]
    return row.select(F.inline(F.array(*parts)))


def apply(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """Derived columns added, violating rows dropped."""
    derived, checks = split(constraints)
    df = derive(df, derived)
    return df.filter(~violations(df, checks)) if checks else df


@dataclass
class ConstraintReport:
    """Rows asked for and kept, attempts, and violations by label over all attempts."""

    requested: int
    accepted: int
    attempts: int
    violations: dict[str, int]

    def rate(self, label: str, generated: int) -> float:
        return self.violations.get(label, 0) / generated if generated else 0.0


class ExhaustedError(ValueError):
    """Too few rows satisfy the constraints."""


def factors(most: float = DEFAULT_MAX_FACTOR) -> list[float]:
    """Oversampling factors: 1.5 and its powers up to `most`; one attempt at least."""
    out, f = [FIRST_FACTOR], FIRST_FACTOR * GROWTH
    while f <= most:
        out.append(f)
        f *= GROWTH
    return out


def first_by_id(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of least row_id, numbered range by range: no task holds all of them."""
    return positions(rows, ["row_id"]).filter(F.col("pos") < n).drop("pos")


def reject_resample(generate: Callable[[int, int], DataFrame], n: int, constraints: list[Constraint], *, most: float = DEFAULT_MAX_FACTOR) -> tuple[DataFrame, ConstraintReport]:
    """n rows that satisfy the constraints. generate(first_row_id, rows) gives rows with a row_id from disjoint ranges.

    Each attempt asks for its factor times what is missing. Factors that are too low by the share of rows kept so far are left out, since an attempt joins every pool of the model
    with its rows; the last one never is. Kept rows are the first n by row_id.
    """
    derived, checks = split(constraints)
    kept, have, next_id, seen = None, 0, 0, {c.label: 0 for c in checks}
    attempt = 0
    left = factors(most)
    while left:
        factor = next((f for f in left[:-1] if f * have >= SURE_FACTOR * next_id), left[0]) if have else left[0]
        left = left[left.index(factor) + 1 :]
        attempt += 1
        size = max(int((n - have) * factor), 1)
        batch = staged(derive(generate(next_id, size), derived), "attempt")  # counted and filtered: the trees run once
        next_id += size
        row = batch.agg(F.count_if(~violations(batch, checks)).alias("good"), *[F.count_if(c.violated(batch.schema)).alias(f"v{i}") for i, c in enumerate(checks)]).first()
        for i, c in enumerate(checks):
            seen[c.label] += row[f"v{i}"]
        good = batch.filter(~violations(batch, checks))
        kept = good if kept is None else kept.unionByName(good)
        have += row["good"]
        if have >= n:
            return first_by_id(kept, n), ConstraintReport(n, n, attempt, seen)
    raise ExhaustedError(f"only {have} of {n} rows satisfy the constraints after {attempt} attempts; violations: {seen}")


def precheck(df: DataFrame, expression: str) -> int:
    """Rows of the source that match; none is an error."""
    n = df.filter(compile_boolean(expression, df.schema)).count()
    if not n:
        raise ExhaustedError(f"no source row matches {expression!r}")
    return n


def thin_support_warning(matches: int) -> str | None:
    return f"only {matches} source rows match; results may be poor" if matches < THIN_SUPPORT else None


def where_table(expression: str, columns: dict[str, list[str]]) -> str:
    """The one table that has all columns of the expression."""
    names = referenced(expression)
    found = sorted(t for t, own in columns.items() if set(names) <= set(own))
    if len(found) != 1:
        raise ValueError(f"columns {names} must belong to exactly one table; found {found or 'none'}")
    return found[0]

"""One call from a real table to a synthetic one."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import pii
from mirrorframe.functions.text import TextPolicy, apply_policy
from mirrorframe.operators.constraints import Constraint, ConstraintReport, Where, precheck, reject_resample
from mirrorframe.operators.trees import TreeSynthesizer, fit_row_cap
from mirrorframe.plans.infer import infer_table
from mirrorframe.plans.model import Table


@dataclass
class Generated:
    """The synthetic rows, the table they were fitted on, and what was found on the way."""

    data: DataFrame
    table: Table
    report: ConstraintReport | None = None
    pii: list[pii.Detection] = field(default_factory=list)
    synthesizer: TreeSynthesizer | None = None


def generate(
    source: DataFrame | Table,
    n: int,
    *,
    seed: int = 0,
    constraints: list[Constraint] | None = None,
    where: str | None = None,
    fit_rows: int | None = None,
    text_policy: TextPolicy | str = TextPolicy.SAMPLE,
    salt: str = "",
    strip_pii: bool = True,
    max_oversample: float = 4.0,
    fitted: TreeSynthesizer | None = None,
) -> Generated:
    """n synthetic rows like the source. fit_rows: None caps automatically, 0 fits all rows. Keys are numbered after rows are accepted, so they never repeat."""
    table = source if isinstance(source, Table) else infer_table("table", source)
    spark = table.data.sparkSession
    constraints = list(constraints or [])
    if where:
        precheck(table.data, where)
        constraints.append(Where(where))
    order = [c.name for c in table.columns]
    found = pii.detect(table.data, table.columns, seed) if strip_pii else []
    fit_table = pii.strip(table, found)
    model = fitted
    if model is None:
        cap = (fit_row_cap(n, table.data.count()) or 100_000) if fit_rows is None else fit_rows
        model = TreeSynthesizer(seed).fit(fit_table, fit_rows=cap)
    if constraints:
        rows, report = reject_resample(lambda first, size: model.sample(spark, size, first_id=first), n, constraints, most=max_oversample)
        from mirrorframe.functions.ranges import positions
        from mirrorframe.operators.trees import key_values

        rows = positions(rows, ["row_id"]).drop("row_id").withColumnRenamed("pos", "row_id")
        for c, kind in model.keys:
            rows = rows.withColumn(c.name, key_values(c.name, kind, F.col("row_id"), seed))
    else:
        rows, report = model.sample(spark, n), None
    extra = [c for c in rows.columns if c not in order and c != "row_id"]
    if found:
        rows = pii.restore(rows, found, ["row_id", *order, *extra], seed=seed, key=F.col("row_id"))
    rows = apply_policy(rows, fit_table.columns, text_policy, seed=seed, salt=salt, key=F.col("row_id"), source=table.data)
    return Generated(rows.select("row_id", *[c for c in [*order, *extra] if c in rows.columns]), table, report, found, model)

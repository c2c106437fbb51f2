"""Synthesis of tables linked by foreign keys: parents first, children by drawn child counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions.expressions import compile_boolean
from mirrorframe.functions.ranges import positions
from mirrorframe.operators.constraints import DEFAULT_MAX_FACTOR, ExhaustedError, factors
from mirrorframe.operators.relations import child_counts, draw_counts, expand, prune
from mirrorframe.operators.trees import FIT_ROWS, TreeSynthesizer
from mirrorframe.plans.model import Column, ColumnType, Dataset, Table
from mirrorframe.plans.stages import staged


class HierarchySynthesizer:
    """One tree synthesizer a table, and the observed distribution of children per parent."""

    def __init__(self, seed: int = 0):
        self.seed = seed
        self.models: dict[str, TreeSynthesizer] = {}
        self.counts: dict[str, DataFrame] = {}
        self.dataset: Dataset | None = None

    def fit(self, dataset: Dataset, *, fit_rows: int | None = FIT_ROWS) -> HierarchySynthesizer:
        self.dataset = dataset
        for name in dataset.topological_order():
            table = dataset.tables[name]
            if len(table.references) > 1:
                raise NotImplementedError(f"table {name} has more than one parent")
            own = {r.column for r in table.references}
            columns = [Column(c.name, ColumnType.KEY) if c.name == table.primary_key else c for c in table.columns if c.name not in own]
            self.models[name] = TreeSynthesizer(self.seed).fit(Table(name, columns, table.primary_key, table.data.drop(*own)), fit_rows=fit_rows)
            for r in table.references:
                self.counts[name] = staged(child_counts(dataset.tables[r.table].data, r.key, table.data, r.column).select("n"), "child-counts")
        return self

    def sample(self, spark, rows: dict[str, int], *, attempt: int = 0) -> dict[str, DataFrame]:
        """Tables by name. rows: of tables without parents."""
        out: dict[str, DataFrame] = {}
        for name in self.dataset.topological_order():
            table = self.dataset.tables[name]
            stream = f"sample{attempt or ''}/{name}"
            if not table.references:
                made = self.models[name].sample(spark, rows[name], stream=stream)
            else:
                r = table.references[0]
                above = out[r.table].select(F.col(r.key).alias("_parent"))
                drawn = draw_counts(above, self.counts[name], self.seed, f"{stream}/children", "_parent")
                ids = positions(expand(drawn, "n").select("_parent", "child_no"), ["_parent", "child_no"])
                kind = table.data.schema[r.column].dataType
                ids = staged(ids.select(F.col("pos").alias("row_id"), F.col("_parent").cast(kind).alias(r.column)), "children")
                made = self.models[name].sample(spark, 0, stream=stream, ids=ids)
            out[name] = staged(made.select(*[c.name for c in table.columns]), f"sample-{name}")
        return out

    def sample_where(self, spark, rows: dict[str, int], table: str, expression: str, *, most: float = DEFAULT_MAX_FACTOR) -> dict[str, DataFrame]:
        """Tables whose `table` satisfies the expression and whose children have their parents: the whole set is drawn again, larger, until enough root rows are left."""
        for attempt, factor in enumerate(factors(most)):
            made = self.sample(spark, {k: max(int(v * factor), 1) for k, v in rows.items()}, attempt=attempt)
            made[table] = made[table].filter(compile_boolean(expression, made[table].schema))
            if table not in rows:
                return prune(self.dataset, made)
            if made[table].count() >= rows[table]:
                key = self.dataset.tables[table].primary_key or made[table].columns[0]
                made[table] = positions(made[table], [key]).filter(F.col("pos") < rows[table]).drop("pos")
                return prune(self.dataset, made)
        raise ExhaustedError(f"too few rows of {table} satisfy {expression!r}")

"""Sequential decision-tree synthesis of one table on MLlib.

Columns are fitted in input order, each on the columns before it; a new value is drawn from the real values in the leaf that the
generated row falls into. Fits are independent (their predictors are real columns) and run side by side; sampling is a chain of
narrow transformations over spark.range(n). Draws are functions of (seed, column, row_id).

A pool entry carries the value together with its encoding, so generated values never have to be encoded again. A pool's entries are numbered in the order of (leaf, hash of
the row), range by range. MLlib numbers leaves from left to right, so that the entries of a leaf, and of every node above it, are a span of places: a draw is a
place within a leaf's span, or, where a leaf has no entry, within that of the nearest node above it that has some. Entries are joined by their place, which no two share: a leaf of nearly all
rows spreads over tasks like any other.

A fit frame is capped (`fit_rows`) and then lies in one partition in a fixed order, which makes MLlib's splits reproducible. With fit_rows=0 all rows are fitted, by `growing`:
trees of the same rules, whose leaves are spans of places themselves.

A category of over `CLASSES` levels is fitted as a number, by the code of its level; its dictionary is a table that is joined.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions.features import MISSING, SentinelError, calendar, finite, to_epoch
from mirrorframe.functions.ranges import positions
from mirrorframe.functions.rng import below, exact_sample, row_identity, uniform, uuid4_hex
from mirrorframe.operators import growing
from mirrorframe.operators import repair as repairs
from mirrorframe.plans.infer import level_table
from mirrorframe.plans.model import Column, ColumnType, Table, calendar_of, is_integral
from mirrorframe.plans.stages import ship, staged

FIT_ROWS = 100_000
MIN_LEAF = 5
#: New columns between two stage tables while sampling.
LINEAGE = 6
#: Levels of a category up to which its codes are part of the expression; more are joined.
LISTED = 64
#: Levels of a category up to which it is fitted by classification.
CLASSES = 1000
#: Places of a pool that are numbered together.
PLACES = 1 << 16


@dataclass
class FittedColumn:
    """How one column is drawn: its strategy, encoding and models."""

    column: Column
    kind: T.DataType
    strategy: str
    null_rate: float
    features: list[str]
    fill: float
    null_model: object = None
    value_model: object = None
    pool: DataFrame | None = None
    spans: DataFrame | None = None
    constant: object = None
    predictors: list[str] = field(default_factory=list)
    tree: DataFrame | None = None
    place: object = None
    size: int | None = None


def fit_row_cap(rows: int, source_rows: int) -> int | None:
    """Rows to fit where the user gave none: a source over FIT_ROWS is capped at 5 times the rows asked for, FIT_ROWS at most."""
    return min(rows * 5, FIT_ROWS) if source_rows > FIT_ROWS else None


class TreeSynthesizer:
    """Fit once, sample any number of rows."""

    def __init__(self, seed: int = 0, *, max_bins: int = 128, max_depth: int = 18, threads: int = 4):
        self.seed, self.max_bins, self.max_depth, self.threads = seed, max_bins, max_depth, threads
        self.fitted: list[FittedColumn] = []
        self.keys: list[tuple[Column, T.DataType]] = []
        self.rules = repairs.Rules()
        self.names: list[str] = []
        self.rows = 0
        self.capped = True
        self.levels: dict[str, int] = {}

    # fit

    def _encoded(self, df: DataFrame, columns: list[Column]) -> tuple[DataFrame, dict[str, tuple[list[str], float]]]:
        """e_<i> per column: struct(v, x, calendar...). x is null-free: median for numbers, code for categories."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        numbers = [c for c in columns if c.type in (ColumnType.NUMERIC, ColumnType.DATETIME)]
        as_number = {c.name: to_epoch(F.col(f"`{c.name}`")).cast("double") if c.type is ColumnType.DATETIME else F.col(f"`{c.name}`").cast("double") for c in numbers}
        seen = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(~finite(x)).alias(f"m{i}") for i, x in enumerate(as_number.values())]).first()
        self.rows = seen["n"]
        fill = dict.fromkeys(as_number, 0.0)
        if holed := {name: x for i, (name, x) in enumerate(as_number.items()) if seen[f"m{i}"]}:  # exact medians meet in one task; columns without gaps need none
            medians = df.agg(*[F.coalesce(F.percentile(F.when(finite(x), x), F.lit(0.5)), F.lit(0.0)).alias(f"m{i}") for i, x in enumerate(holed.values())]).first()
            fill |= {name: medians[f"m{i}"] for i, name in enumerate(holed)}
        out, meta = [], {}
        codes, tables = {}, {}
        for c in columns:
            wide = c.levels if c.categories is None else None
            if c.type is ColumnType.CATEGORICAL and wide is None and c.categories is None and not isinstance(kinds[c.name], T.BooleanType):
                wide = level_table(df, c.name)
            if c.type is ColumnType.CATEGORICAL and wide is not None:
                if wide.filter(F.col("value") == MISSING).limit(1).count():
                    raise SentinelError(f"{c.name} holds {MISSING!r}")
                tables[c.name], self.levels[c.name] = wide, wide.count() + 1
            elif c.type is ColumnType.CATEGORICAL:
                values = sorted({str(v) if not isinstance(v, bool) else str(v).lower() for v in (c.categories or ())})
                if MISSING in values:
                    raise SentinelError(f"{c.name} holds {MISSING!r}")
                codes[c.name] = sorted([*values, MISSING])
                self.levels[c.name] = len(codes[c.name])
        for i, c in enumerate(columns):
            v = F.col(f"`{c.name}`")
            parts, names = [v.alias("v")], []
            if c.type is ColumnType.TEXT:
                meta[c.name] = ([], 0.0)
            elif c.type is ColumnType.CATEGORICAL:
                said = F.coalesce(v.cast("string"), F.lit(MISSING))
                if c.name in tables:
                    df = df.join(tables[c.name].select(F.col("value").alias(f"_level_{i}"), F.col("code").cast("double").alias(f"_code_{i}")), said == F.col(f"_level_{i}"), "left")
                    at = F.coalesce(F.col(f"_code_{i}"), F.when(v.isNull(), F.lit(self.levels[c.name] - 1.0)).otherwise(F.lit(-1.0)))
                elif len(codes[c.name]) > LISTED:
                    table = df.sparkSession.createDataFrame([(x, float(k)) for k, x in enumerate(codes[c.name])], f"_level_{i} string, _code_{i} double")
                    df = df.join(table, said == F.col(f"_level_{i}"), "left")
                    at = F.coalesce(F.col(f"_code_{i}"), F.lit(-1.0))
                else:
                    at = F.array_position(F.array(*[F.lit(x) for x in codes[c.name]]), said) - 1
                parts.append(at.cast("double").alias("x"))
                names, fill[c.name] = ["x"], self.levels[c.name] - 1.0 if c.name in tables else float(codes[c.name].index(MISSING))
                meta[c.name] = (names, fill[c.name])
            else:
                x = as_number[c.name]
                parts.append(F.when(finite(x), x).otherwise(F.lit(fill[c.name])).alias("x"))
                names = ["x", *calendar_of(c, kinds[c.name])]
                parts += [F.coalesce(calendar(v, k, kinds[c.name]).cast("double"), F.lit(0.0)).alias(k) for k in names[1:]]
                meta[c.name] = (names, fill[c.name])
            out.append(F.struct(*parts).alias(f"e_{i}"))
        return df.select(F.col("_order"), *out), meta

    def fit(self, table: Table, *, fit_rows: int | None = FIT_ROWS) -> TreeSynthesizer:
        df = table.data
        self.names = [c.name for c in table.columns]
        kinds = {f.name: f.dataType for f in df.schema.fields}
        self.keys = [(c, kinds[c.name]) for c in table.columns if c.type is ColumnType.KEY]
        columns = table.drawn()
        self.rules = repairs.detect(df, columns)
        self.capped = bool(fit_rows)
        keyed = df.withColumn("_order", F.xxhash64(row_identity(df)))
        sample = exact_sample(keyed, fit_rows, self.seed, "_order") if fit_rows else keyed
        frame, meta = self._encoded(sample, columns)
        if self.capped:
            frame = frame.coalesce(1).sortWithinPartitions("_order")
        frame = staged(frame, "fit")
        if self.capped:
            frame = frame.coalesce(1)
        predictors: list[str] = []
        jobs = []
        for i, c in enumerate(columns):
            jobs.append((i, c, kinds[c.name], *meta[c.name], list(predictors)))
            predictors += [f"e_{i}.{k}" for k in meta[c.name][0]]
        row = self._looks(frame, columns, kinds)
        looks = [{k: row[f"{k}_{i}"] for k in ("nulls", "a", "b", "low", "high", "mean") if f"{k}_{i}" in row} for i in range(len(columns))]
        grown = {} if self.capped else self._grow(frame, jobs, looks)
        with ThreadPoolExecutor(self.threads) as pool:
            self.fitted = list(pool.map(lambda job: self._fit_column(frame, looks[job[0]], grown.get(job[0]), *job), jobs))
        return self

    def _looks(self, frame: DataFrame, columns: list[Column], kinds: dict[str, T.DataType]) -> dict:
        """Of each column, in one pass: nulls, the least and largest hash of a value (equal for a constant), and bounds and mean of its number."""
        aggs = []
        for i, c in enumerate(columns):
            v = F.col(f"e_{i}")["v"]
            flat = v if isinstance(kinds[c.name], T.AtomicType) else F.to_json(F.struct(v.alias("v")))
            h = F.when(v.isNotNull(), F.xxhash64(flat))
            aggs += [F.count_if(v.isNull()).alias(f"nulls_{i}"), F.min(h).alias(f"a_{i}"), F.max(h).alias(f"b_{i}")]
            if c.type is not ColumnType.TEXT:
                x = F.when(v.isNotNull(), F.col(f"e_{i}")["x"])
                aggs += [F.min(x).alias(f"low_{i}"), F.max(x).alias(f"high_{i}"), F.avg(x).alias(f"mean_{i}")]
        return frame.agg(*aggs).first().asDict() if aggs else {}

    def _alone(self, c: Column, look: dict, predictors: list[str]) -> bool:
        """Whether a column is drawn without a tree."""
        return not predictors or c.type is ColumnType.TEXT or self.rows - look["nulls"] <= 1 or look["a"] == look["b"]

    def _classes(self, c: Column) -> bool:
        return c.type is ColumnType.CATEGORICAL and self.levels[c.name] <= CLASSES + 1

    def _grow(self, frame: DataFrame, jobs: list, looks: list[dict]) -> dict[int, DataFrame]:
        """By place of a column, its tree over all rows. All trees look at one table of bins."""
        drawn = [(i, c, predictors) for i, c, _, _, _, predictors in jobs if not self._alone(c, looks[i], predictors)]
        if not drawn:
            return {}
        if self.max_bins > 256:
            raise ValueError("max_bins is 256 at most where all rows are fitted: a bin is a byte")
        ship(frame.sparkSession)
        features = max((p for _, _, p in drawn), key=len)
        cuts = growing.feature_cuts(frame, self.rows, features, self.max_bins)
        labels, targets = [], []
        for t, (i, c, predictors) in enumerate(drawn):
            e, look = F.col(f"e_{i}"), looks[i]
            labels.append(F.when(e["v"].isNotNull(), F.greatest(e["x"], F.lit(0.0)) if self._classes(c) else e["x"]))
            scale = max(look["high"] - look["mean"], look["mean"] - look["low"])
            targets.append(growing.Target(t, len(predictors), self.levels[c.name] if self._classes(c) else 0, self.rows - look["nulls"], look["mean"], scale))
        bins = growing.binned(frame, features, cuts, labels)
        trees = growing.grow_trees(bins, targets, deepest=self.max_depth, least=MIN_LEAF, bins=self.max_bins)
        return {i: growing.node_table(frame.sparkSession, tree, cuts) for (i, _, _), tree in zip(drawn, trees, strict=True)}

    def _fit_column(self, frame: DataFrame, look: dict, tree: DataFrame | None, i: int, c: Column, kind: T.DataType, features: list[str], fill: float, predictors: list[str]) -> FittedColumn:
        e, order = F.col(f"e_{i}"), "_order"
        null = e["v"].isNull()
        n, nulls = self.rows, look["nulls"]
        out = FittedColumn(c, kind, "empirical-resample", nulls / n if n else 0.0, features, fill, predictors=predictors, size=n - nulls)
        values = frame.filter(~null)
        if self._alone(c, look, predictors):
            if look["a"] == look["b"] and n - nulls > 1:
                out.strategy = "constant"
            share = F.floor(_share(F.col(order)) * (n - nulls))
            out.pool = numbered_pool(values.select(order, e.alias("e")), [order]) if self.capped else placed_pool(values.select(share.alias("_near"), order, e.alias("e")))
            if predictors and 0 < nulls < n and c.type is not ColumnType.TEXT:
                out.null_model = self._null_model(frame, null, predictors)
            return out
        out.strategy = "cart+leaf-sample" if nulls else "cart-no-nulls"
        if nulls:
            out.null_model = self._null_model(frame, null, predictors)
        if tree is not None:
            out.tree, out.place = tree, growing.placing(tree)
            out.pool = placed_pool(values.select(out.place(_share(F.col(order)), predictors).alias("_near"), order, e.alias("e")))
            return out
        label = values.withColumn("_label", e["x"])
        classes = self._classes(c)
        if classes:  # without the number of classes MLlib takes 100 at most
            label = label.withMetadata("_label", {"ml_attr": {"type": "nominal", "name": "_label", "num_vals": self.levels[c.name]}})
        assembled = self._assemble(label, predictors)
        maker = DecisionTreeClassifier if classes else DecisionTreeRegressor
        tree = maker(featuresCol="_features", labelCol="_label", leafCol="_leaf", maxDepth=self.max_depth, maxBins=self.max_bins, minInstancesPerNode=MIN_LEAF, seed=self.seed, maxMemoryInMB=512)
        out.value_model = tree.fit(assembled)
        leaves = out.value_model.transform(assembled).select(F.col("_leaf").cast("long").alias("_leaf"), order, F.col(f"e_{i}").alias("e"))
        out.pool, out.spans = leaf_pool(out.value_model, leaves, order)
        return out

    def _assemble(self, df: DataFrame, predictors: list[str]) -> DataFrame:
        names = [f"_f{k}" for k in range(len(predictors))]
        df = df.withColumns({n: F.col(p) for n, p in zip(names, predictors, strict=True)})
        return VectorAssembler(inputCols=names, outputCol="_features").transform(df).drop(*names)

    def _null_model(self, frame: DataFrame, null: SparkColumn, predictors: list[str]):
        data = self._assemble(frame.withColumn("_label", null.cast("double")), predictors)
        return DecisionTreeClassifier(featuresCol="_features", labelCol="_label", maxDepth=self.max_depth, maxBins=self.max_bins, minInstancesPerNode=MIN_LEAF, seed=self.seed, maxMemoryInMB=512).fit(data)

    # sample

    def _null_entry(self, f: FittedColumn) -> SparkColumn:
        parts = [F.lit(None).cast(f.kind).alias("v")]
        for k in f.features:
            parts.append(F.lit(f.fill if k == "x" else 0.0).alias(k))
        return F.struct(*parts)

    def sample(self, spark, n: int, *, first_id: int = 0, stream: str = "sample", ids: DataFrame | None = None) -> DataFrame:
        """row_id and the columns, without keys' uniqueness across calls: keys are numbered from row_id + 1."""
        out = ids if ids is not None else spark.range(first_id, first_id + n).select(F.col("id").alias("row_id"))
        carried = [c for c in out.columns if c != "row_id"]
        for i, f in enumerate(self.fitted):
            name = f"{stream}/{f.column.name}"
            u = uniform(self.seed, f"{name}/value", F.col("row_id"))
            have = [c for c in out.columns]
            if f.null_model is not None:
                with_null = f.null_model.transform(self._assemble(out, f.predictors))
                p = vector_to_array("probability")
                out = with_null.withColumn("_p", F.when(F.size(p) > 1, p[1]).otherwise(0.0)).select(*have, "_p")
            else:
                out = out.withColumn("_p", F.lit(f.null_rate))
            is_null = uniform(self.seed, f"{name}/null", F.col("row_id")) < F.col("_p")
            if f.value_model is not None:
                leaf = f.value_model.transform(self._assemble(out, f.predictors)).select(*have, "_p", F.col("_leaf").cast("long").alias("_leaf"))
                placed = leaf.join(f.spans, "_leaf").withColumn("pos", F.col("_first") + F.floor(u * F.col("_size"))).drop("_leaf", "_first", "_size")
            elif f.tree is not None:
                ship(spark)
                f.place = f.place or growing.placing(f.tree)
                placed = out.withColumn("pos", f.place(u, f.predictors))
            else:
                size = f.size = f.pool.count() if f.size is None else f.size
                placed = out.withColumn("pos", below(self.seed, f"{name}/value", F.col("row_id"), size) if size else F.lit(None).cast("long"))
            # A pool of few values is a small file of any number of rows: its size says nothing of what a broadcast of it would take
            joined, entry = placed.join(f.pool.hint("merge"), "pos", "left"), F.coalesce("e", self._null_entry(f))
            out = joined.withColumn(f"e_{i}", F.when(is_null, self._null_entry(f)).otherwise(entry)).select(*have, f"e_{i}")
            if (i + 1) % LINEAGE == 0 and i + 1 < len(self.fitted):
                out = staged(out, "sampled")
        at = {f.column.name: F.col(f"e_{i}")["v"] for i, f in enumerate(self.fitted)}
        for c, kind in self.keys:
            at[c.name] = key_values(c.name, kind, F.col("row_id"), self.seed)
        out = out.select("row_id", *carried, *[at[c].alias(c) for c in self.names])
        out = repairs.enforce_ordered(out, self.rules.ordered)
        return repairs.repair(out, self.rules)

    def explain(self) -> list[tuple[str, str, float]]:
        """(column, strategy, null rate)."""
        return [(f.column.name, f.strategy, f.null_rate) for f in self.fitted] + [(c.name, "key", 0.0) for c, _ in self.keys]


def numbered_pool(entries: DataFrame, order: list[str]) -> DataFrame:
    """(pos, e) as a written table: entries by their place in the order given."""
    return staged(positions(entries, order).select("pos", "e"), "pool")


def _share(order: SparkColumn) -> SparkColumn:
    """A long hash as a share in [0, 1], in the same order."""
    return order.cast("double") / float(1 << 64) + 0.5


def placed_pool(entries: DataFrame) -> DataFrame:
    """(pos, e) as a written table: entries (_near, _order, e) by their place in that order. _near is about that place, so that pieces of PLACES of it are alike in size and no range needs to be sampled."""
    entries = entries.withColumn("_part", F.floor(F.col("_near") / PLACES).cast("int"))
    sums = entries.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_part").orderBy("_near", "_order"))
    return staged(entries.withColumn("_own", own).join(F.broadcast(before), "_part").select((F.col("_before") + F.col("_own") - 1).cast("long").alias("pos"), "e"), "pool")  # a row a piece


def leaf_pool(model, leaves: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """leaves: _leaf, order, e. Their entries by place, and the span of places (_leaf, _first, _size) that each leaf of the model draws from."""
    leaves = staged(leaves, "leaves")
    depths = leaf_depths(model.toDebugString)
    counts = np.zeros(len(depths), np.int64)
    for r in leaves.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a leaf of a model that the driver holds
        counts[r._leaf] = r.n
    first, size = leaf_spans(depths, counts)
    spans = pa.table({"_leaf": np.arange(len(depths)), "_first": first, "_size": size})
    return numbered_pool(leaves.select("_leaf", order, "e"), ["_leaf", order]), staged(leaves.sparkSession.createDataFrame(spans), "spans")


def leaf_depths(text: str) -> np.ndarray:
    """Depths of a tree's leaves from left to right, by the indents of its text."""
    return np.array([len(line) - len(line.lstrip()) - 2 for line in text.splitlines() if line.lstrip().startswith("Predict")], np.int64)


def leaf_spans(depths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and size of the span that each leaf draws from, where entries go by leaf: its own, or of the nearest node above that has entries (nothing if none has).

    The depths of the leaves from left to right give the tree: a leaf of depth d takes 2**-d of a line, and the node at depth k above it the whole 2**-k part that it lies in.
    """
    deepest = int(depths.max(initial=0))
    width = 1 << (deepest - depths)
    starts = np.cumsum(width) - width
    upto = np.concatenate([[0], np.cumsum(counts)])
    first, size = upto[:-1].copy(), counts.copy()
    for k in range(deepest - 1, -1, -1):
        empty = np.flatnonzero((size == 0) & (depths > k))
        part = starts[empty] >> (deepest - k) << (deepest - k)
        low, high = np.searchsorted(starts, part), np.searchsorted(starts, part + (1 << (deepest - k)))
        first[empty], size[empty] = upto[low], upto[high] - upto[low]
    return first, size


def key_values(name: str, kind: T.DataType, row_id: SparkColumn, seed: int) -> SparkColumn:
    """1, 2, ... in an integer source's type; UUIDs for string columns named uuid or *_uuid; else name_1, name_2, ..."""
    number = row_id + 1
    if is_integral(kind) or isinstance(kind, T.DecimalType) or isinstance(kind, (T.FloatType, T.DoubleType)):
        return number.cast(kind)
    if name.lower() == "uuid" or name.lower().endswith("_uuid"):
        return uuid4_hex(seed, f"key/{name}", row_id)
    return F.concat(F.lit(f"{name}_"), number.cast("string"))



"""Fitted synthesizers on disk: a manifest and schema as JSON, MLlib models, and value pools as Parquet. Nothing in it is code."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from mirrorframe import __version__
from mirrorframe.operators.repair import Rules
from mirrorframe.operators.trees import FittedColumn, TreeSynthesizer
from mirrorframe.plans.model import Column, ColumnType
from mirrorframe.plans.stages import staged

FORMAT = 3
#: Formats that can be read; 2 has no trees over all rows.
READABLE = (2, 3)
MANIFEST_LIMIT = 1 << 20


class ArtifactError(ValueError):
    """A folder that holds no readable artifact."""


@dataclass(frozen=True)
class Manifest:
    format: int
    version: str
    kind: str
    seed: int
    rows: int
    columns: list[str]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    try:
        row = spark.read.text(path, wholetext=True).first()
    except Exception as e:
        raise ArtifactError(f"{path} can't be read") from e
    if row is None or len(row[0]) > MANIFEST_LIMIT * 5:
        raise ArtifactError(f"{path} is empty or too large")
    return row[0]


def _column(c: Column) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(replace(c, levels=None)).items() if k != "levels"}


def _column_of(d: dict) -> Column:
    as_tuple = lambda v: None if v is None else tuple(v)
    return Column(d["name"], ColumnType(d["type"]), d["nullable"], as_tuple(d["categories"]), as_tuple(d["calendar_features"]))


def save(spark: SparkSession, model: TreeSynthesizer, path: str, schema_toml: str | None = None) -> None:
    """Write a fitted synthesizer below path; the manifest comes last, so a broken write is no artifact."""
    fitted = []
    for i, f in enumerate(model.fitted):
        if f.null_model is not None:
            f.null_model.write().overwrite().save(f"{path}/null-{i}")
        if f.value_model is not None:
            f.value_model.write().overwrite().save(f"{path}/value-{i}")
        for name, table in (("pool", f.pool), ("spans", f.spans), ("tree", f.tree), ("levels", f.column.levels)):
            if table is not None:
                table.write.mode("overwrite").parquet(f"{path}/{name}-{i}")
        fitted.append({"column": _column(f.column), "kind": f.kind.json(), "strategy": f.strategy, "null_rate": f.null_rate, "features": f.features, "fill": f.fill, "null_model": f.null_model is not None, "value_model": type(f.value_model).__name__ if f.value_model is not None else None, "predictors": f.predictors, "tree": f.tree is not None, "levels": f.column.levels is not None})
    state = {"fitted": fitted, "keys": [[_column(c), k.json()] for c, k in model.keys], "rules": asdict(model.rules), "names": model.names, "capped": model.capped, "max_bins": model.max_bins, "max_depth": model.max_depth, "schema_toml": schema_toml}
    _write_text(spark, f"{path}/schema", json.dumps(state))
    _write_text(spark, f"{path}/manifest", json.dumps(asdict(Manifest(FORMAT, __version__, type(model).__name__, model.seed, model.rows, model.names))))


def info(spark: SparkSession, path: str) -> Manifest:
    """The manifest alone, checked."""
    try:
        found = Manifest(**json.loads(_read_text(spark, f"{path}/manifest")))
    except (TypeError, json.JSONDecodeError) as e:
        raise ArtifactError(f"{path} has no valid manifest") from e
    if found.format not in READABLE:
        raise ArtifactError(f"{path} has format {found.format}; this is {FORMAT}")
    if found.kind != TreeSynthesizer.__name__:
        raise ArtifactError(f"{path} holds a {found.kind}")
    return found


def load(spark: SparkSession, path: str) -> tuple[TreeSynthesizer, Manifest, str | None]:
    """The synthesizer, its manifest and the schema it was fitted under."""
    manifest = info(spark, path)
    state = json.loads(_read_text(spark, f"{path}/schema"))
    model = TreeSynthesizer(manifest.seed, max_bins=state["max_bins"], max_depth=state["max_depth"])
    model.rows, model.names, model.capped = manifest.rows, state["names"], state["capped"]
    kind = lambda x: T._parse_datatype_json_string(x)
    model.keys = [(_column_of(c), kind(k)) for c, k in state["keys"]]
    model.rules = Rules(**{k: [tuple(p) for p in v] for k, v in state["rules"].items()})
    models = {c.__name__: c for c in (DecisionTreeClassificationModel, DecisionTreeRegressionModel)}
    for i, f in enumerate(state["fitted"]):
        null_model = DecisionTreeClassificationModel.load(f"{path}/null-{i}") if f["null_model"] else None
        value_model = models[f["value_model"]].load(f"{path}/value-{i}") if f["value_model"] else None
        table = lambda name, there: staged(spark.read.parquet(f"{path}/{name}-{i}"), name) if there else None  # noqa: B023, E731
        column = replace(_column_of(f["column"]), levels=table("levels", f["levels"]))
        pool, spans = table("pool", True), table("spans", value_model is not None)
        model.fitted.append(FittedColumn(column, kind(f["kind"]), f["strategy"], f["null_rate"], f["features"], f["fill"], null_model, value_model, pool, spans, None, f["predictors"], table("tree", f.get("tree", False))))
    return model, manifest, state["schema_toml"]

"""Schemas as TOML: one table with overrides and constraints, or several with foreign keys."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import SparkSession

from mirrorframe.functions.expressions import compile_boolean, compile_numeric
from mirrorframe.operators.constraints import Constraint, Derived, Inequality, Range, Where, parse_constraint
from mirrorframe.operators.relations import check_foreign_key, check_primary_key
from mirrorframe.plans.infer import infer_table
from mirrorframe.plans.model import CALENDAR, Column, ColumnType, Dataset, Reference, Table
from mirrorframe.sources.reading import read
from mirrorframe.sources.uri import parse_source


class SchemaError(ValueError):
    """A schema that is malformed or doesn't fit its table."""


def _fields(spec: dict, allowed: set[str], where: str) -> dict:
    if extra := set(spec) - allowed:
        raise SchemaError(f"unknown field {', '.join(sorted(extra))} in {where}")
    return spec


def column_override(name: str, spec: dict) -> dict:
    """Fields that a column's TOML sets. calendar_features: omitted keeps the default, false disables, a list is the exact set; `ordered` is accepted and has no effect."""
    spec = dict(_fields(spec, {"type", "nullable", "ordered", "categories", "calendar_features"}, f"column {name}"))
    spec.pop("ordered", None)
    if "type" in spec:
        try:
            spec["type"] = ColumnType(spec["type"])
        except ValueError as e:
            raise SchemaError(f"column {name}: unknown type {spec['type']!r}") from e
    if "categories" in spec:
        spec["categories"] = tuple(spec["categories"])
    if "calendar_features" in spec:
        found = spec["calendar_features"]
        if found is True or not (found is False or isinstance(found, list)):
            raise SchemaError(f"column {name}: calendar_features is false or a list")
        if found and (bad := set(found) - set(CALENDAR)):
            raise SchemaError(f"column {name}: unknown calendar features {sorted(bad)}")
        spec["calendar_features"] = tuple(f for f in CALENDAR if f in found) if found else ()
    return spec


@dataclass
class TableSchema:
    """Overrides of one table."""

    name: str | None = None
    primary_key: str | None = None
    columns: dict[str, dict] = field(default_factory=dict)
    constraints: list[Constraint] = field(default_factory=list)


def parse_table(data: dict) -> TableSchema:
    _fields(data, {"table", "columns", "constraints"}, "schema")
    head = _fields(data.get("table", {}), {"name", "primary_key"}, "table")
    try:
        rules = [parse_constraint(c) for c in data.get("constraints", [])]
    except ValueError as e:
        raise SchemaError(str(e)) from e
    return TableSchema(head.get("name"), head.get("primary_key"), {n: column_override(n, c) for n, c in data.get("columns", {}).items()}, rules)


def load(path: str) -> TableSchema:
    try:
        return parse_table(tomllib.loads(Path(path).read_text(encoding="utf-8")))
    except tomllib.TOMLDecodeError as e:
        raise SchemaError(f"{path}: {e}") from e


def apply_overrides(table: Table, schema: TableSchema) -> Table:
    """The table's columns with the schema's fields; a declared primary key becomes a non-null key."""
    names = [c.name for c in table.columns]
    if unknown := sorted((set(schema.columns) | ({schema.primary_key} - {None})) - set(names)):
        raise SchemaError(f"unknown columns {', '.join(unknown)}")
    columns = [replace(c, **schema.columns.get(c.name, {})) for c in table.columns]
    key = schema.primary_key or table.primary_key
    columns = [replace(c, type=ColumnType.KEY, nullable=False, categories=None) if c.name == schema.primary_key else c for c in columns]
    return Table(schema.name or table.name, columns, key, table.data)


def validate(table: Table, schema: TableSchema) -> None:
    """Key and constraints against the data; derived columns may be referred to once they are declared."""
    apply_overrides(table, schema)
    if schema.primary_key:
        check_primary_key(table.name, table.data, schema.primary_key)
    frame = table.data.limit(0)
    for c in schema.constraints:
        if isinstance(c, Derived):
            frame = frame.withColumn(c.column, compile_numeric(c.expression, frame.schema))
        elif isinstance(c, Where):
            compile_boolean(c.expression, frame.schema)
        elif missing := [n for n in c.names() if n not in frame.columns]:
            raise SchemaError(f"constraint {c.label} names unknown columns {missing}")


def _value(x: object) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(_value(v) for v in x) + "]"
    return json.dumps(x, ensure_ascii=False) if isinstance(x, str) else repr(x)


def _key(name: str) -> str:
    return name if name.replace("_", "").replace("-", "").isalnum() and name.isascii() else json.dumps(name)


def emit(table: Table, constraints: list[Constraint] | None = None) -> str:
    """The table's columns as TOML."""
    lines = ["[table]", f"name = {_value(table.name)}"]
    if table.primary_key:
        lines.append(f"primary_key = {_value(table.primary_key)}")
    for c in table.columns:
        lines += ["", f"[columns.{_key(c.name)}]", f"type = {_value(str(c.type))}", f"nullable = {_value(c.nullable)}"]
        if c.categories is not None:
            lines.append(f"categories = {_value([v for v in c.categories])}")
        if c.calendar_features is not None:
            lines.append(f"calendar_features = {_value(list(c.calendar_features)) if c.calendar_features else 'false'}")
    kinds = {Derived: "derived", Range: "range", Inequality: "inequality", Where: "where"}
    for rule in constraints or []:
        lines += ["", "[[constraints]]", f"kind = {_value(kinds[type(rule)])}"] + [f"{k} = {_value(v)}" for k, v in vars(rule).items() if v is not None]
    return "\n".join(lines) + "\n"


def save(path: str, table: Table, constraints: list[Constraint] | None = None) -> None:
    Path(path).write_text(emit(table, constraints), encoding="utf-8")


# several tables


@dataclass
class MultiSchema:
    """Sources, overrides and foreign keys of several tables."""

    sources: dict[str, dict]
    tables: dict[str, TableSchema]
    references: dict[str, tuple[Reference, ...]]


def is_multi(data: dict) -> bool:
    return "tables" in data


def parse_multi(data: dict) -> MultiSchema:
    _fields(data, {"tables", "foreign_keys"}, "schema")
    sources, tables = {}, {}
    for name, spec in data["tables"].items():
        _fields(spec, {"file", "path", "uri", "table", "query", "primary_key", "columns"}, f"table {name}")
        file = spec.get("file") or spec.get("path")
        if bool(file) == bool(spec.get("uri")):
            raise SchemaError(f"table {name} needs either a file or a uri")
        if file and (spec.get("table") or spec.get("query")):
            raise SchemaError(f"table {name}: a file has no table or query")
        if spec.get("uri") and bool(spec.get("table")) == bool(spec.get("query")):
            raise SchemaError(f"table {name} needs either a table or a query")
        sources[name] = {"value": file or spec["uri"], "table": spec.get("table"), "query": spec.get("query")}
        tables[name] = TableSchema(name, spec.get("primary_key"), {n: column_override(n, c) for n, c in spec.get("columns", {}).items()})
    refers: dict[str, tuple[Reference, ...]] = {}
    for k in data.get("foreign_keys", []):
        _fields(k, {"child_table", "child_column", "parent_table", "parent_column", "inherit_parent_features"}, "foreign key")
        if k.get("inherit_parent_features"):
            raise NotImplementedError("inherit_parent_features isn't supported")
        refers[k["child_table"]] = (*refers.get(k["child_table"], ()), Reference(k["child_column"], k["parent_table"], k["parent_column"]))
    if unknown := set(refers) - set(tables):
        raise SchemaError(f"foreign keys of unknown tables {sorted(unknown)}")
    return MultiSchema(sources, tables, refers)


def load_multi(path: str) -> MultiSchema:
    return parse_multi(tomllib.loads(Path(path).read_text(encoding="utf-8")))


def to_dataset(spark: SparkSession, schema: MultiSchema, base: str = "") -> Dataset:
    """All tables read, inferred, overridden and checked. Paths are taken below base."""
    tables = {}
    for name, s in schema.sources.items():
        value = s["value"] if "://" in s["value"] or s["value"].startswith("/") or not base else f"{base}/{s['value']}"
        found = infer_table(name, read(spark, parse_source(value, table=s["table"], query=s["query"])))
        tables[name] = replace(apply_overrides(found, schema.tables[name]), references=schema.references.get(name, ()))
        if schema.tables[name].primary_key:
            check_primary_key(name, tables[name].data, schema.tables[name].primary_key)
    out = Dataset(tables)
    for name in out.topological_order():
        for r in tables[name].references:
            check_foreign_key(name, tables[name].data, r.column, tables[r.table].data, r.key)
    return out


def emit_multi(dataset: Dataset, files: dict[str, str]) -> str:
    """A dataset as TOML, each table by its file."""
    lines: list[str] = []
    for name, t in dataset.tables.items():
        lines += [f"[tables.{_key(name)}]", f"file = {_value(files[name])}"] + ([f"primary_key = {_value(t.primary_key)}"] if t.primary_key else []) + [""]
        for c in t.columns:
            lines += [f"[tables.{_key(name)}.columns.{_key(c.name)}]", f"type = {_value(str(c.type))}", ""]
    for name, t in dataset.tables.items():
        for r in t.references:
            lines += ["[[foreign_keys]]", f"child_table = {_value(name)}", f"child_column = {_value(r.column)}", f"parent_table = {_value(r.table)}", f"parent_column = {_value(r.key)}", ""]
    return "\n".join(lines)

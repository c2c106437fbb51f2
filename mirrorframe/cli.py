"""Command line: gen, fit, sample, diff, schema infer|check, artifact info, doctor."""

from __future__ import annotations

import argparse
import json
import math
import platform
import sys
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from mirrorframe import __version__
from mirrorframe.functions import pii
from mirrorframe.functions.rng import row_identity
from mirrorframe.functions.text import TextPolicy, apply_policy
from mirrorframe.operators.constraints import ConstraintReport, parse_constraint, precheck, thin_support_warning, where_table
from mirrorframe.operators.hierarchy import HierarchySynthesizer
from mirrorframe.operators.pipeline import generate
from mirrorframe.operators.quality import compare
from mirrorframe.operators.report import Gates, breaches, summary_line, to_html, to_json, to_text
from mirrorframe.operators.trees import FIT_ROWS, TreeSynthesizer
from mirrorframe.plans import schema_toml as S
from mirrorframe.plans.infer import infer_table
from mirrorframe.plans.model import Table
from mirrorframe.plans.stages import drop_stages
from mirrorframe.sources import artifact
from mirrorframe.sources.reading import read
from mirrorframe.sources.uri import FilePath, parse_sink, parse_source
from mirrorframe.sources.writing import write, write_dataset

#: Rows of each side that the quality line compares at most.
SUMMARY_ROWS = 5000


def _session() -> SparkSession:
    return SparkSession.builder.appName("mirrorframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _source(spark: SparkSession, value: str, a: argparse.Namespace) -> DataFrame:
    spec = parse_source(value, table=getattr(a, "table", None), query=getattr(a, "query", None), password_cmd=getattr(a, "password_cmd", None), timeout=getattr(a, "timeout", None))
    return read(spark, spec, fit_rows=getattr(a, "fit_rows", None), seed=a.seed)


def _table(spark: SparkSession, a: argparse.Namespace) -> tuple[Table, list]:
    table = infer_table(Path(a.source).stem or "table", _source(spark, a.source, a))
    if not a.schema:
        return table, []
    schema = S.load(a.schema)
    S.validate(table, schema)
    return S.apply_overrides(table, schema), schema.constraints


def rows_by_table(items: list[str], roots: list[str]) -> dict[str, int]:
    """--rows N for a single root, or table=N for each."""
    out: dict[str, int] = {}
    for item in items:
        name, eq, n = item.rpartition("=")
        if not n.isdigit() or int(n) < 1:
            raise ValueError(f"bad row count {item!r}")
        if eq:
            out[name] = int(n)
        else:
            out |= {r: int(n) for r in roots}
    if missing := set(roots) - set(out):
        raise ValueError(f"no row count for {sorted(missing)}")
    if extra := set(out) - set(roots):
        raise ValueError(f"row counts are for tables without parents, not {sorted(extra)}")
    return out


def _explain(model: TreeSynthesizer, prefix: str = "") -> None:
    for name, strategy, rate in model.explain():
        print(f"{prefix + name:<28} {strategy:<20} nulls {rate:.3f}")


def report_lines(report: ConstraintReport) -> list[str]:
    """What constraints cost, in words: attempts, and violations of each, most first."""
    out = [f"kept {report.accepted} of {report.requested} rows asked for in {report.attempts} attempt{'s' if report.attempts != 1 else ''}"]
    return out + [f"  {n} rows broke {label}" for label, n in sorted(report.violations.items(), key=lambda x: (-x[1], x[0])) if n]


def gen(a: argparse.Namespace) -> int:
    spark = _session()
    if a.schema and S.is_multi(tomllib.loads(Path(a.schema).read_text(encoding="utf-8"))):
        schema = S.load_multi(a.schema)
        data = S.to_dataset(spark, schema, str(Path(a.schema).parent))
        rows = rows_by_table(a.rows, [name for name, t in data.tables.items() if not t.references])
        model = HierarchySynthesizer(a.seed).fit(data, fit_rows=FIT_ROWS if a.fit_rows is None else a.fit_rows)
        if a.where:
            made = model.sample_where(spark, rows, where_table(a.where, {n: t.data.columns for n, t in data.tables.items()}), a.where, most=a.max_oversample)
        else:
            made = model.sample(spark, rows)
        made = {n: apply_policy(d, data.tables[n].columns, a.text_policy, seed=a.seed, salt=a.salt, key=row_identity(d), source=data.tables[n].data) for n, d in made.items()}
        suffixes = {n: Path(s["value"]).suffix or ".csv" for n, s in schema.sources.items()}
        write_dataset(made, a.out, suffixes, one_file=a.one_file)
        if a.explain:
            for name, part in model.models.items():
                _explain(part, f"{name}.")
        print(json.dumps({n: d.count() for n, d in made.items()}))
        return 0
    table, constraints = _table(spark, a)
    if a.where and (note := thin_support_warning(precheck(table.data, a.where))):
        print(f"warning: {note}", file=sys.stderr)
    n = rows_by_table(a.rows, ["table"])["table"]
    made = generate(table, n, seed=a.seed, constraints=constraints, where=a.where, fit_rows=a.fit_rows, text_policy=a.text_policy, salt=a.salt, max_oversample=a.max_oversample, strip_pii=not a.keep_pii)
    write(made.data.drop("row_id"), parse_sink(a.out, table=a.out_table), one_file=a.one_file)
    if made.report:
        for line in report_lines(made.report):
            print(line)
    if a.explain:
        _explain(made.synthesizer)
    if not a.no_quality:
        print(summary_line(compare(table.data, made.data.drop("row_id"), table.columns, dcr_rows=SUMMARY_ROWS, seed=a.seed)))
    return 0


def fit(a: argparse.Namespace) -> int:
    spark = _session()
    table, _ = _table(spark, a)
    if found := pii.detect(table.data, table.columns, a.seed):
        print("personal data in " + ", ".join(f"{d.column} ({d.entity})" for d in found) + "; drop the columns first", file=sys.stderr)
        return 1
    model = TreeSynthesizer(a.seed).fit(table, fit_rows=100_000 if a.fit_rows is None else a.fit_rows)
    artifact.save(spark, model, a.out, Path(a.schema).read_text(encoding="utf-8") if a.schema else None)
    print(f"fitted {len(model.names)} columns on {model.rows} rows")
    return 0


def sample(a: argparse.Namespace) -> int:
    spark = _session()
    model, _, toml = artifact.load(spark, a.artifact)
    constraints = [parse_constraint(c) for c in tomllib.loads(toml).get("constraints", [])] if toml else []
    columns = [f.column for f in model.fitted] + [c for c, _ in model.keys]
    frame = model.sample(spark, 1).drop("row_id")
    table = Table("table", [next(c for c in columns if c.name == n) for n in model.names], None, frame)
    if a.where:
        constraints.append(parse_constraint({"kind": "where", "expression": a.where}))
    made = generate(table, int(a.rows), seed=model.seed, constraints=constraints, text_policy=a.text_policy, salt=a.salt, strip_pii=False, fitted=model, max_oversample=a.max_oversample)
    write(made.data.drop("row_id"), parse_sink(a.out, table=a.out_table), one_file=a.one_file)
    return 0


def diff(a: argparse.Namespace) -> int:
    spark = _session()
    side = lambda value: _source(spark, value, a) if "://" in value else read(spark, FilePath(value), seed=a.seed)
    real, synth = side(a.real), side(a.synth)
    report = compare(real, synth, infer_table("real", real).columns, dcr_rows=a.dcr_rows, seed=a.seed)
    print(to_text(report))
    if a.json:
        Path(a.json).write_text(to_json(report), encoding="utf-8")
    if a.html:
        Path(a.html).write_text(to_html(report), encoding="utf-8")
    broken = breaches(report, Gates(a.max_marginal, a.max_correlation, a.min_dcr, a.max_verbatim))
    for b in broken:
        print(f"gate {b.gate}: {b.value if not math.isnan(b.value) else 'no value'} against {b.limit}", file=sys.stderr)
    return 2 if broken else 0


def schema(a: argparse.Namespace) -> int:
    spark = _session()
    table = infer_table(Path(a.source).stem, _source(spark, a.source, a))
    if a.action == "infer":
        text = S.emit(table)
        Path(a.out).write_text(text, encoding="utf-8") if a.out else print(text)
        return 0
    if not a.schema:
        raise ValueError("check needs --schema")
    try:
        S.validate(table, S.load(a.schema))
    except ValueError as e:
        print(f"invalid: {e}", file=sys.stderr)
        return 1
    print("valid")
    return 0


def artifact_info(a: argparse.Namespace) -> int:
    for k, v in vars(artifact.info(_session(), a.artifact)).items():
        print(f"{k:<10} {v}")
    return 0


def doctor(a: argparse.Namespace) -> int:
    bad = 0
    print(f"mirrorframe {__version__}, Python {platform.python_version()}")
    for name, core in (("pyspark", True), ("pyarrow", True), ("numpy", True), ("pandas", True), ("duckdb", False)):
        try:
            print(f"{name:<10} {__import__(name).__version__}")
        except ImportError:
            print(f"{name:<10} missing")
            bad |= core
    try:
        spark = _session()
        print(f"java       {spark._jvm.System.getProperty('java.version')}")
        print(f"spark      {spark.range(1000).count()} rows counted on {spark.sparkContext.master}")
    except Exception as e:  # whatever keeps Spark from starting is what the user wants to see
        print(f"spark      doesn't run: {e}")
        bad = 1
    return int(bad)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="mirrorframe")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, f, *positional: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        p.add_argument("--seed", type=int, default=0)
        p.set_defaults(run=f)
        return p

    def source(p: argparse.ArgumentParser) -> None:
        for x in ("--table", "--query", "--password-cmd", "--schema"):
            p.add_argument(x)
        p.add_argument("--timeout", type=int)
        p.add_argument("--fit-rows", type=int)

    def out(p: argparse.ArgumentParser) -> None:
        p.add_argument("--out", required=True)
        p.add_argument("--out-table")
        p.add_argument("--one-file", action="store_true")
        p.add_argument("--text-policy", choices=[str(x) for x in TextPolicy], default="sample")
        p.add_argument("--salt", default="")
        p.add_argument("--where")
        p.add_argument("--max-oversample", type=float, default=4.0)

    p = add("gen", gen, "source")
    source(p)
    out(p)
    p.add_argument("--rows", action="append", required=True)
    p.add_argument("--model", choices=["cart"], default="cart")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--no-quality", action="store_true")
    p.add_argument("--keep-pii", action="store_true")
    p = add("fit", fit, "source")
    source(p)
    p.add_argument("--out", required=True)
    p = add("sample", sample, "artifact")
    out(p)
    p.add_argument("--rows", required=True)
    p = add("diff", diff, "real", "synth")
    source(p)
    p.add_argument("--dcr-rows", type=int, default=50_000)
    for x in ("--max-marginal", "--max-correlation", "--min-dcr", "--max-verbatim"):
        p.add_argument(x, type=float)
    for x in ("--json", "--html"):
        p.add_argument(x)
    p = add("schema", schema)
    p.add_argument("action", choices=["infer", "check"])
    p.add_argument("source")
    source(p)
    p.add_argument("--out")
    p = add("artifact", artifact_info)
    p.add_argument("action", choices=["info"])
    p.add_argument("artifact")
    add("doctor", doctor)
    return top


def main(argv: list[str] | None = None) -> int:
    a, own = parser().parse_args(argv), SparkSession.getActiveSession() is None
    try:
        return a.run(a)
    except (ValueError, NotImplementedError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        if own and (spark := SparkSession.getActiveSession()):
            drop_stages(spark)


if __name__ == "__main__":
    sys.exit(main())

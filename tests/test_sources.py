import datetime as dt
import json

import duckdb
import pytest

from mirrorframe.cli import main, rows_by_table
from mirrorframe.plans import schema_toml as S
from mirrorframe.plans.infer import infer_table
from mirrorframe.plans.model import ColumnType
from mirrorframe.sources import uri as U
from mirrorframe.sources.reading import read, read_file
from mirrorframe.sources.writing import write, write_file
from mirrorframe.streaming.drift import watch


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(2, "b, x", 1.5, dt.datetime(2024, 1, 2, 3, 4, 5)), (1, None, 2.0, dt.datetime(2024, 2, 2))], "z long, name string, a double, t timestamp_ntz").coalesce(1)


@pytest.mark.parametrize("kind", ["csv", "tsv", "parquet", "ndjson", "json", "arrow"])
def test_file_round_trip(spark, frame, tmp_path, kind):
    path = f"{tmp_path}/f.{kind}"
    with pytest.warns(UserWarning) if "json" in kind else __import__("contextlib").nullcontext():
        write_file(frame, path, one_file=True)
    back = read_file(spark, path)
    assert sorted(map(str, back.select(*frame.columns).collect())) == sorted(map(str, frame.collect()))
    assert dict(back.dtypes) == dict(frame.dtypes)
    if kind != "json":
        assert back.columns == frame.columns


def test_folders(spark, frame, tmp_path):
    write_file(frame, f"{tmp_path}/d.csv")
    assert read_file(spark, f"{tmp_path}/d.csv").count() == 2
    with pytest.raises(U.SourceError):
        read_file(spark, "x.xls")


def test_duckdb_round_trip(spark, frame, tmp_path):
    path = f"{tmp_path}/x.duckdb"
    write(frame, U.parse_sink(f"duckdb://{path}#items"))
    back = read(spark, U.parse_source(f"duckdb://{path}", table="items"))
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    with duckdb.connect(path) as c:
        c.execute("CREATE TABLE big AS SELECT range AS i FROM range(1000)")
    spec = U.parse_source(f"duckdb://{path}", query="SELECT * FROM big")
    assert read(spark, spec, fit_rows=50).count() == 50 and read(spark, spec).count() == 1000
    slow = U.parse_source(f"duckdb://{path}", query="SELECT count(*) AS n FROM range(10000000) a, range(10000000) b WHERE a.range % 7 = b.range % 11", timeout=1)
    with pytest.raises(U.ProbeError):
        read(spark, slow)


def test_uris(monkeypatch):
    monkeypatch.setenv("DB_USER", "me")
    assert U.expand_env("${DB_USER}/$x") == "me/$x"
    with pytest.raises(U.SourceError):
        U.expand_env("${NO_SUCH_VARIABLE}")
    assert U.redact("postgres://u:secret@h/db") == "postgres://u:***@h/db"
    assert U.redact("postgres://u:p@s/e:c@h:5/db") == "postgres://u:***@h:5/db" and U.redact("duckdb:///a/b.duckdb") == "duckdb:///a/b.duckdb"
    with pytest.raises(U.SourceError):
        U.with_password("postgres://u@h/db", "true")
    monkeypatch.setattr(U, "PASSWORD_SECONDS", 0.2)
    with pytest.raises(U.SourceError):
        U.with_password("postgres://u@h/db", "sleep 5")
    monkeypatch.undo()
    assert "secret" not in repr(U.parse_source("postgres://u:secret@h/db", table="t"))
    assert U.with_password("postgres://u@h:5/db", "printf 'a b'") == "postgres://u:a%20b@h:5/db"
    assert U.with_password("postgres://u:old@[::1]:5/Db?x=a@b", "printf p@q") == "postgres://u:p%40q@[::1]:5/Db?x=a@b" and U.with_password("postgres://Me@HOST", "echo x") == "postgres://Me:x@HOST"
    for bad in ("postgres://h/db", "postgres://@h/db", "postgres://h/db?user=a@b"):
        with pytest.raises(U.SourceError):
            U.with_password(bad, "echo x")
    for bad in ({"table": "t", "query": "q"}, {}):
        with pytest.raises(U.SourceError):
            U.parse_source("postgres://h/db", **bad)
    with pytest.raises(U.SourceError):
        U.parse_source("mysql://h/db", table="t")
    with pytest.raises(U.SinkError):
        U.parse_sink("snowflake://h/db")


def test_pushed_sql():
    assert U.sample_sql("duckdb", "SELECT 1", None, 0) == "SELECT 1" == U.sample_sql("duckdb", "SELECT 1", 0, 0)
    assert "reservoir(10 ROWS) REPEATABLE (3)" in U.sample_sql("duckdb", "SELECT 1", 10, 3)
    assert "SAMPLE (10 ROWS)" in U.sample_sql("snowflake", "SELECT 1", 10, 3) and "LIMIT 10" in U.sample_sql("postgres", "SELECT 1", 10, 3, 1000)
    assert "pg_class" in U.count_sql("postgres", "a.b", None) and "count(*)" in U.count_sql("postgres", None, "SELECT 1;")
    with pytest.raises(U.SourceError):
        U.enforce_limit(2_000_000, None)
    U.enforce_limit(2_000_000, 0)


def test_schema_toml(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", 6.0)], "ref long, s string, x double")
    path = tmp_path / "s.toml"
    path.write_text('[table]\nprimary_key = "ref"\n[columns.s]\ntype = "categorical"\n[[constraints]]\nkind = "derived"\ncolumn = "y"\nexpression = "x * 2"\n[[constraints]]\nkind = "where"\nexpression = "y > 1"\n')
    schema = S.load(str(path))
    table = S.apply_overrides(infer_table("t", df), schema)
    assert table["ref"].type is ColumnType.KEY and table.primary_key == "ref" and table["s"].type is ColumnType.CATEGORICAL
    S.validate(infer_table("t", df), schema)
    again = S.parse_table(__import__("tomllib").loads(S.emit(table, schema.constraints)))
    assert again.primary_key == "ref" and again.constraints == schema.constraints
    for bad in ('[columns.x]\ntype = "boolean"', "[columns.x]\ncalendar_features = true", "[nope]\na = 1", '[[constraints]]\nkind = "z"'):
        path.write_text(bad)
        with pytest.raises(S.SchemaError):
            S.load(str(path))
    path.write_text('[columns.nope]\ntype = "text"')
    with pytest.raises(S.SchemaError):
        S.validate(infer_table("t", df), S.load(str(path)))


def test_multi_schema(spark, tmp_path):
    spark.createDataFrame([(1, "SE"), (2, "NO")], "user_id int, country string").toPandas().to_csv(tmp_path / "users.csv", index=False)
    spark.createDataFrame([(1, 1), (2, 9)], "order_id int, user_id int").toPandas().to_csv(tmp_path / "orders.csv", index=False)
    text = '[tables.users]\nfile = "users.csv"\nprimary_key = "user_id"\n[tables.orders]\npath = "orders.csv"\n[[foreign_keys]]\nchild_table = "orders"\nchild_column = "user_id"\nparent_table = "users"\nparent_column = "user_id"\n'
    schema = S.parse_multi(__import__("tomllib").loads(text))
    with pytest.raises(ValueError, match="FK violation"):
        S.to_dataset(spark, schema, str(tmp_path))
    with pytest.raises(S.SchemaError):
        S.parse_multi({"tables": {"a": {"file": "x", "uri": "y"}}})


def test_cli(spark, tmp_path, capsys):
    rows = [(i, ["free", "pro"][i % 2], i % 40, float(i % 9)) for i in range(200)]
    spark.createDataFrame(rows, "account_id long, plan string, age long, score double").toPandas().to_csv(tmp_path / "a.csv", index=False)
    src, out = f"{tmp_path}/a.csv", f"{tmp_path}/o.csv"
    assert main(["gen", src, "--rows", "50", "--out", out, "--one-file", "--seed", "1", "--where", "plan == 'pro'", "--explain"]) == 0
    assert "quality:" in capsys.readouterr().out and read_file(spark, out).filter("plan = 'pro'").count() == 50
    assert main(["diff", src, out, "--max-marginal", "0.0001", "--json", f"{tmp_path}/r.json", "--html", f"{tmp_path}/r.html"]) == 2
    assert main(["fit", src, "--out", f"{tmp_path}/m"]) == 0 and main(["artifact", "info", f"{tmp_path}/m"]) == 0
    assert main(["sample", f"{tmp_path}/m", "--rows", "20", "--out", f"{tmp_path}/s.parquet"]) == 0 and read_file(spark, f"{tmp_path}/s.parquet").count() == 20
    assert main(["schema", "infer", src, "--out", f"{tmp_path}/a.toml"]) == 0 and main(["schema", "check", src, "--schema", f"{tmp_path}/a.toml"]) == 0
    assert main(["gen", f"{tmp_path}/none.xls", "--rows", "5", "--out", out]) == 1 and main(["doctor"]) == 0
    assert main(["schema", "check", src]) == 1
    with pytest.raises(SystemExit):
        main(["artifact", "drop", f"{tmp_path}/m"])


def test_row_counts():
    assert rows_by_table(["5"], ["a", "b"]) == {"a": 5, "b": 5} and rows_by_table(["a=3"], ["a"]) == {"a": 3}
    for bad in (["x"], ["0"], ["c=1", "a=1"]):
        with pytest.raises(ValueError):
            rows_by_table(bad, ["a"])


def test_drift(spark, tmp_path):
    df = spark.range(200).selectExpr("cast(id % 10 as double) x", "cast(id % 3 as string) c")
    df.write.parquet(f"{tmp_path}/in")
    seen = []
    q = watch(df.filter("x < 3"), spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", on_drift=lambda b, rows: seen.extend(rows))
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2 and [r.column for r in seen] == ["x"]


def test_json_texts_are_cleaned(spark, tmp_path):
    rows = [{"z": " x ", "a": "NA", "n": "1"}, {"z": "?", "a": "b", "n": "N/A", "late": 2}]
    (tmp_path / "t.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "t.ndjson").write_text("\n".join(map(json.dumps, rows)))
    for name in ("t.json", "t.ndjson"):
        df = read_file(spark, f"file://{tmp_path}/{name}")
        assert df.columns == ["z", "a", "n", "late"] and dict(df.dtypes)["n"] == "bigint"
        assert {tuple(r) for r in df.collect()} == {("x", None, 1, None), (None, "b", None, 2)}

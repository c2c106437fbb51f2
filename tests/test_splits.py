"""CSV and JSON files cut anywhere, against Spark's readers of whole files and against plain Python."""

import csv
import io
import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from mirrorframe.sources import splits
from mirrorframe.sources.reading import read_file


@pytest.fixture
def small_blocks(spark, monkeypatch):
    """Blocks of some bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(splits, "WHOLE_BYTES", 0)
    yield 400
    for k in keys:
        spark.conf.unset(k)


def words(rng, pool, n):
    return "".join(rng.choice(pool) for _ in range(n))


@pytest.mark.parametrize(("sep", "end"), [(",", "\n"), (",", "\r\n"), ("\t", "\n")])
def test_csv(spark, tmp_path, small_blocks, sep, end):
    rng = random.Random(sep + end)
    kind = "csv" if sep == "," else "tsv"
    for part in range(2):
        out = io.StringIO()
        w = csv.writer(out, delimiter=sep, lineterminator=end)
        w.writerow(["id", "text", 'odd "name"', "x"])
        for i in range(60):
            w.writerow([f"r{part}-{i}", words(rng, 'ab",\té ' + end, rng.choice([0, 3, 9, 400 if i % 20 == 0 else 5])), words(rng, '"\n', 3) if i % 7 == 0 else "q", "" if i % 3 else "z"])
        body = out.getvalue() + f'tail{sep}5" pipe{sep}a "b" c{sep}"quoted" rest{end}{end}'
        (tmp_path / f"d.{kind}").mkdir(exist_ok=True)
        (tmp_path / f"d.{kind}" / f"part-{part}.{kind}").write_bytes(body.encode())
    path = f"{tmp_path}/d.{kind}"
    assert splits._blocks(spark, path, "\n").select("file", "start").distinct().count() > 4
    got = splits.read_csv(spark, path, sep)
    want = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"')
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.count() == 122


def test_csv_of_one_line_records_goes_to_the_plain_reader(spark, tmp_path, small_blocks, monkeypatch):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f'{i},"a, ""{i}"""\n' for i in range(100)))
    monkeypatch.setattr(splits, "_records", None)
    rows = read_file(spark, f"{tmp_path}/a.csv")
    assert rows.rdd.getNumPartitions() > 2 and sorted((r.x, r.y) for r in rows.collect()) == [(i, f'a, "{i}"') for i in range(100)]
    (tmp_path / "e.csv").write_text("x,y\n")
    assert read_file(spark, f"{tmp_path}/e.csv").columns == ["x", "y"] and read_file(spark, f"{tmp_path}/e.csv").count() == 0


@pytest.mark.parametrize("layout", ["one line", "indented", "single", "lines", "spread", "empty"])
def test_json(spark, tmp_path, small_blocks, layout):
    rng = random.Random(3)
    rows = [{"z": i, "a": words(rng, '{}[]"\\,é\n\t ', rng.choice([0, 4, 30, 300 if i % 9 == 0 else 3])), "deep": {"k": [{"v": i}, {"v": None}], "s": "}{"}} for i in range(1 if layout == "single" else 30)]
    text = {"one line": json.dumps(rows), "indented": "\ufeff \n" * (layout == "x") + json.dumps(rows, indent=3, ensure_ascii=False), "single": json.dumps(rows[0], indent=1), "lines": "\n".join(map(json.dumps, rows)), "spread": " [\n\n" + " ,\n ".join(json.dumps(r) for r in rows) + "\n]\n", "empty": "[]"}[layout]
    (tmp_path / "f.json").write_text(text, encoding="utf-8")
    got, _ = splits.read_json(spark, f"{tmp_path}/f.json")
    if layout == "empty":
        assert got.count() == 0
        return
    assert sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in got.collect()) == sorted(json.dumps(r, sort_keys=True) for r in rows)
    assert read_file(spark, f"{tmp_path}/f.json").columns == ["z", "a", "deep"]


@given(st.text('",ab\n', max_size=60))
def test_lines_compose(text):
    """The state behind a text doesn't depend on where its lines are cut off, and equals a walk over its characters."""
    state = (False, 0)
    for line in text.split("\n"):
        state = splits.after_line(line, state, ",")
    inside, start, at = False, True, 0
    while at < len(text):
        c = text[at]
        if inside:
            if c == '"' and text[at + 1 : at + 2] == '"':
                at += 1
            elif c == '"':
                inside, start = False, False
        elif c == '"' and start:
            inside = True
        else:
            start = c in ",\n"
        at += 1
    assert state == (inside, 0)


@given(st.recursive(st.one_of(st.integers(), st.text('{}[]"\\,x', max_size=8)), lambda t: st.one_of(st.lists(t, max_size=3), st.dictionaries(st.text('{"x', max_size=3), t, max_size=3)), max_leaves=20))
def test_pieces_of_json(value):
    text = json.dumps([{"v": value}])
    state = (False, 0)
    for piece in text.split("}")[:-1]:
        state = splits.after_piece(piece, state)
    assert state == (False, 1)

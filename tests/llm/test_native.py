"""Mixing, license scans, fingerprints and the pipeline."""

import hashlib
import math
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from mirrorframe.llm import fingerprints, licenses, mixing
from mirrorframe.llm.common import stage
from mirrorframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Water filling by rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in out]
        level = left / sum(w[s] for s in free) if free else 0
        full = [s for s in free if w[s] * level > cap * sizes[s] or sizes[s] == 0]
        if not full:
            return out | {s: w[s] * level for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "b", "é", "Z", None])
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)) if i % 50 else None, source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def test_mix(spark, documents):
    rows = mixing.weighted_mix(documents).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert r.taken == r.copies * r["size"] and r.copies <= 2
    want = targets(dict(sizes))
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9)
    total = sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)
    assert 1.5 * total - 60 <= sum(taken.values()) <= 1.5 * total
    again = {(r.id, r.taken) for r in mixing.weighted_mix(documents.repartition(2)).collect()}
    assert again == {(r.id, r.taken) for r in rows}


def test_mixed_documents(spark, documents):
    plan = {r.id: r.copies for r in mixing.weighted_mix(documents).collect()}
    got = Counter(r.doc_id for r in mixing.mixed_documents(documents).collect())
    assert got == Counter({k: v for k, v in plan.items() if v})


def test_mix_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.weighted_mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.weighted_mix(blank).collect()] == [0, 0, 0] and mixing.mixed_documents(blank).count() >= 2
    one = spark.createDataFrame([(1, "a b c", "s", 9)], "doc_id long, text string, source string, size int")
    assert [(r["size"], r.target, r.taken) for r in mixing.weighted_mix(one).collect()] == [(3, 4.5, 3)]


def edited(texts):
    ids = sorted(texts)
    out = {}
    for k, i in enumerate(ids):
        t, n = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(t) // 2
        out[i] = t[: len(t) - half] + n[:half]
    return out


def test_fingerprints(spark):
    rng = random.Random(8)
    texts = {i * 3: " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 2) + str(rng.randint(0, 9)) for _ in range(rng.randint(0, 80))) for i in range(120)}
    texts |= {1: None, 2: "", 4: "ééé x 😀", 5: texts[9], 7: "one"}
    df = spark.createDataFrame([(i, t, "q") for i, t in texts.items()], "doc_id long, text string, fingerprint string").repartition(4)
    got = {r.id: r for r in fingerprints.fingerprints(df, k=48).collect()}
    want, ids = edited(texts), sorted(texts)
    bag = lambda t: Counter(t.lower().split())
    like = lambda a, b: (lambda x, y: sum((x & y).values()) / sum((x | y).values()) if x | y else 1.0)(bag(a), bag(b))
    errors = []
    for k, i in enumerate(ids):
        r, t, n = got[i], texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        errors += [r.near_edited - like(t, want[i]), r.near_next - like(t, n)]
    assert got[9].fingerprint == got[5].fingerprint and got[1].fingerprint == got[2].fingerprint
    assert abs(sum(errors) / len(errors)) < 0.03 and max(map(abs, errors)) < 0.35


def test_samples_by_brute_force(spark):
    """The least ln a of every sample, drawn in plain Python from the same hashes."""
    import struct

    import xxhash
    from pyspark.sql import functions as F

    rng = random.Random(12)
    bags = {k: {rng.getrandbits(62): rng.randint(1, 9) for _ in range(rng.randint(1, 30))} for k in range(12)}
    terms = spark.createDataFrame([(k, t, w) for k, bag in bags.items() for t, w in bag.items()], "k long, term long, w long").select("k", "term", F.log(F.col("w").cast("double")).alias("ln_w"))
    got = {r.k: r for r in fingerprints.samples(terms, ["k"], 6).collect()}
    part = lambda x, at, n: ((x >> at & (1 << n) - 1) + 0.5) / (1 << n)
    for k, bag in bags.items():
        for i in range(6):
            least = math.inf
            for t, w in bag.items():
                h = xxhash.xxh64_intdigest(struct.pack("<i", i), xxhash.xxh64_intdigest(struct.pack("<q", t), 42))
                g = xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)
                r, c, b = -math.log(part(h, 0, 14) * part(h, 14, 14)), -math.log(part(g, 0, 32) * part(g, 32, 32)), part(h, 28, 36)
                least = min(least, math.log(c) - r * (math.floor(math.log(w) / r + b) - b + 1))
            assert math.isclose(got[k][f"s{i}"], least, rel_tol=1e-9)


def test_fingerprints_odd_tables(spark):
    assert fingerprints.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a a").hexdigest() and one.near_next == 1.0
    rows = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b")], "doc_id long, text string")
    assert sorted((r.id is None, r.n_chars) for r in fingerprints.fingerprints(rows).collect()) == [(False, 1), (True, 1)]


def test_license_inheritance(spark):
    from pyspark.sql import functions as F

    wrap = lambda text, mark="": "\n".join(mark + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    L = licenses
    files = [
        ("1", "p/LICENSE", "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + wrap(L.MIT_GRANT + L.MIT_REST)),
        ("2", "p/src/a/x.py", "print(1)"),
        ("3", "p/src/y.py", "# Licensed under the Apache License, Version 2.0\nimport os\n\nprint(os.name, 'and much more code')"),
        ("4", "p/src/a/z.py", None),
        ("5", "q/x.py", ""),
        (None, None, "the and of"),
        ("7", "r/COPYING", "Copyright 2001, A. Person\n\n" + wrap(L.BSD_GRANT) + "\n\n" + wrap(L.BSD_THIRD) + "\n\n" + wrap(L.BSD_REST)),
        ("8", "r/two/COPYING", "Copyright 2001, A. Person\n\n" + wrap(L.BSD_GRANT) + "\n\n" + wrap(L.BSD_REST)),
        ("9", "r/two/b/c.c", "int main() { return 0; }"),
        ("10", "q/g.c", wrap(L.GPL_TERMS.format(3), " * ") + "\n\n" + " ".join(f"int v{i};" for i in range(60))),
        ("10", "q/h.c", "one id twice"),
        (None, "s/n.c", "/* Released under the MIT License */\n\nint x = 1; long text of other words follows here"),
        ("11", "q/long.c", "word " * 5000),
    ]
    df = spark.createDataFrame(files, "id string, path string, text string").withColumn("row", F.lit(1)).withColumn("licence", F.lit("x"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    scan = lambda **how: {(r.id, r.directory): (r.own_licence, r.licence, r.from_directory) for r in licenses.scan_licences(df, id_col="id", directory=folder, **how).collect()}
    for got in (scan(), scan(licence_file=F.col("path").rlike("(LICENSE|COPYING)$"))):
        assert got["1", "p"] == ("MIT", "MIT", None) and got["3", "p/src"] == ("Apache-2.0", "Apache-2.0", None)
        assert got["2", "p/src/a"] == got["4", "p/src/a"] == (None, "MIT", "p")  # a header of another file isn't inherited
        assert got["5", "q"] == got[None, ""] == got["11", "q"] == (None, None, None)
        assert got["7", "r"] == ("BSD-3-Clause", "BSD-3-Clause", None) and got["8", "r/two"] == ("BSD-2-Clause", "BSD-2-Clause", None) and got["9", "r/two/b"] == (None, "BSD-2-Clause", "r/two")
        assert got[None, "s"] == ("MIT", "MIT", None)
    rows = licenses.scan_licences(df, id_col="id", directory=folder).collect()
    assert len(rows) == len(files) and sorted(str(r.own_licence) for r in rows if r.id == "10") == ["GPL-3.0", "None"]
    assert licenses.scan_licences(df.limit(0), id_col="id", directory=folder).count() == 0


def test_license_inheritance_from_the_top(spark):
    """Relative paths inherit from '', and complete long licences speak by their title."""
    from pyspark.sql import functions as F

    L = licenses
    body = "\n\n".join(f"{k}. Some section of terms that says much about rights and duties of number {k}." for k in range(30))
    title = lambda name, at=-1: "\n".join([t for n, t in L.TEMPLATES if n == name and t in L.TITLES][at].replace(" Version", "\n Version").split("\n"))
    files = [
        (1, "LICENSE", L.MIT_GRANT + L.MIT_REST),
        (2, "src/x.py", "x = 1"),
        (3, "g/COPYING", "\n\n      " + title("GPL-3.0") + "\n\n" + body),
        (4, "g/src/y.c", "int y;"),
        (5, "a/LICENSE", title("Apache-2.0") + "\n\n" + body),
        (6, "a/z.go", "package z"),
        (7, "m/readme", body + "\n\n" + title("LGPL-2.1")),
        (8, "m/k.c", "int k;"),
        (9, "t/one", L.ISC),
        (9, "t/two", L.MIT_GRANT + L.MIT_REST),
        (10, "t/deep/q", "ties by id go to the first licence"),
        (11, "u/LICENSE", title("Unlicense") + "\n\n" + body),
        (12, "u/v", "v"),
    ]
    df = spark.createDataFrame(files, "id long, path string, text string")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    got = {(r.id, r.directory): (r.own_licence, r.licence, r.from_directory) for r in L.scan_licences(df, id_col="id", directory=folder).collect()}
    assert got[1, ""] == ("MIT", "MIT", None) and got[2, "src"] == (None, "MIT", "")
    assert got[3, "g"] == ("GPL-3.0", "GPL-3.0", None) and got[4, "g/src"] == (None, "GPL-3.0", "g")
    assert got[6, "a"] == (None, "Apache-2.0", "a") and got[12, "u"] == (None, "Unlicense", "u")
    assert got[8, "m"] == (None, "MIT", "")  # a title further down doesn't speak
    assert got[10, "t/deep"] == (None, "ISC", "t")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    if not Path(SF).exists():
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    clean = lambda df: sorted(str(tuple(None if v != v else v for v in r)) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None))
    assert clean(QUERIES[name](spark, SF).toPandas()) == clean(c.sql(ORACLES[name]).df())


def test_pipeline(spark):
    import corpus_pipeline

    if not Path(SF).exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = stage(out, name)
        counts.append(docs.count())
    assert counts[1] == counts[0] and counts[2] < counts[1] and 0 < counts[3] <= counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[4]
    assert corpus_pipeline.run(spark, SF).orderBy(*last.columns).collect() == last.orderBy(*last.columns).collect()


def test_pipeline_of_odd_rows(spark):
    """Null ids, one id with two texts, columns that could clash: every stage against plain Python."""
    import corpus_pipeline
    from test_pairs import classes, removed

    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage = say(40)
    texts = [say(30) for _ in range(8)] + [say(20) + " " + passage, passage + " " + say(25), say(30) + " é" + passage, None, "", "12 34", "é" * 200]
    ids = [None, None, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]
    rows = [(i, t, "en", "s" if k % 2 else None, len(t or ""), k / 10, f"x{k}", k, k, k, k, k) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += [(20, texts[2], "en", "s", 1, 9.0, "copy", 0, 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, id long, n_removed long, _row long, _at long, _id long").repartition(3)
    steps = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted(map(str, map(tuple, df.collect())))
    run = lambda name, df: stage(steps[name](spark, df, SF), name)
    first = run("language", docs)
    assert plain(first) == sorted(str(r) for r in rows if any(c.isalpha() for c in r[1] or ""))
    second = run("near_dedup", first)
    left = [tuple(r) for r in first.collect()]
    found = classes([(k, r[1]) for k, r in enumerate(sorted(left, key=lambda r: (r[0] is None, r[0] or 0)))])
    assert second.count() == sum(x[2] for x in found.values()) == len(left) - 1 and set(plain(second)) <= set(map(str, left))
    third = run("repeats", second)
    ordered = sorted([tuple(r) for r in second.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    assert {r[6]: r[1] for r in ordered if r[0] == 3} == {r.lang_pred: r.text for r in third.collect() if r.doc_id == 3}  # two texts of one id stay
    total = sum(x[0] - x[1] for x in removed([(k, r[1]) for k, r in enumerate(ordered)]).values())
    after = third.collect()
    assert abs(sum(len(r.text.encode()) for r in after) - total) <= 4 and all(r.n_chars == len(r.text) for r in after)
    others = lambda rows_: {r[6]: (r[0], *r[2:4], *r[5:]) for r in rows_}
    assert others(map(tuple, after)) == others(ordered)
    fourth = run("mix", third)
    took, sizes = Counter(tuple(r) for r in fourth.collect()), sum(len(r.text.split()) for r in after)
    assert set(took) <= {tuple(r) for r in after} and max(took.values()) <= 2 and sum(n * len(r[1].split()) for r, n in took.items()) <= 1.5 * sizes
    assert corpus_pipeline.STAGES[-1][1](spark, fourth, SF).count() == fourth.count()
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), SF).count() == 0

"""Near-dedup and suffix-array dedup against brute force."""

import gc
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorframe.llm import components as C
from mirrorframe.llm import languages
from mirrorframe.llm import near_dedup as N
from mirrorframe.llm import repeats as R
from mirrorframe.llm.common import released, stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(docs):
    sets = {i: shingles(t) for i, t in docs}
    low = {i: i for i in sets}

    def top(x):
        while low[x] != x:
            x = low[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = top(x), top(y)
                low[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def removed(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        mark = np.zeros(len(b), bool)
        for o in range(len(b) - R.MATCH + 1):
            w = b[o : o + R.MATCH]
            if w in seen:
                mark[o : o + R.MATCH] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(int), [0]])) == 1)
        out[i] = (len(b), int(mark.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~mark])).hexdigest())
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    docs, passages = [], [" ".join(word() for _ in range(60)) for _ in range(3)]
    for i in range(120):
        text = " ".join(word() for _ in range(rng.randint(1, 150)))
        if i % 3 == 0:
            text += " " + rng.choice(passages)
        docs.append((i, text))
    base = docs[1][1] + " " + passages[0]
    for i in range(120, 220):  # one large group of near copies, some below the threshold
        w = base.split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join(w).upper() if i % 9 == 0 else " ".join(w)))
    docs += [(300 + i, docs[5][1]) for i in range(40)]
    docs += [(400, None), (401, ""), (402, "  \t\n"), (403, "a b"), (404, "A  B"), (405, "a b c d e"), (406, "x" * 500), (407, "é" * 700), (408, "\x1fa\x1f b"), (409, "ab" * 400)]
    docs.append((500, " ".join(word() for _ in range(6000))))
    docs.append((501, docs[-1][1][100:]))
    return docs


def test_near_duplicates(spark, corpus):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in corpus], "doc_id long, text string, n int, component_id string").repartition(5)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}
    assert got == classes(corpus)


def test_near_duplicates_of_large_nodes(spark, corpus, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 2)
    monkeypatch.setattr(N, "BLOCK", 7)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect()}
    assert got == classes(corpus)


def test_near_duplicates_of_one_template(spark, monkeypatch):
    """600 texts share a template (likeness 0.67); each is linked to one other (0.77) only."""
    words = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    docs = [(i, " ".join([words("t", 96), words(f"p{i // 2}", 8), words(f"d{i}", 15)])) for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for small, block in ((N.SMALL, N.BLOCK), (1000, N.BLOCK), (16, 100)):
        monkeypatch.setattr(N, "SMALL", small)
        monkeypatch.setattr(N, "BLOCK", block)
        got = {r.id: r.component_id for r in N.near_duplicates(df).collect()}
        assert got == {i: i // 2 * 2 for i in range(600)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=8), st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=8))
def test_overlaps(left, right):
    arrays = lambda sets: [np.array(sorted(x), np.uint64) for x in sets]
    assert N.overlaps(arrays(left), arrays(right)).tolist() == [[len(a & b) for b in right] for a in left]


def test_near_duplicates_odd_tables(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q"), (2, "a b c d e f"), (None, "z"), (None, "z"), (None, "q"), (4, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, map(tuple, N.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(1, 2, 1, True), (1, 2, 1, False), (2, 2, 1, False), (1, 1, 1, True), (None, 1, 1, False), (None, 1, None, True), (None, 1, None, False), (4, 0, 4, True), (None, 0, None, True)]))
    wide = df.selectExpr("doc_id", "text", "'x' AS component_id", "1.5 AS id", "2 AS _row", "3 AS _own")
    kept = N.without_near_duplicates(wide)
    assert kept.columns == wide.columns and sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, "a b c d e f"), (1, "q"), (None, "z"), (4, None), (None, None)]))
    assert N.near_duplicates(spark.createDataFrame([(1,)], "doc_id long")).first().n_shingles == 0


def _reachable(links):
    """Least id reachable, by search."""
    near = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out = {}
    for i in sorted(near):
        todo = [i] if i not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += near[x]
    return out


def _chains():
    rng = random.Random(1)
    up = [(i, i + 1) for i in range(100, 300)] + [(7, 900), (8, 900), (5, 5)]
    order = rng.sample(range(1000), 200)
    valley = list(range(400, 200, -1)) + list(range(201, 400))
    star = [(10_000, i) for i in range(200)]
    return {"up": up, "random": list(zip(order, order[1:], strict=False)), "valley": [(x, y + 1000) for x, y in zip(valley, valley[1:], strict=False)] + [(y + 1000, y) for y in valley], "star": star}


@pytest.mark.parametrize("shape", ["up", "random", "valley", "star"])
def test_components_of_chains(spark, shape, monkeypatch):
    """Chains of 200 links in every order take a number of tables that grows with the logarithm."""
    links, tables = _chains()[shape], []
    random.Random(1).shuffle(links)
    monkeypatch.setattr(C, "stage", lambda df, name: tables.append(name) or stage(df, name))
    got = {r.id: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == _reachable(links) and len(tables) <= 12
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \té\n", max_size=120))
def test_shingle_set_size(text):
    assert len(N.shingle_set(text)) == len(shingles(text))


def test_remove_repeats(spark, corpus):
    df = spark.createDataFrame([(i, t, "kept") for i, t in corpus], "doc_id long, text string, kept string").repartition(5)
    got = {r.id: (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in R.remove_repeats(df).collect()}
    assert got == removed(corpus)
    small = R.remove_repeats(df, hot=2, held=50)  # anchors become hot while runs still come
    assert {r.id: (r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in small.collect()} == got


@pytest.mark.parametrize(("hot", "held"), [(2000, 1 << 18), (5, 1 << 18), (5, 40), (0, 7)])
def test_resolve_streams(hot, held):
    """Every run but the first of its text is covered or let go with its hot anchor, in whatever parts the runs come."""
    rng = np.random.default_rng(3)
    runs = np.zeros(3000, R.RUN)
    runs["anchor"], runs["run"] = np.minimum(rng.geometric(0.05, 3000), 40), rng.integers(0, 30, 3000)
    runs["doc"], runs["n"] = rng.permutation(3000), 1
    parts = [pa.RecordBatch.from_pydict({"group": [0], "kind": pa.array([0], pa.int32()), "runs": [R.pack(x)]}) for x in np.array_split(runs, 60)]
    out = pa.Table.from_batches(list(R._resolve(iter(parts), hot, held))).to_pylist()
    texts = {(int(a), int(r)) for a, r in zip(runs["anchor"], runs["run"], strict=True)}
    over = {a for a in {a for a, _ in texts} if sum(x == a for x, _ in texts) > hot}
    assert {r["anchor"] for r in out if r["kind"] == R.HOT_RUNS} == over
    first = {}
    for a, r, d in zip(runs["anchor"].tolist(), runs["run"].tolist(), runs["doc"].tolist(), strict=True):
        first[a, r] = min(d, first.get((a, r), d))
    by = {d: (a, r) for a, r, d in zip(runs["anchor"].tolist(), runs["run"].tolist(), runs["doc"].tolist(), strict=True)}
    assert sorted(r["id"] for r in out if r["kind"] == R.RUNS) == sorted(d for (a, _), d in first.items() if a not in over and sum(x == a for x, _ in texts) > 1)
    assert all(first[by[r["id"]]] < r["id"] for r in out if r["kind"] == R.SPANS)
    assert len({r["id"] for r in out}) == len(out) == 3000 - sum(1 for (a, _) in first if a not in over and sum(x == a for x, _ in texts) == 1)


def test_runs_cover_every_window(corpus):
    module = R
    docs = [(i, t or "") for i, t in corpus]
    runs = module.runs_of(np.frombuffer("".join(t for _, t in docs).encode(), np.uint8), np.cumsum([len(t.encode()) for _, t in docs]), np.array([i for i, _ in docs]), np.zeros(len(docs), np.int64))
    assert runs["n"].max() <= module.WINDOWS and runs["n"].sum() == sum(max(0, len(t.encode()) - module.MATCH + 1) for _, t in docs)
    first, more = module.fold(runs)
    assert len(first) + len(more) == len(runs) and (module.unpack([module.pack(runs)]) == runs).all()


def test_workers_remember_one_operator(spark):
    """Workers live on between stages: the tasks of one operator drop what those of another remember, and keep their own."""
    docs = spark.createDataFrame([(i, f"some words number {i}", "en") for i in range(400)], "doc_id long, text string, lang string").repartition(8)

    def spaces(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": [sum(type(x) is languages.Space for x in gc.get_objects())]})

    languages.identify(docs, languages.learn(docs)).count()
    assert sum(r.n for r in docs.mapInArrow(spaces, "n long").collect()) > 0
    assert sum(r.n for r in docs.mapInArrow(released(spaces), "n long").collect()) == 0


def test_runs_take_little_memory():
    """Hashes of a slice of text are made in pieces, and its runs still leave together, those of long texts too."""
    rng = np.random.default_rng(8)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (3 * R.SLICE // 2, *[4000] * 400, 50)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    tracemalloc.start()
    rows = [r for b in R._dealt(iter([batch]), 4) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert len(rows) <= 4 * (1 + sum(map(len, texts)) // R.SLICE)
    windows = np.concatenate([np.arange(r["start"], r["start"] + int(r["n"])) + (int(r["doc"]) << 32) for r in R.unpack([x["runs"] for x in rows])])
    assert np.array_equal(np.sort(windows), np.concatenate([np.arange(max(0, len(t) - R.MATCH + 1)) + (i << 32) for i, t in enumerate(texts)]))


def test_remove_repeats_odd_tables(spark):
    assert R.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(2, "y" * 150), (None, "y" * 150), (2, "y" * 150), (3, None), (3, None)]
    got = sorted(str((r.id, r.n_bytes, r.n_removed)) for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(map(str, [(None, 150, 149), (2, 150, 150), (2, 150, 150), (3, 0, 0), (3, 0, 0)]))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab", min_size=10, max_size=120))
def test_longest_previous_factor(text):
    data = np.frombuffer(text.encode() + b"#" * 0, np.uint8)
    cap = 8
    positions = np.arange(max(0, len(data) - cap + 1))
    got = R.longest_previous_factor(data, positions, cap).tolist()

    def longest(i):
        best = 0
        for j in range(i):
            n = 0
            while n < cap and text[i + n] == text[j + n]:
                n += 1
            best = max(best, n)
        return best

    assert got == [longest(i) for i in positions]


def test_cuts_keep_replacement_characters(spark):
    """Texts that hold U+FFFD and cuts that go through characters, against plain Python."""
    rng = random.Random(6)
    say = lambda n: "".join(rng.choice("abcé😀\ufffd ") for _ in range(n))
    passage = say(90)
    texts = [passage + say(20), "x\ufffdy " + passage + " kept\ufffd", "é" * 120, "\u1ea9" + "é" * 120, "aé" * 60 + "\ufffd", "\u00a9" + passage[1:] + "😀", None, "\ufffd", passage]
    texts += ["\u4e2d" * 40, "\u4e2d" * 35 + "\u4e2e", "\u4e3d" * 40 + "\u4e2d" * 34]
    got = {r.doc_id: r.text for r in R.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = set()
        for o in range(len(b) - R.MATCH + 1):
            if b[o : o + R.MATCH] in seen:
                gone |= set(range(o, o + R.MATCH))
            seen.add(b[o : o + R.MATCH])
        at, left = 0, ""
        for c in t or "":
            width = len(c.encode())
            left += "" if gone & set(range(at, at + width)) else c
            at += width
        if left or not gone:
            want[i] = t if t is None else left
    assert got == want and "\ufffd" in got[1] and len(got) < len(texts)


@settings(max_examples=200, deadline=None)
@given(st.text("aé\u4e2d😀\ufffd", min_size=1, max_size=8), st.data())
def test_whole_characters(text, data):
    b = text.encode()
    start = data.draw(st.integers(0, len(b)))
    end = data.draw(st.integers(start, len(b)))
    inside, at = "", 0
    for c in text:
        inside += c if start <= at and at + len(c.encode()) <= end else ""
        at += len(c.encode())
    assert R.whole_characters(b[start:end], start == 0, end == len(b)) == inside.encode()

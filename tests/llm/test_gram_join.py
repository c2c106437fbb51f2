"""The n-gram join against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorframe.llm import gram_join as G

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(docs, percent=80):
    sets = {i: shingles(t) for i, t in docs}
    low, ids = {i: i for i in sets}, sorted(sets)
    for x in ids:
        for y in ids:
            a, b = sets[x], sets[y]
            if x < y and a and b and low[x] != low[y] and 100 * len(a & b) >= percent * len(a | b):
                old, new = max(low[x], low[y]), min(low[x], low[y])
                low |= {i: new for i in ids if low[i] == old}
    return {i: (len(sets[i]), low[i]) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    docs, passages = [], [" ".join(word() for _ in range(60)) for _ in range(3)]
    for i in range(120):
        text = " ".join(word() for _ in range(rng.randint(1, 150)))
        docs.append((i, text + " " + rng.choice(passages) if i % 3 == 0 else text))
    base = docs[1][1] + " " + passages[0]
    for i in range(120, 260):  # one family, some below the threshold
        w = base.split()
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join(w).upper() if i % 9 == 0 else " ".join(w)))
    docs += [(300 + i, docs[5][1]) for i in range(90)]
    docs += [(400, None), (401, ""), (402, "  \t\n"), (403, "a b"), (404, "A  B"), (405, "a b c d e"), (406, "x" * 500), (407, "é" * 700), (408, "\x1fa\x1f b"), (409, "ab" * 400)]
    docs += [(420 + i, " ".join(map(str, range(n)))) for i, n in enumerate((7, 8, 8, 9, 10, 11, 12))]  # 4 of 5 shingles and the like
    docs.append((500, " ".join(word() for _ in range(6000))))
    docs.append((501, docs[-1][1][1000:]))
    return docs


@pytest.mark.parametrize("small", [False, True])
def test_join(spark, corpus, small, monkeypatch):
    if small:  # many chunks, buckets, blocks and frequent shingles
        for name, x in (("CHUNK", 37), ("CHUNK_BYTES", 20_000), ("BUCKET_BYTES", 9_000), ("OFTEN", 2), ("BLOCK", 12), ("PILOTS", 3)):
            monkeypatch.setattr(G, name, x)
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in corpus], "doc_id long, text string, n int, component_id string, keys string").repartition(5)
    assert {r.id: (r.n_shingles, r.component_id) for r in G.gram_join(df).collect()} == classes(corpus)
    if small:
        assert {r.id: (r.n_shingles, r.component_id) for r in G.gram_join(df, percent=55).collect()} == classes(corpus, 55)


def test_join_of_one_template(spark, monkeypatch):
    """Texts share a template (likeness 0.69); each is linked to one other (0.81) only: one cluster of many components."""
    monkeypatch.setattr(G, "BLOCK", 40)
    words = lambda name, n: " ".join(f"{name}x{k}" for k in range(n))
    docs = [(i, " ".join([words("t", 104), words(f"p{i // 2}", 8), words(f"d{i}", 11)])) for i in range(300)]
    got = {r.id: r.component_id for r in G.gram_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: i // 2 * 2 for i in range(300)} == {i: x[1] for i, x in classes(docs).items()}


def test_odd_tables(spark):
    assert G.gram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q"), (2, "a b c d e f"), (None, "z"), (None, "z"), (None, "q"), (4, None), (None, None)]
    got = sorted(map(str, map(tuple, G.gram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    assert got == sorted(map(str, [(1, 2, 1), (1, 2, 1), (2, 2, 1), (1, 1, 1), (None, 1, 1), (None, 1, None), (None, 1, None), (4, 0, 4), (None, 0, None)]))
    assert G.gram_join(spark.createDataFrame([(1,)], "doc_id long")).first().n_shingles == 0


SETS = st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=12)


@settings(max_examples=150, deadline=None)
@given(SETS, SETS, st.lists(st.integers(0, 5), min_size=24, max_size=24), st.integers(30, 100), st.integers(0, 2))
def test_links(left, right, extra, percent, labels):
    """Links span the components of brute force: within one side and across two, with unique shingles that aren't stored and with labels given."""
    arrays = lambda sets: [np.array(sorted(x), np.uint64) for x in sets]
    sizes = lambda sets, e: np.array([len(x) + y for x, y in zip(sets, e, strict=False)])
    linked = lambda a, n, b, m: 100 * len(a & b) >= percent * (n + m - len(a & b))

    def spanned(labels, pairs):
        low = dict(enumerate(labels))
        for a, b in pairs:
            x, y = low[a], low[b]
            low = {k: x if v == y else v for k, v in low.items()}
        return {frozenset(k for k in low if low[k] == v) for v in low.values()}

    n, m = sizes(left, extra), sizes(right, extra[12:])
    start = np.arange(len(left)) // (labels + 1)
    want = [(i, j) for i in range(len(left)) for j in range(i) if linked(left[i], n[i], left[j], n[j])]
    assert spanned(start, G.links_of(arrays(left), n, None, n, start, start, percent)) == spanned(start, want)
    both = np.concatenate([np.arange(len(left)), 100 + np.arange(len(right)) // (labels + 1)])
    want = [(i, len(left) + j) for i in range(len(left)) for j in range(len(right)) if linked(left[i], n[i], right[j], m[j])]
    got = G.links_of(arrays(left), n, arrays(right), m, both[: len(left)], both[len(left) :], percent)
    assert spanned(both, [(i, len(left) + j) for i, j in got]) == spanned(both, want)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=40))
def test_packed(values):
    x = np.array(sorted(values), np.uint64)
    assert (G.unpacked(G.packed(x), np.uint64) == x).all()

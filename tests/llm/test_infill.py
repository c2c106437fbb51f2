"""Fill-in-middle against plain Python."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorframe.llm.infill import Lanes, fill_in_middle, line_widths, restored

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def plain(i, text, transformed=100, suffix_first=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= transformed:
        return n, "plain", None, None, text, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < suffix_first else "psm"
    return n, form, len(x), len(y), f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}", text


@given(st.lists(st.integers(0, 50), max_size=300))
def test_every_rank_is_reached(widths):
    lanes = Lanes(np.array(widths, np.int64))
    assert [lanes.reach(k) for k in range(len(widths) + 1)] == [sum(widths[:k]) for k in range(len(widths) + 1)]


def test_lanes_are_short():
    lanes = Lanes(np.ones(100_000, np.int64))
    assert 6 < len(lanes.lanes) < 14 and max(len(units) for units, _, _ in lanes.lanes[-1:]) <= 4


@given(st.text("a\n\r\u2028é", max_size=30))
def test_units(text):
    assert line_widths(text).tolist() == [len(x) for x in UNIT.findall(text)]


def test_rows(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "one\ntwo", "é😀\n\r\n\x85x\u2028y", "has <P> mark\nx", "<M>", "a<S>b\n", "<p>\n<s>", "line\n" * 50_000, "w" * 3_000_000 + "\nend", "tail $1 \\E\n(x"]
    rows = [(k, x) for k, x in enumerate(texts)] + [(k + 100, "".join(rng.choice("ab\né ") for _ in range(rng.randint(0, 80)))) for k in range(200)]
    rows += [(None, "null\nid\n"), (None, None), (3, "again\nthree\n"), (-5, "minus\nfive"), (3, "again\nthree\n")]
    df = spark.createDataFrame([(i, t, "o", 1, 2) for i, t in rows], "doc_id long, text string, output string, id long, h1 long").repartition(5)
    for transformed, suffix_first in ((100, 50), (60, 20)):
        got = fill_in_middle(df, transformed=transformed, suffix_first=suffix_first).withColumn("restored", restored(F.col("output"), F.col("form"))).collect()
        want = [(i, *plain(i, t, transformed, suffix_first)) for i, t in rows]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fill_in_middle(df.limit(0)).count() == 0
    assert {r.form for r in fill_in_middle(df).collect()} == {"plain", "psm", "spm"}

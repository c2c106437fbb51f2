"""Operators that work row by row: media, BPE, token files, languages, toxicity."""

import base64
import gzip
import hashlib
import io
import random
import struct
import zipfile
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorframe.llm import byte_bpe, languages, media, token_files, toxicity

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
TEXTS = ["Hello world", None, "", " \n\t x y  ", "don't'll 12½ é漢字😀\x85", "a" * 3000, "ab" * 70, "\x1c\x1dZ", "Hello world", " " * 300, "<|endoftext|> a <|startoftext|>b", "ΟΔΟΣ İ ǅ"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)


@pytest.fixture(scope="module")
def bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return byte_bpe.Bpe(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", zlib.compress(b"x")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
BMP = b"BM" + struct.pack("<IIIIiiHHI", 58, 0, 54, 40, 1, 1, 1, 24, 0) + b"\0" * 24


def pdf(note=b""):
    body = b"%PDF-1.4\n1 0 obj\n<< >>\nendobj\n" + note + b"\n"
    return body + b"xref\n0 1\ntrailer\n<< >>\nstartxref\n%d\n%%%%EOF" % len(body)


def crc(data, poly, bits):
    out = 0
    for x in data:
        out ^= x << (bits - 8)
        for _ in range(8):
            out = (out << 1 ^ (poly if out >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
    return out


def flac(frames=200, total=None):
    """Frames of 192 equal samples, 16 bits, mono."""
    total = 192 * frames if total is None else total
    info = struct.pack(">HH", 192, 192) + b"\0" * 6 + (44100 << 44 | 15 << 36 | total).to_bytes(8, "big") + b"\0" * 16
    out = b"fLaC\0\0\0\x22" + info + b"\x81\0\0\x04note"
    for i in range(frames):
        head = b"\xff\xf8\x19\x08" + chr(i).encode()
        head += bytes([crc(head, 7, 8)])
        body = head + b"\0" + struct.pack(">h", i)
        out += body + struct.pack(">H", crc(body, 0x8005, 16))
    return out


def riff(form, *chunks):
    body = form + b"".join(n + struct.pack("<I", len(d)) + d + b"\0" * (len(d) & 1) for n, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(name, data=b""):
    return struct.pack(">I", 8 + len(data)) + name + data


def ogg(*flags):
    return b"".join(b"OggS\0" + bytes([f]) + struct.pack("<QIII", i, 7, i, 0) + b"\x02\x03\x01" + b"abcd" for i, f in enumerate(flags))


def tiff(order):
    entry = lambda tag, kind, n, v: struct.pack(order + "HHII", tag, kind, n, v)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, 3) + entry(256, 4, 1, 2) + entry(273, 4, 1, 60) + entry(279, 4, 1, 6) + struct.pack(order + "I", 0) + b"\0" * 10 + b"pixels"


JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xe1\0\x06\xff\xd8\xff\xd9\xff\xda\0\x08\x01\x01\0\0\x3f\0\x12\xff\0\x34\xff\xd9"
MP3 = b"ID3\x04\0\0\0\0\0\x05notes" + (b"\xff\xfb\x90\0" + b"\0" * 413) * 3
WEBM = b"\x1a\x45\xdf\xa3\x87\x42\x82\x84webm\x18\x53\x80\x67\x40\x05hello"
MORE = [
    ("application/pdf", pdf()), ("audio/flac", flac()), ("audio/flac", flac(3, 0)), ("image/jpeg", JPEG), ("image/webp", riff(b"WEBP", (b"VP8L", b"abc"))), ("video/x-msvideo", riff(b"AVI ", (b"LIST", b"hdrl"))),
    ("video/mp4", box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", b"x" * 9) + box(b"mdat", b"y" * 5)), ("application/ogg", ogg(2, 0, 4)), ("image/tiff", tiff("<")), ("image/tiff", tiff(">")), ("audio/mpeg", MP3), ("video/x-matroska", WEBM),
]


@pytest.mark.parametrize("kind, data", MORE)
def test_more_formats_are_found_carved_and_checked(kind, data):
    assert media.sniff(data) == (kind, [])
    whole, inside = media.sniff(b"some text " + data + b" more " + data)
    assert inside == [(10, len(data), kind), (16 + len(data), len(data), kind)]
    assert media.sniff(data[: len(data) // 2])[0] != kind and not media.sniff(b"some text " + data[: len(data) // 2])[1]


def test_lengths_that_disagree_are_no_media():
    broken = flac(5)
    assert media.sniff(flac(5, 192 * 6))[0] != "audio/flac" and media.sniff(broken[:63] + b"\0" + broken[64:])[0] != "audio/flac" and media.sniff(broken[:-1] + b"\0")[0] != "audio/flac"
    assert media.sniff(box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", b"y"))[0] != "video/mp4" and media.sniff(ogg(2, 0, 0))[0] != "application/ogg"
    assert media.sniff(MP3[:20])[0] != "audio/mpeg" and media.sniff(tiff("<")[:-1])[0] != "image/tiff" and media.sniff(riff(b"WEBP", (b"ICCP", b"")))[0] != "image/webp"
    nested = pdf(pdf(b"inner"))
    assert media.sniff(b"x " + nested)[1] == [(2, len(nested), "application/pdf")]


@pytest.mark.parametrize("kind, data", [("image/png", png()), ("image/gif", GIF), ("image/bmp", BMP), ("audio/wav", media.wav_of(b"\x80" * 9)), ("application/zip", zipped()), ("application/gzip", gzip.compress(b"hello" * 50)), ("application/pdf", b"%PDF-1.4 ... startxref\n9\n%%EOF")])
def test_formats_are_found_carved_and_checked(kind, data):
    assert media.sniff(data) == (kind, [])
    whole, inside = media.sniff(b"some text " + data + b" more")
    assert inside == [(10, len(data), kind)]
    assert media.sniff(data[: len(data) // 2])[0] != kind


def test_chance_hits_are_no_media():
    assert media.sniff(b"BM GIF89a RIFF PK\x03\x04 %PDF- fLaC ID3 OggS ftyp isom MM II*") == ("text/plain", [])
    assert media.sniff(b"\xff\xfe") == ("application/octet-stream", []) and media.sniff(b"") == ("empty", [])


def test_text_media(spark, docs):
    stored = media.sniff_media(media.store_text_media(docs))
    got = {r.doc_id: r for r in media.read_media(stored).collect()}
    for i, t in enumerate(TEXTS):
        b = (t or "").encode()
        b += b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-32:]))
        assert r.media_type == "audio/wav" and r.type_was_wrong
    assert got[0].feature == got[8].feature and got[1].media_sha256 == got[2].media_sha256
    assert media.store_text_media(docs.limit(0)).count() == 0


def test_sniff_declared_types(spark):
    df = spark.createDataFrame([(1, bytearray(png()), "image/png", 5), (2, bytearray(png()), "text/html", 5), (3, None, None, 5)], "id long, media binary, declared_type string, embedded int")
    got = {r.id: (r.media_type, r.type_was_wrong, r.embedded) for r in media.sniff_media(df).collect()}
    assert got == {1: ("image/png", False, []), 2: ("image/png", True, []), 3: ("empty", False, [])}


def test_bpe_matches_the_library(spark, docs, bpe):
    _, library = bpe
    back = byte_bpe.decode(byte_bpe.encode(docs, ranks_path=RANKS), ranks_path=RANKS)
    for r in back.collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(TEXTS[r.doc_id] or "") and bytes(r.decoded).decode() == (TEXTS[r.doc_id] or "")
    assert byte_bpe.token_digest(docs.limit(0), ranks_path=RANKS).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdefg ehtn'\n")), max_size=80))
def test_bpe_any_text(bpe, text):
    own, library = bpe
    ids = own.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text) and own.decode(ids).decode() == text


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, tokenizer_path=WORDS, end_id=1)
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.id)
    start = 0
    for i, r in enumerate(rows):
        ids = t.encode(TEXTS[i] or "", add_special_tokens=False).ids + [1]
        assert (r.id, r.start, r.n_tokens) == (i, start, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        start += len(ids)


def test_token_files_trained_dictionary_and_damage(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randint(0, 50)) for _ in range(80))) for i in range(600)] + [(None, "x"), (5, "again")]
    path = f"file://{tmp_path}/tokens"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert token_files.write_tokens(df, path, tokenizer_path=WORDS, end_id=1)
    got = token_files.read_tokens(spark, path).collect()
    assert len(got) == 602 and sorted(got, key=lambda r: r.start)[0].id is None
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "dict_sha256 string, dictionary binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        token_files.read_tokens(spark, path)
    empty = f"file://{tmp_path}/empty"
    token_files.write_tokens(df.limit(0), empty, tokenizer_path=WORDS, end_id=1)
    assert token_files.read_tokens(spark, empty).count() == 0


def test_token_files_read_back_in_place(spark, docs, tmp_path):
    """Frames aren't shuffled to meet their starts, also where shards look too large to broadcast."""
    path = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, path, tokenizer_path=WORDS, end_id=1)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = token_files.read_tokens(spark, path)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert out.count() == len(TEXTS)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_token_files_look_up(spark, tmp_path, monkeypatch):
    """A look-up decompresses the frames of the wanted documents and no others."""
    rows = [(i, f"text number {i} " * 3) for i in range(50)] + [(None, "none"), (7, "seven again"), (8, None)]
    path = f"file://{tmp_path}/tokens"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    token_files.write_tokens(df, path, tokenizer_path=WORDS, end_id=1)
    whole = token_files.read_tokens(spark, path).collect()
    wanted = [7, None, 31, 999]
    got = token_files.read_documents(spark, path, wanted).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in whole if r.id in (7, None, 31)) and len(got) == 4
    assert token_files.read_documents(spark, path, []).count() == 0 and token_files.read_documents(spark, path, [None]).count() == 1
    # Damage every frame but the wanted document's: its look-up still works, reading all doesn't
    shards = spark.read.parquet(f"{path}/shards").collect()
    hurt = []
    for r in shards:
        index, frames = np.frombuffer(bytes(r["index"]), "<i8").reshape(-1, 4), bytearray(r.frames)
        ends = [*index[1:, 2].tolist(), len(frames)]
        for (i, _, a, _), b in zip(index.tolist(), ends, strict=True):
            if i != 31:
                frames[a:b] = b"\0" * (b - a)
        hurt.append((*[r[c] for c in r.__fields__ if c != "frames"], frames))
    names = [c for c in shards[0].__fields__ if c != "frames"] + ["frames"]
    schema = spark.read.parquet(f"{path}/shards").select(*names).schema
    other = f"file://{tmp_path}/hurt"
    spark.createDataFrame(hurt, schema).write.parquet(f"{other}/shards")
    spark.read.parquet(f"{path}/dictionary").write.parquet(f"{other}/dictionary")
    assert [r.ids for r in token_files.read_documents(spark, other, [31]).collect()] == [r.ids for r in whole if r.id == 31]
    with pytest.raises(Exception):
        token_files.read_tokens(spark, other).collect()


@pytest.fixture(scope="module")
def chunked():
    from tokenizers import Tokenizer

    return token_files.ChunkEncoder(WORDS), Tokenizer.from_file(WORDS)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abH.,' \n\u0331\u0301Éé<|>ΣİK")), max_size=60))
def test_chunks_any_text(chunked, text):
    own, library = chunked
    for t in (text, text + "<|EndOfText|>. A", "<|endoftext|>" + text):
        assert np.frombuffer(own.encode(pa.array([t]), 1)[0], "<u2").tolist() == library.encode(t, add_special_tokens=False).ids + [1]


def test_languages(spark):
    rng = random.Random(5)
    parts = {"aa": ["lo", "mi", "ta", "re"], "bb": ["sch", "über", "cht", "ung"], "cc": ["ção", "que", "inho", "ar"]}
    say = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(30))
    rows = [(i, say(k), k) for i, k in enumerate(rng.choice("abc") * 2 for _ in range(150))] + [(900, None, "aa"), (901, "12 !?", "bb"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    prototypes = languages.learn(df.filter("doc_id < 100").select("text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in languages.identify(df, prototypes).collect()}
    assert all(got[i][0] == k for i, _, k in rows[100:150]) and got[900] == got[901] == got[902] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in languages.identify(df, {}).collect()} == {"und"} and languages.learn(df.limit(0).select("text", "lang")) == {}


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["er", "on", "th", "an", "re", "in"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(600):
        w = [word() for _ in range(60)]
        if i % 5 == 0:
            w[rng.randrange(60)] = rng.choice(["blurgh", "zonk"])
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.fit(df.filter("doc_id < 400").withColumnRenamed("doc_id", "id"), bits=16)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(got[i], y) for i, _, y in rows[400:]]
    assert all(s >= 0.7 for s, y in held if y) and sum(s >= 0.7 for s, y in held if not y) <= 4
    odd = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert len({r.score for r in toxicity.score(odd, model).collect()}) == 1
    none = toxicity.fit(df.filter("label = 0").withColumnRenamed("doc_id", "id"), bits=16)
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_ratios(spark):
    """Log-count ratios against a count in plain Python, repeated labels and clashing columns included."""
    rng = random.Random(9)
    rows = [(i % 180, " ".join(rng.choice(["abc", "xyz", "mno"] if i % 3 else ["abc", "qqq"]) for _ in range(6)), int(i % 3 == 0), 0.5) for i in range(200)] + [(500, None, 0, 0.5), (501, "", 1, 0.5)]
    df = spark.createDataFrame(rows, "id long, text string, label int, score double").repartition(3)
    got, n = toxicity.log_count_ratios(df.select("text", "label"), 12)
    mark, counts = np.zeros(1 << 12, bool), np.zeros((2, 1 << 12))
    texts = [sum(r[2] == 0 for r in rows), sum(r[2] == 1 for r in rows)]
    for _, text, label, _ in rows:
        counts[label][toxicity.feature_ids(text, mark)] += 1
    share = [(counts[k] + texts[k] / sum(texts)) / (texts[k] + 1) for k in (0, 1)]
    want = np.log(share[1] / share[0])
    want[np.abs(want) < toxicity.MIN_Z * np.sqrt(1 / (counts[0] + 0.5) + 1 / (counts[1] + 0.5))] = 0
    assert list(n) == texts and np.allclose(got, want) and (got > 0).any() and (got < 0).any()
    for most in (10, 60, 500):
        for label in (0, 1):
            some = toxicity.first_by_hash(df, label, texts[label], most)
            whole = df.filter(f"label = {label}").orderBy(F.xxhash64("id"), "id").limit(most)
            assert sorted(r.id for r in some.collect()) == sorted(r.id for r in whole.collect())
    assert toxicity.fit(df, bits=12).weights.any()


def test_pdf_and_gzip_by_brute_force():
    """Lengths against a search of all end marks and a whole inflation; false starts don't cost the rest of the payload each."""
    import re
    import time
    import zlib

    def pdf(b, at):
        if not b[at + 5 : at + 6].isdigit():
            return None
        ends = [(m.start(), m.end(), at + int(m[1][:15])) for m in re.finditer(rb"startxref\s+(\d+)\s+%%EOF", b) if m.start() >= at]
        following, last = b.find(b"%PDF-", at + 5), at
        for start, end, table in ends:
            if last <= table < start and re.compile(rb"xref|\d+\s+\d+\s+obj").match(b, table):
                last = end
        near = [end for start, end, table in ends if table < start and (following < 0 or end <= following)]
        return last - at if last > at else near[-1] - at if near else None

    rng = random.Random(9)
    for _ in range(300):
        b = b"".join(rng.choice([b"%PDF-1.4\n", b"%PDF-", b"xref\n", b"1 0 obj\n", b"filler", f"startxref\n{rng.randint(0, 120)}\n%%EOF".encode(), b"startxref 999999 %%EOF"]) for _ in range(rng.randint(1, 14)))
        for at in [m.start() for m in re.finditer(b"%PDF-", b)]:
            assert media._pdf(b, at) == pdf(b, at)
    body = bytes(rng.randrange(256) for _ in range(200_000))
    packed = zlib.compressobj(wbits=31)
    packed = packed.compress(body) + packed.flush()
    empty = zlib.compressobj(wbits=31).flush()
    assert media._gzip(b"xx" + packed + b"behind", 2) == len(packed) and media._gzip(packed[:-1], 0) is None and media._gzip(packed[:-5] + b"\0" + packed[-4:], 0) is None
    assert media._gzip(empty, 0) == len(empty) and media._gzip(b"\x1f\x8b\x08", 0) is None
    zeros = zlib.compressobj(9, wbits=31)
    zeros = zeros.compress(bytes(1 << 20)) + zeros.flush()
    assert media._gzip(zeros + b"\0" * 5, 0) == len(zeros)
    start = time.perf_counter()
    for b in (b"%PDF-" * 100_000, b"%PDF-1" * 100_000, b"%PDF-1" * 10_000 + b"startxref 99999999 %%EOF" * 10_000, b"\x1f\x8b\x08" * 100_000):
        assert media.sniff(b)[1] == []
    assert time.perf_counter() - start < 30


def test_toxicity_weights_by_brute_force():
    """Factors of the places with a ratio equal those of a fit over every place."""
    rng = np.random.default_rng(3)
    size, ids = 64, [np.flatnonzero(rng.random(64) < 0.3) for _ in range(80)]
    y = (rng.random(80) < 0.4).astype(np.float32)
    ratios = np.where(rng.random(size) < 0.5, rng.normal(size=size), 0).astype(np.float32)
    x = np.zeros((80, size))
    for k, own in enumerate(ids):
        x[k, own] = 1
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    f, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, 61):
        d = (1 / (1 + np.exp(-(x @ (f * ratios) + b))) - y) * each
        g = (x.T @ d) * ratios + 1e-3 * f
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * d.sum(), 0.99 * vb + 0.01 * d.sum() ** 2
        f -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        b -= 0.03 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    factor, bias, used = toxicity.adam(ids, y, ratios, 1e-3, 60)
    dense = np.zeros(size)
    dense[used] = factor
    assert np.abs(dense - f).max() < 1e-3 and abs(bias - b) < 1e-3 and np.abs(f).max() > 0.1
    mark = np.zeros(1 << 14, bool)
    text = "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 5000))
    assert (toxicity.feature_ids(text[:900], mark) == toxicity.feature_ids(text[:900], np.zeros(1 << 14, bool))).all() and not mark.any()
    both = [np.concatenate([toxicity.feature_ids(text, np.zeros(1 << bits, bool))]) for bits in (14, 17)]
    assert (np.unique(both[1] >> 3) == both[0]).all()  # sorted places and marks give one set

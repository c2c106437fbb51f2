"""Media columns: signature sniffing over binary payloads.

One Aho-Corasick automaton locates the magic bytes of every known format in one pass over a payload. A validator of the format then
confirms structure and lengths from the bytes that follow, so a chance hit inside text or pixels is not media. A
confirmed format at offset 0 gives the detected type and corrects the declared one; confirmed formats further in are
carved out as embedded media with their offset and length. Payloads that no format claims keep the type text or binary.

Each row is worked on alone inside Arrow batches: nothing is shuffled, and memory is bounded by a batch. A lost
executor costs the repetition of its tasks.

Defined results: a null payload is treated as empty and of type `empty`; a null declared type counts as wrong unless there is no
payload; repeated rows each get the same result; an empty table gives an empty result; columns of the input whose
names clash with the result's are left out, the others are kept.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import column_or_null, released, ship, table

#: Samples are stored in frames of this many bytes.
FRAME = 576
RATE = 8000
#: Bytes of a name or comment in a gzip header.
GZIP_NAME = 4096


def _riff(form: bytes, needed: tuple[bytes, ...], any_of: tuple[bytes, ...] = ()) -> Callable[[bytes, int], int | None]:
    """Validator of a RIFF form: all chunks inside the RIFF size, the needed ones in their order, and one of `any_of` where given."""

    def check(b: bytes, at: int) -> int | None:
        if len(b) - at < 12 or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        pos, seen = at + 12, []
        while pos + 8 <= end:
            name, n = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
            if pos + 8 + n > end or name == b"fmt " and n < 16:
                return None
            seen.append(name)
            pos += 8 + n + (n & 1)
        order = [seen.index(x) for x in needed if x in seen]
        whole = len(order) == len(needed) and order == sorted(order) and (not any_of or any(x in seen for x in any_of))
        return end - at if whole else None

    return check


def _png(b: bytes, at: int) -> int | None:
    """Length of a PNG at `at`: IHDR first, every chunk's CRC right, IEND last."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        n, name = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        if pos + 12 + n > len(b) or first and name != b"IHDR" or zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if name == b"IEND":
            return pos - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    """Length of a GIF at `at`: walks colour tables, extensions and image blocks to the trailer."""
    if len(b) - at < 14:
        return None
    flags, pos = b[at + 10], at + 13
    pos += 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1 - at
        if kind == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            pos += 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)
        elif kind == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    """Length of a JPEG at `at`: marker segments with lengths, then scan data up to the end marker."""
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark, n = b[pos + 1], struct.unpack_from(">H", b, pos + 2)[0]
        if mark < 0xC0 or n < 2 or pos + 2 + n > len(b):
            return None
        pos += 2 + n
        if mark == 0xDA:
            end = b.find(b"\xff\xd9", pos)
            return end + 2 - at if end >= 0 else None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    """Length of a BMP at `at`: file size, pixel offset and header size must agree."""
    if len(b) - at < 30:
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + 26)[0]
    return size if zero == 0 and header in (40, 108, 124) and planes == 1 and 14 + header <= offset <= size <= len(b) - at else None


def _zip(b: bytes, at: int) -> int | None:
    """Length of a zip archive at `at`: local header sane and an end record whose directory offset and size fit."""
    if len(b) - at < 52 or struct.unpack_from("<H", b, at + 4)[0] > 63:
        return None
    end = b.find(b"PK\x05\x06", at)
    while end >= 0 and end + 22 <= len(b):
        n, start, note = struct.unpack_from("<IIH", b, end + 12)
        if at + start + n == end and end + 22 + note <= len(b):
            return end + 22 + note - at
        end = b.find(b"PK\x05\x06", end + 4)
    return None


def _gzip(b: bytes, at: int) -> int | None:
    """Length of a gzip member at `at`: it must inflate, with the right CRC. Input goes in parts, so that a false start costs what it inflates; name and comment have GZIP_NAME bytes at most."""
    flags, pos = b[at + 3 : at + 4] or b"\xff", at + 10
    if flags[0] & 0xE0:
        return None
    if flags[0] & 4:
        pos += 2 + int.from_bytes(b[pos : pos + 2], "little")
    for bit in (8, 16):
        if flags[0] & bit:
            pos = b.find(b"\0", pos, pos + GZIP_NAME) + 1
            if not pos:
                return None
    part, view, pos = 1 << 16, memoryview(b), at
    try:
        d = zlib.decompressobj(31)
        while not d.eof and pos < len(b):
            rest = d.decompress(view[pos : pos + part], part)
            pos = min(pos + part, len(b))
            while not d.eof and (d.unconsumed_tail or len(rest) == part):
                rest = d.decompress(d.unconsumed_tail, part)
    except zlib.error:
        return None
    return pos - len(d.unused_data) - at if d.eof else None


_PDF_END = re.compile(rb"startxref\s+(\d+)\s+%%EOF")
_PDF_TABLE = re.compile(rb"xref|\d+\s+\d+\s+obj")


@lru_cache(maxsize=1)
def _pdf_ends(b: bytes) -> tuple[list[int], list[tuple[int, int, int]], list[int]]:
    """Of a payload, once: starts of end marks, (start, end, offset) of each, and from each on the furthest that a PDF can begin for one of the offsets to lie before its mark."""
    ends = [(m.start(), m.end(), int(m[1][:15])) for m in _PDF_END.finditer(b)]
    reach = list(accumulate((start - offset for start, _, offset in reversed(ends)), max))[::-1]
    return [e[0] for e in ends], ends, reach


def _pdf(b: bytes, at: int) -> int | None:
    """Length of a PDF at `at`: version digits, and the last end mark whose startxref points, counted from `at`, to a cross-reference table or stream.

    Where none does (readers rebuild such tables), the last end mark before the next PDF whose offset lies inside the file.
    """
    if not b[at + 5 : at + 6].isdigit():
        return None
    starts, marks, reach = _pdf_ends(b)
    k = bisect_left(starts, at)
    if k == len(marks) or reach[k] <= at:  # no offset lies before its mark
        return None
    ends = [(start, end, at + offset) for start, end, offset in islice(marks, k, None)]
    following = b.find(b"%PDF-", at + 5)
    last = at
    for start, end, table in ends:
        if last <= table < start and _PDF_TABLE.match(b, table):  # an update is appended with a table of its own
            last = end
    near = [end for start, end, table in ends if table < start and (following < 0 or end <= following)]
    return last - at if last > at else near[-1] - at if near else None


def _crc_table(poly: int, bits: int) -> list[int]:
    """What a byte shifted out of the top of a CRC adds to it."""
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly if x & top else x << 1) & mask
        out.append(x)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(b: bytes, at: int) -> tuple[int, int, int] | None:
    """Of a FLAC frame header at `at` with the right CRC: where it ends, the frame's samples and its number."""
    h = b[at : at + 17].ljust(17, b"\0")
    size, rate, ones = h[2] >> 4, h[2] & 15, 8 - (~h[4] & 255).bit_length()
    if h[0] != 0xFF or h[1] & 0xFE != 0xF8 or not size or rate == 15 or h[3] >> 4 > 10 or h[3] & 1 or ones in (1, 8):
        return None
    number, pos = h[4] & (255 >> ones), 5
    for _ in range(ones - 1):
        if h[pos] & 0xC0 != 0x80:
            return None
        number, pos = number << 6 | h[pos] & 0x3F, pos + 1
    samples = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8) if size > 7 else 0
    if not samples:
        samples = int.from_bytes(h[pos : pos + size - 5], "big") + 1
        pos += size - 5
    pos += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in h[:pos]:
        crc = CRC8[crc ^ x]
    return (at + pos + 1, samples, number) if crc == h[pos] and at + pos < len(b) else None


def _flac(b: bytes, at: int) -> int | None:
    """Length of a FLAC stream at `at`: STREAMINFO of 34 bytes first, metadata blocks inside, then frames with ascending numbers up to the
    number of samples that STREAMINFO names (0: to the last frame). Headers are checked by their CRC, frame bodies are not, but for the last. That one ends where its CRC does: at the payload's end if it fits there, else where it first fits."""
    pos, first, last = at + 4, True, False
    while not last:
        if pos + 4 > len(b):
            return None
        n = int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (b[pos] & 127 or n != 34) or pos + 4 + n > len(b):
            return None
        last, pos, first = bool(b[pos] & 128), pos + 4 + n, False
    info = b[at + 8 : at + 42]
    least, total, done = int.from_bytes(info[4:7], "big"), int.from_bytes(info[10:18], "big") & ((1 << 36) - 1), 0
    while True:
        head = _flac_frame(b, pos)
        if head is None:
            return None
        body, samples, number = head
        done += samples
        following = -1
        if not total or done < total:
            sync, expected = b[pos : pos + 2], number + (samples if b[pos + 1] & 1 else 1)
            following = b.find(sync, body)
            while following >= 0 and ((found := _flac_frame(b, following)) is None or found[2] != expected):
                following = b.find(sync, following + 1)
        if following < 0:
            break
        pos = following
    if total and done < total:
        return None
    crc, ends = 0, 0
    for i in range(pos, len(b)):
        crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ b[i]]
        if not crc and not ends and i + 1 - pos >= max(least, body + 3 - pos):
            ends = i + 1
    ends = ends if crc else len(b)
    return ends - at if ends >= body + 3 else None


#: Boxes that stand at the top level of an ISO media file.
_BOXES = {b"ftyp", b"styp", b"moov", b"moof", b"mdat", b"free", b"skip", b"wide", b"uuid", b"meta", b"mfra", b"sidx", b"pdin", b"emsg", b"prft"}


def _mp4(b: bytes, at: int) -> int | None:
    """Length of an ISO media file at `at`: known boxes one behind the other, among them a movie or a movie fragment."""
    pos, seen = at, set()
    while pos + 8 <= len(b) and b[pos + 4 : pos + 8] in _BOXES:
        name, n, least = b[pos + 4 : pos + 8], struct.unpack_from(">I", b, pos)[0], 8
        if n == 1:
            if pos + 16 > len(b):
                return None
            n, least = struct.unpack_from(">Q", b, pos + 8)[0], 16
        n = n or len(b) - pos
        if n < least or pos + n > len(b) or name == b"ftyp" and (seen or n < 16):
            return None
        seen.add(name)
        pos += n
    return pos - at if seen & {b"moov", b"moof"} else None


def _ogg(b: bytes, at: int) -> int | None:
    """Length of an Ogg stream at `at`: pages one behind the other, each logical stream from its first page in sequence to its last."""
    pos, sequence, open_ = at, {}, set()
    while pos + 27 <= len(b) and b[pos : pos + 5] == b"OggS\0":
        flags, (serial, page), segments = b[pos + 5], struct.unpack_from("<II", b, pos + 14), b[pos + 26]
        end = pos + 27 + segments + sum(b[pos + 27 : pos + 27 + segments])
        if end > len(b) or bool(flags & 2) == (serial in sequence) or page != sequence.get(serial, page - 1) + 1:
            return None
        sequence[serial] = page
        open_.add(serial)
        if flags & 4:
            open_.remove(serial)
        pos = end
        if not open_:
            return pos - at
    return None


#: Bytes of a TIFF value by its type, from 1.
_TIFF_SIZES = (1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)


def _tiff(b: bytes, at: int) -> int | None:
    """Length of a TIFF at `at`: the furthest end of its directories, their values, strips and tiles, all inside the payload; each directory names a width."""
    order = "<" if b[at : at + 1] == b"I" else ">"
    if len(b) - at < 8:
        return None
    seen, end, where = set(), 8, struct.unpack_from(order + "I", b, at + 4)[0]
    while where:
        if where in seen or where < 8 or at + where + 6 > len(b):
            return None
        seen.add(where)
        n = struct.unpack_from(order + "H", b, at + where)[0]
        stop = where + 6 + 12 * n
        if not n or at + stop > len(b):
            return None
        end, lists = max(end, stop), {}
        for k in range(n):
            slot = where + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", b, at + slot)
            if not 1 <= kind <= 12:
                return None
            size = _TIFF_SIZES[kind - 1] * count
            start = slot + 8 if size <= 4 else struct.unpack_from(order + "I", b, at + slot + 8)[0]
            if at + start + size > len(b):
                return None
            end = max(end, start + size)
            if tag in (273, 279, 324, 325) and kind in (3, 4):
                lists[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", b, at + start)
            elif tag == 256:
                lists[tag] = ()
        if 256 not in lists:
            return None
        for offsets, sizes in ((273, 279), (324, 325)):
            for start, size in zip(lists.get(offsets, ()), lists.get(sizes, ()), strict=False):
                end = max(end, start + size)
        where = struct.unpack_from(order + "I", b, at + stop - 4)[0]
    return end if seen and at + end <= len(b) else None


#: Kilobits a second of MPEG-1 and MPEG-2 layer III frames by their code from 1, and samples a second of MPEG-1.
_MP3_BITS = {3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
_MP3_RATES = (44100, 48000, 32000)


def _mp3(b: bytes, at: int) -> int | None:
    """Length of an MP3 at `at`: an ID3v2 tag of the length it names, then two layer III frames or more, and an ID3v1 tag if there is one."""
    if len(b) - at < 10 or b[at + 3] not in (2, 3, 4) or any(x & 128 for x in b[at + 6 : at + 10]):
        return None
    size = 0
    for x in b[at + 6 : at + 10]:
        size = size << 7 | x
    pos, frames = at + 10 + size + (10 if b[at + 5] & 16 else 0), 0
    while pos + 4 <= len(b) and b[pos] == 0xFF and b[pos + 1] & 0xE6 == 0xE2:
        version, code, rate = b[pos + 1] >> 3 & 3, b[pos + 2] >> 4, b[pos + 2] >> 2 & 3
        if version == 1 or code in (0, 15) or rate == 3:
            break
        kbits, hertz = _MP3_BITS[3 if version == 3 else 2][code - 1], _MP3_RATES[rate] >> {3: 0, 2: 1, 0: 2}[version]
        n = (144 if version == 3 else 72) * 1000 * kbits // hertz + (b[pos + 2] >> 1 & 1)
        if pos + n > len(b):
            break
        pos, frames = pos + n, frames + 1
    if frames < 2:
        return None
    return pos - at + (128 if b[pos : pos + 3] == b"TAG" and pos + 128 <= len(b) else 0)


def _ebml(b: bytes, pos: int) -> tuple[int, int] | None:
    """Length of an EBML size at `pos` and its value; none where it is cut or says unknown."""
    if pos >= len(b) or not b[pos]:
        return None
    n = 9 - b[pos].bit_length()
    value, unknown = int.from_bytes(b[pos : pos + n], "big") & ((1 << 7 * n) - 1), (1 << 7 * n) - 1
    return (n, value) if pos + n <= len(b) and value != unknown else None


def _matroska(b: bytes, at: int) -> int | None:
    """Length of a Matroska or WebM file at `at`: an EBML header that names one of them, then a segment of known size."""
    head = _ebml(b, at + 4)
    if head is None:
        return None
    end = at + 4 + sum(head)
    if b[end : end + 4] != b"\x18\x53\x80\x67" or not any(x in b[at:end] for x in (b"webm", b"matroska")):
        return None
    body = _ebml(b, end + 4)
    return end + 4 + sum(body) - at if body and end + 4 + sum(body) <= len(b) else None


#: Magic bytes, how many bytes of the file lie before them, media type and validator of each format.
FORMATS: list[tuple[bytes, int, str, Callable[[bytes, int], int | None]]] = [
    (b"RIFF", 0, "audio/wav", _riff(b"WAVE", (b"fmt ", b"data"))),
    (b"RIFF", 0, "image/webp", _riff(b"WEBP", (), (b"VP8 ", b"VP8L", b"ANMF"))),
    (b"RIFF", 0, "video/x-msvideo", _riff(b"AVI ", (b"LIST",))),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"II*\0", 0, "image/tiff", _tiff),
    (b"MM\0*", 0, "image/tiff", _tiff),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"ID3", 0, "audio/mpeg", _mp3),
    (b"OggS", 0, "application/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"\x1a\x45\xdf\xa3", 0, "video/x-matroska", _matroska),
]
_MACHINE: ahocorasick.Automaton | None = None


def automaton() -> ahocorasick.Automaton:
    """The automaton over all magic bytes, built once a process; a word holds the formats that start so. Bytes are held as Latin-1 characters."""
    global _MACHINE
    if _MACHINE is None:
        made = ahocorasick.Automaton()
        for magic in dict.fromkeys(f[0] for f in FORMATS):
            made.add_word(magic.decode("latin-1"), [f for f in FORMATS if f[0] == magic])
        made.make_automaton()
        _MACHINE = made
    return _MACHINE


def sniff(payload: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """Detected type, and (offset, length, type) of embedded media in ascending offset; media inside carved media is its own business."""
    found, covered, whole = [], 0, ""
    for end, formats in automaton().iter(payload.decode("latin-1")):
        for magic, lead, kind, check in formats:
            at = end + 1 - len(magic) - lead
            if at < covered:
                continue
            n = check(payload, at)
            if n is None:
                continue
            if at == 0:
                whole = kind
                covered = 1  # what lies inside the file or behind it is embedded
            else:
                found.append((at, n, kind))
                covered = at + n
            break
    if not whole:
        whole = "application/octet-stream"
        if not payload:
            whole = "empty"
        else:
            try:
                payload.decode("utf-8")
                whole = "text/plain"
            except UnicodeDecodeError:
                pass
    return whole, found


def wav_of(samples: bytes) -> bytes:
    """8-bit mono PCM in a RIFF/WAVE file: lossless, one byte a sample."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + (len(samples) & 1)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) & 1)


def samples_of(wav: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    pos = 12
    while pos + 8 <= len(wav):
        n = struct.unpack_from("<I", wav, pos + 4)[0]
        if wav[pos : pos + 4] == b"data":
            return wav[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def _per_row(df: DataFrame, out: str, work: Callable[[dict[str, list]], dict[str, list]], types: dict[str, pa.DataType], keep: list[str]) -> DataFrame:
    ship(df.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                made = work(part.to_pydict())
                columns = [part.column(k) for k in keep] + [pa.array(made[k], t) for k, t in types.items()]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *types])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keep)
    return df.mapInArrow(run, f"{kept + ', ' if kept else ''}{out}")


def store_text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", media_col: str = "media", type_col: str = "declared_type") -> DataFrame:
    """id, n_bytes and the text's UTF-8 bytes, padded with bytes 255 to a positive multiple of FRAME, as a media column.

    The producer declares every payload as text/plain, which is wrong: sniffing is to correct it.
    """

    def work(rows: dict[str, list]) -> dict[str, list]:
        raw = [(x or "").encode() for x in rows["text"]]
        return {"n_bytes": [len(x) for x in raw], media_col: [wav_of(x + b"\xff" * (max(1, -(-len(x) // FRAME)) * FRAME - len(x))) for x in raw], type_col: ["text/plain"] * len(raw)}

    source = docs.select(column_or_null(docs, id_col, "long").alias(id_col), column_or_null(docs, text_col, "string").alias("text"))
    return _per_row(source, f"n_bytes long, `{media_col}` binary, `{type_col}` string", work, {"n_bytes": pa.int64(), media_col: pa.binary(), type_col: pa.string()}, [id_col])


def sniff_media(df: DataFrame, *, media_col: str = "media", type_col: str = "declared_type") -> DataFrame:
    """Adds media_type (the corrected type), type_was_wrong, and embedded: array of (offset, length, type) carved from the payload."""
    names = ["media_type", "type_was_wrong", "embedded"]

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in names}
        for payload, said in zip(rows[media_col], rows[type_col], strict=True):
            kind, inside = sniff(payload or b"")
            out["media_type"].append(kind)
            out["type_was_wrong"].append(said != kind and not (said is None and kind == "empty"))
            out["embedded"].append([{"offset": a, "length": n, "type": k} for a, n, k in inside])
        return out

    spans = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
    keep = [c for c in df.columns if c not in names]
    return _per_row(df.select(*keep), "media_type string, type_was_wrong boolean, embedded array<struct<offset: bigint, length: bigint, type: string>>", work, {"media_type": pa.string(), "type_was_wrong": pa.bool_(), "embedded": spans}, keep)


def features_of(samples: bytes) -> str:
    """Sample features: mean, spread, share of turns across the middle, and entropy of the byte histogram."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    up = x >= 128
    return f"mean={x.mean():.3f};std={x.std():.3f};turns={np.count_nonzero(up[1:] != up[:-1]) / len(x):.5f};bits={-(p * np.log2(p)).sum():.4f}"


def read_media(df: DataFrame, *, media_col: str = "media") -> DataFrame:
    """Replaces the stored media by what is read back from it: payload size and digests, the stored form's, and features."""
    types = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def work(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in types}
        for stored, kind, inside in zip(rows[media_col], rows["media_type"], rows["embedded"], strict=True):
            read = samples_of(stored)
            out["payload_bytes"].append(len(read))
            out["payload_sha256"].append(hashlib.sha256(read).hexdigest())
            out["tail_crc32"].append(zlib.crc32(read[-32:]))
            out["media_bytes"].append(len(stored))
            out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
            carved = ",".join(f"{e['type']}@{e['offset']}+{e['length']}" for e in inside)
            out["feature"].append(f"{kind};{features_of(read)};embedded={carved}")
        return out

    keep = [c for c in df.columns if c != media_col and c not in types]
    return _per_row(df, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", work, types, keep)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as 8-bit samples in a WAV file, sniffed, and read back."""
    sniffed = sniff_media(store_text_media(table(spark, sf_dir, "documents")))
    out = read_media(sniffed)
    digest = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return out.select(*digest, "media_type", "type_was_wrong", F.size("embedded").cast("long").alias("n_embedded"))

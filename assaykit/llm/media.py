"""Media columns: sniffing of true types by signature, and carving of embedded media.

An Aho-Corasick automaton finds all magic bytes in one pass; a validator per format then follows
the structure (chunks, markers, checksums) and gives the length of the medium, or rejects the
hit. The type at offset 0 corrects the declared one; valid media further in are carved.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, new_path, position, table, with_arrow, without

UNIT, RATE = 64, 8000
#: Bytes that are unpacked at a time.
PIECE = 1 << 16


def wav_of(samples: bytes) -> bytes:
    """Mono 8-bit PCM; an odd number of samples gets RIFF's pad byte."""
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples + pad


def riff_chunks(data: bytes, start: int = 0) -> dict[bytes, tuple[int, int]] | None:
    """Place and size of the chunks of a RIFF file that starts there, or null if their sizes don't fit."""
    if len(data) < start + 12 or (end := start + 8 + struct.unpack_from("<I", data, start + 4)[0]) > len(data):
        return None
    at, found = start + 12, {}
    while at + 8 <= end:
        kind, n = struct.unpack_from("<4sI", data, at)
        if at + 8 + n > end:
            return None
        found.setdefault(kind, (at + 8, n))
        at += 8 + n + n % 2
    return found if at == end else None


# Validators get the data, the place of the magic bytes, and the sorted places of all marks. They give the
# place behind the medium, or null. None copies what is left of the data.
Marks = dict[str, list[int]]


def _riff(form: bytes, needed: bytes) -> Callable[[bytes, int, Marks], int | None]:
    def run(d: bytes, at: int, _: Marks) -> int | None:
        if d[at + 8 : at + 12] != form or (chunks := riff_chunks(d, at)) is None or not any(k.startswith(needed) for k in chunks):
            return None
        return at + 8 + struct.unpack_from("<I", d, at + 4)[0]

    return run


def _png(d: bytes, at: int, _: Marks) -> int | None:
    view, at, first = memoryview(d), at + 8, True
    while at + 12 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, at)
        if at + 12 + n > len(d) or (first and (kind, n) != (b"IHDR", 13)) or zlib.crc32(view[at + 4 : at + 8 + n]) != struct.unpack_from(">I", d, at + 8 + n)[0]:
            return None
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at
    return None


def _gif(d: bytes, at: int, _: Marks) -> int | None:
    if len(d) < at + 14:
        return None
    at += 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0)
    while at < len(d):
        if d[at] == 0x3B:
            return at + 1
        if d[at] == 0x21:
            at += 2
        elif d[at] == 0x2C and at + 10 <= len(d):
            at += 11 + (3 << (d[at + 9] & 7) + 1 if d[at + 9] & 0x80 else 0)
        else:
            return None
        while at < len(d) and d[at]:
            at += 1 + d[at]
        at += 1
    return None


def _jpeg(d: bytes, at: int, _: Marks) -> int | None:
    at, scanned = at + 2, False
    while at + 4 <= len(d) and d[at] == 0xFF:
        if d[at + 1] == 0xD9:
            return at + 2 if scanned else None
        n = struct.unpack_from(">H", d, at + 2)[0]
        if n < 2:
            return None
        scan = d[at + 1] == 0xDA
        at += 2 + n
        if scan:
            scanned = True
            while (at := d.find(b"\xff", at)) >= 0 and at + 1 < len(d) and (d[at + 1] == 0 or 0xD0 <= d[at + 1] <= 0xD7):
                at += 2
            if at < 0:
                return None
    return at + 2 if scanned and d[at : at + 2] == b"\xff\xd9" else None


def _gzip(d: bytes, at: int, marks: Marks) -> int | None:
    """The header field by field, then the deflate stream, whose checksum and length must be those behind it."""
    if len(d) < at + 18 or (flags := d[at + 3]) & 0xE0:
        return None
    at += 10
    if flags & 4:
        at += 2 + int.from_bytes(d[at : at + 2], "little")
    for _ in range((flags >> 3 & 1) + (flags >> 4 & 1)):  # a name and a comment, each up to a zero byte
        if "\0" not in marks:
            marks["\0"] = np.flatnonzero(np.frombuffer(d, np.uint8) == 0).tolist()
        if (zero := _next(marks["\0"], at)) is None:
            return None
        at = zero + 1
    at += flags & 2
    view, unpack, crc, size = memoryview(d), zlib.decompressobj(-15), 0, 0
    try:
        while at < len(d) and not unpack.eof:
            rest = view[at : at + PIECE]
            at += len(rest)
            while len(rest) and not unpack.eof:
                out = unpack.decompress(rest, 1 << 16)
                crc, size, rest = zlib.crc32(out, crc), size + len(out), unpack.unconsumed_tail
    except zlib.error:
        return None
    at -= len(unpack.unused_data)
    return at + 8 if unpack.eof and at + 8 <= len(d) and struct.unpack_from("<II", d, at) == (crc, size & 0xFFFFFFFF) else None


def _bmp(d: bytes, at: int, _: Marks) -> int | None:
    if len(d) < at + 26:
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", d, at + 2)
    return at + size if zero == 0 and head in (12, 40, 52, 56, 108, 124) and 14 + head <= offset <= size <= len(d) - at else None


def _next(places: list[int], at: int) -> int | None:
    """The first of the places from at on."""
    k = bisect_left(places, at)
    return places[k] if k < len(places) else None


def _pdf(d: bytes, at: int, marks: Marks) -> int | None:
    """Up to the last end mark before the next header: updates add markers. If there is none the next PDF is inside."""
    if not d[at + 5 : at + 6].isdigit():
        return None
    refers, ends = _next(marks["startxref"], at), marks["%%EOF"]
    first = None if refers is None else _next(ends, refers)  # the first end that may close it
    if first is None:
        return None
    header = _next(marks["%PDF-"], first)
    last = ends[bisect_left(ends, len(d) if header is None else header) - 1]
    return last + 5


def _ogg(d: bytes, at: int, _: Marks) -> int | None:
    start = at
    if len(d) < at + 27 or not d[at + 5] & 2:  # a page in the middle of a stream begins no medium
        return None
    while d[at : at + 4] == b"OggS" and len(d) >= at + 27 and d[at + 4] == 0:
        n = d[at + 26]
        end = at + 27 + n + sum(d[at + 27 : at + 27 + n])
        if end > len(d):
            return None
        at = end
    return at if at > start else None


@cache
def _crc_table(width: int, polynomial: int) -> list[int]:
    top, mask, out = 1 << width - 1, (1 << width) - 1, []
    for byte in range(256):
        crc = byte << width - 8
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc & top else crc << 1) & mask
        out.append(crc)
    return out


def _flac_frame(d: bytes, at: int) -> bool:
    """Whether a frame's header starts here: sync code, fields in their ranges, and its CRC-8."""
    if d[at : at + 1] != b"\xff" or len(d) < at + 6 or d[at + 1] & 0xFE != 0xF8 or d[at + 2] >> 4 == 0 or d[at + 2] & 15 == 15 or d[at + 3] >> 4 > 10 or d[at + 3] & 1:
        return False
    lead = d[at + 4]
    more = 0 if lead < 0x80 else (~lead & 0xFF).bit_length()  # of the coded number, as in UTF-8
    more = 0 if lead < 0x80 else 7 - more
    end = at + 5 + more + {6: 1, 7: 2}.get(d[at + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(d[at + 2] & 15, 0)
    crc, table = 0, _crc_table(8, 0x07)
    for byte in d[at:end]:
        crc = table[crc ^ byte]
    return end < len(d) and crc == d[end]


def _flac(d: bytes, at: int, _: Marks) -> int | None:
    """Metadata blocks by their lengths, then frames: each ends where its CRC-16 comes out as 0 and the next
    header starts; the last one at the first such place of a size that the stream allows."""
    if len(d) < at + 42 or d[at + 4] & 0x7F or d[at + 5 : at + 8] != b"\0\0\x22":
        return None
    least = max(10, int.from_bytes(d[at + 12 : at + 15], "big"))
    last, at = False, at + 4
    while not last:
        if len(d) < at + 4:
            return None
        last, at = bool(d[at] & 0x80), at + 4 + int.from_bytes(d[at + 1 : at + 4], "big")
    if at > len(d) or not _flac_frame(d, at):
        return None
    table, closed, start, crc = _crc_table(16, 0x8005), None, at, 0
    while at < len(d):
        crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ d[at]]
        at += 1
        if crc == 0 and at - start >= least:
            if _flac_frame(d, at):
                start, crc, closed = at, 0, None
            elif closed is None:
                closed = at
    return closed


def _zip(d: bytes, at: int, marks: Marks) -> int | None:
    """Up to the first end record whose directory, by its size and offset, starts where it should for a file that starts here.
    Where a file would start is a property of its end record alone, so this is one lookup a header."""
    if "zip starts" not in marks:
        found = []
        for end in marks["PK\x05\x06"]:
            if end + 22 <= len(d):
                size, offset, note = struct.unpack_from("<IIH", d, end + 12)
                if end + 22 + note <= len(d):
                    found.append((end - size - offset, end, end + 22 + note))
        found.sort()
        marks["zip starts"], marks["zip stops"] = [f[0] for f in found], [f[2] for f in found]
    i = bisect_left(marks["zip starts"], at)
    return marks["zip stops"][i] if i < len(marks["zip starts"]) and marks["zip starts"][i] == at else None


def _midi(d: bytes, at: int, _: Marks) -> int | None:
    if d[at + 4 : at + 8] != b"\0\0\0\6" or len(d) < at + 14:
        return None
    tracks, at = struct.unpack_from(">H", d, at + 10)[0], at + 14
    for _ in range(tracks):
        if d[at : at + 4] != b"MTrk" or len(d) < at + 8:
            return None
        at += 8 + struct.unpack_from(">I", d, at + 4)[0]
    return at if at <= len(d) else None


#: Magic bytes, type, validator.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int, Marks], int | None]]] = [
    (b"RIFF", "audio/wav", _riff(b"WAVE", b"data")),
    (b"RIFF", "image/webp", _riff(b"WEBP", b"VP8")),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"BM", "image/bmp", _bmp),
    (b"%PDF-", "application/pdf", _pdf),
    (b"OggS", "audio/ogg", _ogg),
    (b"fLaC", "audio/flac", _flac),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"MThd", "audio/midi", _midi),
]


#: Marks inside and at the end of media, whose places validators look up.
MARKS = ("%PDF-", "startxref", "%%EOF", "PK\x05\x06")


@cache
def _automaton():
    import ahocorasick

    found: dict[str, list[int]] = {m: [] for m in MARKS}
    for i, (magic, _, _) in enumerate(FORMATS):
        found.setdefault(magic.decode("latin-1"), []).append(i)
    a = ahocorasick.Automaton()
    for mark, which in found.items():
        a.add_word(mark, (mark, which))
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the valid media in data, by offset; none starts inside another but
    in the one at offset 0, whose content is searched too. Of types at one offset the longest wins."""
    found: list[tuple[str, int, int]] = []
    past = 0
    hits: list[tuple[int, list[int]]] = []
    marks: Marks = {m: [] for m in MARKS}
    for end, (mark, which) in _automaton().iter(data.decode("latin-1")):
        at = end - len(mark) + 1
        if mark in marks:
            marks[mark].append(at)
        if which:
            hits.append((at, which))
    for at, which in sorted(hits):
        if at and at < past:
            continue
        valid = [(end - at, FORMATS[i][1]) for i in which if (end := FORMATS[i][2](data, at, marks))]
        if valid:
            n, kind = max(valid)
            found.append((kind, at, n))
            past = at + n if at else 0
    return found


SNIFFED = {"sniffed_type": "string", "corrected": "boolean", "embedded": "array<struct<type:string,offset:long,length:long>>"}


def sniff_media(df: DataFrame, media: str = "media", declared: str = "declared_type") -> DataFrame:
    """df with sniffed_type (null if no format fits at offset 0), corrected (it differs from the
    declared one; the declared type stands where nothing fits) and embedded (further valid media).

    Null or empty media have a null type and no embedded ones. Columns of df with the added names
    are replaced; rows are kept as they are.
    """
    bounded_batches(df.sparkSession)
    df = without(df, "sniffed_type", "corrected", "embedded")
    m, d = position(df, media), position(df, declared)
    kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [sniff(x.as_py() or b"") for x in batch.column(m)]
        true = [x[0][0] if x and x[0][1] == 0 else None for x in found]
        wrong = [t is not None and t != s.as_py() for t, s in zip(true, batch.column(d), strict=True)]
        inner = [[{"type": k, "offset": a, "length": n} for k, a, n in x if a] for x in found]
        return [pa.array(true, pa.string()), pa.array(wrong), pa.array(inner, kind)]

    return with_arrow(df, run, SNIFFED)


def _to_wav(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            raw = [(t or "").encode() for t in batch.column(1).slice(at, 512).to_pylist()]
            media = [wav_of(x + bytes(max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x))) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array([len(x) for x in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared_type", "media"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media, kind, corrected, embedded in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at, n = riff_chunks(media)[b"data"] if kind == "audio/wav" else (0, 0)
            samples = media[at : at + n]
            x = np.frombuffer(samples, np.uint8)
            inner = ",".join(f"{e['type']}@{e['offset']}+{e['length']}" for e in embedded)
            feature = f"{kind};corrected={str(corrected).lower()};n={len(x)};sum={int(x.sum(dtype=np.int64))};peak={int(x.max(initial=0))};changes={int((x[1:] != x[:-1]).sum())};embedded=[{inner}]"
            rows.append((doc_id, n_bytes, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 8
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def store_wav(docs: DataFrame, path: str) -> None:
    """Writes doc_id, n_bytes, declared_type and media: each text's UTF-8 bytes (null: none), with bytes
    0 up to a positive multiple of UNIT, as the samples of an 8-bit WAV file."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs.select("doc_id", "text").mapInArrow(_to_wav, f"doc_id {kind}, n_bytes long, declared_type string, media binary").write.option("compression", "zstd").parquet(path)


def media_digest(docs: DataFrame) -> DataFrame:
    """What op5_media returns, for every row: repeated rows as often, null texts as empty ones, null ids
    kept, other columns not read. Texts are stored, read back, and sniffed like any media."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "media")
    store_wav(docs, path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sniffed = sniff_media(spark.read.parquet(path)).select("doc_id", "n_bytes", "media", "sniffed_type", "corrected", "embedded")
    return sniffed.mapInArrow(_digest, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text as a WAV file, read back and described (see media_digest for nulls and ties)."""
    return media_digest(table(spark, sf_dir, "documents"))

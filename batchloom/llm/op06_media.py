"""Media payload columns: lossless storage, signature sniffing, validation and carving.

``store`` keeps UTF-8 text as 8-bit mono PCM in a RIFF/WAVE container. ``sniff`` finds magic bytes
with one Aho-Corasick automaton over the whole payload; a validator per format walks its structure
and returns the exact length, so a signature without a sound body counts for nothing. The object
at offset 0 corrects the declared type; sound objects further inside are carved, outermost first.

Validators share one ``Payload``, whose markers are found once and whose dead ends are walked once.
RIFF chunks and FLAC frames, which signatures with different ends may share, form forests that are
built once; a signature then asks for a place on its path in logarithmic time. So a very long payload
full of signatures takes time in proportion to its length, up to a logarithm (checksums of nested
sound chunks aside).

Defined cases: null text is stored as no bytes; null media has a null type and no objects; of
objects with one start, the first by format order counts; rows repeat freely; an empty table gives
an empty result; other columns are ignored by the query and kept by ``sniff`` (its columns win a
clash).
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT, RATE = 64, 8000
OBJECTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


class Payload:
    """Bytes with what several validators share, each found once: markers' places and dead ends.

    A walk over a format's structure that ends in nothing marks the places it passed, and a later
    walk of the kind stops there, so all walks together are linear in the payload.
    """

    def __init__(self, raw: bytes):
        self.raw = raw
        self.dead: dict[str, bytearray] = {}

    def walk(self, kind: str, p: int, step: Callable[[int], int | None], done: Callable[[int], int | None]) -> int | None:
        """The end that ``done`` gives for a place on the way from ``p`` by ``step``; None where the way ends."""
        if kind not in self.dead:
            self.dead[kind] = bytearray(len(self.raw))
        dead, passed = self.dead[kind], []
        at: int | None = p
        while at is not None and 0 <= at < len(self.raw) and not dead[at]:
            if (end := done(at)) is not None:
                return end
            passed.append(at)
            at = step(at)
        for q in passed:
            dead[q] = 1
        return None

    @cached_property
    def chunks(self) -> Chunks:
        return Chunks(self.raw)

    @cached_property
    def frames(self) -> Frames:
        return Frames(self.raw)

    @cached_property
    def jpeg_markers(self) -> list[int]:
        """Places of 0xFF before a byte that is neither stuffing, a restart nor a fill byte."""
        return [m.start() for m in re.finditer(rb"\xff[^\x00\xd0-\xd7\xff]", self.raw)]

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Start of an archive to the end of its last end record, by the record's own directory offset."""
        out = {}
        for m in re.finditer(rb"PK\x05\x06", self.raw):
            if (e := m.start()) + 22 <= len(self.raw):
                size, first, comment = struct.unpack_from("<IIH", self.raw, e + 12)
                start, end = e - size - first, e + 22 + comment
                if start >= 0 and end <= len(self.raw) and self.raw[start + first : start + first + 4] == b"PK\x01\x02":
                    out[start] = end
        return out

    @cached_property
    def pdf_ends(self) -> tuple[dict[int, int], list[int], dict[int, list[int]]]:
        """(start of a file to the end of its last section, places of xref tables, offsets told to ends).

        A section ends in startxref, an offset and %%EOF; the offset leads from the file's start to
        the section's own xref table or stream, the nearest before. A linearised file's last
        section leads to the first table instead.
        """
        tables = [m.start() for m in re.finditer(rb"(?<![a-z])xref(?=\s)", self.raw)]
        objects = [m.start() for m in re.finditer(rb"(?<![0-9])[0-9]+ [0-9]+ obj\b", self.raw)]
        ends, told = {}, {}
        for m in re.finditer(rb"startxref\s+([0-9]{1,15})\s+%%EOF", self.raw):
            offset = int(m[1])
            told.setdefault(offset, []).append(m.end())
            for places in (tables, objects):
                if at := bisect.bisect_left(places, m.start()):
                    ends[places[at - 1] - offset] = m.end()
        return ends, tables, told


class Chunks:
    """The forest of RIFF chunks that any RIFF head leads to: a chunk's parent is the one that follows it."""

    def __init__(self, b: bytes):
        self.after: dict[int, int | None] = {}
        self.kind: dict[int, tuple[bytes, int]] = {}
        for m in re.finditer(b"RIFF", b):
            p: int | None = m.start() + 12
            while p is not None and p not in self.after:
                if p + 8 <= len(b):
                    n = struct.unpack_from("<I", b, p + 4)[0]
                    self.kind[p], self.after[p] = (b[p : p + 4], n), p + 8 + n + n % 2
                else:
                    self.kind[p], self.after[p] = (b"", 0), None
                p = self.after[p]
        # what follows lies behind, so parents come before children in falling order
        order = sorted(self.after, reverse=True)
        self.size, self.first, self.kids, self.marks, free = dict.fromkeys(order, 1), {}, {}, {}, 0
        for p in reversed(order):
            if (q := self.after[p]) is not None:
                self.size[q] += self.size[p]
        room: dict[int, int] = {}
        for p in order:
            q, (name, n) = self.after[p], self.kind[p]
            fmt, data = self.marks.get(q, (0, 0))
            self.marks[p] = fmt + (name == b"fmt " and n >= 16), data + (name == b"data")
            if q is None:
                self.first[p], free = free, free + self.size[p]
            else:
                self.first[p], room[q] = room[q], room[q] + self.size[p]
                self.kids.setdefault(q, []).append(p)
            room[p] = self.first[p] + 1

    def reaches(self, p: int, q: int) -> bool:
        """Whether the chunks from ``p`` on lead to ``q``."""
        return q in self.first and self.first[q] <= self.first[p] < self.first[q] + self.size[q]

    def last(self, p: int, q: int) -> int:
        """The chunk before ``q`` on the way from ``p``."""
        kids = self.kids[q]
        return kids[bisect.bisect_right(kids, self.first[p], key=self.first.__getitem__) - 1]


def _wav(p: Payload, at: int) -> int | None:
    """Chunks up to the stated end (or one byte of padding beyond), a format and data among them."""
    b = p.raw
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end, chunks, first = at + 8 + struct.unpack_from("<I", b, at + 4)[0], p.chunks, at + 12
    if end > len(b):
        return None
    if chunks.reaches(first, end):
        stop = end
    elif chunks.reaches(first, end + 1) and first <= end and chunks.kind[chunks.last(first, end + 1)][1]:
        stop = end + 1
    else:
        return None
    (fmt, data), (fmt_after, data_after) = chunks.marks[first], chunks.marks[stop]
    return end if fmt > fmt_after and data > data_after else None


def _png(p: Payload, at: int) -> int | None:
    b = p.raw
    if b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None

    def chunk(q: int) -> int | None:
        return q + 12 + struct.unpack_from(">I", b, q)[0] if q + 12 <= len(b) else None

    # lengths first: only a chain of chunks that ends is worth its checksums
    end = p.walk("png", at + 8, chunk, lambda q: q + 12 if b[q : q + 8] == b"\0\0\0\0IEND" and q + 12 <= len(b) else None)
    q = at + 8
    while end is not None and q < end:
        n = struct.unpack_from(">I", b, q)[0]
        if zlib.crc32(memoryview(b)[q + 4 : q + 8 + n]) != struct.unpack_from(">I", b, q + 8 + n)[0]:
            return None
        q += 12 + n
    return end


def _jpeg(p: Payload, at: int) -> int | None:
    b, markers = p.raw, p.jpeg_markers

    def segment(q: int) -> int | None:
        if b[q] != 0xFF or q + 4 > len(b) or (n := struct.unpack_from(">H", b, q + 2)[0]) < 2:
            return None
        if b[q + 1] != 0xDA:
            return q + 2 + n
        after = bisect.bisect_left(markers, q + 2 + n)  # entropy-coded data up to the next real marker
        return markers[after] if after < len(markers) else None

    return p.walk("jpeg", at + 2, segment, lambda q: q + 2 if b[q : q + 2] == b"\xff\xd9" else None)


def _gif(p: Payload, at: int) -> int | None:
    b = p.raw
    if len(b) < at + 13 or b[at + 4 : at + 6] not in (b"7a", b"9a"):
        return None

    def after_blocks(q: int) -> int | None:
        return p.walk("gif data", q, lambda x: x + 1 + b[x], lambda x: x + 1 if not b[x] else None)

    def section(q: int) -> int | None:
        if b[q] == 0x2C and q + 10 <= len(b):
            return after_blocks(q + 10 + (3 << (b[q + 9] & 7) + 1 if b[q + 9] & 0x80 else 0) + 1)
        return after_blocks(q + 2) if b[q] == 0x21 else None

    first = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    return p.walk("gif", first, section, lambda q: q + 1 if b[q] == 0x3B else None)


def _bmp(p: Payload, at: int) -> int | None:
    b = p.raw
    if len(b) < at + 54:
        return None
    size, zero, first, head = struct.unpack_from("<IIII", b, at + 2)
    sound = not zero and head in (40, 108, 124) and 54 <= first < size <= len(b) - at and struct.unpack_from("<H", b, at + 26)[0] == 1
    return at + size if sound else None


def _pdf(p: Payload, at: int) -> int | None:
    """The last section whose offset leads from this header to its own table."""
    b = p.raw
    if not b[at + 5 : at + 6].isdigit() or b[at + 6 : at + 7] != b".":
        return None
    ends, tables, told = p.pdf_ends
    found = [ends[at]] if ends.get(at, 0) > at else []
    if b.find(b"/Linearized", at, at + 1024) >= 0 and (i := bisect.bisect_left(tables, at)) < len(tables):
        places = told.get(tables[i] - at, [])
        found += places[(j := bisect.bisect_right(places, tables[i])) : j + 1]
    return max(found, default=None)


def _zip(p: Payload, at: int) -> int | None:
    return p.zip_ends.get(at)


def _flac_frame(b: bytes, p: int) -> tuple[int, int] | None:
    """(samples, length of the header) of a frame header whose checksum holds."""
    if b[p : p + 2] not in (b"\xff\xf8", b"\xff\xf9") or p + 6 > len(b):
        return None
    block, rate, channels, bits = b[p + 2] >> 4, b[p + 2] & 15, b[p + 3] >> 4, b[p + 3] >> 1 & 7
    if not block or rate == 15 or channels > 10 or bits == 3 or b[p + 3] & 1:
        return None
    lead = b[p + 4]
    q = p + 5 + (7 - (~lead & 0xFF).bit_length() if lead >= 0xC0 else 0)  # the frame's number, coded like UTF-8
    if block in (6, 7):
        samples = int.from_bytes(b[q : q + block - 5], "big") + 1
        q += block - 5
    else:
        samples = 192 if block == 1 else 576 << block - 2 if block < 6 else 256 << block - 8
    q += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    crc = 0
    for x in b[p : q + 1]:
        crc ^= x
        for _ in range(8):
            crc = (crc << 1 ^ (0x07 if crc & 0x80 else 0)) & 0xFF
    return (samples, q + 1 - p) if q < len(b) and not crc else None


@lru_cache(maxsize=1)
def _crc16_weights() -> np.ndarray:
    """x ** (8 - 8 i) modulo the frame checksum's polynomial, for one period of i."""
    back = lambda c: (c ^ 0x18005 if c & 1 else c) >> 1  # divided by x
    out, w = [], 0x100
    while not out or w != out[0]:
        out.append(w)
        for _ in range(8):
            w = back(w)
    return np.array(out, np.uint32)


class Frames:
    """FLAC frames of a payload: verified heads, each with the next head at which its checksum holds.

    A checksum of bytes q..r is zero exactly if ``sums[q] == sums[r]``: the sums are running XORs of
    every byte times its power of x. Twofold jumps along the chain of frames carry their samples and
    their shortest and longest length, so a stream finds its last frame in logarithmic time.
    """

    def __init__(self, b: bytes):
        raw, weights = np.frombuffer(b, np.uint8).astype(np.uint32), _crc16_weights()
        w = np.resize(weights, len(raw))
        term = np.zeros(len(raw), np.uint32)
        for _ in range(8):
            term ^= np.where(raw & 1, w, 0).astype(np.uint32)
            raw >>= 1
            w = np.where(w & 0x8000, w << 1 ^ 0x18005, w << 1)
        self.sums = np.concatenate([[0], np.bitwise_xor.accumulate(term)]) if len(raw) else np.zeros(1, np.uint32)
        order = np.argsort(self.sums, kind="stable")
        cuts = np.searchsorted(self.sums[order], np.arange(0x10001))
        self.places, self.cuts = order, cuts
        heads = [(m.start(), got) for m in re.finditer(rb"\xff(?=[\xf8\xf9])", b) if (got := _flac_frame(b, m.start()))]
        self.at = {p: i for i, (p, _) in enumerate(heads)}
        self.start, self.samples, self.least = (np.array(x, np.int64) for x in ([p for p, _ in heads], [g[0] for _, g in heads], [p + g[1] + 3 for p, g in heads]))
        by_sum: dict[int, list[int]] = {}
        for i, (p, _) in enumerate(heads):
            by_sum.setdefault(int(self.sums[p]), []).append(i)
        nxt = np.full(len(heads), -1, np.int64)
        for same in by_sum.values():
            at = np.searchsorted(self.start[same], self.least[same])
            nxt[same] = [same[k] if k < len(same) else -1 for k in at]
        length = np.where(nxt >= 0, self.start[nxt] - self.start, 0) if len(heads) else nxt
        self.jumps = [(nxt, self.samples, length, length)]
        while (self.jumps[-1][0] >= 0).any():
            to, total, low, high = self.jumps[-1]
            ok = (to >= 0) & (to[to] >= 0)
            self.jumps.append((np.where(ok, to[to], -1), total + np.where(ok, total[to], 0), np.minimum(low, np.where(ok, low[to], low)), np.maximum(high, np.where(ok, high[to], high))))

    def end(self, q: int, total: int, least: int, most: int) -> int | None:
        """The end of ``total`` samples in frames from ``q`` on, each of ``least`` to ``most`` bytes (0: any)."""
        if (i := self.at.get(q)) is None:
            return None
        for to, samples, low, high in reversed(self.jumps):
            if to[i] >= 0 and samples[i] < total:
                if low[i] < least or most and high[i] > most:
                    return None
                total, i = total - int(samples[i]), int(to[i])
        if self.samples[i] < total:
            return None
        start, value = int(self.start[i]), int(self.sums[self.start[i]])
        a, z = self.cuts[value], self.cuts[value + 1]
        k = a + np.searchsorted(self.places[a:z], max(int(self.least[i]), start + least))
        stop = int(self.places[k]) if k < z else None
        return stop if stop is not None and not (most and stop - start > most) else None


def _flac(p: Payload, at: int) -> int | None:
    """Metadata blocks, then frames until the stream's samples are reached; a frame ends where its checksum does."""
    b = p.raw
    if len(b) < at + 42 or b[at + 4] & 0x7F or b[at + 5 : at + 8] != b"\0\0\x22":
        return None
    info = int.from_bytes(b[at + 8 : at + 42], "big")
    least, most, total = info >> 34 * 8 - 56 & 0xFFFFFF, info >> 34 * 8 - 80 & 0xFFFFFF, info >> 128 & (1 << 36) - 1
    block = lambda q: q + 4 + int.from_bytes(b[q + 1 : q + 4], "big")
    q = p.walk("flac", at + 4, lambda x: block(x) if x + 4 <= len(b) and not b[x] >> 7 else None, lambda x: block(x) if x + 4 <= len(b) and b[x] >> 7 and block(x) <= len(b) else None)
    return q if q is None or not total else p.frames.end(q, total, least, most)


def _ogg(p: Payload, at: int) -> int | None:
    b = p.raw

    def page(q: int) -> int | None:
        n = q + 27 + b[q + 26] if q + 27 <= len(b) and b[q : q + 5] == b"OggS\0" else len(b) + 1
        return n + sum(b[q + 27 : n]) if n <= len(b) else None

    def last(q: int) -> int | None:
        return end if q + 27 <= len(b) and b[q + 5] & 4 and (end := page(q)) is not None and end <= len(b) else None

    return p.walk("ogg", at, page, last)


#: Published magic bytes of each format.
FORMATS: dict[str, tuple[bytes, Callable[[Payload, int], int | None]]] = {
    "audio/wav": (b"RIFF", _wav),
    "image/png": (b"\x89PNG\r\n\x1a\n", _png),
    "image/jpeg": (b"\xff\xd8\xff", _jpeg),
    "image/gif": (b"GIF8", _gif),
    "image/bmp": (b"BM", _bmp),
    "application/pdf": (b"%PDF-", _pdf),
    "application/zip": (b"PK\x03\x04", _zip),
    "audio/flac": (b"fLaC", _flac),
    "audio/ogg": (b"OggS", _ogg),
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, (magic, _) in FORMATS.items():
        a.add_word(magic.decode("latin-1"), (kind, len(magic)))
    a.make_automaton()
    return a


def objects(media: bytes) -> list[tuple[str, int, int]]:
    """(type, start, stop) of every sound object, outermost first, none nested in a carved one."""
    found: list[tuple[str, int, int]] = []
    payload = Payload(media)
    for last, (kind, n) in _automaton().iter(media.decode("latin-1")):
        at = last - n + 1
        if found and found[-1][1] > 0 and at < found[-1][2]:
            continue
        if (stop := FORMATS[kind][1](payload, at)) is not None:
            found.append((kind, at, stop))
    return found


def to_media(raw: bytes) -> tuple[bytes, int]:
    """(WAVE file of 8-bit samples, payload length): bytes padded by zeros to a positive multiple of 64."""
    payload = raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))
    head = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload, len(payload)


def from_media(media: bytes) -> bytes:
    """Samples of the data chunk."""
    p = 12
    while p + 8 <= len(media):
        n = struct.unpack_from("<I", media, p + 4)[0]
        if media[p : p + 4] == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            raw = [(t or "").encode() for t in batch.column(1).slice(i, 512).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 512), pa.array([len(r) for r in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array([to_media(r)[0] for r in raw], pa.binary())],
                names=["doc_id", "n_bytes", "declared", "media"],
            )


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, media: every whole text as a WAVE payload, not yet typed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_store, "doc_id long, n_bytes long, declared string, media binary")


def sniff_one(media: bytes | None, declared: str | None) -> tuple:
    """(type, whether it corrects the declared one, carved objects)."""
    if media is None:
        return None, False, []
    found = objects(media)
    kind = next((k for k, a, stop in found if a == 0), declared)
    return kind, kind != declared, [o for o in found if o[1] > 0]


def _sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    carved = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        got = [sniff_one(m, d) for m, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got]), pa.array([[dict(zip(("type", "start", "stop"), o, strict=True)) for o in g[2]] for g in got], carved), batch.column(2)],
            names=["detected", "corrected", "carved", "row"],
        )


def sniff(df: DataFrame, media: str = "media", declared: str = "declared") -> DataFrame:
    """``df`` with detected, corrected and carved (array of type, start, stop)."""
    keep = [c for c in df.columns if c not in ("detected", "corrected", "carved")]
    row = df.select(F.col(media).alias("m"), F.col(declared).alias("d"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    schema = T.StructType([T.StructField("detected", T.StringType()), T.StructField("corrected", T.BooleanType()), T.StructField("carved", OBJECTS), row.schema["row"]])
    return row.mapInArrow(_sniff, schema).select("row.*", "detected", "corrected", "carved")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for i in range(0, batch.num_rows, 256):
            for doc, n, declared, media in zip(*(batch.column(k).slice(i, 256).to_pylist() for k in range(4)), strict=True):
                kind, corrected, carved = sniff_one(media, declared)
                p = from_media(media)
                feature = f"{kind};corrected={int(corrected)};carved=" + ",".join(f"{k}:{a}-{z}" for k, a, z in carved)
                rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)


def features(stored: DataFrame) -> DataFrame:
    """Digests of every stored payload as read back, and its sniffed feature."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(_features, schema)

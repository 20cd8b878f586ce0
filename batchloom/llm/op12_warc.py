"""WARC archives of pages: records cut into segments on writing, put together again on reading.

Writing: a page's payload becomes an HTTP response with chunked transfer framing; a block longer
than ``segment`` bytes is cut into one ``response`` record and ``continuation`` records that name
the first one's id, their number and, in the last, the total length. Of equal payloads of at least
``REVISIT_FROM`` bytes that of the largest page_id is written, and the others are ``revisit``
records that name it. Archives are gzip files of Spark's text writer with the records' closing
CRLF CRLF as line separator, so they lie wherever Spark can write.

Reading: files are read as lines that end where a record's version line begins; a record is whole
when its Content-Length is reached, so payloads may hold anything, WARC records included. A record
of one segment is decoded where it is read. Segments go to their origin's id, are ordered by their number and
streamed through one decoder of the chunked framing; numbers must be gapless, the total length and the
payload's digest must agree, else ``problem`` says what is wrong. Revisits look up what they name.

Defined cases: null html is an empty payload; null urls and ids have no header and come back null;
of equal rows that share a long payload one is the response (as of rows of equal page_id); a null page_id is the smallest; very
long payloads are cut like others and need memory for one payload in writing and one segment in reading;
an empty table gives no archive rows. Only page_id, url and html are read, so no other column's name can clash.
Uncompressed archives are read in parts; there a payload that holds a version line at the edge of a part is
reported as a problem instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import discard, landed, row_keys, scratch, small_or_shuffled

VERSION, END, REVISIT_FROM = "WARC/1.1\r\n", "\r\n\r\n", 1000
#: Bytes of a record's block and of a chunk of its transfer framing.
SEGMENT, CHUNK = 16_384, 4_096
#: Expected bytes of payload in one archive file.
FILE_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def framed(payload: bytes, chunk: int = CHUNK) -> bytes:
    """A payload in chunked transfer framing."""
    out = []
    for i in range(0, len(payload), chunk):
        piece = payload[i : i + chunk]
        out += (b"%x\r\n" % len(piece), piece, b"\r\n")
    return b"".join([*out, b"0\r\n\r\n"])


def record(kind: str, record_id: str, block: bytes, **headers: str | int | None) -> bytes:
    """A record without its version line's and its own end, which the files' separators are."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"Content-Length: {len(block)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def _url(url: str | None) -> str | None:
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def response(record_id: str, page_id: int | None, url: str | None, payload: bytes, segment: int = SEGMENT, chunk: int = CHUNK) -> Iterator[bytes]:
    """The records of one page."""
    block = HTTP + framed(payload, chunk)
    head = {"WARC_Target_URI": _url(url), "Page_ID": page_id, "WARC_Payload_Digest": f"sha1:{hashlib.sha1(payload).hexdigest()}", "Content_Type": "application/http; msgtype=response"}
    if len(block) <= segment:
        yield record("response", record_id, block, **head)
        return
    count = -(-len(block) // segment)
    for n in range(1, count + 1):
        piece = block[(n - 1) * segment : n * segment]
        if n == 1:
            yield record("response", record_id, piece, WARC_Segment_Number=1, **head)
        else:
            own = str(uuid.uuid5(uuid.UUID(record_id), str(n)))
            yield record("continuation", own, piece, WARC_Segment_Number=n, WARC_Segment_Origin_ID=f"<urn:uuid:{record_id}>", WARC_Segment_Total_Length=len(block) if n == count else None)


def _id_of(*parts: object) -> str:
    return str(uuid.UUID(bytes=hashlib.blake2b(repr(parts).encode(), digest_size=16).digest(), version=5))


def _shared_id(sha1: str) -> str:
    """The record id of the one response with this payload."""
    return _id_of("payload", sha1)


def _responses(segment: int, chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        out, held = [], 0
        for page_id, url, payload, k1, k2 in zip(*(c for c in batch.columns), strict=True):
            body = payload.as_py()
            n += 1
            record_id = _shared_id(hashlib.sha1(body).hexdigest()) if len(body) >= REVISIT_FROM else _id_of(k1.as_py(), k2.as_py(), part, n)
            for r in response(record_id, page_id.as_py(), url.as_py(), body, segment, chunk):
                out.append(r)
                held += len(r)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def _revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = HTTP.replace(b"Transfer-Encoding: chunked\r\n", b"")
    for batch in batches:
        out = []
        for page_id, url, sha1, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.append(record("revisit", _id_of("revisit", row), block, WARC_Target_URI=_url(url), Page_ID=page_id, WARC_Payload_Digest=f"sha1:{sha1}", WARC_Profile=PROFILE, WARC_Refers_To=f"<urn:uuid:{_shared_id(sha1)}>", Content_Type="application/http; msgtype=response"))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def write_archives(pages: DataFrame, path: str | None = None, segment: int = SEGMENT, chunk: int = CHUNK) -> str:
    """Archive files of all rows of ``pages(page_id, url, html)``; returns their folder."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    k1, k2 = row_keys(base)
    keyed = base.select("page_id", "url", _payload().alias("payload"), k1.alias("k1"), k2.alias("k2"))
    thin = keyed.select("page_id", "url", "k1", "k2", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    thin = landed(thin, "payloads")
    long = thin.where(F.col("bytes") >= REVISIT_FROM)
    order = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "k1", "k2", "row")
    shared = long.groupBy("sha1").agg(F.count("*").alias("n"), F.max(order).alias("best")).where("n > 1").select("sha1", "best.k1", "best.k2", "best.row")
    shared = landed(shared, "shared")
    revisits = landed(long.join(small_or_shuffled(shared.select("sha1", F.col("row").alias("best"))), "sha1").where("row != best").select("page_id", "url", "sha1", "row", "k1", "k2"), "revisits")
    # rows that are no response; where an equal row is one, the first of the equal rows stands for it
    repeated = landed(revisits.join(small_or_shuffled(shared.select("k1", "k2")), ["k1", "k2"], "left_semi").select("k1", "k2").distinct(), "repeated")
    responses = keyed
    if not revisits.isEmpty():
        responses = keyed.join(small_or_shuffled(revisits.select("k1", "k2").distinct()), ["k1", "k2"], "left_anti")
    if not repeated.isEmpty():
        responses = responses.unionByName(keyed.join(small_or_shuffled(repeated), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    total = thin.agg(F.sum("bytes")).first()[0] or 0
    made = responses.select("page_id", "url", "payload", "k1", "k2").mapInArrow(lambda it: _responses(segment, chunk, it), "record binary")
    made = made.union(revisits.select("page_id", "url", "sha1", "row").mapInArrow(_revisits, "record binary"))
    # the version line opens a record, the separator closes it; bytes pass the text writer as they are
    text = made.select(F.concat(F.lit(VERSION).cast("binary"), "record").cast("string").alias("value"))
    rows_a_file = max(1_000, int(FILE_BYTES / max(1, min(segment, total / max(1, thin.count())))))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", rows_a_file).text(path)
    discard(thin, shared, revisits, repeated)
    return path


class Chunked:
    """Decoder of an HTTP response fed in pieces: headers, then identity or chunked transfer framing."""

    def __init__(self) -> None:
        self.rest, self.state, self.left, self.chunked, self.problem = b"", "head", 0, False, None

    def feed(self, data: bytes) -> Iterator[bytes]:
        """Payload bytes that ``data`` completes."""
        data, self.rest, p = self.rest + data, b"", 0
        while self.problem is None and p < len(data):
            if self.state == "body":
                yield data[p:]
                return
            if self.state == "data":
                piece = data[p : p + self.left]
                p, self.left = p + len(piece), self.left - len(piece)
                yield piece
                self.state = "data" if self.left else "data end"
                continue
            if self.state == "done":
                self.problem = "bytes after the last chunk"
                return
            stop = data.find(b"\r\n\r\n" if self.state == "head" else b"\r\n", p)
            if stop < 0:
                self.rest = data[p:]
                return
            line, p = data[p:stop], stop + (4 if self.state == "head" else 2)
            if self.state == "head":
                self.chunked = any(h.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for h in line.split(b"\r\n"))
                self.state = "size" if self.chunked else "body"
            elif self.state == "data end":
                self.problem, self.state = "chunk longer than its size" if line else None, "size"
            elif self.state == "trailer":
                self.state = "trailer" if line else "done"
            else:
                try:
                    self.left = int(line.split(b";")[0].strip(), 16)
                except ValueError:
                    self.problem = "chunk without a size"
                    return
                self.state = "data" if self.left else "trailer"

    def ended(self) -> str | None:
        """What is wrong at the end of the input, if anything."""
        return self.problem or (None if self.state in ("body", "done") else "framing ends early")


_RECORD = "record_id string, kind string, page_id long, url string, segment int, origin string, total long, digest string, refers string, block binary, problem string"
_NAMES = [c.split()[0] for c in _RECORD.split(", ")]
_ARROW = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary()), ("problem", pa.string())])


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and text.lstrip("-").isdigit() else None


def parse(head: bytes, block: bytes, problem: str | None) -> tuple:
    """A record's fields in the order of ``_RECORD``."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")) if k.strip()}
    uid = lambda key: fields[key].strip("<>").removeprefix("urn:uuid:") if key in fields else None
    segment = _number(fields.get("warc-segment-number"))
    own = uid("warc-record-id")
    origin = uid("warc-segment-origin-id") or (own if segment is not None else None)
    return (own, fields.get("warc-type"), _number(fields.get("page-id")), fields.get("warc-target-uri"), segment, origin, _number(fields.get("warc-segment-total-length")), (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None, uid("warc-refers-to"), block, problem)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of (file, piece) rows; pieces end where a version line stood, so those of one record are joined again."""
    head, block, need, have, file = None, [], 0, 0, None

    def whole() -> tuple:
        data = b"".join(block)
        got = data[:need]
        problem = "block ends early" if len(data) < need else "bytes after the block" if data[need:].strip(b"\r\n") else None
        return parse(head, got, problem)

    for batch in batches:
        rows, held = [], 0
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = piece.as_py()
            if head is not None and name == file and have < need:
                block += [VERSION.encode(), data]  # the version line was part of the payload
                have += len(VERSION) + len(data)
                continue
            if head is not None:
                rows.append(whole())
                held += need
                head = None
            file = name
            at = data.find(b"\r\n\r\n")
            if at >= 0:
                head, block = data[:at], [data[at + 4 :]]
                length = next((line.split(b":")[1].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")), b"")
                need, have = int(length) if length.isdigit() else 0, len(block[0])
            elif data.strip(b"\r\n"):
                rows.append((None, None, None, None, None, None, None, None, None, b"", "no record head"))
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
    if head is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(whole(), _ARROW.types, strict=True)], schema=_ARROW)


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``, continuations included: their headers' fields and their block."""
    pieces = spark.read.option("lineSep", VERSION).text(path)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(_records, _RECORD)


_OUT = "record_id string, kind string, page_id long, url string, refers string, payload_bytes long, payload_digest string, problem string"
_PARTS = ", segment int, origin string, total long, digest string, block binary"


class _Page:
    """One page's payload as its blocks come in; the payload itself is kept only if asked for."""

    def __init__(self, keep: bool):
        self.decoder, self.sha1, self.bytes, self.keep, self.parts = Chunked(), hashlib.sha1(), 0, keep, []

    def add(self, block: bytes) -> None:
        for piece in self.decoder.feed(block):
            self.sha1.update(piece)
            self.bytes += len(piece)
            if self.keep:
                self.parts.append(piece)

    def row(self, first: dict, problem: str | None) -> dict:
        digest = self.sha1.hexdigest()
        problem = problem or self.decoder.ended() or (None if first["digest"] in (None, digest) else "payload digest differs")
        return first | {"payload_bytes": self.bytes, "payload_digest": digest, "problem": problem, "payload": b"".join(self.parts) if self.keep else None}


def _schema(parts: bool, keep: bool) -> tuple[str, pa.Schema]:
    ddl = _OUT + _PARTS * parts + ", payload binary" * keep
    arrow = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return ddl, pa.schema([(name, arrow[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _decoded(keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of one segment decoded, those of several with their block as it is."""
    schema = _schema(True, keep)[1]
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = batch.slice(i, 256).to_pylist()
            for k, r in enumerate(rows):
                if r["segment"] is None:
                    block, r["block"] = r["block"], None
                    if r["kind"] == "response":
                        page = _Page(keep)
                        page.add(block)
                        rows[k] = page.row(r, r["problem"])
                    else:
                        r["payload_digest"] = r["digest"]
            yield pa.RecordBatch.from_pylist(rows, schema)


def _joined(keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of segments that come sorted by (origin, segment)."""
    schema = _schema(False, keep)[1]
    page, first, expected, seen, total, problem = None, {}, 0, 0, None, None

    def finish() -> dict:
        wrong = problem or ("last segment is missing" if total is None else None if total == seen else "total length differs")
        return page.row(first, wrong)

    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if page is None or r["origin"] != first["origin"]:
                if page is not None:
                    done.append(finish())
                page, first, expected, seen, total, problem = _Page(keep), r, 1, 0, None, None
                if r["kind"] == "continuation":  # its first segment is missing
                    first = dict.fromkeys(r) | {"record_id": r["origin"], "origin": r["origin"], "kind": "response"}
            if r["segment"] != expected:
                problem = problem or (f"segment {expected} is missing" if (r["segment"] or 0) > expected else f"segment {r['segment']} is repeated")
            expected = (r["segment"] or 0) + 1
            problem, total = problem or r["problem"], r["total"] if r["total"] is not None else total
            seen += len(r["block"])
            page.add(r["block"])
        yield pa.RecordBatch.from_pylist(done, schema)
    if page is not None:
        yield pa.RecordBatch.from_pylist([finish()], schema)


def read_pages(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Responses and revisits of the archives under ``path``, segments put together, each with its payload's length and digest.

    With ``payloads`` the payload comes along. ``problem`` is null for a sound record. Only records of
    several segments are shuffled.
    """
    raw = landed(raw_records(spark, path).mapInArrow(lambda it: _decoded(payloads, it), _schema(True, payloads)[0]), "records")
    columns = _schema(False, payloads)[1].names
    cut = raw.where("segment is not null").repartition("origin").sortWithinPartitions("origin", "segment")
    return raw.where("segment is null").select(columns).unionByName(cut.mapInArrow(lambda it: _joined(payloads, it), _schema(False, payloads)[0]))


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page_id), problem: revisits take length and digest from what they name."""
    responses = records.where("kind = 'response'")
    named = responses.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("named_bytes"), F.col("payload_digest").alias("named_digest"))
    met = records.where("kind = 'revisit'").join(named, "refers", "left")
    wrong = F.coalesce("problem", F.when(F.col("named_bytes").isNull(), "the record that is named is missing"), F.when(F.col("named_digest") != F.col("payload_digest"), "payload digest differs"))
    own = responses.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "problem")
    return own.unionByName(met.select("page_id", F.col("named_bytes").alias("payload_bytes"), F.col("named_digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", wrong.alias("problem")))

"""WARC archives: round trips, segments in any file, and what a broken archive says."""

import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from batchloom.llm import op12_warc
from batchloom.llm.op12_warc import Chunked, framed, record, response

SCHEMA = "page_id bigint, url string, html string"
VERSION = b"WARC/1.1\r\n"


def back(spark, df, path=None, **how):
    return op12_warc.pages_of(op12_warc.read_pages(spark, op12_warc.write_archives(df, path, **how))).collect()


def by_force(rows):
    out, groups = [], {}
    for i, (page_id, _, html) in enumerate(rows):
        body = (html or "").encode()
        groups.setdefault(body, []).append((page_id is not None, page_id or 0, i))
        out.append([page_id, len(body), hashlib.sha1(body).hexdigest(), "response", None])
    for body, g in groups.items():
        best = max(g)
        for known, page_id, i in g:
            if len(body) >= 1000 and (known, page_id, i) != best:
                out[i][3:] = ["revisit", best[1] if best[0] else None]
    return Counter(map(tuple, out))


def test_round_trip(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc é\r\n0") for _ in range(n)) for n in (0, 1, 999, 1000, 1001, 5_000, 40_000, 40_001)] + ["WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 900, "WARC/1.1\r\n" * 2_000]
    rows = [(i, f"http://x/{i}", rng.choice(texts)) for i in range(120)] + [(None, None, None), (None, "u", texts[5]), (7, "a\r\nb", texts[5]), (7, "a\r\nb", texts[5]), (7, "a\r\nb", texts[5]), (500, "s", "short"), (500, "s", "short")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6).select("*", *[F.lit(1).alias(c) for c in ("k1", "record", "row", "sha1", "bytes", "payload", "a.b")])
    got = back(spark, df)
    assert all(r.problem is None for r in got)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == by_force(rows)
    assert back(spark, df.limit(0)) == []


def test_segments_keep_payloads(spark, tmp_path):
    rows = [(i, None, f"é{i}" * (300 * i)) for i in range(20)]
    path = op12_warc.write_archives(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "w"), segment=700, chunk=97)
    raw = op12_warc.raw_records(spark, path)
    assert raw.where("kind = 'continuation'").count() > 100 and raw.where("octet_length(block) > 700").count() == 0
    got = {r.page_id: (r.payload.decode(), r.problem) for r in op12_warc.read_pages(spark, path, payloads=True).collect()}
    assert got == {i: (text, None) for i, _, text in rows}


def archive(tmp_path, name, records, packed=True):
    data = b"".join(VERSION + r + b"\r\n\r\n" for r in records)
    (tmp_path / "made").mkdir(exist_ok=True)
    (tmp_path / "made" / (name + ".gz" * packed)).write_bytes(gzip.compress(data) if packed else data)
    return str(tmp_path / "made")


ID = "00000000-0000-5000-8000-00000000000"


def test_segments_in_other_files_and_orders(spark, tmp_path):
    pages = {i: bytes(random.Random(i).randrange(256) for _ in range(3_000)) for i in range(4)}
    records = [r for i, body in pages.items() for r in response(f"{ID}{i}", i, "u", body, segment=500, chunk=64)]
    random.Random(9).shuffle(records)
    archive(tmp_path, "a", records[::2])
    path = archive(tmp_path, "b", records[1::2], packed=False)
    got = {r.page_id: (bytes(r.payload), r.problem) for r in op12_warc.read_pages(spark, path, payloads=True).collect()}
    assert got == {i: (body, None) for i, body in pages.items()}


def test_broken_archives(spark, tmp_path):
    body = b"x" * 2_000
    cut = {i: list(response(f"{ID}{i}", i, "u", body, segment=600)) for i in range(6)}
    del cut[1][1]  # a segment in the middle
    del cut[2][-1]  # the last one
    del cut[3][0]  # the first one
    cut[4].append(cut[4][1])
    cut[5][1] = cut[5][1].replace(b"x", b"y", 1)
    path = archive(tmp_path, "a", [r for rs in cut.values() for r in rs])
    archive(tmp_path, "b", [record("response", ID + "6", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc", Page_ID=6), record("response", ID + "7", b"HTTP/1.1 200 OK\r\n\r\nplain", Page_ID=7), record("revisit", ID + "8", b"HTTP/1.1 200 OK\r\n\r\n", Page_ID=8, WARC_Refers_To=f"<urn:uuid:{ID}9>"), record("warcinfo", ID + "a", b"software: none")])
    found = op12_warc.read_pages(spark, path)
    got = {r.record_id[-1]: r.problem for r in found.collect()}
    assert got == {"0": None, "1": "segment 2 is missing", "2": "last segment is missing", "3": "segment 1 is missing", "4": "segment 2 is repeated", "5": "payload digest differs", "6": "framing ends early", "7": None, "8": None, "a": None}
    assert {r.page_id: r.problem for r in op12_warc.pages_of(found).collect()}[8] == "the record that is named is missing"


@pytest.mark.parametrize("step", [1, 2, 7, 10_000])
def test_chunked_framing(step):
    payload = bytes(random.Random(step).randrange(256) for _ in range(500))
    for raw in (b"H: 1\r\nTransfer-Encoding: chunked\r\n\r\n" + framed(payload, 61), b"Transfer-Encoding:chunked\r\n\r\n1f4;name=value\r\n" + payload + b"\r\n000\r\nTrailer: 1\r\n\r\n"):
        d = Chunked()
        assert b"".join(b"".join(d.feed(raw[i : i + step])) for i in range(0, len(raw), step)) == payload and d.ended() is None
    for bad in (b"X: 1\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n", b"Transfer-Encoding: chunked\r\n\r\n2\r\nabc\r\n0\r\n\r\n", b"Transfer-Encoding: chunked\r\n\r\n0\r\n\r\nmore"):
        d = Chunked()
        list(d.feed(bad))
        assert d.ended()

"""Secret scans: fixed base patterns plus a token-efficiency test.

The base finds assignments, access keys and long hex runs. The method looks at every longer run of
key-like characters: random strings cost many tokens, so a low number of characters per token under
a tiktoken vocabulary exposes them. It is taken of the whole run and, where that is calm, of each
stretch between its word-like parts (words and numbers that cost few tokens), so a key behind a
path is seen. Of a run that base spans cut, every piece outside them is tested by itself, from
``LEAST_REST`` characters on, so that no remainder of a secret stays. Known digests (32, 40, 56, 64, 96 or 128 hex characters),
UUIDs, dates and times as they stand in names, numbers and word-like identifiers are left out. An identifier is word-like when each part
between separators is a name (one case, capitalised or camel case, four digits at the end at most)
without five consonants in a row, y being a vowel; letters of one case from ``LEAST_RUN`` on count as random
beyond that where they cost at most ``DENSE`` characters a token, which words do not. Keys without digits count like others. A key
glued to words without a separator is seen only if the whole part's ratio is low.

Offsets are code points, ends exclusive; spans of one start tie and follow the kinds' order. Runs
longer than ``SLICE`` are tokenised in slices of that length, so time is linear in the text, very
long ones included. Defined cases: null or empty text has no span; repeated rows repeat; an empty
table gives an empty result; other columns, whatever their names, are ignored by ``scan`` and kept
by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_rows
from .worker import kept

KINDS = ("assign", "access", "hex", "token")
MOST_CHARS_PER_TOKEN, DENSE, LEAST_RUN, LEAST_REST, SLICE = 2.1, 1.75, 20, 8, 1024
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the longest runs, since a run of 24 starts at its run's start
WORDS = re.compile(r"password|passwd|secret|token|api", re.ASCII | re.IGNORECASE)
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
DIGEST = re.compile(r"(?i)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z")
UUID = re.compile(r"(?i)[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\Z")
#: Dates, with or without a time of day, as they stand in names of files and jobs.
STAMP = re.compile(r"(?<![0-9A-Za-z])[12][0-9]{3}[-_]?[01][0-9][-_]?[0-3][0-9](?:[T_-][0-2][0-9][-_]?[0-5][0-9](?:[-_]?[0-5][0-9])?Z?)?(?![0-9A-Za-z])")
PARTS, PART = re.compile(r"[_/=+-]+"), re.compile(r"[^_/=+-]+")
CLUSTER = re.compile(r"(?i)[b-df-hj-np-tv-xz]{5}")
NAME = re.compile(r"[A-Z]?[a-z]{2,}(?:[A-Z][a-z]+)*[0-9]{0,4}\Z|[A-Z]+[0-9]{0,4}\Z|[0-9]*\Z")


def vocabulary(path: str):
    return kept(("vocabulary", path), lambda: _vocabulary(path))


def _vocabulary(path: str):
    import public_tokenizers as P
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base findings, sorted."""
    out = []
    if WORDS.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_name(part: str) -> bool:
    return bool(NAME.match(part)) and not CLUSTER.search(part)


def chars_per_token(run: str, encoding) -> float:
    return len(run) / sum(len(encoding.encode_ordinary(run[i : i + SLICE])) for i in range(0, len(run), SLICE))


def is_dense(part: str, encoding) -> bool:
    """Whether long letters of one case cost so many tokens that no word does."""
    return len(part) >= LEAST_RUN and (part.islower() or part.isupper()) and chars_per_token(part, encoding) <= DENSE


def is_random(run: str, encoding) -> bool:
    """Whether a run has letters, is no digest, time or identifier, and costs many tokens."""
    if not any(map(str.isalpha, run)) or DIGEST.match(run) or UUID.match(run):
        return False
    if all(is_name(p) and not is_dense(p, encoding) for p in PARTS.split(STAMP.sub("", run))):
        return False
    return chars_per_token(run, encoding) <= MOST_CHARS_PER_TOKEN


def stretches(run: str, encoding) -> Iterator[tuple[int, int]]:
    """The longest stretches of a run's parts that hold no word-like part."""
    start = end = None
    for m in PART.finditer(run):
        part = m[0]
        if is_name(part) and len(part) >= 4 and (part.isdigit() or chars_per_token(part, encoding) > MOST_CHARS_PER_TOKEN):
            if start is not None:
                yield start, end
            start = None
        else:
            start, end = m.start() if start is None else start, m.end()
    if start is not None:
        yield start, end


def outside(covered: list[tuple[int, int]], at: int, start: int, stop: int) -> tuple[int, list[tuple[int, int]]]:
    """(first interval that may reach beyond ``start``, pieces of start..stop outside the intervals).

    ``covered`` are disjoint and sorted; ``at`` is what the call for an earlier run returned.
    """
    while at < len(covered) and covered[at][1] <= start:
        at += 1
    pieces, j = [], at
    while j < len(covered) and covered[j][0] < stop:
        pieces.append((start, covered[j][0]))
        start = covered[j][1]
        j += 1
    return at, [(a, z) for a, z in [*pieces, (start, stop)] if a < z]


def spans(text: str | None, encoding) -> list[tuple[int, int, int]]:
    """Base and token-efficiency spans, sorted by start, then kind."""
    if not text:
        return []
    found = base_spans(text)
    covered: list[tuple[int, int]] = []
    for a, _, z in found:
        if covered and a <= covered[-1][1]:
            covered[-1] = covered[-1][0], max(z, covered[-1][1])
        else:
            covered.append((a, z))
    more, at = [], 0
    for m in RUN.finditer(text):
        at, pieces = outside(covered, at, m.start(), m.end())
        least = LEAST_RUN if pieces == [m.span()] else LEAST_REST
        for a, z in pieces:
            piece = text[a:z].strip("_/=+-") if least == LEAST_REST else text[a:z]
            a = text.index(piece, a)
            z = a + len(piece)
            if len(piece) < least:
                continue
            if is_random(piece, encoding):
                more.append((a, 3, z))
                continue
            more += [(a + x, 3, a + y) for x, y in stretches(piece, encoding) if y - x >= LEAST_RUN and y - x < len(piece) and is_random(piece[x:y], encoding)]
    return sorted(found + more)


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in found)


def _scan(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = vocabulary(path)
    for batch in batches:
        rows = []
        for i in range(0, batch.num_rows, 256):
            for doc, text in zip(batch.column(0).slice(i, 256).to_pylist(), batch.column(1).slice(i, 256).to_pylist(), strict=True):
                found = spans(text, enc)
                base = [s for s in found if s[1] < 3]
                n = [sum(k == j for _, k, _ in found) for j in range(4)]
                rows.append((doc, *n[:3], hashlib.sha256(told(base).encode()).hexdigest(), told(found), n[3]))
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)


def scan(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_token for every row; no shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scan(vocabulary_path, it), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long")


def redacted(text: str | None, encoding, mark: str = "[SECRET]") -> str | None:
    """``text`` with every span, merged where they overlap, replaced by ``mark``."""
    found = spans(text, encoding)
    if not found:
        return text
    out, at = [], 0
    for a, _, z in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join([*out, text[at:]])


def _redact(path: str, at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = vocabulary(path)
    for batch in batches:
        for i in range(0, batch.num_rows, 256):  # small slices: a batch of long texts stands in memory once
            part = batch.slice(i, 256)
            new = [redacted(t, enc) for t in part.column(at).to_pylist()]
            yield part.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))


def redact(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced; n_chars, if there, follows the new text."""
    at = docs.columns.index("text")
    out = map_rows(docs, lambda it: _redact(vocabulary_path, at, it))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Sequence packing by minimum bin slack.

A document's ids (plus the end id) are cut into full sequences of ``capacity`` and one remainder.
Remainders wait in a window; each sequence takes the longest waiting remainder and then the
multiset of others that comes closest to the capacity: a subset-sum dynamic program over Python
integers used as bitsets, counts taken by binary splitting, stopped as soon as the capacity is
reached and backtracked into counts. Every task packs its own documents; texts and ids are never
shuffled. What a task's last window cannot fill well (sequences with more than ``SLACK`` left
over) stays loose, and the loose remainders of all tasks, a few numbers each, are packed again
together, so the fill does not depend on the number of tasks. sequence_id holds the task in its
high 32 bits and the second round in bit 62.

Defined cases: null or empty text is one end id; very long texts are cut into full sequences;
remainders of equal length tie and the last one added goes first; repeated rows are packed as
often as they occur; null doc_id is kept; an empty table gives no piece; only doc_id and text are
read, so no other column's name can clash.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import landed
from .words import MEMO, encoder

CAPACITY, WINDOW, END_ID = 4096, 2048, 2
SLACK, LOOSE_ROWS, SECOND = 16, 50_000, 1 << 62
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [p.split()[0] for p in PIECES.split(", ")]


def closest_multiset(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times) of a multiset within ``counts`` whose sum is the largest that is <= room.

    ``lengths`` ascends; longer ones are tried first.
    """
    if room <= 0:
        return []
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, trail = 1, []
    for i in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
        n = lengths[i]
        left, k = min(counts[n], room // n), 1
        while left > 0 and not reach & goal:
            k = min(k, left)
            trail.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left, k = left - k, 2 * k
        if reach & goal:
            break
    t = reach.bit_length() - 1
    took = []
    for n, k, before in reversed(trail):
        if not before >> t & 1:
            took.append((n, k))
            t -= n * k
    return took


class Packer:
    """Window of remainders of one task; refs are opaque."""

    def __init__(self, capacity: int = CAPACITY, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.lengths: list[int] = []
        self.refs: dict[int, list] = {}
        self.counts: dict[int, int] = {}
        self.waiting = 0

    def add(self, length: int, ref) -> None:
        if length not in self.counts:
            bisect.insort(self.lengths, length)
            self.refs[length], self.counts[length] = [], 0
        self.refs[length].append(ref)
        self.counts[length] += 1
        self.waiting += 1

    def _take(self, length: int):
        self.counts[length] -= 1
        self.waiting -= 1
        ref = self.refs[length].pop()
        if not self.counts[length]:
            del self.lengths[bisect.bisect_left(self.lengths, length)], self.refs[length], self.counts[length]
        return ref

    def sequences(self, down_to: int) -> Iterator[list[tuple[int, object]]]:
        """Filled sequences, until at most ``down_to`` remainders wait."""
        while self.waiting > down_to:
            n = self.lengths[-1]
            out = [(n, self._take(n))]
            for m, k in closest_multiset(self.lengths, self.counts, self.capacity - n):
                out += [(m, self._take(m)) for _ in range(k)]
            yield out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def _placed(pieces: list[tuple[int, tuple]], sequence: int | None) -> Iterator[tuple]:
    at = 0
    for n, (doc, start, crc, total) in pieces:
        yield doc, start, n, crc, total, sequence, None if sequence is None else at
        at += n


def _pack(path: str, end_id: int, capacity: int, window: int, memo: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path, memo), np.array([end_id], "<u4").tobytes()
    packer, task, sequence, rows = Packer(capacity, window), TaskContext.get().partitionId() << 32, 0, []

    def drain(down_to: int, slack: int) -> None:
        nonlocal sequence
        for pieces in packer.sequences(down_to):
            full = capacity - sum(n for n, _ in pieces) <= slack
            rows.extend(_placed(pieces, task + sequence if full else None))
            sequence += full

    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1)
        for i in range(0, len(keys), 256):
            for k, p in zip(keys[i : i + 256], enc.encode(texts.slice(i, 256).to_pylist()), strict=True):
                raw = memoryview(p + end)
                total = len(raw) // 4
                full = total // capacity * capacity
                for s in range(0, full, capacity):
                    rows.append((k, s, capacity, zlib.crc32(raw[4 * s : 4 * (s + capacity)]), total, task + sequence, 0))
                    sequence += 1
                if total > full:
                    packer.add(total - full, (k, full, zlib.crc32(raw[4 * full :]), total))
            if packer.waiting > window:
                drain(window // 2, capacity)
        if len(rows) >= 10_000:
            yield _batch(rows)
            rows.clear()
    drain(0, SLACK)
    yield _batch(rows)


def _pack_loose(capacity: int, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer, task, sequence, rows = Packer(capacity, window), SECOND + (TaskContext.get().partitionId() << 32), 0, []

    def drain(down_to: int) -> None:
        nonlocal sequence
        for pieces in packer.sequences(down_to):
            rows.extend(_placed(pieces, task + sequence))
            sequence += 1

    for batch in batches:
        for doc, start, n, crc, total in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            packer.add(n, (doc, start, crc, total))
            if packer.waiting > window:
                drain(window // 2)
        if len(rows) >= 10_000:
            yield _batch(rows)
            rows.clear()
    drain(0)
    yield _batch(rows)


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, window: int = WINDOW, memo: int = MEMO) -> DataFrame:
    """Pieces of all documents with their sequence and offset (columns in ``PIECES``).

    ``memo`` bounds the encoder's memory in a worker.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = landed(rows.mapInArrow(lambda it: _pack(tokenizer, end_id, capacity, window, memo, it), PIECES), "pieces")
    loose = first.where("sequence_id is null").select(*_NAMES[:5])
    n = loose.count()
    if not n:
        return first
    # dealt and ordered by their values, so a task that runs again packs alike
    dealt = loose.repartition(-(-n // LOOSE_ROWS), F.xxhash64(*_NAMES[:5])).sortWithinPartitions(F.xxhash64(*_NAMES[:5]), *_NAMES[:5])
    return first.where("sequence_id is not null").unionByName(dealt.mapInArrow(lambda it: _pack_loose(capacity, window, it), PIECES))

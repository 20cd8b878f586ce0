"""Token-id shards compressed by Re-Pair grammars, with random-access decoding.

A shard block holds the ids of consecutive documents. Re-Pair replaces frequent neighbouring
pairs by new symbols until none is left that occurs ``MIN_COUNT`` times; counts are exact, and the
most frequent pairs of a round become rules together, which keeps a round a handful of vector
passes. No rule crosses a document end, so every document starts on a symbol of the block. Rules store the length of their
expansion, so any id range decodes by a search in summed lengths and one partial expansion.

Blocks are rows of a Parquet table (columns in ``BLOCK_SCHEMA``): Spark's writer commits them, so
lost tasks leave nothing behind and any file system works.

Defined cases: null text is empty (only the end id); rows with one doc_id are ordered by a hash of
the text and then the text, and a hot doc_id (null too) is split over tasks by that hash; null
doc_id sorts first; a very long text is one block of its own size; an empty table gives no block;
only doc_id and text are read, so no other column's name can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import landed, small_or_shuffled
from .words import encoder

MIN_COUNT, STEP, HASH_BITS = 8, 0.02, 18
BLOCK_TOKENS = 1 << 19
END_ID = 2
_LOW = np.uint64(0xFFFFFFFF)
BLOCK_SCHEMA = (
    "shard int, block int, before long, n_tokens long, doc_ids array<long>, doc_tokens binary, doc_symbols binary, "
    "base int, rules binary, rule_lengths binary, width int, symbols binary"
)


def numbered(key: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, number of each key): a slot's last key by one look-up, the others by sorting."""
    if len(key) < 1 << HASH_BITS - 4:
        return np.unique(key, return_inverse=True)
    held, used = np.empty(1 << HASH_BITS, key.dtype), np.zeros(1 << HASH_BITS, bool)
    held[slot], used[slot] = key, True
    rest = np.flatnonzero(held.take(slot) != key)
    of, distinct = (np.cumsum(used, dtype=np.int32) - 1).take(slot), held[used]
    if len(rest):
        more, inverse = np.unique(key[rest], return_inverse=True)
        of[rest] = len(distinct) + inverse
        distinct = np.concatenate([distinct, more])
    return distinct, of


def repeated_pairs(seq: np.ndarray, at: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pairs as one integer each, their exact counts, places, pair of each place, whether it counts) of pairs seen ``min_count`` times or more.

    ``at`` are the places to look at. Of overlapping occurrences of one pair (a run of one symbol)
    every other counts. A hash only leaves out places whose pair is surely too rare.
    """
    left, right = seq.take(at), seq.take(at + 1)
    slot = ((left * np.uint32(2654435761) ^ right * np.uint32(2246822519)) * np.uint32(3266489917) >> np.uint32(32 - HASH_BITS)).astype(np.intp)
    may = np.flatnonzero((np.bincount(slot, minlength=1 << HASH_BITS) >= min_count).take(slot))
    at, left, right = at.take(may), left.take(may), right.take(may)
    pair, of = numbered(left.astype(np.uint64) << np.uint64(32) | right, slot.take(may))
    counts = np.ones(len(at), bool)
    twin = np.flatnonzero(left == right)
    if len(twin):
        starts = np.r_[True, (np.diff(at[twin]) > 1) | (np.diff(of[twin]) != 0)]
        place = np.arange(len(twin))
        counts[twin[(place - np.maximum.accumulate(np.where(starts, place, 0))) % 2 == 1]] = False
    count = np.bincount(of, minlength=len(pair)) - np.bincount(of[~counts], minlength=len(pair))
    often = np.flatnonzero((count >= min_count).take(of))
    return pair, count, at.take(often), of.take(often), counts.take(often)


def repair(ids: np.ndarray, last: np.ndarray, base: int, min_count: int = MIN_COUNT, step: float = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, last-of-document flags, rules of shape (k, 2)); symbol ``base + i`` stands for rule i.

    Rounds go on until no pair is seen ``min_count`` times. A round takes the pairs at least ``step``
    times as frequent as its most frequent one; where two overlap, the more frequent one's place is
    replaced, and a pair that keeps fewer than ``min_count`` places waits for the next round. The
    most frequent pair loses no place, so every round makes a rule. Pairs only become rarer but for
    those with a new symbol, so a round looks at the places of the last one's frequent pairs and
    beside its new symbols.
    """
    seq, last = ids.astype(np.uint32), last.copy()
    rules: list[np.ndarray] = []
    n_rules, look = 0, np.flatnonzero(~last[:-1])  # a pair over a document's end does not count
    while len(look):
        pair, count, at, of, counts = repeated_pairs(seq, look, min_count)
        if not len(at):
            break
        chosen = np.flatnonzero(count >= max(min_count, int(count.max() * step)))
        chosen = chosen[np.lexsort((pair[chosen], -count[chosen]))]
        rank = np.full(len(pair), -1, np.int32)
        rank[chosen] = np.arange(len(chosen))
        again = np.zeros(len(seq), bool)
        again[at] = True
        mine = rank.take(of)
        could = np.flatnonzero((mine >= 0) & counts)
        at, mine = at.take(could), mine.take(could)
        close = np.diff(at) == 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~(close & (mine[1:] >= mine[:-1]))
        wins[:-1] &= ~(close & (mine[:-1] > mine[1:]))
        won = np.flatnonzero(wins)
        made = np.bincount(mine.take(won), minlength=len(chosen)) >= min_count
        won = won[made.take(mine.take(won))]
        at, mine = at.take(won), mine.take(won)
        number = np.cumsum(made, dtype=np.uint32) + np.uint32(base + n_rules - 1)
        top = pair[chosen[made]]
        rules.append(np.stack([top >> np.uint64(32), top & _LOW], 1).astype(np.uint32))
        seq[at] = number[mine]
        last[at] |= last[at + 1]
        again[at] = again[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        # the place before a removed symbol is the new symbol's, and before that may lie another new one
        kept = np.flatnonzero(keep)  # a gather by places is faster than three by a mask
        seq, last, again = seq.take(kept), last.take(kept), again.take(kept)
        n_rules += len(top)
        look = np.flatnonzero(again[:-1] & ~last[:-1])
    return seq, last, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; a rule refers only to earlier ones."""
    inner = rules >= base
    to = np.where(inner, rules.astype(np.int64) - base, 0)
    out = np.full(len(rules), 2, np.int64)
    while len(rules) and not np.array_equal(out, new := np.where(inner, out[to], 1).sum(1)):
        out = new  # one pass for every level of nesting
    return out


class Grammar:
    """Decoder of one block's symbols."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, base: int):
        flat = rules.ravel().astype(np.uint32)
        while (big := flat >= base).any():  # one pass for every level of nesting
            out = np.repeat(flat, np.where(big, 2, 1))
            first = np.flatnonzero(big) + np.arange(int(big.sum()))
            pairs = rules[flat[big].astype(np.int64) - base]
            out[first], out[first + 1] = pairs[:, 0], pairs[:, 1]
            flat = out
        # every symbol's expansion, plain ids included, one after the other
        self.flat = np.concatenate([np.arange(base, dtype=np.uint32), flat])
        self.lengths = np.concatenate([np.ones(base, np.int32), lengths.astype(np.int32)])
        self.at = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int32)

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        return self.lengths[symbols]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.intp)
        size = self.lengths[symbols]
        ends = np.cumsum(size, dtype=np.int32)
        at = np.repeat(self.at[symbols] - (ends - size), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.flat[at]

    def slice(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of a document or block without decoding the rest."""
        ends = np.cumsum(self.sizes(symbols), dtype=np.int64)
        i, j = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        before = int(ends[i - 1]) if i else 0
        return self.expand(symbols[i : j + 1])[start - before : stop - before]


def pack_block(shard: int, block: int, before: int, ids: list, parts: list[bytes], base: int) -> dict:
    counts = np.array([len(p) // 4 for p in parts], np.int64)
    flat = np.frombuffer(b"".join(parts), "<u4")
    last = np.zeros(len(flat), bool)
    last[np.cumsum(counts) - 1] = True
    seq, ends, rules = repair(flat, last, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    return {
        "shard": shard, "block": block, "before": before, "n_tokens": len(flat), "doc_ids": ids,
        "doc_tokens": counts.astype("<u4").tobytes(), "doc_symbols": np.diff(np.r_[-1, np.flatnonzero(ends)]).astype("<u4").tobytes(),
        "base": base, "rules": rules.astype("<u4").tobytes(), "rule_lengths": rule_lengths(rules, base).astype("<u4").tobytes(),
        "width": width, "symbols": seq.astype(f"<u{width}").tobytes(),
    }


def unpack_block(row: dict) -> tuple[Grammar, np.ndarray, np.ndarray, np.ndarray]:
    """(grammar, symbols, ids per document, symbols per document) of a stored block."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    g = Grammar(rules, np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64), row["base"])
    return g, np.frombuffer(row["symbols"], f"<u{row['width']}"), np.frombuffer(row["doc_tokens"], "<u4"), np.frombuffer(row["doc_symbols"], "<u4")


_ARROW_BLOCK = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_tokens", pa.binary()), ("doc_symbols", pa.binary()), ("base", pa.int32()), ("rules", pa.binary()), ("rule_lengths", pa.binary()),
    ("width", pa.int32()), ("symbols", pa.binary()),
])


def _blocks(path: str, end_id: int, block_tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    base = max(enc.tok.get_vocab_size(), end_id + 1)
    shard, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
    ids, parts, held, block, before = [], [], 0, 0, 0
    for batch in batches:
        keys = batch.column(0).to_pylist()
        texts = batch.column(1)
        for i in range(0, len(keys), 256):
            for k, p in zip(keys[i : i + 256], enc.encode(texts.slice(i, 256).to_pylist()), strict=True):
                ids.append(k)
                parts.append(p + end)
                held += len(p) // 4 + 1
                if held >= block_tokens:
                    yield pa.RecordBatch.from_pylist([pack_block(shard, block, before, ids, parts, base)], _ARROW_BLOCK)
                    before, block, ids, parts, held = before + held, block + 1, [], [], 0
    if ids:
        yield pa.RecordBatch.from_pylist([pack_block(shard, block, before, ids, parts, base)], _ARROW_BLOCK)


def encode_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of all documents in ascending doc_id order (order: shard, block, place in the block)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return ordered.mapInArrow(lambda it: _blocks(tokenizer, end_id, block_tokens, it), BLOCK_SCHEMA)


def write_blocks(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Encode, write (to ``path``, else to the shared folder) and return the blocks as read back."""
    blocks = encode_blocks(docs, tokenizer, **options)
    if path is None:
        return landed(blocks, "token_blocks")
    blocks.write.parquet(path)
    return docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            g, symbols, tokens, _ = unpack_block(row)
            raw = memoryview(g.expand(symbols).astype("<u4").tobytes())
            ends = np.cumsum(tokens.astype(np.int64))
            first = ends - tokens
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(first + row["before"] + row["shard_start"]), pa.array(tokens.astype(np.int64)),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.int64()),
            ], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def document_digests(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from stored blocks."""
    totals = blocks.groupBy("shard").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per writing task
    starts = totals.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("shard_start"))
    joined = blocks.join(small_or_shuffled(starts), "shard")
    return joined.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _texts(start_stop: tuple[int, int | None], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            g, symbols, tokens, per_doc = unpack_block(row)
            ends = np.cumsum(per_doc.astype(np.int64))
            out = []
            for n, b, k in zip(tokens.tolist(), ends.tolist(), per_doc.tolist(), strict=True):
                stop = n if start_stop[1] is None else min(n, start_stop[1])
                out.append(g.slice(symbols[b - k : b], start_stop[0], stop).astype(np.int64) if start_stop[0] < stop else [])
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_ids(blocks: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """Ids ``start..stop`` of every document by random access, without expanding the rest."""
    return blocks.mapInArrow(lambda it: _texts((start, stop), it), "doc_id long, ids array<long>")

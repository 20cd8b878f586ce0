"""Near-duplicate documents by MinHash with odd sketches.

One pass over the texts gives each document the digest of its set of word shingles, ``BANDS`` band
keys of MinHash samples and an odd sketch: every sample toggles one bit, so the population count
of two sketches' XOR estimates how many samples differ. Documents of one digest are one class.
Inside a band's bucket a breadth-first search over sketches connects classes that may be similar
(no pair is written, each class leaves one edge), components of those edges are candidate
clusters, and each cluster is searched again on full shingle sets, which confirms every link. Hot
buckets and clusters are dealt into blocks (``connected``); two blocks meet only while their rows
are not in one component.

Recall: at similarity 0.8 one of 24 bands of 5 samples agrees with probability 1 - 7e-5, at 0.85
with 1 - 8e-7; the sketch threshold follows the similarity asked for and lies four standard
deviations beyond its expected count.

Defined cases: null, empty or blank texts have an empty set and never link; fewer words than a
shingle make one shingle of all; repeated rows share a class; rows of one doc_id with different
texts are judged apart, each by its own text; rows of null doc_id link like others, but a
component without any id is null and nothing of it is kept; ties cannot occur, since a component
is named by its smallest id; very long texts count whole (a block of one document may pass
``SET_BLOCK``); an empty table gives an empty result. Only doc_id and text are read, under their
own names, so no other column's name can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, search
from .groups import bounds, map_groups
from .store import discard, landed, row_keys, small_or_shuffled
from .words import words_of
from .worker import kept

SHINGLE, BANDS, ROWS, BITS, SEED = 5, 24, 5, 512, 11
SIMILAR = (80, 100)
SKETCH_BLOCK, SET_BLOCK = 4_096, 500_000
_rng = np.random.default_rng(SEED)
_MULT = (_rng.integers(0, 2**32, 1024, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_FLIP = _rng.integers(0, 2**32, 1024, dtype=np.uint64).astype(np.uint32)


def _hash_words(words: list[bytes]) -> np.ndarray:
    memo = kept("word hashes", dict)
    if len(memo) > 120_000:
        memo.clear()
    try:
        got = list(map(memo.__getitem__, words))
    except KeyError:
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        got = list(map(memo.__getitem__, words))
    return np.array(got, np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = _hash_words(words)
    n = max(1, len(h) - k + 1)
    acc = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        acc = _mix(acc + h[i : i + n] + np.uint64(i + 1))
    return np.unique(acc)


def min_hashes(s: np.ndarray, count: int) -> np.ndarray:
    """MinHash samples of a set, each a seeded permutation of its 32-bit images."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, ((x[None, i : i + 2048] ^ _FLIP[:count, None]) * _MULT[:count, None]).min(1), out=out)
    return out


def odd_sketch(samples: np.ndarray, bits: int = BITS) -> bytes:
    at = _mix(samples.astype(np.uint64) * np.uint64(len(_MULT)) + np.arange(len(samples), dtype=np.uint64)) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.intp), minlength=bits) & 1 != 0).tobytes()


def sketch_threshold(similar: float, samples: int, bits: int) -> int:
    """XOR counts up to this may belong to a pair of at least this similarity (four deviations)."""
    toggles = 2 * (samples * (1 - similar) + 4 * math.sqrt(samples * similar * (1 - similar)))
    return math.ceil(bits / 2 * (1 - (1 - 2 / bits) ** toggles) + math.sqrt(toggles))


def _sketches(shingle: int, bands: int, rows: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for i in range(0, len(texts), 256):
            n, digest, keys, sketch = [], [], [], []
            ids = [batch.column(c).slice(i, 256) for c in (0, 2, 3)]
            for t in texts.slice(i, 256).to_pylist():
                s = shingle_set(t, shingle)
                n.append(len(s))
                if not len(s):
                    digest.append(None), keys.append(None), sketch.append(None)
                    continue
                m = min_hashes(s, bands * rows)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                band = np.zeros(bands, np.uint64)
                for r in m.reshape(bands, rows).T:
                    band = _mix(band + r.astype(np.uint64) + np.uint64(1))
                keys.append(band.astype("<u8").tobytes())
                sketch.append(odd_sketch(m, bits))
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary())],
                names=["doc_id", "k1", "k2", "n_shingles", "digest", "bands", "sketch"],
            )


_POP = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _edges(rep: np.ndarray, label: np.ndarray) -> Iterator[dict]:
    for u, v in zip(rep.tolist(), rep[label].tolist(), strict=True):
        if u != v:
            yield {"u": u, "v": v}


def _sketch_groups(limit: int, table: pa.Table) -> Iterator[dict]:
    """Edges between classes of a bucket whose sketches differ in at most ``limit`` bits."""
    reps = table.column("cid").to_numpy()
    s = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(reps), -1)
    groups = bounds(table, 4)
    pairs = np.array([a for a, z in groups if z - a == 2], np.int64)
    near = pairs[_POP[s[pairs] ^ s[pairs + 1]].sum(1, dtype=np.int64) <= limit] if len(pairs) else pairs
    for u, v in zip(reps[near + 1].tolist(), reps[near].tolist(), strict=True):
        if u != v:
            yield {"u": u, "v": v}
    for a, z in groups:
        if z - a > 2:
            x = s[a:z]
            yield from _edges(reps[a:z], search(z - a, lambda i, others, x=x: _POP[x[others] ^ x[i]].sum(1, dtype=np.int64) <= limit))


def _confirm_groups(similar: tuple[int, int], shingle: int, table: pa.Table) -> Iterator[dict]:
    reps, texts = table.column("cid").to_numpy(), table.column("text")
    for a, z in bounds(table, 3):
        sets = [shingle_set(t, shingle) for t in texts.slice(a, z - a).to_pylist()]
        yield from _edges(reps[a:z], confirmed(sets, similar))


def confirmed(sets: list[np.ndarray], similar: tuple[int, int]) -> np.ndarray:
    """Component labels of sets under exact similarity links."""
    size = np.array([len(s) for s in sets])
    flat, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.concatenate([[0], np.cumsum(size)])
    marks = np.zeros(len(flat), bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        mine = inverse[start[i] : start[i + 1]]
        marks[mine] = True
        fit = (size[others] * similar[1] >= size[i] * similar[0]) & (size[i] * similar[1] >= size[others] * similar[0])
        at = others[fit]
        out = np.zeros(len(others), bool)
        if len(at):
            n = size[at]
            pick = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            common = np.add.reduceat(marks[inverse[pick]].astype(np.int64), np.cumsum(n) - n)
            out[fit] = similar[1] * common >= similar[0] * (size[i] + n - common)
        marks[mine] = False
        return out

    return search(len(sets), near)


def connected(rows: DataFrame, keys: list[str], payload: Callable[[DataFrame], DataFrame], columns: list[str], of: Callable[[pa.Table], Iterator[dict]]) -> DataFrame:
    """(node, component) of ``rows(keys, cid, blocks)`` under the links that ``of`` finds inside groups.

    A group is dealt into blocks by its rows' ids. Blocks are searched alone first, then with their
    neighbours, then every two blocks whose rows are not all in one component yet. So no two rows
    of different components stay uncompared, and a dense group travels about three times whatever
    its size. ``payload`` joins what ``of`` reads to the dealt rows.
    """
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("cid", F.lit(3)), "blocks").cast("int"))

    def searched(dealt: DataFrame, name: str) -> DataFrame:
        return landed(map_groups(payload(dealt), [*keys, "lo", "hi"], ["cid", *columns], of, "u long, v long", _EDGES), name)

    links = searched(rows.select(*keys, "cid", F.col("mine").alias("lo"), F.col("mine").alias("hi")), "links")
    comp = components(links)
    discard(links)
    big = rows.where("blocks > 1")
    if big.isEmpty():
        return comp
    for far in (False, True):
        at = big.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("c", F.coalesce("component", "cid"))
        block = landed(at.groupBy(*keys, "mine").agg(F.min("c").alias("least"), F.max("c").alias("most")), "blocks")
        a, b = (block.select(*keys, F.col("mine").alias(end), F.col("least").alias(f"{end}_least"), F.col("most").alias(f"{end}_most")) for end in ("lo", "hi"))
        pair = a.join(b, keys).where(F.col("hi") > F.col("lo") + 1 if far else F.col("hi") == F.col("lo") + 1)
        pair = pair.where(F.least("lo_least", "hi_least") < F.greatest("lo_most", "hi_most")).select(*keys, "lo", "hi", F.explode(F.array("lo", "hi")).alias("mine"))
        links = searched(big.join(pair, [*keys, "mine"]).select(*keys, "cid", "lo", "hi"), "links")
        old, comp = comp, components(links.union(comp.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        discard(links, block, old)
    return comp


def _found(docs: DataFrame, keys: list[Column], similar: tuple[int, int], shingle: int, bands: int, rows: int, bits: int) -> DataFrame:
    """doc_id, k1, k2, n_shingles, root (of the component; null without words), component_id of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), keys[0].alias("k1"), keys[1].alias("k2"))
    signed = landed(base.mapInArrow(lambda it: _sketches(shingle, bands, rows, bits, it), "doc_id long, k1 long, k2 long, n_shingles long, digest binary, bands binary, sketch binary"), "signed")
    limit = sketch_threshold(similar[0] / similar[1], bands * rows, bits)
    cls = signed.where("digest is not null").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct("k1", "k2")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    cls = landed(cls.withColumn("cid", F.monotonically_increasing_id()), "classes")
    split = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.substring("bands", b * 8 + 1, F.lit(8)).alias("key")))
    at = cls.select("cid", F.explode(split).alias("w")).select("cid", "w.band", "w.key")
    print_of = lambda seed: F.sum(F.xxhash64("cid", F.lit(seed)).cast("decimal(38,0)"))
    count = at.groupBy("band", "key").agg(F.count("*").alias("n"), print_of(0).alias("who"), print_of(1).alias("who2")).where("n > 1")
    # bands that gather the same classes ask the same question: one of them is enough
    count = count.groupBy("n", "who", "who2").agg(F.min(F.struct("band", "key")).alias("w")).select("n", "w.band", "w.key")
    shared = landed(at.join(count, ["band", "key"]).select("band", "key", "cid", F.ceil(F.col("n") / SKETCH_BLOCK).cast("int").alias("blocks")), "shared")
    sketches = cls.select("cid", "sketch")
    rough = connected(shared, ["band", "key"], lambda dealt: dealt.join(sketches, "cid"), ["sketch"], lambda t: _sketch_groups(limit, t))
    cluster = landed(rough.select(F.col("node").alias("cid"), F.col("component").alias("cluster")), "clusters")
    discard(shared, rough)
    load = cluster.join(cls.select("cid", "n_shingles"), "cid").groupBy("cluster").agg(F.sum("n_shingles").alias("load"))
    spread = landed(cluster.join(load, "cluster").select("cluster", "cid", F.ceil(F.col("load") / SET_BLOCK).cast("int").alias("blocks")), "spread")
    asked = landed(spread.join(cls.select("cid", "row.k1", "row.k2"), "cid").select("cid", "k1", "k2"), "asked")
    texts = base.join(small_or_shuffled(asked), ["k1", "k2"]).select("cid", "k1", "k2", "text")
    if not signed.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        texts = texts.dropDuplicates(["k1", "k2"])  # repeated rows stand for one
    sure = connected(spread, ["cluster"], lambda dealt: dealt.join(texts.select("cid", "text"), "cid"), ["text"], lambda t: _confirm_groups(similar, shingle, t))
    comp = sure.withColumnRenamed("node", "cid")
    least = cls.select("cid", "rep").join(comp, "cid").groupBy("component").agg(F.min("rep").alias("least"))
    known = cls.select("digest", "rep", "cid").join(comp, "cid", "left").join(least, "component", "left")
    known = known.select("digest", F.coalesce("component", "cid").alias("root"), F.coalesce("least", "rep").alias("least"))
    return signed.join(known, "digest", "left").select("doc_id", "k1", "k2", "n_shingles", "root", F.coalesce("least", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, similar: tuple[int, int] = SIMILAR, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Links: similar[1] * intersection >= similar[0] * union of shingle sets.
    """
    found = _found(docs, row_keys(docs.select("doc_id", "text")), similar, shingle, bands, rows, bits)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, similar: tuple[int, int] = SIMILAR, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """One row of every component of ``docs``: that of the smallest doc_id, null last; ties by a hash of the row.

    Decided by row, so different texts under one doc_id are judged apart and copies without doc_id
    go too. Rows without words all stay.
    """
    found = landed(_found(docs, row_keys(docs), similar, shingle, bands, rows, bits).where("root is not null"), "found")
    best = found.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("b")).where("n > 1")
    inside = landed(found.join(best.select("root", F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2")), "root").select("k1", "k2", ((F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2"))).alias("best")), "inside")
    gone = inside.where("not best").select("k1", "k2").distinct()
    repeated = inside.where("best").groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2")
    k1, k2 = row_keys(docs)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), k1.alias("k1"), k2.alias("k2"))
    out = keyed.join(small_or_shuffled(landed(gone.unionByName(repeated), "gone")), ["k1", "k2"], "left_anti")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(small_or_shuffled(repeated), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
    return out.select("record.*")

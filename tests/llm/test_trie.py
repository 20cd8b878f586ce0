"""Conversation prefix tries against a tree of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from batchloom.llm import op11_trie
from batchloom.llm.running import running

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def by_force(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        seq = turns.get(c - c % 100, [])[:h] + turns[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        below = [out[k] for k in kids[p]]
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(b[6] for b in below)
        ids = ",".join(map(str, sorted(ends[p])))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), sum(b[5] for b in below) if below else 1, saved, hashlib.sha256(ids.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def found(df, **how):
    return sorted((tuple(r[n] for n in NAMES) for r in op11_trie.trie(df, **how).collect()), key=repr)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 4 * n), n):
        copied = rng.choice(["", "x" * (c % 3)])
        rows += [(c, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", f"{t}{copied}" if rng.random() < 0.9 else f"{t} {c}") for t in range(rng.randint(1, longest))]
    return rows


@pytest.mark.parametrize(("seed", "longest", "chunk"), [(1, 8, 64), (3, 30, 2)])
def test_equals_brute_force(spark, seed, longest, chunk):
    rows = conversations(seed, 120, longest)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5), chunk=chunk) == by_force(rows)


def test_odd_conversations(spark):
    rows = [(None, 0, "user", "lost"), (3, None, None, None), (3, 1, "user", ""), (3, 1, "user", ""), (3, 1, "a", "b"), (7, 0, "user", "é" * 9), (7, 0, "user", "z"), (205, 0, "user", "x" * 300_000), (206, 0, "user", "x" * 300_000), (10**15, 5, "user", "q")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("pos", "depth", "h", "base", "at", "lo", "a.b")])
    assert found(df) == by_force(rows)
    assert found(df.limit(0)) == [] and found(df.where("conv_id is null")) == []


def test_only_turnless(spark):
    rows = [(c, 0, "user", "gone") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 6 > 0]
    want = by_force(rows)
    assert found(spark.createDataFrame(rows, SCHEMA)) == want and len(want) == 1


def test_a_long_conversation_spreads(spark):
    rows = [(4, t, "user", f"turn {t}") for t in range(3_000)] + [(5, t, "user", f"turn {t}") for t in range(2_500)] + [(6, t, "user", f"turn {min(t, 1234)}") for t in range(2_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == by_force(rows)


def test_running_crosses_ranges(spark):
    df = spark.range(5_000).select((F.col("id") % 3 * (F.col("id") % 7 == 0).cast("long")).alias("k"), F.col("id").alias("o"), F.col("id").alias("s"), (F.col("id") * 77).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.o: (r.k, r.s, r.x) for r in running(df, "k", ["o"], {"s": "sum", "x": "xor"}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums, xors = defaultdict(int), defaultdict(int)
    for i in range(5_000):
        k = i % 3 * (i % 7 == 0)
        sums[k], xors[k] = sums[k] + i, xors[k] ^ (i * 77)
        assert got[i] == (k, sums[k], xors[k])

"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchloom.llm import op13_spelling
from batchloom.llm.op13_spelling import Wavelet, near_in_bucket


def one_edit(u, v):
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v, strict=True)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def by_force(rows):
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += len(run) >= 5
    words = {w: n for w, n in words.items() if n >= 3}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def found(df, **how):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in op13_spelling.spelling(df, **how).collect())


@pytest.mark.parametrize("size", [60, 400, 1 << 17])
def test_equals_all_pairs(spark, size):
    rng = random.Random(60)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaaaa", "Éaaaaaaa", "ÀAAAAAAA", "aaaa×aaa"]
    rows = [(d, " ".join(rng.choice(base) + rng.choice(["", ".", "b", "A"]) for _ in range(90))) for d in range(60)]
    want = by_force(rows)
    assert any(r[1] for r in want) and any(r[2] != (r[1] or r[0]) for r in want)
    assert found(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), bucket_bytes=size) == want


def test_odd_texts(spark):
    long = "x" * 3_000
    rows = [(0, None), (1, ""), (None, "Grüße grüße GRÜSSE gruße"), (None, "Grüße grüße GRÜSSE gruße"), (None, "grüße gruße gruße 12 ab abcd"), (2, " ".join(["hello"] * 5 + ["hallo"] * 5 + ["hullo"] * 3)), (3, f"{long} {long}y {long}-{long}y {long}y {long}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit("x").alias(c) for c in ("word", "n", "run", "doc", "key", "a", "b", "m", "a.b")])
    assert found(df) == by_force(rows) == found(df, bucket_bytes=100)
    assert found(df.limit(0)) == [] and found(df.where("doc_id < 2")) == []


def test_every_pair_once_in_a_bucket():
    rng = random.Random(3)
    for kind in (0, 1):
        for m in (5, 6, 9):
            words = sorted({"".join(rng.choice("ab") for _ in range(m + (kind and rng.randrange(2)))) for _ in range(120)})
            rng.shuffle(words)
            counts = np.array([rng.randint(3, 6) for _ in words])
            ends = [0, m // 3, m // 2, m + kind]
            near = sum(near_in_bucket([w.encode() for w in words], counts, kind, m, a, b)[0] for a, b in zip(ends[:-1], ends[1:], strict=True))
            want = [sum(one_edit(w, x) and (len(w) != len(x)) == bool(kind) for x in words) for w in words]
            assert near.tolist() == want


def test_wavelet_reports_rectangles():
    rng = np.random.default_rng(4)
    for n in (1, 2, 8, 37, 64):
        seq = rng.permutation(n)
        tree = Wavelet(seq)
        lo, hi = np.sort(rng.integers(0, n + 1, (2, 50)), axis=0)
        value = rng.integers(0, n + 1, 50)
        assert tree.below(lo, hi, value).tolist() == [int((seq[a:b] < v).sum()) for a, b, v in zip(lo, hi, value, strict=True)]
        for a, b in zip(lo, hi, strict=True):
            k = np.arange(b - a)
            assert tree.smallest(np.full(len(k), a), np.full(len(k), b), k).tolist() == sorted(seq[a:b].tolist())

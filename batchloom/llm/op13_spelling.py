"""Spelling variants: words one edit apart, by two-dimensional range reporting over wavelet trees.

Words of one length are points: their rank in forward order and their rank in the order of reversed
words. For an edit position i the words that share w[:i] are an interval of the first order, those
that share the suffix behind it one of the second, and the points in that rectangle are exactly the
words that differ from w at i. A wavelet tree over the reverse ranks counts and reports them. For
insertions the points are the words that are one longer; a letter put into a run of equal letters
counts at the run's end only, so no pair is found twice.

Distribution: words are dealt by (kind, length, edit positions [a, b), hash of what is outside of
those positions), first for the two halves of the positions. Every pair meets in exactly one such
place. A key with too many bytes has its positions halved again until it fits; at one position it
holds at most one word per letter. Keys are then hashed into buckets of about ``BUCKET_BYTES``, each
one wavelet tree. Per word, numbers of near words and the best one leave a bucket, never pairs.

Roots follow forms by pointer doubling: a form has at least twice the word's occurrences.

Defined cases: null text has no run; a null doc_id is empty in the hashed text, so rows repeat
freely; very long runs are words like others and cost their length; ties of n go to the smallest word; a
text or table without words gives no row. Only doc_id and text are read, so no other column's name
can clash.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import bounds, map_groups
from .store import discard, landed, small_or_shuffled

RUN, LEAST_LENGTH, LEAST_COUNT, SLIPS, TIMES = "[A-Za-zÀ-ÿ]+", 5, 3, 97, 2
BUCKET_BYTES = 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with enough letters and occurrences."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), 0)).alias("run"))
    plain = F.octet_length("run") == F.char_length("run")  # lower() is meant for A-Z only
    lowered = runs.select("doc", F.when(plain, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    cut = lowered.where(F.char_length("run") >= LEAST_LENGTH).select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % SLIPS == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return cut.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Wavelet:
    """A wavelet tree over a permutation, one bit plane a level; all queries take arrays."""

    def __init__(self, seq: np.ndarray):
        self.levels: list[tuple[int, int, np.ndarray]] = []
        cur = seq
        for bit in range(max(1, int(len(seq)).bit_length()) - 1, -1, -1):
            ones = (cur >> bit) & 1
            zero_rank = np.concatenate([[0], np.cumsum(1 - ones)])
            self.levels.append((bit, int(zero_rank[-1]), zero_rank))
            cur = np.concatenate([cur[ones == 0], cur[ones == 1]])

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of places lo..hi hold less than value."""
        out = np.zeros(len(lo), np.int64)
        for bit, zeros, rank in self.levels:
            zl, zh = rank[lo], rank[hi]
            one = (value >> bit) & 1 == 1
            out += np.where(one, zh - zl, 0)
            lo, hi = np.where(one, zeros + lo - zl, zl), np.where(one, zeros + hi - zh, zh)
        return out

    def smallest(self, lo: np.ndarray, hi: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth smallest value (from 0) of places lo..hi."""
        out = np.zeros(len(lo), np.int64)
        for bit, zeros, rank in self.levels:
            zl, zh = rank[lo], rank[hi]
            one = nth >= zh - zl
            nth = np.where(one, nth - (zh - zl), nth)
            out |= one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros + lo - zl, zl), np.where(one, zeros + hi - zh, zh)
        return out


def _common(rows: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every row and the next."""
    differ = rows[1:] != rows[:-1]
    return np.where(differ.any(1), differ.argmax(1), rows.shape[1])


class _Order:
    """Words in one order, with the target intervals of their prefixes."""

    def __init__(self, letters: np.ndarray, target: np.ndarray):
        self.at = np.argsort(letters.view(f"S{letters.shape[1]}").ravel(), kind="stable")
        self.place = np.empty(len(self.at), np.int64)
        self.place[self.at] = np.arange(len(self.at))
        self.common = _common(letters[self.at])
        both = np.concatenate([[0], self.common, [0]])
        self.reach = np.maximum(both[1:], both[:-1])[self.place]  # the longest prefix shared with any word
        self.before = np.concatenate([[0], np.cumsum(target[self.at])])

    def intervals(self, words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks among targets that share the first ``length`` letters of each of ``words``."""
        edges = np.concatenate([[0], np.flatnonzero(self.common < length) + 1, [len(self.at)]])
        run = np.searchsorted(edges, self.place[words], "right")
        return self.before[edges[run - 1]], self.before[edges[run]]


def near_in_bucket(words: list[bytes], counts: np.ndarray, kind: int, m: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of near words, index of the best or -1) of every word under edits at positions a..b.

    kind 0: all words have m letters and replace one; kind 1: words of m letters gain one, those of m + 1 lose it.
    """
    n, width = len(words), m + kind
    size = np.array([len(w) for w in words])
    padded = np.array(words, f"S{width}")
    rank = np.lexsort((padded, -counts))
    standing = np.empty(n, np.int64)
    standing[rank] = np.arange(n)
    near, best = np.zeros(n, np.int64), np.full(n, n, np.int64)
    letters = padded.view(np.uint8).reshape(n, width)
    target = size == width
    ask = np.flatnonzero(size == m)
    if len(ask) and target.any():
        backward = letters[:, ::-1].copy()
        short = size < width
        backward[short] = np.roll(backward[short], -1, axis=1)  # padding stands at the end
        fore, back = _Order(letters, target), _Order(backward, target)
        seq_words = fore.at[target[fore.at]]
        back_rank = np.cumsum(target[back.at]) - 1
        by_back = back.at[target[back.at]]
        tree = Wavelet(back_rank[back.place[seq_words]])
        tail = m - 1 + kind  # letters before and behind the edit
        lowest, highest = np.maximum(a, tail - back.reach[ask]), np.minimum(b - 1, fore.reach[ask])
        live = lowest <= highest
        ask, lowest, highest = ask[live], lowest[live], highest[live]
        for i in range(int(lowest.min(initial=b)), int(highest.max(initial=-1)) + 1):
            q = ask[(lowest <= i) & (i <= highest)]
            if not len(q):
                continue
            lo, hi = fore.intervals(q, i)
            least, most = back.intervals(q, tail - i)
            under = tree.below(lo, hi, least)
            found = tree.below(lo, hi, most) - under
            some = found > 1 - kind  # a word of kind 0 always finds itself
            q, lo, hi, under, found = q[some], lo[some], hi[some], under[some], found[some]
            if not len(q):
                continue
            each = np.repeat(np.arange(len(q)), found)
            nth = under[each] + np.arange(len(each)) - np.repeat(np.cumsum(found) - found, found)
            other = by_back[tree.smallest(lo[each], hi[each], nth)]
            own = q[each]
            keep = own != other if kind == 0 else letters[own, i] != letters[other, i]
            own, other = own[keep], other[keep]
            near += np.bincount(own, minlength=n)
            np.minimum.at(best, own, standing[other])
            if kind:
                near += np.bincount(other, minlength=n)
                np.minimum.at(best, other, standing[own])
    return near, np.where(best < n, rank[np.minimum(best, n - 1)], -1)


_PLACE = ["kind", "m", "a", "b"]
_SCHEMA = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _buckets(table: pa.Table) -> Iterator[dict]:
    for start, stop in bounds(table, 5):
        kind, m, a, b = (table.column(c)[start].as_py() for c in range(4))
        texts = table.column("word").slice(start, stop - start).to_pylist()
        counts = table.column("n").slice(start, stop - start).to_numpy()
        near, best = near_in_bucket([t.encode("latin-1") for t in texts], counts, kind, m, a, b)
        for i in np.flatnonzero(near).tolist():
            yield {"word": texts[i], "n_near": int(near[i]), "best_n": int(counts[best[i]]), "best": texts[best[i]]}


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of (kind, m, a, b, long, word, n) with the hash of the letters that no edit at a..b touches."""
    skip = F.when((F.col("kind") == 1) & ~F.col("long"), F.col("b") - 1).otherwise(F.col("b"))
    return rows.withColumn("key", F.xxhash64(F.substring("word", F.lit(1), F.col("a")), F.substring("word", skip + 1, F.char_length("word"))))


def _halved(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(F.col("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b")))
    return rows.withColumn("half", F.explode(halves)).withColumns({"a": F.col("half.a"), "b": F.col("half.b")}).select(*_PLACE, "long", "word", "n")


def near_words(words: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words(word, n)`` that has a near word."""
    m = F.char_length("word")
    zero = F.lit(0)
    kinds = [(0, m, m, False), (1, m, m + 1, False), (1, m - 1, m, True)]
    rows = words.select("word", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), length.alias("m"), zero.alias("a"), end.alias("b"), F.lit(long).alias("long")) for k, length, end, long in kinds])).alias("p"))
    open_rows = _keyed(_halved(rows.select("p.*", "word", "n").where(f"m >= {LEAST_LENGTH}")))
    weight = F.col("m") + 1
    done, kept = [], []
    while True:
        heavy = landed(open_rows.groupBy(*_PLACE, "key").agg(F.count("*").alias("rows")).where((F.col("rows") * weight > bucket_bytes) & (F.col("b") - F.col("a") > 1)), "heavy")
        kept.append(heavy)
        if heavy.isEmpty():
            break
        known = small_or_shuffled(heavy.drop("rows"))
        done.append(open_rows.join(known, [*_PLACE, "key"], "left_anti"))
        open_rows = _keyed(_halved(open_rows.join(known, [*_PLACE, "key"], "left_semi")))
    for part in done:
        open_rows = open_rows.unionByName(part)
    loads = open_rows.groupBy(*_PLACE).agg(F.ceil(F.sum(weight) / bucket_bytes).alias("buckets"))
    dealt = open_rows.join(small_or_shuffled(landed(loads, "loads")), _PLACE).withColumn("bucket", F.pmod("key", "buckets"))
    found = map_groups(dealt, [*_PLACE, "bucket"], ["word", "n"], _buckets, "word string, n_near long, best_n long, best string", _SCHEMA)
    out = landed(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("x")).select("word", "n_near", (-F.col("x.minus")).alias("best_n"), F.col("x.best").alias("best")), "near")
    discard(*kept)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: where the way over forms ends."""
    state = landed(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(sys.maxsize.bit_length()):
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = landed(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(state)
        state = met
        if met.where("moved").isEmpty():
            break
    return state.select("word", "root")


def spelling(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    words = landed(vocabulary(docs), "words")
    near = near_words(words, bucket_bytes)
    known = landed(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("best_n") >= TIMES * F.col("n"), F.struct("best", "best_n")).alias("x")), "known")
    discard(words, near)
    known = known.select("word", "n", "n_near", F.col("x.best").alias("form"), F.col("x.best_n").alias("form_n"))
    root = roots(known.where("form is not null"))
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

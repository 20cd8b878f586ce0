"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, everything else is unlabelled (other labels only give the
class prior). A linear model over the presence of words, and of stems by how many words share them, minimises the risk of Kiryo et al. (2017):
prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]) with the sigmoid loss, by Adam in numpy
over at most ``MOST_POSITIVE`` + ``MOST_UNLABELLED`` rows (hash samples of the table, expected sizes).
Features are counted on the executors; the driver sees only those that stand out among positives.
Scoring reads every whole text once and shuffles nothing.

PULL, START and LEAST_Z were chosen by folds inside the training rows (``cross_validated``): the most
positives found with at most 0.4 % of the known clean rows flagged. Rows that are held out were looked
at once, afterwards.

Defined cases: null or empty text scores by the bias alone; very long texts score by all their
words; repeated rows score alike; a score of exactly 0.5 predicts 1; without a confirmed example
every score is half the prior, below 0.5; a doc_id with several labels takes the largest; a null
doc_id is held out of training; an empty table gives an empty result. Labels, lang, source and
doc_id never enter a score. Columns are read by their own names, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, landed, small_or_shuffled
from .words import letter_words

MOST_POSITIVE, MOST_UNLABELLED, LEAST_DOCS, LEAST_Z, LEAST_RATIO = 2_000, 6_000, 3, 6.0, 3.0
STEPS, RATE, PULL, START, FOLDS = 600, 0.05, 0.8, 1.0, 5
STEMS, MOST_REPEATS = (4, 5, 6, 7), 4


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _hash(x: bytes) -> int:
    return xxhash.xxh64_intdigest(x)


def stem_counts(words: set[bytes]) -> dict[bytes, int]:
    """Distinct words of a text by each of their beginnings of STEMS bytes; a word is longer than its stem."""
    return Counter(w[:n] for w in words for n in STEMS if len(w) > n)


def features(text: str | None) -> np.ndarray:
    """Sorted hashes of a whole text's distinct words, and of its stems with 1 to MOST_REPEATS or more words."""
    words = set(letter_words(text))
    stems = [_hash(b"%s\0%d" % (stem, k)) for stem, n in stem_counts(words).items() for k in range(1, min(n, MOST_REPEATS) + 1)]
    return np.array(sorted([*map(_hash, words), *stems]), "<u8")


class Model:
    """Weights by feature hash."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.of = dict(zip(keys.tolist(), weights.tolist(), strict=True))
        self.stems: dict[bytes, list[float] | None] = {}

    def stem(self, stem: bytes) -> list[float] | None:
        """Summed weights of a stem with 1, 2, ... words; None if it has none."""
        if stem not in self.stems:
            if len(self.stems) > 300_000:
                self.stems = {k: v for k, v in self.stems.items() if v}  # those that count are the model's
            got = [self.of.get(_hash(b"%s\0%d" % (stem, k)), 0.0) for k in range(1, MOST_REPEATS + 1)]
            self.stems[stem] = list(itertools.accumulate(got)) if any(got) else None
        return self.stems[stem]

    def score(self, texts: list[str | None], memo: dict[bytes, tuple]) -> list[float]:
        """``memo`` keeps each word's weight and those of its stems that count, between calls."""
        out = []
        for t in texts:
            words = set(letter_words(t))
            if fresh := words.difference(memo):
                if len(memo) > 300_000:
                    memo.clear()
                    fresh = words
                for w in fresh:
                    memo[w] = self.of.get(_hash(w), 0.0), [k for n in STEMS if len(w) > n and self.stem(k := w[:n])]
            found = list(map(memo.__getitem__, words))
            seen = Counter(k for _, stems in found for k in stems)
            # exact summation: the order of a set's words does not show
            z = self.bias + math.fsum([*(w for w, _ in found if w), *(self.stems[k][min(n, MOST_REPEATS) - 1] for k, n in seen.items())])
            out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
        return out


def upper_tail_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of upper tails of a score.

    Thresholds that keep less than a third of the positives say too little and are left out.
    """
    cuts = np.unique(positive)
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([((unlabelled >= c).sum() + 1) / (len(unlabelled) + 1) for c in cuts])
    return float(min(0.9, max(1e-3, (u / p)[p >= 1 / 3].min())))


def constant(prior: float) -> Model:
    """A model that knows nothing: half the prior for every text."""
    floor = min(0.5, max(prior, 1e-3)) / 2
    return Model(np.zeros(0, np.uint64), np.zeros(0), math.log(floor / (1 - floor)))


def marked(share_p: np.ndarray, share_u: np.ndarray, n_p: int, least_z: float = LEAST_Z) -> np.ndarray:
    """Which features positives hold more often by ``least_z`` deviations and ``LEAST_RATIO`` times as often as the unlabelled."""
    return ((share_p - share_u) / np.sqrt(share_u * (1 - share_u) / n_p) >= least_z) & (share_p >= LEAST_RATIO * share_u)


def _held(docs: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of the features ``keys`` that documents hold."""
    flat, row = np.concatenate([np.zeros(0, np.uint64), *docs]), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    at = np.minimum(np.searchsorted(keys, flat), max(0, len(keys) - 1))
    ok = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
    return at[ok], row[ok]


def train(docs_p: list[np.ndarray], docs_u: list[np.ndarray], prior: float, steps: int = STEPS, **settings) -> Model:
    """Fit on hashed word sets of positive and unlabelled documents: counts, choice of features and weights in one."""
    if not docs_p or not docs_u:
        return constant(prior)
    n_p, n_u = len(docs_p), len(docs_u)
    keys, count = np.unique(np.concatenate(docs_p), return_counts=True)
    count_u = np.bincount(_held(docs_u, keys)[0], minlength=len(keys))
    keys, ratio = chosen(keys, count, count_u, n_p, n_u, settings.pop("least_z", LEAST_Z))
    return weigh(keys, ratio, docs_p, docs_u, prior, steps, **settings)


def chosen(keys: np.ndarray, count_p: np.ndarray, count_u: np.ndarray, n_p: int, n_u: int, least_z: float = LEAST_Z) -> tuple[np.ndarray, np.ndarray]:
    """The features of at least ``LEAST_DOCS`` positives that are marked, ascending, and their log ratios."""
    share_p, share_u = count_p / n_p, (count_u + 1) / (n_u + 2)
    ok = (count_p >= LEAST_DOCS) & marked(share_p, share_u, n_p, least_z)
    order = np.argsort(keys[ok])
    return keys[ok][order], np.log(share_p[ok] / share_u[ok])[order]


def weigh(keys: np.ndarray, ratio: np.ndarray, docs_p: list[np.ndarray], docs_u: list[np.ndarray], prior: float, steps: int = STEPS, pull: float = PULL, start: float = START) -> Model:
    """Weights of the features ``keys`` by risk descent over documents, of which other features are ignored.

    ``prior`` (the labels' share of toxic rows) is the upper bound of the class prior: labels may
    favour toxic rows, so the tails of a first score lower it where they show less.
    """
    if not len(keys):
        return constant(prior)
    n_p, n_u = len(docs_p), len(docs_u)
    held_p, held_u = _held(docs_p, keys), _held(docs_u, keys)
    prior = min(prior, upper_tail_prior(np.bincount(held_p[1], ratio[held_p[0]], n_p), np.bincount(held_u[1], ratio[held_u[0]], n_u)))
    # few positives say little about each word, so weights are pulled to their log ratios, the more the fewer there are
    first, pull = start * ratio, pull * prior / n_p
    w = np.append(first, -np.median(ratio) / 2)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        _, g = risk(w, held_p, held_u, n_p, n_u, prior)
        g[:-1] += pull * (w[:-1] - first)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        np.maximum(w[:-1], 0, out=w[:-1])  # marks of positives speak for nothing else
    return Model(keys, w[:-1], float(w[-1]))


def cross_validated(docs_p: list[np.ndarray], docs_u: list[np.ndarray], clean_u: np.ndarray, prior: float, grid: list[dict], folds: int = 4) -> list[tuple[float, float, dict]]:
    """(share of left-out positives found, of left-out clean rows flagged, settings), for each settings of ``grid``.

    All rows are training rows: settings are compared by folds inside them, never by rows that are held out.
    ``clean_u`` marks unlabelled rows that are known to be clean; of the others nobody can say.
    """
    out = []
    for settings in grid:
        found = wrong = 0
        for f in range(folds):
            model = train([d for i, d in enumerate(docs_p) if i % folds != f], [d for i, d in enumerate(docs_u) if i % folds != f], prior, **settings)
            hit = lambda d, of=model.of, bias=model.bias: bias + math.fsum(of.get(k, 0.0) for k in d.tolist()) >= 0
            found += sum(hit(d) for d in docs_p[f::folds])
            wrong += sum(hit(d) for d, clean in zip(docs_u[f::folds], clean_u[f::folds], strict=True) if clean)
        out.append((found / max(1, len(docs_p)), wrong / max(1, int(clean_u.sum())), settings))
    return out


def risk(w: np.ndarray, held_p: tuple[np.ndarray, np.ndarray], held_u: tuple[np.ndarray, np.ndarray], n_p: int, n_u: int, prior: float) -> tuple[float, np.ndarray]:
    """(non-negative positive-unlabelled risk of weights and bias ``w``, direction of descent).

    ``held`` are (feature, document) of the features that documents hold. Where the unlabelled risk
    less the positives' part falls below zero, the direction climbs that part alone (Kiryo et al.).
    """
    (pc, pr), (uc, ur) = held_p, held_u
    fp, fu = np.bincount(pr, w[pc], n_p) + w[-1], np.bincount(ur, w[uc], n_u) + w[-1]
    sp, su = 1 / (1 + np.exp(-np.clip(fp, -50, 50))), 1 / (1 + np.exp(-np.clip(fu, -50, 50)))
    dp, du = sp * (1 - sp) / n_p, su * (1 - su) / n_u  # slopes of the sigmoid loss
    negative = su.mean() - prior * sp.mean()
    gp, gu = (-2 * prior * dp, du) if negative >= 0 else (prior * dp, -du)
    g = np.append(np.bincount(pc, gp[pr], len(w) - 1) + np.bincount(uc, gu[ur], len(w) - 1), gp.sum() + gu.sum())
    return prior * (1 - sp).mean() + max(0.0, negative), g


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            sets = [features(t).tobytes() for t in batch.column(1).slice(i, 256).to_pylist()]
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 256), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["positive", "digest", "words"])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's documents hold each feature, positives and unlabelled apart."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            rows = batch.slice(i, 512)
            for positive in (True, False):
                sets = [np.frombuffer(w, "<u8") for p, w in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True) if p == positive]
                keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
                zero = np.zeros(len(keys), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n if positive else zero), pa.array(zero if positive else n)], names=["feature", "count_p", "count_u"])


def _only(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = shared.value
    for batch in batches:
        sets = [np.frombuffer(w, "<u8") for w in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([keys[_held([s], keys)[0]].tobytes() for s in sets], pa.binary())], names=["positive", "words"])


def _drawn(share: float, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000)


def sample(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> tuple[float, DataFrame | None]:
    """(prior, positive and digest and words of the sampled training rows); equal word sets count once: copies of one document are one piece of evidence."""
    lab = labels.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_lab, n_pos = lab.agg(F.count("toxic"), F.count_if(F.col("toxic") == 1)).first()
    prior = min(0.9, max(1e-3, n_pos / n_lab)) if n_lab else 1e-3
    if not n_pos:
        return prior, None
    text = docs.where(fold(F.col("doc_id")) != 0).select("doc_id", F.col("text").cast("string").alias("text"))
    n_docs = max(1, docs.select("doc_id").count())
    toxic = lab.where("toxic = 1").where(_drawn(most_positive / n_pos, 5)).select("doc_id")
    positive = text.join(small_or_shuffled(toxic), "doc_id").select(F.lit(True).alias("positive"), "text")
    unlabelled = text.where(_drawn(most_unlabelled / (n_docs * (FOLDS - 1) / FOLDS), 6)).select(F.lit(False).alias("positive"), "text")
    return prior, positive.union(unlabelled).mapInArrow(_word_sets, "positive boolean, digest binary, words binary").dropDuplicates(["positive", "digest"])


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """A model from the training folds of ``docs`` and ``labels(doc_id, toxic)``.

    Features are counted on the executors. The driver gets those that stand out, and of each sampled
    row the ones of these that it holds: 24 bytes a marked feature and 8 for each that a row holds.
    """
    prior, sets = sample(docs, labels, most_positive, most_unlabelled)
    if sets is None:
        return constant(prior)
    sets = landed(sets, "word_sets")
    n_p, n_u = sets.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_p or not n_u:
        return constant(prior)
    counts = sets.select("positive", "words").mapInArrow(_feature_counts, "feature long, count_p long, count_u long").groupBy("feature").agg(F.sum("count_p").alias("count_p"), F.sum("count_u").alias("count_u"))
    share_p, share_u = F.col("count_p") / n_p, (F.col("count_u") + 1) / (n_u + 2)
    stands_out = (F.col("count_p") >= LEAST_DOCS) & (share_p >= LEAST_RATIO * share_u) & ((share_p - share_u) / F.sqrt(share_u * (1 - share_u) / n_p) >= LEAST_Z)
    got = counts.where(stands_out).toPandas()
    keys, ratio = chosen(got["feature"].to_numpy(np.int64).view(np.uint64), got["count_p"].to_numpy(), got["count_u"].to_numpy(), n_p, n_u)
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    rows = sets.select("positive", "words").mapInArrow(lambda it: _only(shared, it), "positive boolean, words binary").toPandas()
    held = {k: [np.frombuffer(b, "<u8") for b in sorted(g["words"])] for k, g in rows.groupby("positive")}
    discard(sets)
    return weigh(keys, ratio, held.get(True, []), held.get(False, []), prior)


def _scores(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, memo = shared.value, {}
    for batch in batches:
        score = []
        for i in range(0, batch.num_rows, 512):
            score += model.score(batch.column(2).slice(i, 512).to_pylist(), memo)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. The model is at most the sample's vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scores(shared, it), "doc_id long, held_out boolean, score double, predicted int")

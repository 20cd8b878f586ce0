"""Language identification by prediction by partial matching.

Every language has a tree of byte contexts of orders 0 to ``ORDER`` with escape method C (without
exclusion of the symbols of longer contexts, so lengths are those of a code with some slack). Bytes are
first folded to 157 symbols (letters without case, digits, blanks, marks, and each other byte its
own), so a context with its next symbol is a small integer. Statistics are frozen after training,
hence the exact code length of a symbol depends only on the last ORDER + 1 symbols: the trees are
evaluated once into code lengths of the grams that any language has seen, in sorted arrays. A
worker looks a byte's gram up once for ``SLICE`` languages together; a gram none of them has seen
falls back by their escapes to the next lower order. A text's code length per language is the
sum. The order is the same for every number of languages, and memory grows with their number only.

Training reads an expected ``MOST_ROWS`` labelled rows per language (a hash sample, whole texts). A value
of lang is learned if at least ``LEAST_ROWS`` training rows have it and no ``MOST_LANGUAGES`` others have
more (ties by name), so stray values in a dirty column neither become languages nor reach the driver;
rows with other values are scored like rows without lang.

Defined cases: null text or text without letters is ``und`` with score 0; without any training row
everything is ``und``; languages of equal code length tie and the first by name is taken; very long
texts are scored whole, in pieces that overlap by the order; repeated rows agree; a null doc_id is
held out; empty table: empty result. lang, source and doc_id never enter a prediction. Columns are
read by their own names, so no other column can clash.

``keep_identified`` judges no row by trees that the row taught: rows are dealt into
``PARTS`` parts by doc_id, and a row is scored by trees of the other parts (a language with rows in
one part only is in all). It rejects a text whose best code length is more than ``FAR`` times that
language's usual bits a byte plus ``SHORT`` bits, and writes predictions of a posterior from
``SURE`` on, and those of rows without lang, into lang. The usual figure is the median over the
training rows so scored; a language without any takes the median of all, and without any row at
all the bound is infinite.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import places
from .worker import kept

ORDER, SYMBOLS, SLICE = 3, 157, 16
MOST_ROWS, FOLDS = 1_500, 5
LEAST_ROWS, MOST_LANGUAGES = 5, 500
PARTS, FAR, SHORT, SURE = 5, 3.0, 64, 0.99
UNITS = 512  # code lengths are kept in 1/512 bit
LETTER = re.compile(r"[^\W\d_]")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def alphabet(byte_counts: np.ndarray | None = None) -> np.ndarray:
    """Symbol of each byte: letters 0-25, digits 26, blanks 27, other ASCII 28, others 29-156, whatever their counts."""
    out = np.full(256, 28, np.uint8)
    for c in range(26):
        out[65 + c] = out[97 + c] = c
    out[48:58], out[[9, 10, 11, 12, 13, 32]] = 26, 27
    out[128:] = np.arange(29, 157)
    return out


def grams(raw: bytes, symbol: np.ndarray, order: int) -> np.ndarray:
    """For each byte: its symbol and the ``order`` before it as one integer (blanks before the start)."""
    s = np.concatenate([np.full(order, 27, np.uint8), symbol[np.frombuffer(raw, np.uint8)]]).astype(np.uint32)
    n, key = len(raw), np.zeros(len(raw), np.uint32)
    for k in range(order + 1):
        key = key * np.uint32(SYMBOLS) + s[k : k + n]
    return key


@dataclass(frozen=True)
class Model:
    languages: list[str]
    symbol: np.ndarray
    order: int
    counts: list[tuple[np.ndarray, np.ndarray]]  # per language: sorted grams, counts
    usual: list[float] | None = None  # per language: bits a byte of its training texts

    def table(self) -> list[Table]:
        """Code lengths of every gram, for slices of languages."""
        return [Table.of(self.counts[i : i + SLICE], self) for i in range(0, len(self.languages), SLICE)]

    @staticmethod
    def _order(key: np.ndarray, n: np.ndarray, size: int, lower: np.ndarray) -> np.ndarray:
        """Code lengths of one order from counts and the lower order's lengths."""
        c = np.bincount(key, n, size).astype(np.float32).reshape(-1, SYMBOLS)
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True).astype(np.float32)
        seen = np.maximum(total + kinds, 1)
        escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / seen), 0)
        with np.errstate(divide="ignore"):
            return np.where(c > 0, -np.log2(c / seen), escape + lower).astype(np.float32).reshape(-1)

    def code_lengths(self, key: np.ndarray, n: np.ndarray, order: int | None = None) -> np.ndarray:
        cost = np.full(SYMBOLS, np.log2(SYMBOLS), np.float32)  # order -1: all symbols alike
        for k in range((self.order if order is None else order) + 1):
            size = SYMBOLS ** (k + 1)
            cost = self._order(key % np.uint32(size), n, size, np.tile(cost.reshape(-1, SYMBOLS), (SYMBOLS if k else 1, 1)))
        return cost


def _find(sorted_keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
    return at, sorted_keys[at] == key


@dataclass
class Table:
    """Code lengths in 1/UNITS bit for some languages: all grams of order 1, and those seen of each higher order.

    A level holds its grams and their lengths, and their contexts with the bits of an escape, one
    column per language (0 where the language has not seen the context).
    """

    base: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, counts: list[tuple[np.ndarray, np.ndarray]], model: Model) -> Table:
        base = np.stack([model.code_lengths(key, n, 1) for key, n in counts], 1) * UNITS
        out = cls(np.minimum(65535, base + 0.5).astype(np.uint16), [])
        for k in range(2, model.order + 1):
            size, seen = np.uint32(SYMBOLS ** (k + 1)), []
            for key, n in counts:
                mine, to = np.unique(key % size, return_inverse=True)
                seen.append((mine, np.bincount(to, n, len(mine))))
            union = np.unique(np.concatenate([m for m, _ in seen]))
            contexts, of = np.unique(union // np.uint32(SYMBOLS), return_inverse=True)
            cost, escape = out.sums(union, k - 1).astype(np.float64), np.zeros((len(contexts), len(counts)))
            for j, (mine, n) in enumerate(seen):
                at = np.searchsorted(union, mine)
                total, kinds = np.bincount(of[at], n, len(contexts)), np.bincount(of[at], minlength=len(contexts))
                escape[:, j] = np.where(kinds > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0) * UNITS
                cost[:, j] += escape[of, j]
                cost[at, j] = -np.log2(n / (total + kinds)[of[at]]) * UNITS
            out.levels.append((union, np.minimum(65535, cost + 0.5).astype(np.uint16), contexts, (escape + 0.5).astype(np.uint16)))
        return out

    def sums(self, key: np.ndarray, k: int) -> np.ndarray:
        """Code length of each gram's last symbol after ``k`` symbols, per language."""
        key = key % np.uint32(SYMBOLS ** (k + 1))
        if k == 1:
            return self.base[key].astype(np.int32)
        grams, cost, contexts, escape = self.levels[k - 2]
        at, hit = _find(grams, key)
        out = cost[at].astype(np.int32) if len(grams) else np.zeros((len(key), self.base.shape[1]), np.int32)
        if not hit.all():
            rest = key[~hit]
            at, known = _find(contexts, rest // np.uint32(SYMBOLS))
            lower = self.sums(rest, k - 1)
            if len(contexts):
                lower += np.where(known[:, None], escape[at], 0)
            out[~hit] = lower
        return out


def _key(model: Model) -> tuple:
    return ("ppm", *model.languages, *(int(n.sum()) for _, n in model.counts), *(len(n) for _, n in model.counts))


def _table(shared) -> tuple[Model, list[Table]]:
    model = shared.value
    return model, kept(_key(model), model.table)


def _parts(shared) -> tuple[list[Model], list[list[Table]]]:
    models = shared.value
    return models, kept(("parts", *map(_key, models)), lambda: [m.table() for m in models])


def code_bits(text: str, model: Model, table: list[Table]) -> tuple[np.ndarray, int]:
    """Code length of a text in bits per language, and its bytes."""
    raw, bits = text.encode(), np.zeros(len(model.languages))
    for i in range(0, len(raw), 1 << 16):  # pieces overlap by the order, so contexts run on
        lead = min(i, model.order)
        key = grams(raw[i - lead : i + (1 << 16)], model.symbol, model.order)[lead:]
        bits += np.concatenate([t.sums(key, model.order).sum(0, dtype=np.int64) for t in table])
    return bits / UNITS, len(raw)


def predict(texts: list[str | None], model: Model, table: list[Table]) -> list[tuple[str, float]]:
    """(language, posterior of its code length) per text."""
    out = []
    for t in texts:
        if not t or not model.languages or not LETTER.search(t):
            out.append(("und", 0.0))
            continue
        bits, _ = code_bits(t, model, table)
        best = int(bits.argmin())
        out.append((model.languages[best], float(1 / np.exp2(-np.minimum(bits - bits[best], 1000)).sum())))
    return out


def _counts(symbol: np.ndarray, order: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    for batch in batches:
        for lang, t, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            held.setdefault((lang, part), []).append(grams(t.encode(), symbol, order))
    for lang, part in sorted(held):
        key, n = np.unique(np.concatenate(held[lang, part]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array([part] * len(key), pa.int32()), pa.array(key.astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "part", "gram", "n"])


def _rates(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits a byte of each text in its own language, by trees of the other parts."""
    models, tables = _parts(shared)
    at = {lang: i for i, lang in enumerate(models[0].languages)}
    for batch in batches:
        langs, parts, rates = [], [], []
        for lang, t, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if LETTER.search(t):
                bits, n = code_bits(t, models[part], tables[part])
                langs.append(lang), parts.append(part), rates.append(float(bits[at[lang]]) / n)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.int32()), pa.array(rates, pa.float64())], names=["lang", "part", "rate"])


def part_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(PARTS)).cast("int")


def _sample(docs: DataFrame, most_rows: int) -> tuple[list[str], DataFrame | None]:
    """Languages, and lang, text, part of the training sample."""
    rows = docs.where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    count = rows.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    count = count.orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in count)
    if not languages:
        return [], None
    share = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, most_rows / r["n"]) * 1_000_000)) for r in count], "known string, share int")
    sample = rows.withColumn("known", F.col("lang").cast("string")).join(F.broadcast(share), "known")  # at most MOST_LANGUAGES rows
    sample = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < F.col("share"))
    return languages, sample.select("lang", F.col("text").cast("string").alias("text"), part_of(F.col("doc_id")).alias("part"))


def _grams(sample: DataFrame, symbol: np.ndarray):
    return sample.mapInArrow(lambda it: _counts(symbol, ORDER, it), "lang string, part int, gram long, n long").groupBy("lang", "part", "gram").agg(F.sum("n").alias("n")).toPandas()


def _model(languages: list[str], symbol: np.ndarray, found) -> Model:
    counts = []
    for lang in languages:
        mine = found[found["lang"] == lang].groupby("gram")["n"].sum()  # sorted
        counts.append((mine.index.to_numpy().astype(np.uint32), mine.to_numpy().astype(np.uint32)))
    return Model(languages, symbol, ORDER, counts)


def fit(docs: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """Frozen context trees from labelled rows of the training folds."""
    symbol = alphabet()
    languages, sample = _sample(docs, most_rows)
    if not languages:
        return Model([], symbol, ORDER, [])
    return _model(languages, symbol, _grams(sample.withColumn("part", F.lit(0)), symbol))


def fit_parts(docs: DataFrame, most_rows: int = MOST_ROWS) -> list[Model]:
    """For the rows of each part, the trees of the other parts with the usual bits a byte."""
    symbol = alphabet()
    languages, sample = _sample(docs, most_rows)
    if not languages:
        return [Model([], symbol, ORDER, [])] * PARTS
    found = _grams(sample, symbol)
    alone = found.groupby("lang")["part"].transform("nunique") == 1
    models = [_model(languages, symbol, found[(found["part"] != h) | alone]) for h in range(PARTS)]
    shared = docs.sparkSession.sparkContext.broadcast(models)
    rates = sample.mapInArrow(lambda it: _rates(shared, it), "lang string, part int, rate double").toPandas()  # at most the sample's rows
    out = []
    for h, model in enumerate(models):
        mine = rates[rates["part"] == h]
        mine = mine if len(mine) else rates
        every = float(mine["rate"].median()) if len(mine) else float("inf")
        usual = mine.groupby("lang")["rate"].median().to_dict()
        out.append(replace(model, usual=[float(usual.get(k, every)) for k in languages]))
    return out


def _predict(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model, table = _table(shared)
    for batch in batches:
        got = []
        for i in range(0, batch.num_rows, 256):
            got += predict(batch.column(2).slice(i, 256).to_pylist(), model, table)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; the model's grams are bounded by its sample."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _predict(shared, it), "doc_id long, held_out boolean, lang_pred string, score double")


def decide(text: str | None, lang: str | None, model: Model, table: list[Table]) -> tuple[bool, str | None]:
    """Whether a text is in a learned language, and its lang from now on."""
    if not text or not model.languages or not LETTER.search(text):
        return False, lang
    bits, n = code_bits(text, model, table)
    best = int(bits.argmin())
    if model.usual is not None and bits[best] > FAR * model.usual[best] * n + SHORT:
        return False, lang
    sure = 1 / np.exp2(-np.minimum(bits - bits[best], 1000)).sum() >= SURE
    return True, model.languages[best] if sure or lang is None else lang


def _keep(shared, text: int, lang: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    models, tables = _parts(shared)
    for batch in batches:
        part, batch = batch.column(batch.num_columns - 1), batch.select(range(batch.num_columns - 1))
        got = []
        for i in range(0, batch.num_rows, 256):
            rows = batch.slice(i, 256)
            got += [decide(t, k, models[h], tables[h]) for t, k, h in zip(rows.column(text).to_pylist(), rows.column(lang).to_pylist(), part.slice(i, 256).to_pylist(), strict=True)]
        field = batch.schema.field(lang)
        yield batch.set_column(lang, field, pa.array([k for _, k in got], field.type)).filter(pa.array([k for k, _ in got], pa.bool_()))


def keep_identified(docs: DataFrame, models: list[Model]) -> DataFrame:
    """Rows of ``docs`` in a learned language, with lang as predicted where sure; other columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")
    plain = docs.toDF(*places(docs))
    rows = plain.select("*", part_of(F.col(plain.columns[docs.columns.index("doc_id")])))
    return rows.mapInArrow(lambda it: _keep(shared, text, lang, it), plain.schema).toDF(*docs.columns)

"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from batchloom.llm import op01_repair, op02_balance, op03_pstable, op04_shuffle, op05_oddsketch, op06_media, op07_nnpu, op08_slack, op09_secrets, op10_ppm

BPE, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Names that the operators use inside.
CLASH = ["size", "k", "salt", "place", "copies", "shard", "bucket", "record", "rep", "g", "cluster", "u", "v", "start", "length", "media", "declared", "row", "mixed_id", "mixed_copies", "positive", "held_out", "n_chars", "k1", "k2", "cid", "root", "b", "h", "part", "hi", "lo", "mine", "blocks", "a.b", "nth", "task", "known", "share"]
SCHEMA = "doc_id bigint, text string, lang string, source string"
LONG = "lorem ipsum dolor, sit amet consectetur. " * 30_000  # beyond every piece, slice and block of the operators
ROWS = [
    (0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", "a"), (3, "one two", "de", None), (4, LONG, "en", "b"), (5, LONG, "en", "b"), (6, "one two", "de", "a"),
    (7, "the quick brown fox jumps over the lazy dog", "en", "b"), (7, "the quick brown fox jumps over the lazy dog", "en", "b"), (None, "no id here at all", "en", "c"), (8, "É ñ 中文 <|endoftext|> don't 12.5", None, "c"),
    (9, "....", "en", "c"), (10, "\U0001f600 idiot trash token = abcdef123456", "en", ""),
]


def clashing(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(spark.createDataFrame(ROWS, SCHEMA)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


OPS = {
    "repair": lambda s, d: op01_repair.document_digests(op01_repair.write_blocks(d, BPE)),
    "mix": lambda s, d: op02_balance.mix(d),
    "shuffle": lambda s, d: op04_shuffle.slots(*op04_shuffle.external_shuffle(d)),
    "near": lambda s, d: op05_oddsketch.near_duplicates(d),
    "media": lambda s, d: op06_media.features(op06_media.store(d)),
    "toxic": lambda s, d: op07_nnpu.score(d, op07_nnpu.fit(d, labels(s, [(10, 1, 1), (7, 1, 0), (None, 1, 1)]))),
    "secrets": lambda s, d: op09_secrets.scan(d, RANKS),
    "redact": lambda s, d: op09_secrets.redact(d, RANKS),
    "language": lambda s, d: op10_ppm.identify(d, op10_ppm.fit(d)),
    "sniff": lambda s, d: op06_media.sniff(d.withColumns({"media": F.col("text").cast("binary"), "declared": F.lit("x")})),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_one_row_each(spark, odd, name):
    got = OPS[name](spark, odd).collect()
    assert len(got) == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_table(spark, none, name):
    assert OPS[name](spark, none).count() == 0


def test_pack_odd(spark, odd, none):
    got = op08_slack.pack(odd, BPE).collect()
    assert len({(r.doc_id, r.doc_tokens) for r in got}) >= 11 and op08_slack.pack(none, BPE).count() == 0
    assert all(r.offset + r.length <= 4096 for r in got)


def test_defined_results(spark, odd):
    near = {(r.doc_id, r.n_shingles): r for r in op05_oddsketch.near_duplicates(odd).collect()}
    assert near[0, 0].component_id == 0 and near[2, 0].component_id == 2 and near[6, 1].component_id == 3 and near[6, 1].kept is False
    assert [r.component_id for k, r in near.items() if k[0] == 5] == [4]
    lang = {r.doc_id: r for r in op10_ppm.identify(odd, op10_ppm.fit(odd)).collect()}
    assert lang[0].lang_pred == lang[1].lang_pred == lang[9].lang_pred == "und" and lang[4].lang_pred == "en"
    mixed = op02_balance.mix(odd).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in mixed)
    assert {r.source for r in mixed} == {None, "a", "b", "c", ""}


def test_no_positive_examples(spark, odd):
    got = op07_nnpu.score(odd, op07_nnpu.fit(odd, labels(spark, []))).collect()
    assert {r.predicted for r in got} == {0}


def test_odd_vectors(spark):
    v = [0.1, 0.2, 0.3]
    rows = [(0, v, 1), (1, [2 * x for x in v], 1), (2, v, 2), (3, v, None), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [float("nan"), 1.0, 1.0], 1), (7, [None, 1.0, 1.0], 1), (8, [], 1), (9, [0.1, 0.2], 1), (0, v, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").select("*", F.lit(1).alias("links"), F.lit(1).alias("rep"))
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in op03_pstable.near_duplicates(df).collect()}
    assert got == {(0, 2, 0, True), (1, 2, 0, False), *((i, 0, i, True) for i in range(2, 10))}
    assert op03_pstable.near_duplicates(df.limit(0)).count() == 0


def test_repeated_vec_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 0), (1, b, 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.01, 1.0, 0.0], 0), (4, [0.0, 0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in op03_pstable.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_one_id_with_many_texts(spark):
    """Rows of one doc_id keep an order of their own, and null ids come first."""
    rows = [(d, f"{d} text {i}") for d in (3, 3, 3, 1, None, None) for i in range(4)] + [(2, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in op01_repair.document_digests(op01_repair.write_blocks(df, BPE)).collect()]
    again = [tuple(r) for r in op01_repair.document_digests(op01_repair.write_blocks(df.repartition(7), BPE)).collect()]
    key = lambda r: r[1]
    assert sorted(got, key=key) == sorted(again, key=key) and [r[0] for r in sorted(got, key=key)] == sorted([r[0] for r in rows], key=lambda d: -1 if d is None else d)
    assert sum(r[2] for r in got) == max(r[1] + r[2] for r in got)


def test_mix_row_that_closes_the_gap(spark):
    """Of documents that could close a source's gap equally well, one does, the same in every run."""
    df = spark.createDataFrame([(i, "one two three four five", "a") for i in range(7)] + [(i, "six words stand in this text", "b") for i in range(7, 12)], "doc_id bigint, text string, source string")
    runs = [sorted((r.doc_id, r.taken, r.cut_words) for r in op02_balance.mix(d).collect()) for d in (df, df.repartition(5))]
    assert runs[0] == runs[1] and sum(c != 0 for _, _, c in runs[0]) <= 2
    for source, t in {r.source: (r.t, r.w) for r in op02_balance.mix(df).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect()}.items():
        assert abs(t[0] - t[1]) <= 1, source


def test_null_vec_ids_link(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [0.0, 1.0], 1), (4, [0.0, 1.0], 1)], "vec_id bigint, embedding array<double>, label int")
    got = sorted(map(tuple, op03_pstable.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 1, None, False), (None, 1, None, False), (None, 1, 4, False), (4, 1, 4, True)], key=str)


def test_many_equal_rows_spread(spark):
    """Equal rows are numbered by task and salted apart; copies come out as the mix has them."""
    row = (7, "one two three four five six seven", "en", "a")
    df = spark.createDataFrame([row], SCHEMA).crossJoin(spark.range(60_000, numPartitions=8)).drop("id").unionByName(spark.createDataFrame([(i, "a few words more", "en", "b") for i in range(500)], SCHEMA)).withColumn("a.b", F.lit(1))
    mixed = op02_balance.mix(df, exact_words=False)
    counts = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w"), F.count("*").alias("n")).collect()
    assert {r.source: r.n for r in counts} == {"a": 60_000, "b": 500} and all(abs(r.t - r.w) <= 7 for r in counts)
    out = op02_balance.materialise(df, mixed)
    assert {r.source: r["count"] for r in out.groupBy("source").count().collect()} == {r.source: r.c for r in mixed.groupBy("source").agg(F.sum("copies").alias("c")).collect()}
    keyed = spark.range(60_000, numPartitions=8).select(F.monotonically_increasing_id().alias("row"), (F.col("id") % 2).alias("k1"), F.lit(1).cast("long").alias("k2"))
    nth = op02_balance.numbered(keyed).groupBy("k1").agg(F.count_distinct("nth").alias("d"), F.max("nth").alias("m")).collect()
    assert {(r.k1, r.d, r.m) for r in nth} == {(0, 30_000, 29_999), (1, 30_000, 29_999)}


def test_a_dirty_lang_column(spark):
    """Stray values do not become languages, and a bound keeps the most frequent ones."""
    good = [(i, f"the quick brown fox number {i}", "en", "a") for i in range(0, 400)] + [(i, f"der schnelle braune fuchs nummer {i}", "de", "a") for i in range(400, 800)]
    stray = [(i, "some words of no language", f"x{i}", "a") for i in range(1_000, 6_000)]
    model = op10_ppm.fit(spark.createDataFrame(good + stray, SCHEMA))
    assert model.languages == ["de", "en"]
    several = [(i, "some words", f"y{i % 700}", "a") for i in range(9_000)]
    assert len(op10_ppm.fit(spark.createDataFrame(several, SCHEMA)).languages) == op10_ppm.MOST_LANGUAGES

"""The pipeline's stages against brute force on a small table."""

import numpy as np
import public_tokenizers
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from batchloom.llm import op02_balance, op09_secrets

from .test_odd_inputs import LONG, ROWS, SCHEMA, clashing
from .test_operators import by_force


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    raw = ds.dataset(f"{sf}/documents.parquet").to_table().to_pandas().sort_values("doc_id").reset_index(drop=True)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secrets", "mixing", "packing"]
    one = corpus_pipeline.language_id(spark, docs, sf)
    assert one.columns == docs.columns and one.count() == len(raw)  # every document has a language
    two = corpus_pipeline.near_dedup(spark, one, sf)
    comp, _ = by_force(raw.text, (80, 100))
    kept = [raw.doc_id[i] for i in range(len(raw)) if comp[i] == i]
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.select("doc_id").collect()) == kept
    three = corpus_pipeline.secrets(spark, two, sf).toPandas().set_index("doc_id")
    enc = op09_secrets.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    text = raw.set_index("doc_id").text
    assert all(three.text[d] == op09_secrets.redacted(text[d], enc) for d in kept) and (three.n_chars == three.text.str.len()).all()
    four = corpus_pipeline.mixing(spark, spark.createDataFrame(three.reset_index()[docs.columns]), sf)
    n = four.groupBy("doc_id").count().toPandas()
    assert four.columns == docs.columns and n["count"].max() <= 2 and set(n.doc_id) <= set(kept)


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert len(got) and got.groupby("sequence_id").length.sum().max() <= 4096


def test_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z x y z q"), (None, "no id"), (3, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert sorted(got, key=str) == [1, 2, None]
    rows = [(1, "a b c d e f"), (1, "other words under the same id"), (2, "other words under the same id"), (None, "x y z x y z q"), (None, "x y z x y z q"), (None, "X y z x y z q"), (4, None), (4, None)]
    apart = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, apart, "").collect()]
    assert [t.lower() for d, t in got if d is None] == ["x y z x y z q"]
    assert sorted(x for x in got if x[0] is not None and x[1]) == [(1, "a b c d e f"), (1, "other words under the same id")] and got.count((4, None)) == 2
    assert corpus_pipeline.mixing(spark, df.where("doc_id is null or doc_id != 3").dropDuplicates(["doc_id"]), "").count() >= 1


def test_near_dedup_at_080(spark):
    words = [f"w{i}" for i in range(120)]
    near, far = words.copy(), words.copy()
    for i in (20, 60):
        near[i] = f"new{i}"  # 106 of 126 shingles in common: 0.841
    for i in (20, 60, 100):
        far[i] = f"other{i}"  # 101 of 131: 0.771
    assert by_force([" ".join(words), " ".join(near)], (80, 100))[0] == [0, 0] and by_force([" ".join(words), " ".join(near)])[0] == [0, 1]
    df = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(near)), (2, " ".join(far))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 2]


def test_language_id_decides(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(3)
    gibberish = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(40))
    unlearned = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw " * 3
    german = max((r.text for r in docs.where("lang = 'de'").collect()), key=len)
    more = [(-1, gibberish, "en"), (-2, unlearned, None), (-3, german, "fr"), (-4, german, None), (-5, "Все люди рождаются свободными и равными в своем достоинстве", None)]
    more = spark.createDataFrame(more, "doc_id bigint, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' as source", "length(text) as n_chars")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs.unionByName(more), sf).collect()}
    assert {d for d in got if d < 0} == {-3, -4} and got[-3] == got[-4] == "de"
    assert sum(d >= 0 for d in got) == docs.count()  # clean documents stay


def test_mixing_by_row(spark):
    """Rows without doc_id are mixed one by one, equal rows together; the mix comes out as rows."""
    rows = [(None, f"{'w ' * (1 + i % 7)}t{i}", "a" if i % 3 else "b") for i in range(60)] + [(5, "same row here", "a")] * 9 + [(6, None, None), (7, "", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as mixed_id", "2 as mixed_copies", "3 as copies", "4 as k1", "5 as record")
    want = op02_balance.mix(df, exact_words=False).groupBy().agg(F.sum("taken").alias("t"), F.sum("copies").alias("c")).first()
    got = corpus_pipeline.mixing(spark, df, "")
    assert got.columns == df.columns
    got = got.collect()
    assert len(got) == want.c and sum(len((r.text or "").split()) for r in got) == want.t
    texts = [r.text for r in got if r.doc_id is None]
    assert max(texts.count(t) for t in set(texts)) <= 2


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_at_every_stage(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = clashing(spark.createDataFrame(ROWS, SCHEMA))
    got = stage(spark, odd, "")
    if name != "packing":
        assert got.columns == odd.columns
    rows = got.collect()
    assert rows
    if name == "secrets":
        assert len(rows) == len(ROWS) and {r.text for r in rows if r.doc_id == 10} == {"\U0001f600 idiot trash [SECRET]"}
    if name == "near_dedup":
        assert [r.doc_id for r in rows if r.text == LONG] == [4] and sum(r.text is None for r in rows) == 1
    if name == "language_id":
        assert {0, 1, 2, 9}.isdisjoint(r.doc_id for r in rows)
    none = stage(spark, clashing(spark.createDataFrame([], SCHEMA)), "")
    assert none.count() == 0


def test_stages_of_nulls_only(spark):
    df = spark.createDataFrame([(None, None, None, None)] * 3, SCHEMA)
    assert corpus_pipeline.language_id(spark, df, "").count() == 0 and corpus_pipeline.near_dedup(spark, df, "").count() == 3
    assert corpus_pipeline.secrets(spark, df, "").count() == 3 and corpus_pipeline.mixing(spark, df, "").count() == 0 and corpus_pipeline.packing(spark, df, "").count() == 3

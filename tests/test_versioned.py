"""Versioned tables: what an upsert leaves alone, and what a failed one leaves."""

import pytest
from pyspark.sql import functions as F

from batchloom.sources.versioned import VersionedTable


def table(spark, tmp_path, buckets=8):
    return VersionedTable(spark, f"file://{tmp_path}/t", "id bigint, v string, seq bigint", ["id"], buckets)


def rows(t):
    return sorted(tuple(r) for r in t.read().collect())


def changes(spark, data):
    return spark.createDataFrame(data, "id bigint, v string, seq bigint")


def test_upsert_rewrites_only_changed_buckets(spark, tmp_path):
    t = table(spark, tmp_path)
    assert rows(t) == [] and t.version() == 0
    assert t.upsert(changes(spark, [(i, "a", 1) for i in range(100)]), ["seq"]) == 1
    first = t.folders()
    assert t.upsert(changes(spark, [(7, "b", 2), (7, "c", 3), (200, "d", 1)]), ["seq"]) == 2
    second = t.folders()
    hit = {r.b for r in spark.createDataFrame([(7,), (200,)], "id bigint").select(F.pmod(F.xxhash64("id"), F.lit(8)).cast("int").alias("b")).collect()}
    assert {b for b in first if first[b] != second[b]} == hit and len(first) == 8
    want = {i: "a" for i in range(100)} | {7: "c", 200: "d"}
    assert {i: v for i, v, _ in rows(t)} == want
    assert sorted(r.v for r in t.read(1).where("id in (7, 200)").collect()) == ["a"]  # the old version is still whole
    assert t.delete(changes(spark, [(7, None, None), (999, None, None)])) == 3
    assert {i: v for i, v, _ in rows(t)} == {k: v for k, v in want.items() if k != 7}
    assert t.upsert(changes(spark, []), ["seq"]) == 3


def test_the_new_row_wins_whatever_its_order_says(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(changes(spark, [(1, "old", 9)]), ["seq"])
    t.upsert(changes(spark, [(1, "new", 1)]), ["seq"])
    assert rows(t) == [(1, "new", 1)]


def test_failures_leave_the_old_version(spark, tmp_path):
    t = table(spark, tmp_path)
    t.upsert(changes(spark, [(1, "a", 1)]), ["seq"])
    broken = changes(spark, [(1, "b", 2)]).withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        t.upsert(broken, ["seq"])
    assert t.version() == 1 and rows(t) == [(1, "a", 1)]
    other = table(spark, tmp_path)
    publish = other._publish
    other._publish = lambda version, folders: (t.upsert(changes(spark, [(2, "first", 1)]), ["seq"]), publish(version, folders))
    with pytest.raises(Exception, match="exists"):
        other.upsert(changes(spark, [(3, "second", 1)]), ["seq"])
    assert rows(t) == [(1, "a", 1), (2, "first", 1)]
    assert t.upsert(changes(spark, [(1, "z", 5)]), ["seq"]) == 3 and rows(t) == [(1, "z", 5), (2, "first", 1)]


def test_a_bucket_may_become_empty(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2)
    t.upsert(changes(spark, [(i, "a", 1) for i in range(6)]), ["seq"])
    t.delete(t.read())
    assert rows(t) == [] and t.folders() == {}

"""Logs in files: zone maps, lookups that read no other file, and streams in bounded ordered steps."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchloom.operators import offsets
from batchloom.sources import log

STAMP = "2024-01-01 00:00:00"


def records(spark, spans, size=lambda o: 10):
    rows = [(t, p, o, "k", "v" * size(o)) for (t, p), (a, z) in spans.items() for o in range(a, z)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "topic string, partition int, offset bigint, key string, value string").withColumn("timestamp", F.lit(STAMP).cast("timestamp"))


def test_zones_tell_what_files_hold(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    assert log.zones(spark, path).count() == 0
    log.append(records(spark, {("a", 0): (5, 105), ("a", 1): (0, 3), ("b/c", 0): (0, 50)}), path, file_records=20)
    log.append(records(spark, {("a", 0): (105, 120)}), path)
    z = log.zones(spark, path)
    assert {(r.topic, r.partition): tuple(r)[2:] for r in z.groupBy("topic", "partition").agg(F.min("first"), F.max("last"), F.sum("records"), F.sum("bytes")).collect()} == {("a", 0): (5, 119, 115, 1265), ("a", 1): (0, 2, 3, 33), ("b/c", 0): (0, 49, 50, 550)}
    assert z.where("last - first + 1 != records").count() == 0  # offsets of a file's partition lie together
    with pytest.raises(ValueError, match="before the end"):
        log.append(records(spark, {("a", 0): (119, 130)}), path)
    assert log.zones(spark, path).count() == z.count()


def test_lookup_reads_only_files_with_pointers(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log.append(records(spark, {("a", p): (10, 400) for p in range(3)}), path, file_records=25)
    pointers = spark.createDataFrame([("a", 0, 10), ("a", 0, 11), ("a", 2, 399), ("a", 1, 9), ("a", 1, 400), ("z", 0, 1)], "topic string, partition int, offset bigint")
    got = {tuple(r)[:3]: r.result for r in log.lookup(pointers, path).select("topic", "partition", "offset", "result").collect()}
    assert got == {("a", 0, 10): "found", ("a", 0, 11): "found", ("a", 2, 399): "found", ("a", 1, 9): "lost", ("a", 1, 400): "miss", ("z", 0, 1): "miss"}
    want = log.zones(spark, path).where("(partition = 0 and first <= 11) or (partition = 2 and last = 399)").select("file").distinct()
    one = lambda names: sorted(n.replace("file:///", "file:/") for n in names)
    assert one(log.holding(pointers, path).inputFiles()) == one(r.file for r in want.collect()) and log.zones(spark, path).count() > 40
    plain = offsets.lookup(pointers, records(spark, {("a", p): (10, 400) for p in range(3)}).withColumnRenamed("value", "payload"), log.bounds(spark, path), ("topic", "partition"))
    assert {tuple(r)[:3]: r.result for r in plain.select("topic", "partition", "offset", "result").collect()} == got
    assert log.holding(pointers.where("offset = 9"), path).count() == 0


def test_steps_keep_their_budgets():
    """Every step is within the budgets, or one record; all records come once and in order; no partition starves."""
    rng = np.random.default_rng(2)
    size = {f"t/{p}": rng.integers(1, 400, 200) for p in range(5)}
    size["t/3"][7] = 5_000  # larger than any budget
    of = {n: [log.Zone(str(k), 40 * k, 40 * k + 39, int(s[40 * k : 40 * k + 40].sum())) for k in range(5)] for n, s in size.items()}

    def sizes(file, topic, partition, start):
        at = np.arange(max(start, 40 * int(file)), 40 * int(file) + 40)
        return at, size[f"{topic}/{partition}"][at]

    at, steps = {"at": {}, "turn": ""}, []
    while (then := log.step(of, at, 1_000, 300, sizes)) != at:
        took = {n: size[n][at["at"].get(n, 0) : z] for n, z in then["at"].items()}
        total = sum(int(x.sum()) for x in took.values())
        assert total <= 1_000 or sum(map(len, took.values())) == 1
        assert all(x.sum() <= 300 or len(x) == 1 for x in took.values())
        steps.append({n for n, x in took.items() if len(x)})
        at = then
    assert at["at"] == dict.fromkeys(of, 200)
    assert all(set().union(*steps[i : i + 5]) == set(of) for i in range(0, 40, 5))


def test_stream_in_order_and_after_a_restart(spark, tmp_path):
    path, out = f"file://{tmp_path}/log", str(tmp_path / "out")
    log.append(records(spark, {("a", 0): (0, 300), ("a", 1): (0, 40), ("b", 0): (7, 90)}), path, file_records=64)
    batches = {}

    def each(batch, epoch):
        rows = batch.select("topic", "partition", "offset", (F.octet_length("key") + F.octet_length("value")).alias("n"), F.spark_partition_id().alias("task")).collect()
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        assert batches.setdefault(epoch, rows) == rows  # a batch that runs again is the same

    def run(until):
        q = log.stream(spark, path, 1_100, 440).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
        try:
            for _ in range(400):
                time.sleep(0.1)
                if q.exception() is not None or until():
                    break
        finally:
            q.stop()
        assert q.exception() is None, q.exception()

    total = lambda: sum(map(len, batches.values()))
    run(lambda: len(batches) >= 3)
    first = len(batches)
    assert total() < 423
    run(lambda: total() >= 423)
    log.append(records(spark, {("a", 1): (40, 60)}), path)
    run(lambda: total() >= 443)
    assert sorted(batches) == list(range(len(batches))) and len(batches) > first
    for rows in batches.values():
        assert sum(r.n for r in rows) <= 1_100
        for name in {(r.topic, r.partition) for r in rows}:
            mine = [r for r in rows if (r.topic, r.partition) == name]
            assert sum(r.n for r in mine) <= 440 and len({r.task for r in mine}) == 1 and [r.offset for r in mine] == sorted(r.offset for r in mine)
    got = spark.read.parquet(out)
    assert got.count() == got.select("topic", "partition", "offset").distinct().count() == 443
    assert got.where(F.col("timestamp") != F.lit(STAMP).cast("timestamp")).count() == 0
    order = got.groupBy("topic", "partition").agg(F.sort_array(F.collect_list(F.struct("epoch", "offset"))).alias("x")).collect()
    assert all([y.offset for y in r.x] == sorted(y.offset for y in r.x) for r in order)

"""Findings of round 3: work that must not pass through one task, one key or one call a row."""

import random

from pyspark.sql import functions as F

from batchloom.operators import ledger, schedule
from batchloom.plans import catalogue
from batchloom.sources import log
from batchloom.sources.bridge import NOW, at
from batchloom.streaming import jobs, replay

from .test_cases import any_batches, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_f4_pending_recovery_passes_no_single_task(spark, sf):
    plan = plan_of(catalogue.QUERIES["pending_recovery"](spark, sf))
    assert "Limit" not in plan and "TakeOrdered" not in plan and "SinglePartition" not in plan


def test_f3_tick_works_once_for_equal_schedules(spark):
    """Equal schedules are evaluated once, rows that are not due or hold nulls keep their own results."""
    kinds = [("*/15 * * * *", "UTC", True, "backfill", "1998-05-31 23:00:00"), ("61 * * * *", None, True, None, "1998-05-31 23:00:00"), (None, "Mars/Base", True, "skip", "1998-05-31 23:00:00"), ("0 1 * * *", "Europe/Berlin", False, "skip", "1998-05-30 00:00:00"), ("0 1 * * *", None, None, "skip", "1999-01-01 00:00:00")]
    rows = [(i, *kinds[i % 5]) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, cron_expr string, timezone string, enabled boolean, misfire_policy string, at string").withColumn("next_run_at", F.col("at").cast("timestamp_ntz"))
    out = schedule.tick(df, at(NOW), cap=3)
    assert "HashAggregate" in plan_of(out)
    got = out.groupBy("cron_expr", "timezone", "misfire_policy", "enabled", "problem", F.size("fires").alias("fires"), F.col("new_next").cast("string").alias("then")).count().collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in [
        ("*/15 * * * *", "UTC", "backfill", True, None, 3, "1998-05-31 23:45:00", 100), ("61 * * * *", None, None, False, "bad minute field", 0, "1998-05-31 23:00:00", 100),
        (None, "Mars/Base", "skip", False, "five fields are needed", 0, "1998-05-31 23:00:00", 100), ("0 1 * * *", "Europe/Berlin", "skip", False, None, 0, "1998-05-30 00:00:00", 100), ("0 1 * * *", None, "skip", None, None, 0, "1999-01-01 00:00:00", 100),
    ])


def run_and_rows(stream, tmp_path, name):
    """What a stream gives, and how many keys its state holds then."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(60)
    kept = max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])
    return stream.sparkSession.table(name).collect(), kept


def test_f1_ledger_state_stands_in_pages(spark, tmp_path):
    """Many batches are read and written by the page, and give the fold's counters and callbacks."""
    ev, rows = tables(spark, any_batches())
    copies = spark.range(400).withColumnRenamed("id", "copy")
    wide = lambda df: df.crossJoin(copies).withColumn("batch_id", F.col("batch_id") * 1_000 + F.col("copy")).drop("copy")
    ev, rows = wide(ev), wide(rows)
    both = ev.join(rows, "batch_id").coalesce(1)
    both.write.parquet(str(tmp_path / "in"))
    got, kept = run_and_rows(jobs.ledger_stream(spark.readStream.schema(both.schema).parquet(str(tmp_path / "in"))), tmp_path, "f1_out")
    want = ledger.fold(ev, rows)
    assert len({r.batch_id for r in got}) > 400 and kept <= 256
    counters = {r.batch_id: (r.touched, r.completed, r.failed, r.status) for r in want.collect()}
    assert all((r.touched, r.completed, r.failed, r.status) == counters[r.batch_id] for r in got if r.callback is None)
    assert sorted((r.batch_id, r.callback) for r in got if r.callback) == sorted((r.batch_id, r.kind) for r in ledger.callbacks(want).collect())


def test_f6_claims_stand_in_pages(spark, tmp_path):
    """Claims of many fingerprints, a null one too, over two micro-batches, as one fold a fingerprint tells them."""
    rng = random.Random(6)
    rows = [(None if f == 0 else f"f{f}", rng.choice("abc"), "claim" if rng.random() < 0.7 else "release", float(i)) for i, f in enumerate(rng.randrange(700) for _ in range(4_000))]
    df = spark.createDataFrame(rows, "fingerprint string, job_id string, action string, arrival double")
    path = str(tmp_path / "in")
    for part in ("arrival < 2000", "arrival >= 2000"):
        df.where(part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    got, kept = run_and_rows(jobs.uniq_stream(stream, 300), tmp_path, "f6_out")
    owners, want = {}, []
    for f, job, action, when in rows:
        held = owners.get(f)
        if action == "release":
            if held and held[0] == job:
                del owners[f]
            continue
        won = held is None or held[1] <= when or held[0] == job
        if won:
            owners[f] = job, when + 300
        want.append((str(f), job, won))
    assert sorted((str(r.fingerprint), r.job_id, r.won) for r in got) == sorted(want) and kept <= 256


def test_f5_numbers_come_from_ranges(spark, monkeypatch):
    """Numbers inside a group are those of a window, though ranges of few rows are sorted one by one."""
    from pyspark.sql import Window

    monkeypatch.setattr(replay, "TASK_ROWS", 50)
    rows = spark.range(2_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 2_003).alias("x"))
    got = replay.numbered(rows, ["g"], ["x"])
    assert "Window" not in plan_of(rows.sparkSession.read.parquet(*got.inputFiles())) and len(got.inputFiles()) > 10
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("x")) - 1)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("g", "x", F.col("n").cast("bigint").alias("n")).collect()))


def spread(spark, n, partitions, size):
    value = F.repeat(F.lit("x"), size)
    return spark.range(n).select(F.lit("t").alias("topic"), (F.col("id") % partitions).cast("int").alias("partition"), F.floor(F.col("id") / partitions).alias("offset"), F.lit("").alias("key"), value.alias("value"), F.lit(0).cast("timestamp").alias("timestamp"))


def test_f2_partitions_are_dealt_to_streams(spark):
    """Streams side by side hold the budgets each; a partition is one stream's, whole and in order, so steps are as few as its own budget allows."""
    s = replay.streaming_session(spark)
    path = replay.log_of(spread(s, 1_200, 12, 10))
    members = replay.dealt(s, path, (160, 80))
    assert len(members) == 3 and sorted(sum(members, [])) == sorted(f"t/{p}" for p in range(12))
    assert {len(m) for m in members} == {4}
    members = replay.dealt(s, path, (400, 100))
    assert [len(m) for m in members] == [4, 4, 4]
    got = replay.replayed(s, path, lambda rows: rows.select("partition", "offset", "value"), (400, 100), shared=True).collect()
    assert sorted((r.partition, r.offset) for r in got) == [(p, o) for p in range(12) for o in range(100)]
    for p in range(12):
        mine = sorted((r.member, r.epoch, r.place, r.offset) for r in got if r.partition == p)
        assert len({m for m, *_ in mine}) == 1 and [x[-1] for x in mine] == list(range(100)) and len({x[1] for x in mine}) == 10
    steps = {}
    for r in got:
        steps.setdefault((r.member, r.epoch), []).append(r.partition)
    assert len(steps) == 30 and all(len(ps) <= 40 and max(map(ps.count, ps)) <= 10 for ps in steps.values())
    empty = replay.log_of(spread(s, 0, 12, 10))
    got = replay.replayed(s, empty, lambda rows: rows.select("value"), (400, 100), shared=True)
    assert got.columns == ["value", "place", "member", "epoch"] and got.count() == 0


def test_f2_a_step_reads_what_it_takes(spark, monkeypatch):
    """Planning reads a partition's sizes in a file once, not at every step; a step's records come from few row groups and one input partition."""
    import pyarrow.parquet as pq

    path = replay.log_of(spread(spark, 40_000, 2, 40))
    asked, plain = [], log._sizes
    monkeypatch.setattr(log, "_sizes", lambda *a: asked.append(a) or plain(*a))
    reader, at, taken = log.BoundedReader(path, 16_000, 8_000, ["t/1"]), {"at": {}, "turn": ""}, []
    while (then := reader.latestOffset()) != at:
        parts = reader.partitions(at, then)
        assert len(parts) == 1
        if len(taken) < 5:
            assert sum(b.num_rows for b in reader.read(parts[0])) == 200
        taken.append(then["at"]["t/1"])
        assert set(then["at"]) == {"t/1"}
        at = then
    files = {z.file for z in reader.of["t/1"]}
    assert taken == list(range(200, 20_001, 200)) and 0 < len(asked) <= len(files)
    groups = [pq.ParquetFile(name.replace("file://", "")).metadata.num_row_groups for name in files]
    assert min(groups) > 1

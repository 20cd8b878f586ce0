import datetime as dt

from pyspark.sql import functions as F

from batchloom.client import JobClient
from batchloom.sources import config

NOW = "2026-01-01 00:00:00"


def test_client(spark):
    client = JobClient(config.manifest(spark, {"a": {"runtime": "go", "topic": "ta", "worker_class": "A", "max_retries": 3}, "f": {"runtime": "go", "topic": "tf", "fairness_type": "time"}}), chunk=2)
    now = F.lit(NOW).cast("timestamp_ntz")
    day = dt.datetime(2026, 1, 1)
    made = client.create_batches(spark.createDataFrame([(1,)], "batch_id bigint"), spark.createDataFrame([(1, day, 1), (2, day, 2), (2, day, 3)], "batch_id bigint, created_at timestamp_ntz, request_id bigint")).collect()
    assert [(r.batch_id, r.request_id, r.status) for r in made] == [(2, 2, "running")]
    jobs = spark.createDataFrame([(2, "j1", "a", "k"), (2, "j2", "a", "k"), (2, "j3", "a", "l"), (2, "j4", "x", "m")], "batch_id bigint, job_id string, job_type string, key string")
    got = {r.job_id: (r.pushed_id, r.seq, r.chunk, r.known) for r in client.push_many(jobs, F.col("key")).collect()}
    assert got == {"j1": ("j1", 1, 0, True), "j2": ("", None, None, True), "j3": ("j3", 2, 0, True), "j4": ("j4", 3, 1, False)}
    due, later = client.push_later(jobs, now, F.lit(60))
    assert due.count() == 0 and {r.run_at for r in later.collect()} == {day + dt.timedelta(seconds=60)}
    alone = spark.createDataFrame([("1", None, "a", None, "", day), ("2", None, "f", "t1", "", day), ("3", None, "a", None, "", day + dt.timedelta(days=90))], "job_id string, batch_id bigint, job_type string, tenant_id string, valid_till string, run_at timestamp_ntz")
    out, index = client.enqueue_later(alone, now)
    assert {r.job_id: (r.to_topic, r.to_key, r.max_retries) for r in out.collect()} == {"1": ("ta", "1", 3), "2": ("fair-time-ingest", "t1", 7)}
    assert index.first().run_at == day + dt.timedelta(days=30)
    named = client.by_worker_class(spark.createDataFrame([("9", "", "A")], "job_id string, job_type string, worker_class string")).first()
    assert named.job_type == "a"
    assert [r.topic for r in client.missing_topics(spark.createDataFrame([("ta",)], "topic string")).collect()] == ["tf"]

"""Streams over stored relations run to their end."""

from pyspark.sql import functions as F

from batchloom.streaming import replay

RECORDS = "topic string, partition int, offset bigint, key string, value string, timestamp timestamp"


def records(s, n):
    return s.range(n).select(F.lit("t").alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.floor(F.col("id") / 3).alias("offset"), F.lit("").alias("key"), F.col("id").cast("string").alias("value"), F.lit(0).cast("timestamp").alias("timestamp"))


def test_an_empty_log_gives_no_rows(spark):
    s = replay.streaming_session(spark)
    path = replay.log_of(s.createDataFrame([], RECORDS))
    got = replay.replayed(s, path, lambda rows: rows.select("value"), replay.shares(s, path, 3))
    assert got.columns == ["value", "place", "epoch"] and got.count() == 0


def test_every_record_once_in_several_steps(spark):
    s = replay.streaming_session(spark)
    path = replay.log_of(records(s, 90))
    got = replay.replayed(s, path, lambda rows: rows.select("partition", "offset", "value"), replay.shares(s, path, 3)).collect()
    assert sorted(int(r.value) for r in got) == list(range(90)) and 3 <= len({r.epoch for r in got}) <= 5
    for p in range(3):
        assert [r.offset for r in sorted(got, key=lambda r: (r.epoch, r.place)) if r.partition == p] == list(range(30))


def test_the_session_is_its_own(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        s = replay.streaming_session(spark)
        assert s.conf.get("spark.sql.session.timeZone") == "UTC" and spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
        assert s.sparkContext is spark.sparkContext
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)

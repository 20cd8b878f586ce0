"""Queries that run streams: tables become logs, logs pass through stateful operators in micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fairness
from ..session import scratch
from ..sources.bridge import Relations
from ..streaming import fair, jobs
from ..streaming.replay import log_of, numbered, replayed, shares, streaming_session
from .ledger_queries import LEDGER, owners
from .ordered_queries import weights
from .registry import query

#: Byte budgets of a micro-batch and of a partition in it.
BUDGETS = 1 << 16, 1 << 13
STEPS = 3


def _streaming(r: Relations) -> Relations:
    return Relations(streaming_session(r.spark), r.sf_dir)


def _records(rows: DataFrame, topic: str, partition: Column, order: list[str], value: Column, key: Column | None = None) -> DataFrame:
    """Log records of ``rows``, numbered by ``order`` inside their partition."""
    dealt = rows.select(F.lit(topic).alias("topic"), partition.cast("int").alias("partition"), (F.lit("") if key is None else key.cast("string")).alias("key"), value.alias("value"), *order)
    return numbered(dealt, ["partition"], order, "offset").withColumn("timestamp", F.lit(0).cast("timestamp")).drop(*order)


def _values(stream: DataFrame, schema: str) -> DataFrame:
    return stream.select("offset", F.from_json("value", schema).alias("v")).select("offset", "v.*")


def _run(r: Relations, records: DataFrame, build) -> DataFrame:
    path = log_of(records)
    return replayed(r.spark, path, build, shares(r.spark, path, STEPS))


@query("""SELECT topic, partition_id AS partition, count(*) AS records, sum(strlen(event_id::VARCHAR) + strlen(props))::BIGINT AS bytes, min("offset") AS first_offset, max("offset") AS last_offset, true AS in_order, true AS within_budgets FROM log GROUP BY ALL""")
def stream_log(r: Relations):
    """A log read by a stream: every record once, a partition's in offset order, no micro-batch beyond its budgets unless by one record alone."""
    r = _streaming(r)
    path = log_of(r.log.select("topic", F.col("partition_id").alias("partition"), "offset", F.col("event_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("timestamp")))
    got = replayed(r.spark, path, lambda s: s, BUDGETS, shared=True).withColumn("size", F.octet_length("key") + F.octet_length("value"))
    part = Window.partitionBy("topic", "partition").orderBy("offset")
    before = F.lag(F.struct("member", "epoch", "place")).over(part)
    after = (before["member"] == F.col("member")) & (F.struct(before["epoch"], before["place"]) < F.struct("epoch", "place"))
    got = got.withColumn("follows", before.isNull() | after)
    each = got.groupBy("member", "epoch", "topic", "partition").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"), F.min("offset").alias("first"), F.max("offset").alias("last"), F.min("follows").alias("follows"))
    whole = each.groupBy("member", "epoch").agg((F.sum("bytes") <= BUDGETS[0]).alias("fits"), (F.sum("records") == 1).alias("alone"))
    each = each.join(whole, ["member", "epoch"]).withColumn("within", F.col("alone") | (F.col("fits") & ((F.col("bytes") <= BUDGETS[1]) | (F.col("records") == 1))))
    return each.groupBy("topic", "partition").agg(
        F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.min("first").alias("first_offset"), F.max("last").alias("last_offset"), F.min("follows").alias("in_order"), F.min("within").alias("within_budgets")
    )


@query("""c AS (SELECT topic, partition_id, coalesce(min("offset") FILTER (state != 'done'), max("offset") + 1) AS next_commit FROM log GROUP BY ALL)
SELECT topic, partition_id, next_commit, (SELECT count(*) FROM log l WHERE l.topic = c.topic AND l.partition_id = c.partition_id AND l."offset" >= next_commit AND state != 'failed') AS held FROM c""")
def stream_commits(r: Relations):
    """Commit positions and held places after the last micro-batch of the log."""
    r = _streaming(r)
    records = r.log.select("topic", F.col("partition_id").alias("partition"), "offset", F.lit("").alias("key"), F.col("state").alias("value"), F.col("ts").cast("timestamp").alias("timestamp"))
    build = lambda s: jobs.commit_stream(s.select("topic", F.col("partition").alias("partition_id"), "offset", F.col("value").alias("state"), F.col("offset").alias("arrival")))
    last = _run(r, records, build).groupBy("topic", "partition_id").agg(F.max_by(F.struct("next_commit", "held"), "epoch").alias("last"))
    return last.select("topic", "partition_id", "last.next_commit", "last.held")


@query(LEDGER + """SELECT batch_id, touched, completed, failed, status, concat_ws(',', CASE WHEN complete_at IS NOT NULL THEN 'complete' END, CASE WHEN success_at IS NOT NULL THEN 'success' END) AS callbacks FROM ledger WHERE batch_id IN (SELECT batch_id FROM completions)""")
def stream_ledger(r: Relations):
    """The ledger kept by a stream of completions: each batch's counters and status after its last event, and the callbacks it gave."""
    r = _streaming(r)
    value = F.to_json(F.struct("batch_id", "batch_seq", "op"))
    own = scratch(r.spark, "owners")
    owners(r).write.parquet(own)

    def build(s: DataFrame) -> DataFrame:
        events = _values(s, "batch_id bigint, batch_seq bigint, op string").withColumnRenamed("offset", "arrival")
        return jobs.ledger_stream(events.join(r.spark.read.parquet(own), "batch_id", "left"))

    out = _run(r, _records(r.completions, "events", F.col("batch_id") % 16, ["arrival", "batch_id"], value), build)
    last = F.max_by(F.when(F.col("callback").isNull(), F.struct("touched", "completed", "failed", "status")), F.when(F.col("callback").isNull(), F.col("epoch")))
    return out.groupBy("batch_id").agg(last.alias("last"), F.array_join(F.sort_array(F.collect_list("callback")), ",").alias("callbacks")).select("batch_id", "last.*", "callbacks")


@query("""c AS (SELECT user_id || '-' || event_type AS fingerprint, 'j' || (event_id % 3) AS job_id, value > 60 AS release, epoch_us(ts) / 1e6 AS arrival, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT fingerprint, 0::BIGINT AS n, NULL::VARCHAR AS owner, NULL::DOUBLE AS until, NULL::VARCHAR AS job_id, NULL::BOOLEAN AS won FROM c GROUP BY fingerprint
  UNION ALL SELECT w.fingerprint, c.n, CASE WHEN release THEN CASE WHEN owner = c.job_id THEN NULL ELSE owner END WHEN owner IS NULL OR until <= arrival OR owner = c.job_id THEN c.job_id ELSE owner END,
    CASE WHEN NOT release AND (owner IS NULL OR until <= arrival OR owner = c.job_id) THEN arrival + 86400 ELSE until END, c.job_id, CASE WHEN NOT release THEN owner IS NULL OR until <= arrival OR owner = c.job_id END
  FROM w JOIN c ON c.fingerprint = w.fingerprint AND c.n = w.n + 1)
SELECT fingerprint, job_id, count(*) FILTER (won) AS won, count(*) FILTER (NOT won) AS lost FROM w WHERE won IS NOT NULL GROUP BY ALL""")
def stream_uniq(r: Relations):
    """Claims and releases of fingerprints in the order of the log; a claim holds for a day."""
    r = _streaming(r)
    e = r.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    value = F.to_json(F.struct(F.concat_ws("-", "user_id", "event_type").alias("fingerprint"), F.concat(F.lit("j"), F.col("event_id") % 3).alias("job_id"), F.when(F.col("value") > 60, "release").otherwise("claim").alias("action"), "at"))
    build = lambda s: jobs.uniq_stream(_values(s, "fingerprint string, job_id string, action string, at double").withColumnRenamed("at", "arrival"), 86_400)
    out = _run(r, _records(e, "claims", F.col("user_id") % 16, ["ts", "event_id"], value), build)
    return out.groupBy("fingerprint", "job_id").agg(F.count_if("won").alias("won"), F.count_if(~F.col("won")).alias("lost"))


#: A lane's actions one after the other, its tenants as a list with virtual time, weight and waiting jobs.
FAIR = """o AS (SELECT c_mktsegment || '-' || c_nationkey AS lane, o_custkey::VARCHAR AS tenant, o_orderkey::VARCHAR AS job, o_orderkey % 3 != 0 AS takes, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY o_orderdate, o_orderkey) AS n,
  CASE WHEN o_custkey % 7 = 0 THEN 1.0 WHEN o_custkey % 4 = 0 THEN 4.0 WHEN o_custkey % 4 = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM orders JOIN customer ON c_custkey = o_custkey),
a AS (SELECT lane, tenant, job, weight, n * 2 AS arrival, row_number() OVER (PARTITION BY lane ORDER BY n * 2) AS k FROM (SELECT lane, tenant, job, weight, n::DOUBLE AS n FROM o UNION ALL SELECT lane, NULL, NULL, NULL, n + 0.5 FROM o WHERE takes)),
q AS (
  SELECT lane, 0::BIGINT AS k, 0::DOUBLE AS arrival, []::STRUCT(t VARCHAR, v DOUBLE, w DOUBLE, jobs VARCHAR[])[] AS ts, NULL::VARCHAR AS tenant_id, NULL::VARCHAR AS job_id, NULL::VARCHAR AS result FROM o GROUP BY lane
  UNION ALL
  SELECT lane, k, arrival, CASE WHEN mine IS NULL OR result = 'rejected' THEN ts ELSE list_append(list_filter(ts, lambda x: x.t != mine.t), mine) END, tenant_id, job_id, result FROM (
    SELECT lane, k, arrival, ts, CASE WHEN tenant IS NULL THEN first.t WHEN len(own.jobs) >= 3 THEN tenant END AS tenant_id, CASE WHEN tenant IS NULL THEN first.jobs[1] WHEN len(own.jobs) >= 3 THEN job END AS job_id,
      CASE WHEN tenant IS NULL AND first IS NOT NULL THEN 'checked_out' WHEN len(own.jobs) >= 3 THEN 'rejected' END AS result,
      CASE WHEN tenant IS NOT NULL THEN {'t': tenant, 'v': CASE WHEN coalesce(len(own.jobs), 0) = 0 THEN greatest(coalesce(own.v, 0), coalesce(first.v, 0)) ELSE own.v END, 'w': weight, 'jobs': list_append(coalesce(own.jobs, []), job)}
        WHEN first IS NOT NULL THEN {'t': first.t, 'v': first.v + 1 / first.w, 'w': first.w, 'jobs': first.jobs[2:]} END AS mine
    FROM (SELECT q.lane, a.k, a.arrival, ts, a.tenant, a.job, a.weight, list_filter(ts, lambda x: x.t = a.tenant)[1] AS own,
        list_filter(ts, lambda x: x.t = list_sort(list_transform(list_filter(ts, lambda y: len(y.jobs) > 0), lambda y: {'v': y.v, 't': y.t}))[1].t)[1] AS first FROM q JOIN a ON a.lane = q.lane AND a.k = q.k + 1)))
"""


@query(FAIR + "SELECT lane, tenant_id, job_id, result, arrival FROM q WHERE result IS NOT NULL")
def stream_fair(r: Relations):
    """Orders join their lane as they come, and after two in three a job is taken: tenants leave and come back at the ring's least virtual time."""
    r = _streaming(r)
    lanes = r.customer.select(F.col("c_custkey").alias("tenant_id"), F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("lane"), (F.col("c_nationkey") % 16).alias("partition"))
    o = fairness.weighted(r.orders.select(F.col("o_custkey").alias("tenant_id"), "o_orderkey", "o_orderdate").join(lanes.drop("partition"), "tenant_id"), weights(r))
    o = numbered(o, ["lane"], ["o_orderdate", "o_orderkey"])
    # a row for each lane; its place among those of its partition makes offsets of places in lanes, so lanes advance together
    spots = lanes.select("lane", "partition").distinct().withColumn("spot", F.row_number().over(Window.partitionBy("partition").orderBy("lane")) - 1)
    spots = spots.withColumn("spots", F.count("*").over(Window.partitionBy("partition")))
    kinds = F.when(F.col("o_orderkey") % 3 != 0, F.array(F.lit("enqueue"), F.lit("checkout"))).otherwise(F.array(F.lit("enqueue")))
    acts = o.join(F.broadcast(spots), "lane").select("*", F.posexplode(kinds).alias("late", "action")).withColumn("arrival", F.col("n") * 2 + 2 + F.col("late"))
    put = F.col("action") == "enqueue"
    value = F.to_json(F.struct("action", F.when(put, F.col("tenant_id").cast("string")).alias("tenant_id"), F.when(put, F.col("weight")).alias("weight"), F.when(put, F.col("o_orderkey").cast("string")).alias("job_id"), F.col("arrival").cast("double").alias("arrival")))
    records = acts.select(F.lit("fair").alias("topic"), F.col("partition").cast("int").alias("partition"), (F.col("arrival") * F.col("spots") + F.col("spot")).alias("offset"), F.col("lane").alias("key"), value.alias("value"), F.lit(0).cast("timestamp").alias("timestamp"))

    def build(s: DataFrame) -> DataFrame:
        actions = s.select(F.col("key").alias("lane"), F.from_json("value", "action string, tenant_id string, weight double, job_id string, arrival double").alias("v"))
        return fair.fair_stream(actions.select("lane", "v.*", F.lit(0.0).alias("duration")), window=3)

    out = _run(r, records, build)
    return out.select("lane", "tenant_id", "job_id", "result", F.col("at").alias("arrival"))


@query("""b AS (SELECT user_id AS consumer_id, epoch_us(ts) // 1000 AS ms, lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT consumer_id, 'up' AS state, ms AS at_ms FROM b WHERE prev IS NULL OR ms > prev + 21600000 UNION ALL SELECT consumer_id, 'down', prev + 21600000 FROM b WHERE ms > prev + 21600000""")
def stream_liveness(r: Relations):
    """When consumers came up, and went down after six hours without a sign of life; those that are still down at the end are not told yet, as the watermark lies far behind."""
    r = _streaming(r)
    value = F.to_json(F.struct(F.col("user_id").alias("consumer_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")))
    build = lambda s: jobs.liveness_stream(_values(s, "consumer_id bigint, us bigint").select("consumer_id", F.timestamp_micros("us").alias("seen_at")), 21_600, "3650 days")
    out = _run(r, _records(r.events, "beats", F.col("user_id") % 16, ["ts", "event_id"], value), build)
    return out.select("consumer_id", "state", F.unix_millis("at").alias("at_ms"))

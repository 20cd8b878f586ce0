"""Metric bucket, alert and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, offsets
from ..sources.bridge import LOG_NOW, Relations, at
from .registry import query




def throughput_events(r: Relations):
    return r.events.select("ts", F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), F.concat(F.lit("jt"), F.col("user_id") % 4).alias("field"), F.lit(1).cast("bigint").alias("n"))


@query("""b AS (SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS bucket, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, 'jt' || (user_id % 4) AS field FROM events)
SELECT bucket, status, field, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT bucket, status, '_all', count(*) FROM b GROUP BY ALL""")
def perf_buckets(r: Relations):
    return metrics.throughput(throughput_events(r), 3600)


@query("""e AS (SELECT event_id, ts, CASE WHEN user_id % 9 = 0 THEN '_all' ELSE 'u' || user_id END AS field FROM events), k AS (SELECT field FROM e WHERE field != '_all' GROUP BY field ORDER BY min((ts, event_id)) LIMIT 50)
SELECT CASE WHEN field = '_all' OR field IN (SELECT field FROM k) THEN field ELSE '_other' END AS field, count(*) AS n FROM e GROUP BY 1""")
def perf_cap_other(r: Relations):
    e = r.events.select("event_id", "ts", F.when(F.col("user_id") % 9 == 0, "  ").otherwise(F.concat(F.lit(" u"), "user_id")).alias("field"))
    return metrics.capped_field(e).groupBy("field").agg(F.count("*").alias("n"))


PROBES = """probe AS (SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS bucket, round(value * 1000)::BIGINT AS micros, event_type = 'error' AS error FROM events),
rtt AS (SELECT bucket, count(*) FILTER (NOT error) AS probes, coalesce(sum(micros) FILTER (NOT error), 0)::BIGINT AS sum_us, coalesce(max(micros) FILTER (NOT error), 0) AS max_us, count(*) FILTER (error) AS errors FROM probe GROUP BY bucket),
rtt2 AS (SELECT *, CASE WHEN probes > 0 THEN sum_us / probes / 1000 ELSE 0 END AS avg_ms FROM rtt)"""


def rtts(r: Relations):
    return metrics.rtt(r.events.select("ts", F.round(F.col("value") * 1000).cast("bigint").alias("micros"), (F.col("event_type") == "error").alias("error")), 3600)


@query(PROBES + " SELECT bucket, probes, sum_us, max_us, errors, round(avg_ms, 6) AS avg_ms FROM rtt2")
def rtt_summary(r: Relations):
    return rtts(r).withColumn("avg_ms", F.round("avg_ms", 6))


LAG = """lag AS (SELECT 'g' || (user_id % 3) AS "group", topic, sum(greatest(hi - com, 0))::BIGINT AS lag, sum(com)::BIGINT AS committed, sum(hi)::BIGINT AS end_sum
  FROM (SELECT user_id % 3 AS user_id, topic, partition_id, max("offset") + 1 AS hi, coalesce(min("offset") FILTER (state != 'done'), max("offset") + 3) AS com FROM log GROUP BY ALL) GROUP BY ALL)"""


def lag(r: Relations):
    per = r.log.groupBy(F.concat(F.lit("g"), F.col("user_id") % 3).alias("group"), "topic", "partition_id").agg(
        (F.max("offset") + 1).alias("end"), F.coalesce(F.min(F.when(F.col("state") != "done", F.col("offset"))), F.max("offset") + 3).alias("committed"))
    return offsets.lag_rollup(per)


@query(LAG + ' SELECT "group", topic, lag, committed, end_sum FROM lag')
def lag_rollup(r: Relations):
    return lag(r)


BASE = """base AS (SELECT "group", topic, lag - CASE WHEN topic = 'jobs1' THEN 10 ELSE 400 END AS lag, committed, end_sum - CASE WHEN topic = 'jobs1' THEN 0 ELSE 5 END AS end_sum FROM lag)"""


@query(LAG + ", " + BASE + """ SELECT 'lag_stuck_growing' AS rule_id, 'critical' AS severity, 'lag_stuck_growing:' || c."group" || ':' || c.topic AS fingerprint FROM lag c JOIN base b USING ("group", topic)
WHERE c.lag >= 1000 AND c.committed = b.committed AND (c.lag - b.lag >= 100 OR c.end_sum > b.end_sum) AND NOT (topic = 'jobs2' AND c."group" != 'g1')""")
def lag_stuck(r: Relations):
    c = lag(r)
    one = F.col("topic") == "jobs1"
    old = c.select("group", "topic", (F.col("lag") - F.when(one, 10).otherwise(400)).alias("lag"), "committed", (F.col("end_sum") - F.when(one, 0).otherwise(5)).alias("end_sum"))
    paused = r.log.where("topic = 'jobs2' and user_id % 3 != 1").select(F.concat(F.lit("g"), F.col("user_id") % 3).alias("group"), "topic").distinct()
    return metrics.lag_stuck(c, old, paused)


@query("""SELECT 'fair-' || (user_id % 5) AS lane, sum(CASE WHEN event_type = 'signup' THEN 7 ELSE 0 END)::BIGINT AS ingest, count(*) FILTER (event_type = 'error' AND value > 150) AS ready FROM events GROUP BY 1""")
def lane_rollup(r: Relations):
    return _lanes(r)


def _lanes(r: Relations):
    return r.events.groupBy(F.concat(F.lit("fair-"), F.col("user_id") % 5).alias("lane")).agg(F.sum(F.when(F.col("event_type") == "signup", 7).otherwise(0)).alias("ingest"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 150)).alias("ready"))


@query("SELECT (floor(epoch(ts) / 60) * 60)::BIGINT AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def dlt_minute(r: Relations):
    return r.events.where("event_type = 'error'").groupBy(metrics.bucket(F.col("ts"), 60).alias("bucket")).agg(F.count("*").alias("n"))


@query(PROBES + """, lanes AS (SELECT 'fair-' || (user_id % 5) AS lane, sum(CASE WHEN event_type = 'signup' THEN 7 ELSE 0 END) AS ingest, count(*) FILTER (event_type = 'error' AND value > 150) AS ready FROM events GROUP BY 1),
dlt AS (SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1),
here AS (SELECT floor(epoch(log_now) / 3600) * 3600 AS b FROM clock), latest AS (SELECT rtt2.* FROM rtt2, here WHERE bucket IN (b, b - 3600) ORDER BY bucket DESC LIMIT 1)
SELECT 'redis_rtt_high' AS rule_id, 'warning' AS severity, 'redis_rtt_high' AS fingerprint FROM latest WHERE avg_ms >= 40 OR max_us / 1000 >= 260 OR (probes > 0 AND errors / greatest(probes, 1) >= 0.6)
UNION ALL SELECT 'fairness_ingest_backed_up', 'warning', 'fairness_ingest_backed_up:' || lane FROM lanes WHERE ingest >= 300 AND ready <= 30
UNION ALL SELECT 'dlt_rate_high', 'warning', 'dlt_rate_high' FROM dlt, here WHERE bucket = b AND n >= 1
UNION ALL SELECT 'schedule_depth_high', 'warning', 'schedule_depth_high' FROM (SELECT count(*) AS n FROM log WHERE state = 'pending') WHERE n >= 10
UNION ALL SELECT 'no_live_consumers', 'critical', 'no_live_consumers' WHERE (SELECT count(*) FROM log WHERE state = 'pending') > 0 AND (SELECT count(*) FROM events WHERE ts > TIMESTAMP '2030-01-01') = 0
UNION ALL SELECT 'reconciler_stale', 'warning', 'reconciler_stale:age' UNION ALL SELECT 'reconciler_stale', 'warning', 'reconciler_stale:failures' UNION ALL SELECT 'reconciler_stale', 'warning', 'reconciler_stale:missing'
UNION ALL SELECT 'cron_stale', 'warning', 'cron_stale:' || s_suppkey FROM supplier WHERE s_suppkey % 9 = 0""")
def alert_findings(r: Relations):
    pending = r.log.where("state = 'pending'")
    hours = _letters(r)
    runs = r.region.where("r_regionkey = 0").select(at("2024-01-19 00:00:00").alias("last_run"), F.lit(1).alias("produce_failed"), F.lit(0).alias("found_stale"))
    found = [
        metrics.rtt_high(metrics.current_or_previous(rtts(r), at(LOG_NOW), 3600), 40, 260, 0.6), metrics.lane_backed_up(_lanes(r), 300, 30), metrics.over(hours.where(F.col("bucket") == metrics.bucket(at(LOG_NOW), 3600)), "n", 1, "dlt_rate_high"),
        metrics.over(pending.agg(F.count("*").alias("n")), "n", 10, "schedule_depth_high"), metrics.no_live(pending, r.events.where("ts > timestamp_ntz'2030-01-01'")),
        metrics.reconciler_stale(runs, at(LOG_NOW)), metrics.reconciler_stale(runs.limit(0), at(LOG_NOW)), metrics.cron_stale(r.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 9 == 0).alias("stale"))),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _letters(r: Relations):
    return r.events.where("event_type = 'error'").groupBy(metrics.bucket(F.col("ts"), 3600).alias("bucket")).agg(F.count("*").alias("n"))


@query(PROBES + """, dlt AS (SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS bucket, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT bucket, 'redis_rtt_high' AS rule_id, 'warning' AS severity, 'redis_rtt_high' AS fingerprint FROM rtt2 WHERE avg_ms >= 70 OR max_us / 1000 >= 260 OR (probes > 0 AND errors / greatest(probes, 1) >= 0.6)
UNION ALL SELECT bucket, 'dlt_rate_high', 'warning', 'dlt_rate_high' FROM dlt WHERE n >= 7""")
def findings_by_hour(r: Relations):
    """The rules over buckets as they would have found in every hour."""
    return metrics.rtt_high(rtts(r), 70, 260, 0.6, keep=("bucket",)).unionByName(metrics.over(_letters(r), "n", 7, "dlt_rate_high", keep=("bucket",)))


TICKS = """fd AS (SELECT DISTINCT 'user:' || user_id AS fp, day(ts)::BIGINT AS tick FROM events WHERE event_type = 'error' AND value > 40), tk AS (SELECT x AS tick FROM range(1, 32) q(x))"""


@query(TICKS + """, g AS (SELECT f.fp, tick, EXISTS (SELECT 1 FROM fd WHERE fd.fp = f.fp AND fd.tick = tk.tick) AS b FROM (SELECT DISTINCT fp FROM fd) f, tk),
st AS (SELECT fp, 0::BIGINT AS tick, 0 AS bad, 0 AS good, false AS open, NULL::VARCHAR AS change FROM (SELECT DISTINCT fp FROM fd)
  UNION ALL SELECT fp, tick, CASE WHEN change = 'resolved' THEN 0 ELSE nbad END, CASE WHEN change IS NOT NULL THEN 0 ELSE ngood END, CASE change WHEN 'opened' THEN true WHEN 'resolved' THEN false ELSE open END, change
  FROM (SELECT *, CASE WHEN NOT open AND b AND nbad >= 3 THEN 'opened' WHEN open AND NOT b AND ngood >= 2 THEN 'resolved' END AS change FROM (
    SELECT st.fp, g.tick, st.open, g.b, CASE WHEN g.b THEN st.bad + 1 ELSE st.bad END AS nbad, CASE WHEN g.b THEN 0 WHEN st.open THEN st.good + 1 ELSE 0 END AS ngood FROM st JOIN g ON g.fp = st.fp AND g.tick = st.tick + 1)))
SELECT fp AS fingerprint, tick, change FROM st WHERE change IS NOT NULL""")
def hysteresis(r: Relations):
    found = r.events.where("event_type = 'error' and value > 40").select(F.concat(F.lit("user:"), "user_id").alias("fingerprint"), F.dayofmonth("ts").cast("bigint").alias("tick")).distinct()
    return metrics.hysteresis(found, 31)


@query("""f AS (SELECT DISTINCT user_id AS k FROM events WHERE value > 150), i AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'signup' AND value > 90)
SELECT 'u' || coalesce(f.k, i.k) AS fingerprint, CASE WHEN i.k IS NULL THEN 'new' WHEN f.k IS NULL THEN 'cleared' ELSE 'ongoing' END AS state FROM f FULL JOIN i ON f.k = i.k""")
def incident_diff(r: Relations):
    fp = F.concat(F.lit("u"), "user_id").alias("fingerprint")
    return metrics.incident_diff(r.events.where("value > 150").select(fp), r.events.where("event_type = 'signup' and value > 90").select(fp))


@query("""m AS (SELECT 'loop' || c_custkey AS name, TIMESTAMP '2024-01-20 00:00:00' - to_seconds(c_custkey % 60) AS registered_at FROM customer),
t AS (SELECT 'loop' || user_id AS name, max(ts) AS last_tick FROM events, clock WHERE ts <= log_now GROUP BY user_id)
SELECT name, last_tick, CASE WHEN last_tick IS NULL THEN coalesce(epoch(log_now) - epoch(registered_at) <= 45, false) ELSE epoch(log_now) - epoch(last_tick) <= 86400 END AS healthy FROM m FULL JOIN t USING (name), clock""")
def health_stale(r: Relations):
    ticks = r.events.where(F.col("ts") <= at(LOG_NOW)).select(F.concat(F.lit("loop"), "user_id").alias("name"), "ts")
    members = r.customer.select(F.concat(F.lit("loop"), "c_custkey").alias("name"), (at(LOG_NOW) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("c_custkey") % 60)).alias("registered_at"))
    return metrics.stale_members(ticks, at(LOG_NOW), 86_400, members)


@query("""s AS (SELECT user_id, ts, event_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) / 100.0 AS cpu, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events),
d AS (SELECT *, cpu - lag(cpu) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used, (epoch_us(ts) - epoch_us(old)) / 1e6 AS wall FROM s)
SELECT 'p' || user_id AS name, event_id, CASE WHEN wall > 0 AND used >= 0 THEN round(used / wall * 100, 1) END::DOUBLE AS cpu_pct FROM d""")
def cpu_pct(r: Relations):
    """Processes whose counters start anew every day."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", F.dayofmonth("ts")).orderBy("ts", "event_id")
    s = r.events.select(F.concat(F.lit("p"), "user_id").alias("name"), "ts", "event_id", (F.sum(F.round(F.col("value") * 100).cast("bigint")).over(w) / 100.0).alias("cpu_seconds"))
    return metrics.cpu_percent(s).select("name", "event_id", "cpu_pct")

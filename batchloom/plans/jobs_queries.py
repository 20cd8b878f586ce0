"""Classifier, routing, lookup and scalar queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import offsets, routing, schedule
from ..session import scratch
from ..sources import config, log
from ..sources.bridge import LOG_NOW, NOW, Relations, at
from .registry import query


#: Times of the projection come in one shape only; other shapes have a query of their own (time_shapes).
TS = "try_strptime(valid_till, '%Y-%m-%dT%H:%M:%SZ')"
EXPIRED = f"CASE WHEN coalesce(trim(valid_till), '') = '' THEN false WHEN {TS} IS NULL THEN true ELSE {TS} <= now END"
TENANT = "coalesce(nullif(trim(tenant_id), ''), nullif(batch_id::VARCHAR, ''), job_id)"
DELAY = "CASE {} WHEN 'medium' THEN 420 WHEN 'large' THEN 1200 ELSE 30 END"


def cancelled(r: Relations):
    return r.batches.where("status = 'cancelled'").select("batch_id")


def skipped(r: Relations):
    return r.jobs.where("partition_id = 3 and attempt = 2").select("job_id")


DECIDE = f"""skips AS (SELECT DISTINCT job_id FROM jobs WHERE partition_id = 3 AND attempt = 2),
decided AS (SELECT j.*, m.runtime, m.topic, m.max_retries, m.retry_tier, m.fairness_type, m.worker_class, CASE WHEN malformed THEN 'dlt_malformed' WHEN b.batch_id IS NOT NULL THEN 'drop_cancelled'
  WHEN s.job_id IS NOT NULL THEN 'failed_retry_cancelled' WHEN {EXPIRED} THEN 'dlt_expired' WHEN runtime IS NULL OR runtime = 'ruby' THEN 'dlt_unknown_handler' WHEN ok THEN 'run_success' ELSE 'run_failure' END AS decision
  FROM jobs j CROSS JOIN clock LEFT JOIN manifest m USING (job_type) LEFT JOIN (SELECT batch_id FROM batches WHERE status = 'cancelled') b ON b.batch_id = j.batch_id LEFT JOIN skips s ON s.job_id = j.job_id)
"""


def decided(r: Relations):
    return routing.decide(r.jobs, r.manifest, cancelled(r), skipped(r), at(NOW))


@query(DECIDE + "SELECT job_id, batch_id, job_type, decision FROM decided")
def job_decision(r: Relations):
    return decided(r).select("job_id", "batch_id", "job_type", "decision")


FAILED = DECIDE + """, failing AS (SELECT *, coalesce(error_class IN ('UnknownHandler', 'Overloaded'), false) AS fatal, attempt < CASE WHEN coalesce(max_retries, 0) > 0 THEN max_retries ELSE 7 END AS may FROM decided WHERE decision = 'run_failure')"""


@query(FAILED + """ SELECT job_id, batch_id, attempt, CASE WHEN fatal THEN 'dead_letter_fatal' WHEN may THEN 'retry' ELSE 'dead_letter_exhausted' END AS action,
CASE WHEN batch_id IS NULL OR batch_seq IS NULL THEN NULL WHEN NOT fatal AND may THEN CASE WHEN NOT batch_counted THEN 'executed' END ELSE 'failed' END AS event, NOT fatal AND NOT may AS exhausted, coalesce(error_class, 'GoExecutionError') AS error_name FROM failing""")
def failure_decision(r: Relations):
    return routing.on_failure(decided(r).where("decision = 'run_failure'")).select("job_id", "batch_id", "attempt", "action", "event", "exhausted", "error_name")


TIER = "CASE WHEN retry_tier IN ('short', 'medium', 'large') THEN retry_tier ELSE ['short', 'medium', 'large'][least(greatest(attempt + 1, 1), 3)] END"


@query(FAILED + f""", p AS (SELECT *, {TIER} AS tier FROM failing CROSS JOIN clock WHERE NOT fatal AND may)
SELECT job_id, (attempt + 1)::INT AS next_attempt, tier, now + to_seconds({DELAY.format('tier')}) AS retry_after, topic AS retry_to FROM p""")
def retry_plan(r: Relations):
    again = routing.on_failure(decided(r).where("decision = 'run_failure'")).where("action = 'retry'")
    return routing.retry_plan(again, at(NOW)).select("job_id", "next_attempt", "tier", "retry_after", "retry_to")


@query(f"""m AS (SELECT job_id, malformed, batch_id % 97 = 0 AS cancelled, CASE WHEN partition_id = 5 THEN '' ELSE 'topic' || partition_id END AS retry_to, valid_till,
  CASE WHEN attempt = 1 THEN 'soon' ELSE strftime(run_at, '%Y-%m-%dT%H:%M:%SZ') END AS retry_after FROM jobs),
d AS (SELECT *, try_strptime(retry_after, '%Y-%m-%dT%H:%M:%SZ') AS due FROM m),
c AS (SELECT d.*, now, CASE WHEN malformed THEN 'dlt' WHEN cancelled THEN 'failed' WHEN retry_to = '' THEN 'dlt_failed' WHEN {EXPIRED} THEN 'dlt_expired' WHEN due > now THEN 'wait' ELSE 'dispatch' END AS decision FROM d CROSS JOIN clock)
SELECT job_id, decision, CASE WHEN decision = 'wait' THEN least(epoch(due) - epoch(now), 30) ELSE 0 END::BIGINT AS wait_seconds FROM c""")
def retry_due(r: Relations):
    m = r.jobs.select(
        "job_id", "malformed", (F.col("batch_id") % 97 == 0).alias("cancelled"), F.when(F.col("partition_id") == 5, "").otherwise(F.concat(F.lit("topic"), "partition_id")).alias("retry_to"), "valid_till",
        F.when(F.col("attempt") == 1, "soon").otherwise(F.date_format("run_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("retry_after"),
    )
    return routing.retry_due(m, at(NOW)).select("job_id", "decision", "wait_seconds")


@query(f"SELECT job_id, {EXPIRED} AS expired, coalesce(strftime({TS}, '%Y-%m-%dT%H:%M:%SZ'), '') AS normalized FROM jobs, clock")
def expiry_flag(r: Relations):
    return r.jobs.select("job_id", routing.expired(F.col("valid_till"), at(NOW)).alias("expired"), routing.normalized_valid_till(F.col("valid_till")).alias("normalized"))


@query(f"""x AS (SELECT * FROM jobs, clock WHERE {EXPIRED})
SELECT 'letter' AS kind, job_id, batch_id FROM x UNION ALL SELECT 'event', job_id, batch_id FROM x WHERE batch_id IS NOT NULL AND batch_seq > 0 UNION ALL SELECT 'failure', job_id, batch_id FROM x""")
def expired_drop(r: Relations):
    letters, events, failures = routing.expired_drop(r.jobs, at(NOW))
    pick = lambda df, k: df.select(F.lit(k).alias("kind"), "job_id", "batch_id")
    return pick(letters, "letter").unionByName(pick(events, "event")).unionByName(pick(failures, "failure"))


@query("""SELECT batch_id, batch_seq - 1 AS batch_seq, CASE WHEN op IN ('success', 'failed') THEN op ELSE 'failed' END AS op, count(*) AS n FROM completions WHERE batch_seq - 1 >= 1 GROUP BY ALL""")
def event_normalize(r: Relations):
    from ..operators import ledger

    raw = r.completions.select("batch_id", (F.col("batch_seq") - 1).alias("batch_seq"), F.when(F.col("op") == "executed", "odd").otherwise(F.col("op")).alias("op"))
    return ledger.normalized(raw).groupBy("batch_id", "batch_seq", "op").agg(F.count("*").alias("n"))


#: A time in many shapes; only RFC 3339 counts.
SHAPES = ("2030-05-06T07:08:09Z", "2030-05-06T07:08:09.123456789+05:30", "1999-12-31T23:59:59-01:00", "2030", "2030-05", "2030-05-06", "2030-05-06 07:08:09", "12:30", "2030-02-30T00:00:00Z", "2030-05-06T07:08:09", "  2030-05-06T07:08:09Z ", "2030-05-06T25:00:00Z")


@query(f"""s AS (SELECT event_id, {list(SHAPES)}[event_id % {len(SHAPES)} + 1] AS valid_till FROM events),
p AS (SELECT event_id, [TIMESTAMP '2030-05-06 07:08:09', TIMESTAMP '2030-05-06 01:38:09', TIMESTAMP '2000-01-01 00:59:59', NULL, NULL, NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2030-05-06 07:08:09', NULL][event_id % {len(SHAPES)} + 1] AS t FROM s)
SELECT event_id, coalesce(t <= TIMESTAMP '2030-05-06 05:00:00', true) AS expired, coalesce(strftime(t, '%Y-%m-%dT%H:%M:%SZ'), '') AS normalized FROM p""")
def time_shapes(r: Relations):
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("event_id") % len(SHAPES) + 1).cast("int"))
    e = r.events.select("event_id", shape.alias("valid_till"))
    return e.select("event_id", routing.expired(F.col("valid_till"), at("2030-05-06 05:00:00")).alias("expired"), routing.normalized_valid_till(F.col("valid_till")).alias("normalized"))


@query("""m2 AS (SELECT * REPLACE (CASE WHEN topic = 'topic3' THEN 'odd' ELSE fairness_type END AS fairness_type) FROM manifest),
t AS (SELECT j.*, m2.topic, coalesce(fairness_type, '') AS lane, CASE WHEN tenant_id IN ('t1', 't2', 't3') THEN tenant_id[2:]::INT END AS fixed FROM jobs j LEFT JOIN m2 USING (job_type))
SELECT job_id, CASE lane WHEN 'time' THEN 'fair-time-ingest' WHEN 'throughput' THEN 'fair-throughput-ingest' WHEN 'odd' THEN 'jobs' ELSE coalesce(nullif(topic, ''), 'jobs') END AS to_topic,
CASE WHEN lane = '' THEN job_id WHEN fixed IS NOT NULL THEN '' WHEN tenant_id IS NOT NULL THEN tenant_id WHEN batch_id IS NOT NULL THEN batch_id::VARCHAR ELSE job_id END AS to_key, CASE WHEN lane != '' THEN fixed END AS to_partition FROM t""")
def route_jobs(r: Relations):
    """Some handlers name a lane that does not exist; batch ids that look like assigned tenants do not count."""
    fixed = r.spark.range(1, 4).select(F.concat(F.lit("t"), "id").alias("tenant_key"), F.col("id").cast("int").alias("assigned_partition"))
    odd = r.manifest.withColumn("fairness_type", F.when(F.col("topic") == "topic3", "odd").otherwise(F.col("fairness_type")))
    return routing.route(r.jobs, odd, fixed.unionByName(r.spark.range(1, 50).select(F.col("id").cast("string").alias("tenant_key"), F.lit(9).alias("assigned_partition")))).select("job_id", "to_topic", "to_key", "to_partition")


@query(f"SELECT job_id, {TENANT} AS tenant FROM jobs")
def tenant_resolve(r: Relations):
    return r.jobs.select("job_id", routing.tenant(F.col("tenant_id"), F.col("batch_id"), F.col("job_id")).alias("tenant"))


@query("SELECT job_id, greatest(now, least(run_at, now + INTERVAL 30 DAY)) AS clamped FROM jobs, clock")
def run_at_clamp(r: Relations):
    return r.jobs.select("job_id", routing.clamp_run_at(F.col("run_at"), at(NOW)).alias("clamped"))


@query("""r AS (SELECT event_id, ts, log_now AS now FROM events, clock),
t AS (SELECT *, CASE WHEN event_id % 9 < 2 THEN date_trunc('second', ts) WHEN event_id % 9 IN (6, 7) THEN now + INTERVAL 9 DAY ELSE now END AS run_at FROM r)
SELECT event_id, greatest(now, least(run_at, now + INTERVAL 5 DAY)) AS run_at, greatest(now, least(now + to_seconds((event_id * 97) % 900000), now + INTERVAL 5 DAY)) AS after FROM t""")
def run_at_forms(r: Relations):
    """Texts of 13 and 19 digits are times far ahead; 20 digits are no 64-bit number."""
    now, k, ts = at(LOG_NOW), F.col("event_id") % 9, F.col("ts").cast("string")
    stamp = F.concat(F.substring(ts, 1, 10), F.lit("T"), F.substring(ts, 12, 8), F.lit("Z"))
    text = F.when(k == 0, stamp).when(k == 1, scalars.epoch(F.col("ts")).cast("string")).when(k == 2, "soon").when(k == 3, "").when(k == 5, F.substring(ts, 1, 10)).when(k == 6, "1700000000000").when(k == 7, "9223372036854775807").when(k == 8, "99999999999999999999")
    return r.events.select(
        "event_id", routing.clamp_run_at(routing.run_at_of(text, now), now, 5).alias("run_at"), routing.clamp_run_at(routing.run_at_after(F.col("event_id") * 97 % 900_000, now), now, 5).alias("after")
    )


@query("""SELECT job_id, batch_id, job_type, coalesce(nullif(worker_class, ''), 'go:' || job_type) AS worker_class, 0 AS attempt, (CASE WHEN coalesce(max_retries, 0) > 0 THEN max_retries ELSE 5 END)::INT AS max_retries,
coalesce(retry_tier, '') AS retry_tier, coalesce(strftime(try_strptime(valid_till, '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%dT%H:%M:%SZ'), '') AS valid_till FROM jobs LEFT JOIN manifest USING (job_type)""")
def job_envelope(r: Relations):
    return routing.envelope(r.jobs, r.manifest, client_retries=5)


@query("""m AS (SELECT job_id, CASE WHEN partition_id % 2 = 0 THEN job_type ELSE 'none' END AS job_type, 'class' || job_type[3:] AS worker_class FROM jobs)
SELECT job_id, coalesce(a.job_type, b.job_type) AS resolved FROM m LEFT JOIN manifest a ON a.job_type = m.job_type LEFT JOIN manifest b ON b.worker_class = m.worker_class""")
def job_type_lookup(r: Relations):
    m = r.jobs.select("job_id", F.when(F.col("partition_id") % 2 == 0, F.col("job_type")).otherwise("none").alias("job_type"), F.concat(F.lit("class"), F.substring("job_type", 3, 9)).alias("worker_class"))
    return routing.job_type_of(m, r.manifest).select("job_id", "resolved")


@query("SELECT topic, count(DISTINCT runtime) AS runtimes FROM manifest WHERE fairness_type = '' GROUP BY topic HAVING count(DISTINCT runtime) > 1")
def topic_conflicts(r: Relations):
    return routing.topic_conflicts(r.manifest)


@query("SELECT job_id, batch_id FROM jobs WHERE batch_id IS NULL OR batch_id NOT IN (SELECT batch_id FROM batches WHERE status = 'cancelled')")
def cancelled_anti(r: Relations):
    return r.jobs.join(cancelled(r), "batch_id", "left_anti").select("job_id", "batch_id")


@query("SELECT job_id, attempt FROM jobs WHERE job_id IN (SELECT job_id FROM jobs WHERE partition_id = 3 AND attempt = 2)")
def retry_cancel_semi(r: Relations):
    return r.jobs.join(skipped(r), "job_id", "left_semi").select("job_id", "attempt")


@query("""marks AS (SELECT topic, partition_id, max("offset") AS skip_until FROM log WHERE state = 'failed' AND value > 250 GROUP BY ALL)
SELECT l.topic, l.partition_id, l."offset", l.event_id FROM log l JOIN marks m USING (topic, partition_id) WHERE l."offset" <= m.skip_until""")
def skip_offsets(r: Relations):
    marks = r.log.where("state = 'failed' and value > 250").groupBy("topic", "partition_id").agg(F.max("offset").alias("skip_until"))
    return offsets.skipped(r.log, marks).select("topic", "partition_id", "offset", "event_id")


@query("""low AS (SELECT topic, partition_id, 5::BIGINT AS low FROM log GROUP BY ALL),
p AS (SELECT DISTINCT 'jobs' || (consumer_id % 3) AS topic, partition_id, (batch_seq * 40 + attempt - 41)::BIGINT AS "offset" FROM jobs),
rec AS (SELECT topic, partition_id, "offset", props AS payload FROM log WHERE "offset" >= 5)
SELECT p.topic, p.partition_id, p."offset", CASE WHEN payload IS NOT NULL THEN 'found' WHEN p."offset" < low THEN 'lost' ELSE 'miss' END AS result, payload FROM p LEFT JOIN low USING (topic, partition_id) LEFT JOIN rec USING (topic, partition_id, "offset")""")
def pointer_payload(r: Relations):
    """Records below offset 5 are gone, as after a log's retention: that is what makes pointers lost."""
    of = ("topic", "partition_id")
    return offsets.lookup(pointers(r), retained(r), lowest(r), of).select(*of, "offset", "result", "payload")


@query("""p AS (SELECT DISTINCT 'jobs' || (consumer_id % 3) AS topic, partition_id, (batch_seq * 40 + attempt - 41)::BIGINT AS "offset" FROM jobs),
rec AS (SELECT topic, partition_id, "offset", props AS payload FROM log WHERE "offset" >= 5), low AS (SELECT topic, partition_id, min("offset") AS low FROM rec GROUP BY ALL)
SELECT p.topic, p.partition_id, p."offset", CASE WHEN payload IS NOT NULL THEN 'found' WHEN p."offset" < low THEN 'lost' ELSE 'miss' END AS result, payload FROM p LEFT JOIN low USING (topic, partition_id) LEFT JOIN rec USING (topic, partition_id, "offset")""")
def pointer_zones(r: Relations):
    """The log written as files with a zone map, and pointers looked up in those of its files that may hold them."""
    path = scratch(r.spark, "log")
    log.append(r.log.where("offset >= 5").select("topic", F.col("partition_id").alias("partition"), "offset", F.lit(None).cast("string").alias("key"), F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("timestamp")), path, 2_000)
    found = log.lookup(pointers(r).withColumnRenamed("partition_id", "partition"), path)
    return found.select("topic", F.col("partition").alias("partition_id"), "offset", "result", "payload")


def pointers(r: Relations):
    topic = F.concat(F.lit("jobs"), F.col("consumer_id") % 3).alias("topic")
    return r.jobs.select(topic, "partition_id", (F.col("batch_seq") * 40 + F.col("attempt") - 41).alias("offset"), "attempt").drop("attempt").distinct()


def retained(r: Relations):
    return r.log.where("offset >= 5").select("topic", "partition_id", "offset", F.col("props").alias("payload"))


def lowest(r: Relations):
    return r.log.groupBy("topic", "partition_id").agg(F.lit(5).cast("bigint").alias("low"))


@query("""l AS (SELECT job_id, max(run_at) AS lease_until FROM jobs WHERE partition_id < 6 GROUP BY job_id)
SELECT j.job_id, CASE WHEN batch_counted THEN 'drop' WHEN lease_until > now THEN 'defer' ELSE 'rerun' END AS decision, CASE WHEN NOT batch_counted AND lease_until > now THEN lease_until + INTERVAL 5 SECOND END AS defer_until FROM jobs j CROSS JOIN clock LEFT JOIN l USING (job_id)""")
def fair_skip(r: Relations):
    leases = r.jobs.where("partition_id < 6").groupBy("job_id").agg(F.max("run_at").alias("lease_until"))
    return routing.fair_skip(r.jobs, leases, at(NOW)).select("job_id", "decision", "defer_until")


@query("""SELECT event_id, 't' || (event_id % 3) AS _src_topic, coalesce(CASE WHEN event_type = 'click' THEN 99 END, partition_id)::INT AS _src_partition, "offset" AS _src_offset, true AS _fair_slot,
'time' AS _fair_type, 'slot-' || event_id AS _fair_slot_id, CASE WHEN user_id % 2 = 0 THEN 'u' || user_id ELSE 'default' END AS tenant_id FROM log""")
def stamp_and_slot(r: Relations):
    m = r.log.select(
        "event_id", F.concat(F.lit("t"), F.col("event_id") % 3).alias("topic"), F.col("partition_id").alias("partition"), "offset", F.lit(None).cast("string").alias("_src_topic"),
        F.when(F.col("event_type") == "click", 99).alias("_src_partition"), F.lit(None).cast("bigint").alias("_src_offset"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), "user_id")).alias("tenant_id"),
    )
    out = routing.mark_slot(routing.stamped(m), F.lit("time"), F.concat(F.lit("slot-"), "event_id"))
    return out.select("event_id", "_src_topic", "_src_partition", "_src_offset", "_fair_slot", "_fair_type", "_fair_slot_id", "tenant_id")


@query("SELECT job_type, CASE WHEN starts_with(topic, 'topic1') THEN topic ELSE 'topic1' || topic END AS prefixed FROM manifest")
def topic_prefix(r: Relations):
    return r.manifest.select("job_type", routing.prefixed(F.col("topic"), "topic1").alias("prefixed"))


@query("""SELECT job_id || ':' || partition_id || ':' || batch_seq AS member, job_id, partition_id, batch_seq AS "offset" FROM (SELECT DISTINCT job_id || ':x' AS job_id, partition_id, batch_seq FROM jobs)""")
def member_codec(r: Relations):
    m = r.jobs.select(scalars.member(F.concat("job_id", F.lit(":x")), F.col("partition_id"), F.col("batch_seq")).alias("member")).distinct()
    return m.select("member", scalars.parse_member(F.col("member")).alias("p")).select("member", "p.job_id", "p.partition_id", "p.offset")


@query("SELECT DISTINCT attempt, least(60.0, 2.0 * pow(2, attempt)) AS delay, (CASE WHEN attempt < 1 THEN 30 WHEN attempt = 1 THEN 30 WHEN attempt = 2 THEN 420 ELSE 1200 END)::INT AS tier_delay FROM jobs")
def backoff(r: Relations):
    a = r.jobs.select("attempt").distinct()
    return a.select("attempt", routing.backoff(F.col("attempt"), 2, 60).alias("delay"), routing.retry_delay(routing.retry_tier(F.lit(None).cast("string"), F.col("attempt"))).alias("tier_delay"))


@query("""v AS (SELECT event_id, [' TRUE ', 'off', '17', ' 2.5 ', '', NULL, 'Yes', 'y', 't', '2.5e1', ' 17', '1.5d', '-.5'][event_id % 13 + 1] AS raw FROM events)
SELECT event_id, CASE WHEN coalesce(raw, '') = '' THEN true ELSE lower(trim(raw)) IN ('1', 'true', 'yes', 'on') END AS flag, CASE raw WHEN '17' THEN 17 ELSE 3 END::BIGINT AS n, CASE raw WHEN '17' THEN 17 WHEN '2.5e1' THEN 25 WHEN '-.5' THEN -0.5 ELSE 0.5 END::DOUBLE AS x FROM v""")
def coerce(r: Relations):
    raw = F.element_at(F.array(*map(F.lit, (" TRUE ", "off", "17", " 2.5 ", "", None, "Yes", "y", "t", "2.5e1", " 17", "1.5d", "-.5"))), (F.col("event_id") % 13 + 1).cast("int"))
    return r.events.select("event_id", raw.alias("raw")).select("event_id", scalars.truthy(F.col("raw"), True).alias("flag"), scalars.to_int(F.col("raw"), 3).alias("n"), scalars.to_float(F.col("raw"), 0.5).alias("x"))


@query("""SELECT event_id, 'job_' || event_type || CASE WHEN event_type = 'error' THEN ':1|c' ELSE ':' || round(value)::BIGINT || '|ms' END || '|#kind:' || event_type || CASE WHEN user_id % 2 = 0 THEN ',user:' || user_id ELSE '' END AS line FROM events""")
def statsd_lines(r: Relations):
    values = F.create_map(F.lit("user"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")), F.lit("kind"), F.col("event_type"), F.lit("payload"), F.col("props"))
    return r.events.select("event_id", scalars.statsd(F.concat(F.lit("job."), "event_type"), F.when(F.col("event_type") != "error", F.col("value")), values).alias("line"))


@query("""f AS (SELECT event_id, md5('c' || (event_id % 5) || chr(0) || '{"k":' || (props->>'k') || '}') AS fingerprint FROM events)
SELECT event_id, fingerprint, row_number() OVER (PARTITION BY fingerprint ORDER BY event_id) = 1 AS claimed FROM f""")
def uniq_first_wins(r: Relations):
    f = r.events.select("event_id", scalars.fingerprint(F.concat(F.lit("c"), F.col("event_id") % 5), F.col("props")).alias("fingerprint"))
    return schedule.first_wins(f, ["fingerprint"], ["event_id"])


#: XXH64 under seed 0 of texts of less than 32 ASCII letters, by lanes of eight bytes, one of four, and single bytes.
XXH64 = """l AS (SELECT *, list_transform(range(0, n // 8), lambda i: list_reduce(list_transform(range(8), lambda j: c[8 * i + j + 1] << (j * 8)::UHUGEINT), lambda a, x: a + x)) AS eights, n // 8 * 8 AS done FROM b),
h AS (SELECT *, list_reduce(list_prepend((P5 + n::UHUGEINT) & W, eights), lambda h, x: (TURN27(xor(h, (TURN31((x * P2) & W) * P1) & W)) * P1 + P4) & W) AS h8 FROM l),
i AS (SELECT *, CASE WHEN n % 8 >= 4 THEN (TURN23(xor(h8, ((c[done + 1] + (c[done + 2] << 8) + (c[done + 3] << 16) + (c[done + 4] << 24)) * P1) & W)) * P2 + P3) & W ELSE h8 END AS h4, n - n % 4 AS ends FROM h),
j AS (SELECT *, list_reduce(list_prepend(h4, c[ends + 1:]), lambda h, x: (TURN11(xor(h, (x * P5) & W)) * P1) & W) AS h1 FROM i),
k AS (SELECT *, (xor(h1, h1 >> 33) * P2) & W AS m1 FROM j), o AS (SELECT *, (xor(m1, m1 >> 29) * P3) & W AS m2 FROM k), x AS (SELECT *, xor(m2, m2 >> 32) AS hash FROM o)"""
for turn in (11, 23, 27, 31):  # TURN11(y) and the others as macros
    while (start := XXH64.find(f"TURN{turn}(")) >= 0:
        stop, depth = start + len(f"TURN{turn}("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(XXH64[stop], 0)
            stop += 1
        inner = XXH64[start + len(f"TURN{turn}(") : stop - 1]
        XXH64 = f"{XXH64[:start]}(((({inner}) << {turn}) & W) | (({inner}) >> {64 - turn})){XXH64[stop:]}"
for name, value in (("P1", 11400714785074694791), ("P2", 14029467366897019727), ("P3", 1609587929392839161), ("P4", 9650029242287828579), ("P5", 2870177450012600261), ("W", 2**64 - 1)):
    XXH64 = re.sub(rf"\b{name}\b", f"{value}::UHUGEINT", XXH64)
XXH64 = re.sub(r"(<<|>>) (\d+)", r"\1 \2::UHUGEINT", XXH64)


@query(f"""m AS (SELECT event_id, part, 'c' || (event_id % 5) || chr(0) || '{{"k":' || (props->>'k') || '}}' || salt AS s FROM events, (VALUES (0, ''), (1, chr(0) || 'uniq_salt_v1')) v(part, salt)),
b AS (SELECT event_id, part, len(s) AS n, list_transform(range(1, len(s) + 1), lambda i: ord(s[i])::UHUGEINT) AS c FROM m), {XXH64}
SELECT event_id, string_agg(array_to_string(list_transform(range(8), lambda i: lpad(lower(hex(((hash >> (i * 8)::UHUGEINT) & 255::UHUGEINT)::BIGINT)), 2, '0')), ''), '' ORDER BY part) AS fingerprint FROM x GROUP BY event_id""")
def parity_fingerprints(r: Relations):
    return r.events.select("event_id", scalars.parity_fingerprint(F.concat(F.lit("c"), F.col("event_id") % 5), F.col("props")).alias("fingerprint"))


MASK, MUL = "4294967295::UBIGINT", "1540483477::UBIGINT"


@query(f"""b AS (SELECT event_id, user_id, len(k) AS n, list_transform(range(1, len(k) + 1), lambda i: ord(k[i])::UBIGINT) AS c FROM (SELECT event_id, user_id, 'k' || event_id AS k FROM events)),
w AS (SELECT *, list_transform(range(0, n // 4), lambda i: ((c[4 * i + 1] + c[4 * i + 2] * 256 + c[4 * i + 3] * 65536 + c[4 * i + 4] * 16777216) * {MUL}) & {MASK}) AS ks FROM b),
h AS (SELECT *, list_reduce(list_prepend(xor(2538058380::UBIGINT, n::UBIGINT), list_transform(ks, lambda x: (xor(x, x >> 24) * {MUL}) & {MASK})), lambda a, x: xor((a * {MUL}) & {MASK}, x)) AS h0 FROM w),
t AS (SELECT *, CASE n % 4 WHEN 0 THEN h0 WHEN 1 THEN (xor(h0, c[n]) * {MUL}) & {MASK} WHEN 2 THEN (xor(h0, c[n - 1] + c[n] * 256) * {MUL}) & {MASK} ELSE (xor(h0, c[n - 2] + c[n - 1] * 256 + c[n] * 65536) * {MUL}) & {MASK} END AS h1 FROM h),
f AS (SELECT *, (xor(h1, h1 >> 13) * {MUL}) & {MASK} AS h2 FROM t)
SELECT event_id, (CASE WHEN user_id % 20 < 16 THEN user_id % 20 ELSE (xor(h2, h2 >> 15) & 2147483647::UBIGINT) % 16 END)::INT AS partition_id FROM f""")
def partitioner(r: Relations):
    want = F.col("user_id") % 20
    return r.events.select("event_id", offsets.partition_of(F.concat(F.lit("k"), "event_id"), want, 16).alias("partition_id"))


@query("""u AS (SELECT event_id, ['mysql2://u' || event_id || ':p@db/sched', 'mysql://db.internal:3307/kb?parseTime=true&loc=UTC', '  u:p@tcp(h:1)/x  ', 'MYSQL2://u@[::1]/kb?a=1&a=2', 'mysql:///none', ''][event_id % 6 + 1] AS url FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'u' || event_id || ':p@tcp(db:3306)/sched' WHEN 1 THEN 'tcp(db.internal:3307)/kb?loc=UTC&parseTime=true' WHEN 2 THEN 'u:p@tcp(h:1)/x' WHEN 3 THEN 'u@tcp([::1]:3306)/kb?a=1' WHEN 4 THEN NULL ELSE '' END AS dsn FROM u""")
def dsn_forms(r: Relations):
    k = F.col("event_id") % 6
    url = (
        F.when(k == 0, F.concat(F.lit("mysql2://u"), "event_id", F.lit(":p@db/sched"))).when(k == 1, "mysql://db.internal:3307/kb?parseTime=true&loc=UTC").when(k == 2, "  u:p@tcp(h:1)/x  ")
        .when(k == 3, "MYSQL2://u@[::1]/kb?a=1&a=2").when(k == 4, "mysql:///none").otherwise("")
    )
    return r.events.select("event_id", scalars.dsn(url).alias("dsn"))


@query("""SELECT event_id, list_filter(list_transform(regexp_split_to_array(' a' || event_id || ' ,b' || chr(10) || chr(13) || ',, c ', '[,' || chr(10) || chr(13) || ']'), lambda x: trim(x)), lambda x: x != '') AS urls FROM events""")
def url_lists(r: Relations):
    return r.events.select("event_id", scalars.split_urls(F.concat(F.lit(" a"), "event_id", F.lit(" ,b\n\r,, c "))).alias("urls"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN props->>'k' WHEN 1 THEN 'x' END AS k, event_id % 4 < 2 AS known FROM events""")
def decoded_maps(r: Relations):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("props")).when(k == 1, '{"k":"x","n":1}').when(k == 2, "{broken").otherwise("")
    m = r.events.select("event_id", scalars.decoded_map(text).alias("m"))
    return m.select("event_id", F.col("m")["k"].alias("k"), F.col("m").isNotNull().alias("known"))


@query("""p AS (SELECT event_id, md5('sched' || chr(31) || event_id) AS h FROM events) SELECT event_id, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id FROM p""")
def derived_ids(r: Relations):
    return r.events.select("event_id", scalars.derived_id(F.lit("sched"), F.col("event_id")).alias("id"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'gzip' ELSE '' END AS encoding, CASE WHEN event_id % 3 = 0 THEN repeat(props, 60) ELSE props END AS payload FROM events""")
def payload_round_trip(r: Relations):
    body = F.when(F.col("event_id") % 3 == 0, F.repeat("props", F.lit(60))).otherwise(F.col("props"))
    packed = r.events.select("event_id", scalars.packed_payload(body).alias("p"))
    return packed.select("event_id", "p.encoding", scalars.raw_payload(F.col("p.payload"), F.col("p.encoding")).cast("string").alias("payload"))


@query("""m2 AS (SELECT * REPLACE (CASE WHEN job_type IN ('jt3', 'jt8') THEN ' ' ELSE runtime END AS runtime) FROM manifest)
SELECT 'no_runtime' AS problem, job_type AS name FROM m2 WHERE trim(runtime) = '' UNION ALL SELECT 'several_runtimes', topic FROM m2 WHERE fairness_type = '' GROUP BY topic HAVING count(DISTINCT runtime) > 1""")
def manifest_problems(r: Relations):
    return routing.manifest_problems(r.manifest.withColumn("runtime", F.when(F.col("job_type").isin("jt3", "jt8"), " ").otherwise(F.col("runtime"))))


@query("""want AS (SELECT DISTINCT topic FROM manifest UNION SELECT 'scheduled' UNION SELECT 'fair-time-ingest')
SELECT topic, CASE WHEN starts_with(topic, 'fair-') THEN 64 ELSE 16 END::INT AS partitions, (CASE WHEN topic = 'scheduled' THEN 31 ELSE 7 END * 86400000::BIGINT)::BIGINT AS retention_ms FROM want WHERE topic NOT IN ('topic1', 'topic4')""")
def missing_topics(r: Relations):
    own = r.part.where("p_partkey < 2").select(F.when(F.col("p_partkey") == 0, "scheduled").otherwise("fair-time-ingest").alias("topic"))
    return config.missing_topics(config.topic_specs(r.manifest.select("topic").distinct().unionByName(own)), r.manifest.where("topic in ('topic1', 'topic4')").select("topic").distinct())


@query("SELECT DISTINCT topic FROM manifest WHERE runtime = 'go' INTERSECT SELECT DISTINCT topic FROM manifest WHERE fairness_type != ''")
def overlap_topics(r: Relations):
    return r.manifest.where("runtime = 'go'").select("topic").intersect(r.manifest.where("fairness_type != ''").select("topic"))


@query("SELECT topic, array_to_string(list(job_type ORDER BY job_type), ',') AS job_types FROM manifest WHERE topic IN (SELECT topic FROM manifest WHERE runtime = 'go') GROUP BY topic")
def cohort_topics(r: Relations):
    own = r.manifest.where("runtime = 'go'").select("topic").distinct()
    return r.manifest.join(own, "topic", "left_semi").groupBy("topic").agg(F.array_join(F.sort_array(F.collect_list("job_type")), ",").alias("job_types"))

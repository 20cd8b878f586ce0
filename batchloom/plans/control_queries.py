"""Queries of producing, parking, polling, guards and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control, routing, schedule
from ..sources.bridge import LOG_NOW, NOW, Relations, at
from .jobs_queries import lowest, retained
from .registry import query


@query("""n AS (SELECT l_orderkey * 2 AS batch_id, l_shipdate AS created_at, l_partkey * 1000000 + l_suppkey * 1000 AS request_id, l_linenumber FROM lineitem WHERE l_linenumber = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY created_at, request_id) AS k FROM n)
SELECT batch_id, count(*) AS requests, count(*) FILTER (k = 1 AND batch_id NOT IN (SELECT batch_id FROM batches)) AS created FROM f GROUP BY batch_id""")
def create_batches(r: Relations):
    rid = F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 1000
    # the first line of an order stands for a request to create its batch
    new = r.lineitem.where("l_linenumber = 1").select((F.col("l_orderkey") * 2).alias("batch_id"), F.col("l_shipdate").alias("created_at"), rid.alias("request_id"))
    return control.create_batches(r.batches, new).groupBy("batch_id").agg(F.count("*").alias("requests"), F.count_if("created").alias("created"))


@query("""q AS (SELECT batch_id, op, ord AS request_id, CASE op WHEN 'success' THEN 5 WHEN 'failed' THEN -1 ELSE 2 END::BIGINT AS n FROM completions),
j AS (SELECT q.*, CASE WHEN b.batch_id IS NULL THEN 'not_found' WHEN status = 'cancelled' THEN 'cancelled' WHEN sealed THEN 'closed' ELSE 'ok' END AS result FROM q LEFT JOIN (SELECT * FROM batches WHERE batch_id % 10 != 3) b USING (batch_id)),
s AS (SELECT *, sum(CASE WHEN result = 'ok' THEN greatest(n, 0) ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY request_id)::BIGINT AS last FROM j)
SELECT batch_id, request_id::INT AS request_id, n, result, CASE WHEN result = 'ok' AND n > 0 THEN last - n + 1 END AS first_seq, CASE WHEN result = 'ok' AND n > 0 THEN last END AS last_seq FROM s""")
def add_jobs(r: Relations):
    from pyspark.sql import Window

    n = F.when(F.col("op") == "success", 5).when(F.col("op") == "failed", -1).otherwise(2).cast("bigint")
    q = r.completions.select("batch_id", F.row_number().over(Window.partitionBy("batch_id").orderBy("arrival")).alias("request_id"), n.alias("n"))
    return control.add_jobs(q, r.batches.where("batch_id % 10 != 3"))


@query("""j AS (SELECT batch_id, job_id, job_type, attempt, run_at, duration, row_number() OVER (PARTITION BY batch_id, attempt ORDER BY run_at, job_id, duration) = 1 AS claimed FROM jobs WHERE batch_id IS NOT NULL),
s AS (SELECT *, row_number() OVER (PARTITION BY batch_id, claimed ORDER BY run_at, job_id, duration) AS n FROM j)
SELECT batch_id, CASE WHEN claimed THEN job_id ELSE '' END AS pushed_id, claimed, CASE WHEN claimed THEN n END AS seq, CASE WHEN claimed THEN floor((n - 1) / 3)::BIGINT END AS chunk, m.job_type IS NOT NULL AS known, m.topic FROM s LEFT JOIN manifest m USING (job_type)""")
def push_many(r: Relations):
    jobs = r.jobs.where("batch_id is not null").select("batch_id", "job_id", "job_type", "attempt", "run_at", "duration")
    out = control.push_many(jobs, r.manifest, F.col("attempt").cast("string"), ["run_at", "job_id", "duration"], 3)
    return out.select("batch_id", "pushed_id", "claimed", "seq", "chunk", "known", "topic")


@query("""c AS (SELECT job_id, greatest(now, least(run_at, now + INTERVAL 30 DAY)) AS run_at, now FROM jobs, clock)
SELECT job_id, run_at, CASE WHEN run_at <= now THEN 'now' ELSE 'indexed' END AS place FROM c""")
def schedule_jobs(r: Relations):
    due, later = control.schedule_jobs(r.jobs.select("job_id", "run_at"), at(NOW))
    return due.withColumn("place", F.lit("now")).unionByName(later.drop("lease_until").withColumn("place", F.lit("indexed")))


@query("SELECT batch_id, CASE WHEN batch_id % 5 = 2 AND status = 'running' THEN 'cancelled' ELSE status END AS status FROM batches")
def cancel_batches(r: Relations):
    return control.cancel(r.batches, r.batches.where("batch_id % 5 = 2")).select("batch_id", "status")


@query("""q AS (SELECT user_id AS batch_id, CASE WHEN event_id % 2 = 0 THEN 'complete' ELSE 'success' END AS kind, event_id AS request_id FROM events)
SELECT *, row_number() OVER (PARTITION BY batch_id, kind ORDER BY request_id) = 1 AND NOT (batch_id % 6 = 1 AND kind = 'success') AS won FROM q""")
def claim_callbacks(r: Relations):
    q = r.events.select(F.col("user_id").alias("batch_id"), F.when(F.col("event_id") % 2 == 0, "complete").otherwise("success").alias("kind"), F.col("event_id").alias("request_id"))
    return control.claim_callbacks(q, q.where("batch_id % 6 = 1 and kind = 'success'").select("batch_id", "kind"))


@query("""SELECT event_id, props AS dlt_raw_payload, 'unproducible' AS dlt_type, 'jobs' AS dlt_source_topic, 'ProduceError' AS dlt_error_class, 'code ' || user_id AS dlt_error_message, log_now AS dlt_at FROM events, clock WHERE event_type = 'error' AND value > 100""")
def parked_events(r: Relations):
    bad = r.events.where("event_type = 'error' and value > 100").select("event_id", "user_id", F.col("props").alias("dlt_raw_payload"))
    return control.parked(bad, F.concat(F.lit("code "), "user_id"), F.lit("jobs"), at(LOG_NOW)).drop("user_id")


@query("""p AS (SELECT DISTINCT 'jobs' || (consumer_id % 3) AS topic, partition_id, (batch_seq * 40 + attempt - 41)::BIGINT AS "offset", ((consumer_id + partition_id) % 12)::INT AS misses FROM jobs),
rec AS (SELECT topic, partition_id, "offset" FROM log WHERE "offset" >= 5), low AS (SELECT DISTINCT topic, partition_id FROM log)
SELECT p.topic, p.partition_id, p."offset", misses, CASE WHEN rec."offset" IS NOT NULL THEN 'dispatch' WHEN low.partition_id IS NOT NULL AND p."offset" < 5 THEN 'drop_lost' WHEN misses + 1 >= 10 THEN 'drop_missing' ELSE 'retry_later' END AS action
FROM p LEFT JOIN rec USING (topic, partition_id, "offset") LEFT JOIN low ON low.topic = p.topic AND low.partition_id = p.partition_id""")
def poll_tick(r: Relations):
    """Records below offset 5 are gone, as after a log's retention: that is what makes pointers lost."""
    topic, misses = F.concat(F.lit("jobs"), F.col("consumer_id") % 3).alias("topic"), ((F.col("consumer_id") + F.col("partition_id")) % 12).cast("int").alias("misses")
    due = r.jobs.select(topic, "partition_id", (F.col("batch_seq") * 40 + F.col("attempt") - 41).alias("offset"), misses).distinct()
    of = ("topic", "partition_id")
    return control.poll(due, retained(r), lowest(r), of=of).select(*of, "offset", "misses", "action")


@query("""o AS (SELECT DISTINCT job_id, CASE WHEN partition_id = 9 THEN NULL ELSE 'topic' || partition_id END AS topic FROM jobs WHERE attempt = 3)
SELECT job_id, topic, CASE WHEN topic IS NULL THEN 'dead_letter' ELSE 'reproduce' END AS action, true AS _reclaim FROM o WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE attempt = 3 AND malformed)""")
def reclaim_jobs(r: Relations):
    # jobs of one attempt stand for the orphans, malformed ones for those produced before
    o = r.jobs.where("attempt = 3").select("job_id", F.when(F.col("partition_id") != 9, F.concat(F.lit("topic"), "partition_id")).alias("topic")).distinct()
    return control.reclaim(o, r.jobs.where("attempt = 3 and malformed"))


@query("""l AS (SELECT fairness_type FROM manifest WHERE fairness_type != '' GROUP BY 1 HAVING count(DISTINCT runtime) > 1)
SELECT DISTINCT fairness_type, runtime, 'fair-' || fairness_type || '-ready-' || runtime AS ready_topic FROM manifest JOIN l USING (fairness_type)""")
def fair_ready_split(r: Relations):
    return control.fair_ready_split(r.manifest)


@query("""t AS (SELECT DISTINCT topic FROM manifest UNION ALL SELECT 'events' UNION ALL SELECT 'retry') SELECT topic, topic NOT IN ('events', 'callbacks', 'retry', 'scheduled', 'dlt') AS executable FROM t""")
def executable_topics(r: Relations):
    """The topics of handlers, and those that events of two kinds would name."""
    named = r.events.where("event_type in ('error', 'signup')").select(F.when(F.col("event_type") == "error", "retry").otherwise("events").alias("topic")).distinct()
    return control.executable(r.manifest.select("topic").distinct().unionByName(named))


@query("""g AS (SELECT worker_class AS "group", topic, job_type FROM manifest), x AS (SELECT "group", topic AS t, 0 AS rank FROM g UNION ALL SELECT "group", 'topic' || (job_type[3:]::INT % 3), 1 FROM g)
SELECT t AS topic, min((rank, "group"))[2] AS "group", min((rank, "group"))[1]::INT AS rank FROM x GROUP BY t""")
def all_topics(r: Relations):
    groups = r.manifest.select(F.col("worker_class").alias("group"), F.array("topic", F.concat(F.lit("topic"), (F.substring("job_type", 3, 9).cast("int") % 3).cast("string"))).alias("topics"))
    return control.all_topics(groups)


@query("""g AS (SELECT 'g' || (user_id % 4) AS "group", topic, partition_id FROM log),
stops AS (SELECT DISTINCT 'g' || (user_id % 3) AS "group", topic, CASE WHEN user_id % 2 = 0 THEN -1 ELSE partition_id END AS p FROM log WHERE event_type = 'error' AND value > 140)
SELECT "group", topic, partition_id, count(*) AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s."group" = g."group" AND s.topic = g.topic AND s.p IN (-1, g.partition_id)) GROUP BY ALL""")
def consumed(r: Relations):
    """The first store cannot be reached, so the second one's pauses hold; a pause stops its own group alone."""
    group = lambda n: F.concat(F.lit("g"), F.col("user_id") % n)
    log = r.log.withColumn("group", group(4))
    stops = r.log.where("event_type = 'error' and value > 140").select(group(3).alias("group"), "topic", F.when(F.col("user_id") % 2 == 0, -1).otherwise(F.col("partition_id")).alias("partition_id"))
    paused = control.pauses(r.spark, [lambda: r.spark.read.parquet(f"{r.sf_dir}/no-such-store.parquet"), lambda: stops])
    return control.consumed(log, paused, F.col("group")).groupBy("group", "topic", "partition_id").agg(F.count("*").alias("n"))


@query("""g AS (SELECT DISTINCT 'g' || (user_id % 4) AS "group", topic FROM log), stops AS (SELECT DISTINCT 'g' || (user_id % 3) AS "group", topic FROM log WHERE event_type = 'error' AND value > 140 AND user_id % 2 = 0)
SELECT * FROM g EXCEPT SELECT * FROM stops""")
def active_higher(r: Relations):
    group = lambda n: F.concat(F.lit("g"), F.col("user_id") % n).alias("group")
    stops = r.log.where("event_type = 'error' and value > 140").select(group(3), "topic", F.when(F.col("user_id") % 2 == 0, -1).otherwise(F.col("partition_id")).alias("partition_id"))
    return control.active_higher(r.log.select(group(4), "topic").distinct(), stops)


@query("""f AS (SELECT DISTINCT 'u' || user_id AS fingerprint, 'slow' AS rule_id, 'warning' AS severity FROM events WHERE value > 120)
SELECT fingerprint, rule_id, severity, '[WARNING] slow ' || fingerprint AS message FROM f WHERE fingerprint NOT IN (SELECT 'u' || user_id FROM events, clock WHERE event_type = 'signup' AND value > 80 AND ts > log_now - INTERVAL 900 SECOND)""")
def notices(r: Relations):
    f = r.events.where("value > 120").select(F.concat(F.lit("u"), "user_id").alias("fingerprint"), F.lit("slow").alias("rule_id"), F.lit("warning").alias("severity"))
    sent = r.events.where("event_type = 'signup' and value > 80").select(F.concat(F.lit("u"), "user_id").alias("fingerprint"), F.col("ts").alias("sent_at"))
    return control.notices(f, sent, 300, at(LOG_NOW))


@query("""c AS (SELECT worker_class, runtime, CASE max_retries WHEN 0 THEN 'success' WHEN 1 THEN 'success_only' ELSE 'complete' END AS outcome, CASE WHEN runtime = 'go' THEN worker_class ELSE '' END AS s FROM manifest)
SELECT worker_class, 'app-' || worker_class || '-events' AS "group", CASE WHEN outcome != 'complete' AND s != '' THEN 'on_success' ELSE 'on_complete' END AS method,
CASE WHEN outcome != 'complete' AND s != '' THEN s ELSE 'Done' END AS class_name, CASE WHEN outcome = 'complete' THEN 'complete' ELSE 'success' END AS claim_kind FROM c""")
def names(r: Relations):
    k = F.col("max_retries")
    rows = r.manifest.select("worker_class", F.when(k == 0, "success").when(k == 1, "success_only").otherwise("complete").alias("outcome"), F.when(F.col("runtime") == "go", F.col("worker_class")).otherwise("").alias("on_success"), F.lit("Done").alias("on_complete"))
    return routing.callback_target(rows).select("worker_class", control.group_name("app-", F.col("worker_class"), "events").alias("group"), "method", "class_name", "claim_kind")


@query("SELECT topic, array_to_string(list(job_type ORDER BY job_type), ' ') AS listing FROM manifest GROUP BY topic ORDER BY topic")
def listing(r: Relations):
    return r.manifest.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("job_type")), " ").alias("listing")).orderBy("topic")


@query("SELECT event_id, event_type FROM events WHERE md5(event_id::VARCHAR)[1:8] < '40000000'")
def sampled_events(r: Relations):
    return control.sampled(r.events.select("event_id", "event_type"), 0.25, F.col("event_id"))


@query("""s AS (SELECT job_id, max(run_at) AS seen FROM jobs GROUP BY job_id) SELECT job_id, (now - seen) > INTERVAL 180 SECOND AS gone FROM s, clock""")
def heartbeat_age(r: Relations):
    seen = r.jobs.groupBy("job_id").agg(F.max("run_at").alias("seen"))
    return seen.select("job_id", (F.col("seen") < at(NOW) - schedule.seconds(180)).alias("gone"))


NOTICE = "event_type AS event, CASE WHEN value > 150 THEN 'critical' ELSE 'warning' END AS severity, 'value of \"' || user_id || '\"' AS title, repeat('é' || event_id || ' ', 600) AS summary, 'slow' AS rule_id, 'u' || user_id AS fingerprint"


@query(f"""n AS (SELECT event_id, {NOTICE} FROM events WHERE event_type = 'error')
SELECT event_id, json_object('text', '[' || severity || '] ' || title, 'blocks', json_array(json_object('type', 'header', 'text', json_object('type', 'plain_text', 'text', upper((event || ': ' || title)[1:150]))),
  json_object('type', 'section', 'text', json_object('type', 'mrkdwn', 'text', summary[1:2900])), json_object('type', 'context', 'elements', json_array(json_object('type', 'mrkdwn', 'text', 'rule=`' || rule_id || '` · `' || fingerprint || '`')))))::VARCHAR AS chat,
concat_ws(chr(13) || chr(10), 'To: a@b', 'From: c@d', 'Subject: [' || severity || '] ' || event || ': ' || title, 'MIME-Version: 1.0', 'Content-Type: text/plain; charset=UTF-8', '', summary, '', 'rule=' || rule_id || ' fingerprint=' || fingerprint, '') AS mail FROM n""")
def notice_bodies(r: Relations):
    e = r.events.where("event_type = 'error'").select(
        "event_id", F.col("event_type").alias("event"), F.when(F.col("value") > 150, "critical").otherwise("warning").alias("severity"), F.concat(F.lit('value of "'), "user_id", F.lit('"')).alias("title"),
        F.repeat(F.concat(F.lit("é"), "event_id", F.lit(" ")), F.lit(600)).alias("summary"), F.lit("slow").alias("rule_id"), F.concat(F.lit("u"), "user_id").alias("fingerprint"),
    )
    notice = {c: F.col(c) for c in e.columns[1:]}
    return e.select("event_id", control.chat_body(notice).alias("chat"), control.mail_text(notice, "a@b", "c@d").alias("mail"))

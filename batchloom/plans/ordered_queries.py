"""Ordered computations, scheduling, fairness and priority queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cron
from ..operators import fairness, offsets, schedule
from ..session import scratch
from ..sources.bridge import LOG_NOW, NOW, Relations, at
from ..sources.versioned import VersionedTable
from .registry import query




@query("""SELECT topic, partition_id, min("offset") AS first_offset, min("offset") FILTER (state != 'done') AS blocked_at, coalesce(min("offset") FILTER (state != 'done'), max("offset") + 1) AS next_commit FROM log GROUP BY topic, partition_id""")
def commit_prefix(r: Relations):
    return offsets.commit_prefix(r.log)


@query("""SELECT topic, partition_id, min("offset") AS rewind_to FROM log WHERE state = 'pending' GROUP BY ALL""")
def rewind_offsets(r: Relations):
    return offsets.rewind(r.log)


@query("""SELECT event_id, topic, partition_id, floor((row_number() OVER (PARTITION BY topic, partition_id ORDER BY "offset") - 1) / 50)::BIGINT AS chunk FROM log""")
def produce_chunks(r: Relations):
    return offsets.chunks(r.log.select("event_id", "topic", "partition_id", "offset"), ["offset"], ["topic", "partition_id"], 50).drop("offset")


QUEUE = """w AS (SELECT c_mktsegment AS lane, o_custkey AS tenant_id, o_orderkey AS pos, floor(o_totalprice)::BIGINT % 60 + 1 AS duration, CASE WHEN o_custkey % 7 = 0 THEN 1.0 WHEN o_custkey % 4 = 0 THEN 4.0 WHEN o_custkey % 4 = 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM orders JOIN customer ON c_custkey = o_custkey)"""


def weights(r: Relations):
    w = F.when(F.col("c_custkey") % 7 == 0, -1.0).when(F.col("c_custkey") % 4 == 0, 4.0).when(F.col("c_custkey") % 4 == 1, 2.0).when(F.col("c_custkey") % 4 == 2, 1.0)
    return r.customer.select(F.col("c_custkey").alias("tenant_id"), w.alias("weight")).where("weight is not null")


def queue(r: Relations):
    lanes = r.customer.select(F.col("c_custkey").alias("tenant_id"), F.col("c_mktsegment").alias("lane"))
    rows = r.orders.select(F.col("o_custkey").alias("tenant_id"), F.col("o_orderkey").alias("pos"), (F.floor("o_totalprice") % 60 + 1).alias("duration"))
    return fairness.weighted(rows.join(lanes, "tenant_id"), weights(r))


@query("w AS (SELECT c_custkey AS tenant_id, CASE WHEN c_custkey % 7 = 0 THEN 1.0 WHEN c_custkey % 4 = 0 THEN 4.0 WHEN c_custkey % 4 = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM customer) SELECT * FROM w")
def tenant_weight(r: Relations):
    return fairness.weighted(r.customer.select(F.col("c_custkey").alias("tenant_id")), weights(r))


@query(QUEUE + """, v AS (SELECT *, (row_number() OVER (PARTITION BY lane, tenant_id ORDER BY pos) - 1) / weight AS vtime FROM w),
t AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY vtime, tenant_id, pos) AS turn FROM v) SELECT lane, tenant_id, pos, vtime::DOUBLE AS vtime, turn::INT AS turn FROM t WHERE turn <= 200""")
def wfq_throughput(r: Relations):
    return fairness.checkout(fairness.throughput_order(queue(r)), 200).select("lane", "tenant_id", "pos", "vtime", "turn")


@query(QUEUE + """, v AS (SELECT *, coalesce(sum(duration / weight) OVER (PARTITION BY lane, tenant_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS vtime FROM w),
t AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY vtime, tenant_id, pos) AS turn FROM v) SELECT lane, tenant_id, pos, vtime::DOUBLE AS vtime, turn::INT AS turn FROM t WHERE turn <= 200""")
def wfq_time(r: Relations):
    return fairness.checkout(fairness.time_order(queue(r)), 200).select("lane", "tenant_id", "pos", "vtime", "turn")


@query(QUEUE + " SELECT lane, tenant_id, pos, row_number() OVER (PARTITION BY lane, tenant_id ORDER BY pos) <= 8 AS accepted FROM w")
def enqueue_cap(r: Relations):
    return fairness.queue_cap(queue(r), 8).select("lane", "tenant_id", "pos", "accepted")


@query(QUEUE + """, t AS (SELECT DISTINCT lane, tenant_id, weight FROM w), s AS (SELECT lane, sum(weight) AS sw, count(*) AS n FROM t GROUP BY lane)
SELECT t.lane, tenant_id, least(greatest(floor(3 * n * weight / sw), 1), 4)::BIGINT AS weighted_cap, least(greatest(ceil(3.0 * n / n), 1), 4)::BIGINT AS even_cap FROM t JOIN s USING (lane)""")
def inflight_cap(r: Relations):
    """A lane's budget is three slots per active tenant."""
    return fairness.inflight_caps(queue(r).select("lane", "tenant_id", "weight").distinct(), 3 * F.col("active"), 4).select("lane", "tenant_id", "weighted_cap", "even_cap")


@query(QUEUE + """, t AS (SELECT lane, tenant_id, (count(*) / any_value(weight))::DOUBLE AS vtime FROM w GROUP BY lane, tenant_id)
SELECT lane, tenant_id, vtime, row_number() OVER (PARTITION BY lane ORDER BY vtime, tenant_id)::INT AS place FROM t QUALIFY row_number() OVER (PARTITION BY lane ORDER BY vtime, tenant_id) <= 60""")
def checkout_candidates(r: Relations):
    ring = queue(r).groupBy("lane", "tenant_id").agg((F.count("*") / F.first("weight")).alias("vtime"))
    return fairness.candidates(ring, 10)


@query("""tn AS (SELECT s_suppkey AS tenant_id FROM supplier), fx AS (SELECT s_suppkey AS tenant_id, (s_suppkey % 70)::INT AS partition_id FROM supplier WHERE s_suppkey IN (4, 10, 66)),
held AS (SELECT * FROM fx WHERE partition_id < 40), free AS (SELECT p::INT AS partition_id, row_number() OVER (ORDER BY p) AS rk FROM range(40) x(p) WHERE p NOT IN (SELECT partition_id FROM held)),
wt AS (SELECT tenant_id, row_number() OVER (ORDER BY tenant_id) AS rk FROM tn WHERE tenant_id NOT IN (SELECT tenant_id FROM held))
SELECT tn.tenant_id, coalesce(held.partition_id, free.partition_id) AS partition_id FROM tn LEFT JOIN held USING (tenant_id) LEFT JOIN wt ON wt.tenant_id = tn.tenant_id LEFT JOIN free ON free.rk = wt.rk""")
def partition_assign(r: Relations):
    fixed = r.supplier.where("s_suppkey in (4, 10, 66)").select(F.col("s_suppkey").alias("tenant_id"), (F.col("s_suppkey") % 70).cast("int").alias("partition_id"))
    return fairness.assign_partitions(r.supplier.select(F.col("s_suppkey").alias("tenant_id")), fixed, 40)


@query("""f AS (SELECT event_id AS slot_id FROM events WHERE event_type = 'purchase'), l AS (SELECT event_id AS slot_id, value AS expiry FROM events WHERE event_id % 3 != 0)
SELECT f.slot_id, expiry FROM f LEFT JOIN l USING (slot_id) WHERE expiry IS NULL OR expiry + 5 <= 40""")
def stale_forwards(r: Relations):
    forwards = r.events.where("event_type = 'purchase'").select(F.col("event_id").alias("slot_id"))
    return fairness.stale_forwards(forwards, r.events.where("event_id % 3 != 0").select(F.col("event_id").alias("slot_id"), F.col("value").alias("expiry")), 40.0)


@query(QUEUE + """, ring AS (SELECT lane, tenant_id FROM w WHERE pos % 3 = 0), lease AS (SELECT lane, tenant_id FROM w WHERE pos % 5 = 0), u AS (SELECT * FROM ring UNION SELECT * FROM lease),
ww AS (SELECT DISTINCT tenant_id, weight FROM w) SELECT lane, count(*) AS tenants, sum(weight)::DOUBLE AS weight FROM u JOIN ww USING (tenant_id) GROUP BY lane""")
def active_view(r: Relations):
    q = queue(r)
    return fairness.active_view(q.where("pos % 3 = 0"), q.where("pos % 5 = 0"), weights(r))


@query(QUEUE + """ SELECT lane, count(DISTINCT tenant_id) FILTER (pos % 3 = 0) AS tenants, count(*) FILTER (pos % 5 = 0) AS leases, count(*) FILTER (pos % 11 = 0) AS forwards FROM w GROUP BY lane""")
def lane_stats(r: Relations):
    q = queue(r)
    return fairness.lane_stats(q.where("pos % 3 = 0"), q.where("pos % 5 = 0"), q.where("pos % 11 = 0"))


@query("""t AS (SELECT 'g' || (o_custkey % 40) AS "group", o_orderpriority AS topic, o_orderpriority[1]::INT - 1 AS rank, count(*) FILTER (o_orderstatus = 'O' AND o_custkey % 3 = 0)::BIGINT AS lag, o_custkey % 40 = 3 AND o_orderpriority[1] = '1' AS paused FROM orders GROUP BY ALL)
SELECT "group", topic, rank::INT AS rank, EXISTS (SELECT 1 FROM t h WHERE h."group" = t."group" AND h.rank < t.rank AND h.lag > 0 AND NOT h.paused) AS must_yield FROM t""")
def priority_gate(r: Relations):
    group = F.col("o_custkey") % 40
    t = r.orders.groupBy(F.concat(F.lit("g"), group).alias("group"), F.col("o_orderpriority").alias("topic"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("rank"), ((group == 3) & F.col("o_orderpriority").startswith("1")).alias("paused")).agg(
        F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_custkey") % 3 == 0)).alias("lag"))
    return fairness.priority_gate(t).select("group", "topic", "rank", "must_yield")


@query("""t AS (SELECT event_type AS topic, event_id AS tick, value > 20 AS higher_lag FROM events)
SELECT topic, tick, NOT higher_lag OR row_number() OVER (PARTITION BY topic, higher_lag ORDER BY tick) % 4 = 0 AS proceeds FROM t""")
def weighted_interleave(r: Relations):
    return fairness.interleave(r.events.select(F.col("event_type").alias("topic"), F.col("event_id").alias("tick"), (F.col("value") > 20).alias("higher_lag"))).drop("higher_lag")


@query("""g AS (SELECT worker_class AS "group", [topic, 'p' || worker_class, 'topic0'] AS topics FROM manifest WHERE runtime = 'ruby'), x AS (SELECT unnest(topics) AS topic FROM g)
SELECT topic, 'duplicate' AS problem FROM x GROUP BY topic HAVING count(*) > 1 UNION ALL SELECT DISTINCT topic, 'overlap' FROM x WHERE topic IN (SELECT topic FROM manifest WHERE runtime = 'go')""")
def priority_conflicts(r: Relations):
    groups = r.manifest.where("runtime = 'ruby'").select(F.col("worker_class").alias("group"), F.array("topic", F.concat(F.lit("p"), "worker_class"), F.lit("topic0")).alias("topics"))
    return fairness.duplicate_topics(groups, r.manifest.where("runtime = 'go'").select("topic"))


@query("""s AS (SELECT job_id, min(run_at) AS run_at, max(CASE WHEN partition_id % 4 = 0 THEN run_at + INTERVAL 60 SECOND END) AS lease_until FROM jobs GROUP BY job_id)
SELECT job_id, run_at FROM s, clock WHERE run_at <= now AND (lease_until IS NULL OR lease_until <= now) ORDER BY run_at, job_id LIMIT 100""")
def due_claim(r: Relations):
    s = r.jobs.groupBy("job_id").agg(F.min("run_at").alias("run_at"), F.max(F.when(F.col("partition_id") % 4 == 0, F.col("run_at") + schedule.seconds(60))).alias("lease_until"))
    return schedule.claim_due(s, at(NOW)).select("job_id", "run_at")


SCHEDULES = "s AS (SELECT s_suppkey AS id, ['skip', 'fire_once', 'backfill', 'weird'][s_suppkey % 4 + 1] AS misfire_policy, s_suppkey % 10 != 0 AS enabled, TIMESTAMP '1998-05-31 00:00:00' + to_minutes((s_suppkey * 37) % 2000) AS next_run_at FROM supplier)"


def schedules(r: Relations):
    k = (F.col("s_suppkey") % 4 + 1).cast("int")
    return r.supplier.select(
        F.col("s_suppkey").alias("id"), F.element_at(F.array(F.lit("skip"), F.lit("fire_once"), F.lit("backfill"), F.lit("weird")), k).alias("misfire_policy"), (F.col("s_suppkey") % 10 != 0).alias("enabled"),
        (at("1998-05-31 00:00:00") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("s_suppkey") * 37 % 2000).cast("int"))).alias("next_run_at"),
    )


@query(SCHEDULES + " SELECT id, next_run_at FROM s, clock WHERE enabled AND next_run_at <= now ORDER BY next_run_at, id LIMIT 50")
def due_schedules(r: Relations):
    return schedule.due_schedules(schedules(r), at(NOW), 50).select("id", "next_run_at")


INSTANTS = SCHEDULES + """, m AS (SELECT TIMESTAMP '1998-05-31 00:00:00' + to_minutes(x) AS fire_at FROM range(2881) q(x)),
i AS (SELECT id, fire_at FROM s JOIN m ON fire_at >= next_run_at AND minute(fire_at) IN (0, 20, 40) AND hour(fire_at) BETWEEN 6 AND 22)"""


def instants(r: Relations):
    return cron.instants(schedules(r), "*/20 6-22 * * *", F.col("next_run_at"), at("1998-06-02 00:00:00"))


@query(INSTANTS + " SELECT id, fire_at FROM i")
def cron_instants(r: Relations):
    return instants(r).select("id", "fire_at")


@query("""d AS (SELECT DISTINCT o_orderdate AS after FROM orders), m AS (SELECT after, after + to_minutes(x) AS t FROM d, range(1, 11521) q(x) WHERE x % 5 = 0)
SELECT after, min(t) AS fire_at FROM m WHERE minute(t) = 30 AND hour(t) IN (8, 17) AND (dayofweek(t) IN (1, 3) OR day(t) IN (1, 15)) GROUP BY after""")
def cron_next(r: Relations):
    d = r.orders.select(F.col("o_orderdate").alias("after")).distinct()
    stop = F.col("after") + F.make_dt_interval(F.lit(8))
    return cron.instants(d, "30 8,17 1,15 * mon,wed", F.col("after") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(1)), stop).groupBy("after").agg(F.min("fire_at").alias("fire_at"))


PLAN = INSTANTS + """, q AS (SELECT id, misfire_policy, next_run_at, unnest(list_prepend(next_run_at, coalesce((SELECT list(fire_at ORDER BY fire_at) FROM i WHERE i.id = s.id AND fire_at > next_run_at), []))) AS fire_at FROM s, clock WHERE next_run_at <= now),
p AS (SELECT q.*, row_number() OVER (PARTITION BY id ORDER BY fire_at) AS n FROM q),
c AS (SELECT p.* FROM p, clock WHERE fire_at <= now AND CASE misfire_policy WHEN 'backfill' THEN n <= 20 WHEN 'skip' THEN n = 1 AND now - next_run_at <= INTERVAL 2 HOUR ELSE n = 1 END),
f AS (SELECT id, count(*) AS fires, min(fire_at) AS first_fire, max(fire_at) AS last_fire FROM c GROUP BY id)"""


@query(PLAN + """, n AS (SELECT p.id, min(fire_at) AS new_next FROM p LEFT JOIN f USING (id), clock WHERE fire_at > CASE WHEN misfire_policy = 'backfill' THEN last_fire ELSE now END GROUP BY p.id)
SELECT s.id, misfire_policy, coalesce(fires, 0) AS fires, first_fire, last_fire, coalesce(new_next, next_run_at) AS new_next FROM s LEFT JOIN f USING (id) LEFT JOIN n USING (id)""")
def plan_fires(r: Relations):
    return schedule.plan_fires(instants(r).select("id", "fire_at"), schedules(r), at(NOW), 7200, 20)


@query(PLAN + """ SELECT c.id AS schedule_id, fire_at, 'sched-' || c.id || '-' || epoch(fire_at)::BIGINT AS job_id FROM c WHERE NOT (c.id % 4 = 2 AND hour(fire_at) BETWEEN 6 AND 11 AND minute(fire_at) = 20)""")
def unseen_fires(r: Relations):
    from ..functions import scalars

    due = schedule.fires(instants(r).select("id", "fire_at"), schedules(r), at(NOW), 7200, 20).withColumnRenamed("id", "schedule_id")
    known = due.where("schedule_id % 4 = 2 and hour(fire_at) between 6 and 11 and minute(fire_at) = 20")
    return schedule.unseen_fires(due, known).withColumn("job_id", scalars.fire_id(F.col("schedule_id"), F.col("fire_at")))


FIRES = """fires AS (SELECT l_suppkey AS schedule_id, l_shipdate AS fire_at, CASE l_returnflag WHEN 'A' THEN 'pending' ELSE 'dispatched' END AS status, l_shipdate + to_seconds(l_linenumber) AS created_at,
  CASE WHEN l_returnflag != 'A' THEN l_shipdate + INTERVAL 1 MINUTE END AS dispatched_at, l_orderkey AS fire_key FROM lineitem)"""


def fires(r: Relations):
    return r.lineitem.select(
        F.col("l_suppkey").alias("schedule_id"), F.col("l_shipdate").alias("fire_at"), F.when(F.col("l_returnflag") == "A", "pending").otherwise("dispatched").alias("status"),
        (F.col("l_shipdate") + schedule.seconds(F.col("l_linenumber"))).alias("created_at"), F.when(F.col("l_returnflag") != "A", F.col("l_shipdate") + schedule.seconds(60)).alias("dispatched_at"), F.col("l_orderkey").alias("fire_key"),
    )


@query(SCHEDULES + ", " + FIRES + """ SELECT schedule_id, fire_at, count(*) AS n FROM (SELECT schedule_id, fire_at, created_at FROM fires JOIN s ON s.id = schedule_id, clock WHERE status = 'pending' AND created_at <= now - INTERVAL 120 SECOND AND enabled) GROUP BY ALL""")
def pending_recovery(r: Relations):
    s = schedules(r).where("enabled").select(F.col("id").alias("schedule_id"), "misfire_policy")
    return schedule.pending_recovery(fires(r), s, at(NOW), limit=None).groupBy("schedule_id", "fire_at").agg(F.count("*").alias("n"))


@query(FIRES + """ SELECT schedule_id, status, count(*) AS n FROM fires, clock WHERE NOT coalesce(status = 'dispatched' AND dispatched_at < now - INTERVAL 7 DAY, false) GROUP BY schedule_id, status""")
def fires_pruned(r: Relations):
    return schedule.pruned(fires(r), at(NOW)).groupBy("schedule_id", "status").agg(F.count("*").alias("n"))


@query(SCHEDULES + """ SELECT id, (epoch(TIMESTAMP '1998-06-01 00:00:00') - epoch(next_run_at))::BIGINT AS age_seconds, epoch(TIMESTAMP '1998-06-01 00:00:00') - epoch(next_run_at) > 2 * (600 + id % 7 * 3600) AS stale FROM s WHERE enabled""")
def cron_stale(r: Relations):
    s = schedules(r).withColumns({"last_fire_at": F.lit(None).cast("timestamp_ntz"), "interval_seconds": 600 + F.col("id") % 7 * 3600})
    return schedule.staleness(s, at(NOW)).select("id", "age_seconds", "stale")


@query("""v AS (SELECT user_id AS k, ts, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT k, ts, event_id, value FROM v WHERE n = 1 AND k NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)""")
def upsert_delete(r: Relations):
    rows = schedule.latest(r.events.select(F.col("user_id").alias("k"), "ts", "event_id", "value"), ["k"], ["ts", "event_id"])
    return schedule.without(rows, r.events.where("event_type = 'error' and value > 200").select(F.col("user_id").alias("k")), ["k"])


@query("""i AS (SELECT DISTINCT user_id AS id, date_trunc('hour', ts) AS fire_at FROM events)
SELECT id, fire_at, (epoch(lead(fire_at) OVER (PARTITION BY id ORDER BY fire_at)) - epoch(fire_at))::BIGINT AS interval_seconds FROM i""")
def fire_intervals(r: Relations):
    return schedule.intervals(r.events.select(F.col("user_id").alias("id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("fire_at")).distinct())


CRON_NOW = "2024-03-31 06:00:00"
#: Zones of the schedules below; the clocks of one went forward at 01:00 UTC of that day.
CRON_ZONES = ("UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata")


@query(f"""s AS (SELECT p_partkey AS id, p_partkey % 6 AS k, {list(CRON_ZONES)}[p_partkey % 4 + 1] AS zone, p_partkey % 60 AS m, p_partkey % 24 AS h, p_partkey % 7 AS w, 1 + p_partkey % 28 AS d,
  ['fire_once', 'skip', 'backfill'][p_partkey % 3 + 1] AS policy, TIMESTAMP '{CRON_NOW}' - to_minutes((p_partkey * 37 % 3000 - 500)::INT) AS due, TIMESTAMP '{CRON_NOW}' AS now FROM part),
days AS (SELECT TIMESTAMP '2024-03-27' + to_days(x::INT) AS day FROM range(56) r(x)), mins AS (SELECT x AS minute FROM range(1440) r(x)),
walls AS (SELECT s.*, day + to_minutes(minute::INT) AS wall FROM s, days, mins WHERE k < 5 AND CASE k WHEN 1 THEN minute % 15 = 0 WHEN 4 THEN minute = 150 ELSE minute = h * 60 + m END
  AND (k != 2 OR dayofweek(day) = w) AND (k != 3 OR day(day) = d)),
i AS (SELECT id, timezone('UTC', timezone(zone, wall)) AS t FROM walls WHERE timezone(zone, timezone(zone, wall)) = wall),
f AS (SELECT s.id, s.due AS t FROM s WHERE k < 5 AND due <= now AND (policy != 'skip' OR due + INTERVAL 60 SECOND >= now)
  UNION ALL SELECT id, t FROM (SELECT s.id, i.t, row_number() OVER (PARTITION BY s.id ORDER BY i.t) AS n FROM s JOIN i ON i.id = s.id WHERE policy = 'backfill' AND i.t > due AND i.t <= now) WHERE n < 5),
g AS (SELECT id, count(*) AS fires, min(t) AS first_fire, max(t) AS last_fire FROM f GROUP BY id),
n AS (SELECT s.id, min(i.t) AS nxt FROM s LEFT JOIN g ON g.id = s.id JOIN i ON i.id = s.id AND i.t > CASE WHEN policy = 'backfill' THEN least(last_fire, now) ELSE now END WHERE due <= now GROUP BY s.id)
SELECT s.id, NOT (k = 5 AND due <= now) AS enabled, CASE WHEN k = 5 AND due <= now THEN 'bad minute field' END AS problem, coalesce(fires, 0)::INT AS fires, first_fire, last_fire, coalesce(nxt, due) AS new_next FROM s LEFT JOIN g USING (id) LEFT JOIN n USING (id)""")
def schedule_tick(r: Relations):
    """Schedules of many expressions and four zones; every sixth one does not parse."""
    p = F.col("p_partkey")
    text = lambda *cs: F.concat_ws(" ", *[c if isinstance(c, str) else c.cast("string") for c in cs])
    star = F.lit("*")
    expr = (
        F.when(p % 6 == 0, text(p % 60, p % 24, star, star, star)).when(p % 6 == 1, "*/15 * * * *").when(p % 6 == 2, text(p % 60, p % 24, star, star, p % 7))
        .when(p % 6 == 3, text(p % 60, p % 24, 1 + p % 28, star, star)).when(p % 6 == 4, "30 2 * * *").otherwise("61 * * * *")
    )
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (p % n + 1).cast("int"))
    at_ = at(CRON_NOW) - F.make_dt_interval(F.lit(0), F.lit(0), (p * 37 % 3000 - 500).cast("int"))
    s = r.part.select(p.alias("id"), expr.alias("cron_expr"), pick(CRON_ZONES, 4).alias("timezone"), F.lit(True).alias("enabled"), pick(("fire_once", "skip", "backfill"), 3).alias("misfire_policy"), at_.alias("next_run_at"))
    out = schedule.tick(s, at(CRON_NOW), cap=5)
    return out.select("id", "enabled", "problem", F.size("fires").alias("fires"), F.array_min("fires").alias("first_fire"), F.array_max("fires").alias("last_fire"), "new_next")


@query("""l AS (SELECT user_id AS k, ts, event_id, value, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) AS n FROM events),
v AS (SELECT k, ts, event_id, value, row_number() OVER (PARTITION BY k ORDER BY event_id % 2 DESC) AS n FROM l WHERE n = 1)
SELECT k, ts, event_id, value FROM v WHERE n = 1 AND k NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 200)""")
def versioned_upsert(r: Relations):
    """Even events first, then odd ones in place of them, then a deletion: three versions of one table."""
    t = VersionedTable(r.spark, scratch(r.spark, "users"), "k bigint, ts timestamp_ntz, event_id bigint, value double", ["k"], 16)
    rows = r.events.select(F.col("user_id").alias("k"), "ts", "event_id", "value")
    for part in (0, 1):
        t.upsert(rows.where(F.col("event_id") % 2 == part), ["ts", "event_id"])
    t.delete(r.events.where("event_type = 'error' and value > 200").select(F.col("user_id").alias("k")))
    return t.read()


@query("""c AS (SELECT CASE WHEN user_id % 7 = 0 THEN '' ELSE 's' || user_id END AS slot_id, event_id AS request_id FROM events WHERE event_type = 'click'),
h AS (SELECT DISTINCT 's' || user_id AS slot_id FROM events, clock WHERE event_type = 'signup' AND ts + INTERVAL 6 HOUR > log_now)
SELECT slot_id, request_id, slot_id = '' OR (slot_id NOT IN (SELECT slot_id FROM h) AND row_number() OVER (PARTITION BY slot_id ORDER BY request_id) = 1) AS won,
CASE WHEN slot_id != '' AND slot_id NOT IN (SELECT slot_id FROM h) AND row_number() OVER (PARTITION BY slot_id ORDER BY request_id) = 1 THEN log_now + INTERVAL 3600 SECOND END AS until FROM c, clock""")
def slot_claims(r: Relations):
    slot = F.concat(F.lit("s"), "user_id")
    claims = r.events.where("event_type = 'click'").select(F.when(F.col("user_id") % 7 == 0, "").otherwise(slot).alias("slot_id"), F.col("event_id").alias("request_id"))
    held = r.events.where("event_type = 'signup'").select(slot.alias("slot_id"), (F.col("ts") + F.expr("interval 6 hours")).alias("until"))
    return fairness.claim_slots(claims, held, at(LOG_NOW), 3600)


@query("""l AS (SELECT event_id AS slot_id, round(value)::DOUBLE AS expiry FROM events WHERE event_type = 'click'), n AS (SELECT event_id - 1 AS slot_id, max(round(value))::DOUBLE AS at FROM events WHERE event_type = 'signup' GROUP BY 1),
x AS (SELECT slot_id, coalesce(n.at + 60, expiry) AS expiry FROM l LEFT JOIN n USING (slot_id)), s AS (SELECT event_id AS slot_id FROM events)
SELECT s.slot_id, x.expiry, coalesce(x.expiry > 80, false) AS active FROM s LEFT JOIN x USING (slot_id)""")
def lease_renewals(r: Relations):
    leases = r.events.where("event_type = 'click'").select(F.col("event_id").alias("slot_id"), F.round("value").alias("expiry"))
    renewals = r.events.where("event_type = 'signup'").select((F.col("event_id") - 1).alias("slot_id"), F.round("value").alias("at"))
    return fairness.lease_active(r.events.select(F.col("event_id").alias("slot_id")), fairness.renew_leases(leases, renewals, 60), 80.0)

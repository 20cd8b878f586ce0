"""Ledger, reconciler and working-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger, schedule
from ..sources.bridge import NOW, Relations, at
from .registry import query


#: The ledger as SQL: one event after the other, with the sequences seen, succeeded and failed as lists.
LEDGER = """
owner AS (SELECT b.batch_id, coalesce(total_jobs, 0)::BIGINT AS total, sealed, status FROM batches b LEFT JOIN totals USING (batch_id)),
step AS (
  SELECT batch_id, total, sealed, status, 0::BIGINT AS ord, []::BIGINT[] AS seen, []::BIGINT[] AS ok, []::BIGINT[] AS bad, 0::BIGINT AS duplicates, NULL::INT AS code,
    NULL::TIMESTAMP AS complete_at, NULL::BIGINT AS complete_seq, NULL::TIMESTAMP AS success_at, NULL::BIGINT AS success_seq FROM owner
  UNION ALL
  SELECT batch_id, total, sealed, CASE WHEN fresh AND live AND ending IS NOT NULL AND status = 'running' THEN ending ELSE status END, ord, seen, ok, bad, duplicates + (NOT fresh)::BIGINT,
    CASE WHEN NOT fresh THEN 0 WHEN NOT live THEN 2 WHEN fires_success OR (fires_complete AND ending IS NOT NULL) THEN 1 WHEN fires_complete THEN 3 ELSE 2 END,
    CASE WHEN fires_complete THEN moment ELSE complete_at END, CASE WHEN fires_complete THEN seq ELSE complete_seq END, CASE WHEN fires_success THEN moment ELSE success_at END, CASE WHEN fires_success THEN seq ELSE success_seq END
  FROM (SELECT *, fresh AND live AND complete_at IS NULL AND (ending IS NOT NULL OR len(seen) >= total) AS fires_complete, fresh AND live AND success_at IS NULL AND coalesce(ending = 'success', false) AS fires_success
    FROM (SELECT *, sealed AND total >= 1 AS live, CASE WHEN len(ok) >= total THEN 'success' WHEN len(ok) + len(bad) >= total THEN 'complete' END AS ending
      FROM (SELECT s.batch_id, total, sealed, status, e.ord, duplicates, complete_at, complete_seq, success_at, success_seq, e.occurred_at AS moment, e.batch_seq AS seq,
          status != 'cancelled' AND (touches OR succeeds OR fails) AS fresh,
          CASE WHEN touches AND status != 'cancelled' THEN list_append(seen, e.batch_seq) ELSE seen END AS seen,
          CASE WHEN succeeds AND status != 'cancelled' THEN list_append(ok, e.batch_seq) ELSE ok END AS ok, CASE WHEN fails AND status != 'cancelled' THEN list_append(bad, e.batch_seq) ELSE bad END AS bad
        FROM step s JOIN completions e ON e.batch_id = s.batch_id AND e.ord = s.ord + 1,
          LATERAL (SELECT NOT list_contains(s.seen, e.batch_seq) AS touches, e.op = 'success' AND NOT list_contains(s.ok, e.batch_seq) AS succeeds,
            e.op = 'failed' AND NOT list_contains(s.ok, e.batch_seq) AND NOT list_contains(s.bad, e.batch_seq) AS fails) AS l)))),
ledger AS (SELECT batch_id, total AS total_jobs, sealed, len(seen)::BIGINT AS touched, len(ok)::BIGINT AS completed, len(bad)::BIGINT AS failed, duplicates, status, complete_at, complete_seq, success_at, success_seq
  FROM step QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY ord DESC) = 1)
"""


def owners(r: Relations):
    """Batches with their totals, status and seal."""
    return r.batches.select("batch_id", "sealed", "status").join(r.totals, "batch_id", "left").fillna(0, ["total_jobs"])


def folded(r: Relations):
    return ledger.fold(r.completions, owners(r))


@query(LEDGER + "SELECT batch_id, total_jobs, touched, completed, failed, duplicates, status, complete_at, complete_seq, success_at, success_seq FROM ledger")
def ledger_status(r: Relations):
    at = lambda kind: [F.col(f"{kind}_at.l_shipdate").alias(f"{kind}_at"), F.col(f"{kind}_at.l_linenumber").cast("bigint").alias(f"{kind}_seq")]
    return folded(r).select("batch_id", "total_jobs", "touched", "completed", "failed", "duplicates", "status", *at("complete"), *at("success"))


@query(LEDGER + "SELECT batch_id, 'complete' AS kind, complete_at AS at, complete_seq AS seq FROM ledger WHERE complete_at IS NOT NULL UNION ALL SELECT batch_id, 'success', success_at, success_seq FROM ledger WHERE success_at IS NOT NULL")
def ledger_callbacks(r: Relations):
    return ledger.callbacks(folded(r)).select("batch_id", "kind", F.col("at.l_shipdate").alias("at"), F.col("at.l_linenumber").cast("bigint").alias("seq"))


@query(LEDGER + "SELECT s.batch_id, e.batch_seq, e.occurred_at, e.op, code FROM step s JOIN completions e ON e.batch_id = s.batch_id AND e.ord = s.ord")
def ledger_codes(r: Relations):
    return ledger.return_codes(r.completions, owners(r)).select("batch_id", "batch_seq", "occurred_at", "op", "code")


@query("""SELECT c.batch_id, c.batch_seq, op, CASE WHEN b.batch_id IS NULL THEN 'not_found' ELSE 'duplicate' END AS reason
FROM completions c LEFT JOIN (SELECT * FROM batches WHERE batch_id % 10 != 3) b USING (batch_id) WHERE b.batch_id IS NULL OR b.status = 'cancelled'""")
def ledger_dropped(r: Relations):
    return ledger.dropped(r.completions, r.batches.where("batch_id % 10 != 3")).select("batch_id", "batch_seq", "op", "reason")


@query(LEDGER + """SELECT batch_id, total_jobs, touched, completed, failed, CASE WHEN status != 'running' THEN 'sealed' WHEN total_jobs = 0 OR completed >= total_jobs THEN 'success' WHEN completed + failed >= total_jobs THEN 'complete'
  WHEN touched >= total_jobs THEN 'early_complete' ELSE 'sealed' END AS outcome, CASE WHEN outcome = 'success' THEN 'complete,success' WHEN outcome IN ('complete', 'early_complete') THEN 'complete' ELSE '' END AS claims FROM ledger WHERE NOT sealed""")
def ledger_seal(r: Relations):
    """The batches that are still open, sealed now."""
    open_ = folded(r).where("not sealed").select("batch_id", "total_jobs", "touched", "completed", "failed", "status")
    return ledger.seal(open_).select("batch_id", "total_jobs", "touched", "completed", "failed", "outcome", F.array_join("claims", ",").alias("claims"))


@query("SELECT batch_id, job_id, batch_seq, run_at, row_number() OVER (PARTITION BY batch_id ORDER BY run_at, job_id, duration)::BIGINT AS assigned_seq FROM jobs WHERE batch_id IS NOT NULL")
def batch_seq(r: Relations):
    return ledger.sequence(r.jobs.where("batch_id is not null").select("batch_id", "job_id", "batch_seq", "run_at", "duration"), ["run_at", "job_id", "duration"]).drop("duration")


@query(LEDGER + "SELECT status, count(*) AS batches FROM ledger GROUP BY status")
def status_counts(r: Relations):
    return folded(r).groupBy("status").agg(F.count("*").alias("batches"))


RECONCILE = LEDGER + """, w AS (SELECT b.batch_id, CASE WHEN b.batch_id % 50 = 7 THEN NULL WHEN b.batch_id % 4 = 2 THEN b.status ELSE l.status END AS status, b.sealed, l.total_jobs, completed, failed FROM batches b JOIN ledger l USING (batch_id)),
d AS (SELECT batch_id, CASE WHEN status IS NULL THEN 'gone' WHEN status != 'running' THEN 'not_running' WHEN NOT sealed THEN 'open' WHEN total_jobs = 0 THEN 'empty_success'
  WHEN completed + failed < total_jobs THEN 'in_progress' WHEN failed > 0 THEN 'finished_complete' ELSE 'finished_success' END AS decision FROM w)"""


def _decided(r: Relations):
    """Ledger rows as a reconciler meets them: some vanished, some with a status that was never written."""
    stored = r.batches.select("batch_id", F.col("status").alias("stored"))
    status = F.when(F.col("batch_id") % 50 == 7, None).when(F.col("batch_id") % 4 == 2, F.col("stored")).otherwise(F.col("status"))
    return schedule.stuck(folded(r).join(stored, "batch_id").withColumn("status", status)).select("batch_id", "decision", "status", "total_jobs", "failed")


@query(RECONCILE + " SELECT batch_id, decision FROM d")
def reconcile_stuck(r: Relations):
    return _decided(r).select("batch_id", "decision")


@query(RECONCILE + " SELECT decision, count(*) AS n, count(*) > 100 AS capped, array_to_string(list(batch_id ORDER BY batch_id)[1:25], ' ') AS details FROM d GROUP BY decision")
def reconciler_summary(r: Relations):
    return schedule.reconciler_summary(_decided(r).select("batch_id", "decision"), "batch_id").withColumn("details", F.array_join("details", " "))


@query(RECONCILE + ", q AS (SELECT batch_id, decision, row_number() OVER (PARTITION BY decision ORDER BY batch_id)::INT AS place FROM d) SELECT * FROM q WHERE place <= 100")
def reconcile_cap(r: Relations):
    return schedule.capped(_decided(r).select("batch_id", "decision"), ["decision"], ["batch_id"])


LOST = "x AS (SELECT batch_id, CASE WHEN hint = 'O' OR batch_id % 3 = 0 THEN 'not_lost' WHEN created_at > now - INTERVAL 400 DAY AND batch_id % 2 = 0 THEN 'skipped_recent' ELSE 'refire' END AS decision, CASE hint WHEN 'O' THEN 'running' WHEN 'F' THEN 'success' ELSE 'complete' END AS status FROM batches, clock)"


@query(RECONCILE + ", " + LOST + """, s AS (SELECT 0 AS kind, batch_id, decision, w.status, total_jobs, failed FROM d JOIN w USING (batch_id) ORDER BY batch_id LIMIT 100), t AS (SELECT 1 AS kind, batch_id, decision, status, 0 AS total_jobs, 0 AS failed FROM x ORDER BY batch_id LIMIT 100),
e AS (SELECT *, CASE WHEN decision LIKE 'finished%' THEN 'recovered_running' WHEN decision = 'empty_success' THEN 'recovered_empty' WHEN decision = 'refire' THEN 'refired_lost' WHEN decision = 'skipped_recent' THEN 'skipped_recent_refire' WHEN decision = 'not_lost' THEN 'skipped_not_done' ELSE 'skipped_' || decision END AS action FROM (FROM s UNION ALL FROM t)),
f AS (SELECT string_agg(batch_id || ':' || action || ':' || coalesce(status, '') || ':' || total_jobs || ':' || failed, ' ' ORDER BY kind, batch_id) AS details FROM (FROM e ORDER BY kind, batch_id LIMIT 25))
SELECT (SELECT count(*) FROM d) AS found_stale, (SELECT count(*) FROM x) AS found_lost, count(*) FILTER (kind = 0) AS processed_stale, count(*) FILTER (kind = 1) AS processed_lost, count(*) FILTER (action LIKE 'recovered%') AS recovered_stale,
count(*) FILTER (action IN ('skipped_open', 'skipped_in_progress')) AS skipped_stale, count(*) FILTER (action = 'refired_lost') AS refired_lost, count(*) FILTER (action = 'skipped_recent_refire') AS skipped_recent, 0::BIGINT AS produce_failed, (SELECT details FROM f) AS details, (SELECT count(*) FROM d) > 100 AS capped_stale, (SELECT count(*) FROM x) > 100 AS capped_lost FROM e""")
def reconciler_run(r: Relations):
    """One run over all stale and lost batches; the caps and the details are the report's own."""
    lost = _lost(r).withColumns({"total_jobs": F.lit(0), "failed": F.lit(0)})
    show = lambda d: F.concat_ws(":", d["batch_id"], d["action"], F.coalesce(d["outcome"], F.lit("")), d["total_jobs"], d["failed_count"])
    return schedule.run_summary(_decided(r), lost).withColumn("details", F.array_join(F.transform("details", show), " "))


@query("""SELECT batch_id, CASE WHEN hint = 'O' OR batch_id % 3 = 0 THEN 'not_lost' WHEN created_at > now - INTERVAL 400 DAY AND batch_id % 2 = 0 THEN 'skipped_recent' ELSE 'refire' END AS decision FROM batches, clock""")
def reconcile_lost(r: Relations):
    return _lost(r).select("batch_id", "decision")


def _lost(r: Relations):
    b = r.batches.select(
        "batch_id", F.when(F.col("hint") == "O", "running").when(F.col("hint") == "F", "success").otherwise("complete").alias("status"),
        F.when(F.col("batch_id") % 3 == 0, F.col("created_at")).alias("dispatched_at"), F.when(F.col("batch_id") % 2 == 0, F.col("created_at")).alias("refired_at"),
    )
    return schedule.lost_callbacks(b, at(NOW), 400 * 86_400).select("batch_id", "decision", "status")


@query("""live AS (SELECT user_id AS consumer_id, max(ts) AS last_seen FROM events, clock GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30 18:00:00' - INTERVAL 3 HOUR)
SELECT job_id, consumer_id, run_at AS claimed_at FROM jobs, clock WHERE run_at <= now - INTERVAL 40 SECOND AND NOT EXISTS (SELECT 1 FROM live WHERE live.consumer_id = jobs.consumer_id)
ORDER BY run_at, job_id LIMIT 500""")
def orphans(r: Relations):
    live = schedule.live_consumers(r.events.select(F.col("user_id").alias("consumer_id"), F.col("ts").alias("seen_at")), at("2024-01-30 18:00:00"), 3 * 3600)
    held = r.jobs.select("job_id", "consumer_id", F.col("run_at").alias("claimed_at"))
    return schedule.orphans(held, live, at(NOW))


@query("""live AS (SELECT DISTINCT user_id AS owner FROM events WHERE event_type = 'purchase' AND value > 60),
held AS (SELECT job_id, min(consumer_id) AS owner, max(run_at) AS claimed_at FROM jobs WHERE partition_id < 8 GROUP BY job_id),
c AS (SELECT DISTINCT job_id, CASE WHEN partition_id % 4 = 0 THEN consumer_id ELSE consumer_id + 1 END AS consumer_id FROM jobs)
SELECT c.job_id, consumer_id, h.owner, CASE WHEN h.owner IS NULL THEN 'won' WHEN h.owner = consumer_id THEN 'resumed' WHEN l.owner IS NOT NULL OR claimed_at > now - INTERVAL 40 SECOND THEN 'lost' ELSE 'steal' END AS outcome
FROM c CROSS JOIN clock LEFT JOIN held h ON c.job_id = h.job_id LEFT JOIN live l ON l.owner = h.owner""")
def workset_claims(r: Relations):
    live = r.events.where("event_type = 'purchase' and value > 60").select(F.col("user_id").alias("consumer_id")).distinct()
    held = r.jobs.where("partition_id < 8").groupBy("job_id").agg(F.min("consumer_id").alias("consumer_id"), F.max("run_at").alias("claimed_at"))
    claims = r.jobs.select("job_id", F.when(F.col("partition_id") % 4 == 0, F.col("consumer_id")).otherwise(F.col("consumer_id") + 1).alias("consumer_id")).distinct()
    return schedule.claim_outcome(claims, held, live, at(NOW)).select("job_id", "consumer_id", "owner", "outcome")


@query("""old AS (SELECT job_id, consumer_id, run_at FROM jobs, clock WHERE run_at <= now - INTERVAL 40 SECOND)
SELECT consumer_id, count(*) AS checked, count(*) FILTER (consumer_id % 3 = 0) AS reclaimed, count(*) FILTER (consumer_id % 3 = 1) AS skipped FROM old GROUP BY consumer_id""")
def reclaim_counters(r: Relations):
    old = r.jobs.where(F.col("run_at") <= at(NOW) - schedule.seconds(40))
    k = F.col("consumer_id") % 3
    return old.groupBy("consumer_id").agg(F.count("*").alias("checked"), F.count_if(k == 0).alias("reclaimed"), F.count_if(k == 1).alias("skipped"))


@query(LEDGER + """SELECT batch_id, status FROM ledger WHERE duplicates > 0 AND status IN ('success', 'complete') AND batch_id % 4 != 1""")
def replay_callbacks(r: Relations):
    """Finished batches with replayed events; one in four has all its claims (that is the operator's own condition)."""
    some = "batch_id % 4 != 1"  # what is not asked for is not folded
    done = ledger.fold(r.completions.where(some), owners(r).where(some))
    return done.where("duplicates > 0 and status in ('success', 'complete')").select("batch_id", "status")

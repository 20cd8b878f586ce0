"""Delayed jobs, recurring schedules, working sets, uniqueness and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cron
from ..functions.scalars import epoch


def seconds(n) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n) if not isinstance(n, Column) else n)


def claim_due(scheduled: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """The oldest due jobs without a live lease (a distributed top-k)."""
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now)
    return scheduled.where((F.col("run_at") <= now) & free).orderBy("run_at", "job_id").limit(limit)


def due_schedules(schedules: DataFrame, now: Column, limit: int) -> DataFrame:
    return schedules.where(F.col("enabled") & (F.col("next_run_at") <= now)).orderBy("next_run_at", "id").limit(limit)


def _instants(instants: DataFrame, schedules: DataFrame, now: Column) -> DataFrame:
    """A due schedule's next run and its instants after that."""
    due = schedules.where(F.col("next_run_at") <= now).select("id", "misfire_policy", "next_run_at")
    later = instants.select("id", "fire_at").join(due, "id").where("fire_at > next_run_at")
    return due.withColumn("fire_at", F.col("next_run_at")).unionByName(later, allowMissingColumns=True)


def fires(instants: DataFrame, schedules: DataFrame, now: Column, grace_seconds: int = 60, cap: int = 100) -> DataFrame:
    """(id, fire_at) to enqueue for schedules(id, misfire_policy, next_run_at) that are due.

    instants(id, fire_at) are a schedule's instants from next_run_at on, at least one after now.
    skip fires next_run_at only within the grace; backfill it and all missed ones after it, ``cap``
    at most; fire_once, and any unknown policy, next_run_at alone.
    """
    n = F.row_number().over(Window.partitionBy("id").orderBy("fire_at"))
    policy = F.coalesce("misfire_policy", F.lit(""))
    past = _instants(instants, schedules, now).where(F.col("fire_at") <= now).withColumn("n", n)
    taken = F.when(policy == "backfill", F.col("n") <= max(1, cap)).when(policy == "skip", (F.col("n") == 1) & (F.col("fire_at") + seconds(grace_seconds) >= now)).otherwise(F.col("n") == 1)
    return past.where(taken).select("id", "fire_at")


def plan_fires(instants: DataFrame, schedules: DataFrame, now: Column, grace_seconds: int = 60, cap: int = 100) -> DataFrame:
    """Per schedule the number, first and last of its ``fires``, and the next run.

    The next run is the first instant after now, or for a backfill the one after the last fire; a
    minute after the last instant where none is left. Schedules that are not due keep theirs.
    """
    found = fires(instants, schedules, now, grace_seconds, cap).groupBy("id").agg(F.count("*").alias("fires"), F.min("fire_at").alias("first_fire"), F.max("fire_at").alias("last_fire"))
    each = _instants(instants, schedules, now).join(found.select("id", "last_fire"), "id", "left")
    after = F.when(F.coalesce("misfire_policy", F.lit("")) == "backfill", F.least("last_fire", now)).otherwise(now)
    ahead = F.min(F.when(F.col("fire_at") > after, F.col("fire_at")))
    behind = F.max(F.when(F.col("fire_at") <= after, F.col("fire_at"))) + seconds(60)
    nexts = each.groupBy("id").agg(F.coalesce(ahead, behind).alias("planned"))
    out = schedules.select("id", "misfire_policy", "next_run_at").join(found, "id", "left").join(nexts, "id", "left")
    return out.select("id", "misfire_policy", F.coalesce("fires", F.lit(0)).alias("fires"), "first_fire", "last_fire", F.coalesce("planned", "next_run_at").alias("new_next"))


def tick(schedules: DataFrame, now: Column, grace_seconds: int = 60, cap: int = 100) -> DataFrame:
    """One tick over schedules(id, cron_expr, timezone, enabled, misfire_policy, next_run_at): what each fires and when it runs next.

    Adds fires (instants to enqueue, none unless enabled and due), new_next, and problem. Every row has its
    own expression and zone, parsed and evaluated as columns. A due schedule whose expression or zone is none is
    disabled, fires nothing and keeps its next run; the others go on. Policies are those of ``fires``; where
    no instant is left within five years the next run is a minute after the last.
    """
    at, none = F.col("next_run_at"), F.array().cast("array<timestamp_ntz>")
    due = F.coalesce(F.col("enabled") & (at <= now), F.lit(False))
    keys = ["cron_expr", "timezone", "misfire_policy", "next_run_at"]
    # the work follows different schedules, spread over the cores whatever files they come from
    asked = schedules.where(due).select(*keys).distinct()
    tasks = max(int(schedules.sparkSession.conf.get("spark.sql.shuffle.partitions")), schedules.sparkSession.sparkContext.defaultParallelism)
    found = _ticked(asked.repartition(tasks, *keys), now, grace_seconds, cap)
    found = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("problem", "fires", "new_next").alias("_tick"))
    same = due
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = schedules.join(found, same, "left").withColumns({"problem": F.col("_tick.problem"), "fires": F.coalesce("_tick.fires", none), "new_next": F.coalesce("_tick.new_next", at)})
    return out.withColumn("enabled", F.col("enabled") & F.col("problem").isNull()).drop("_tick", *[f"_{k}" for k in keys])


def _ticked(s: DataFrame, now: Column, grace_seconds: int, cap: int) -> DataFrame:
    """Due schedules with problem, fires and new_next (see ``tick``)."""
    m, at = F.col("_cron"), F.col("next_run_at")
    s = s.withColumn("_cron", cron.masks(F.col("cron_expr")))
    zone_ok = cron.zone_known(s.sparkSession, F.coalesce("timezone", F.lit("UTC")))
    zone = F.when(zone_ok, F.coalesce("timezone", F.lit("UTC"))).otherwise("UTC")
    s = s.withColumn("problem", F.coalesce(m["problem"], F.when(~zone_ok, "unknown time zone")))
    good, policy = F.col("problem").isNull(), F.coalesce("misfire_policy", F.lit(""))

    def one_more(acc: Column, _: Column) -> Column:
        return F.when(acc["next"] <= now, F.struct(F.array_append(acc["fires"], acc["next"]).alias("fires"), cron.next_after(m, zone, acc["next"]).alias("next"))).otherwise(acc)

    none = F.array().cast("array<timestamp_ntz>")
    missed = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, cap))), F.struct(none.alias("fires"), at.alias("next")), one_more)
    fired = F.when(policy == "backfill", missed["fires"]).when((policy == "skip") & (at + seconds(grace_seconds) < now), none).otherwise(F.array(at))
    s = s.withColumn("fires", F.when(good, fired).otherwise(none))
    last = F.element_at("fires", -1)
    after = F.when(policy == "backfill", F.least(last, now)).otherwise(now)
    following = F.coalesce(cron.next_after(m, zone, after), F.greatest(at, F.when(F.size("fires") > 0, last)) + seconds(60))
    return s.withColumn("new_next", F.when(good, following).otherwise(at)).drop("_cron")


def unseen_fires(fires: DataFrame, ledger: DataFrame) -> DataFrame:
    """Insert-ignore: fires whose (schedule_id, fire_at) the ledger lacks."""
    return fires.join(ledger.select("schedule_id", "fire_at"), ["schedule_id", "fire_at"], "left_anti").dropDuplicates(["schedule_id", "fire_at"])


def pending_recovery(fires: DataFrame, schedules: DataFrame, now: Column, age_seconds: int = 120, limit: int | None = 100) -> DataFrame:
    """Fires that stayed pending too long, with their schedules, oldest first; all of them if ``limit`` is None, so that none passes through one task."""
    old = fires.where((F.col("status") == "pending") & (F.col("created_at") <= now - seconds(age_seconds)))
    found = old.join(schedules, "schedule_id").orderBy("created_at", "schedule_id", "fire_at")
    return found if limit is None else found.limit(limit)


def pruned(fires: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The ledger without dispatched fires older than the retention."""
    return fires.where(~((F.col("status") == "dispatched") & (F.col("dispatched_at") < now - F.make_dt_interval(F.lit(days)))))


def staleness(schedules: DataFrame, now: Column, factor: float = 2.0) -> DataFrame:
    """Enabled schedules whose last fire (or next run) lies over factor * interval back."""
    age = epoch(now) - epoch(F.coalesce("last_fire_at", "next_run_at"))
    return schedules.where("enabled").withColumns({"age_seconds": age, "stale": age > F.col("interval_seconds") * factor})


def intervals(instants: DataFrame) -> DataFrame:
    """Seconds from each instant of a schedule to its next one."""
    nxt = F.lead("fire_at").over(Window.partitionBy("id").orderBy("fire_at"))
    return instants.withColumn("interval_seconds", epoch(nxt) - epoch(F.col("fire_at")))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of every key by ``order``: a partial aggregation, so a key with many rows sorts nothing."""
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(best).select("_row.*")


def without(rows: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """Delete by rewriting."""
    return rows.join(deleted.select(*keys).distinct(), keys, "left_anti")


def orphans(workset: DataFrame, live: DataFrame, now: Column, grace_seconds: int = 40, limit: int = 500) -> DataFrame:
    """Aged claims of consumers without a heartbeat, oldest first (exact: filtered before the limit)."""
    aged = workset.where(F.col("claimed_at") <= now - seconds(grace_seconds))
    return aged.join(live.select("consumer_id").distinct(), "consumer_id", "left_anti").orderBy("claimed_at", "job_id").limit(limit)


def live_consumers(heartbeats: DataFrame, now: Column, ttl_seconds: int = 180) -> DataFrame:
    return heartbeats.groupBy("consumer_id").agg(F.max("seen_at").alias("last_seen")).where(F.col("last_seen") >= now - seconds(ttl_seconds))


def claim_outcome(claims: DataFrame, workset: DataFrame, live: DataFrame, now: Column, grace_seconds: int = 40) -> DataFrame:
    """won, resumed, lost or steal for claims(job_id, consumer_id) against the working set."""
    held = workset.select("job_id", F.col("consumer_id").alias("owner"), "claimed_at")
    alive = live.select(F.col("consumer_id").alias("owner"), F.lit(True).alias("alive")).distinct()
    j = claims.join(held, "job_id", "left").join(alive, "owner", "left")
    outcome = (
        F.when(F.col("owner").isNull(), "won").when(F.col("owner") == F.col("consumer_id"), "resumed")
        .when(F.col("alive") | (F.col("claimed_at") > now - seconds(grace_seconds)), "lost").otherwise("steal")
    )
    return j.withColumn("outcome", outcome).drop("alive")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Whether a row is the first of its fingerprint; later ones are skipped in place."""
    return rows.withColumn("claimed", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def stuck(batches: DataFrame) -> DataFrame:
    """Reconciler's decision for running batches(batch_id, status, sealed, total_jobs, touched, completed, failed)."""
    choice = (
        F.when(F.col("status").isNull(), "gone").when(F.col("status") != "running", "not_running").when(~F.col("sealed"), "open").when(F.col("total_jobs") == 0, "empty_success")
        .when(F.col("completed") + F.col("failed") < F.col("total_jobs"), "in_progress").when(F.col("failed") > 0, "finished_complete").otherwise("finished_success")
    )
    return batches.withColumn("decision", choice)


def lost_callbacks(batches: DataFrame, now: Column, interval_seconds: int = 900) -> DataFrame:
    """Refire decision for finished batches whose callback may be lost."""
    recent = F.coalesce(F.col("refired_at") > now - seconds(interval_seconds), F.lit(False))
    return batches.withColumn("decision", F.when(~F.col("status").isin("success", "complete") | F.col("dispatched_at").isNotNull(), "not_lost").when(recent, "skipped_recent").otherwise("refire"))


def reconciler_summary(decisions: DataFrame, order: str, cap: int = 100, details: int = 25) -> DataFrame:
    """Counts per decision, whether the capped list would cut any, and the first ``details`` in order."""
    first = capped(decisions, ["decision"], [order], details).groupBy("decision").agg(F.sort_array(F.collect_list(order)).alias("details"))
    return decisions.groupBy("decision").agg(F.count("*").alias("n")).withColumn("capped", F.col("n") > cap).join(first, "decision")


#: What a reconciler run did with a batch, by its decision.
ACTIONS = {
    "finished_success": "recovered_running", "finished_complete": "recovered_running", "empty_success": "recovered_empty", "gone": "skipped_gone", "not_running": "skipped_not_running",
    "open": "skipped_open", "in_progress": "skipped_in_progress", "refire": "refired_lost", "not_lost": "skipped_not_done", "skipped_recent": "skipped_recent_refire",
}


def run_summary(stale: DataFrame, lost: DataFrame, cap: int = 100, details: int = 25) -> DataFrame:
    """One row about a reconciler run over stale and lost batches(batch_id, decision, status, total_jobs, failed).

    The first ``cap`` of either kind by batch_id are processed; ``details`` are the first of those,
    stale ones before lost ones. Other decisions than those known (produce_failed) are their own action.
    """
    action = F.coalesce(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("decision")], F.col("decision"))
    detail = F.struct("kind", "batch_id", action.alias("action"), F.col("status").alias("outcome"), "total_jobs", F.col("failed").alias("failed_count"))
    none = F.lit(None)
    lines = None
    for kind, rows in enumerate((stale, lost)):  # counts come partially aggregated, rows already cut
        found = rows.agg(F.count("*").alias("found")).select(F.lit(kind).alias("kind"), "found", none.cast("string").alias("decision"), none.cast("bigint").alias("batch_id"), none.cast("string").alias("status"), none.cast("bigint").alias("total_jobs"), none.cast("bigint").alias("failed"))
        taken = rows.orderBy("batch_id").limit(cap).select(F.lit(kind).alias("kind"), F.lit(0).cast("bigint").alias("found"), "decision", "batch_id", "status", F.col("total_jobs").cast("bigint").alias("total_jobs"), F.col("failed").cast("bigint").alias("failed"))
        lines = found.unionByName(taken) if lines is None else lines.unionByName(found).unionByName(taken)
    of = lambda *actions: F.count_if(F.col("action").isin(*actions))
    lines = lines.withColumn("detail", F.when(F.col("decision").isNotNull(), detail)).withColumn("action", F.col("detail.action"))
    out = lines.agg(
        F.sum(F.when(F.col("kind") == 0, F.col("found"))).alias("found_stale"), F.sum(F.when(F.col("kind") == 1, F.col("found"))).alias("found_lost"),
        F.count_if((F.col("kind") == 0) & F.col("action").isNotNull()).alias("processed_stale"), F.count_if((F.col("kind") == 1) & F.col("action").isNotNull()).alias("processed_lost"),
        of("recovered_running", "recovered_empty").alias("recovered_stale"), of("skipped_open", "skipped_in_progress").alias("skipped_stale"), of("refired_lost").alias("refired_lost"),
        of("skipped_recent_refire").alias("skipped_recent"), of("produce_failed").alias("produce_failed"), F.slice(F.sort_array(F.collect_list("detail")), 1, details).alias("details"),
    )
    return out.withColumns({"capped_stale": F.col("found_stale") > F.col("processed_stale"), "capped_lost": F.col("found_lost") > F.col("processed_lost")})


def capped(rows: DataFrame, by: list[str], order: list[str], cap: int = 100) -> DataFrame:
    """At most ``cap`` rows of each kind, in order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= cap)

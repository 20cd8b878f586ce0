"""Classifiers and routes over job messages: ordered CASE chains and lookups.

Lookups are plain joins: the planner broadcasts sides by their size, known or measured, and shuffles others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch, from_epoch, rfc3339

DEFAULT_RETRIES, MAX_PAUSE = 7, 30
TIERS = {"short": 30, "medium": 420, "large": 1200}
NON_RETRYABLE = ("UnknownHandler", "Overloaded")
#: Seconds since 1970 of the first and last moment that a timestamp shows with a year of four digits.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def expired_at(valid_till: Column, parsed: Column, now: Column) -> Column:
    """Empty is not expired; text that is no RFC 3339 time is; else at or before now."""
    blank = F.coalesce(F.trim(valid_till), F.lit("")) == ""
    return F.when(blank, False).when(parsed.isNull(), True).otherwise(parsed <= now)


def expired(valid_till: Column, now: Column) -> Column:
    return expired_at(valid_till, rfc3339(F.trim(valid_till)), now)


def normalized_valid_till(valid_till: Column) -> Column:
    text = rfc3339(F.trim(valid_till)).cast("string")
    return F.coalesce(F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("Z")), F.lit(""))


def with_handler(jobs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Jobs with their handler's columns."""
    return jobs.join(manifest, "job_type", "left")


def decide(jobs: DataFrame, manifest: DataFrame, cancelled: DataFrame, skipped: DataFrame, now: Column) -> DataFrame:
    """Job decision, first match wins: malformed, cancelled, retry_cancelled, expired, unknown, run."""
    j = with_handler(jobs, manifest).withColumn("_valid", rfc3339(F.trim("valid_till")))  # parsed once
    j = j.join(cancelled.select("batch_id", F.lit(True).alias("is_cancelled")).distinct(), "batch_id", "left")
    j = j.join(skipped.select("job_id", F.lit(True).alias("is_skipped")).distinct(), "job_id", "left")
    choice = (
        F.when(F.col("malformed"), "dlt_malformed").when(F.col("is_cancelled"), "drop_cancelled").when(F.col("is_skipped"), "failed_retry_cancelled")
        .when(expired_at(F.col("valid_till"), F.col("_valid"), now), "dlt_expired").when(F.col("runtime").isNull() | (F.col("runtime") == "ruby"), "dlt_unknown_handler")
        .when(F.col("ok"), "run_success").otherwise("run_failure")
    )
    return j.withColumn("decision", choice).drop("is_cancelled", "is_skipped", "_valid")


def most_retries(max_retries: Column) -> Column:
    return F.when(F.coalesce(max_retries, F.lit(0)) > 0, max_retries).otherwise(DEFAULT_RETRIES)


def on_failure(failed: DataFrame) -> DataFrame:
    """Retry, terminal failure or dead letter, and whether an executed or failed event is emitted."""
    fatal = F.coalesce(F.col("error_class").isin(*NON_RETRYABLE), F.lit(False))
    retry = ~fatal & (F.col("attempt") < most_retries(F.col("max_retries")))
    batched = F.col("batch_id").isNotNull() & F.col("batch_seq").isNotNull()  # an event needs both
    event = F.when(~batched, None).when(retry, F.when(~F.col("batch_counted"), "executed")).otherwise("failed")
    return failed.withColumns({
        "action": F.when(fatal, "dead_letter_fatal").when(retry, "retry").otherwise("dead_letter_exhausted"),
        "event": event, "exhausted": ~fatal & ~retry, "error_name": F.coalesce("error_class", F.lit("GoExecutionError")),
    })


def retry_tier(tier: Column, attempt: Column) -> Column:
    """The handler's tier if known, else short, medium, large by attempt."""
    steps = F.array(*[F.lit(t) for t in TIERS])
    return F.when(tier.isin(*TIERS), tier).otherwise(F.element_at(steps, F.least(F.greatest(attempt, F.lit(1)), F.lit(len(TIERS))).cast("int")))


def retry_delay(tier: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair])
    return F.coalesce(F.try_element_at(named, tier), F.lit(TIERS["short"]))


def retry_plan(failed: DataFrame, now: Column) -> DataFrame:
    """Rewritten retry messages: next attempt, tier, due time and target; slot columns are dropped."""
    out = failed.withColumn("next_attempt", F.col("attempt") + 1)
    out = out.withColumn("tier", retry_tier(F.col("retry_tier"), F.col("next_attempt")))
    return out.withColumn("retry_after", now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), retry_delay(F.col("tier")))).withColumn("retry_to", F.col("topic")).drop("_fair_slot", "_fair_type", "_fair_slot_id")


def retry_due(messages: DataFrame, now: Column) -> DataFrame:
    """Decision for messages(malformed, cancelled, retry_to, valid_till, retry_after text)."""
    due = rfc3339(F.col("retry_after"))
    wait = F.least(epoch(due) - epoch(now), F.lit(MAX_PAUSE))
    choice = (
        F.when(F.col("malformed"), "dlt").when(F.col("cancelled"), "failed").when(F.coalesce("retry_to", F.lit("")) == "", "dlt_failed")
        .when(expired(F.col("valid_till"), now), "dlt_expired").when(due > now, "wait").otherwise("dispatch")
    )
    return messages.withColumns({"decision": choice, "wait_seconds": F.when(choice == "wait", wait).otherwise(0).cast("bigint")})


def expired_drop(jobs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dead letters, failed events, failure rows) of expired jobs."""
    gone = jobs.where(expired(F.col("valid_till"), now))
    letters = gone.withColumns({"dlt_type": F.lit("expired"), "dlt_error_class": F.lit("JobExpired")})
    events = gone.where("batch_id is not null and batch_seq > 0").select("batch_id", "job_id", "batch_seq", F.lit("failed").alias("op"))
    return letters, events, gone.select("batch_id", "job_id", "attempt", F.lit("expired").alias("status"))


def tenant(tenant_id: Column, batch_id: Column, job_id: Column) -> Column:
    filled = lambda c: F.when(F.trim(c.cast("string")) != "", c.cast("string"))
    return F.coalesce(filled(tenant_id), filled(batch_id), filled(job_id), F.lit("default"))


def route(jobs: DataFrame, manifest: DataFrame, assigned: DataFrame | None = None, default_topic: str = "jobs") -> DataFrame:
    """Target topic, key and partition.

    A fair lane goes to its ingest topic (an unknown lane to the default topic), keyed by tenant,
    else batch, else job; a tenant that is given and assigned to a partition goes there without a
    key. Other jobs go to their handler's topic, keyed by job.
    """
    j = with_handler(jobs, manifest)
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    if assigned is not None:
        j = j.join(assigned.select(F.col("tenant_key").alias("tenant_id"), "assigned_partition"), "tenant_id", "left")
    else:
        j = j.withColumn("assigned_partition", F.lit(None).cast("int"))
    lane, default = F.coalesce(F.col("fairness_type"), F.lit("")), F.lit(default_topic)
    fair, there = lane != "", F.when(filled("tenant_id").isNotNull(), F.col("assigned_partition"))
    topic = F.when(lane.isin("time", "throughput"), F.concat(F.lit("fair-"), lane, F.lit("-ingest"))).when(fair, default).otherwise(F.coalesce(F.nullif(F.col("topic"), F.lit("")), default))
    key = F.when(fair & there.isNotNull(), "").when(fair, F.coalesce(filled("tenant_id"), filled("batch_id"), F.col("job_id"))).otherwise(F.col("job_id"))
    return j.withColumns({"to_topic": topic, "to_key": key, "to_partition": F.when(fair, there)})


def job_type_of(messages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Resolve job_type directly, else by worker_class."""
    direct = manifest.select("job_type", F.col("job_type").alias("direct"))
    by_class = manifest.groupBy("worker_class").agg(F.min("job_type").alias("by_class"))
    return messages.join(direct, "job_type", "left").join(by_class, "worker_class", "left").withColumn("resolved", F.coalesce("direct", "by_class")).drop("direct", "by_class")


def envelope(jobs: DataFrame, manifest: DataFrame, client_retries: int = 0) -> DataFrame:
    """Job envelopes as the client builds them."""
    return with_handler(jobs, manifest).select(*envelope_columns(client_retries))


def envelope_columns(client_retries: int = 0) -> list:
    """Envelope of jobs that have their handler's columns."""
    known = F.coalesce(F.nullif(F.col("worker_class"), F.lit("")), F.concat(F.lit("go:"), F.col("job_type")))
    return [
        "job_id", "batch_id", "job_type", known.alias("worker_class"), F.lit(0).alias("attempt"),
        F.when(F.coalesce("max_retries", F.lit(0)) > 0, F.col("max_retries")).when(F.lit(client_retries) > 0, client_retries).otherwise(DEFAULT_RETRIES).cast("int").alias("max_retries"),
        F.coalesce("retry_tier", F.lit("")).alias("retry_tier"), normalized_valid_till(F.col("valid_till")).alias("valid_till"),
    ]


def run_at_of(text: Column, now: Column) -> Column:
    """A time given as text: RFC 3339 or whole seconds since 1970; anything else is now.

    Any 64-bit number counts; those beyond the years 1 to 9999 are held at their ends, which ``clamp_run_at`` cuts anyway.
    """
    number = F.when(F.regexp_like(text, F.lit(r"^[+-]?\d+$")), text).try_cast("bigint")
    held = F.when(number.isNotNull(), F.greatest(F.lit(FIRST_SECOND), F.least(number, F.lit(LAST_SECOND))))
    return F.coalesce(rfc3339(text), from_epoch(held), now)


def run_at_after(seconds: Column, now: Column) -> Column:
    """A time given as a duration."""
    return now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def clamp_run_at(run_at: Column, now: Column, horizon_days: int = 30) -> Column:
    return F.greatest(now, F.least(F.coalesce(run_at, now), now + F.make_dt_interval(F.lit(horizon_days))))


def stamped(messages: DataFrame) -> DataFrame:
    """Source coordinates kept where present, else taken from the record's own."""
    return messages.withColumns({f"_src_{c}": F.coalesce(f"_src_{c}", c) for c in ("topic", "partition", "offset")})


def mark_slot(messages: DataFrame, lane: Column, slot: Column) -> DataFrame:
    return messages.withColumns({"_fair_slot": F.lit(True), "_fair_type": lane, "_fair_slot_id": slot, "tenant_id": F.coalesce("tenant_id", F.lit("default"))})


def prefixed(topic: Column, prefix: str) -> Column:
    return F.when(topic.startswith(prefix), topic).otherwise(F.concat(F.lit(prefix), topic))


def fair_skip(jobs: DataFrame, leases: DataFrame, now: Column, grace: int = 5) -> DataFrame:
    """Already counted: drop; lease live: defer past its end; else run again."""
    j = jobs.join(leases.select("job_id", "lease_until"), "job_id", "left")
    live = F.coalesce(F.col("lease_until") > now, F.lit(False))
    return j.withColumns({
        "decision": F.when(F.col("batch_counted"), "drop").when(live, "defer").otherwise("rerun"),
        "defer_until": F.when(~F.col("batch_counted") & live, F.col("lease_until") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(grace))),
    })


def backoff(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt))


def linear_backoff(attempt: Column, base: float, cap: float = float("inf")) -> Column:
    return F.least(F.lit(float(cap)), F.lit(float(base)) * attempt)


def jittered(delay: Column, share: float, seed: int | None = None) -> Column:
    """A delay within ``share`` of itself, drawn anew for every row."""
    return delay * (1 + (F.rand(seed) * 2 - 1) * share) if share > 0 else delay


def callback_target(callbacks: DataFrame) -> DataFrame:
    """callbacks(outcome, on_success, on_complete) with method, class_name and claim kind."""
    good = F.col("outcome").isin("success", "success_only")
    named = good & (F.coalesce("on_success", F.lit("")) != "")
    return callbacks.withColumns({
        "method": F.when(named, "on_success").otherwise("on_complete"), "class_name": F.when(named, F.col("on_success")).otherwise(F.col("on_complete")),
        "claim_kind": F.when(good, "success").otherwise("complete"),
    })


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(problem, name): handlers without a runtime, plain topics of several runtimes."""
    blank = manifest.where("coalesce(trim(runtime), '') = ''").select(F.lit("no_runtime").alias("problem"), F.col("job_type").alias("name"))
    return blank.unionByName(topic_conflicts(manifest).select(F.lit("several_runtimes").alias("problem"), F.col("topic").alias("name")))


def topic_conflicts(manifest: DataFrame) -> DataFrame:
    """Plain topics claimed by more than one runtime."""
    plain = manifest.where("coalesce(fairness_type, '') = ''")
    return plain.groupBy("topic").agg(F.count_distinct("runtime").alias("runtimes")).where("runtimes > 1")

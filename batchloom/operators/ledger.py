"""Batch ledger: the order-sensitive fold of completion events into counters, status and callbacks.

Events reduce map-side to their firsts per (batch, seq), and these to counters per batch. Most
batches end with the last event of a counter, a maximum; only batches whose counters go on beyond
their total order the events that count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = ("success", "failed", "executed")


def normalized(events: DataFrame) -> DataFrame:
    """Valid completion events: a batch, a positive sequence, an unknown operation counted as failed."""
    return events.where("batch_id is not null and batch_seq >= 1").withColumn("op", F.when(F.col("op").isin(*OPS), F.col("op")).otherwise("failed"))


def firsts(events: DataFrame) -> DataFrame:
    """Per (batch, sequence): events, touched_at, good_at and bad_at (arrivals of the events that count).

    events(batch_id, batch_seq, op, arrival): the arrival column, unique in its batch, orders the
    events. A sequence is touched by its first event, good by its first success and bad by its
    first failure unless a success came before.
    """
    first = lambda op: F.min(F.when(F.col("op") == op, F.col("arrival")))
    f = normalized(events).groupBy("batch_id", "batch_seq").agg(F.count("*").alias("events"), F.min("arrival").alias("touched_at"), first("success").alias("good_at"), first("failed").alias("failed_at"))
    return f.withColumn("bad_at", F.when(F.col("good_at").isNull() | (F.col("failed_at") < F.col("good_at")), F.col("failed_at"))).drop("failed_at")


def marks(f: DataFrame) -> DataFrame:
    """The events that count of ``firsts``, with what they count as: batch_id, batch_seq, arrival, touch, good, bad."""

    def mark(at: str) -> Column:
        same = lambda other: F.coalesce(F.col(at) == F.col(other), F.lit(False)).cast("bigint")
        return F.struct(F.col(at).alias("arrival"), same("touched_at").alias("touch"), same("good_at").alias("good"), same("bad_at").alias("bad"))

    each = F.array(mark("touched_at"), F.when(F.col("good_at") != F.col("touched_at"), mark("good_at")), F.when(F.col("bad_at") != F.col("touched_at"), mark("bad_at")))
    return f.select("batch_id", "batch_seq", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("m")).select("batch_id", "batch_seq", "m.*")


def running(f: DataFrame) -> DataFrame:
    """The events that count of ``firsts`` with their batch's counters after them."""
    order = Window.partitionBy("batch_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    return marks(f).withColumns({"touched": F.sum("touch").over(order), "completed": F.sum("good").over(order), "failed": F.sum("bad").over(order)})


def _conditions() -> tuple[Column, Column, Column, Column]:
    """(batch is counted for outcomes, all good, all good or bad, all touched)."""
    total = F.col("total_jobs")
    live = F.coalesce(F.col("sealed"), F.lit(False)) & (total >= 1) & (F.col("status") != "cancelled")
    full = F.col("completed") >= total
    return live, full, full | (F.col("completed") + F.col("failed") >= total), F.col("touched") >= total


def fold(events: DataFrame, batches: DataFrame) -> DataFrame:
    """One row per batch of ``batches(batch_id, total_jobs, sealed, status)``: counters, sticky status, callback claims.

    A cancelled batch counts nothing: all its events are duplicates. An unsealed batch, or one
    without jobs, counts but gets neither status nor callbacks (sealing judges it, see ``seal``).
    Otherwise the first event that ends a running batch makes it a success (all good) or complete,
    for good. complete_at and success_at are the arrivals of the events that claim the two
    callbacks; a batch that is complete or a success from the start has claimed its own before.
    """
    b = batches.select("batch_id", F.coalesce("total_jobs", F.lit(0)).cast("bigint").alias("total_jobs"), "sealed", F.coalesce("status", F.lit("running")).alias("status"))
    live, full, over, early = _conditions()
    f = firsts(events)
    apart = lambda c: F.coalesce(F.col(c) != F.col("touched_at"), F.lit(False)).cast("bigint")
    counts = f.groupBy("batch_id").agg(
        F.count("*").alias("touched"), F.count("good_at").alias("completed"), F.count("bad_at").alias("failed"), F.sum("events").alias("events"), F.sum(1 + apart("good_at") + apart("bad_at")).alias("marks"),
        F.max("touched_at").alias("last_touch"), F.max("good_at").alias("last_good"), F.greatest(F.max("good_at"), F.max("bad_at")).alias("last_end"),
    )
    total, ended_jobs = F.col("total_jobs"), F.col("completed") + F.col("failed")
    # a counter that stops at its threshold reaches it with its last event; only those that go on need an order
    counted = b.join(counts, "batch_id", "left").withColumn("further", F.coalesce(live & ((F.col("touched") > total) | (ended_jobs > total)), F.lit(False)))
    at = lambda cond: F.min(F.when(cond, F.col("arrival")))
    further = counted.where("further").select("batch_id", "total_jobs", "sealed", "status")
    ordered = running(f.join(further.select("batch_id"), "batch_id", "left_semi")).join(further, "batch_id").groupBy("batch_id").agg(at(full).alias("full_in"), at(over).alias("over_in"), at(over | early).alias("claim_in"))
    end_at = F.when(live & (ended_jobs == total), F.col("last_end"))
    out = counted.join(ordered, "batch_id", "left").withColumns({
        "full_at": F.when(F.col("further"), F.col("full_in")).otherwise(F.when(live & full, F.col("last_good"))),
        "over_at": F.when(F.col("further"), F.col("over_in")).otherwise(end_at),
        "claim_at": F.when(F.col("further"), F.col("claim_in")).otherwise(F.least(end_at, F.when(live & early, F.col("last_touch")))),
    })
    kept = F.col("status") != "cancelled"
    counter = lambda c: F.when(kept, F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
    ended = F.when(F.col("full_at") == F.col("over_at"), "success").otherwise("complete")
    return out.select(
        "batch_id", "total_jobs", "sealed", counter("touched"), counter("completed"), counter("failed"),
        (F.coalesce("events", F.lit(0)) - F.when(kept, F.coalesce("marks", F.lit(0))).otherwise(0)).cast("bigint").alias("duplicates"),
        F.when((F.col("status") == "running") & F.col("over_at").isNotNull(), ended).otherwise(F.col("status")).alias("status"),
        F.when(F.col("status") == "running", F.col("claim_at")).alias("complete_at"), F.when(F.col("status") != "success", F.col("full_at")).alias("success_at"),
    )


def callbacks(ledger: DataFrame) -> DataFrame:
    """One row per claimed callback: the complete callback once, the success callback once."""
    claim = lambda kind: F.when(F.col(f"{kind}_at").isNotNull(), F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_at").alias("at")))
    return ledger.select("batch_id", F.explode(F.filter(F.array(claim("complete"), claim("success")), lambda x: x.isNotNull())).alias("c")).select("batch_id", "c.kind", "c.at")


def dropped(events: DataFrame, batches: DataFrame) -> DataFrame:
    """Events that no ledger row takes, with the reason, checked in order."""
    b = batches.select("batch_id", F.col("status").alias("batch_status"))
    reason = (
        F.when(F.col("batch_id").isNull() | F.col("batch_seq").isNull() | (F.col("batch_seq") < 1), "invalid")
        .when(F.col("batch_status").isNull(), "not_found").when(F.col("batch_status") == "cancelled", "duplicate")
    )
    return events.join(b, "batch_id", "left").withColumn("reason", reason).where("reason is not null").drop("batch_status")


def return_codes(events: DataFrame, batches: DataFrame) -> DataFrame:
    """``events`` with the result code of each: 0 invalid, not found or duplicate, 1 terminal or success, 2 continue, 3 early complete.

    Agrees with ``fold`` event by event over the same ``batches``.
    """
    b = batches.select("batch_id", F.coalesce("total_jobs", F.lit(0)).cast("bigint").alias("total_jobs"), "sealed", F.coalesce("status", F.lit("running")).alias("status"))
    m = running(firsts(events)).join(b, "batch_id")
    before = Window.partitionBy("batch_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    live, full, over, early = _conditions()
    had = lambda cond, statuses: F.coalesce(F.max(cond.cast("int")).over(before), F.lit(0)).astype("boolean") | F.col("status").isin(*statuses)
    complete, success = (over | early) & ~had(over | early, ("complete", "success")), full & ~had(full, ("success",))
    code = F.when(F.col("status") == "cancelled", 0).when(~live, 2).when(success | (complete & over), 1).when(complete, 3).otherwise(2)
    m = m.select("batch_id", "batch_seq", "arrival", code.alias("code"))
    return events.join(m, ["batch_id", "batch_seq", "arrival"], "left").withColumn("code", F.coalesce("code", F.lit(0)).cast("int"))


def seal(batches: DataFrame) -> DataFrame:
    """Outcome of sealing batches(batch_id, status, total_jobs, touched, completed, failed), and the callbacks it claims.

    Only a running batch is judged; an empty one succeeds at once. ``outcome`` is success, complete,
    early_complete (still running) or sealed.
    """
    total = F.col("total_jobs")
    outcome = (
        F.when(F.coalesce(F.col("status"), F.lit("running")) != "running", "sealed").when((total == 0) | (F.col("completed") >= total), "success")
        .when(F.col("completed") + F.col("failed") >= total, "complete").when(F.col("touched") >= total, "early_complete").otherwise("sealed")
    )
    claims = F.when(F.col("outcome") == "success", F.array(F.lit("complete"), F.lit("success"))).when(F.col("outcome").isin("complete", "early_complete"), F.array(F.lit("complete"))).otherwise(F.array().cast("array<string>"))
    return batches.withColumn("outcome", outcome).withColumn("claims", claims)


def sequence(jobs: DataFrame, order: list[str]) -> DataFrame:
    """Contiguous batch_seq from 1 per batch in ``order``."""
    return jobs.withColumn("assigned_seq", F.row_number().over(Window.partitionBy("batch_id").orderBy(*order)).cast("bigint"))

"""Bucketed throughput and latency, alert rules with hysteresis, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch


def bucket(ts: Column, secs: int) -> Column:
    """Start of the tumbling bucket of a timestamp without zone, as epoch seconds."""
    return (F.floor(epoch(ts) / secs) * secs).cast("bigint")


def throughput(events: DataFrame, secs: int = 60) -> DataFrame:
    """events(ts, status, field, n): sums per (bucket, status, field) and per (bucket, status) as _all."""
    b = events.select(bucket(F.col("ts"), secs).alias("bucket"), "status", "field", "n")
    fine = b.groupBy("bucket", "status", "field").agg(F.sum("n").alias("n"))
    # the totals sum the fine rows, so events are read and shuffled once
    return fine.groupingSets([["bucket", "status", "field"], ["bucket", "status"]], "bucket", "status", "field").agg(F.sum("n").alias("n")).withColumn("field", F.coalesce("field", F.lit("_all")))


def named_field(events: DataFrame) -> DataFrame:
    """Field names trimmed, cut to 200 characters, and empty ones as _all."""
    name = F.substring(F.trim("field"), 1, 200)
    return events.withColumn("field", F.when(F.coalesce(name, F.lit("")) == "", "_all").otherwise(name))


def first_seen(named: DataFrame, known: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` names of ``named_field`` rows(field, ts, event_id) that are not ``known``."""
    fresh = named.where("field != '_all'").join(known.select("field"), "field", "left_anti")
    return fresh.groupBy("field").agg(F.min(F.struct("ts", "event_id")).alias("first")).orderBy("first").limit(cap).select("field")


def others(named: DataFrame, known: DataFrame) -> DataFrame:
    """Names that are not ``known`` (a bounded list) as _other."""
    known = F.broadcast(known.select("field", F.lit(True).alias("known")))  # at most cap rows
    return named.join(known, "field", "left").withColumn("field", F.when(F.col("known") | (F.col("field") == "_all"), F.col("field")).otherwise("_other")).drop("known")


def capped_field(events: DataFrame, cap: int = 50) -> DataFrame:
    """``events`` with their names, those beyond the first ``cap`` seen as _other."""
    e = named_field(events)
    return others(e, first_seen(e, e.select("field").limit(0), cap))


def rtt(probes: DataFrame, secs: int = 60) -> DataFrame:
    """probes(ts, micros, error): count, sum, max, errors and the average in ms per bucket."""
    ok = F.when(~F.col("error"), F.col("micros"))
    return probes.groupBy(bucket(F.col("ts"), secs).alias("bucket")).agg(
        F.count(ok).alias("probes"), F.coalesce(F.sum(ok), F.lit(0)).alias("sum_us"), F.coalesce(F.max(ok), F.lit(0)).alias("max_us"), F.count_if(F.col("error")).alias("errors")
    ).withColumn("avg_ms", F.when(F.col("probes") > 0, F.col("sum_us") / F.col("probes") / 1000).otherwise(0.0))


def finding(rule: str, severity: str, key: Column | None = None) -> list[Column]:
    """Rule, severity and fingerprint: the rule alone, or with the key of what it found."""
    return [F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), (F.lit(rule) if key is None else F.concat(F.lit(rule + ":"), key)).alias("fingerprint")]


def lag_stuck(current: DataFrame, baseline: DataFrame, paused: DataFrame, least: int = 1000, growth: int = 100) -> DataFrame:
    """Lag over the limit, nothing committed since the baseline, and still growing; paused(group, topic) excepted."""
    old = baseline.select("group", "topic", F.col("lag").alias("old_lag"), F.col("committed").alias("old_committed"), F.col("end_sum").alias("old_end"))
    c = current.join(paused.select("group", "topic").distinct(), ["group", "topic"], "left_anti").join(old, ["group", "topic"])
    grows = (F.col("lag") - F.col("old_lag") >= growth) | (F.col("end_sum") > F.col("old_end"))
    return c.where((F.col("lag") >= least) & (F.col("committed") == F.col("old_committed")) & grows).select(*finding("lag_stuck_growing", "critical", F.concat_ws(":", "group", "topic")))


def current_or_previous(buckets: DataFrame, now: Column, secs: int = 60) -> DataFrame:
    """The row of the bucket that holds ``now``, else of the one before."""
    here = bucket(now, secs)
    return buckets.where((F.col("bucket") == here) | (F.col("bucket") == here - secs)).orderBy(F.col("bucket").desc()).limit(1)


def rtt_high(rtts: DataFrame, avg_ms: float = 50, max_ms: float = 200, error_share: float = 0.25, keep: tuple[str, ...] = ()) -> DataFrame:
    """A finding for every row (one, of the current bucket, in a tick) that is over a limit, with the ``keep`` columns."""
    bad = (F.col("avg_ms") >= avg_ms) | (F.col("max_us") / 1000 >= max_ms) | ((F.col("probes") > 0) & (F.col("errors") / F.greatest(F.col("probes"), F.lit(1)) >= error_share))
    return rtts.where(bad).select(*keep, *finding("redis_rtt_high", "warning"))


def no_live(pending: DataFrame, live: DataFrame) -> DataFrame:
    both = pending.agg(F.count("*").alias("pending")).crossJoin(live.agg(F.count("*").alias("live")))  # one row each
    return both.where("pending > 0 and live = 0").select(*finding("no_live_consumers", "critical"))


def reconciler_stale(runs: DataFrame, now: Column, most_age: int = 900, most_stale: int = 10) -> DataFrame:
    """runs(last_run, produce_failed, found_stale), one row or none: no run at all, an old one, a bad one."""
    age = epoch(now) - epoch(F.col("last_run"))
    missing = runs.agg(F.count("*").alias("n")).where("n = 0").select(*finding("reconciler_stale", "warning", F.lit("missing")))
    old = runs.where(age > most_age).select(*finding("reconciler_stale", "warning", F.lit("age")))
    bad = runs.where((F.col("produce_failed") > 0) | (F.col("found_stale") >= most_stale)).select(*finding("reconciler_stale", "warning", F.lit("failures")))
    return missing.unionByName(old).unionByName(bad)


def lane_backed_up(lanes: DataFrame, ingest: int = 5000, ready: int = 10) -> DataFrame:
    return lanes.where((F.col("ingest") >= ingest) & (F.col("ready") <= ready)).select(*finding("fairness_ingest_backed_up", "warning", F.col("lane")))


def over(counts: DataFrame, column: str, limit: int, rule: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A finding for every row (one in a tick) whose count reaches the limit, with the ``keep`` columns."""
    return counts.where(F.col(column) >= limit).select(*keep, *finding(rule, "warning"))


def cron_stale(stale: DataFrame) -> DataFrame:
    return stale.where("stale").select(*finding("cron_stale", "warning", F.col("id").cast("string")))


def hysteresis(findings: DataFrame, last_tick: int, open_after: int = 3, close_after: int = 2) -> DataFrame:
    """Open and resolve transitions per fingerprint; ticks are numbered without gaps up to ``last_tick``.

    Opening needs ``open_after`` breaches in total since the last resolve (healthy ticks do not
    reset them); resolving needs ``close_after`` healthy ticks in a row. Only breaches are
    gathered: the healthy ticks between two of them are their distance, so a fingerprint costs an
    array of its breaches, folded JVM-side.
    """
    per = findings.groupBy("fingerprint").agg(F.sort_array(F.collect_set(F.col("tick").cast("bigint"))).alias("ticks"))
    none = F.array().cast("array<struct<tick:bigint,change:string>>")
    zero = F.struct(F.lit(0).alias("bad"), F.lit(0).cast("bigint").alias("last"), F.lit(False).alias("open"), none.alias("out"))
    noted = lambda out, tick, change: F.concat(out, F.array(F.struct(tick.cast("bigint").alias("tick"), F.lit(change).alias("change"))))

    def closed(s: Column, upto: Column) -> Column:
        """State after the healthy ticks between the last breach and ``upto`` (exclusive)."""
        closes = s["open"] & (upto - s["last"] - 1 >= close_after)
        out = F.when(closes, noted(s["out"], s["last"] + close_after, "resolved")).otherwise(s["out"])
        return F.struct(F.when(closes, 0).otherwise(s["bad"]).alias("bad"), s["last"].alias("last"), (s["open"] & ~closes).alias("open"), out.alias("out"))

    def breach(s: Column, tick: Column) -> Column:
        c = closed(s, tick)
        opens = ~c["open"] & (c["bad"] + 1 >= open_after)
        return F.struct((c["bad"] + 1).alias("bad"), tick.alias("last"), (c["open"] | opens).alias("open"), F.when(opens, noted(c["out"], tick, "opened")).otherwise(c["out"]).alias("out"))

    folded = F.aggregate("ticks", zero, breach, lambda s: closed(s, F.lit(last_tick + 1))["out"])
    return per.select("fingerprint", F.explode(folded).alias("t")).select("fingerprint", "t.tick", "t.change")


def incident_diff(findings: DataFrame, incidents: DataFrame) -> DataFrame:
    """new, ongoing or cleared per fingerprint."""
    f, i = findings.select("fingerprint").distinct().withColumn("f", F.lit(True)), incidents.select("fingerprint").distinct().withColumn("i", F.lit(True))
    return f.join(i, "fingerprint", "full").withColumn("state", F.when(F.col("i").isNull(), "new").when(F.col("f").isNull(), "cleared").otherwise("ongoing")).drop("f", "i")


def stale_members(ticks: DataFrame, now: Column, most_age: int = 60, registered: DataFrame | None = None, grace: int = 45) -> DataFrame:
    """Loops or groups whose last tick is missing or too old. ticks(name, ts), registered(name, registered_at).

    A member that never ticked is healthy within ``grace`` seconds of its registration.
    """
    last = ticks.groupBy("name").agg(F.max("ts").alias("last_tick"))
    fresh = F.coalesce(epoch(now) - epoch(F.col("last_tick")) <= most_age, F.lit(False))
    if registered is None:
        return last.withColumn("healthy", fresh)
    out = last.join(registered.groupBy("name").agg(F.max("registered_at").alias("registered_at")), "name", "full")
    young = F.coalesce(epoch(now) - epoch(F.col("registered_at")) <= grace, F.lit(False))
    return out.withColumn("healthy", F.when(F.col("last_tick").isNull(), young).otherwise(fresh)).drop("registered_at")


def cpu_percent(samples: DataFrame) -> DataFrame:
    """samples(name, ts, cpu_seconds): percent of wall time since the previous sample, to 0.1; other columns (memory) stay.

    Null at the first sample, without wall time, and where the counter fell (a process that restarted).
    """
    w = Window.partitionBy("name").orderBy("ts")
    at = epoch(F.col("ts")) + F.date_format("ts", "SSSSSS").cast("bigint") / 1e6
    wall = F.round(at - F.lag(at).over(w), 6)
    used = F.col("cpu_seconds") - F.lag("cpu_seconds").over(w)
    return samples.withColumn("cpu_pct", F.when((wall > 0) & (used >= 0), F.round(used / wall * 100, 1)))

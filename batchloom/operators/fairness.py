"""Weighted fair queueing over tenants, caps, partition assignment and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def weighted(rows: DataFrame, weights: DataFrame, default: float = 1.0) -> DataFrame:
    """Rows with their tenant's weight; a missing or non-positive weight is the default."""
    w = weights.select("tenant_id", F.col("weight").alias("given"))
    return rows.join(w, "tenant_id", "left").withColumn("weight", F.when(F.col("given") > 0, F.col("given")).otherwise(default)).drop("given")


def throughput_order(queue: DataFrame) -> DataFrame:
    """Virtual start of every job in a static backlog: (place in its tenant - 1) / weight.

    queue(lane, tenant_id, pos, weight). Sorting by (vtime, tenant_id) is the checkout order; the
    order itself needs no shuffle beyond the tenant's.
    """
    place = F.row_number().over(Window.partitionBy("lane", "tenant_id").orderBy("pos"))
    return queue.withColumn("vtime", (place - 1) / F.col("weight"))


def time_order(queue: DataFrame) -> DataFrame:
    """Virtual start when finished work counts: summed duration / weight of the tenant's earlier jobs."""
    before = Window.partitionBy("lane", "tenant_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return queue.withColumn("vtime", F.coalesce(F.sum(F.col("duration") / F.col("weight")).over(before), F.lit(0.0)))


def checkout(ordered: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` jobs of every lane in fair order."""
    rank = F.row_number().over(Window.partitionBy("lane").orderBy("vtime", "tenant_id", "pos"))
    return ordered.withColumn("turn", rank).where(F.col("turn") <= limit)


def queue_cap(queue: DataFrame, window: int = 100) -> DataFrame:
    """Accepted arrivals: the first ``window`` waiting jobs per tenant."""
    return queue.withColumn("accepted", F.row_number().over(Window.partitionBy("lane", "tenant_id").orderBy("pos")) <= window)


def candidates(ring: DataFrame, budget: int) -> DataFrame:
    """The tenants of every lane that a checkout looks at: the first max(60, 3 * budget) by vtime."""
    rank = F.row_number().over(Window.partitionBy("lane").orderBy("vtime", "tenant_id"))
    return ring.withColumn("place", rank).where(F.col("place") <= max(60, 3 * budget))


def inflight_caps(tenants: DataFrame, budget: int | Column, hard_cap: int | None = None) -> DataFrame:
    """Per-tenant shares of a lane's budget: weighted floor and equal ceiling, at least 1 each.

    tenants(lane, tenant_id, weight) with one row per active tenant. ``budget`` may use the lane's
    ``active`` and ``lane_weight``.
    """
    lane = tenants.groupBy("lane").agg(F.sum("weight").alias("lane_weight"), F.count("*").alias("active"))
    t = tenants.join(lane, "lane")
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    by_weight = F.greatest(F.floor(budget * F.col("weight") / F.col("lane_weight")), F.lit(1))
    even = F.greatest(F.ceil(budget / F.col("active")), F.lit(1))
    cap = lambda c: F.least(c, F.lit(hard_cap)) if hard_cap else c
    return t.withColumns({"weighted_cap": cap(by_weight).cast("bigint"), "even_cap": cap(even).cast("bigint")})


def assign_partitions(tenants: DataFrame, fixed: DataFrame, partitions: int) -> DataFrame:
    """Tenant to partition: fixed ones keep theirs, others take free partitions in ascending order.

    Tenants beyond the free partitions get null (routed by key hash). One row per tenant of a lane
    goes through one ordered window.
    """
    held = fixed.where((F.col("partition_id") >= 0) & (F.col("partition_id") < partitions)).select("tenant_id", "partition_id")
    free = tenants.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition_id")).join(held.select("partition_id"), "partition_id", "left_anti")
    free = free.withColumn("rank", F.row_number().over(Window.orderBy("partition_id")))
    waiting = tenants.select("tenant_id").distinct().join(held, "tenant_id", "left_anti").orderBy("tenant_id").limit(partitions)
    got = waiting.withColumn("rank", F.row_number().over(Window.orderBy("tenant_id"))).join(free, "rank", "left").select("tenant_id", "partition_id")
    return tenants.select("tenant_id").distinct().join(held.unionByName(got), "tenant_id", "left")


def stale_forwards(forwards: DataFrame, leases: DataFrame, now: float, grace: float = 5.0) -> DataFrame:
    """Forwards without a lease, or whose lease ended at least ``grace`` before now."""
    j = forwards.join(leases.select("slot_id", "expiry"), "slot_id", "left")
    return j.where(F.col("expiry").isNull() | (F.col("expiry") + grace <= now))


def claim_slots(claims: DataFrame, held: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """claims(slot_id, request_id) with whether each may execute, and until when it then holds its slot.

    The first claim of a slot that nobody holds wins; held(slot_id, until) are claims before. A claim
    without a slot always may and holds nothing.
    """
    slot = F.nullif(F.col("slot_id"), F.lit(""))
    live = held.where(F.col("until") > now).select(F.col("slot_id").alias("held_id")).distinct()
    first = claims.where(slot.isNotNull()).groupBy(F.col("slot_id").alias("first_id")).agg(F.min("request_id").alias("first_request"))
    j = claims.join(live, slot == F.col("held_id"), "left").join(first, slot == F.col("first_id"), "left")
    won = slot.isNull() | (F.col("held_id").isNull() & (F.col("request_id") == F.col("first_request")))
    until = F.when(won & slot.isNotNull(), now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)))
    return j.select(*claims.columns, won.alias("won"), until.alias("until"))


def renew_leases(leases: DataFrame, renewals: DataFrame, ttl_seconds: float) -> DataFrame:
    """leases(slot_id, expiry, ...) with those of renewals(slot_id, at) that are still there prolonged from the last renewal; a lease that is gone is not made again."""
    last = renewals.groupBy("slot_id").agg(F.max("at").alias("at"))
    j = leases.join(last, "slot_id", "left")
    return j.withColumn("expiry", F.coalesce(F.col("at") + F.lit(float(ttl_seconds)), F.col("expiry"))).drop("at")


def lease_active(slots: DataFrame, leases: DataFrame, now: float) -> DataFrame:
    """slots(slot_id) with whether a live lease stands behind each, and its expiry."""
    j = slots.join(leases.groupBy("slot_id").agg(F.max("expiry").alias("expiry")), "slot_id", "left")
    return j.withColumn("active", F.coalesce(F.col("expiry") > now, F.lit(False)))


def active_view(ring: DataFrame, leases: DataFrame, weights: DataFrame) -> DataFrame:
    """Distinct tenants of ring and live leases per lane, with their summed weight."""
    every = ring.select("lane", "tenant_id").union(leases.select("lane", "tenant_id")).distinct()
    return weighted(every, weights).groupBy("lane").agg(F.count("*").alias("tenants"), F.sum("weight").alias("weight"))


def lane_stats(ring: DataFrame, leases: DataFrame, forwards: DataFrame) -> DataFrame:
    """Active tenants, live leases and forwarding depth per lane."""
    parts = [
        ring.groupBy("lane").agg(F.count_distinct("tenant_id").alias("n")).withColumn("what", F.lit("tenants")),
        leases.groupBy("lane").agg(F.count("*").alias("n")).withColumn("what", F.lit("leases")),
        forwards.groupBy("lane").agg(F.count("*").alias("n")).withColumn("what", F.lit("forwards")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    pick = lambda k: F.coalesce(F.max(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k)
    return every.groupBy("lane").agg(pick("tenants"), pick("leases"), pick("forwards"))


def priority_gate(topics: DataFrame) -> DataFrame:
    """Whether a better-ranked, unpaused topic of the group has lag. topics(group, topic, rank, lag, paused)."""
    above = Window.partitionBy("group").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    busy = F.when((F.col("lag") > 0) & ~F.col("paused"), 1).otherwise(0)
    return topics.withColumn("must_yield", F.coalesce(F.max(busy).over(above), F.lit(0)) == 1)


def interleave(ticks: DataFrame, every: int = 4) -> DataFrame:
    """Of a topic's polls made while higher topics have lag, every Nth proceeds; others always do."""
    n = F.row_number().over(Window.partitionBy("topic", "higher_lag").orderBy("tick"))
    return ticks.withColumn("proceeds", ~F.col("higher_lag") | (n % every == 0))


def ranks(groups: DataFrame) -> DataFrame:
    """Topics with their rank in the group. groups(group, topics array)."""
    return groups.select("group", F.posexplode("topics").alias("rank", "topic"))


def duplicate_topics(groups: DataFrame, flat: DataFrame) -> DataFrame:
    """Topics listed more than once, or also consumed outside the groups."""
    r = ranks(groups)
    twice = r.groupBy("topic").agg(F.count("*").alias("n")).where("n > 1").select("topic", F.lit("duplicate").alias("problem"))
    overlap = r.select("topic").distinct().join(flat.select("topic").distinct(), "topic", "left_semi").select("topic", F.lit("overlap").alias("problem"))
    return twice.unionByName(overlap)

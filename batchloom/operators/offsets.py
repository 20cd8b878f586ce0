"""Log positions: contiguous commit prefixes, rewinds, skips, pointer lookups and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import murmur2


def commit_prefix(log: DataFrame) -> DataFrame:
    """Per (topic, partition): first offset, offsets done from it without a gap, and the next to commit.

    log(topic, partition_id, offset, state). Only the smallest offset that is not done matters, so
    one partial aggregation does it; gaps in the numbering itself do not block.
    """
    blocked = F.min(F.when(F.col("state") != "done", F.col("offset")))
    per = log.groupBy("topic", "partition_id").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), blocked.alias("blocked_at"))
    return per.withColumn("next_commit", F.coalesce("blocked_at", F.col("last_offset") + 1)).drop("last_offset")


def rewind(log: DataFrame) -> DataFrame:
    """Smallest offset per (topic, partition) that was fetched and never dispatched."""
    return log.where("state = 'pending'").groupBy("topic", "partition_id").agg(F.min("offset").alias("rewind_to"))


def skipped(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Records at or below the skip mark of their (topic, partition)."""
    m = marks.groupBy("topic", "partition_id").agg(F.max("skip_until").alias("skip_until"))
    return log.join(m, ["topic", "partition_id"]).where("offset <= skip_until").drop("skip_until")


def lookup(pointers: DataFrame, log: DataFrame, bounds: DataFrame, of: tuple[str, ...] = ("partition_id",)) -> DataFrame:
    """Pointers(offset and the columns ``of``) resolved to records: found, lost (below low) or miss."""
    p = pointers.join(bounds, list(of), "left").join(log, [*of, "offset"], "left")
    found = F.when(F.col("payload").isNotNull(), "found").when(F.col("offset") < F.col("low"), "lost").otherwise("miss")
    return p.withColumn("result", found)


def lag_rollup(lag: DataFrame) -> DataFrame:
    """Summed positive lag, committed and end positions per group and topic."""
    return lag.groupBy("group", "topic").agg(F.sum(F.greatest(F.col("end") - F.col("committed"), F.lit(0))).alias("lag"), F.sum("committed").alias("committed"), F.sum("end").alias("end_sum"))


def partition_of(key: Column, requested: Column, n: int) -> Column:
    """The requested partition if it exists, else the key's Murmur2 hash; null without either (any partition will do)."""
    hashed = F.pmod(murmur2(F.nullif(key, F.lit(""))), F.lit(n)).cast("int")
    return F.when((requested >= 0) & (requested < n), requested.cast("int")).otherwise(hashed)


def chunks(records: DataFrame, order: list[str], by: list[str], size: int = 500) -> DataFrame:
    """Chunk numbers of bulk writes, per producer key."""
    return records.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size).cast("bigint"))

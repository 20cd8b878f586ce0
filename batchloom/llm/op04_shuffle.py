"""Sharding by a two-pass external shuffle, with DataFrame operations only.

Pass one scatters whole records into buckets of about ``bucket_bytes`` by a seeded hash of doc_id;
pass two sorts each bucket into a fixed order, applies the built-in seeded Fisher-Yates shuffle
to it as one array, and writes it. The law is ``key``: rendezvous hashing of (doc_id, shard)
decides the shard, so one more shard takes rows only into itself.

Buckets hold a bounded number of bytes because the bucket count follows the table's bytes and
(doc_id, text) hashes evenly; a hot source, a group of equal texts or a hot doc_id with many texts
spreads like everything else (only rows equal in both share a bucket whatever their number). Slots
are the bucket's first slot (sums over bucket counts) plus the place in the bucket.

Defined cases: null text has size 1 and the crc32 of no bytes; rows of equal doc_id share a shard
and are ordered by all their columns before the shuffle (so columns must be orderable: no maps); null doc_id is one more key; an empty table gives no row. Records keep
all their columns under ``record``, so no name can clash; a very long text is one record of its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import landed, small_or_shuffled

SHARDS, SEED, BUCKET_BYTES, MOST_TASKS = 8, 20_240_229, 4 << 20, 20_000


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with the key is largest."""
    draws = [F.struct(F.xxhash64(key, F.lit(s), F.lit(seed)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return (F.greatest(*draws) if shards > 1 else draws[0])["s"]


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def external_shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records: shard, bucket, place, record) as written, and (manifest: shard, bucket, n, first_slot)."""
    key = F.col("doc_id").cast("long")
    total = docs.agg(F.sum(text_bytes(F.col("text").cast("string")))).first()[0] or 0
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")).withColumns({"key": F.col("record.doc_id").cast("long")})
    placed = placed.withColumns({"shard": shard_of(F.col("key"), shards, seed), "bucket": F.pmod(F.xxhash64("key", F.col("record.text"), F.lit(seed + 1)), F.lit(per_shard)).cast("int")})
    # one fixed partition count, so a bucket's generator state depends on nothing but the data
    width = min(shards * per_shard, MOST_TASKS)
    scattered = placed.repartition(width, "shard", "bucket")
    order = F.struct(F.xxhash64("key", F.lit(seed + 2)).alias("h"), F.col("key"), F.col("record"))
    gathered = scattered.sortWithinPartitions("shard", "bucket").groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(order)).alias("rows"))
    mixed = gathered.select("shard", "bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "row"))
    written = landed(mixed.select("shard", "bucket", "place", F.col("row.record").alias("record")), "shards")
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return written, counts.withColumn("first_slot", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def slots(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Records with their gapless slot in the shard."""
    return records.join(small_or_shuffled(manifest.drop("n")), ["shard", "bucket"]).withColumn("slot", F.col("first_slot") + F.col("place"))

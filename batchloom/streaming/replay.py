"""Streams over stored relations, run to their end: what a stream gives, as a table.

Records are appended to a log in files and read back in bounded ordered steps (``sources.log``), so a
replay passes through several micro-batches, with state, checkpoints and offsets as in a running stream.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..session import ARROW_KEY, package_on_workers, scratch
from ..sources import log

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` for stateful streams, in UTC: RocksDB state in as many partitions as there are cores, no micro-batches without data."""
    s = spark.newSession()
    if (size := spark.conf.get(ARROW_KEY, None)) is not None:
        s.conf.set(ARROW_KEY, size)
    s.conf.set("spark.sql.session.timeZone", "UTC")
    s.conf.set("spark.sql.shuffle.partitions", max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    s.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    s.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return package_on_workers(s)


#: Rows that a task sorts, however many there are in all.
TASK_ROWS = 250_000


def tasks_for(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // TASK_ROWS))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with their number from 0 by ``order`` inside ``by``, whose values are few.

    Rows are sorted in ranges of about ``TASK_ROWS`` and written; each range is then shifted by what
    lies in earlier ones, so no task sorts a whole group.
    """
    path = scratch(rows.sparkSession, "ranges")
    dealt = rows.repartitionByRange(tasks_for(rows), *by, *order).sortWithinPartitions(*by, *order)
    dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_place")).write.parquet(path)
    dealt = rows.sparkSession.read.parquet(path)
    runs = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_rows"), F.min("_place").alias("_first"))
    before = F.sum("_rows").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_range").alias("_at"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    # a row for each range and for each value of ``by``, about
    return dealt.join(F.broadcast(runs), same).withColumn(name, F.col("_place") + F.col("_shift")).select(*rows.columns, name)


def log_of(records: DataFrame) -> str:
    """A new log with ``records(topic, partition, offset, key, value, timestamp)``."""
    path = scratch(records.sparkSession, "log")
    log.append(records, path, tasks=max(tasks_for(records), records.sparkSession.sparkContext.defaultParallelism))
    return path


def shares(spark: SparkSession, path: str, steps: int) -> tuple[int, int]:
    """Byte budgets (all, each partition) by which a log takes about ``steps`` micro-batches, whatever its size, each with a share of every partition."""
    of = log.zones(spark, path).groupBy("topic", "partition").agg(F.sum("bytes").alias("bytes"))
    total, largest = of.agg(F.sum("bytes"), F.max("bytes")).first()
    each = (largest or 0) // steps + (largest or 0) // 64 + 1  # somewhat more, since records are not cut
    return max(1, total or 0), each


#: Streams side by side: each holds a Python planner of about 160 MB beside the driver.
STREAMS = 3


def dealt(spark: SparkSession, path: str, budgets: tuple[int, int]) -> list[list[str]]:
    """The partitions of a log dealt to streams, near equal in bytes: so many streams that a micro-batch has room for each of a stream's partitions, but no more than ``STREAMS`` or cores."""
    of = log.zones(spark, path).groupBy("topic", "partition").agg(F.sum("bytes").alias("bytes")).collect()  # a row per partition
    n = max(1, min(-(-len(of) * budgets[1] // budgets[0]), STREAMS, spark.sparkContext.defaultParallelism))
    groups: list[list[str]] = [[] for _ in range(n)]
    heap = [(0, i) for i in range(n)]
    for r in sorted(of, key=lambda r: (-r["bytes"], r["topic"], r["partition"])):
        size, i = heapq.heappop(heap)
        groups[i].append(f"{r['topic']}/{r['partition']}")
        heapq.heappush(heap, (size + r["bytes"], i))
    return groups


def replayed(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], budgets: tuple[int, int], shared: bool = False) -> DataFrame:
    """Rows that the stream ``build(log)`` gives until the log at ``path`` ends, with ``epoch``, their micro-batch, and ``place``, their order in its tasks.

    With ``shared`` the log's partitions are dealt to streams that run side by side, as consumers of a group
    are, each micro-batch within the budgets; ``member`` tells the stream. For streams whose partitions do not meet.
    A micro-batch that runs again replaces what it wrote.
    """
    out, check = scratch(spark, "out"), scratch(spark, "checkpoint")

    def start(stream: DataFrame, to: str, check: str) -> StreamingQuery:
        def each(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{to}/epoch={epoch}")

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", check).trigger(processingTime="0 seconds").start()

    members = dealt(spark, path, budgets) if shared else [None]
    queries: list[StreamingQuery] = []
    try:
        for m, assigned in enumerate(members):
            stream = build(log.stream(spark, path, *budgets, assigned))
            queries.append(start(stream, f"{out}/member={m}" if shared else out, f"{check}/{m}"))
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    keys = ["place", *(["member"] if shared else []), "epoch"]
    whole = T.StructType([*stream.schema.fields, *(T.StructField(k, T.LongType()) for k in keys)])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], whole)  # the log was empty
    return spark.read.schema(whole).parquet(out)

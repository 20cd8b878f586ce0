"""Sinks: records of a relation produced in chunks, with what was written and what failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = "task int, chunk int, records bigint, produced bigint, error string"


def produce(records: DataFrame, write: Callable[[pd.DataFrame], int | None], size: int = 500) -> DataFrame:
    """A row per chunk of at most ``size`` records: how many there were, how many ``write`` took, and its error.

    Tasks cut chunks from their own records, so nothing is shuffled. ``write`` gives the number it
    wrote (none: all) or raises; after a failed chunk a task writes no other one, and the records
    left count as not produced. A task that runs again writes again: delivery is at least once.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, chunk, failed = TaskContext.get().partitionId(), 0, False
        for b in batches:
            out = []
            for i in range(0, len(b), size):
                part, done, error = b.iloc[i : i + size], 0, None
                if not failed:
                    try:
                        got = write(part)
                        done = len(part) if got is None else got
                        error = None if done == len(part) else "partial write"
                    except Exception as e:  # a failed write is a result
                        error = str(e) or type(e).__name__
                    failed = error is not None
                out.append((task, chunk, len(part), done, error))
                chunk += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNKS.split(", ")])

    return records.mapInPandas(each, CHUNKS)


def produced(chunks: DataFrame) -> DataFrame:
    """One row: records, produced, failed, and the first error."""
    return chunks.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.coalesce(F.sum("produced"), F.lit(0)).alias("produced"),
        F.coalesce(F.sum(F.col("records") - F.col("produced")), F.lit(0)).alias("failed"), F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("task", "chunk"))).alias("error"),
    )


def to_topics(records: DataFrame, path: str) -> None:
    """Append records to a folder per topic: the log where no broker is at hand."""
    records.write.mode("append").partitionBy("topic").parquet(path)


#: Names of acknowledgement levels, and the producer's setting for each.
ACKS = {"": "all", "all_isr": "all", "all": "all", "all_isr_acks": "all", "leader": "1", "leader_ack": "1"}


def required_acks(text: str | None) -> str:
    """The producer's setting for an acknowledgement level; all in-sync replicas by default."""
    name = (text or "").strip().lower()
    if name not in ACKS:
        raise ValueError(f"unsupported acknowledgements {text!r} (use all_isr or leader)")
    return ACKS[name]


def to_broker(records: DataFrame, options: dict[str, str], acks: str | None = None) -> None:
    """Write records(topic, key, value, partition) to a broker whose connector is on the class path.

    Returns when every record is acknowledged as ``acks`` asks, and raises if one is not.
    """
    columns = [c for c in ("topic", "key", "value", "partition") if c in records.columns]
    records.select(*columns).write.format("kafka").options(**{"kafka.acks": required_acks(acks), **options}).save()

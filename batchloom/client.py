"""The producing side as one object: batches, bulk pushes, standalone and delayed jobs, topics.

Every method takes and returns relations; nothing is sent. A sink (files, a broker, ``foreachBatch``)
writes what it returns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import control, routing
from .sources import config


def _due(jobs: DataFrame, now: Column, after: Column | None) -> DataFrame:
    return jobs if after is None else jobs.withColumn("run_at", routing.run_at_after(after, now))


@dataclass
class JobClient:
    manifest: DataFrame
    chunk: int = 500
    horizon_days: int = 30
    retries: int = 0
    default_topic: str = "jobs"

    # batches -----------------------------------------------------------------------------------

    def create_batches(self, existing: DataFrame, new: DataFrame) -> DataFrame:
        """Created batches, running and unsealed, with no jobs yet."""
        made = control.create_batches(existing, new).where("created").drop("created")
        return made.withColumns({"status": F.lit("running"), "sealed": F.lit(False), "total_jobs": F.lit(0).cast("bigint")})

    # jobs of batches ---------------------------------------------------------------------------

    def push_many(self, jobs: DataFrame, uniq_key: Column | None = None, order: list[str] | None = None) -> DataFrame:
        """Jobs of open batches with sequence, target topic and chunk; unknown job types raise no error but are marked."""
        return control.push_many(jobs, self.manifest, F.col("job_id") if uniq_key is None else uniq_key, order or ["job_id"], self.chunk)

    def push_later(self, jobs: DataFrame, now: Column, after: Column | None = None, **options) -> tuple[DataFrame, DataFrame]:
        """(due now, index rows) of pushed jobs with run_at, or ``after`` that many seconds."""
        return control.schedule_jobs(self.push_many(_due(jobs, now, after), **options), now, self.horizon_days)

    # standalone jobs ---------------------------------------------------------------------------

    def enqueue_many(self, jobs: DataFrame, assigned: DataFrame | None = None) -> DataFrame:
        """Envelopes of jobs with topic, key and partition, in one pass; a sink writes them in chunks."""
        routed = routing.route(jobs, self.manifest, assigned, self.default_topic)
        return routed.select(*routing.envelope_columns(self.retries), "to_topic", "to_key", "to_partition")

    def enqueue_later(self, jobs: DataFrame, now: Column, after: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """(envelopes due now, index rows) of jobs with run_at, or ``after`` that many seconds."""
        due, later = control.schedule_jobs(_due(jobs, now, after), now, self.horizon_days)
        return self.enqueue_many(due), later

    def by_worker_class(self, messages: DataFrame) -> DataFrame:
        """Messages that name a worker class, with the job type it stands for."""
        out = routing.job_type_of(messages, self.manifest)
        return out.withColumn("job_type", F.coalesce("resolved", "job_type")).drop("resolved", "worker_class")

    # topics ------------------------------------------------------------------------------------

    def missing_topics(self, existing: DataFrame) -> DataFrame:
        """Specifications of topics that the manifest needs and nobody has created."""
        topics = self.manifest.where("topic != ''").select("topic").distinct()
        return config.missing_topics(config.topic_specs(topics), existing)

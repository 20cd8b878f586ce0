"""Configuration sources: manifests, priority groups, environment expansion, topic specifications."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the syntax of variables in configuration texts.
VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")
MANIFEST = "job_type string, runtime string, worker_class string, topic string, max_retries int, retry_tier string, fairness_type string"


def expand(text: str, env: dict[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default}; an unset or empty name without default is empty."""
    env = os.environ if env is None else env
    return VARIABLE.sub(lambda m: env.get(m[1]) or m[2] or "", text)


def load_yaml(path: str) -> dict:
    import yaml  # only where configuration is kept as YAML

    with open(path) as f:
        return yaml.safe_load(expand(f.read())) or {}


def manifest(spark: SparkSession, handlers: dict[str, dict]) -> DataFrame:
    """Handlers by job_type as a table; unknown keys are ignored."""
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    return spark.createDataFrame([tuple([k, *(h.get(c) for c in names[1:])]) for k, h in sorted(handlers.items())], MANIFEST)


def priority_groups(spark: SparkSession, groups: list[dict]) -> DataFrame:
    rows = [(g["group"], g.get("mode", "strict"), int(g.get("weighted_interleave", 4)), list(g["topics"])) for g in groups]
    if bad := [r[1] for r in rows if r[1] not in ("strict", "weighted")]:
        raise ValueError(f"unknown mode {bad[0]!r}")
    return spark.createDataFrame(rows, "group string, mode string, weighted_interleave int, topics array<string>")


def topic_specs(topics: DataFrame, partitions: int = 16, fair_partitions: int = 64, horizon_days: int = 30) -> DataFrame:
    """Specifications to provision for topics(topic): fair ingest and ready topics are wider, scheduled ones keep longer."""
    day = 86_400_000
    wide = F.when(F.col("topic").startswith("fair-"), fair_partitions).otherwise(partitions)
    kept = F.when(F.col("topic") == "scheduled", max(7, horizon_days + 1) * day).otherwise(7 * day)
    return topics.select("topic", wide.cast("int").alias("partitions"), kept.cast("bigint").alias("retention_ms"))


def missing_topics(specs: DataFrame, existing: DataFrame) -> DataFrame:
    return specs.join(existing.select("topic"), "topic", "left_anti").orderBy("topic")

"""Producing jobs, parking what cannot go on, and the guards of the control plane."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fairness, routing, schedule

CONTROL_TOPICS = ("events", "callbacks", "retry", "scheduled", "dlt")


def create_batches(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` with whether they are created: the first of an unknown id is."""
    first = F.row_number().over(Window.partitionBy("batch_id").orderBy("created_at", "request_id")) == 1
    known = existing.select("batch_id", F.lit(True).alias("known")).distinct()
    return new.join(known, "batch_id", "left").withColumn("created", first & F.col("known").isNull()).drop("known")


def add_jobs(requests: DataFrame, batches: DataFrame) -> DataFrame:
    """Reserve contiguous sequence ranges: requests(batch_id, request_id, n) in request_id order.

    not_found, cancelled and closed reserve nothing; a negative n lowers the total but never the
    sequence.
    """
    j = requests.join(batches.select("batch_id", "status", "sealed"), "batch_id", "left")
    result = F.when(F.col("status").isNull(), "not_found").when(F.col("status") == "cancelled", "cancelled").when(F.col("sealed"), "closed").otherwise("ok")
    j = j.withColumn("result", result)
    grown = F.when(F.col("result") == "ok", F.greatest("n", F.lit(0))).otherwise(0)
    last = F.sum(grown).over(Window.partitionBy("batch_id").orderBy("request_id").rowsBetween(Window.unboundedPreceding, 0))
    good = (F.col("result") == "ok") & (F.col("n") > 0)
    return j.withColumns({"first_seq": F.when(good, last - F.col("n") + 1), "last_seq": F.when(good, last)}).drop("status", "sealed")


def push_many(jobs: DataFrame, manifest: DataFrame, uniq_key: Column, order: list[str], chunk: int = 500) -> DataFrame:
    """Bulk push to open batches: uniqueness, sequence, envelope target and chunk of every job.

    A job that loses its uniqueness claim keeps its place in the result with an empty id and no
    sequence. One shuffle by batch and one by fingerprint.
    """
    j = schedule.first_wins(jobs.withColumn("fingerprint", uniq_key), ["batch_id", "fingerprint"], order)
    open_ = Window.partitionBy("batch_id", "claimed").orderBy(*order)
    n = F.row_number().over(open_)
    j = j.withColumns({"seq": F.when(F.col("claimed"), n).cast("bigint"), "chunk": F.when(F.col("claimed"), F.floor((n - 1) / chunk)).cast("bigint"), "pushed_id": F.when(F.col("claimed"), F.col("job_id")).otherwise("")})
    return routing.with_handler(j, manifest).withColumn("known", F.col("runtime").isNotNull())


def schedule_jobs(jobs: DataFrame, now: Column, horizon_days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(due now, index rows) of jobs with run_at: later ones wait in the schedule index."""
    j = jobs.withColumn("run_at", routing.clamp_run_at(F.col("run_at"), now, horizon_days))
    return j.where(F.col("run_at") <= now), j.where(F.col("run_at") > now).withColumn("lease_until", F.lit(None).cast("timestamp_ntz"))


def cancel(batches: DataFrame, ids: DataFrame) -> DataFrame:
    """Batches with running ones of ``ids`` cancelled; finished ones stay."""
    hit = F.col("hit").isNotNull() & (F.col("status") == "running")
    return batches.join(ids.select("batch_id", F.lit(True).alias("hit")).distinct(), "batch_id", "left").withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status"))).drop("hit")


def claim_callbacks(requests: DataFrame, claimed: DataFrame) -> DataFrame:
    """At most one claim per (batch, kind): the first request of one that nobody holds."""
    first = F.row_number().over(Window.partitionBy("batch_id", "kind").orderBy("request_id")) == 1
    held = claimed.select("batch_id", "kind", F.lit(True).alias("held")).distinct()
    return requests.join(held, ["batch_id", "kind"], "left").withColumn("won", first & F.col("held").isNull()).drop("held")


def parked(messages: DataFrame, error: Column, source: Column, now: Column) -> DataFrame:
    """Dead-letter rows of what could not be produced or parsed; the raw text survives."""
    return messages.withColumns({"dlt_type": F.lit("unproducible"), "dlt_source_topic": source, "dlt_error_class": F.lit("ProduceError"), "dlt_error_message": F.substring(error, 1, 500), "dlt_at": now})


def poll(due: DataFrame, log: DataFrame, bounds: DataFrame, most_misses: int = 10, of: tuple[str, ...] = ("partition_id",)) -> DataFrame:
    """One tick over due pointers(offset, misses and the columns ``of``): dispatch, drop lost ones, retry misses."""
    from . import offsets

    j = offsets.lookup(due, log, bounds, of)
    misses = F.col("misses") + 1
    action = F.when(F.col("result") == "found", "dispatch").when(F.col("result") == "lost", "drop_lost").when(misses >= most_misses, "drop_missing").otherwise("retry_later")
    return j.withColumn("action", action)


def reclaim(orphans: DataFrame, produced: DataFrame) -> DataFrame:
    """Orphans to produce again: not twice, and to the dead letters if they have no source."""
    again = orphans.join(produced.select("job_id").distinct(), "job_id", "left_anti")
    return again.withColumns({"action": F.when(F.col("topic").isNull(), "dead_letter").otherwise("reproduce"), "_reclaim": F.lit(True)})


def fair_ready_split(manifest: DataFrame) -> DataFrame:
    """Lanes whose handlers run on several runtimes, which need a ready topic for each."""
    lanes = manifest.where("coalesce(fairness_type, '') != ''").groupBy("fairness_type").agg(F.array_sort(F.collect_set("runtime")).alias("runtimes"))
    return lanes.where(F.size("runtimes") > 1).select("fairness_type", F.explode("runtimes").alias("runtime")).withColumn("ready_topic", F.concat(F.lit("fair-"), "fairness_type", F.lit("-ready-"), "runtime"))


def executable(topics: DataFrame) -> DataFrame:
    """Topics with whether a worker may execute them: control topics may not."""
    return topics.withColumn("executable", ~F.col("topic").isin(*CONTROL_TOPICS))


def all_topics(groups: DataFrame) -> DataFrame:
    """Every topic of the groups once, at its first place."""
    return fairness.ranks(groups).groupBy("topic").agg(F.min(F.struct("rank", "group")).alias("first")).select("topic", "first.group", "first.rank")


def sampled(events: DataFrame, rate: float, key: Column) -> DataFrame:
    """The share of metric events whose key's digest is low, 0 < rate <= 1: the same in every run and partitioning."""
    if not 0 < rate <= 1:
        raise ValueError("rate must lie in (0, 1]")
    return events if rate == 1 else events.where(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8) < F.lit(f"{int(rate * 2**32):08x}"))


#: Pauses of a consumer group: of one partition, or of a whole topic (partition -1).
PAUSES = "group string, topic string, partition_id int"


def pauses(spark: SparkSession, stores: list[Callable[[], DataFrame]]) -> DataFrame:
    """The pauses of the first store that can be reached, even if it has none; nothing is paused if none can.

    A store is a function that gives its rows(group, topic, partition_id) or raises.
    """
    for store in stores:
        with contextlib.suppress(Exception):  # a store that cannot be reached leaves the word to the next
            return store().select("group", "topic", F.col("partition_id").cast("int").alias("partition_id")).distinct()
    return spark.createDataFrame([], PAUSES)


class PauseSwitch:
    """Pauses as of their last reading, read again after ``interval`` seconds."""

    def __init__(self, spark: SparkSession, stores: list[Callable[[], DataFrame]], interval: float = 30, clock: Callable[[], float] = time.monotonic):
        self.spark, self.stores, self.interval, self.clock = spark, stores, interval if interval > 0 else 30, clock
        self.read_at, self.now = None, None

    def __call__(self) -> DataFrame:
        if self.now is None or self.clock() - self.read_at >= self.interval:
            old, self.now = self.now, pauses(self.spark, self.stores).persist()
            self.now.count()  # as of this moment, whatever the store says later
            self.read_at = self.clock()
            if old is not None:
                old.unpersist()
        return self.now


class LagGate:
    """Whether better-ranked topics have lag, by the last reading that worked, taken anew after ``interval`` seconds.

    ``read`` gives rows(group, topic, lag) or raises. Before any reading nothing yields; a failed one
    leaves the last good one in force.
    """

    def __init__(self, read: Callable[[], DataFrame], interval: float = 2, clock: Callable[[], float] = time.monotonic):
        self.read, self.interval, self.clock = read, interval if interval > 0 else 2, clock
        self.read_at, self.now = None, None

    def lag(self, force: bool = False) -> DataFrame | None:
        if force or self.now is None or self.clock() - self.read_at >= self.interval:
            with contextlib.suppress(Exception):  # the last good reading stays
                fresh = self.read().select("group", "topic", "lag").persist()
                fresh.count()
                old, self.now, self.read_at = self.now, fresh, self.clock()
                if old is not None:
                    old.unpersist()
        return self.now

    def must_yield(self, topics: DataFrame, paused: DataFrame, force: bool = False) -> DataFrame:
        """topics(group, topic, rank) with must_yield: a better-ranked topic of the group, not paused as a whole, has lag."""
        lag = self.lag(force)
        if lag is None:
            return topics.withColumn("must_yield", F.lit(False))
        whole = paused.where("partition_id = -1").select("group", "topic", F.lit(True).alias("stopped")).distinct()
        j = topics.join(lag, ["group", "topic"], "left").join(whole, ["group", "topic"], "left")
        j = j.select(*topics.columns, F.coalesce("lag", F.lit(0)).alias("lag"), F.coalesce("stopped", F.lit(False)).alias("paused"))
        return fairness.priority_gate(j).drop("lag", "paused")


def _paused(log: DataFrame, paused: DataFrame, group: Column, how: str) -> DataFrame:
    p = paused.select(F.col("group").alias("p_group"), F.col("topic").alias("p_topic"), F.col("partition_id").alias("p_partition"))
    return log.join(p, (group == F.col("p_group")) & (F.col("topic") == F.col("p_topic")) & ((F.col("p_partition") == -1) | (F.col("p_partition") == F.col("partition_id"))), how)


def consumed(log: DataFrame, paused: DataFrame, group: Column) -> DataFrame:
    """Records that the consumer ``group`` may take: no pause of its own holds their topic or partition."""
    return _paused(log, paused, group, "left_anti")


def held(log: DataFrame, paused: DataFrame, group: Column) -> DataFrame:
    """Records that a pause of ``group`` holds."""
    return _paused(log, paused, group, "left_semi")


def active_higher(topics: DataFrame, paused: DataFrame) -> DataFrame:
    """Of topics(group, topic, ...) those that no pause of the whole topic holds back in their group."""
    whole = paused.where("partition_id = -1").select("group", "topic").distinct()
    return topics.join(whole, ["group", "topic"], "left_anti")


def notices(findings: DataFrame, sent: DataFrame, interval: int, now: Column) -> DataFrame:
    """Findings to notify about: none sent within clamp(3 * interval, 120, 3600) seconds."""
    ttl = min(3600, max(120, 3 * interval))
    recent = sent.where(F.col("sent_at") > now - schedule.seconds(ttl)).select("fingerprint").distinct()
    text = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "rule_id", F.lit(" "), F.substring("fingerprint", 1, 200))
    return findings.join(recent, "fingerprint", "left_anti").dropDuplicates(["fingerprint"]).withColumn("message", text)


def _section(kind: str, text_type: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.struct(F.lit(text_type).alias("type"), text.alias("text")).alias("text"))


def chat_body(notice: dict[str, Column]) -> Column:
    """The body of a chat message as JSON: a header of at most 150 characters, the summary and what found it.

    ``notice`` has event, severity, title, summary, rule_id and fingerprint.
    """
    n = notice
    header = _section("header", "plain_text", F.upper(F.substring(F.concat(n["event"], F.lit(": "), n["title"]), 1, 150)))
    section = _section("section", "mrkdwn", F.substring(n["summary"], 1, 2900))
    found = F.concat(F.lit("rule=`"), n["rule_id"], F.lit("` · `"), n["fingerprint"], F.lit("`"))
    context = F.struct(F.lit("context").alias("type"), F.array(F.struct(F.lit("mrkdwn").alias("type"), found.alias("text"))).alias("elements"))
    blocks = F.concat_ws(",", F.to_json(header), F.to_json(section), F.to_json(context))
    text = F.to_json(F.struct(F.concat(F.lit("["), n["severity"], F.lit("] "), n["title"]).alias("text")))
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"blocks":['), blocks, F.lit("]}"))


def mail_text(notice: dict[str, Column], to: str, sender: str) -> Column:
    """A plain mail of a notice, headers and body."""
    n = notice
    subject = F.concat(F.lit("["), n["severity"], F.lit("] "), n["event"], F.lit(": "), n["title"])
    head = [F.lit(f"To: {to}"), F.lit(f"From: {sender}"), F.concat(F.lit("Subject: "), F.regexp_replace(subject, r"[\r\n]+", " ")), F.lit("MIME-Version: 1.0"), F.lit("Content-Type: text/plain; charset=UTF-8")]
    return F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), n["summary"], F.lit("\r\n\r\nrule="), n["rule_id"], F.lit(" fingerprint="), n["fingerprint"], F.lit("\r\n"))


def deliver(bodies: DataFrame, send: dict[str, Callable[[str], None]]) -> DataFrame:
    """bodies(channel, fingerprint, body) handed to ``send`` by channel where they lie: delivered, and the error if one was.

    For ``foreachBatch``: a channel that fails disturbs neither the others nor the job; channels without a
    sender deliver nothing.
    """
    import pandas as pd

    def each(batches):
        for b in batches:
            out = []
            for channel, fingerprint, body in zip(b["channel"], b["fingerprint"], b["body"], strict=True):
                error = None if channel in send else "no sender"
                try:
                    if error is None:
                        send[channel](body)
                except Exception as e:  # best effort, noted
                    error = str(e) or type(e).__name__
                out.append((channel, fingerprint, error is None, error))
            yield pd.DataFrame(out, columns=["channel", "fingerprint", "delivered", "error"])

    return bodies.select("channel", "fingerprint", "body").mapInPandas(each, "channel string, fingerprint string, delivered boolean, error string")


def group_name(prefix: str, group: Column, role: str) -> Column:
    """Consumer group of a role: <prefix><group>-<role>, the prefix only once."""
    return F.concat(routing.prefixed(group, prefix), F.lit(f"-{role}"))

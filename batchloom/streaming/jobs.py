"""Structured Streaming: sources, ledger state, uniqueness locks, retry timers, bucket metrics.

Files with the log's columns stand for a broker where no connector is installed; ``log_stream``
takes either, ``sources.log.stream`` reads them in order and in bounded steps. State is keyed; order inside a
micro-batch is restored by sorting a key's rows by their arrival column.
"""

from __future__ import annotations

import bisect
import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import metrics
from ..sources.versioned import VersionedTable

LOG = "topic string, partition int, offset bigint, key string, value string, timestamp timestamp"
LEDGER = "batch_id bigint, touched bigint, completed bigint, failed bigint, status string, callback string"
WEEK = 7 * 86_400


def log_stream(spark: SparkSession, path: str | None = None, schema: str = LOG, per_trigger: int = 100, kafka: dict[str, str] | None = None) -> DataFrame:
    """A bounded-fetch stream of log records from files, or from a broker if its options are given.

    ``per_trigger`` bounds the files, or the records of a broker, that a micro-batch takes. Records
    of a partition keep their offsets; operators restore their order per key.
    """
    if kafka:
        return spark.readStream.format("kafka").options(**{"startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger), **kafka}).load()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


#: Keys of keyed state stand in this many pages: a micro-batch reads and writes a page once, not its keys one by one.
PAGES = 256


def _paged(events: DataFrame, key: str):
    """Rows by the page of their key."""
    return events.withColumn("_page", F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(PAGES)).cast("int")).groupBy("_page")


def _packed(**columns) -> bytes:
    """Columns of a page as one binary value."""
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(value) -> list[pa.Array]:
    return pa.ipc.open_stream(bytes(value)).read_next_batch().columns


def _first(mask: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The first row of every group where ``mask`` holds; the number of rows where it never does."""
    out, at = np.full(groups, len(mask)), np.flatnonzero(mask)[::-1]
    out[group[at]] = at
    return out


def _so_far(mask: np.ndarray, group: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often ``mask`` held up to each row in its group; groups stand together and begin at ``starts``."""
    n = np.cumsum(mask)
    return n - (n[starts] - mask[starts])[group]


class LedgerProcessor(StatefulProcessor):
    """Per batch: seen operations by sequence, counters, sticky status and callback claims.

    The rules are those of ``ledger.fold``, taken over all batches of a page at once. All state of a batch
    goes ``ttl`` seconds after the last event that counted: it is not read any more then, leaves with the
    page's next change, and a page without changes leaves as a whole.
    """

    def __init__(self, ttl: int = WEEK):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "batches binary, seen binary, expires bigint")

    def _kept(self, now: int) -> tuple[list[np.ndarray], list[np.ndarray], int | None]:
        """Live batches (id, touched, completed, failed, status, complete, success, expires), their seen sequences (id, seq, ok, bad) and the page's timer."""
        if not self.page.exists():
            none = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, object, bool, bool, np.int64)]
            return none, [np.zeros(0, t) for t in (np.int64, np.int64, bool, bool)], None
        batches, seen, timer = self.page.get()
        batches, seen = ([c.to_numpy(zero_copy_only=False) for c in _unpacked(x)] for x in (batches, seen))
        live = batches[-1] > now
        batches = [c[live] for c in batches]
        held = np.isin(seen[0], batches[0])
        return batches, [c[held] for c in seen], timer

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        old, seen, timer = self._kept(now)
        e = pd.concat(list(rows)).sort_values("arrival", kind="stable").sort_values("batch_id", kind="stable")
        ids = e["batch_id"].to_numpy(np.int64)
        n, starts = len(ids), np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        batch, group = ids[starts], np.cumsum(np.r_[False, ids[1:] != ids[:-1]])
        g = len(batch)
        # a batch as it is kept, or as it was when its first event came
        at = np.searchsorted(old[0], batch)
        known = np.zeros(g, bool)
        known[at < len(old[0])] = old[0][at[at < len(old[0])]] == batch[at < len(old[0])]
        stored = e["status"].to_numpy(object)
        status = np.array(["running" if s is None or s != s else s for s in stored[starts]], object)
        status[known] = old[4][at[known]]
        touched, completed, failed, expires = (np.zeros(g, np.int64) for _ in range(4))
        complete, success = np.isin(status, ["complete", "success"]), status == "success"
        for now_, c in ((touched, 1), (completed, 2), (failed, 3), (complete, 5), (success, 6), (expires, 7)):
            now_[known] = old[c][at[known]]
        dead = np.where(status == "cancelled", 0, _first(stored == "cancelled", group, g))
        seq, op = e["batch_seq"].to_numpy(np.int64), e["op"].to_numpy(object)
        live = (seq >= 1) & (np.arange(n) < dead[group])
        # rows by batch and sequence, what was seen before in front of them
        row = np.flatnonzero(live)
        pid, pseq = np.r_[seen[0], ids[row]], np.r_[seen[1], seq[row]]
        prow = np.r_[np.full(len(seen[0]), -1), row]
        good = np.r_[seen[2], op[row] == "success"].astype(bool)
        bad = np.r_[seen[3], ~np.isin(op[row], ["success", "executed"])].astype(bool)
        order = np.lexsort((prow, pseq, pid))
        pid, pseq, prow, good, bad = (c[order] for c in (pid, pseq, prow, good, bad))
        fresh = np.r_[True, (pid[1:] != pid[:-1]) | (pseq[1:] != pseq[:-1])][: len(pid)]
        pair, pairs, m = np.cumsum(fresh) - 1, int(fresh.sum()), len(pid)
        first_good, first_bad = _first(good, pair, pairs), _first(bad, pair, pairs)
        # a failure counts before any success only
        new_bad = (first_bad < m) & (first_bad < first_good)
        is_t, is_good, is_bad = (np.zeros(n, bool) for _ in range(3))
        is_t[prow[fresh & (prow >= 0)]] = True
        for firsts, out in ((first_good[first_good < m], is_good), (first_bad[new_bad], is_bad)):
            hit = prow[firsts]
            out[hit[hit >= 0]] = True
        counts = is_t | is_good | is_bad
        t, c, f = touched[group] + _so_far(is_t, group, starts), completed[group] + _so_far(is_good, group, starts), failed[group] + _so_far(is_bad, group, starts)
        total = e["total_jobs"].to_numpy(np.int64)
        judged = counts & e["sealed"].to_numpy(bool) & (total >= 1)
        full, over = judged & (c >= total), judged & (c + f >= total)
        turn = np.where(status == "running", _first(full | over, group, g), n)
        turned = status.copy()
        turned[turn < n] = np.where(full[turn[turn < n]], "success", "complete")
        fired = []
        for order_, kind, given, when in ((0, "complete", complete, full | over | (judged & (t >= total))), (1, "success", success, full)):
            hit = _first(when, group, g)
            who = np.flatnonzero(~given & (hit < n))
            given[who] = True
            hit = hit[who]
            fired.append(pd.DataFrame({"batch_id": batch[who], "touched": t[hit], "completed": c[hit], "failed": f[hit], "status": np.where(hit >= turn[who], turned[who], status[who]), "callback": kind, "row": hit, "order": order_}))
        calls = pd.concat(fired).sort_values(["row", "order"])[[x.split()[0] for x in LEDGER.split(", ")]]
        last = np.r_[starts[1:], n] - 1
        touched, completed, failed = t[last], c[last], f[last]
        status = np.where(dead < n, "cancelled", turned).astype(object)
        counted = np.bincount(group[counts], minlength=g) > 0
        expires[counted] = now + 1000 * self.ttl
        keep = counted | known  # batches without a counting event keep no state
        if keep.any():
            rest = ~np.isin(old[0], batch)
            new = [np.r_[o[rest], x[keep]] for o, x in zip(old, (batch, touched, completed, failed, status, complete, success, expires), strict=True)]
            by = np.argsort(new[0])
            names = ("id", "touched", "completed", "failed", "status", "complete", "success", "expires")
            end = int(new[-1].max())
            if end != timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(end)
            first = np.flatnonzero(fresh)
            sure_bad = new_bad | np.isin(np.arange(pairs), pair[bad & (prow < 0)])
            self.page.update((_packed(**{k: x[by] for k, x in zip(names, new, strict=True)}), _packed(id=pid[first], seq=pseq[first], ok=first_good < m, bad=sure_bad), end))
        yield pd.concat([calls, pd.DataFrame({"batch_id": batch, "touched": touched, "completed": completed, "failed": failed, "status": status, "callback": None})])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.page.clear()  # the timer stands at the last end of all its batches
        yield pd.DataFrame([], columns=[c.split()[0] for c in LEDGER.split(", ")])

    def close(self) -> None:
        pass


def ledger_stream(events: DataFrame, ttl: int = WEEK) -> DataFrame:
    """Counters after every micro-batch and callbacks once. events(batch_id, batch_seq, op, arrival, total_jobs, sealed, status).

    Needs the RocksDB state store provider. Expiry is a timer, so a run over available data ends only
    with spark.sql.streaming.noDataMicroBatches.enabled=false.
    """
    whole = lambda name: F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint")).alias(name)
    events = events.select("batch_id", whole("batch_seq"), "op", "arrival", whole("total_jobs"), F.coalesce("sealed", F.lit(False)).alias("sealed"), "status")
    return _paged(events.where("batch_id is not null"), "batch_id").transformWithStateInPandas(LedgerProcessor(ttl), LEDGER, "Append", "ProcessingTime")


class UniqProcessor(StatefulProcessor):
    """First claim of a fingerprint wins until it expires or its owner releases it.

    A page holds the owners of its fingerprints, each forgotten ``ttl`` seconds after its last event.
    """

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the store forgets pages too, so fingerprints that never come back leave nothing behind
        self.owners = handle.getValueState("owners", "owners binary", ttlDurationMs=self.ttl * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        now = timerValues.getCurrentProcessingTimeInMs()
        owners = {}
        if self.owners.exists():
            owners = {f: (job, until, end) for f, job, until, end in zip(*(c.to_pylist() for c in _unpacked(self.owners.get()[0])), strict=True) if end > now}
        end, out = now + self.ttl * 1000, []
        for f, job, action, at in zip(events["fingerprint"].tolist(), events["job_id"].tolist(), events["action"].tolist(), events["arrival"].tolist(), strict=True):
            held = owners.get(f)
            if action == "release":
                if held is not None and held[0] == job:
                    del owners[f]
                elif held is not None:
                    owners[f] = (*held[:2], end)
                continue
            won = held is None or held[1] <= at or held[0] == job
            owners[f] = (job, float(at) + self.ttl, end) if won else (*held[:2], end)
            out.append((f, job, won))
        if owners:
            self.owners.update((_packed(fingerprint=list(owners), job_id=[o[0] for o in owners.values()], until=[o[1] for o in owners.values()], end=[o[2] for o in owners.values()]),))
        else:
            self.owners.clear()
        yield pd.DataFrame(out, columns=["fingerprint", "job_id", "won"])

    def close(self) -> None:
        pass


def uniq_stream(claims: DataFrame, ttl_seconds: int = WEEK) -> DataFrame:
    """claims(fingerprint, job_id, action claim/release, arrival in seconds): who won."""
    return _paged(claims, "fingerprint").transformWithStateInPandas(UniqProcessor(ttl_seconds), "fingerprint string, job_id string, won boolean", "Append", "ProcessingTime")


class Runs:
    """A set of integers as sorted runs of neighbours; costs follow the runs, not the members."""

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = list(starts or []), list(ends or [])  # inclusive

    def __len__(self) -> int:
        return len(self.starts)

    def _at(self, x: int) -> int:
        """The run that starts last at or before ``x``, or -1."""
        return bisect.bisect_right(self.starts, x) - 1

    def __contains__(self, x: int) -> bool:
        return (i := self._at(x)) >= 0 and x <= self.ends[i]

    def add(self, x: int) -> None:
        i = self._at(x)
        if i >= 0 and x <= self.ends[i]:
            return
        left, right = i >= 0 and self.ends[i] == x - 1, i + 1 < len(self) and self.starts[i + 1] == x + 1
        if left and right:
            self.ends[i] = self.ends.pop(i + 1)
            self.starts.pop(i + 1)
        elif left:
            self.ends[i] = x
        elif right:
            self.starts[i + 1] = x
        else:
            self.starts.insert(i + 1, x)
            self.ends.insert(i + 1, x)

    def remove(self, x: int) -> bool:
        i = self._at(x)
        if i < 0 or x > self.ends[i]:
            return False
        a, z = self.starts[i], self.ends[i]
        if a == z:
            del self.starts[i], self.ends[i]
        elif x == a:
            self.starts[i] = x + 1
        elif x == z:
            self.ends[i] = x - 1
        else:
            self.ends[i] = x - 1
            self.starts.insert(i + 1, x + 1)
            self.ends.insert(i + 1, z)
        return True

    def drop_below(self, x: int) -> int:
        """Without members below ``x``; how many they were."""
        i, gone = bisect.bisect_left(self.ends, x), 0
        gone = sum(z - a + 1 for a, z in zip(self.starts[:i], self.ends[:i], strict=True))
        del self.starts[:i], self.ends[:i]
        if self.starts and self.starts[0] < x:
            gone += x - self.starts[0]
            self.starts[0] = x
        return gone


COMMITS = "topic string, partition_id int, next_commit bigint, held bigint, room bigint, runs int"


class CommitProcessor(StatefulProcessor):
    """Per (topic, partition): runs of offsets that wait and of offsets done out of order, and the next one to commit.

    What ``offsets.commit_prefix`` computes over a whole log; a failed or pending offset blocks. An offset
    holds a place of the window from its dispatch until it is committed or fails; ``room`` says how
    many more may be dispatched. State and work follow the runs: an offset done in order leaves none.
    """

    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        runs = "array<bigint>"
        self.state = handle.getValueState("state", f"last bigint, next bigint, wait_from {runs}, wait_to {runs}, done_from {runs}, done_to {runs}, failed {runs}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, following, waiting, done, failed = -1, 0, Runs(), Runs(), set()
        if self.state.exists():
            last, following, a, b, c, d, e = self.state.get()
            waiting, done, failed = Runs(a, b), Runs(c, d), set(e)
        for r in pd.concat(list(rows)).sort_values(["offset", "arrival"], kind="stable").itertuples():
            offset = int(r.offset)
            known, last = offset <= last, max(last, offset)
            failed.discard(offset)
            if r.state != "done":
                waiting.add(offset)
                done.remove(offset)
                if r.state == "failed":
                    failed.add(offset)
            elif waiting.remove(offset) or not known:
                done.add(offset)  # what was committed before is done already
        following = waiting.starts[0] if len(waiting) else last + 1
        done.drop_below(following)
        inside = sum(z - a + 1 for r in (waiting, done) for a, z in zip(r.starts, r.ends, strict=True)) - len(failed)
        self.state.update((last, following, waiting.starts, waiting.ends, done.starts, done.ends, sorted(failed)))
        yield pd.DataFrame([(*key, following, inside, max(0, self.window - inside), len(waiting) + len(done))], columns=[c.split()[0] for c in COMMITS.split(", ")])

    def close(self) -> None:
        pass


def commit_stream(log: DataFrame, window: int = 1000) -> DataFrame:
    """log(topic, partition_id, offset, state, arrival): after every micro-batch the next offset to commit, the places held and left of the window, and the runs kept."""
    return log.groupBy("topic", "partition_id").transformWithStateInPandas(CommitProcessor(window), COMMITS, "Append", "None")


class RetryProcessor(StatefulProcessor):
    """Holds a message until its due time, then releases it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "job_id string, retry_to string, due bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        for r in pd.concat(list(rows)).itertuples():
            if r.due <= now:
                out.append((r.job_id, r.retry_to))
            else:
                self.held.appendValue((r.job_id, r.retry_to, int(r.due)))
                self.handle.registerTimer(int(r.due))
        yield pd.DataFrame(out, columns=["job_id", "retry_to"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = list(self.held.get())
        keep = [h for h in held if h[2] > now]
        self.held.put(keep) if keep else self.held.clear()
        yield pd.DataFrame([(h[0], h[1]) for h in held if h[2] <= now], columns=["job_id", "retry_to"])

    def close(self) -> None:
        pass


def retry_stream(messages: DataFrame) -> DataFrame:
    """messages(job_id, retry_to, due in epoch ms), released when due (processing time)."""
    return messages.groupBy("job_id").transformWithStateInPandas(RetryProcessor(), "job_id string, retry_to string", "Append", "ProcessingTime")


LIVE = "consumer_id bigint, state string, at timestamp"


class LivenessProcessor(StatefulProcessor):
    """Per consumer: up at a heartbeat after silence, down ``ttl`` seconds after the last one, by event time."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = (self.seen.get()[0] if self.seen.exists() else None), []
        before = last
        for ms in sorted(t.value // 1_000_000 for t in pd.concat(list(rows))["seen_at"]):
            if last is None or ms > last + 1000 * self.ttl:
                out += [] if last is None else [(key[0], "down", last + 1000 * self.ttl)]
                out.append((key[0], "up", ms))
            last = ms if last is None else max(last, ms)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + 1000 * self.ttl)
            self.handle.registerTimer(last + 1000 * self.ttl)
            self.seen.update((last,))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = self.seen.get()[0] + 1000 * self.ttl
        self.seen.clear()
        yield self._frame([(key[0], "down", end)])

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame({"consumer_id": pd.Series([r[0] for r in rows], dtype="int64"), "state": pd.Series([r[1] for r in rows], dtype="object"), "at": pd.to_datetime([r[2] for r in rows], unit="ms")})

    def close(self) -> None:
        pass


def liveness_stream(heartbeats: DataFrame, ttl: int = 180, late: str = "0 seconds") -> DataFrame:
    """heartbeats(consumer_id, seen_at timestamp): when consumers come up and go down.

    A down is known once the watermark, ``late`` behind the newest heartbeat of all, has passed it.
    """
    beats = heartbeats.select("consumer_id", "seen_at").withWatermark("seen_at", late)
    return beats.groupBy("consumer_id").transformWithStateInPandas(LivenessProcessor(ttl), LIVE, "Append", "EventTime")


def claim_stream(claims: DataFrame, heartbeats: DataFrame, ttl: int = 180, grace: int = 40, late: str = "0 seconds") -> DataFrame:
    """claims(job_id, consumer_id, owner, claimed_at, at): won, resumed, lost or steal, by who lived at the moment of the claim.

    ``owner`` and ``claimed_at`` are the working set's entry of the job as the claim met it, null where it had
    none. An owner lives if a heartbeat of its own lies within ``ttl`` seconds before the claim. Claims meet
    heartbeats in a stream-stream interval join, so both sides keep only what the watermarks leave open, and a claim
    that met several counts once.
    """
    beats = heartbeats.select(F.col("consumer_id").alias("live_id"), "seen_at").withWatermark("seen_at", late)
    asked = claims.withWatermark("at", late)
    near = (F.col("owner") == F.col("live_id")) & (F.col("seen_at") <= F.col("at")) & (F.col("seen_at") >= F.col("at") - F.expr(f"interval {ttl} seconds"))
    met = asked.join(beats, near, "left_outer")
    outcome = (
        F.when(F.col("owner").isNull(), "won").when(F.col("owner") == F.col("consumer_id"), "resumed")
        .when(F.col("live_id").isNotNull() | (F.col("claimed_at") > F.col("at") - F.expr(f"interval {grace} seconds")), "lost").otherwise("steal")
    )
    return met.select("job_id", "consumer_id", "owner", "at", outcome.alias("outcome")).dropDuplicatesWithinWatermark(["job_id", "consumer_id", "at"])


def throughput_stream(events: DataFrame, delay: str = "10 minutes", width: str = "60 seconds") -> DataFrame:
    """events(ts timestamp, status, field, n): finished buckets, late rows beyond ``delay`` dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "status", "field").agg(F.sum("n").alias("n")).select(F.col("window.start").alias("bucket"), "status", "field", "n")


class FieldCap:
    """The first ``cap`` field names over all micro-batches, kept as a small versioned table.

    Earlier micro-batches come first, and inside one the order of (ts, event_id). A micro-batch that
    runs again sees the names of earlier ones only, so it gives the same again.
    """

    def __init__(self, spark: SparkSession, path: str, cap: int = 50):
        self.names, self.cap = VersionedTable(spark, path, "field string, epoch bigint", ["field"], 1), cap

    def apply(self, batch: DataFrame, epoch: int) -> DataFrame:
        """``batch``(field, ts, event_id, ...) with its names, those beyond the cap as _other."""
        named, known = metrics.named_field(batch), self.names.read().where(F.col("epoch") < epoch)
        left = self.cap - known.count()
        if left > 0:
            self.names.upsert(metrics.first_seen(named, known, left).withColumn("epoch", F.lit(epoch).cast("bigint")), ["epoch"])
        return metrics.others(named, self.names.read().where(F.col("epoch") <= epoch))


def route_each(stream: DataFrame, split: Callable[[DataFrame], dict[str, DataFrame]], sink: Callable[[str, DataFrame], None], checkpoint: str, paused: Callable[[], DataFrame] | None = None, group: str = ""):
    """Start a query that splits every micro-batch into named relations and hands them to a sink.

    The micro-batch is persisted while its branches are written. ``paused`` gives the pauses
    (group, topic, partition_id; -1 for a whole topic) anew for every micro-batch: a kill switch
    (``control.PauseSwitch``), or the topics that a priority gate holds back. Records that pauses of the
    consumer ``group`` hold go to the sink as "held" and nowhere else.
    """
    from ..operators import control

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            free = batch
            if paused is not None:
                now = paused()
                free = control.consumed(batch, now, F.lit(group))
                sink("held", control.held(batch, now, F.lit(group)))
            for name, rows in split(free).items():
                sink(name, rows)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Subscribers:
    """Receivers of events; one that raises disturbs neither the others nor the job."""

    def __init__(self) -> None:
        self.receivers: dict[int, Callable[[dict], None]] = {}
        self.given = 0

    def add(self, fn: Callable[[dict], None] | None) -> Callable[[], None]:
        """Add a receiver; what is returned removes it, once or more often."""
        if fn is None:
            return lambda: None
        self.given += 1
        number = self.given
        self.receivers[number] = fn
        return lambda: self.receivers.pop(number, None) and None

    def replace(self, fn: Callable[[dict], None] | None) -> None:
        """``fn`` alone from now on; none clears all."""
        self.receivers = {}
        self.add(fn)

    def emit(self, event: dict) -> int:
        """Hand a copy to every receiver; how many took it."""
        took = 0
        for fn in list(self.receivers.values()):
            with contextlib.suppress(Exception):  # a receiver's error is its own
                fn(dict(event))
                took += 1
        return took

    def deliver(self, events: DataFrame) -> DataFrame:
        """``events`` handed to the receivers where they lie, batch by batch, with ``delivered``."""
        everyone = Subscribers()
        everyone.receivers = dict(self.receivers)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(delivered=[everyone.emit(e) for e in b.to_dict("records")])

        return events.mapInPandas(each, T.StructType([*events.schema.fields, T.StructField("delivered", T.IntegerType())]))


class Callbacks:
    """Batch callbacks by class name. An unknown class is only noted; an error parks the callback."""

    SCHEMA = "batch_id bigint, method string, class_name string, result string, dlt_type string, dlt_error_message string"

    def __init__(self) -> None:
        self.by_class: dict[str, Callable] = {}

    def register(self, class_name: str, fn: Callable[[str, dict], None]) -> None:
        """``fn(method, callback)`` for callbacks of a class."""
        self.by_class[class_name] = fn

    def invoke(self, callbacks: DataFrame) -> DataFrame:
        """callbacks(batch_id, outcome, on_success, on_complete), claimed before: what became of each."""
        from ..operators import routing

        table, names = dict(self.by_class), [c.split()[0] for c in self.SCHEMA.split(", ")]

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for cb in b.to_dict("records"):
                    fn, head = table.get(cb["class_name"]), (cb["batch_id"], cb["method"], cb["class_name"])
                    if fn is None:
                        out.append((*head, "noted", None, None))
                        continue
                    try:
                        fn(cb["method"], cb)
                        out.append((*head, "invoked", None, None))
                    except Exception as e:  # parked, not raised: other callbacks go on
                        out.append((*head, "parked", "callback_error", str(e)))
                yield pd.DataFrame(out, columns=names)

        rows = routing.callback_target(callbacks).select("batch_id", "outcome", "on_success", "on_complete", "method", "class_name")
        return rows.mapInPandas(each, self.SCHEMA)


class HandlerError(Exception):
    """A job's error with a class of its own."""

    def __init__(self, error_class: str, message: str):
        super().__init__(message)
        self.error_class = error_class or "GoExecutionError"


class Handlers:
    """Registry of job handlers; running them is one Arrow-batched pass, and errors are result rows."""

    def __init__(self) -> None:
        self.by_type: dict[str, Callable] = {}
        self.exhausted: dict[str, Callable[[dict], None]] = {}

    def register(self, job_type: str, fn: Callable) -> None:
        if job_type in self.by_type:
            raise ValueError(f"{job_type} has a handler")
        self.by_type[job_type] = fn

    def on_exhausted(self, job_type: str, fn: Callable[[dict], None]) -> None:
        """``fn(summary)`` once for every job of the type that has no retry left, before its dead letter."""
        self.exhausted[job_type] = fn

    def run_exhausted(self, failed: DataFrame) -> DataFrame:
        """Run the hooks over ``routing.on_failure`` rows that are exhausted: job_id and whether a hook ran.

        A hook that raises has run; its error goes no further.
        """
        table = {k: fn for k, fn in self.exhausted.items() if k in self.by_type}
        cols = [c for c in ("job_id", "job_type", "worker_class", "batch_id", "tenant_id", "payload", "attempt", "max_retries", "batch_counted", "error_name", "error_message") if c in failed.columns]

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                ran = []
                for summary in b.to_dict("records"):
                    fn = table.get(summary["job_type"])
                    ran.append(fn is not None)
                    if fn is not None:
                        with contextlib.suppress(Exception):  # best effort
                            fn(summary)
                yield pd.DataFrame({"job_id": b["job_id"], "hook_ran": ran})

        return failed.where("exhausted").select(*cols).mapInPandas(each, "job_id string, hook_ran boolean")

    def run(self, jobs: DataFrame) -> DataFrame:
        """jobs(job_id, job_type, payload) with ok, error_class and error_message."""
        table = dict(self.by_type)

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for job, kind, payload in zip(b["job_id"], b["job_type"], b["payload"], strict=True):
                    fn = table.get(kind)
                    if fn is None:
                        out.append((job, False, "UnknownHandler", f"no handler for {kind}"))
                        continue
                    try:
                        fn(payload)
                        out.append((job, True, None, None))
                    except Exception as e:  # a handler's error is data
                        out.append((job, False, getattr(e, "error_class", "GoExecutionError"), str(e)))
                yield pd.DataFrame(out, columns=["job_id", "ok", "error_class", "error_message"])

        return jobs.select("job_id", "job_type", "payload").mapInPandas(each, "job_id string, ok boolean, error_class string, error_message string")

"""Continuous forms give what the batch forms give."""

import datetime as dt
import json
import math
import random
import time
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from batchloom.operators import control, ledger, metrics, offsets, routing, schedule
from batchloom.sources import sinks
from batchloom.sources.bridge import Relations
from batchloom.streaming import fair as fair_queue
from batchloom.streaming import jobs

from .test_cases import any_batches, tables


def drained(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    q.stop()
    return stream.sparkSession.table(name)


def staged(spark, tmp_path, name, *parts):
    """A stream of one micro-batch per part, in order."""
    path = str(tmp_path / name)
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1 if i + 1 < len(parts) else 0)  # files are read by time
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_ledger_stream(spark, tmp_path):
    """The stream's last counters, statuses and callbacks are those of the fold, over sealed, open, empty and cancelled batches."""
    batches = any_batches()
    ev, rows = tables(spark, batches)
    both = ev.join(rows, "batch_id")
    out = drained(jobs.ledger_stream(staged(spark, tmp_path, "in", both.where("arrival <= 2"), both.where("arrival > 2"))), tmp_path, "ledger_out").collect()
    want = {r.batch_id: r for r in ledger.fold(ev, rows).collect()}
    last = {}
    for r in out:
        if r.callback is None:
            last[r.batch_id] = max(last.get(r.batch_id, (0, 0, 0)), (r.touched, r.completed, r.failed))
    assert last == {b: (want[b].touched, want[b].completed, want[b].failed) for b, v in batches.items() if v[1]}
    fired = sorted((r.batch_id, r.callback) for r in out if r.callback)
    assert fired == sorted((r.batch_id, r.kind) for r in ledger.callbacks(ledger.fold(ev, rows)).collect())
    ended = {r.batch_id: r.status for r in out if r.callback is None and (r.touched, r.completed, r.failed) == last[r.batch_id]}
    assert all(ended[b] == want[b].status for b in ended)


def test_ledger_state_expires(spark, tmp_path):
    """After the time to live a batch is as new, and its events count again."""
    ev = spark.createDataFrame([(1, 1, "success", 1, 2, True, "running")], "batch_id bigint, batch_seq bigint, op string, arrival int, total_jobs bigint, sealed boolean, status string")
    path, check = str(tmp_path / "in"), str(tmp_path / "check")

    def run(name):
        ev.coalesce(1).write.mode("append").parquet(path)
        stream = jobs.ledger_stream(spark.readStream.schema(ev.schema).parquet(path), ttl=3)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run("a") == 1
    first = spark.read.parquet(str(tmp_path / "out")).collect()
    time.sleep(4)
    run("b")  # timers fire after a micro-batch's rows, so this one still meets the old state or clears it
    time.sleep(4)
    run("c")
    assert [r.touched for r in first] == [1] and {r.touched for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1}


def test_commit_stream(spark, sf, tmp_path):
    log = Relations(spark, sf).log.select("topic", "partition_id", "offset", "state")
    seen = log.withColumn("state", F.when(F.col("state") == "done", "pending").otherwise(F.col("state"))).withColumn("arrival", F.lit(1))
    done = log.where("state = 'done'").withColumn("arrival", F.lit(2))
    out = drained(jobs.commit_stream(staged(spark, tmp_path, "log", seen, done)), tmp_path, "commit_out").collect()
    want = {(r.topic, r.partition_id): r.next_commit for r in offsets.commit_prefix(log).collect()}
    got = {}
    for r in out:
        got[r.topic, r.partition_id] = max(got.get((r.topic, r.partition_id), 0), r.next_commit)
    assert got == want


def test_commit_window_and_runs(spark, tmp_path):
    """State follows runs: a batch dispatched at once and done in order leaves one run, then none."""
    cols = "topic string, partition_id int, offset bigint, state string, arrival int"
    part = lambda n, rows: spark.createDataFrame([("t", 0, o, s, n) for o, s in rows], cols)
    steps = [
        [(o, "pending") for o in range(100, 200)], [(o, "done") for o in range(100, 150)], [(o, "done") for o in range(151, 199, 2)], [(150, "failed")], [(150, "done"), (120, "done")],
        [(o, "done") for o in range(152, 200, 2)] + [(199, "done"), (300, "done")],
    ]
    out = drained(jobs.commit_stream(staged(spark, tmp_path, "w", *[part(i, rows) for i, rows in enumerate(steps)]), window=120), tmp_path, "commit_runs").collect()
    assert [(r.next_commit, r.held, r.room, r.runs) for r in out] == [(100, 100, 20, 1), (150, 50, 70, 1), (150, 50, 70, 49), (150, 49, 71, 49), (152, 48, 72, 47), (301, 0, 120, 0)]


def test_runs_equal_a_set():
    rng = random.Random(6)
    runs, plain = jobs.Runs(), set()
    for _ in range(4_000):
        x = rng.randrange(60)
        if rng.random() < 0.5:
            runs.add(x), plain.add(x)
        else:
            assert runs.remove(x) == (x in plain)
            plain.discard(x)
        if rng.random() < 0.01:
            low = rng.randrange(60)
            assert runs.drop_below(low) == sum(p < low for p in plain)
            plain = {p for p in plain if p >= low}
        got = [y for a, z in zip(runs.starts, runs.ends, strict=True) for y in range(a, z + 1)]
        assert got == sorted(plain) and all(b - a > 1 for a, b in zip(runs.ends, runs.starts[1:], strict=False)) and (x in runs) == (x in plain)


T0 = dt.datetime(2024, 1, 1)


def seconds(n):
    return T0 + dt.timedelta(seconds=n)


def test_liveness_stream(spark, tmp_path):
    """Ups at once, downs when the watermark has passed them; a late beat within the time to live keeps a consumer up."""
    beats = lambda *rows: spark.createDataFrame([(c, seconds(s)) for c, s in rows], "consumer_id bigint, seen_at timestamp")
    parts = [beats((1, 0), (2, 0)), beats((1, 150), (1, 300)), beats((2, 400), (3, 400)), beats((3, 1_000))]
    out = drained(jobs.liveness_stream(staged(spark, tmp_path, "hb", *parts), ttl=180), tmp_path, "live_out").collect()
    got = sorted((r.consumer_id, int((r.at - T0).total_seconds()), r.state) for r in out)
    want = [(1, 0, "up"), (1, 480, "down"), (2, 0, "up"), (2, 180, "down"), (2, 400, "up"), (3, 400, "up"), (3, 580, "down"), (3, 1_000, "up")]
    assert [w for w in want if w not in got] in ([], [(1, 480, "down")], [(2, 580, "down")]) and set(got) <= {*want, (2, 580, "down")}


def test_claim_stream_equals_claim_outcome(spark, tmp_path):
    rng = random.Random(8)
    beats = [(c, s) for c in range(6) for s in range(0, 3_000, 60) if rng.random() < 0.35 or s > 2_900]
    claims = []
    for i in range(60):
        at = rng.randrange(200, 2_500)
        owner = rng.choice([None, *range(6)])
        claims.append((f"j{i}", rng.randrange(6), owner, None if owner is None else seconds(at - rng.randrange(0, 90)), seconds(at)))
    hb = spark.createDataFrame([(c, seconds(s)) for c, s in beats] + [(99, seconds(100_000))], "consumer_id bigint, seen_at timestamp")
    cl = spark.createDataFrame([*claims, ("end", 99, None, None, seconds(100_000))], "job_id string, consumer_id bigint, owner bigint, claimed_at timestamp, at timestamp")
    again = lambda df, c: df.where(F.col(c) == F.lit(seconds(100_000))).withColumn(c, F.lit(seconds(200_000)))
    old = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    try:
        out = drained(jobs.claim_stream(staged(spark, tmp_path, "cl", cl, again(cl, "at"), again(cl, "at")), staged(spark, tmp_path, "hb", hb, again(hb, "seen_at"), again(hb, "seen_at"))), tmp_path, "claims_out").collect()
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", old)
    got = {r.job_id: r.outcome for r in out if r.job_id != "end"}
    want = {}
    for job, consumer, owner, claimed, at in claims:  # each against the heartbeats that came before it
        now = F.lit(at)
        live = schedule.live_consumers(spark.createDataFrame([(c, seconds(s)) for c, s in beats if seconds(s) <= at] or [(-1, T0)], "consumer_id bigint, seen_at timestamp"), now)
        row = spark.createDataFrame([(job, consumer)], "job_id string, consumer_id bigint")
        workset = spark.createDataFrame([(job, owner, claimed)] if owner is not None else [], "job_id string, consumer_id bigint, claimed_at timestamp")
        want[job] = (row, workset, live, now)
    alive = lambda owner, at: any(seconds(s) <= at <= seconds(s) + dt.timedelta(seconds=180) for c, s in beats if c == owner)
    plain = {j: "won" if o is None else "resumed" if o == c else "lost" if alive(o, at) or claimed > at - dt.timedelta(seconds=40) else "steal" for j, c, o, claimed, at in claims}
    assert got == plain and set(plain.values()) == {"won", "resumed", "lost", "steal"}
    for job in list(want)[:6]:
        assert schedule.claim_outcome(*want[job]).first().outcome == plain[job]


def test_field_cap_equals_the_batch_form(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f" f{rng.randrange(14)} " if rng.random() < 0.9 else "", seconds(i), i) for i in range(300)]
    cap, seen = jobs.FieldCap(spark, f"file://{tmp_path}/names", 6), []
    schema = "field string, ts timestamp, event_id bigint"
    for epoch in range(6):
        part = spark.createDataFrame(rows[50 * epoch : 50 * epoch + 50], schema)
        got = sorted((r.event_id, r.field) for r in cap.apply(part, epoch).collect())
        assert got == sorted((r.event_id, r.field) for r in cap.apply(part, epoch).collect())  # run again
        seen += got
        assert sorted(seen) == sorted((r.event_id, r.field) for r in metrics.capped_field(spark.createDataFrame(rows[: 50 * epoch + 50], schema), 6).collect())
    assert {f for _, f in seen} >= {"_other", "_all"}


def test_lag_gate_fails_open_and_keeps_its_last_reading(spark):
    topics = spark.createDataFrame([("g", "high", 0), ("g", "low", 1), ("h", "low", 1)], "group string, topic string, rank int")
    lag, at, fails = [("g", "high", 5)], [0.0], [True]

    def read():
        if fails[0]:
            raise OSError("no broker")
        return spark.createDataFrame(lag, "group string, topic string, lag bigint")

    gate, none = control.LagGate(read, 2, lambda: at[0]), spark.createDataFrame([], control.PAUSES)
    yields = lambda paused=none, **k: {(r.group, r.topic) for r in gate.must_yield(topics, paused, **k).collect() if r.must_yield}
    assert yields() == set()  # never read
    fails[0] = False
    assert yields() == {("g", "low")}
    assert yields(spark.createDataFrame([("g", "high", -1)], control.PAUSES)) == set() == yields(spark.createDataFrame([("g", "high", -1), ("g", "high", 3)], control.PAUSES))
    assert yields(spark.createDataFrame([("h", "high", -1), ("g", "high", 3)], control.PAUSES)) == {("g", "low")}
    lag[:] = [("g", "high", 0)]
    assert yields() == {("g", "low")}  # not yet time to read again
    fails[0], at[0] = True, 10.0
    assert yields() == {("g", "low")}  # a failed reading
    fails[0] = False
    assert yields(force=True) == set()


def fair(spark, tmp_path, name, rows, **settings):
    """Results of actions (tenant, job, action, duration, arrival) on one lane with weights a 1, b 2."""
    acts = spark.createDataFrame([("l", t, 2.0 if t == "b" else 1.0, j, a, d, float(at)) for t, j, a, d, at in rows], "lane string, tenant_id string, weight double, job_id string, action string, duration double, arrival double")
    out = drained(fair_queue.fair_stream(staged(spark, tmp_path, name, acts), **settings), tmp_path, name).collect()
    return [(r.tenant_id, r.job_id, r.result) for r in out]


def test_fair_lifecycle(spark, tmp_path):
    put = [("a", f"a{i}", "enqueue", 0.0, i) for i in range(3)] + [("b", f"b{i}", "enqueue", 0.0, i + 0.5) for i in range(3)]
    take = lambda at: ("", "", "checkout", 0.0, at)
    # a budget of one lease: the second checkout waits for completion; an aborted job goes to its tenant's tail
    got = fair(spark, tmp_path, "budget", [*put, take(10), take(11), ("", "a0", "confirm", 0.0, 12), ("", "a0", "complete", 1.0, 13), take(14), ("", "b0", "abort", 0.0, 15), take(16)], budget=1)
    assert [x[1] for x in got] == ["a0", "b0", "b1"]
    # a confirmed job whose lease ends gives its place back; a renewed one keeps it
    got = fair(spark, tmp_path, "lapse", [*put, take(10), ("", "a0", "confirm", 0.0, 11), take(69), take(71)], budget=1, lease=60)
    assert [x[1] for x in got] == ["a0", "b0"]
    got = fair(spark, tmp_path, "renew", [*put, take(10), ("", "a0", "confirm", 0.0, 11), ("", "a0", "renew", 0.0, 60), take(71), take(121)], budget=1, lease=60)
    assert [x[1] for x in got] == ["a0", "b0"]
    # what is still being forwarded does not lapse
    assert [x[1] for x in fair(spark, tmp_path, "stay", [*put, take(10), take(500)], budget=1, lease=60)] == ["a0"]
    # the time lane charges at completion
    got = fair(spark, tmp_path, "time", [*put, take(10), ("", "a0", "complete", 5.0, 11), take(12), take(13)], time_lane=True)
    assert [x[1] for x in got] == ["a0", "b0", "b1"]


def plain_lane(actions, time_lane=False, window=100, budget=0, lease=1800, debounce=15):
    """The rules of a lane over plain dictionaries, everything looked at in every action."""
    ring, slots, idle, out = {}, {}, None, []
    for action, tenant, job, weight, duration, now in actions:
        slots = {j: s for j, s in slots.items() if s[1] > now or s[2]}
        if idle is not None and now - idle >= debounce:
            for t in ring.values():
                t[0] = 0.0
        if action == "enqueue":
            t = ring.setdefault(tenant, [0.0, weight, []])
            if len(t[2]) >= window:
                out.append((tenant, job, "rejected"))
            else:
                if not t[2]:
                    t[0] = max([t[0], *([min(x[0] for x in ring.values() if x[2])] if any(x[2] for x in ring.values()) else [])])
                t[2].append(job)
        elif action == "checkout":
            ready, load = sorted((t[0], k) for k, t in ring.items() if t[2]), Counter(s[0] for s in slots.values())
            if budget and len(slots) >= budget:
                ready = []
            whole = sum(t[1] for k, t in ring.items() if t[2] or load[k]) or 1.0
            ready = ready[: max(60, 3 * budget)] if budget else ready
            below = [k for _, k in ready if not budget or load[k] < max(1, math.floor(budget * ring[k][1] / whole))]
            if ready:
                who = (below or [ready[0][1]])[0]
                job = ring[who][2].pop(0)
                ring[who][0] += 0 if time_lane else 1 / ring[who][1]
                slots[job] = [who, now + max(60, lease), True]
                out.append((who, job, "checked_out"))
        elif job in slots:
            who = slots[job][0]
            if action == "confirm":
                slots[job][2] = False
            elif action == "renew":
                slots[job][1] = now + max(60, lease)
            elif action == "abort" and slots[job][2]:
                del slots[job]
                ring[who][2].append(job)
                ring[who][0] -= 0 if time_lane else 1 / ring[who][1]
            elif action == "complete":
                del slots[job]
                ring[who][0] += duration / ring[who][1] if time_lane else 0
        quiet = not slots and not any(t[2] for t in ring.values())
        idle = (now if idle is None else idle) if quiet else None
    return out


def stores():
    """State of a lane in dictionaries that outlive micro-batches."""
    data = {k: {} for k in ("tenants", "jobs", "slots", "ring", "ends")}
    return data, lambda: {k: fair_queue.Cached(d.get, d.__setitem__, lambda key, d=d: d.pop(key, None)) for k, d in data.items()}


@pytest.mark.parametrize("seed", range(12))
def test_paged_lane_equals_the_plain_one(seed):
    rng = random.Random(seed)
    settings = {"time_lane": seed % 2 == 1, "window": rng.choice([3, 100]), "budget": rng.choice([0, 0, 2, 9]), "lease": 60, "debounce": rng.choice([2, 15])}
    names, actions, live, now, out = [f"t{i}" for i in range(rng.choice([3, 200]))], [], [], 0.0, []
    _, fresh = stores()
    head, ring, ends = None, [], []
    for n in range(1_500):
        if n % 100 == 0:  # a micro-batch
            s = fresh()
            lane = fair_queue.Lane(head, ring, ends, s, *settings.values())
        now += rng.choice([0, 0.1, 1, 1, 5, 40 if rng.random() < 0.05 else 1])
        kind = rng.choice(["enqueue"] * 5 + ["checkout"] * 4 + ["confirm", "renew", "abort", "complete", "complete"])
        job = f"j{n}" if kind == "enqueue" else rng.choice(live[-8:]) if live and rng.random() < 0.8 else f"j{rng.randrange(n + 1)}"
        t = rng.choice(names)
        actions.append((kind, t, job, float(1 + len(t) % 3), rng.choice([0.5, 2.0]), now))
        if (got := lane.play(*actions[-1])) is not None:
            out.append(got)
            live += [got[1]] if got[2] == "checked_out" else []
        if n % 100 == 99:
            for x in s.values():
                x.flush()
            head, ring, ends = (lane.era, lane.slots, lane.weight, lane.idle), lane.ring.root, lane.ends.root
    assert out == plain_lane(actions, **settings) and sum(r[2] == "checked_out" for r in out) > 50


def test_a_lane_reads_what_its_actions_touch():
    """With 20,000 waiting tenants a micro-batch of ten actions reads a few dozen entries of state."""
    _, fresh = stores()
    s = fresh()
    lane = fair_queue.Lane(None, [], [], s, False, 100, 0, 1800, 15)
    for i in range(20_000):
        lane.play("enqueue", f"t{i:05}", f"j{i}", 1.0, 0.0, float(i))
    for x in s.values():
        x.flush()
    s = fresh()
    again = fair_queue.Lane((lane.era, lane.slots, lane.weight, lane.idle), lane.ring.root, lane.ends.root, s, False, 100, 0, 1800, 15)
    got = [again.play(*a) for a in [("checkout", "", "", 1.0, 0.0, 30_000.0)] * 5 + [("enqueue", f"n{i}", f"n{i}", 1.0, 0.0, 30_001.0) for i in range(5)]]
    assert [r[0] for r in got[:5]] == [f"t{i:05}" for i in range(5)]
    assert sum(x.reads for x in s.values()) < 60 and len(lane.ring.root) < 400


def test_idle_lane_forgets_virtual_times(spark, tmp_path):
    def turn(pause, end=("", "a0", "complete", 0.0, 3)):
        rows = [("a", "a0", "enqueue", 0.0, 1), ("", "", "checkout", 0.0, 2), end, ("a", "a1", "enqueue", 0.0, 3 + pause), ("b", "b1", "enqueue", 0.0, 3.1 + pause), ("", "", "checkout", 0.0, 4 + pause)]
        return fair(spark, tmp_path, f"idle{pause}{end[2]}", rows)[-1][1]

    assert turn(5) == "a1"  # b starts at the ring's least time, a's: equal times go by name
    rows = [("a", "a0", "enqueue", 0.0, 1), ("", "", "checkout", 0.0, 2), ("", "a0", "complete", 0.0, 3)]
    late = [("b", "b1", "enqueue", 0.0, 10), ("a", "a1", "enqueue", 0.0, 10.1), ("", "", "checkout", 0.0, 11)]
    assert fair(spark, tmp_path, "busy", rows + late)[-1][1] == "b1"  # 7 idle seconds: a still has its time of 1
    later = [(t, j, k, d, at + 10) for t, j, k, d, at in late]
    assert fair(spark, tmp_path, "quiet", rows + later)[-1][1] == "a1"  # 17 idle seconds: a starts anew
    held = [("a", "a0", "enqueue", 0.0, 1), ("", "", "checkout", 0.0, 2)]
    assert fair(spark, tmp_path, "held", held + later)[-1][1] == "b1"  # a job being forwarded keeps the lane awake


def test_retry_stream(spark, tmp_path):
    """What is due goes at once, what is not is held and goes when its time has come."""
    now = int(time.time() * 1000)
    rows = spark.createDataFrame([("due", "t1", now - 1000), ("soon", "t2", now + 6000), ("late", "t3", now + 3_600_000)], "job_id string, retry_to string, due bigint")
    path = str(tmp_path / "in")
    rows.coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    q = jobs.retry_stream(spark.readStream.schema(rows.schema).parquet(path)).writeStream.format("memory").queryName("retry_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            if spark.table("retry_out").count() == 1 and time.time() * 1000 < now + 6000:
                assert [r.job_id for r in spark.table("retry_out").collect()] == ["due"]
            if spark.table("retry_out").count() == 2:
                break
            time.sleep(1)
        assert {(r.job_id, r.retry_to) for r in spark.table("retry_out").collect()} == {("due", "t1"), ("soon", "t2")} and time.time() * 1000 >= now + 6000
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def test_uniq_and_fair_streams(spark, tmp_path):
    claims = spark.createDataFrame([("f", "a", "claim", 1.0), ("f", "b", "claim", 2.0), ("f", "a", "release", 3.0), ("f", "b", "claim", 4.0)], "fingerprint string, job_id string, action string, arrival double")
    claims.coalesce(1).write.parquet(str(tmp_path / "u"))
    got = drained(jobs.uniq_stream(spark.readStream.schema(claims.schema).parquet(str(tmp_path / "u"))), tmp_path, "uniq_out").collect()
    assert [(r.job_id, r.won) for r in got] == [("a", True), ("b", False), ("b", True)]
    rows = [("l", t, 1.0, f"{t}{i}", "enqueue", 0.0, float(i)) for t in "ab" for i in range(6)] + [("l", "a", 1.0, "", "checkout", 0.0, 100.0 + i) for i in range(4)]
    acts = spark.createDataFrame(rows, "lane string, tenant_id string, weight double, job_id string, action string, duration double, arrival double")
    acts.coalesce(1).write.parquet(str(tmp_path / "f"))
    got = drained(fair_queue.fair_stream(spark.readStream.schema(acts.schema).parquet(str(tmp_path / "f"))), tmp_path, "fair_out").collect()
    assert [r.tenant_id for r in got] == ["a", "b", "a", "b"]


def test_throughput_stream(spark, sf, tmp_path):
    ev = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"), F.lit("x").alias("field"), F.lit(1).cast("bigint").alias("n"))
    ev.coalesce(1).write.parquet(str(tmp_path / "t"))
    out = drained(jobs.throughput_stream(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "t")), width="1 hour"), tmp_path, "thr_out", "update")
    assert out.agg(F.sum("n")).first()[0] == ev.count()


def test_handlers(spark):
    h = jobs.Handlers()
    h.register("ok", lambda payload: None)
    h.register("bad", lambda payload: 1 / 0)
    with pytest.raises(ValueError):
        h.register("ok", print)
    got = {r.job_id: (r.ok, r.error_class) for r in h.run(spark.createDataFrame([("1", "ok", ""), ("2", "bad", ""), ("3", "none", "")], "job_id string, job_type string, payload string")).collect()}
    assert got == {"1": (True, None), "2": (False, "GoExecutionError"), "3": (False, "UnknownHandler")}


def noting(path, fail=False):
    """A callable that leaves a file for each value it is given; workers have no other way to tell."""

    def note(*args):
        with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
            f.write(json.dumps(args, default=str))
        if fail:
            raise RuntimeError("no")

    return note


def notes(path):
    return sorted((json.loads(p.read_text()) for p in path.iterdir()), key=str)


def test_exhausted_hook(spark, tmp_path):
    h = jobs.Handlers()
    for kind in ("a", "b", "c"):
        h.register(kind, print)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    h.on_exhausted("a", noting(str(tmp_path / "a")))
    h.on_exhausted("b", noting(str(tmp_path / "b"), fail=True))
    h.on_exhausted("none", noting(str(tmp_path / "a")))  # no handler of that type here
    rows = [("1", "a", 3, 3), ("2", "a", 1, 3), ("3", "b", 9, 3), ("4", "c", 9, 3), ("5", "none", 9, 3)]
    failed = spark.createDataFrame(rows, "job_id string, job_type string, attempt int, max_retries int").selectExpr("*", "5L as batch_id", "1L as batch_seq", "false as batch_counted", "cast(null as string) as error_class")
    got = {r.job_id: r.hook_ran for r in h.run_exhausted(routing.on_failure(failed)).collect()}
    assert got == {"1": True, "3": True, "4": False, "5": False}
    assert [n[0]["job_id"] for n in notes(tmp_path / "a")] == ["1"] and notes(tmp_path / "a")[0][0]["error_name"] == "GoExecutionError" and len(notes(tmp_path / "b")) == 1


def test_handler_errors(spark):
    h = jobs.Handlers()

    def over(payload):
        raise jobs.HandlerError("Overloaded", "busy")

    h.register("over", over)
    assert h.run(spark.createDataFrame([("1", "over", "")], "job_id string, job_type string, payload string")).first()[1:] == (False, "Overloaded", "busy")


def test_subscribers(spark, tmp_path):
    s, got = jobs.Subscribers(), []
    remove = s.add(got.append)
    s.add(lambda e: 1 / 0)
    assert s.emit({"event": "job.failed"}) == 1 and got == [{"event": "job.failed"}]
    remove(), remove()
    assert s.emit({}) == 0 and len(got) == 1
    (tmp_path / "n").mkdir()
    s.replace(noting(str(tmp_path / "n")))
    events = spark.createDataFrame([("a", 1), ("b", 2)], "event string, n int")
    assert {tuple(r) for r in s.deliver(events).collect()} == {("a", 1, 1), ("b", 2, 1)} and len(notes(tmp_path / "n")) == 2
    s.replace(None)
    assert s.emit({}) == 0 and s.add(None)() is None


def test_callbacks(spark, tmp_path):
    c = jobs.Callbacks()
    (tmp_path / "ok").mkdir()
    c.register("Done", noting(str(tmp_path / "ok")))
    c.register("Broken", lambda method, cb: 1 / 0)
    rows = [(1, "success", "Done", "Other"), (2, "complete", "Done", "Broken"), (3, "success", "", "Done"), (4, "success_only", "Nobody", None)]
    got = {r.batch_id: (r.method, r.class_name, r.result, r.dlt_type) for r in c.invoke(spark.createDataFrame(rows, "batch_id bigint, outcome string, on_success string, on_complete string")).collect()}
    assert got == {1: ("on_success", "Done", "invoked", None), 2: ("on_complete", "Broken", "parked", "callback_error"), 3: ("on_complete", "Done", "invoked", None), 4: ("on_success", "Nobody", "noted", None)}
    assert sorted((m, cb["batch_id"]) for m, cb in notes(tmp_path / "ok")) == [("on_complete", 3), ("on_success", 1)]


def test_kill_switch(spark, tmp_path):
    log = spark.createDataFrame([("t", p, o) for p in range(3) for o in range(4)] + [("u", 0, 0)], "topic string, partition_id int, offset bigint")
    log.write.parquet(str(tmp_path / "l"))
    seen = {}
    pauses = spark.createDataFrame([("g", "t", 1), ("g", "u", -1), ("other", "t", -1)], "group string, topic string, partition_id int")
    q = jobs.route_each(spark.readStream.schema(log.schema).parquet(str(tmp_path / "l")), lambda b: {"all": b}, lambda n, df: seen.__setitem__(n, seen.get(n, 0) + df.count()), str(tmp_path / "ck"), lambda: pauses, "g")
    q.awaitTermination(60)
    assert seen == {"held": 5, "all": 8}


def test_produce(spark, tmp_path):
    """A failed chunk ends its task's writes; what was written is counted."""
    rows = spark.range(0, 1200, 1, 2).selectExpr("id", "'t' || id % 3 as topic")
    assert tuple(sinks.produced(sinks.produce(rows, lambda part: None)).first()) == (1200, 1200, 0, None)
    assert sinks.produce(rows, lambda part: None).count() == 4  # two tasks of 600 records

    def breaks(part):
        if (part["id"] == 550).any():
            raise OSError("broker gone")
        return len(part)

    assert tuple(sinks.produced(sinks.produce(rows, breaks)).first()) == (1200, 1100, 100, "broker gone")
    assert tuple(sinks.produced(sinks.produce(rows, lambda part: 10)).first()) == (1200, 20, 1180, "partial write")
    assert tuple(sinks.produced(sinks.produce(rows.limit(0), lambda part: None)).first()) == (0, 0, 0, None)
    sinks.to_topics(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).groupBy("topic").count().count() == 3


def test_route_each(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "r"))
    seen = {}
    q = jobs.route_each(spark.readStream.schema("id bigint").parquet(str(tmp_path / "r")), lambda b: {"even": b.where("id % 2 = 0"), "odd": b.where("id % 2 = 1")}, lambda n, df: seen.__setitem__(n, df.count()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == {"even": 5, "odd": 5}

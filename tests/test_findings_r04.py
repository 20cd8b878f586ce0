"""Findings of round 4: a fair lane's work must not be a call of the store for every entry."""

import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from batchloom.sources import log
from batchloom.streaming import fair, replay

from .test_findings_r03 import spread
from .test_streaming import plain_lane


class State:
    """A value or a map of a processor's state in this process, with the calls that it got."""

    calls = 0

    def __init__(self):
        self.kept = {}

    def _seen(self, out=None):
        State.calls += 1
        return out

    def exists(self):
        return self._seen(None in self.kept)

    def get(self):
        return self._seen(self.kept[None])

    def update(self, value):
        self.kept[None] = self._seen(value)

    def containsKey(self, key):
        return self._seen(key in self.kept)

    def getValue(self, key):
        return self._seen(self.kept[key])

    def updateValue(self, key, value):
        self.kept[key] = self._seen(value)

    def removeKey(self, key):
        self._seen(self.kept.pop(key))


class Handle:
    def getValueState(self, name, schema):
        return State()

    getMapState = lambda self, name, key, value: State()


def played(processor, actions):
    """A micro-batch: results of actions (action, tenant, job, weight, duration, arrival) of one lane, which come in two packs and out of order."""
    shuffled = [a for a in actions if len(a[2] or "") % 2] + [a for a in actions if not len(a[2] or "") % 2]
    rows = pa.RecordBatch.from_pylist([{"lane": "l"} | dict(zip(fair.ACTIONS, a, strict=True)) for a in shuffled], pa.schema([("lane", pa.string()), *[(c, pa.string()) for c in fair.ACTIONS[:3]], *[(c, pa.float64()) for c in fair.ACTIONS[3:]]]))
    half = len(actions) // 2
    frames = (b.to_pandas()[["lane", "actions"]] for b in fair.packs([rows.slice(0, half), rows.slice(half)]))
    return pd.concat(list(processor.handleInputRows(("l",), frames, None)))


@pytest.mark.parametrize("seed", range(8))
def test_f1_pages_play_as_the_plain_lane(seed, monkeypatch):
    """Lanes whose pages hold a few entries, so that these split often, over many micro-batches with all actions."""
    monkeypatch.setattr(fair, "FILL", 3)
    monkeypatch.setattr(fair, "PAGE", 2)
    rng = random.Random(seed)
    settings = {"time_lane": seed % 2 == 1, "window": rng.choice([3, 100]), "budget": rng.choice([0, 2, 9]), "lease": 60, "debounce": rng.choice([2, 15])}
    processor = fair.FairProcessor(**settings)
    processor.init(Handle())
    names, actions, got, now = [f"t{i}" for i in range(rng.choice([3, 200]))], [], [], 0.0
    for k in range(0, 1_200, 60):
        for n in range(k, k + 60):
            now += rng.choice([0.1, 1, 1, 5, 40 if rng.random() < 0.05 else 1])
            kind = rng.choice(["enqueue"] * 5 + ["checkout"] * 4 + ["confirm", "renew", "abort", "complete", "complete"])
            job = f"j{n}" if kind == "enqueue" else None if kind == "checkout" else rng.choice([f"j{rng.randrange(n + 1)}", *[x[1] for x in got[-8:]]])
            t = rng.choice(names)
            actions.append((kind, None if kind == "checkout" else t, job, float(1 + len(t) % 3), rng.choice([0.5, 2.0]), now))
        got += [tuple(r) for r in played(processor, actions[k:])[["tenant_id", "job_id", "result"]].itertuples(index=False)]
    assert got == plain_lane(actions, **settings) and len(got) > 20


def test_f1_a_lane_calls_its_store_by_the_page():
    """Thousands of actions are some hundred calls; a few actions on a large lane read and write a few pages."""
    processor = fair.FairProcessor(window=3)
    processor.init(Handle())
    many = [("enqueue", f"t{i % 4000}", f"j{i}", 1.0, 0.0, 2.0 * i) if late == 0 else ("checkout", None, None, None, 0.0, 2.0 * i + 1) for i in range(12_000) for late in range(1 + (i % 3 != 0))]
    got, State.calls = [], 0
    for k in range(0, len(many), 10_000):
        got += played(processor, many[k : k + 10_000])["job_id"].tolist()
    assert len(got) >= 8_000 and State.calls < 600
    assert len(processor.maps["slots"].kept) >= 8
    State.calls = 0
    few = [("enqueue", "t1", "x", 1.0, 0.0, 30_000.0), ("checkout", None, None, None, 0.0, 30_001.0)]
    assert len(played(processor, few)) == 1 and State.calls < 50


def test_f1_actions_come_in_packs(spark):
    """A row for each lane of a batch, with its actions in their order; a lane may be null."""
    rows = spark.range(900).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("l"), F.col("id") % 3)).alias("lane"), *[F.lit("x").alias(c) for c in fair.ACTIONS[:3]], F.lit(1.0).alias("weight"), F.lit(0.0).alias("duration"), F.col("id").cast("double").alias("arrival")).coalesce(1)
    got = rows.mapInArrow(fair.packs, "lane string, actions binary").collect()
    assert {r.lane for r in got} == {None, "l1", "l2"} and len(got) == 3
    for r in got:
        assert fair._columns(r.actions)[-1] == [float(i) for i in range(900) if i % 3 == int((r.lane or "l0")[1])]


def test_f1_steps_share_every_partition(spark):
    """A replay's micro-batches are about three, and each takes a share of every partition, not whole partitions in turns."""
    s = replay.streaming_session(spark)
    path = replay.log_of(spread(s, 8_000, 8, 10))
    reader, at, steps = log.BoundedReader(path, *replay.shares(s, path, 3)), {"at": {}, "turn": ""}, []
    while (then := reader.latestOffset()) != at:
        steps.append([then["at"].get(f"t/{p}", 0) - at["at"].get(f"t/{p}", 0) for p in range(8)])
        at = then
    assert len(steps) == 3 and all(min(taken) > 300 for taken in steps) and [sum(x) for x in zip(*steps, strict=True)] == [1_000] * 8

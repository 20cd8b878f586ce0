"""Weighted fair queues as a stream: a lane's order is sequential, its state is not read as a whole.

Tenants stand in an ordered set of pages by (virtual time, name), with a small root that knows where each
page begins; leases stand in another one by their end. An action reads the tenants it names, the pages it
changes and the queue's ends, whatever the number of tenants; a micro-batch writes what it changed.
Tenants, jobs and leases stand in pages by hash, and actions reach a lane in packs: the store and the worker
are called for a page or a pack, not for each entry or action.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import _packed, _unpacked

RESULTS = "lane string, tenant_id string, job_id string, result string, at double"
ACTIONS = ["action", "tenant_id", "job_id", "weight", "duration", "arrival"]
#: Members of half a page of an ordered set, and entries of a page by hash.
PAGE, FILL = 256, 1024


class Cached:
    """A keyed state read entry by entry, each once a micro-batch, and written back where it changed."""

    def __init__(self, read: Callable[[Any], Any], write: Callable[[Any, Any], None], remove: Callable[[Any], None]):
        self._read, self._write, self._remove = read, write, remove
        self._now: dict[Any, Any] = {}
        self._changed: dict[Any, None] = {}
        self.reads = 0

    def get(self, key: Any) -> Any:
        if key not in self._now:
            self.reads += 1
            self._now[key] = self._read(key)
        return self._now[key]

    def put(self, key: Any, value: Any) -> None:
        self._now[key] = value
        self._changed[key] = None

    def flush(self) -> None:
        for key in self._changed:
            if self._now[key] is None:
                self._remove(key)
            else:
                self._write(key, self._now[key])
        self._changed = {}


class Paged:
    """A keyed state as ``Cached``, whose entries stand in pages by hash: dictionaries in ``pages``.

    A page is read once a micro-batch, with its first entry asked for, and written once, if it changed. Pages
    grow in number with the entries, one after the other (linear hashing), so no micro-batch deals all anew.
    """

    def __init__(self, size: tuple[int, int], pages: Cached):
        self.pages, (self.number, self.entries) = pages, size
        self._now: dict[Any, Any] = {}
        self._changed: dict[Any, None] = {}
        self._loaded: dict[int, dict] = {}

    @property
    def reads(self) -> int:
        return self.pages.reads

    def _at(self, code: int) -> int:
        low = 1 << (self.number.bit_length() - 1)
        at = code & (2 * low - 1)
        return at if at < self.number else code & (low - 1)

    def _of(self, key: Any) -> int:
        return self._at(zlib.crc32(repr(key).encode()))

    def _load(self, page: int) -> dict:
        if page not in self._loaded:
            self._loaded[page] = self.pages.get(page) or {}
        return self._loaded[page]

    def get(self, key: Any) -> Any:
        if key not in self._now:
            self._now[key] = self._load(self._of(key)).get(key)
        return self._now[key]

    def put(self, key: Any, value: Any) -> None:
        self._now[key] = value
        self._changed[key] = None

    def flush(self) -> None:
        touched = set()
        for key in self._changed:
            touched.add(at := self._of(key))
            page = self._load(at)
            self.entries -= len(page)
            if (value := self._now[key]) is None:
                page.pop(key, None)
            else:
                page[key] = value
            self.entries += len(page)
        if (number := max(self.number, -(-self.entries // FILL))) > self.number:
            split = [(old, self._load(old)) for old in {self._at(new) for new in range(self.number, number)}]
            touched |= {old for old, _ in split} | set(range(self.number, number))
            self.number = number
            for old, page in split:
                self._loaded[old] = {}
                for key, value in page.items():
                    self._loaded.setdefault(self._of(key), {})[key] = value
        for at in touched:
            self.pages.put(at, self._loaded.get(at) or None)
        self.pages.flush()
        self._changed = {}


class Ordered:
    """A sorted set of (number, name) in pages of at most 2 * PAGE members; ``root`` lists (number, name, page) of each page's first member."""

    def __init__(self, root: list[tuple[float, str, int]], pages: Cached):
        self.root, self.pages = root, pages
        self._own: dict[int, list] = {}

    def _page(self, item: tuple[float, str]) -> int:
        return max(0, bisect.bisect_right(self.root, (*item, float("inf"))) - 1)

    def _members(self, number: int) -> list:
        """A page's members, to be changed in place."""
        if number not in self._own:
            self._own[number] = list(self.pages.get(number))
        return self._own[number]

    def _put(self, number: int, members: list | None) -> None:
        if members is None:
            self._own.pop(number, None)
        else:
            self._own[number] = members
        self.pages.put(number, members)

    def add(self, item: tuple[float, str]) -> None:
        if not self.root:
            self.root.append((*item, 0))
            self._put(0, [item])
            return
        at = self._page(item)
        number = self.root[at][2]
        members = self._members(number)
        bisect.insort(members, item)
        if len(members) > 2 * PAGE:
            new, half = 1 + max(r[2] for r in self.root), members[PAGE:]
            self.root.insert(at + 1, (*half[0], new))
            self._put(new, half)
            members = members[:PAGE]
        self.root[at] = (*members[0], number)
        self._put(number, members)

    def discard(self, item: tuple[float, str]) -> None:
        if not self.root:
            return
        at = self._page(item)
        number = self.root[at][2]
        members = self._members(number)
        k = bisect.bisect_left(members, item)
        if k == len(members) or members[k] != item:
            return
        del members[k]
        self._put(number, members or None)
        if members:
            self.root[at] = (*members[0], number)
        else:
            del self.root[at]

    def first(self) -> tuple[float, str] | None:
        return self.root[0][:2] if self.root else None

    def __iter__(self) -> Iterator[tuple[float, str]]:
        for _, _, number in list(self.root):
            yield from list(self.pages.get(number))


class Lane:
    """The rules of one lane over its cached state; ``play`` takes one action and gives its result, if it has one.

    enqueue: waits, or is rejected beyond ``window`` waiting jobs; a tenant that comes back starts
    at the ring's least virtual time at least. checkout: the least (virtual time, tenant) gives its
    oldest job, which holds a lease and is being forwarded; none beyond ``budget`` live leases
    (0: no bound). With a budget, tenants below their weighted share go first, among the first
    max(60, 3 * budget) of the ring. confirm ends forwarding; abort ends it, and the job goes to
    its tenant's tail; complete ends the lease; renew prolongs it; expired leases lapse. A lane
    without waiting jobs, live leases and forwards for ``debounce`` seconds of arrival time forgets
    its virtual times (a new era, so no tenant is touched); weights stay. arrival is in seconds.
    """

    def __init__(self, head: tuple | None, ring: list, ends: list, stores: dict[str, Cached], time_lane: bool, window: int, budget: int, lease: float, debounce: float):
        self.era, self.slots, self.weight, self.idle = head or (0, 0, 0.0, None)
        self.tenants, self.jobs, self.leases = stores["tenants"], stores["jobs"], stores["slots"]
        self.ring, self.ends = Ordered(ring, stores["ring"]), Ordered(ends, stores["ends"])
        self.time_lane, self.window, self.budget, self.lease, self.debounce = time_lane, window, budget, max(60.0, lease), debounce

    # a tenant is (era, vtime, weight, head, tail, load): jobs head..tail - 1 wait, load leases are live
    def _tenant(self, name: str) -> tuple | None:
        t = self.tenants.get(name)
        return t if t is None or t[0] == self.era else (self.era, 0.0, *t[2:])

    def _set(self, name: str, old: tuple | None, new: tuple) -> None:
        """``new`` in place of ``old``, in the ring and in the weight of busy tenants too."""
        stands, stood = new[4] > new[3], old is not None and old[4] > old[3]
        if stood and (not stands or old[1] != new[1]):
            self.ring.discard((old[1], name))
        if stands and (not stood or old[1] != new[1]):
            self.ring.add((new[1], name))
        self.weight += (new[2] if stands or new[5] else 0.0) - (old[2] if old is not None and (stood or old[5]) else 0.0)
        self.tenants.put(name, new)

    def _take(self) -> str | None:
        """The tenant whose turn it is."""
        if not self.budget:
            return self.ring.root[0][1] if self.ring.root else None
        if self.slots >= self.budget:
            return None
        best, whole = None, self.weight or 1.0
        for k, (_, name) in enumerate(self.ring):
            if k == max(60, 3 * self.budget):
                break
            best = best or name
            t = self._tenant(name)
            if t[5] < max(1, math.floor(self.budget * t[2] / whole)):
                return name
        return best  # work goes on when all have their share

    def _end(self, job: str, slot: tuple) -> tuple[str, tuple]:
        """Without the lease of ``job``: its tenant before."""
        name, expiry, forwarding = slot
        if not forwarding:
            self.ends.discard((expiry, job))
        self.leases.put(job, None)
        self.slots -= 1
        return name, self._tenant(name)

    def _lapse(self, now: float) -> None:
        while (first := self.ends.first()) is not None and first[0] <= now:
            name, t = self._end(first[1], self.leases.get(first[1]))
            self._set(name, t, (*t[:5], t[5] - 1))

    def play(self, action: str, tenant: str, job: str, weight: float | None, duration: float, now: float) -> tuple[str, str, str] | None:
        if self.ends.root:
            self._lapse(now)
        if self.idle is not None and now - self.idle >= self.debounce:
            self.era, self.idle = self.era + 1, now  # the ring is empty, so no place in it changes
        out, slot = None, self.leases.get(job) if action in ("confirm", "renew", "abort", "complete") else None
        if action == "enqueue":
            old = self._tenant(tenant)
            era, vtime, w, head, tail, load = old or (self.era, 0.0, weight if weight and weight > 0 else 1.0, 0, 0, 0)
            if tail - head >= self.window:
                out = tenant, job, "rejected"
            else:
                if tail == head and (first := self.ring.first()) is not None:
                    vtime = max(vtime, first[0])
                self.jobs.put((tenant, tail), job)
                self._set(tenant, old, (era, vtime, w, head, tail + 1, load))
        elif action == "checkout" and (who := self._take()) is not None:
            job = self.jobs.get((who, self._tenant(who)[3]))
            if (held := self.leases.get(job)) is not None:  # an id that came twice holds one lease
                name, t = self._end(job, held)
                self._set(name, t, (*t[:5], t[5] - 1))
            era, vtime, w, head, tail, load = old = self._tenant(who)
            self.jobs.put((who, head), None)
            self._set(who, old, (era, vtime + (0 if self.time_lane else 1 / w), w, head + 1, tail, load + 1))
            self.leases.put(job, (who, now + self.lease, True))
            self.slots += 1
            out = who, job, "checked_out"
        elif action == "confirm" and slot is not None:
            if slot[2]:
                self.ends.add((slot[1], job))
            self.leases.put(job, (*slot[:2], False))
        elif action == "renew" and slot is not None:
            if not slot[2]:
                self.ends.discard((slot[1], job))
                self.ends.add((now + self.lease, job))
            self.leases.put(job, (slot[0], now + self.lease, slot[2]))
        elif action == "abort" and slot is not None and slot[2]:
            name, old = self._end(job, slot)
            era, vtime, w, head, tail, load = old
            self.jobs.put((name, tail), job)
            self._set(name, old, (era, vtime - (0 if self.time_lane else 1 / w), w, head, tail + 1, load - 1))
        elif action == "complete" and slot is not None:
            name, old = self._end(job, slot)
            era, vtime, w, head, tail, load = old
            self._set(name, old, (era, vtime + (duration / w if self.time_lane else 0), w, head, tail, load - 1))
        quiet = not self.slots and not self.ring.root
        self.idle = (now if self.idle is None else self.idle) if quiet else None
        return out


def _columns(value: bytes) -> list[list]:
    return [c.to_pylist() if c.null_count else c.to_numpy(zero_copy_only=False).tolist() for c in _unpacked(value)]


def _table(keys: list, values: list) -> bytes:
    """Entries as columns: the key's, then the value's."""
    return _packed(**{str(i): c for i, c in enumerate([*zip(*keys, strict=True), *zip(*values, strict=True)])})


#: How a page of each keyed state is read and written, and a page of an ordered set.
KEYED: dict[str, tuple[Callable, Callable]] = {
    "tenants": (lambda c: dict(zip(c[0], zip(*c[1:], strict=True), strict=True)), lambda p: _table([(k,) for k in p], list(p.values()))),
    "jobs": (lambda c: dict(zip(zip(c[0], c[1], strict=True), c[2], strict=True)), lambda p: _table(list(p), [(v,) for v in p.values()])),
    "slots": (lambda c: dict(zip(c[0], zip(*c[1:], strict=True), strict=True)), lambda p: _table([(k,) for k in p], list(p.values()))),
}
MEMBERS = (lambda c: list(zip(*c, strict=True)), lambda p: _table(p, []))


def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The actions of each batch as a row a lane, in the order they have there."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        codes = rows.column("lane").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        rows, starts = rows.take(pa.array(order)), [*np.flatnonzero(np.diff(codes[order], prepend=-2)), len(codes)]
        runs = [rows.slice(a, z - a) for a, z in zip(starts, starts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array([r.column("lane")[0].as_py() for r in runs], pa.string()), pa.array([_packed(**{c: r.column(c).combine_chunks() for c in ACTIONS}) for r in runs], pa.binary())], names=["lane", "actions"])


def _sorted(rows: Iterator[pd.DataFrame]) -> list[list]:
    """The columns of a lane's packed actions, by arrival; equal ones as they came."""
    packed = [_unpacked(p) for frame in rows for p in frame["actions"]]
    *words, weight, duration, arrival = (pa.chunked_array(c) for c in zip(*packed, strict=True))
    arrival = arrival.to_numpy()
    order = np.argsort(arrival, kind="stable")
    return [*(c.to_numpy()[order].tolist() for c in (*words, weight, duration)), arrival[order].astype(float).tolist()]


class FairProcessor(StatefulProcessor):
    """A lane's weighted fair queue with its actions as input rows (see ``Lane``)."""

    def __init__(self, time_lane: bool = False, window: int = 100, budget: int = 0, lease: float = 1800, debounce: float = 15):
        self.settings = time_lane, window, budget, lease, debounce

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "era bigint, slots bigint, weight double, idle double")
        self.sizes = handle.getValueState("sizes", ", ".join(f"{k}_pages bigint, {k}_entries bigint" for k in KEYED))
        self.roots = {k: handle.getValueState(f"{k}_root", "members binary") for k in ("ring", "ends")}
        self.maps = {k: handle.getMapState(f"{k}_pages", "page bigint", "members binary") for k in (*KEYED, "ring", "ends")}

    def _pages(self, name: str) -> Cached:
        state, (unpack, pack) = self.maps[name], KEYED.get(name, MEMBERS)
        return Cached(lambda k: unpack(_columns(state.getValue((k,))[0])) if state.containsKey((k,)) else None, lambda k, v: state.updateValue((k,), (pack(v),)), lambda k: state.containsKey((k,)) and state.removeKey((k,)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sizes = self.sizes.get() if self.sizes.exists() else (1, 0) * len(KEYED)
        stores = {k: self._pages(k) for k in ("ring", "ends")} | {k: Paged(tuple(sizes[2 * i : 2 * i + 2]), self._pages(k)) for i, k in enumerate(KEYED)}
        roots = {k: list(zip(*_columns(s.get()[0]), strict=True)) if s.exists() else [] for k, s in self.roots.items()}
        lane = Lane(self.head.get() if self.head.exists() else None, roots["ring"], roots["ends"], stores, *self.settings)
        out, play = [], lane.play
        for action in zip(*_sorted(rows), strict=True):
            if (got := play(*action)) is not None:
                out.append((key[0], *got, action[-1]))
        for s in stores.values():
            s.flush()
        self.sizes.update(tuple(n for k in KEYED for n in (stores[k].number, stores[k].entries)))
        for k, order in (("ring", lane.ring), ("ends", lane.ends)):
            self.roots[k].update((_packed(number=[r[0] for r in order.root], name=[r[1] for r in order.root], page=[r[2] for r in order.root]),))
        self.head.update((lane.era, lane.slots, lane.weight if lane.ring.root or lane.slots else 0.0, lane.idle))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULTS.split(", ")])

    def close(self) -> None:
        pass


def fair_stream(actions: DataFrame, time_lane: bool = False, window: int = 100, **settings) -> DataFrame:
    """actions(lane, tenant_id, weight, job_id, action, duration, arrival): checkouts in fair order.

    A lane's actions are played in order by one task, since each depends on the one before; a micro-batch
    is what bounds them (``sources.log.stream``).
    """
    packed = actions.select("lane", *ACTIONS).mapInArrow(packs, "lane string, actions binary")
    return packed.groupBy("lane").transformWithStateInPandas(FairProcessor(time_lane, window, **settings), RESULTS, "Append", "None")

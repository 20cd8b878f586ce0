"""A log in files: appended in offset order with a zone map, looked up by pointers, read in bounded ordered steps.

A log is a folder: ``data`` holds Parquet files sorted by (topic, partition, offset), ``zones`` a row per
file and partition: its first and last offset, records and bytes. Zones are written last, so they commit an
append: files without zones are not part of the log.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators import offsets

LOG = "topic string, partition int, offset bigint, key string, value string, timestamp timestamp"
ZONES = "file string, topic string, partition int, first bigint, last bigint, records bigint, bytes bigint"
WHERE = ["topic", "partition", "offset"]
#: Bytes of a row group, so that a step reads little of a file, and of a micro-batch's records for each input partition.
GROUP_BYTES, TASK_BYTES = 256 << 10, 256 << 10
#: Records whose sizes a stream's planner holds, to end its next steps without reading them again.
HELD_RECORDS = 2_000_000


def zones(spark: SparkSession, path: str) -> DataFrame:
    """A row per file and partition of the log; none if nothing was appended yet."""
    try:
        return spark.read.schema(ZONES).option("recursiveFileLookup", "true").parquet(f"{path}/zones")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ZONES)


def append(records: DataFrame, path: str, file_records: int = 100_000, tasks: int | None = None) -> DataFrame:
    """Append records(topic, partition, offset, key, value, timestamp) to the log and return the zones of their files.

    Records are dealt by ranges of (topic, partition, offset), so a hot partition fills many tasks and
    files; ``tasks`` says how many ranges there are, else the session does. Offsets must lie beyond those of earlier appends to their partition; if any does not, nothing is committed.
    """
    spark = records.sparkSession
    names = [c.split()[0] for c in LOG.split(", ")]
    size = F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    folder = f"{path}/data/{uuid.uuid4().hex}"
    sorted_ = records.select(*names, size.cast("bigint").alias("bytes")).repartitionByRange(*([tasks] if tasks else []), *WHERE).sortWithinPartitions(*WHERE)
    sorted_.write.option("maxRecordsPerFile", file_records).option("parquet.block.size", GROUP_BYTES).parquet(folder)
    written = spark.read.parquet(folder).select("*", F.col("_metadata.file_path").alias("file"))
    new = written.groupBy("file", "topic", "partition").agg(F.min("offset").alias("first"), F.max("offset").alias("last"), F.count("*").alias("records"), F.sum("bytes").alias("bytes"))
    ends = zones(spark, path).groupBy("topic", "partition").agg(F.max("last").alias("end"))
    if not new.join(ends, ["topic", "partition"]).where("first <= end").isEmpty():
        raise ValueError("records lie before the end of their partition")
    target = f"{path}/zones/{folder.rsplit('/', 1)[1]}"
    new.write.parquet(target)
    return spark.read.schema(ZONES).parquet(target)


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """The lowest offset that every partition still holds: topic, partition, low."""
    return zones(spark, path).groupBy("topic", "partition").agg(F.min("first").alias("low"))


def holding(pointers: DataFrame, path: str) -> DataFrame:
    """The records of the files that may hold pointers(topic, partition, offset); no other file is read.

    The driver learns the names of those files, never more than a scan of the whole log would list.
    """
    spark = pointers.sparkSession
    asked = pointers.select(*WHERE).distinct()
    met = asked.join(zones(spark, path), ["topic", "partition"]).where((F.col("offset") >= F.col("first")) & (F.col("offset") <= F.col("last")))
    files = [r.file for r in met.select("file").distinct().collect()]
    return spark.read.schema(LOG).parquet(*files) if files else spark.createDataFrame([], LOG)


def lookup(pointers: DataFrame, path: str) -> DataFrame:
    """Pointers(topic, partition, offset, ...) with payload and result: found, lost (below the log) or miss."""
    records = holding(pointers, path).select(*WHERE, F.col("value").alias("payload"))
    return offsets.lookup(pointers, records, bounds(pointers.sparkSession, path), ("topic", "partition"))


# a stream in bounded steps ---------------------------------------------------------------------------


class Zone:
    """The records of one partition in one file."""

    def __init__(self, file: str, first: int, last: int, size: int):
        self.file, self.first, self.last, self.size = file, first, last, size


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, also of one with a single slash as Spark's metadata gives."""
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _sizes(file: str, topic: str, partition: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from ``start`` on and their bytes, of one partition in one file."""
    fs, name = _opened(file)
    t = pq.read_table(name, filesystem=fs, columns=["offset", "bytes"], filters=[("topic", "=", topic), ("partition", "=", partition), ("offset", ">=", start)]).sort_by("offset")
    return t.column("offset").to_numpy(), t.column("bytes").to_numpy()


def step(of: dict[str, list[Zone]], at: dict, most: int, most_each: int, sizes=_sizes) -> dict:
    """The next position after ``at`` = {"at": {name: next offset}, "turn": name}.

    Every partition gives at most ``most_each`` bytes and all together at most ``most``; a record that is
    larger than that is taken alone. Partitions take turns: the first asked is the first that got nothing
    the last time though it had records, else the one after the last served.
    Records are told from whole zones where these fit; only the zone that a cut falls into is looked into.
    """
    names = sorted(of)
    turn = next((i for i, n in enumerate(names) if n >= at["turn"]), 0)
    now, taken, turns, missed, then = dict(at["at"]), 0, names[turn:] + names[:turn], None, at["turn"]
    for k, name in enumerate(turns):
        room, used = min(most_each, most - taken), 0
        topic, _, partition = name.rpartition("/")
        start = stop = now.get(name, of[name][0].first)
        for i in range(bisect_left(of[name], stop, key=lambda z: z.last), len(of[name])):
            z = of[name][i]
            if room <= 0:
                break
            if z.first >= stop and used + z.size <= room:
                used, stop = used + z.size, z.last + 1
                continue
            at_, each = sizes(z.file, topic, int(partition), stop)
            total = used + np.cumsum(each)
            fit = int(np.searchsorted(total, room, "right"))
            if not fit and not used and not taken and len(each):
                fit = 1  # alone
            if fit:
                used, stop = int(total[fit - 1]), int(at_[fit - 1]) + 1
            if fit < len(each):
                break
        if stop > start:
            now[name], taken, then = stop, taken + used, turns[(k + 1) % len(turns)]
        elif missed is None and start <= of[name][-1].last:
            missed = name
    return {"at": now, "turn": at["turn"] if now == at["at"] else missed or then}


class Span:
    """Offsets start to stop (exclusive) of one partition, and the files that hold them in order."""

    def __init__(self, topic: str, partition: int, start: int, stop: int, files: list[str]):
        self.topic, self.partition, self.start, self.stop, self.files = topic, partition, start, stop, files


class Spans(InputPartition):
    """Spans of different partitions that one task reads one after the other."""

    def __init__(self, spans: list[Span]):
        self.spans = spans


class BoundedReader(DataSourceStreamReader):
    """Every log partition in offset order in one input partition, within byte budgets; small micro-batches have few input partitions.

    The engine asks for the latest offset without saying where it stands, but plans the last logged
    batch anew after a restart, so its end is where this reader goes on.
    """

    def __init__(self, path: str, most: int, most_each: int, assigned: list[str] | None = None):
        self.path, self.most, self.most_each, self.now = path, most, most_each, None
        self.assigned = None if assigned is None else set(assigned)
        self.seen: set[str] = set()
        self.of: dict[str, list[Zone]] = {}
        self.held: dict[str, tuple[str, np.ndarray, np.ndarray]] = {}

    def _zones(self) -> dict[str, list[Zone]]:
        fs, root = _opened(f"{self.path}/zones")
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
        done = {f.path.rpartition("/")[0] for f in found if f.base_name == "_SUCCESS"}  # an append under way has none
        new: set[str] = set()
        for folder in sorted(done - self.seen):
            for r in pq.read_table(folder, filesystem=fs).to_pylist():
                name = f"{r['topic']}/{r['partition']}"
                if self.assigned is None or name in self.assigned:
                    self.of.setdefault(name, []).append(Zone(r["file"], r["first"], r["last"], r["bytes"]))
                    new.add(name)
            self.seen.add(folder)
        for name in new:
            self.of[name].sort(key=lambda z: z.first)
        return self.of

    def _sizes(self, file: str, topic: str, partition: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        """As the function, but a partition's records in a file are read once, not at every step that ends among them."""
        name = f"{topic}/{partition}"
        held, at, each = self.held.get(name, ("", None, None))
        if held != file:
            self.held.pop(name, None)
            at, each = _sizes(file, topic, partition, start)
            self.held[name] = file, at, each
            while len(self.held) > 1 and sum(len(x[1]) for x in self.held.values()) > HELD_RECORDS:
                del self.held[next(iter(self.held))]
        k = int(np.searchsorted(at, start))
        return at[k:], each[k:]

    def initialOffset(self) -> dict:
        return {"at": {}, "turn": ""}

    def latestOffset(self) -> dict:
        self.now = step(self._zones(), self.now or self.initialOffset(), self.most, self.most_each, self._sizes)
        return self.now

    def partitions(self, start: dict, end: dict) -> list[Spans]:
        if self.now is None:
            self.now = end
        out, of = [], self._zones()
        for name, stop in end["at"].items():
            begin = start["at"].get(name, of[name][0].first)
            if stop > begin:
                topic, _, partition = name.rpartition("/")
                a, z = bisect_left(of[name], begin, key=lambda z: z.last), bisect_left(of[name], stop, key=lambda z: z.first)
                out.append(Span(topic, int(partition), begin, stop, [z.file for z in of[name][a:z]]))
        tasks = max(1, min(len(out), -(-self.most // TASK_BYTES)))
        return [Spans(out[i::tasks]) for i in range(tasks)]

    def read(self, part: Spans) -> Iterator[pa.RecordBatch]:
        for span in part.spans:
            yield from self._records(span)

    def _records(self, span: Span) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LOG.split(", ")]
        for file in span.files:
            fs, name = _opened(file)
            t = pq.read_table(name, filesystem=fs, columns=names, filters=[("topic", "=", span.topic), ("partition", "=", span.partition), ("offset", ">=", span.start), ("offset", "<", span.stop)]).sort_by("offset")
            at = names.index("timestamp")
            moment = pc.cast(t.column(at), pa.timestamp("us"), safe=False) if t.schema.types[at].tz is None else t.column(at)
            moment = pc.assume_timezone(moment, "UTC") if t.schema.types[at].tz is None else pc.cast(moment, pa.timestamp("us", "UTC"), safe=False)
            yield from t.set_column(at, "timestamp", moment).to_batches()


class BoundedLog(DataSource):
    """Options: path, maxBytes (1 MiB a micro-batch), maxPartitionBytes (128 KiB a partition) and assign (a JSON list of topic/partition; all without it)."""

    @classmethod
    def name(cls) -> str:
        return "bounded_log"

    def schema(self) -> str:
        return LOG

    def streamReader(self, schema) -> BoundedReader:
        return BoundedReader(self.options["path"], int(self.options.get("maxBytes", 1 << 20)), int(self.options.get("maxPartitionBytes", 128 << 10)), json.loads(self.options.get("assign", "null")))


def stream(spark: SparkSession, path: str, most: int = 1 << 20, most_each: int = 128 << 10, assigned: list[str] | None = None) -> DataFrame:
    """A stream over a log folder in micro-batches of bounded bytes, every partition in offset order; over ``assigned`` partitions (topic/partition) alone if given.

    Runs with a processing-time trigger; ``availableNow`` would take one step and end.
    """
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planners need not find this package
    spark.dataSource.register(BoundedLog)
    return spark.readStream.format("bounded_log").option("path", path).option("maxBytes", most).option("maxPartitionBytes", most_each).option("assign", json.dumps(assigned)).load()

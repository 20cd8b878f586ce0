"""Tables in bucketed files with versions: an upsert rewrites only the buckets whose keys change.

A table is a folder: ``data`` holds a folder per rewritten bucket and version, ``versions`` a small file per
version that lists which folder holds each bucket. A version exists once its file does; that file is
created exclusively, so of two writers that started from one version the second fails and changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schedule import latest


class VersionedTable:
    """Rows of ``schema`` under ``keys``, in ``buckets`` buckets by the keys' hash."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first one."""
        folder = self._path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json")), default=0)

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Which folder holds each bucket."""
        version = self.version() if version is None else version
        if version == 0:
            return {}
        stream = self._fs.open(self._path(f"{self.path}/versions/{version}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        return self._rows(sorted(set(self.folders(version).values())))

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def upsert(self, changes: DataFrame, order: list[str]) -> int:
        """Rows of ``changes`` in place of those with their keys; of several for one key the last by ``order``. Returns the version.

        Only buckets with changed keys are read and written. The latest row of a key is a partial
        aggregation (``max_by``), so a key with many changes sorts nothing.
        """
        return self._change(changes, lambda old, new: latest(old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True))), self.keys, ["_new", *order]).drop("_new"))

    def delete(self, gone: DataFrame) -> int:
        """Without the rows of ``gone``'s keys. Returns the version."""
        return self._change(gone, lambda old, new: old.join(new.select(*self.keys).distinct(), self.keys, "left_anti"), whole=False)

    def _change(self, changes: DataFrame, merge, whole: bool = True) -> int:
        base = self.version()
        before = self.folders(base)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        names = [f.name for f in self.read(0).schema.fields] if whole else self.keys
        dealt = changes.select(*names)
        touched = sorted(r.b for r in dealt.select(bucket.alias("b")).distinct().collect())  # at most ``buckets``
        if not touched:
            return base
        old = self._rows(sorted({before[b] for b in touched if b in before}))
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        merged = merge(old, dealt).withColumn("_bucket", bucket)
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        made = {int(s.getPath().getName().partition("=")[2]): s.getPath().toString() for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("_bucket=")}
        now = {b: f for b, f in before.items() if b not in touched} | made
        self._publish(base + 1, now)
        return base + 1

    def _publish(self, version: int, folders: dict[int, str]) -> None:
        target = self._path(f"{self.path}/versions/{version}.json")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(target, False)  # fails if another writer was first
        try:
            out.write(bytearray(json.dumps(folders).encode()))
        finally:
            out.close()


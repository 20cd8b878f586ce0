"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only in a single local JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="batchloom-")
    return _local_roots[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with the intermediate tables."""
    path = f"{shared_root(spark)}/batchloom/{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rsplit("/", 1)[0]))
    return path


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._landed = (spark, path.rsplit("/", 1)[0])
    return out


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a table that cannot be deleted now goes with its folder
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete landed tables that nothing reads any more; other relations are left alone."""
    for df in tables:
        entry = getattr(df, "_landed", None)
        if entry in _written:
            _written.remove(entry)
            _delete(*entry)


def release() -> None:
    """Delete every intermediate table written by this process; results that still read them end here."""
    while _written:
        _delete(*_written.pop())


atexit.register(release)

#: Rows up to which a two- or three-column table is broadcast (some tens of MB); beyond it joins shuffle.
BROADCAST_ROWS = 500_000


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows are within ``limit``; unchanged otherwise."""
    return F.broadcast(df) if df.count() <= limit else df


def map_rows(df: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``df`` mapped batch by batch to rows of its own columns; ``of`` sees them under ``places(df)``, so their names may be anything."""
    plain = df.toDF(*places(df))
    return plain.mapInArrow(of, plain.schema).toDF(*df.columns)


def places(df: DataFrame) -> list[str]:
    return [f"c{i}" for i in range(len(df.columns))]


def row_keys(df: DataFrame) -> list[Column]:
    """Two hashes (128 bits together) of all columns of a row, nulls included; equal rows have equal keys."""
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
    columns = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(nulls, *columns), F.xxhash64(F.lit(0x5EED), *columns, nulls)]

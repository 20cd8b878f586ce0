"""Running sums and running XORs inside keys, whatever the number of rows of one key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import discard, landed


def _accumulate(kind: str, x: np.ndarray) -> np.ndarray:
    return np.cumsum(x) if kind == "sum" else np.bitwise_xor.accumulate(x)


def _apart(kind: str, x: np.ndarray, before: np.ndarray) -> np.ndarray:
    return x - before if kind == "sum" else x ^ before


def _joined(kind: str, x: np.ndarray, carry: int) -> np.ndarray:
    return x + np.int64(carry) if kind == "sum" else x ^ np.int64(carry)


def _local(key: str, kinds: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, carry = TaskContext.get().partitionId(), None, {}
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        group = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]]))
        goes_on = len(starts) > 0 and last is not None and keys[0] == last
        first = slice(0, starts[1] if len(starts) > 1 else len(keys))
        columns = {name: batch.column(name) for name in batch.schema.names}
        for name, kind in {**kinds, "nth": "sum"}.items():
            x = columns[name].to_numpy() if name in kinds else np.ones(len(keys), np.int64)
            total = _accumulate(kind, x)
            value = _apart(kind, total, np.concatenate([[0], total])[starts][group])
            if goes_on:
                value[first] = _joined(kind, value[first], carry[name])
            carry[name], columns[name] = value[-1], pa.array(value, pa.int64())
        last = keys[-1]
        columns["part"] = pa.array(np.full(len(keys), part, np.int32))
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def running(df: DataFrame, key: str, order: list[str], kinds: dict[str, str]) -> DataFrame:
    """``df`` as a written table with every column of ``kinds`` replaced by its running value inside ``key``.

    ``kinds`` maps long columns to "sum" or "xor"; ``key`` is a long that is never null. Rows are dealt
    by ranges of (key, order), so a key of any size spreads; what a key has in earlier ranges is
    added afterwards. Only keys that span ranges have such carries: at most two rows a range, which
    bounds the broadcast. Rows equal in key and order stay in one range.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("nth", T.LongType()), T.StructField("part", T.IntegerType())])
    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = landed(ranged.mapInArrow(lambda it: _local(key, kinds, it), schema), "local")
    ends = local.groupBy(key, "part").agg(*[F.max_by(c, "nth").alias(c) for c in kinds])
    ends = landed(ends.withColumn("parts", F.count("*").over(Window.partitionBy(key))).where("parts > 1"), "ends")
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(key, "part", *[(F.sum if kind == "sum" else F.bit_xor)(c).over(before).alias(f"carry_{c}") for c, kind in kinds.items()])
    full = local.join(F.broadcast(carry), [key, "part"], "left")
    value = {c: F.col(c) + F.coalesce(f"carry_{c}", F.lit(0)) if kind == "sum" else F.col(c).bitwiseXOR(F.coalesce(f"carry_{c}", F.lit(0))) for c, kind in kinds.items()}
    out = landed(full.withColumns(value).select(*df.columns), "running")
    discard(local, ends)
    return out

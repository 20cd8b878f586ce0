"""Groups of rows as numpy columns, many small groups an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def _starts(table: pa.Table | pa.RecordBatch, keys: int) -> np.ndarray:
    """First row of every group: rows where any of the first ``keys`` columns changes."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for i in range(keys):
        c = table.column(i)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _runs(of: Callable[[pa.Table], Iterator[dict]], keys: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows: list[dict] = []

    def made(batch: pa.Table) -> None:
        rows.extend(of(batch))

    def key(batch: pa.RecordBatch) -> list:
        return [batch.column(i)[0].as_py() for i in range(keys)]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1]) != key(batch):
            made(pa.Table.from_batches(held))
            held = []
        cut = int(_starts(batch, keys)[-1])  # the last group may go on in the next batch
        if cut:
            made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
        if len(rows) >= 10_000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if held:
        made(pa.Table.from_batches(held))
    yield pa.RecordBatch.from_pylist(rows, schema)


def bounds(table: pa.Table, keys: int) -> list[tuple[int, int]]:
    """First and end row of every group; groups are whole and equal in the first ``keys`` columns."""
    at = [*_starts(table, keys).tolist(), table.num_rows]
    return list(zip(at[:-1], at[1:], strict=True))


def map_groups(df: DataFrame, keys: list[str], columns: list[str], of: Callable[[pa.Table], Iterator[dict]], ddl: str, schema: pa.Schema) -> DataFrame:
    """``of`` over tables of whole groups: the key columns (never null), then ``columns``, sorted by keys and the first column.

    Groups are told apart by the keys themselves, not by a hash. A task holds one Arrow batch and
    the group that runs over its end, so groups must be bounded.
    """
    rows = df.select(*keys, *columns).repartition(*keys)
    return rows.sortWithinPartitions(*keys, *columns[:1]).mapInArrow(lambda it: _runs(of, len(keys), schema, it), ddl)

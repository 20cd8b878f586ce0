"""Embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised; equal vectors of a label form one class, so copies never meet each other.
A class's key in a table is its label with K quantised Gaussian projections. Keys are grouped
first without vectors; only classes that share a bucket get theirs joined. Buckets beyond
``BLOCK`` classes are dealt into blocks and every pair of blocks is one task, so no task holds
more than two blocks. A pair is counted in the first table where it meets, by comparing the keys
of earlier tables, and no pair leaves a task: links leave as counts per class and as one edge per
class to its component's root in the bucket.

Recall: a link at cosine 0.98 is a distance of 0.2, at which one projection of width 1.25 agrees
with probability 0.87; 8 in each of 24 tables leave a miss of 0.0002, less for closer pairs.

Defined cases: null, empty, zero vectors or null/non-finite parts, and null labels: no links, a
component of their own. Vectors of different lengths never link. Repeated vec_ids are separate
vectors. Null vec_ids link like others; a component without any id is null, nothing of it is kept.
Equal vectors tie: all of a class have its links, and a component
is named by its smallest vec_id. Empty table: empty result. Only vec_id, embedding and label are
read, so no other column's name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, search
from .groups import bounds, map_groups
from .store import landed

TABLES, PROJECTIONS, WIDTH, SEED, BLOCK = 24, 8, 1.25, 7, 2_048
COSINE = 0.98


def _plane(dim: int, tables: int, projections: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    a, b = rng.normal(size=(dim, tables * projections)), rng.uniform(size=tables * projections)
    return a, b, rng.integers(1, 2**62, size=(tables, projections), dtype=np.int64) | 1


def table_keys(x: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """One 64-bit key per row and table of normalised rows."""
    a, b, mult = _plane(x.shape[1], tables, projections, seed)
    cells = np.floor(x @ a / width + b).astype(np.int64).reshape(len(x), tables, projections)
    with np.errstate(over="ignore"):
        h = (cells * mult).sum(2)
        h ^= h >> 29
        return h * np.int64(-4658895280553007687)


def _valid(v) -> np.ndarray | None:
    if not v or any(x is None for x in v):
        return None
    x = np.asarray(v, np.float64)
    n = np.sqrt((x * x).sum()) if np.isfinite(x).all() else 0.0
    return x / n if n > 0 and np.isfinite(n) else None


def _hash_rows(tables: int, projections: int, width: float, seed: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels = batch.column(0), batch.column(2).to_pylist()
        vecs = [_valid(v) for v in batch.column(1).to_pylist()]
        unit, keys = [None] * len(vecs), [None] * len(vecs)
        groups: dict[int, list[int]] = {}
        for i, v in enumerate(vecs):
            if v is not None and labels[i] is not None:
                groups.setdefault(len(v), []).append(i)
        for at in groups.values():
            x = np.stack([vecs[i] for i in at])
            for i, row, k in zip(at, x, table_keys(x, tables, projections, width, seed), strict=True):
                unit[i], keys[i] = row.astype("<f8").tobytes(), k.astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(unit, pa.binary()), pa.array(keys, pa.binary())], names=["vec_id", "label", "unit", "keys"])


def hashed(vectors: DataFrame, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    return rows.mapInArrow(lambda it: _hash_rows(tables, projections, width, seed, it), "vec_id long, label long, unit binary, keys binary")


def link_block(x: np.ndarray, keys: np.ndarray, side: np.ndarray, across: bool, table: int, cosine: float, weight: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(summed weight of linked rows per row, component label per row) within one bucket.

    ``across``: only pairs of different sides. Weights count a pair only where it meets in no
    earlier table; components use every link.
    """
    n = len(x)
    linked, got = np.zeros((n, n), bool), np.zeros(n, np.int64)
    for a in range(0, n, step):
        hit = x[a : a + step] @ x.T >= cosine
        if across:
            hit &= side[a : a + step, None] != side[None, :]
        hit[np.arange(len(hit)), np.arange(a, a + len(hit))] = False
        linked[a : a + step] = hit
        if hit.any():
            for t in range(table):
                hit &= keys[a : a + step, None, t] != keys[None, :, t]
        got[a : a + step] = hit.astype(np.float64) @ weight
    return got, search(n, lambda i, others: linked[i, others])


_LINKS = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("partner", pa.int64())])


def _buckets(cosine: float, tables: int, task: pa.Table) -> Iterator[dict]:
    cids, t, lo, hi, side, copies = (task.column(c).to_numpy() for c in ("cid", "table", "lo", "hi", "side", "copies"))
    units, keys = task.column("unit").to_pylist(), task.column("keys").to_pylist()
    for a, z in bounds(task, 5):
        sizes: dict[int, list[int]] = {}
        for i in range(a, z):
            sizes.setdefault(len(units[i]), []).append(i)
        for at in sizes.values():
            if len(at) < 2:
                continue
            x = np.frombuffer(b"".join([units[i] for i in at]), "<f8").reshape(len(at), -1)
            k = np.frombuffer(b"".join([keys[i] for i in at]), "<i8").reshape(len(at), tables)
            got, label = link_block(x, k, side[at], bool(lo[a] != hi[a]), int(t[a]), cosine, copies[at].astype(np.float64))
            mine = cids[at]
            for c, n, p in zip(mine.tolist(), got.tolist(), mine[label].tolist(), strict=True):
                if n or p != c:
                    yield {"cid": c, "links": n, "partner": p}


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``."""
    h = landed(hashed(vectors, tables, projections, width, seed), "hashed")
    # classes of equal unit vectors; the double image of a class is one value, so equality is exact
    cls = h.where("unit is not null").groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("keys").alias("keys"))
    cls = landed(cls.withColumn("cid", F.monotonically_increasing_id()), "classes")
    words = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(t.alias("table"), F.substring("keys", t * 8 + 1, F.lit(8)).alias("key")))
    at = cls.select("label", "cid", F.explode(words).alias("w")).select("label", "cid", "w.table", "w.key")
    count = at.groupBy("label", "table", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = at.join(count, ["label", "table", "key"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    shared = shared.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("cid", F.lit(seed)), "blocks").cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "mine").alias("lo"), F.greatest(o, "mine").alias("hi")))
    tasks = shared.withColumn("pair", F.explode(every)).select("label", "table", "key", "cid", "pair.lo", "pair.hi", F.col("mine").alias("side"))
    rows = tasks.join(cls.select("cid", "unit", "keys", "copies"), "cid")
    columns = ["cid", "side", "copies", "unit", "keys"]
    links = map_groups(rows, ["label", "table", "key", "lo", "hi"], columns, lambda task: _buckets(cosine, tables, task), "cid long, links long, partner long", _LINKS)
    links = landed(links, "links")
    comp = components(links.where("cid != partner").select(F.col("cid").alias("u"), F.col("partner").alias("v"))).withColumnRenamed("node", "cid")
    per_class = links.groupBy("cid").agg(F.sum("links").alias("links"))
    least = cls.select("cid", "rep").join(comp, "cid").groupBy("component").agg(F.min("rep").alias("least"))
    known = cls.select("label", "unit", "rep", "cid", "copies").join(per_class, "cid", "left").join(comp, "cid", "left").join(least, "component", "left")
    out = h.join(known, ["label", "unit"], "left")
    component = F.coalesce("least", "rep", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )

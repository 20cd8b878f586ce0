"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edges. A hub's edges carry the hub as
key; the minimum per key is pre-aggregated map-side. It is broadcast while the counted edges bound
it, so hubs meet in no task; beyond that the join back is left to AQE, which splits skewed
partitions. State between rounds is a written table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BROADCAST_ROWS, discard, landed


def _small(low: DataFrame, edges: int) -> DataFrame:
    """One row per node: at most two per edge."""
    return F.broadcast(low) if 2 * edges <= BROADCAST_ROWS else low


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(_small(low, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(_small(low, n), "u")
    return (
        joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .where("u > v").distinct()
    )


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component is the smallest reachable node.

    Self-loops are ignored; null ends are dropped; an empty edge table gives an empty result.
    """
    e = landed(
        edges.where("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    before = _print_of(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        old, e = e, landed(_small_star(_large_star(e, before[0]), before[0]), "edges")
        discard(old)
        now = _print_of(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def search(n: int, near) -> np.ndarray:
    """Breadth-first components of rows 0..n-1; ``near(i, others)`` gives a mask of linked others.

    Rows already reached are never compared again, so one dense group costs about n comparisons.
    """
    label, left = np.full(n, -1), np.arange(n)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        left = left[left != seed]
        queue = [seed]
        while queue and len(left):
            i = queue.pop()
            mask = near(i, left)
            found = left[mask]
            if len(found):
                label[found] = seed
                left = left[~mask]
                queue += found.tolist()
    return label

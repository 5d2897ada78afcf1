"""Connected components of a graph given as pairs, by alternating star operations.

Each round shuffles edges only. The edges of a hub meet in one task, where adaptive skew handling
doesn't split them, but pass through it one by one and are never held together. Edges are first
contracted to a forest inside each partition, so most graphs need one or two rounds. Every round is
written to the shared folder, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a small graph and the least node each is connected to (numpy, pointer jumping)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        px, py = parent[x], parent[y]
        low = np.minimum(px, py)
        new = parent.copy()
        np.minimum.at(new, px, low)
        np.minimum.at(new, py, low)
        new = new[new]
        if (new == parent).all() and (new[x] == new[y]).all():
            break
        parent = new
    return nodes, nodes[parent]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def fold() -> None:
        nonlocal kept, size
        n, r = roots(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))
        kept = [(n[n != r], r[n != r])]
        size = len(kept[0][0])

    last = 0
    for batch in batches:
        a, b = (np.asarray(batch.column(k)) for k in (0, 1))
        kept.append((a, b))
        size += len(a)
        if size > 2 * last + 1_000_000:
            fold()
            last = size
            if size > 4_000_000:  # a forest too large to hold goes out as it is
                yield pa.RecordBatch.from_arrays([pa.array(kept[0][0]), pa.array(kept[0][1])], names=["u", "v"])
                kept, size, last = [], 0, 0
    if kept:
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(kept[0][0]), pa.array(kept[0][1])], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the least node of its component, of every node with an edge to another."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now = stored(pairs.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    while True:
        n = now.agg(F.count("*"), F.countDistinct("u")).first()
        deep = now.select("u").join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        if n[0] == n[1] and not deep:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        merged = small.unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(merged.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

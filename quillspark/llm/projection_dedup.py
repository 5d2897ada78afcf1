"""Embedding near-dedup by collision counting on one-dimensional projections.

Vectors of a label are normalised; equal ones become one. In a cell of about ``CELL`` vectors, vectors
are sorted along each of many projections; a window around each query counts its collisions per pair;
pairs with at least the needed collisions are verified by cosine in double precision. Window and count
are calibrated so that a pair at the threshold is found with probability above 0.99 (``calibrate``).

Windows wide enough for that recall hold a sixth of all vectors on each line, so counting over a whole
label is quadratic in it. Cells bound it: a cell is the set of vectors on the same sides of ``depth``
projections, depth following the size of the label, and as a pair at the threshold may fall on two
sides, each vector is in one cell of each of ``tables`` such tables, as many as the same recall needs.
Both grow with the logarithm of the label, tables slowly: one side parts a pair at 0.98 with a chance
of 0.064 alone. A pair is counted in the first table that has it in one cell. Cells over ``BLOCK``
vectors, as those of a dense cluster, are cut into blocks that meet pairwise in tasks of their own.

Cases: a null label, a null, zero or non-finite vector, or one with null components links with
nothing; vectors of other lengths than the rest of their pair never link (cells are by length too);
equal vectors link with each other and copies are never expanded; rows without an id or with a
repeated id count as rows; only the named columns are read, so other columns may have any name; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, stored
from .components import components, roots

THRESHOLD = 0.98
LINES = 24
BLOCK = 1024
CELL = 512  # vectors that a cell has about
MISS = 0.004  # chance to lose a pair at the threshold by the tables, and again by counting


@lru_cache(8)
def directions(size: int, count: int, seed: int) -> np.ndarray:
    """Orthogonal directions as far as there are dimensions, then more sets of them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    made = [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(-(-count // size))]
    return np.concatenate(made, 1)[:, :count] if made else np.zeros((size, 0))


def calibrate(size: int, lines: int = LINES, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[float, int]:
    """Half window and collisions needed, for a chance of at most ``miss`` to lose a pair at the
    threshold by counting. Along a direction two unit vectors at distance d lie about
    N(0, d / sqrt(size)) apart."""
    window = math.sqrt(2 - 2 * threshold) / math.sqrt(max(size, 1))
    p = 2 * NormalDist().cdf(1.0) - 1
    chance, needed = 0.0, 0
    for k in range(lines + 1):
        chance += math.comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if chance > miss:
            needed = k
            break
    return window, needed


def tables(depth: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Tables of cells of a depth, for a chance of at most ``miss`` that none keeps a pair at the
    threshold together."""
    together = (1 - math.acos(threshold) / math.pi) ** depth
    return 1 if together >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-together))


def _block(x: np.ndarray, y: np.ndarray, same: bool, window: float, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks of unit vectors with enough collisions along the projections."""
    lines = directions(x.shape[1], LINES, 71)
    px, py = x @ lines, y @ lines
    count = np.zeros(len(x) * len(y), np.uint8)
    for k in range(LINES):
        order = np.argsort(py[:, k])
        line = py[order, k]
        lo, hi = np.searchsorted(line, px[:, k] - window), np.searchsorted(line, px[:, k] + window, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        count[np.repeat(np.arange(len(x)) * len(y), n) + order[at]] += 1
    found = np.flatnonzero(count >= needed)
    i, j = found // len(y), found % len(y)
    if same:
        i, j = i[i < j], j[i < j]
    return i, j


def _cells(key, table):  # no hints: Spark reads them
    """Links within one block pair of a cell."""
    turn, lo, hi = key[2].as_py(), key[4].as_py(), key[5].as_py()
    part, node, copies = (table[c].to_numpy() for c in ("part", "node", "copies"))
    codes, raw = (table[c].combine_chunks().flatten().to_numpy().reshape(len(node), -1) for c in ("codes", "vector"))
    unit = raw / np.sqrt((raw * raw).sum(1))[:, None]
    window, needed = calibrate(raw.shape[1])
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    i, j = _block(unit[left], unit[right], lo == hi, window, needed)
    i, j = left[i], right[j]
    new = ~(codes[i, :turn] == codes[j, :turn]).any(1)  # no table before has both in one cell
    i, j = i[new], j[new]
    cosine = (raw[i] * raw[j]).sum(1) / (np.sqrt((raw[i] * raw[i]).sum(1)) * np.sqrt((raw[j] * raw[j]).sum(1)))
    i, j = i[cosine >= THRESHOLD], j[cosine >= THRESHOLD]
    others = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
    near = np.flatnonzero(others > 0)
    if len(near):
        n, r = roots(node[i], node[j])
        root = dict(zip(n.tolist(), r.tolist(), strict=True))
    return pa.table({"node": pa.array(node[near], pa.int64()), "root": pa.array([root[v] for v in node[near].tolist()] if len(near) else [], pa.int64()), "others": pa.array(others[near].astype(np.int64))})


def _placed():
    """Of each vector its cell in each table of its label's depth."""

    @F.pandas_udf("array<long>")
    def place(vector: pd.Series, depth: pd.Series) -> pd.Series:
        out: list = [None] * len(vector)
        shape = [(len(v), int(d)) for v, d in zip(vector, depth, strict=True)]
        for size, d in sorted(set(shape)):
            at = [k for k, s in enumerate(shape) if s == (size, d)]
            n = tables(d)
            side = np.stack([np.asarray(vector.iloc[k], float) for k in at]) @ directions(size, d * n, 5) > 0 if d else np.zeros((len(at), 0), bool)
            codes = side.reshape(len(at), n, d) @ (1 << np.arange(d, dtype=np.int64)) if d else np.zeros((len(at), n), np.int64)
            for k, c in zip(at, codes, strict=True):
                out[k] = c
        return pd.Series(out)

    return place


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per input row: ``id_col``, ``n_links``, ``component_id`` and ``kept``."""
    own = vectors.select(F.col(id_col).alias("own_id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    good = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True))
    own = own.withColumn("good", F.coalesce(good & (norm > 0), F.lit(False))).withColumn("rid", F.monotonically_increasing_id())
    own = stored(own, "vectors")
    usable = own.where("good").withColumn("size", F.size("vector"))
    nodes = usable.groupBy("label", "vector", "size").agg(F.count("*").alias("copies"), F.min("rid").alias("node"), F.min("own_id").alias("least_id"))
    nodes = stored(nodes, "nodes")
    # splits by size of the label; one row per label and length, with the vectors that it has
    depth = nodes.groupBy("label", "size").agg(F.count("*").alias("_nodes"))
    depth = stored(depth.withColumn("depth", F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("_nodes") / F.lit(float(CELL))))).cast("int")), "depths")
    n_nodes = depth.agg(F.sum("_nodes")).first()[0] or 0
    spread = salted_join(nodes, depth, ["label", "size"], "_nodes", n_nodes, F.col("node"))
    spread = spread.withColumn("codes", _placed()("vector", "depth"))
    spread = spread.select("label", "size", "node", "vector", "copies", "codes", F.posexplode("codes").alias("turn", "code"))
    cell = ["label", "size", "turn", "code"]
    counts = spread.groupBy(*cell).agg(F.count("*").alias("_in")).where(F.col("_in") > BLOCK)  # the few that need blocks
    spread = spread.join(counts, cell, "left").withColumn("parts", F.ceil(F.coalesce("_in", F.lit(1)) / F.lit(BLOCK)).cast("int"))
    spread = spread.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    met = spread.select(*cell, "part", "node", "vector", "copies", "codes", F.explode(every).alias("other"))
    met = met.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other"))
    found = stored(met.groupBy(*cell, "lo", "hi").applyInArrow(_cells, "node long, root long, others long"), "found")
    degree = found.groupBy("node").agg(F.sum("others").alias("others"))
    grouped = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    full = nodes.join(degree, "node", "left").join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = full.groupBy("root").agg(F.min("least_id").alias("component_id"))
    full = full.join(least, "root").select("label", "vector", "copies", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    full = stored(full.withColumnRenamed("n_links", "_links"), "linked")
    total = nodes.agg(F.sum("copies")).first()[0] or 0
    out = salted_join(usable, full, ["label", "vector"], "copies", total, F.col("rid")).select("own_id", F.col("_links").alias("n_links"), "component_id")
    alone = own.where("not good").select("own_id", F.lit(0).cast("long").alias("n_links"), F.col("own_id").alias("component_id"))
    both = out.unionByName(alone)
    return both.select(F.col("own_id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.coalesce(F.col("own_id") == F.col("component_id"), F.lit(False)).alias("kept"))

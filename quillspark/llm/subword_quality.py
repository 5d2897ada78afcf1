"""Quality classifier: averaged subword embeddings with a softmax, trained by numpy SGD.

A text's features are its words, its word pairs and its character trigrams (over UTF-8 bytes), all
hashed into one table of learned vectors. The average vector goes through a softmax. As that last
layer is linear, a trained model scores a text by the mean of one number per bucket.

Cases: a null or empty text has no feature and gets the score of the bias alone; rows are scored
one by one, so repeated rows agree; texts of any length are scored whole; only the text column is an
input of a score, other columns may have any name; with no labelled row, or one class only, every
text gets the share of the class seen (0.5 without any); of several labels of an id the least counts;
a score of exactly ``THRESHOLD`` is class 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import labelled

BITS = 16
BUCKETS = 1 << BITS
DIM = 16
TRAIN_DOCS = 1500  # bound on labelled rows that the model is fitted on
THRESHOLD = 0.7
_REPEAT = ts.mix(np.array([7], np.uint64))[0]


@dataclass
class SubwordModel:
    vectors: np.ndarray  # (BUCKETS, DIM)
    out: np.ndarray  # (DIM, 2)
    bias: np.ndarray  # (2,)

    def table(self) -> np.ndarray:
        """Of each bucket, what it adds to the logit of class 1."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)


def features(b: ts.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket ids of each kind of n-gram, with their offsets by document."""
    h = b.word_hashes(False)
    yield (h >> ts.U(64 - BITS)).astype(np.int32), b.word_bounds
    n = np.maximum(np.diff(b.word_bounds) - 1, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(bounds[-1]) + np.repeat(b.word_bounds[:-1] - bounds[:-1], n)
    first, second = h[at], h[at + 1]
    pair = np.where(first == second, _REPEAT, first * ts.M1 + second * ts.M2)
    yield (pair >> ts.U(64 - BITS)).astype(np.int32), bounds
    n = np.maximum(np.diff(b.bounds) - 2, 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    d = b.data.astype(np.uint32)
    if len(d) < 3:
        yield np.zeros(0, np.int32), bounds
        return
    g = (d[:-2] | (d[1:-1] << np.uint32(8)) | (d[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)
    g >>= np.uint32(32 - BITS)
    ok = np.ones(len(g), bool)
    cut = b.bounds[1:-1]
    for k in (1, 2):
        at = cut - k
        ok[at[(at >= 0) & (at < len(g))]] = False
    g = g.astype(np.int32)
    yield (g if ok.all() else g[ok]), bounds


def logits(column: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    out = []
    for b in ts.blocks(column):
        total, count = np.zeros(b.n_docs), np.zeros(b.n_docs, np.int64)
        for ids, bounds in features(b):
            sums = np.zeros(len(ids) + 1)
            np.cumsum(table[ids], out=sums[1:], dtype=np.float64)
            total += np.diff(sums[bounds])
            count += np.diff(bounds)
        out.append(total / np.maximum(count, 1) + bias)
    return np.concatenate(out) if out else np.zeros(0)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 8.0, seed: int = 5) -> SubwordModel:
    """``rows``: of each text its bucket ids, their counts and its class."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    out = rng.uniform(-1, 1, (DIM, 2)) / DIM
    bias = np.zeros(2)
    ones = sum(y for _, _, y in rows)
    if not rows or ones in (0, len(rows)):
        p = ones / len(rows) if rows else 0.5
        bias[1] = np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
        return SubwordModel(vectors * 0, out, bias)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, counts, y = rows[i]
            now = rate * (1 - done / steps)
            done += 1
            w = counts / max(counts.sum(), 1)
            v = w @ vectors[ids]
            z = v @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            dv = out @ p
            out -= 0.05 * now * np.outer(v, p)
            bias -= 0.005 * now * p
            vectors[ids] -= now * w[:, None] * dv
    return SubwordModel(vectors, out, bias)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_docs: int = TRAIN_DOCS) -> SubwordModel:
    """Train on at most ``max_docs`` rows of ``labels`` where ``usable`` holds, those with the
    smallest hash of their id; the bound holds for rows of ``docs`` too, where an id repeats. Executors
    make the counts by bucket; the driver gets at most ``BUCKETS`` counts a row."""
    sample = labelled(docs, labels.where(usable), max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for b in ts.blocks(batch.column(1)):
                kinds = list(features(b))
                for i in range(b.n_docs):
                    ids, n = np.unique(np.concatenate([x[bd[i] : bd[i + 1]] for x, bd in kinds]), return_counts=True)
                    blobs.append(ids.astype(np.uint32).tobytes() + n.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(blobs, pa.binary())], names=["key", "quality", "blob"])

    rows = sample.mapInArrow(run, "key string, quality int, blob binary").collect()
    rows.sort(key=lambda r: (r.key, bytes(r.blob)))
    made = []
    for r in rows:
        x = np.frombuffer(r.blob, np.uint32).reshape(2, -1)
        made.append((x[0].astype(np.int64), x[1].astype(float), int(r.quality > 0)))
    return train(made)


def score(docs: DataFrame, model: SubwordModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id_col`` and ``score``, the probability of class 1."""
    kind = docs.schema[id_col].dataType.simpleString()
    table, bias = model.table(), float(model.bias[1] - model.bias[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(logits(batch.column(1), table, bias), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, score double")

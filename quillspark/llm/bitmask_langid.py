"""Language ID: bit-sliced Bloom filters tell which languages contain an n-gram.

Each slot of one table is a bitmask with a bit per language. An n-gram has ``PROBES`` slots; the
AND of their masks holds every language whose filter contains it. Per language, the count of such
n-grams less the false positives expected of the filter's fill decides.

A language's filter holds each n-gram of its learned rows, once or often seen, unless it is over
``1 / SHARE`` times as frequent in another language: rows with a wrong label or in two languages would
else fill every filter with every n-gram. The rows learned from are
bounded (``DOCS_PER_LANG`` a language), the table is sized by the language with the most n-grams so
that no filter is over ``FILL`` full, and executors set the bits: the driver gets bitmaps alone.

Cases: a null text or one without a letter is ``und`` with score 0; a text with letters but no
n-gram in any filter gets the language with the most n-grams learned, score 0; ties go to the
first language by name; more than 64 languages take several mask words; nothing learned (an empty
table, no usable row): ``und``; repeated rows are scored alike, and learned from once each; texts of
any length are scored whole; only the named columns are read, so other columns may have any name; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as ts
from .common import dropped, stored

GRAM = 4
BITS = 16  # least table size; it grows with the n-grams learned
PROBES = 2
FILL = 0.25  # most of a language's slots that are set, about
SHARE = 0.1  # of an n-gram's highest frequency among the languages, from which a language holds it
DOCS_PER_LANG = 400  # bound on the labelled rows of a language that are learned from
_NORMAL = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not (65 <= _c <= 90 or 97 <= _c <= 122):
        _NORMAL[_c] = 32
_NORMAL[65:91] = _NORMAL[97:123]


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # (1 << bits, words) masks
    false: np.ndarray  # expected share of false positives by language
    fallback: int = 0
    bits: int = BITS


def grams(column: pa.Array) -> Iterator[tuple[ts.Block, np.ndarray, np.ndarray]]:
    """32-bit hashes of the n-grams of letters of each block, with offsets by document."""
    for b in ts.blocks(pc.utf8_lower(column)):
        d = _NORMAL[b.data].astype(np.uint32)
        if len(d) < GRAM:
            yield b, np.zeros(0, np.uint32), np.zeros(b.n_docs + 1, np.int64)
            continue
        n = len(d) - GRAM + 1
        code = d[:n] | (d[1 : n + 1] << np.uint32(8)) | (d[2 : n + 2] << np.uint32(16)) | (d[3 : n + 3] << np.uint32(24))
        ok = code != 0x20202020
        cut = b.bounds[1:-1]
        for k in range(1, GRAM):
            at = cut - k
            ok[at[(at >= 0) & (at < n)]] = False
        at = np.flatnonzero(ok)
        code = code[at]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        code ^= code >> np.uint32(12)
        code *= np.uint32(0x297A2D39)
        code ^= code >> np.uint32(15)
        yield b, code, np.searchsorted(at, b.bounds)


_PROBE = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[:PROBES]
_PLACES = [f"p{k}" for k in range(PROBES)]


def slots(code: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(code * np.uint32(m)) >> np.uint32(32 - bits) for m in _PROBE]


def table_bits(most: int) -> int:
    """Bits of a slot number for a table in which ``most`` n-grams fill about FILL of the slots."""
    return min(26, max(BITS, int(np.ceil(np.log2(max(most, 1) * PROBES / FILL)))))


def build(langs: list[str], hits: list[np.ndarray], counts: list[int], bits: int) -> LangModel:
    """``hits``: of each language which slots are set; ``counts``: how many n-grams it has."""
    words = max(1, -(-len(langs) // 64))
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    table = np.zeros((1 << bits, words), kind)
    false = np.zeros(len(langs))
    for i, hit in enumerate(hits):
        table[hit, i // 64] |= kind(1) << kind(i % 64)
        false[i] = min(hit.mean() ** PROBES, 0.99)
    return LangModel(langs, table, false, int(np.argmax(counts)) if counts else 0, bits)


def decide(column: pa.Array, model: LangModel) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the index of its language (-1: none) and the score."""
    langs = len(model.langs)
    picked, scores = [], []
    for b, code, bounds in grams(column):
        n = np.diff(bounds)
        got = np.zeros((b.n_docs, langs))
        masks = None
        for s in slots(code, model.bits):
            masks = model.table[s] if masks is None else masks & model.table[s]
        for i in range(langs):
            bit = (masks[:, i // 64] >> masks.dtype.type(i % 64)) & masks.dtype.type(1)
            sums = np.zeros(len(bit) + 1, np.int64)
            np.cumsum(bit, out=sums[1:])
            got[:, i] = np.diff(sums[bounds])
        got = np.maximum(0, (got - n[:, None] * model.false) / (1 - model.false)) if langs else got
        best = got.argmax(1) if langs else np.full(b.n_docs, -1)
        total = got.sum(1) if langs else np.zeros(b.n_docs)
        top = got[np.arange(b.n_docs), best] if langs else total
        best = np.where((total > 0) | (best < 0), best, model.fallback)
        letter = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum(_NORMAL[b.data] != 32, out=letter[1:])
        plain = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum((_NORMAL[b.data] != 32) & (b.data < 128), out=plain[1:])
        some, ascii_some = np.diff(letter[b.bounds]) > 0, np.diff(plain[b.bounds]) > 0
        for i in np.flatnonzero(some & ~ascii_some):
            some[i] = any(map(str.isalpha, bytes(b.data[b.bounds[i] : b.bounds[i + 1]]).decode()))
        picked.append(np.where(some, best, -1))
        scores.append(np.where(some & (total > 0), top / np.maximum(total, 1e-9), 0.0))
    if not picked:
        return np.zeros(0, int), np.zeros(0)
    return np.concatenate(picked), np.concatenate(scores)


def fit(docs: DataFrame, usable: Column, per_lang: int = DOCS_PER_LANG) -> LangModel:
    """Learn from at most ``per_lang`` rows of each language where ``usable`` holds, those with the
    smallest hash of their id; all n-grams in them count."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & usable).select("doc_id", "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = ids.withColumn("_rank", rank).where(F.col("_rank") <= per_lang).select("doc_id", F.col("lang").alias("_lang")).distinct()
    picked = stored(picked, "picked")  # its size is known from here on, so Spark broadcasts it while it is small
    sample = docs.join(picked, (docs["doc_id"] == picked["doc_id"]) & (docs["lang"] == F.col("_lang"))).select("_lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lang in sorted(set(names)):
                own = batch.column(1).filter(pa.array([x == lang for x in names]))
                values, n = np.unique(np.concatenate([c for _, c, _ in grams(own)] or [np.zeros(0, np.uint32)]), return_counts=True)
                probes = [(values * np.uint32(m)).astype(np.int64) for m in _PROBE]  # their high bits are the slots
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), *map(pa.array, (values.astype(np.int64), n, *probes))], names=["lang", "code", "n", *_PLACES])

    counted = sample.mapInArrow(run, f"lang string, code long, n long, {', '.join(f'{p} long' for p in _PLACES)}")
    counted = counted.groupBy("lang", "code", *_PLACES).agg(F.sum("n").alias("n"))
    counted = counted.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))  # n-grams of a bounded sample
    known = stored(counted.withColumn("top", F.max("rate").over(Window.partitionBy("code"))).where(F.col("rate") >= F.col("top") * SHARE).select("lang", *_PLACES), "grams")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    bits = table_bits(max(counts.values(), default=0))
    slot = F.explode(F.array(*(F.shiftright(p, 32 - bits) for p in _PLACES)))
    set_bits = known.select("lang", slot.alias("slot")).groupBy("lang", F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits"))
    hits = {lang: np.zeros(1 << bits, bool) for lang in counts}
    # a filter's bits are the model itself: 1 << bits of them a language
    for r in set_bits.groupBy("lang").agg(F.collect_list("word").alias("words"), F.collect_list("bits").alias("bits")).collect():
        mask = np.array(r.bits, np.int64).view(np.uint64)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
        hits[r.lang].reshape(-1, 64)[np.array(r.words, np.int64)] = mask.astype(bool)
    dropped(known, picked)
    langs = sorted(counts)
    return build(langs, [hits[x] for x in langs], [counts[x] for x in langs], bits)


def predict(docs: DataFrame, model: LangModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id_col``, ``lang_pred`` and ``score`` from 0 to 1."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            best, score = decide(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")

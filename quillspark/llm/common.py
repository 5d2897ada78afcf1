"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textscan as ts

HEAVY_MOST = 10_000  # most keys that can have over 1/HEAVY_MOST of all rows; bounds what is broadcast
WAYS_MOST = 256
BITS_LEAST, BITS_MOST = 23, 30  # slots of a bitmap: 1 MB to 128 MB, 32 a key in between
BATCH_BYTES = 4 << 20  # of an Arrow batch to a worker, or one row where that is larger
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only a session with a local master (tests on one machine) may leave it unset: a temporary folder
    is made and set there. On a cluster a missing setting is an error, as a folder of one machine
    would lose rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, own, True)
        named = f"file://{own}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _paths[id(back)] = (back, path)
    return back


def dropped(*tables: DataFrame) -> None:
    """Free the disk of stored tables that nothing reads any more: an empty table takes their place. It is made
    without Python rows: those start a second daemon and workers of its own, which each executor keeps."""
    for t in tables:
        kept = _paths.pop(id(t), None)
        if kept is not None:
            spark = t.sparkSession
            spark.range(0).select(F.lit(0).alias("gone")).coalesce(1).write.mode("overwrite").parquet(kept[1])


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more. Spark refers to the
    last query it ran, so another runs first."""
    gc.collect()
    spark.range(1).count()
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that is free in this process back to the system: allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, trimmed after each batch out and at the end. Spark keeps the workers of
    an executor for later tasks, four and more for two cores, and what each holds counts."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            trim()
        trim()

    return go


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches to workers hold about BATCH_BYTES while this is open: by default 10,000 rows of texts, which the
    JVM holds outside its heap, with room to grow, and the worker once more. Rows and results stay the same; a
    smaller bound of the session counts. For queries that run within; those that run later aren't bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None)
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, own)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], copies: str, total: int, spread: Column) -> DataFrame:
    """Inner join of ``big`` with ``small``, a stored table (it is read twice) which has each key once and in ``copies`` how many rows of
    ``big`` (``total`` in all) have it. Keys with over 1/HEAVY_MOST of all rows are split by
    ``spread``; there are at most HEAVY_MOST of them, and only those are broadcast."""
    limit = max(1000, total // HEAVY_MOST + 1)
    ways = F.when(F.col(copies) > limit, F.least(F.lit(WAYS_MOST), F.ceil(F.col(copies) / F.lit(limit)))).otherwise(1).cast("int")
    parts = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1)))
    heavy = small.where(F.col(copies) > limit).select(*on, ways.alias("_ways"))
    rows = big.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_ways")), F.lit(0)).cast("int"))
    return rows.join(parts, [*on, "_salt"]).drop("_salt", "_ways")


def labelled(docs: DataFrame, labels: DataFrame, max_docs: int, label: str = "quality") -> DataFrame:
    """At most ``max_docs`` rows (key, text, label) of documents with a label, those with the smallest
    hash of their id (then of their text); of several labels of an id the least counts."""
    best = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(label).alias("_label"))
    picked = best.orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    rows = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id"))  # small, so Spark broadcasts it
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(max_docs).select(F.col("doc_id").cast("string").alias("key"), "text", F.col("_label").cast("int").alias(label))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def merged_pages(pages: DataFrame, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: str, wide: str) -> DataFrame:
    """Rows (page, data), zlib of arrays of one ``kind`` and length, folded by page to arrays of kind
    ``wide`` in two steps, so no task gets a row of every task."""

    def merge(read: str):
        def run(key, table):  # no hints: Spark reads them
            out = None
            for x in table["data"]:
                one = np.frombuffer(zlib.decompress(x.as_py()), read).astype(wide)
                out = one if out is None else fold(out, one)
            return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

        return run

    ways = math.isqrt(partitions(pages.sparkSession)) + 1
    some = pages.withColumn("way", F.pmod(F.xxhash64("data"), F.lit(ways)).cast("int")).groupBy("page", "way").applyInArrow(merge(kind), "page int, data binary")
    return some.groupBy("page").applyInArrow(merge(wide), "page int, data binary")


def slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (ts.mix(values.astype(np.int64).view(np.uint64)) >> ts.U(64 - bits)).astype(np.int64)


def bitmap(keys: DataFrame, column: str, number: Callable[[pa.Array], np.ndarray] = np.asarray) -> np.ndarray:
    """Packed bitmap of the values of a long column, or of those that ``number`` makes of another, sized by
    their number within the bounds. It only spares work: where it fills up, more rows than needed go on.
    ``number`` runs in the task that fills pages: a Python node below would hold workers of its own."""
    n = keys.count()
    bits = min(BITS_MOST, max(BITS_LEAST, int(32 * n).bit_length()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            s = slots(number(batch.column(0)), bits)
            for page in np.unique(s >> 16).tolist():
                found.setdefault(page, np.zeros(1 << 16, bool))[s[(s >> 16) == page] & 0xFFFF] = True
        packed = [zlib.compress(np.packbits(v).tobytes(), 1) for v in found.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(packed, pa.binary())], names=["page", "data"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    pages = keys.select(column).mapInArrow(trimmed(fold), "page int, data binary")
    for r in merged_pages(pages, np.bitwise_or, "u1", "u1").toLocalIterator():
        out[r.page << 13 : (r.page + 1) << 13] = np.frombuffer(zlib.decompress(r.data), np.uint8)
    return out


def in_bitmap(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in a bitmap; one that is in it always may."""
    s = slots(values, (len(packed) * 8).bit_length() - 1)
    return (packed[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1).astype(bool)

"""N-gram Jaccard join: documents whose sets of 3-word shingles are similar, exactly.

1. A first scan counts shingles in a table of fixed size (which are hot) and names each set by 128
   bits; documents with equal sets are one set from there on.
2. A second scan sends PartEnum signatures (``partenum``) of each set, packed by signature bucket.
   Each bucket counts common signatures per pair of sets; pairs that have as many as similar sets
   must have are candidates. A signature of over ``GROUP_MOST`` sets, or over twice as many as a shingle
   has that isn't hot, isn't expanded into pairs: its sets are tied to one of them, and all pairs of tied
   sets whose sizes fit are checked.
3. A third scan brings the sets of candidates together, in blocks of at most ``BLOCK`` sets (twice as
   many if tied), and Jaccard is checked exactly as products of 0/1 matrices. Where linked candidates fill
   several blocks, only the sets of a block's own candidate pairs go there.
   A block gives each set's number of linked documents and a set that it is connected to, not the links.
4. Those numbers are summed; components come from ``components``.

Copies are never expanded into pairs; each pair of different sets is counted once. Cases: null,
empty and blank texts have no set, link with nothing and are components of their own; texts of one
or two words have one shingle, the whole sequence; every input row counts as a document, also with
an id that repeats or is null; the least id ignores nulls; texts of any length count whole; only the named
columns are read, so other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from . import partenum as pe
from . import textscan as ts
from .common import HEAVY_MOST, partitions, release, salted_join, small_batches, stored, trimmed
from .components import components
from .components import roots as local_roots

PAGES = 64
WARM_EXTRA = 2  # above a standard deviation over the mean
HOT_EXTRA = 16  # a shingle is hot this far (and 4 standard deviations) above the mean of a slot
SLOT_BITS = 23  # bitmap of candidate sets: 1 MB
BUCKET_SHINGLES = 6_000_000  # of all, to a bucket; in more buckets than it takes a set's name and a pair go out more often
BLOCK = 1024
PART_WEIGHT = 1 << 20  # shingles of a part of tied sets, each set counted as BLOCK at least
GROUP_MOST = 64  # sets of one signature in a bucket that are expanded into pairs
NO_SIZE = 65535
SEEN_MOST = 50_000  # sets that a task keeps in mind so that a copy doesn't go out again
_FLUSH = 1_500_000


def _count(counts: np.ndarray, slots: np.ndarray) -> None:
    """Add to counts that stop at 255. Sixteen bits hold them and those of one slice."""
    for at in range(0, len(slots), 65_000):
        some = slots[at : at + 65_000]
        np.add.at(counts, some, np.uint16(1))
        counts[some] = np.minimum(counts[some], 255)


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, kind = np.zeros(1 << pe.HOT_BITS, np.uint16), None
    for batch in batches:
        kind = batch.schema.field(0).type
        sizes, keys = [], []
        for b in ts.blocks(batch.column(1)):
            s, bounds = pe.shingles(b)
            _count(counts, pe.hot_slots(s))
            for i in range(b.n_docs):
                x = s[bounds[i] : bounds[i + 1]]
                sizes.append(len(x))
                keys.append(pe.set_key(x) if len(x) else (None, None))
        n = len(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["own_id", "n", "k1", "k2", "page", "counts"])
    if kind is not None:
        # of one task; sums over tasks are whole
        pages = [(p, zlib.compress(x.astype(np.uint8).tobytes(), 1)) for p, x in enumerate(counts.reshape(PAGES, -1)) if x.any()]
        n = len(pages)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([p for p, _ in pages], pa.int32()), pa.array([x for _, x in pages], pa.binary())], names=["own_id", "n", "k1", "k2", "page", "counts"])


def _profile(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a document's set (own_id, n, k1, k2), or a page of shingle counts."""
    id_type = docs.schema["own_id"].dataType.simpleString()
    return docs.mapInArrow(trimmed(_profiled), f"own_id {id_type}, n long, k1 long, k2 long, page int, counts binary")


def _beyond(shingles: int) -> float:
    """How far above the mean of a slot a shingle is hot."""
    return 4 * (shingles / (1 << pe.HOT_BITS)) ** 0.5 + HOT_EXTRA


def _hot(profile: DataFrame, shingles: int) -> np.ndarray:
    """A packed bitmap of slots for each level: those with shingles of that level or above."""
    mean = shingles / (1 << pe.HOT_BITS)
    least = [mean + mean**0.5 + WARM_EXTRA, *(mean + _beyond(shingles) * 4**k for k in range(pe.LEVELS - 1))]

    def total(key, table):  # no hints: Spark reads them
        parts = sum(np.frombuffer(zlib.decompress(x), np.uint8).astype(np.int64) for x in table["counts"].to_pylist())
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([b"".join(np.packbits(parts > x).tobytes() for x in least)], pa.binary())})

    bits = np.zeros((pe.LEVELS, PAGES, (1 << pe.HOT_BITS) // PAGES // 8), np.uint8)
    for r in profile.where("page is not null").select("page", "counts").groupBy("page").applyInArrow(total, "page int, bits binary").collect():
        bits[:, r.page] = np.frombuffer(r.bits, np.uint8).reshape(pe.LEVELS, -1)
    return bits.reshape(pe.LEVELS, -1)


def _postings(docs: DataFrame, hot: np.ndarray, heavy: dict[tuple[int, int], object], buckets: int) -> DataFrame:
    """Rows (bucket, blob) of packed signatures. ``hot`` is a packed bitmap, or one for each level."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, skip = shared.value
        levels = np.zeros(1 << pe.HOT_BITS, np.uint8)
        for bits in packed.reshape(-1, (1 << pe.HOT_BITS) // 8):
            levels += np.unpackbits(bits)
        sigs: list[np.ndarray] = []
        names: list[int] = []
        needs: list[int] = []
        sizes: list[int] = []
        seen: set[tuple[int, int]] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            s = np.concatenate(sigs) if sigs else np.zeros(0, np.uint64)
            doc = np.repeat(np.arange(len(sigs), dtype=np.uint32), [len(x) for x in sigs])
            to = (((s & ts.U(0xFFFFFF)) * ts.U(buckets)) >> ts.U(24)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            s, doc, to = s[order], doc[order], to[order]
            short, need = six_bytes(short_ids(np.array(names, np.int64))), np.array(needs, np.uint8)
            size = np.minimum(np.array(sizes, np.int64), NO_SIZE).astype("<u2")
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(to) else np.zeros(1, int)
            blobs = []
            for x, y in zip(cut, cut[1:], strict=False):
                own = doc[x:y]
                first = np.concatenate([[True], own[1:] != own[:-1]])
                ids = own[first]
                runs = np.diff(np.append(np.flatnonzero(first), y - x))
                width = 1 if runs.max() < 256 else 2 if runs.max() < 65536 else 4
                parts = (np.array([len(ids), y - x, width], "<u4"), short[ids], need[ids], size[ids], runs.astype(f"<u{width}"), (s[x:y] >> ts.U(32)).astype("<u4"))
                blobs.append(b"".join(p.tobytes() for p in parts))
            return pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            owners = batch.column(0)
            for b in ts.blocks(batch.column(1)):
                s, bounds = pe.shingles(b)
                h = levels[pe.hot_slots(s)]
                for i in range(b.n_docs):
                    x, y = bounds[i], bounds[i + 1]
                    if x == y:
                        continue
                    key = pe.set_key(s[x:y])
                    if key in seen or key in skip and skip[key] != owners[b.first + i].as_py():
                        continue
                    seen.add(key)
                    made = [pe.signatures(s[x:y], h[x:y], band) for band in pe.bands(int(y - x))]
                    sigs.append(np.concatenate([m[0] for m in made]))
                    names.append(key[0])
                    needs.append(min(m[1] for m in made))
                    sizes.append(int(y - x))
                    held += len(sigs[-1])
                    if held > _FLUSH:
                        yield flush()
                        sigs, names, needs, sizes, seen, held = [], [], [], [], set(), 0
        if sigs:
            yield flush()

    return docs.mapInArrow(trimmed(run), "bucket int, blob binary")


def six_bytes(ids: np.ndarray) -> np.ndarray:
    """Rows of the six low bytes of each id."""
    return ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def from_six(data: bytes | np.ndarray, n: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    return out.view("<u8").reshape(-1)


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """Short id, need, size and number of postings of each set in a blob, and the high half of the signature
    of each posting. The low half chose the bucket, so within a bucket about 32 bits and the bucket's own tell signatures
    apart; a chance match only adds to a count."""
    docs, n, width = (int(x) for x in np.frombuffer(blob, "<u4", 3))
    at, out = 12 + 6 * docs, [from_six(blob, docs, 12)]
    for kind in ("u1", "<u2", f"<u{width}"):
        out.append(np.frombuffer(blob, kind, docs, at))
        at += docs * np.dtype(kind).itemsize
    return (*out, np.frombuffer(blob, "<u4", n, at))


def short_ids(k1: np.ndarray) -> np.ndarray:
    """48 bits that stand for a set among candidates. Sets that share them are told apart by ``link``,
    which makes them candidates of each other."""
    return k1.astype(np.int64) >> np.int64(16) & np.int64((1 << 48) - 1)


def _pairs_of_bucket(batches: Iterator[pa.RecordBatch], most: int = GROUP_MOST) -> Iterator[pa.RecordBatch]:
    """All blobs of one bucket: pairs of sets with the number of signatures they share in it. The sets of a signature
    that has over ``most`` are paired with the first of them only, with a need of 0, which ties them."""
    parts = [_unpack(x) for batch in batches for x in batch.column(1).to_pylist()]
    if not parts:
        return
    names, needs, sizes, runs, sig = (np.concatenate([p[k] for p in parts]) for k in range(5))
    del parts
    own = np.repeat(np.arange(len(names), dtype=np.uint32), runs)
    order = np.argsort(sig)
    sig = sig[order]
    alone = np.concatenate([[True], sig[1:] != sig[:-1], [True]])
    keep = ~(alone[1:] & alone[:-1])
    sig, own = sig[keep], own[order[keep]]
    del order
    names, needs, sizes = names[own], needs[own], sizes[own]
    # sets that share a short id but not a size are told apart here
    ids, local = np.unique(names << ts.U(16) | sizes.astype(np.uint64), return_inverse=True)
    need_of = np.full(len(ids), 255, np.uint8)
    np.minimum.at(need_of, local, needs)
    size_of, short_of = (ids & ts.U(0xFFFF)).astype(np.int64), (ids >> ts.U(16)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])) if len(sig) else np.zeros(1, int)
    made: list[np.ndarray] = []
    ties: list[np.ndarray] = []
    held = tied = 0

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes that similar sets can have; the largest code stands for all larger sizes."""
        x, y = size_of[a], size_of[b]
        return (pe.DEN * np.minimum(x, y) >= pe.NUM * np.maximum(x, y)) | (np.maximum(x, y) == NO_SIZE)

    def out(codes: list[np.ndarray], tie: bool = False) -> pa.RecordBatch:
        pair, n = np.unique(np.concatenate(codes), return_counts=True)
        a, b = pair // len(ids), pair % len(ids)
        need = np.zeros(len(pair), np.uint8) if tie else np.minimum(need_of[a], need_of[b])
        x, y = short_of[a], short_of[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], six_bytes(y[order])
        n, need = np.minimum(n, 65535).astype("<u2")[order], need[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        ends = np.append(first[1:], len(x))
        blobs = [y[i:j].tobytes() + n[i:j].tobytes() + need[i:j].tobytes() for i, j in zip(first, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(blobs, pa.binary())], names=["a", "blob"])

    twos = np.flatnonzero(np.diff(cut) == 2)
    a, b = local[cut[twos]], local[cut[twos] + 1]
    ok = (a != b) & fits(a, b)
    if ok.any():
        made.append(np.minimum(a, b)[ok] * len(ids) + np.maximum(a, b)[ok])
    for k in np.flatnonzero(np.diff(cut) > 2).tolist():
        group = np.unique(local[cut[k] : cut[k + 1]])
        if len(group) > most:
            ties.append(group[0] * len(ids) + group[1:])
            tied += len(group)
            if tied > 4_000_000:
                ties = [np.unique(np.concatenate(ties))]
                tied = len(ties[0]) // 2  # so that folding them costs no more than making them
            continue
        for i in range(len(group) - 1):
            rest = group[i + 1 :]
            rest = rest[fits(np.full(len(rest), group[i]), rest)]
            made.append(group[i] * len(ids) + rest)
            held += len(rest)
            if held > 4_000_000:
                yield out(made)
                made, held = [], 0
    if made:
        yield out(made)
    if ties:
        yield out(ties, True)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition's counts, sorted by ``a``; pairs that share as many signatures as they must,
    and tied ones."""
    now: int | None = None
    held: list[tuple[np.ndarray, ...]] = []
    found_a: list[np.ndarray] = []
    found_b: list[np.ndarray] = []
    found_tie: list[np.ndarray] = []

    def close() -> None:
        b, n, need = (np.concatenate([h[k] for h in held]) for k in range(3))
        ids, at = np.unique(b, return_inverse=True)
        least = np.full(len(ids), 255, np.int64)
        np.minimum.at(least, at, need)
        ok = np.bincount(at, n) >= least
        found_a.append(np.full(ok.sum(), now, np.int64))
        found_b.append(ids[ok].astype(np.int64))
        found_tie.append(least[ok] == 0)

    for batch in batches:
        for a, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a != now:
                if held:
                    close()
                now, held = a, []
            k = len(blob) // 9
            held.append((from_six(blob, k), np.frombuffer(blob, "<u2", k, 6 * k), np.frombuffer(blob, np.uint8, k, 8 * k)))
    if held:
        close()
    if found_a:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b)), pa.array(np.concatenate(found_tie))], names=["a", "b", "tie"])


def _slot(values: np.ndarray) -> np.ndarray:
    return (ts.mix(values.astype(np.int64).view(np.uint64)) >> ts.U(64 - SLOT_BITS)).astype(np.int64)


def bitmap(keys: DataFrame, column: str) -> np.ndarray:
    """Packed bitmap of fixed size of the values of a long column."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            s = _slot(np.asarray(batch.column(0)))
            for page in np.unique(s >> 16).tolist():
                bits.setdefault(page, np.zeros(1 << 16, bool))[s[(s >> 16) == page] & 0xFFFF] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int32()), pa.array([np.packbits(v).tobytes() for v in bits.values()], pa.binary())], names=["page", "bits"])

    def merge(key, table):  # no hints: Spark reads them
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
        return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros(1 << SLOT_BITS, bool)
    for r in keys.select(column).mapInArrow(fold, "page int, bits binary").groupBy("page").applyInArrow(merge, "page int, bits binary").collect():
        out[r.page << 16 : (r.page + 1) << 16] = np.unpackbits(np.frombuffer(r.bits, np.uint8)).astype(bool)
    return np.packbits(out)


def in_bitmap(packed: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in a bitmap; one that is in it always may."""
    s = _slot(values)
    return (packed[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1).astype(bool)


def _sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(k1, k2, features) of the sets whose key may be wanted."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).view(bool)
        seen: set[tuple[int, int]] = set()  # sets that went out with an earlier batch
        for batch in batches:
            found: dict[tuple[int, int], bytes] = {}
            for b in ts.blocks(batch.column(1)):
                s, bounds = pe.shingles(b)
                for i in range(b.n_docs):
                    x = s[bounds[i] : bounds[i + 1]]
                    if len(x):
                        key = pe.set_key(x)
                        if key not in found and key not in seen and bits[_slot(short_ids(np.array(key[:1])))[0]]:
                            found[key] = x.tobytes()
            if len(seen) > SEEN_MOST:
                seen.clear()
            seen.update(found)
            k1 = np.array([k[0] for k in found], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(short_ids(k1)), pa.array(k1), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.binary())], names=["id", "k1", "k2", "features"])

    return docs.mapInArrow(trimmed(run), "id long, k1 long, k2 long, features binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over common features."""
    n = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every)
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    column = np.cumsum(new) - 1
    many = np.bincount(column) > 1
    keep = many[column]
    column, owner = (np.cumsum(many) - 1)[column[keep]], owner[keep]
    out = np.zeros((n, n), np.float32)  # whole numbers up to 2^24, which no text of Spark's size limits exceeds
    step = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        x, y = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((n, step), np.float32)
        m[owner[x:y], column[x:y] - lo] = 1
        out += m @ m.T
    return out


def _check_block(key, table):  # no hints: Spark reads them
    """Exact links among the sets of one block pair, as (node, documents of linked sets, a node it is connected to). A pair
    within one part counts in one block, and one of sets that are tied together only in a block of tied sets."""
    ordinal, tied = np.array(table["part"].to_pylist()), np.array(table["tied"].to_pylist(), bool)
    node, copies = np.array(table["node"].to_pylist(), np.int64), np.array(table["copies"].to_pylist(), np.int64)
    owner = np.array(table["owner"].to_pylist(), np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in table["features"].to_pylist()]
    lo, hi, every = (key[k].as_py() for k in (1, 2, 3))
    n = np.array([len(s) for s in sets])
    shared = shared_counts(sets)
    del sets
    similar = np.zeros(shared.shape, bool)
    for at in range(0, len(n), 128):  # rows by rows, which takes little memory
        both = shared[at : at + 128].astype(np.int64)
        similar[at : at + 128] = pe.DEN * both >= pe.NUM * (n[at : at + 128, None] + n[None, :] - both)
    del shared
    if lo != hi:
        similar &= ordinal[:, None] != ordinal[None, :]
    if not every:
        similar &= ~tied[:, None] | ~tied[None, :] | (owner[:, None] != owner[None, :])
    np.fill_diagonal(similar, False)
    a, b = np.nonzero(np.triu(similar, 1))
    if not len(a):
        return pa.table({"node": pa.array([], pa.int64()), "others": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
    at, root = local_roots(a, b)
    others = np.concatenate([similar[k : k + 128] @ copies for k in range(0, len(n), 128)])
    return pa.table({"node": pa.array(node[at]), "others": pa.array(others[at]), "root": pa.array(node[root])})


def same_short(keys: DataFrame) -> DataFrame:
    """Pairs (a, a) for the short ids that several different sets have: few at any size, and candidates
    of each other."""
    return keys.groupBy(F.shiftrightunsigned("k1", 16).alias("a")).agg(F.count("*").alias("n")).where("n > 1").select("a", F.col("a").alias("b"))


def link(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``n_similar``, ``component_id`` and
    ``set_key`` (hex; null without a set)."""
    with small_batches(docs.sparkSession):  # all that runs in Python runs in here
        return _link(docs, text, id_col)


def _link(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text).alias("text"))
    profile = stored(_profile(own), "profile").withColumn("rid", F.monotonically_increasing_id())
    rows = profile.where("page is null").select("own_id", "n", "k1", "k2", "rid")
    size = rows.agg(F.count("*"), F.sum("n")).first()
    keys = rows.where("n > 0").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("rid").alias("node"), F.min("own_id").alias("least_id"), F.first("n").alias("n"))
    keys = stored(keys, "keys")
    often = max(100, size[0] // HEAVY_MOST + 1)
    plain = lambda x: x.asDict(True) if isinstance(x, Row) else x  # noqa: E731  # as Arrow gives it
    heavy = {(r.k1, r.k2): plain(r.least_id) for r in keys.where((F.col("copies") > often) & F.col("least_id").isNotNull()).select("k1", "k2", "least_id").collect()}
    n = partitions(spark)
    buckets = min(n, max(12, (size[1] or 0) // BUCKET_SHINGLES))
    postings = _postings(own, _hot(profile, size[1] or 0), heavy, buckets)
    most = max(GROUP_MOST, 2 * math.ceil(_beyond(size[1] or 0)))
    pairs = postings.repartitionById(buckets, "bucket").mapInArrow(trimmed(partial(_pairs_of_bucket, most=most)), "a long, blob binary")
    pairs = pairs.repartition(n, "a").sortWithinPartitions("a").mapInArrow(trimmed(_candidates), "a long, b long, tie boolean")
    pairs = stored(pairs, "candidates")
    del postings
    release(spark)
    ties = components(pairs.where("tie"))
    tied = stored(ties.select(F.col("node").alias("id"), F.col("root").alias("owner")), "tied")
    loose = pairs.where("not tie").select("a", "b")
    for x in ("a", "b"):
        loose = loose.join(tied.select(F.col("id").alias(x), F.col("owner").alias(f"{x}_owner")), x, "left")
    loose = stored(loose.where("a_owner is null or b_owner is null or a_owner != b_owner").select("a", "b"), "loose")
    pairs = loose.unionByName(stored(same_short(keys), "same"))
    alike = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    grouped = components(pairs)
    grouped = grouped.unionByName(alike.join(grouped, "node", "left_anti"))

    per_root = grouped.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK // 2)).cast("int").alias("parts"))
    parted = grouped.join(per_root, "root").withColumn("part", F.when(F.col("parts") <= 2, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int"))
    parted = stored(parted.select(F.col("node").alias("id"), "root", "part", "parts"), "parted")
    # a component of up to BLOCK sets is one block; of a larger one the sets of each candidate pair meet in the block of their parts
    several = parted.where("parts > 2")
    apart = pairs.join(several.select(F.col("id").alias("a"), "root", F.col("part").alias("pa")), "a").join(several.select(F.col("id").alias("b"), F.col("part").alias("pb")), "b")
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("pa").alias("part")), F.struct(F.col("b").alias("id"), F.col("pb").alias("part")))).alias("end")
    apart = apart.select("root", F.least("pa", "pb").alias("lo"), F.greatest("pa", "pb").alias("hi"), ends).select("end.id", "root", "end.part", "lo", "hi").distinct()
    whole = parted.where("parts <= 2").select("id", "root", "part", F.col("part").alias("lo"), F.col("part").alias("hi"))
    names = keys.select(F.shiftrightunsigned("k1", 16).alias("id"), F.col("k1").alias("own_k1"), F.col("k2").alias("own_k2"), "node", "copies", "n")
    places = whole.unionByName(apart).withColumn("every", F.lit(False))
    places = places.join(tied, "id", "left").join(names, "id").drop("n")
    # tied sets are cut up by size; a block is any two parts whose sizes similar sets can have
    weight = F.greatest("n", F.lit(BLOCK))
    before = F.sum(weight).over(Window.partitionBy("owner").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, 0)) - weight
    ranked = tied.join(names, "id").withColumn("part", F.floor(before / F.lit(PART_WEIGHT)).cast("int"))
    ranked = stored(ranked, "ranked")
    span = ranked.groupBy("owner", F.col("part").alias("lo")).agg(F.max("n").alias("most"))
    spans = span.join(ranked.groupBy("owner", F.col("part").alias("hi")).agg(F.min("n").alias("least")), "owner")
    fit = spans.where((F.col("lo") <= F.col("hi")) & (pe.NUM * F.col("least") <= pe.DEN * F.col("most")))
    both_ends = fit.select("owner", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("part"))
    other = ranked.drop("n").join(both_ends, ["owner", "part"]).withColumn("root", F.col("owner")).withColumn("every", F.lit(True))
    places = stored(places.unionByName(other), "places")
    # features move twice: to the places of their set, and from there to its blocks
    sets = _sets(own, bitmap(places, "id")).repartition(n, "id").groupBy("id", "k1", "k2").agg(F.first("features").alias("features"))
    members = sets.join(places, "id").where("(k1 ^ own_k1) = 0 and (k2 ^ own_k2) = 0")  # no keys of the join, which would move the features once more
    members = members.select("root", "lo", "hi", "every", "part", F.col("owner").isNotNull().alias("tied"), F.coalesce("owner", F.lit(0)).alias("owner"), "node", "copies", "features")
    links = members.groupBy("root", "lo", "hi", "every").applyInArrow(_check_block, "node long, others long, root long")
    links = stored(links, "links")
    del sets, members
    release(spark)
    degree = links.groupBy("node").agg(F.sum("others").alias("others"))
    roots = components(links, "node", "root")
    full = keys.join(degree, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = full.groupBy("root").agg(F.min("least_id").alias("component_id"))
    full = full.join(least, "root").select("k1", "k2", "copies", "component_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_similar"))
    full = stored(full, "sets")
    out = salted_join(rows.where("n > 0"), full, ["k1", "k2"], "copies", size[0], F.col("rid")).select("own_id", "n", "n_similar", "component_id", F.concat(F.hex("k1"), F.lit("-"), F.hex("k2")).alias("set_key"), "rid")
    alone = rows.where("n = 0").select("own_id", "n", F.lit(0).cast("long").alias("n_similar"), F.col("own_id").alias("component_id"), F.lit(None).cast("string").alias("set_key"), "rid")
    both = out.unionByName(alone)
    return both.select(F.col("own_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("n_similar").cast("long").alias("n_similar"), "component_id", "set_key")


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
features AS (SELECT doc_id, n, unnest(s) AS f FROM sized),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS xn, b.n AS yn, count(*) AS k
  FROM features a JOIN features b ON a.f = b.f AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * k >= 70 * (xn + yn - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
degrees AS (SELECT x AS doc_id, count(*) AS n FROM edges GROUP BY x),
reach AS (
  WITH RECURSIVE r(doc_id, seen) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT e.y, r.seen FROM r JOIN edges e ON e.x = r.doc_id WHERE r.seen < e.y)
  SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, coalesce(d.n, 0)::BIGINT AS n_similar, r.component_id,
FROM sized s LEFT JOIN degrees d USING (doc_id) JOIN reach r USING (doc_id)
"""

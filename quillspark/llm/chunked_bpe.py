"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over 32 bytes cuts texts where their content says so, so copied passages give equal
chunks wherever they stand. Chunks that occur more than once are encoded once each, in a table of
their own, and joined back to their places. Both sides of a join of two chunks are then re-encoded
from the last sure token bound of the left to the first of the right, going on to the next bound
until the tokens of the chunk agree with it.

A sure bound (anchor) is an ASCII space between two printable ASCII characters: the split pattern
can only start a match there, from whatever place it began, and what follows depends on nothing
before it. So the spliced ids are those of the whole text.

Cases: null and empty texts encode to no id and decode to an empty text; special tokens in a text
are found as the tokenizers library does, and such texts are encoded whole; repeated rows and
repeated or null ids keep their rows, as rows are told apart by a number of their own; a text
without an anchor is re-encoded whole; white-space runs of any length encode; texts of any
length are encoded whole; other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import bitmap, dropped, in_bitmap, stored, trimmed

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CUT_BITS = 10
MIN_CHUNK, MAX_CHUNK = 256, 16_384
HEAVY_MOST = 4096  # digests that can be heavy, hence bound of what is broadcast about them
FLUSH_BYTES = 4 << 20  # of text whose pieces a worker holds
SLICE_ROWS = 500  # of chunks or pieces that are Python objects at once
LONG_SPACE = 100_000  # runs of more white-space characters are matched here, not by the engine
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # \s of the pattern; Python's has more
_LONG_RUN = re.compile(rf"(?<![{_SPACE}])[{_SPACE}]{{{LONG_SPACE},}}")
_GEAR = np.random.Generator(np.random.PCG64(99)).integers(0, 2**32, 256, dtype=np.uint32)


class Codec:
    """Byte-level BPE of a ``tokenizers`` file, run by tiktoken where its ranks allow."""

    def __init__(self, path: str) -> None:
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE file")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if model["vocab"][left + right] != 256 + k:
                raise ValueError("ids don't follow the order of merges")
        self.special = list(added)
        self.engine = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.pieces = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        for text, i in added.items():
            self.pieces[i] = text.encode()
        self.lengths = np.array([len(p) for p in self.pieces])

    def has_special(self, data: bytes) -> bool:
        return any(s.encode() in data for s in self.special)

    def encode(self, data: bytes) -> np.ndarray:
        if len(data) <= LONG_SPACE:
            return self.engine.encode_to_numpy(data.decode(), allowed_special="all")
        # the engine's regular expressions fail on a million white-space characters, so long runs go around them
        text, done, out = data.decode(), 0, []
        for run in _LONG_RUN.finditer(text):
            stop = run.end()
            if stop < len(text) and not text.startswith(tuple(self.special), stop):
                stop -= 1  # \s+(?!\S) leaves the last character to what follows
            out.append(self.engine.encode_to_numpy(text[done : run.start()], allowed_special="all"))
            out.append(np.array(self.engine._core_bpe.encode_single_piece(text[run.start() : stop].encode()), np.uint32))
            done = stop
        out.append(self.engine.encode_to_numpy(text[done:], allowed_special="all"))
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def cuts(b: ts.Block) -> list[list[int]]:
    """Of each text its chunk bounds (from 0 to its length), at starts of UTF-8 characters."""
    d = b.data
    h = _GEAR[d]
    factor = np.uint32(0x01000193)
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            nxt = h * factor
            nxt[width:] += h[:-width]
            h = nxt
        factor = np.uint32(int(factor) ** 2 & 0xFFFFFFFF)
    at = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    found = []
    for i in range(b.n_docs):
        lo, hi = int(b.bounds[i]), int(b.bounds[i + 1])
        own, last = [0], lo
        for c in [*at[np.searchsorted(at, lo + MIN_CHUNK) : np.searchsorted(at, hi)].tolist(), hi]:
            while c - last > MAX_CHUNK:
                c2 = last + MAX_CHUNK
                while c2 < hi and (d[c2] & 0xC0) == 0x80:
                    c2 += 1
                own.append(c2 - lo)
                last = c2
            while c < hi and (d[c] & 0xC0) == 0x80:
                c += 1
            if c < hi and c - last >= MIN_CHUNK and hi - c >= MIN_CHUNK:
                own.append(c - lo)
                last = c
        if hi > lo:
            own.append(hi - lo)
        found.append(own)
    return found


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def keys(digests: list[bytes]) -> np.ndarray:
    """A long of each digest."""
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


def anchors(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    dark = (a > 32) & (a < 127)
    return np.flatnonzero((a[1:-1] == 32) & dark[:-2] & dark[2:]) + 1


def encoded_piece(c: Codec, data: bytes) -> tuple[bytes, bytes, bytes]:
    """Ids between the first and the last anchor that agree with the tokens; the bytes before and
    after. Without two such anchors all bytes come first, with no id."""
    ids = c.encode(data)
    ends = np.cumsum(c.lengths[ids])
    sure = np.intersect1d(anchors(data), ends, assume_unique=True)
    if not len(sure):
        return b"", data, b""
    first, last = int(sure[0]), int(sure[-1])
    lo, hi = np.searchsorted(ends, [first, last]) + 1
    return ids[lo:hi].astype("<u2" if len(c.pieces) <= 65536 else "<u4").tobytes(), data[:first], data[last:]


def splice(c: Codec, pieces: list[tuple[bytes, bytes, bytes, bool]]) -> np.ndarray:
    """Ids of the text whose pieces these are: (ids, bytes before, bytes after, has an anchor)."""
    kind = "<u2" if len(c.pieces) <= 65536 else "<u4"
    out, open_text = [], b""
    for ids, before, after, sure in pieces:
        open_text += before
        if sure:
            out += [c.encode(open_text), np.frombuffer(ids, kind)]
            open_text = after
    out.append(c.encode(open_text))
    return np.concatenate(out).astype("<u4")


def _texts(batch_text: pa.Array) -> Iterator[tuple[int, bytes, list[int]]]:
    for b in ts.blocks(batch_text):
        raw = b.data.tobytes()
        for i, own in enumerate(cuts(b)):
            yield b.first + i, raw[b.bounds[i] : b.bounds[i + 1]], own


def _repeated(docs: DataFrame, text: str) -> tuple[np.ndarray, dict[bytes, int]]:
    """Bitmap of the digests of chunks that occur twice or more, and ways to split heavy ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(digest(data[x:y]) for _, data, own in _texts(batch.column(0)) for x, y in zip(own, own[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["digest", "n"])

    chunks = docs.select(text).mapInArrow(trimmed(count), "digest binary, n long").groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    chunks = stored(chunks, "chunks")

    packed = bitmap(chunks, "digest", lambda column: keys(column.to_pylist()))
    total = chunks.agg(F.sum("n")).first()[0] or 0
    limit = max(1000, total // HEAVY_MOST + 1)
    heavy = {bytes(r.digest): min(256, -(-r.n // limit)) for r in chunks.where(F.col("n") > limit).collect()}
    dropped(chunks)
    return packed, heavy


def flagged(data: bytes, bounds: list[int], bits: np.ndarray, c: Codec) -> list[bytes] | None:
    """Digests of the chunks (empty where not repeated), or None if none is."""
    found = [digest(data[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
    marks = in_bitmap(bits, keys(found)).tolist()
    if not any(marks) or c.has_special(data):
        return None
    return [d if m else b"" for d, m in zip(found, marks, strict=True)]


def cut_pieces(batch: pa.RecordBatch, c: Codec, bits: np.ndarray, ways: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Pieces of the texts of a batch (own_id, text, uid) that have a repeated chunk, and each such chunk once,
    in batches of the pieces of about FLUSH_BYTES of text."""
    uids = batch.column(2).to_pylist()
    sent: set[bytes] = set()
    out: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        columns = [pa.array([x[n + 1] for x in out], t) for n, t in enumerate(kinds)]
        rows = pa.array([x[0] for x in out], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0).take(rows), *columns], names=["own_id", "uid", "pos", "digest", "salt", "ids", "before", "after", "chunk"])

    for i, data, bounds in _texts(batch.column(1)):
        marks = flagged(data, bounds, bits, c)
        if marks is None:
            continue
        k = 0
        while k < len(marks):
            if marks[k]:
                out.append((i, uids[i], k, marks[k], uids[i] % ways.get(marks[k], 1), None, None, None, None))
                if marks[k] not in sent:
                    sent.add(marks[k])
                    out.append((None, None, None, marks[k], 0, None, None, None, data[bounds[k] : bounds[k + 1]]))
                k += 1
                continue
            j = k
            while j < len(marks) and not marks[j]:
                j += 1
            ids, before, after = encoded_piece(c, data[bounds[k] : bounds[j]])
            out.append((i, uids[i], k, None, 0, ids, before, after, None))
            k = j
        held += len(data)
        if held > FLUSH_BYTES:
            yield flush()
            out, held = [], 0
    yield flush()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE_ROWS rows, so Python objects are made of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def encoded_chunks(batches: Iterator[pa.RecordBatch], c: Codec) -> Iterator[pa.RecordBatch]:
    """Of each row (digest, chunk) the digest and the encoded piece, a batch for each slice."""
    for part in _slices(batches):
        done = [encoded_piece(c, x) for x in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([d[k] for d in done], pa.binary()) for k in range(3))], names=["digest", "ids", "before", "after"])


def joined_rows(batches: Iterator[pa.RecordBatch], c: Codec) -> Iterator[pa.RecordBatch]:
    """Rows (own_id, ids, decoded) of pieces (uid, pos, own_id, ids, before, after) that come by uid and pos, in
    batches of about 2 * FLUSH_BYTES of ids, also where one batch of pieces holds more."""
    uid, owner, parts = None, None, []
    rows: list[tuple] = []
    size, id_kind = 0, pa.int64()

    def close() -> None:
        nonlocal size
        x = splice(c, parts)
        rows.append((owner, x.tobytes(), c.decode(x).decode("utf-8", "replace")))
        size += len(rows[-1][1])

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_kind), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.string())], names=["own_id", "ids", "decoded"])

    for part in _slices(batches):
        id_kind = part.schema.field("own_id").type
        u, o, i, x, y = (part.column(n).to_pylist() for n in (0, 2, 3, 4, 5))
        for k in range(len(u)):
            if u[k] != uid:
                if parts:
                    close()
                    if size > 2 * FLUSH_BYTES:
                        yield flush()
                        rows, size = [], 0
                uid, owner, parts = u[k], o[k], []
            parts.append((i[k], x[k], y[k], bool(i[k] or y[k])))
    if parts:
        close()
    if rows:
        yield flush()


def encode(docs: DataFrame, path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id_col``, ``ids`` (little-endian unsigned 32-bit) and ``decoded``."""
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text).alias("text"))
    id_type = own.schema["own_id"].dataType.simpleString()
    packed, heavy = _repeated(own, "text")
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((packed, heavy))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, (bits, _) = codec(path), shared.value
        for batch in batches:
            rows, ids, back, held = [], [], [], 0
            for i, data, bounds in _texts(batch.column(1)):
                if flagged(data, bounds, bits, c) is None:
                    x = c.encode(data).astype("<u4")
                    rows.append(i)
                    ids.append(x.tobytes())
                    back.append(c.decode(x).decode("utf-8", "replace"))
                    held += len(data)
                    if held > FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=["own_id", "ids", "decoded"])
                        rows, ids, back, held = [], [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=["own_id", "ids", "decoded"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, (bits, ways) = codec(path), shared.value
        for batch in batches:
            yield from cut_pieces(batch, c, bits, ways)

    pieces = own.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(trimmed(cut_up), f"own_id {id_type}, uid long, pos int, digest binary, salt int, ids binary, before binary, after binary, chunk binary")
    pieces = stored(pieces, "pieces")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded_chunks(batches, codec(path))

    table = pieces.where("chunk is not null").groupBy("digest").agg(F.first("chunk").alias("chunk")).mapInArrow(trimmed(once), "digest binary, ids binary, before binary, after binary")
    if heavy:
        # from Arrow, as rows of Python objects would start Python workers of another kind, which the executors keep
        ways = docs.sparkSession.createDataFrame(pa.table({"digest": pa.array(list(heavy), pa.binary()), "ways": pa.array(list(heavy.values()), pa.int32())}))
        table = table.join(F.broadcast(ways), "digest", "left").select(*table.columns, F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)).alias("salt"))
    else:
        table = table.withColumn("salt", F.lit(0))
    placed = pieces.where("uid is not null and digest is not null").select("own_id", "uid", "pos", "digest", "salt").join(table, ["digest", "salt"])
    local = pieces.where("uid is not null and digest is null")
    cols = ["uid", "pos", "own_id", "ids", "before", "after"]

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined_rows(batches, codec(path))

    joined = placed.select(*cols).unionByName(local.select(*cols)).repartition("uid").sortWithinPartitions("uid", "pos")
    out = f"own_id {id_type}, ids binary, decoded string"
    both = own.mapInArrow(trimmed(alone), out).unionByName(joined.mapInArrow(trimmed(join_up), out))
    return both.withColumnRenamed("own_id", id_col)

"""PartEnum signatures of shingle sets, for an exact Jaccard join (see ``ngram_jaccard``).

Sets are put in size bands: band L takes sizes from 2^L to 2^(L+1) - 1, and also smaller sets from
the least size that can be similar to one of them, so two similar sets share a band. In band L the
feature domain is cut into 2^L partitions by the high bits of the hash. Two sets of a band within
Hamming distance k differ in at most k partitions, so of the partitions with a feature, put in one fixed
order, the i-th that is equal in both is among the first k + i of each. Each set therefore shows its
first k + m partitions as signatures, and similar sets have m of them in common: that is the same
as one common subset out of the enumeration of all subsets of m partitions, counted instead of
listed. m grows with the size (``shared``), so that a passage in common doesn't make a candidate. The order goes by levels: partitions of common
features ("hot", by one corpus-wide table) come last, the more common the later, which keeps signatures
selective without losing a pair. Warm partitions are shown as the rarest are. Hot partitions are shown only up to the first level with which a set
has more than k, as then it has one in common with any similar set; it needs so many fewer. A set with
at most k partitions filled adds its first features themselves, by the prefix bound, and needs one in common.
"""

from __future__ import annotations

import numpy as np

from . import textscan as ts

NUM, DEN = 70, 100  # Jaccard threshold
HOT_BITS = 23
LEVELS = 6  # above the rarest features: one of warm ones, then of hot ones, each four times as common as the one before
_U32 = ts.U(32)


def least_shared(total: int) -> int:
    """Least intersection of two similar sets whose sizes add up to ``total``."""
    return -(-NUM * total // (NUM + DEN))


def farthest(n: int, band: int) -> int:
    """Most features in which a set of size n differs from a similar set in the band."""
    top = min(n * DEN // NUM, (2 << band) - 1)
    return max(n + s - 2 * least_shared(n + s) for s in (top, max(top - 1, 1)))


def shared(n: int) -> int:
    """Signatures beyond the first k that a set of size n shows."""
    return max(3, n // 16)


def bands(n: int) -> list[int]:
    own = n.bit_length() - 1
    return [own, own + 1] if n * DEN >= NUM * (2 << own) else [own]


def shingles(b: ts.Block) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, and their offsets."""
    h = b.word_hashes(True)
    grams, bounds = ts.trigrams(h, b.word_bounds)
    n = b.n_words()
    short = np.flatnonzero((n == 1) | (n == 2))
    extra = {}
    for i in short.tolist():
        w = h[b.word_bounds[i] : b.word_bounds[i + 1]]
        extra[i] = ts.mix(w[:1] * ts.M1 + ts.U(17)) if len(w) == 1 else ts.mix(w[:1] * ts.M1 + w[1:] * ts.M2 + ts.U(29))
    sets = []
    for i in range(b.n_docs):
        s = extra.get(i)
        if s is None:
            s = np.sort(grams[bounds[i] : bounds[i + 1]])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        sets.append(s)
    out = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from any other; as signed integers."""
    a = ts.mix(np.array([np.add.reduce(s), np.add.reduce(ts.mix(s ^ ts.M3))], np.uint64) + ts.U(len(s)))
    return int(a[0].astype(np.int64)), int(a[1].astype(np.int64))


def hot_slots(s: np.ndarray) -> np.ndarray:
    return (s & ts.U((1 << HOT_BITS) - 1)).astype(np.int64)


def signatures(s: np.ndarray, level: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """64-bit signatures of one sorted set in one band, and how many of them any similar set of the
    band has too (of the two sets' numbers, the least holds)."""
    n = len(s)
    far = farthest(n, band)
    want = far + shared(n)
    out, have = [], 0
    for flag in np.unique(level).tolist():
        if have >= want or flag > 1 and have > far:
            break
        part = s[level == flag]
        index = ((part >> _U32) * ts.U(1 << band)) >> _U32
        first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        sums = np.add.reduceat(part, first)[: want - have]
        salt = ts.U(((LEVELS + 1) * band + flag + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        out.append(ts.mix(sums * ts.M1 + index[first[: want - have]] * ts.M2 + salt))
        have += len(out[-1])
    if have <= far:
        salt = ts.U((1000 + band) * 0x9E3779B97F4A7C15 & (2**64 - 1))
        out.append(ts.mix(s[: n - (-(-NUM * n // DEN)) + 1] * ts.M2 + salt))
        return np.concatenate(out), 1
    return np.concatenate(out), min(shared(n), have - far, 255)

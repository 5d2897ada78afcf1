"""Quality rules: a linear-chain CRF labels the lines of a text as content or boilerplate.

The share of a text's words that stand in content lines decides whether it stays. The CRF learns from
labelled lines: boilerplate are all lines of texts labelled bad, lines that several unlike texts of the
sample have in common (``known`` lines, kept in the model by their hash), and lines that a text repeats;
all others are content. Beside the texts themselves it sees mixtures, bad lines set between good ones,
so that it learns where one kind turns into the other.

Cases: a null or empty text has no line, no word and fails the base rules; lines without a word
carry no weight in the content share; rows are scored one by one, so repeated rows get equal
results; texts of any length are scored whole; only the named text column is read, other columns pass
through untouched, whatever their names; an empty table gives an empty result. A share that ties with
the threshold is kept. Of several labels of an id the least counts; without labels of both classes the
fixed weights ``DEFAULT`` are used.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts
from .common import labelled, trimmed

N_FEATURES = 13
KNOWN_DOCS = 3  # unlike texts of the sample that make a line known boilerplate
MIN_WORDS = 50
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass
class LineModel:
    """State 0 is content, 1 boilerplate. ``emit`` has a weight per feature for state 1 over 0."""

    emit: np.ndarray  # (N_FEATURES,)
    step: np.ndarray  # (2, 2) from, to
    min_share: float = 0.5
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of boilerplate lines


DEFAULT = LineModel(np.array([-2.0, 4, 3, 4, 4, 1, 0, 2, 4, 0, 0, 0, 4]), np.array([[1.0, 0], [0, 1.0]]))


def _per(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys: which have another, and which have an earlier one."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    other, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if not len(keys):
        return other, earlier
    other[order[1:][same]] = True
    other[order[:-1][same]] = True
    first = np.minimum.reduceat(order, np.flatnonzero(np.concatenate([[True], ~same])))
    earlier[:] = other
    earlier[first] = False
    return other, earlier


@dataclass
class Lines:
    stats: np.ndarray  # (docs, 5)
    features: np.ndarray  # (lines with a word, N_FEATURES)
    words: np.ndarray  # of each such line
    bounds: np.ndarray  # docs + 1
    hashes: np.ndarray  # of each such line


def analyse(b: ts.Block, known: np.ndarray = DEFAULT.known) -> Lines:
    data, docs = b.data, b.n_docs
    hashes = b.word_hashes(False)
    salt = ts.mix(np.arange(docs, dtype=np.uint64) + ts.U(1))
    n_words = b.n_words()
    stats = np.zeros((docs, 5), np.int64)
    stats[:, 0] = n_words
    inside = ~ts.SPACE[data]
    stats[:, 1] = _per(inside & ((data & 0xC0) != 0x80), b.bounds)
    symbol = _SYMBOL[data]
    stats[:, 2] = _per(symbol, b.bounds)
    grams, gram_bounds = ts.trigrams(hashes, b.word_bounds)
    if len(grams):
        per = np.diff(gram_bounds)
        twice, _ = _repeats(grams + np.repeat(salt, per))
        at = np.flatnonzero(twice)
        at = at + np.repeat(b.word_bounds[:-1] - gram_bounds[:-1], per)[at]
        covered = np.zeros(len(hashes), bool)
        for k in range(3):
            covered[at + k] = True
        stats[:, 4] = _per(covered, b.word_bounds)
    # lines: cut at newlines and at text bounds
    cut = np.zeros(len(data) + 1, bool)
    cut[b.bounds] = True
    cut[np.flatnonzero(data == 10) + 1] = True
    starts = np.flatnonzero(cut)[:-1]
    ends = np.append(starts[1:], len(data))[: len(starts)]  # none where all texts are empty
    if len(ends):
        ends = ends - (data[ends - 1] == 10)
    line_words = np.searchsorted(b.starts, ends) - (first := np.searchsorted(b.starts, starts))
    keep = line_words > 0
    starts, ends, line_words, first = starts[keep], ends[keep], line_words[keep], first[keep]
    doc = np.searchsorted(b.bounds, starts, "right") - 1
    line_hashes = ts.span_hashes(data, starts, ends)
    _, earlier = _repeats(line_hashes + salt[doc])
    stats[:, 3] = np.bincount(doc[earlier], minlength=docs)
    f = np.zeros((len(starts), N_FEATURES))

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.minimum(1.0, (sums[ends] - sums[starts]) / np.maximum(of, 1))

    if len(starts):
        again = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]]), out=again[1:])
        letters = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_ALPHA[data], out=letters[1:])
        f[:, 0] = 1
        f[:, 1] = share(symbol, line_words)
        f[:, 2] = share(_UPPER[data], letters[ends] - letters[starts]) > 0.6
        f[:, 3] = share(data == 33, line_words)
        f[:, 4] = np.minimum(1, (again[first + line_words] - again[first + np.minimum(1, line_words - 1)]) / line_words)
        f[:, 5] = earlier
        f[:, 6] = line_words <= 3
        f[:, 7] = share(_DIGIT[data], ends - starts)
        f[:, 8] = share(data == 124, line_words)
        f[:, 9] = np.concatenate([[True], doc[1:] != doc[:-1]])
        f[:, 10] = np.concatenate([doc[1:] != doc[:-1], [True]])
        f[:, 11] = line_words <= 15
        f[:, 12] = among(line_hashes, known)
    return Lines(stats, f, line_words, np.searchsorted(doc, np.arange(docs + 1)), line_hashes)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def viterbi(scores: np.ndarray, step: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Best state of each line. ``scores`` is state 1 over 0; the sequences advance together."""
    n = np.diff(bounds)
    state = np.zeros(len(scores), np.int8)
    if not len(scores):
        return state
    order = np.argsort(-n, kind="stable")
    start, n = bounds[:-1][order], n[order]
    longest = int(n[0])
    active = np.searchsorted(-n, -np.arange(1, longest + 1), "right")  # texts with a line t
    back = np.zeros((len(scores), 2), np.int8)
    a, c = np.zeros(len(n)), np.zeros(len(n))
    c[: active[0]] = scores[start[: active[0]]]
    for t in range(1, longest):
        k = active[t]
        at = start[:k] + t
        a0, a1, c0, c1 = a[:k] + step[0, 0], c[:k] + step[1, 0], a[:k] + step[0, 1], c[:k] + step[1, 1]
        back[at, 0], back[at, 1] = a1 > a0, c1 > c0
        a[:k], c[:k] = np.maximum(a0, a1), np.maximum(c0, c1) + scores[at]
    some = n > 0
    now = (c > a).astype(np.int8)
    state[start[some] + n[some] - 1] = now[some]
    for t in range(longest - 1, 0, -1):
        k = active[t]
        at = start[:k] + t
        now[:k] = back[at, state[at]]
        state[at - 1] = now[:k]
    return state


def likelihood(x: np.ndarray, on: np.ndarray, y: np.ndarray, emit: np.ndarray, step: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the lines' labels and its gradients by ``emit`` and ``step``.

    ``x`` (lines, sequences, features), ``on`` which lines there are, ``y`` their labels; sequences
    advance together."""
    longest = len(x)
    s = x @ emit
    e = np.stack([np.zeros_like(s), s], -1)
    fwd = np.zeros_like(e)
    fwd[0] = e[0]
    for t in range(1, longest):
        new = np.logaddexp(fwd[t - 1, :, :1] + step[0], fwd[t - 1, :, 1:] + step[1]) + e[t]
        fwd[t] = np.where(on[t, :, None], new, fwd[t - 1])
    z = np.logaddexp(fwd[-1, :, 0], fwd[-1, :, 1])
    bwd = np.zeros_like(e)
    pair = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        w = e[t] + bwd[t]
        pair += (np.exp(fwd[t - 1, :, :, None] + step + w[:, None, :] - z[:, None, None]) * on[t, :, None, None]).sum(0)
        new = np.logaddexp(step[:, 0] + w[:, None, 0], step[:, 1] + w[:, None, 1])
        bwd[t - 1] = np.where(on[t, :, None], new, 0.0)
    p1 = np.exp(fwd[..., 1] + bwd[..., 1] - z) * on
    moves = on[1:]
    gold = np.array([[((y[:-1] == i) & (y[1:] == j) & moves).sum() for j in (0, 1)] for i in (0, 1)])
    value = (s * (y == 1) * on).sum() + (gold * step).sum() - z.sum()
    return float(value), np.einsum("tnf,tn->f", x, on * (y == 1) - p1), gold - pair


def train(features: list[np.ndarray], labels: list[np.ndarray], rounds: int = 120, rate: float = 0.5, l2: float = 1e-3, window: int = 64) -> LineModel:
    """Maximum likelihood by gradient ascent; ``labels`` has one per line.

    Long texts are cut into windows of ``window`` lines, which all count.
    """
    parts = [(x[i : i + window], y[i : i + window]) for x, y in zip(features, labels, strict=True) for i in range(0, len(x), window)]
    if not parts or len(set(np.concatenate([y for _, y in parts]).tolist())) < 2:
        return DEFAULT
    emit, step = np.zeros(N_FEATURES), np.zeros((2, 2))
    longest = max(len(x) for x, _ in parts)
    x = np.zeros((longest, len(parts), N_FEATURES))
    on, y = np.zeros((longest, len(parts)), bool), np.zeros((longest, len(parts)), np.int8)
    for i, (p, own) in enumerate(parts):
        x[: len(p), i], on[: len(p), i], y[: len(p), i] = p, True, own
    total = on.sum()
    for _ in range(rounds):
        _, to_emit, to_step = likelihood(x, on, y, emit, step)
        emit += rate * (to_emit / total * 8 - l2 * emit)
        step += rate * (to_step / total * 8 - l2 * step)
    return LineModel(emit, step)


def common_lines(texts: list[np.ndarray]) -> np.ndarray:
    """Sorted hashes of the lines that ``KNOWN_DOCS`` unlike texts hold; texts that share over half of
    the lines of the shorter one are copies and count once."""
    sets = [set(t.tolist()) for t in texts]
    holders: dict[int, list[int]] = defaultdict(list)
    for i, own in enumerate(sets):
        for h in own:
            holders[h].append(i)
    known = []
    for h, docs in holders.items():
        unlike: list[int] = []
        for i in docs if len(docs) >= KNOWN_DOCS else ():
            if all(2 * len(sets[i] & sets[j]) <= min(len(sets[i]), len(sets[j])) for j in unlike):
                unlike.append(i)
            if len(unlike) == KNOWN_DOCS:
                known.append(h)
                break
    return np.sort(np.array(known, np.uint64))


def mixtures(good: list[tuple[np.ndarray, np.ndarray]], bad: list[np.ndarray], seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """Good texts with a run of up to eight bad lines in them, as (features, labels); each good and each
    bad text is used at least once."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = []
    for k in range(max(len(good), len(bad)) if good and bad else 0):
        (x, y), b = good[k % len(good)], bad[k % len(bad)]
        at, n = int(rng.integers(0, len(x) + 1)), int(rng.integers(1, 9))
        lo = int(rng.integers(0, max(1, len(b) - n + 1)))
        mixed = np.concatenate([x[:at], b[lo : lo + n], x[at:]])
        mixed[:, 9:11] = 0
        mixed[0, 9] = mixed[-1, 10] = 1
        out.append((mixed, np.concatenate([y[:at], np.ones(len(b[lo : lo + n]), np.int8), y[at:]])))
    return out


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> LineModel:
    """A model from texts as (features, line hashes, class; 0 is bad)."""
    rows = [r for r in rows if len(r[1])]
    known = common_lines([h for _, h, _ in rows])
    made = []
    for x, h, good in rows:
        x = x.copy()
        x[:, 12] = among(h, known)
        made.append((x, np.where(x[:, 12] + x[:, 5] > 0, 1, 0).astype(np.int8) if good else np.ones(len(x), np.int8), good))
    whole = [(x, y) for x, y, _ in made]
    whole += mixtures([(x, y) for x, y, good in made if good], [x for x, _, good in made if not good])
    if len({good for *_, good in made}) < 2:
        return DEFAULT
    found = train([x for x, _ in whole], [y for _, y in whole])
    return LineModel(found.emit, found.step, known=known)


def _scored(batch_text: pa.Array, model: LineModel) -> dict[str, np.ndarray]:
    out = {k: [] for k in [*STATS, "n_lines", "n_content_lines", "content_share", "base_failed", "kept"]}
    for b in ts.blocks(batch_text):
        a = analyse(b, model.known)
        state = viterbi(a.features @ model.emit, model.step, a.bounds)
        content = _per((state == 0) * a.words, a.bounds)
        words = a.stats[:, 0]
        share = np.where(words > 0, content / np.maximum(words, 1), 0.0)
        failed = (words < MIN_WORDS) | (100 * a.stats[:, 4] > 50 * words)
        for i, k in enumerate(STATS):
            out[k].append(a.stats[:, i])
        out["n_lines"].append(np.diff(a.bounds))
        out["n_content_lines"].append(_per(state == 0, a.bounds))
        out["content_share"].append(share)
        out["base_failed"].append(failed)
        out["kept"].append(~failed & (share >= model.min_share))
    return {k: np.concatenate(v) if v else np.zeros(0) for k, v in out.items()}


def score(docs: DataFrame, model: LineModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id_col``, the base counts, line counts, content share and verdict."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _scored(batch.column(1), model)
            ints = [pa.array(s[k], pa.int64()) for k in [*STATS, "n_lines", "n_content_lines"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ints, pa.array(s["content_share"], pa.float64()), pa.array(s["base_failed"], pa.bool_()), pa.array(s["kept"], pa.bool_())], names=[id_col, *STATS, "n_lines", "n_content_lines", "content_share", "base_failed", "kept"])

    longs = ", ".join(f"{k} bigint" for k in [*STATS, "n_lines", "n_content_lines"])
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, {longs}, content_share double, base_failed boolean, kept boolean")


def keep(docs: DataFrame, model: LineModel, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(batch.column(at), model)["kept"], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 600) -> LineModel:
    """Train on at most ``max_docs`` labelled rows, those with the smallest hash of their id.

    Line features are made by the executors; texts never reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, hashes = [], []
            for b in ts.blocks(batch.column(1)):
                a = analyse(b)
                for i in range(b.n_docs):
                    lines.append(a.features[a.bounds[i] : a.bounds[i + 1]].astype(np.float16).tobytes())
                    hashes.append(a.hashes[a.bounds[i] : a.bounds[i + 1]].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lines, pa.binary()), pa.array(hashes, pa.binary())], names=["key", "quality", "lines", "hashes"])

    rows = labelled(docs, labels, max_docs).mapInArrow(run, "key string, quality int, lines binary, hashes binary").collect()
    rows.sort(key=lambda r: (r.key, bytes(r.hashes)))
    return learn([(np.frombuffer(r.lines, np.float16).reshape(-1, N_FEATURES).astype(float), np.frombuffer(r.hashes, np.uint64), int(r.quality > 0)) for r in rows])

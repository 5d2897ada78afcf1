"""Personal data: patterns with checks, plus spans that a semi-Markov CRF finds.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches of fixed patterns that pass
their check, found in time linear in the text. The CRF scores whole candidate segments of up to
``MAX_TOKENS`` tokens (length, digit and hex share, character classes, separators, words before) and
the steps from one segment's type to the next's; a dynamic programme over bounded segments picks
bounds and types jointly. Its kinds are ``secret`` (keys, access tokens, passwords) and
``local_phone`` (numbers without a country code). Base spans stand in the programme as segments of a
type of their own that are certain, so no added span overlaps one. The weights maximise the likelihood
of the segmentations of made-up lines (``fit``).

Candidates lie within ``REACH`` tokens of a digit or of a cue ("password =", "api_key:"), on one line,
hold a digit or follow a cue, and have at most ``MAX_CHARS`` characters: names and addresses in words
are no candidates.

Cases: null and empty texts have no span; spans count code points, end exclusive; repeated rows get
equal results; texts of any length, and runs of any length in them, are read whole; texts without a
digit, ``@`` or cue have no span of any kind by construction; other columns pass through ``redact``
untouched, whatever their names; of equal scores the plain reading wins; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.batches import slices
from .common import trimmed
from .textscan import text_buffers

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "local_phone")
KINDS = (*BASE, *ADDED)
MAX_TOKENS = 9
MAX_CHARS = 1024
REACH = 8  # tokens kept either side of one that can begin or hold an entity
PLAIN, CERTAIN = 0, len(ADDED) + 1  # labels: plain token, ADDED (from 1), base span
LABELS = len(ADDED) + 2
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_CUE = re.compile(r"(?i)(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer|credential)s?\Z")
_CUE_IN = r"(?i)(token|key|secret|passwo?r?d|pwd|auth|bearer|credential)s?[\"']?\s*[:=]"
_CALL = {"tel", "phone", "call", "mobile", "fax", "telephone", "cell"}
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each match has one "@": its name is the run of name characters before it, as far as the match
    before; names hold no "@", so no character is looked at twice."""
    free, before = 0, 0
    at = text.find("@")
    while at >= 0:
        lo = max(free, before)
        start = lo + len(text[lo:at].rstrip(_LOCAL))
        before = at + 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
            free = host.end()
        at = text.find("@", at + 1)


def _ips(text: str) -> Iterator[Span]:
    """Four number parts in a row within a run of digits and full stops."""
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts = run.group().split(".")
        at = run.start()
        k = 0
        while k + 3 < len(parts):
            four = parts[k : k + 4]
            if not all(four):
                at += len(parts[k]) + 1
                k += 1
                continue
            if all(len(p := x.lstrip("0")) <= 3 and (not p or int(p) <= 255) for x in four):
                yield "ip", at, at + sum(map(len, four)) + 3
            at += sum(map(len, four)) + 4
            k += 4


def base_spans(text: str) -> list[Span]:
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += _ips(text)
        for m in _CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37:  # 19 digits and the separators between them
                digits = re.sub(r"[^0-9]", "", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m.group())) <= 15:
                    found.append(("phone", m.start(), m.end()))
    return found


FEATURES = ["bias", "tokens", "hex", "mixed", "long", "longer", "entropy", "cue", "assigned", "quoted", "spaced", "ten", "seven", "groups", "opens", "plus", "letters", "humps", "twelve", "call", "inner_word", "edge", "dense", "grouped_ten"]
_BIT = {f: 1 << i for i, f in enumerate(FEATURES)}


@lru_cache(4096)
def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


class Window:
    """A run of tokens with what the features of its segments are made of."""

    def __init__(self, text: str, tokens: list[tuple[int, int]], certain: list[bool]) -> None:
        self.text, self.tokens, self.certain = text, tokens, certain
        self.words = [text[a:b] for a, b in tokens]
        n = len(tokens)
        self.digits, self.letters, self.gaps, self.breaks, self.fixed = ([0] * (n + 1) for _ in range(5))
        self.is_word = [w[0].isalnum() or w[0] == "_" for w in self.words]
        for i, w in enumerate(self.words):
            gap = text[tokens[i - 1][1] : tokens[i][0]] if i else ""
            self.digits[i + 1] = self.digits[i] + len(_DIGIT.findall(w))
            self.letters[i + 1] = self.letters[i] + sum(map(str.isalpha, w))
            self.gaps[i + 1] = self.gaps[i] + (gap != "")
            self.breaks[i + 1] = self.breaks[i] + ("\n" in gap)
            self.fixed[i + 1] = self.fixed[i] + certain[i]
        self.before = [self._context(i) for i in range(n)]

    def _context(self, i: int) -> int:
        last = self.words[max(0, i - 4) : i]
        f = _BIT["bias"]
        if any(_CUE.search(w) for w in last):
            f |= _BIT["cue"]
        if any(w.lower() in _CALL for w in last):
            f |= _BIT["call"]
        if any(w in ("=", ":") for w in last[-2:]):
            f |= _BIT["assigned"]
        if "+" in last[-3:]:
            f |= _BIT["plus"]
        return f

    def features(self, i: int, j: int) -> int:
        """Features of the segment of tokens i to j (exclusive) as a bit mask; 0 if it is no candidate."""
        if self.breaks[j] > self.breaks[i + 1] or self.fixed[j] > self.fixed[i] or not self.is_word[j - 1] or not (self.is_word[i] or self.words[i] == "("):
            return 0
        lo, hi = self.tokens[i][0], self.tokens[j - 1][1]
        f, digits, letters, one = self.before[i], self.digits[j] - self.digits[i], self.letters[j] - self.letters[i], self.gaps[j] == self.gaps[i + 1]
        if hi - lo > MAX_CHARS or not digits and not (one and letters >= 8 and f & _BIT["cue"]):
            return 0
        n = hi - lo
        if j - i > 1:
            f |= _BIT["tokens"]
        if not one:
            f |= _BIT["spaced"]
        s = self.text[lo:hi] if one else ""
        if one and n >= 16:
            f |= _BIT["long"]
        if one and n >= 28:
            f |= _BIT["longer"]
        if one and letters:
            if digits:
                f |= _BIT["mixed"]
                if digits * 4 >= n:
                    f |= _BIT["dense"]
                if n >= 16 and re.fullmatch(r"[0-9a-fA-F]+", s):
                    f |= _BIT["hex"]
            else:
                f |= _BIT["letters"]
                if re.search(r"[a-z][A-Z]", s):
                    f |= _BIT["humps"]
                if n >= 12:
                    f |= _BIT["twelve"]
            if _entropy(s) > 3.0:
                f |= _BIT["entropy"]
        after = self.text[hi : hi + 1]
        if i and self.words[i - 1] in ("'", '"', "`") and after == self.words[i - 1]:
            f |= _BIT["quoted"]
        if not letters:
            runs = [w for w in self.words[i:j] if w.isdigit()]
            if digits == 10:
                f |= _BIT["ten"]
                if [len(r) for r in runs] == [3, 3, 4] and all(w.isdigit() or w in "().-" for w in self.words[i:j]):
                    f |= _BIT["grouped_ten"]
            if digits == 7:
                f |= _BIT["seven"]
            if len(runs) >= 3:
                f |= _BIT["groups"]
            if self.words[i] == "(":
                f |= _BIT["opens"]
        elif j - i > 1 and any(w.isalpha() for w in self.words[i:j]):
            f |= _BIT["inner_word"]
        prior = self.text[lo - 1 : lo]
        if prior and (prior.isalnum() or prior in "_-./@+") or after and (after.isalnum() or after in "_-/@+"):
            f |= _BIT["edge"]
        return f


def windows(text: str, base: list[Span] | tuple = ()) -> Iterator[Window]:
    """Runs of tokens within reach of a token that holds a digit or is a cue with a sign after it.
    Tokens that a base span touches are certain."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    hot = [k for k, (a, b) in enumerate(tokens) if _DIGIT.search(text, a, b) or (_CUE.search(text[max(a, b - 16) : b]) and any(text[x] in ":=" for x, _ in tokens[k + 1 : k + 3]))]
    spans = sorted((a, b) for _, a, b in base)
    k, at, reach = 0, 0, -1
    while k < len(hot):
        lo, hi = max(0, hot[k] - REACH), hot[k] + REACH + 1
        k += 1
        while k < len(hot) and hot[k] - REACH <= hi:
            hi = hot[k] + REACH + 1
            k += 1
        certain = []
        for a, b in tokens[lo:hi]:
            while at < len(spans) and spans[at][0] < b:
                reach = max(reach, spans[at][1])
                at += 1
            certain.append(a < reach)
        yield Window(text, tokens[lo:hi], certain)


class Model:
    """Weights of the segment features by kind, and of the steps between labels."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray) -> None:
        self.weights, self.steps = weights, steps
        self._scores: dict[int, list[float]] = {}

    def scores(self, mask: int) -> list[float]:
        found = self._scores.get(mask)
        if found is None:
            on = [i for i in range(len(FEATURES)) if mask >> i & 1]
            found = self._scores[mask] = self.weights[:, on].sum(1).tolist()
        return found

    def __getstate__(self) -> tuple:
        return self.weights, self.steps

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)


def decode(win: Window, m: Model) -> list[Span]:
    """The best segmentation: at each token a plain token, a certain one, or an entity of up to
    MAX_TOKENS tokens."""
    n, step = len(win.tokens), m.steps.tolist()
    best = [[-math.inf] * LABELS for _ in range(n + 1)]
    back: list[list[tuple[int, int]]] = [[(0, 0)] * LABELS for _ in range(n + 1)]
    best[0][PLAIN] = 0.0
    into: list[list[tuple[float, int]]] = []  # at each place, of each label the best way to begin it there

    for e in range(n + 1):
        if e:
            label = CERTAIN if win.certain[e - 1] else PLAIN
            best[e][label], back[e][label] = into[e - 1][label][0], (e - 1, into[e - 1][label][1])
            for s in range(e - 1, max(-1, e - 1 - MAX_TOKENS), -1):
                mask = win.features(s, e)
                if mask:
                    for k, v in enumerate(m.scores(mask), 1):
                        if into[s][k][0] + v > best[e][k]:
                            best[e][k], back[e][k] = into[s][k][0] + v, (s, into[s][k][1])
        row = best[e]
        into.append([max((row[y] + step[y][x], -y) for y in range(LABELS)) for x in range(LABELS)])
        into[e] = [(v, -y) for v, y in into[e]]
    label = max(range(LABELS), key=lambda y: (best[n][y], -y))
    found, e = [], n
    while e:
        s, before = back[e][label]
        if PLAIN < label < CERTAIN:
            found.append((ADDED[label - 1], win.tokens[s][0], win.tokens[e - 1][1]))
        e, label = s, before
    return found[::-1]


def _examples(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """Made-up lines with marked entities and with look-alikes that are none."""
    rng = np.random.Generator(np.random.PCG64(seed))
    small = list("etaoinshrdlucm")

    def word(lo: int = 2, hi: int = 9) -> str:
        return "".join(rng.choice(small, rng.integers(lo, hi)))

    def digits(k: int) -> str:
        return "".join(map(str, rng.integers(0, 10, k)))

    def key() -> str:
        kind = rng.integers(4)
        if kind == 0:
            return "".join(rng.choice(list("0123456789abcdef"), rng.choice([18, 32, 40, 64])))
        alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
        if kind == 3:
            return word(8, 16).title() + word(3, 8).title()
        return ("AKIA" if kind == 1 else "") + "".join(rng.choice(alphabet, rng.integers(18, 40))) + digits(3)

    cues = ["token", "api_key", "secret", "password", "key", "access_token", "pwd"]
    made = []
    for _ in range(n):
        parts, marks, at = [], [], 0
        for _ in range(rng.integers(3, 8)):
            r = rng.integers(18)
            lead = inner = tail = ""
            kind = None
            if r == 0:
                lead, inner, tail, kind = f'{rng.choice(cues)} = "', key(), '"', "secret"
            elif r == 1:
                lead, inner, kind = f'{rng.choice(["token", "key", "bearer", "auth"])}: ', key(), "secret"
            elif r == 2:
                lead = str(rng.choice(["", "", "tel ", "call "]))
                inner, kind = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}) {} {}"]).format(digits(3), digits(3), digits(4)), "local_phone"
            elif r == 3:
                inner = digits(int(rng.integers(1, 8)))
            elif r == 4:
                inner = "+1 (" + digits(3) + ") " + digits(3) + "-" + digits(4)
            elif r == 5:
                inner = ".".join(str(x) for x in rng.integers(0, 256, 4))
            elif r == 6:
                inner = digits(16)
            elif r == 7:
                inner = f"{word()}.{digits(2)}@{word()}{digits(1)}.example.com"
            elif r == 8:
                inner = f"{2000 + rng.integers(30)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}"
            elif r == 9:
                inner = word() + digits(2)
            elif r == 10:
                lead, inner, tail, kind = f'{rng.choice(cues)} = "', word(12, 25), '"', "secret"
            elif r == 11:
                lead, inner, kind = f"{rng.choice(cues)}=", key(), "secret"
            elif r == 12:
                inner = f"{rng.choice(cues)}: {word()} {word()}"
            elif r == 13:
                inner = f"{rng.choice(cues)} = {word(8, 11)}"
            else:
                inner = word() + str(rng.choice(["", ".", ","]))
            at0 = at + len(lead)
            if kind:
                marks.append((kind, at0, at0 + len(inner)))
            parts.append(lead + inner + tail)
            at += len(parts[-1]) + 1
        made.append((" ".join(parts), marks))
    return made


class Lattice:
    """All candidate segments of some windows as arrays, for the likelihood over all of them at once."""

    def __init__(self, marked: list[tuple[Window, list[Span]]]) -> None:
        self.longest = max((len(w.tokens) for w, _ in marked), default=0)
        self.n = len(marked)
        place, masks, gold = [], [], []
        self.certain = np.zeros((self.n, self.longest), bool)
        self.length = np.array([len(w.tokens) for w, _ in marked], int)
        self.steps = np.zeros((LABELS, LABELS))
        for x, (w, marks) in enumerate(marked):
            self.certain[x, : len(w.tokens)] = w.certain
            want = {(a, b): k for k, a, b in marks}
            spans = {}
            for s in range(len(w.tokens)):
                for e in range(s + 1, min(len(w.tokens), s + MAX_TOKENS) + 1):
                    mask = w.features(s, e)
                    if mask:
                        kind = want.get((w.tokens[s][0], w.tokens[e - 1][1]))
                        place.append((x, e - 1, e - s - 1))
                        masks.append([mask >> i & 1 for i in range(len(FEATURES))])
                        gold.append(-1 if kind is None else ADDED.index(kind))
                        if kind is not None:
                            spans[s] = (e, gold[-1] + 1)
            s, label = 0, PLAIN
            while s < len(w.tokens):
                e, now = spans.get(s, (s + 1, CERTAIN if w.certain[s] else PLAIN))
                self.steps[label, now] += 1
                s, label = e, now
        self.place = np.array(place, int).reshape(-1, 3).T
        self.phi = np.array(masks, float).reshape(-1, len(FEATURES))
        self.gold = np.array(gold, int)

    def likelihood(self, weights: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of the marked segmentations and its gradients."""
        n, T, K = self.n, self.longest, len(ADDED)
        own = self.phi @ weights.T
        seg = np.full((n, T, MAX_TOKENS, K), -np.inf)
        seg[tuple(self.place)] = own
        single = np.full((n, T, LABELS), -np.inf)
        single[..., PLAIN][~self.certain] = 0
        single[..., CERTAIN][self.certain] = 0
        fwd = np.full((n, T + 1, LABELS), -np.inf)
        fwd[:, 0, PLAIN] = 0
        into = np.full((n, T + 1, LABELS), -np.inf)

        def total(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                return np.log(np.exp(x - np.expand_dims(safe, axis)).sum(axis)) + safe

        for e in range(T + 1):
            if e:
                alone = into[:, e - 1] + single[:, e - 1]
                m = min(e, MAX_TOKENS)
                longer = into[:, e - m : e, 1 : K + 1][:, ::-1] + seg[:, e - 1, :m]
                fwd[:, e] = alone
                fwd[:, e, 1 : K + 1] = total(longer, 1)
            into[:, e] = total(fwd[:, e, :, None] + steps, 1)
        ends = fwd[np.arange(n), self.length]
        z = total(ends, 1)
        bwd = np.full((n, T + 1, LABELS), -np.inf)
        bwd[np.arange(n), self.length] = 0
        start = np.full((n, T + 1, LABELS), -np.inf)  # of a label that begins at a place, all that follows
        for s in range(T - 1, -1, -1):
            start[:, s] = single[:, s] + bwd[:, s + 1]
            m = min(T - s, MAX_TOKENS)
            span = seg[:, np.arange(s, s + m), np.arange(m)] + bwd[:, s + 1 : s + m + 1, 1 : K + 1]
            start[:, s, 1 : K + 1] = total(span, 1)
            bwd[:, s] = np.where((s < self.length)[:, None], total(start[:, s, None, :] + steps, 2), bwd[:, s])
        with np.errstate(invalid="ignore"):
            used = np.exp(fwd[:, :T, :, None] + steps + start[:, :T, None, :] - z[:, None, None, None])
        used = np.nan_to_num(used) * (np.arange(T) < self.length[:, None])[..., None, None]
        x, last, width = self.place
        chance = np.exp(into[x, last - width, 1 : K + 1] + own + bwd[x, last + 1, 1 : K + 1] - z[x, None])
        hit = np.zeros_like(chance)
        some = self.gold >= 0
        hit[np.flatnonzero(some), self.gold[some]] = 1
        value = (own * hit).sum() + (self.steps * steps).sum() - z.sum()
        return float(value), (hit - chance).T @ self.phi, self.steps - used.sum((0, 1))


def fit(examples: list[tuple[str, list[Span]]], rounds: int = 70, rate: float = 0.4, l2: float = 0.05) -> Model:
    """Weights of maximum likelihood over marked texts, by gradient ascent with adaptive rates."""
    marked = []
    for text, marks in examples:
        for w in windows(text, base_spans(text)):
            lo, hi = w.tokens[0][0], w.tokens[-1][1]
            marked.append((w, [m for m in marks if lo <= m[1] and m[2] <= hi]))
    lattice = Lattice(marked)
    at = np.zeros((len(ADDED), len(FEATURES))), np.zeros((LABELS, LABELS))
    seen = [np.zeros_like(x) for x in at]
    for _ in range(rounds):
        _, *slopes = lattice.likelihood(*at)
        for x, g, v in zip(at, slopes, seen, strict=True):
            g = g - l2 * x
            v += g * g
            x += rate * g / np.sqrt(v + 1e-9)
    return Model(*at)


@lru_cache(2)
def model(seed: int = 3, n: int = 200) -> Model:
    """The model of the made-up lines."""
    return fit(_examples(seed, n))


def spans(text: str | None, m: Model) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans, each by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    added = [s for w in windows(text, base) for s in decode(w, m)]
    return base, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def shown(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _suspect(column: pa.Array) -> np.ndarray:
    """Rows whose text holds a digit, ``@`` or a cue."""
    data, off = text_buffers(column)
    flags = np.zeros(256, bool)
    flags[48:58] = True
    flags[64] = True
    out = np.zeros(len(off) - 1, bool)
    for lo in range(0, len(out), 512):
        hi = min(lo + 512, len(out))
        hits = np.flatnonzero(flags[data[off[lo] : off[hi]]]) + off[lo]
        out[lo:hi] = np.searchsorted(hits, off[lo + 1 : hi + 1]) > np.searchsorted(hits, off[lo:hi])
    cold = np.flatnonzero(~out)
    if len(cold):
        out[cold] = np.asarray(pc.fill_null(pc.match_substring_regex(column.take(pa.array(cold)), _CUE_IN), False))
    return out


def find(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per input row: ``id_col`` and two arrays of spans (kind, start, end)."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind:string,start:bigint,stop:bigint>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    w = model()  # trained once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 1)):
            hot = _suspect(part.column(1))
            got = [spans(part.column(1)[i].as_py(), w) if h else ([], []) for i, h in enumerate(hot.tolist())]
            arrays = [pa.array([[dict(zip(("kind", "start", "stop"), s, strict=True)) for s in g[k]] for g in got], arrow) for k in range(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[id_col, "base", "added"])

    return docs.select(id_col, text).mapInArrow(trimmed(run), f"`{id_col}` {kind}, base {span}, added {span}")


def redacted(text: str, found: list[Span]) -> str:
    """Each span as its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The same rows and columns, with spans replaced in ``text`` and ``length`` brought up to date."""
    at = docs.columns.index(text)
    size = docs.columns.index(length) if length in docs.columns else None

    w = model()  # trained once, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = np.flatnonzero(_suspect(batch.column(at)))
            new, sizes = batch.column(at).to_pylist(), None
            changed = {}
            for i in hot.tolist():
                base, added = spans(new[i], w)
                if base or added:
                    new[i] = changed[i] = redacted(new[i], base + added)
            columns = list(batch.columns)
            if changed:
                columns[at] = pa.array(new, batch.schema.field(at).type)
                if size is not None:
                    sizes = batch.column(size).to_pylist()
                    for i, x in changed.items():
                        sizes[i] = len(x)
                    columns[size] = pa.array(sizes, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(trimmed(run), docs.schema)

"""License scans: text segments against license templates by Dice over word bigrams.

Segments are the lines of a text, its paragraphs (cut at blank lines) of two lines or more, and the
whole text where it has two paragraphs or more. Words are runs of ASCII letters and digits in lower
case; a segment's set is its distinct word bigrams. A template is compared only where the sizes of
both sets let Dice reach the threshold, and only where they share a bigram. The best template of a
segment (highest Dice, ties: first by name) counts.

Licences that no segment shows (over several paragraphs, a few lines of a paragraph, part of a line)
are found as windows of words: for each template all windows that begin and end with one of its
bigrams and reach the threshold, of which those of highest Dice are kept that don't overlap (another
end can't raise Dice). Of overlapping windows of several templates that with most shared bigrams
counts. A window adds nothing where it overlaps a segment that matches the same template or shares as
many bigrams with its own; else it counts, in place of the segments' matches that it overlaps and that
share fewer. ``oracle`` states the segments only, so texts with such licences differ from it.

Cases: null and empty texts, and segments of one word, match nothing; equal segments each count;
repeated rows get equal results; every input row gives one output row, matches or not; texts of any
length are read whole; only the named columns are read, so other columns may have any name; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts

THRESHOLD = (4, 5)  # Dice of 0.8, as a fraction
TEMPLATES: dict[str, str] = {
    "agpl-3.0-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-notice": "Released under CC0 1.0 Universal, dedicated to the public domain.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
_WORD = re.compile(rb"[a-z0-9]+")
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False


def words(data: bytes) -> list[bytes]:
    return _WORD.findall(data.lower())


def bigrams(data: bytes) -> frozenset[tuple[bytes, bytes]]:
    w = words(data)
    return frozenset(zip(w, w[1:], strict=False))


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: tuple[int, int]) -> None:
        self.p, self.q = threshold
        self.sets = sorted((name, bigrams(t.encode())) for name, t in templates.items())
        self.sets = [(n, s) for n, s in self.sets if s]
        own = [np.concatenate([self.keys(b) for b in ts.blocks(pa.array([templates[n]]), gap=_GAP)]) for n, _ in self.sets]
        self.table = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.holds = np.array([np.isin(self.table, k) for k in own]).reshape(len(own), -1).T.astype(np.int32)
        # shared bigrams without which no window can reach the threshold
        self.need = np.array([max(1, -(-self.p * len(s) // (2 * self.q - self.p))) for _, s in self.sets], np.int32)

    @staticmethod
    def keys(b: ts.Block) -> np.ndarray:
        h = b.word_hashes(True)
        return ts.mix(h[:-1] * ts.M1 + h[1:] * ts.M2) if len(h) > 1 else np.zeros(0, np.uint64)

    def best(self, segment: bytes) -> tuple[str, int, int] | None:
        """Best template with its shared and total bigram counts."""
        own = bigrams(segment)
        n, found = len(own), None
        for name, other in self.sets:
            m = len(other)
            # Dice can reach p/q only if 2*min(n, m) * q >= p * (n + m)
            if not n or 2 * min(n, m) * self.q < self.p * (n + m):
                continue
            shared = len(own & other)
            if 2 * shared * self.q >= self.p * (n + m) and (found is None or shared * found[2] > found[1] * (n + m)):
                found = (name, shared, n + m)
        return found

    def near(self, doc: np.ndarray, key: np.ndarray) -> dict[int, list[int]]:
        """Of each document that has enough bigrams of a template for a window, those templates;
        ``doc`` and ``key`` (places in the table) are those of the hits."""
        if not len(doc):
            return {}
        pairs = np.unique(doc * len(self.table) + key)
        docs, first = np.unique(pairs // len(self.table), return_index=True)
        enough = np.add.reduceat(self.holds[pairs % len(self.table)], first) >= self.need
        return {int(docs[k]): np.flatnonzero(enough[k]).tolist() for k in np.flatnonzero(enough.any(axis=1))}

    def windows(self, data: bytes, among: list[int]) -> list[tuple[int, int, str, int, int]]:
        """Windows that count, as (first byte, end, template, shared, total); of ``among`` only."""
        spans = [m.span() for m in _WORD.finditer(data.lower())]
        w = [data[x:y].lower() for x, y in spans]
        grams = list(zip(w, w[1:], strict=False))
        last: dict[tuple[bytes, bytes], int] = {}
        before, after = np.full(len(grams), -1), np.full(len(grams), len(grams))
        for k, g in enumerate(grams):
            if g in last:
                before[k] = last[g]
                after[last[g]] = k
            last[g] = k
        kept = []
        for t in among:
            name, other = self.sets[t]
            m = len(other)
            most = m * (2 * self.q - self.p) // self.p  # distinct bigrams of a window
            hit = np.fromiter((g in other for g in grams), bool, len(grams))
            found = []
            for x in np.flatnonzero(hit).tolist():
                # a window past the next place of its first bigram could begin later, with no less Dice
                size, stop = 2 * most, int(after[x])
                while True:
                    new = before[x : min(x + size, stop)] < x
                    n = np.cumsum(new)
                    if n[-1] > most or x + size >= stop:
                        break
                    size *= 2
                shared = np.cumsum(fresh := new & hit[x : x + len(new)])
                for y in np.flatnonzero(fresh & (2 * shared * self.q >= self.p * (n + m))).tolist():
                    found.append((x, x + y, int(shared[y]), int(n[y]) + m))
            kept += [(*f, name) for f in apart(found, lambda f: (-f[2] / f[3], f[0], f[1]))]
        kept = apart(kept, lambda f: (-f[2], -f[2] / f[3], f[4], f[0]))
        return [(spans[x][0], spans[y + 1][1], name, s, t) for x, y, s, t, name in kept]

    def scan(self, data: bytes, among: list[int] | None = None) -> list[tuple[str, int, int]]:
        lines, at = [], 0
        for line in data.split(b"\n"):
            lines.append((at, at + len(line)))
            at += len(line) + 1
        segments = list(lines)
        paragraphs: list[list[tuple[int, int]]] = [[]]
        for x, y in lines:
            if words(data[x:y]):
                paragraphs[-1].append((x, y))
            elif paragraphs[-1]:
                paragraphs.append([])
        paragraphs = [p for p in paragraphs if p]
        segments += [(p[0][0], p[-1][1]) for p in paragraphs if len(p) > 1]
        if len(paragraphs) > 1:
            segments.append((0, len(data)))
        found = [(x, y, *m) for x, y in segments if (m := self.best(data[x:y]))]
        more = self.windows(data, among if among is not None else list(range(len(self.sets)))) if among != [] else []
        meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
        more = [w for w in more if not any(meets(w, f) and (f[2] == w[2] or f[3] >= w[3]) for f in found)]
        found = [f for f in found if not any(meets(w, f) for w in more)]
        return [f[2:] for f in found + more]


def apart(found: list[tuple], rank) -> list[tuple]:
    """Of (first, last, ...) those that overlap none of a lower rank, by rank within a run of overlaps."""
    kept: list[tuple] = []
    run: list[tuple] = []
    end = -1
    for f in [*sorted(found), (float("inf"),)]:
        if f[0] > end and run:
            taken: list[tuple] = []  # by place
            for c in sorted(run, key=rank):
                k = bisect(taken, c[1], key=lambda t: t[0])  # only the last that begins before its end can overlap
                if not k or taken[k - 1][1] < c[0]:
                    taken.insert(k, c)
            kept += taken
            run = []
        if len(f) > 1:
            run.append(f)
            end = max(end, f[1])
    return kept


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: tuple[int, int] = THRESHOLD, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per input row: ``id_col``, ``n_matches``, ``licenses`` (name:count, by name), ``best_license``
    and ``best_dice`` (null without a match)."""
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(chosen, threshold)
        for batch in batches:
            n, listed, names, dice = [], [], [], []
            for b in ts.blocks(batch.column(1), gap=_GAP):
                keys = m.keys(b)
                at = np.searchsorted(m.table, keys)
                hit = np.flatnonzero(m.table[np.minimum(at, len(m.table) - 1)] == keys) if len(m.table) else at[:0]
                doc = np.searchsorted(b.word_bounds, hit, "right") - 1
                hot = set(np.unique(doc).tolist())
                near = m.near(doc, at[hit])
                for i in range(b.n_docs):
                    found = m.scan(b.data[b.bounds[i] : b.bounds[i + 1]].tobytes(), near.get(i, [])) if i in hot else []
                    counts = Counter(name for name, _, _ in found)
                    n.append(len(found))
                    listed.append(",".join(f"{k}:{v}" for k, v in sorted(counts.items())))
                    top = min(((-2 * s / t, name) for name, s, t in found), default=(None, None))
                    names.append(top[1])
                    dice.append(None if top[0] is None else -top[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(names, pa.string()), pa.array(dice, pa.float64())], names=[id_col, "n_matches", "licenses", "best_license", "best_dice"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_matches long, licenses string, best_license string, best_dice double")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle(templates: dict[str, str] | None = None, threshold: tuple[int, int] = THRESHOLD) -> str:
    """The same scan as DuckDB SQL."""
    rows = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in (TEMPLATES if templates is None else templates).items())
    p, q = threshold
    word = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    return f"""
WITH template(name, body) AS (VALUES {rows}),
tw AS (SELECT name, {word.format('body')} AS w FROM template),
tb AS (SELECT name, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM tw WHERE len(w) > 1),
lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS s FROM documents WHERE text IS NOT NULL),
marked AS (SELECT *, regexp_matches(s, '[A-Za-z0-9]') AS worded FROM lines),
blocks AS (SELECT *, sum(CASE WHEN worded THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM marked),
paragraphs AS (SELECT doc_id, p, string_agg(s, chr(10) ORDER BY k) AS s, count(*) AS n FROM blocks WHERE worded GROUP BY doc_id, p),
segments AS (
  SELECT doc_id, s FROM lines
  UNION ALL SELECT doc_id, s FROM paragraphs WHERE n > 1
  UNION ALL SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM paragraphs GROUP BY doc_id HAVING count(*) > 1)),
sw AS (SELECT row_number() OVER () AS sid, doc_id, {word.format('s')} AS w FROM segments),
sb AS (SELECT sid, doc_id, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS g FROM sw WHERE len(w) > 1),
compared AS (
  SELECT sid, doc_id, name, len(list_intersect(sb.g, tb.g)) AS shared, len(sb.g) + len(tb.g) AS total
  FROM sb JOIN tb ON 2 * least(len(sb.g), len(tb.g)) * {q} >= {p} * (len(sb.g) + len(tb.g))),
good AS (
  SELECT * FROM compared WHERE 2 * shared * {q} >= {p} * total
  QUALIFY row_number() OVER (PARTITION BY sid ORDER BY 2.0::DOUBLE * shared / total DESC, name) = 1),
counted AS (SELECT doc_id, name, count(*) AS n, max(2.0::DOUBLE * shared / total) AS d FROM good GROUP BY doc_id, name),
by_doc AS (
  SELECT doc_id, sum(n) AS n, string_agg(name || ':' || n, ',' ORDER BY name) AS listed,
         first(name ORDER BY d DESC, name) AS best, max(d) AS d
  FROM counted GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(listed, '') AS licenses, best AS best_license, d AS best_dice
FROM documents LEFT JOIN by_doc USING (doc_id)
"""

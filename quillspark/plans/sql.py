"""The rules once more, as DuckDB SQL.

What a rule must report of the fixture rows stands there as literal rows (``fixture.EXPECTED``), so a
wrong pattern shows. On the documents the SQL runs the patterns in another engine.

Text is masked to ASCII first (letters beyond it become ``_``, a word character as they are, other
characters ``~``), since RE2 knows ASCII words only. Looking ahead and behind is done on the pieces around a hit.
"""

from __future__ import annotations

import re

from ..functions.vocabulary import either, vocabulary, words
from ..operators.catalogue import NEAR_CODE, PROSE, Pattern, Rule, rules
from .fixture import expected, values

SEG = f"""seg AS (
  SELECT 'doc-' || doc_id AS seg_id, 'markdown' AS kind, text, NULL::VARCHAR AS follows_code FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT * FROM (VALUES {values()}) AS f(seg_id, kind, text, follows_code)),
masked AS (SELECT *, regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{{L}}]', '~', 'g'), '[^\\x00-\\x7F]', '_', 'g') AS m FROM seg)"""


DOCS = SEG.replace(f"""
  UNION ALL SELECT * FROM (VALUES {values()}) AS f(seg_id, kind, text, follows_code)""", "")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(names) -> str:
    return "(" + ", ".join(q(n) for n in names) + ")"


def _hits(name: str, regex: str, groups: int, source: str = "masked", column: str = "m", fold: bool = True) -> str:
    """CTE of (seg_id, kind, text, m, start, hit, rest, before) of all matches."""
    to = {0: "chr(1) || '\\0' || chr(2)", 2: "'\\1' || chr(1) || '\\2' || chr(2)", 3: "'\\1' || chr(1) || '\\2' || chr(2) || '\\3'"}[groups]
    flags = "(?i)" if fold else ""
    return f"""{name}_x AS (SELECT *, regexp_replace({column}, {q(flags + regex)}, {to}, 'g') AS x FROM {source}),
{name}_p AS (SELECT seg_id, kind, text, m, generate_subscripts(string_split(x, chr(1)), 1) AS k, unnest(string_split(x, chr(1))) AS piece FROM {name}_x WHERE contains(x, chr(1))),
{name}_s AS (SELECT *, sum(length(piece) - CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY seg_id ORDER BY k) AS done, lag(replace(piece, chr(2), '')) OVER (PARTITION BY seg_id ORDER BY k) AS before FROM {name}_p),
{name} AS (SELECT seg_id, kind, text, m, (done - length(piece) + 1)::BIGINT AS start, split_part(piece, chr(2), 1) AS hit, split_part(piece, chr(2), 2) AS rest, before FROM {name}_s WHERE k > 1)"""


def _re2(p: Pattern) -> str:
    return p.regex if p.sql is None else p.sql


def _kinds(rule: Rule) -> str:
    return f"kind IN {listed(rule.kinds)}" if rule.kinds else "true"


def _exempt(rule: Rule) -> str:
    return f"lower(regexp_extract(hit, {q(rule.word)}, 1)) NOT IN {listed(rule.exempt)}" if rule.exempt and rule.word else "true"


def _token_rule(names: list[str], kinds: str, first: bool) -> tuple[str, str]:
    cte = _hits("t", r"[A-Za-z][A-Za-z'-]*", 0)
    pick = f"SELECT seg_id, start, length(hit) AS length FROM t WHERE lower(hit) IN {listed(names)} AND {kinds}"
    return cte, pick + (" QUALIFY row_number() OVER (PARTITION BY seg_id, lower(hit) ORDER BY start) = 1" if first else "")


def _special(rule_id: str) -> tuple[list[str], list[str]] | None:
    prose = f"kind IN {listed(PROSE)}"
    if rule_id == "C-4":
        stop = f"lower(hit) IN {listed(words('breakers') + words('determiners'))} OR lower(hit) LIKE '%ly'"
        cte = _hits("t", "[A-Za-z][A-Za-z-]*", 0)
        more = f"""w AS (SELECT *, lower(hit) IN {listed(words('determiners'))} AS det, ({stop}) AS breaks, regexp_matches(lag(rest) OVER (PARTITION BY seg_id ORDER BY start), '^[ \\t]*-?[ \\t]*$') AS near FROM t WHERE {prose} OR kind = 'string'),
g AS (SELECT *, sum(CASE WHEN breaks OR NOT coalesce(near, false) THEN 1 ELSE 0 END) OVER (PARTITION BY seg_id ORDER BY start) AS run FROM w),
r AS (SELECT seg_id, run, first(det ORDER BY start) AS det, count(*) - 1 AS n, list(start ORDER BY start)[2] AS start, max(start + length(hit)) AS stop FROM g GROUP BY seg_id, run)"""
        return [cte, more], ["SELECT seg_id, start, stop - start AS length FROM r WHERE det AND n > 3"]
    if rule_id == "1.14":
        cte, pick = _token_rule(words("spelling"), "true", False)
        other = rules()["1.14#1"]
        return [cte, _hits("h", other.patterns[0].regex, 0)], [pick, f"SELECT seg_id, start, length(hit) AS length FROM h WHERE {_exempt(other)}"]
    if rule_id == "1.1":
        cte, pick = _token_rule(list(vocabulary()["not_approved"]), f"kind IN {listed((*PROSE, 'string', 'commit'))}", True)
        return [cte], [pick]
    if rule_id == "C-5":
        nouns = "pay|income|margin|profit|revenue|sales|total|amount|value|weight|salary|receipts|earnings|merchandise|domestic"
        return [_hits("h", rules()["C-5"].patterns[0].regex, 0), _hits("g", r"\bgross\b", 0)], ["SELECT seg_id, start, length(hit) AS length FROM h", f"SELECT seg_id, start, length(hit) AS length FROM g WHERE NOT regexp_matches(rest, '(?i)^\\s+(?:{nouns})\\b')"]
    if rule_id == "8.1":
        code = r"&\w+;|&#\d+;|[){\]]\s*;|;\s*$|^\s*;|:\s*\w+\s*;"
        lines = f"""l0 AS (SELECT seg_id, kind, text, generate_subscripts(string_split(m, chr(10)), 1) AS n, unnest(string_split(m, chr(10))) AS m FROM masked),
l1 AS (SELECT seg_id || '@' || n AS seg_id, seg_id AS own, kind, text, m, sum(length(m) + 1) OVER (PARTITION BY seg_id ORDER BY n) - length(m) - 1 AS base FROM l0),
l2 AS (SELECT * FROM l1 WHERE contains(m, ';') AND NOT regexp_matches(m, {q(code)}))"""
        return [lines, _hits("h", ";", 0, source="l2")], ["SELECT own AS seg_id, (base + start)::BIGINT AS start, length(hit) AS length FROM h JOIN l2 USING (seg_id)"]
    if rule_id == "A-8":
        return [_hits("h", rules()["A-8"].patterns[0].regex, 0)], [f"SELECT seg_id, min(start) AS start, arg_min(length(hit), start) AS length FROM h WHERE kind IN {listed(NEAR_CODE)} GROUP BY seg_id HAVING count(*) >= 3"]
    if rule_id == "S-1":
        parts = rules()["S-1"].patterns[0].regex.split(r"|\b")
        parts = [parts[0], *(r"\b" + x for x in parts[1:])]
        ctes, picks = [], []
        for k, part in enumerate(parts):
            m = re.search(r"\(\?! \(\?:([^)]*)\)\)$", part)
            ctes.append(_hits(f"h{k}", part[: m.start()] if m else part, 0))
            picks.append(f"SELECT seg_id, start, length(hit) AS length FROM h{k} WHERE {prose}" + (f" AND NOT regexp_matches(rest, '(?i)^ (?:{m.group(1)})')" if m else ""))
        return ctes, picks
    if rule_id == "S-2":
        whole = rules()["S-2"].patterns[0].regex
        old = r"\bthe old (?:way|logic|version|approach|behaviou?r|implementation)\b"
        used = whole[whole.rindex(r"\bused to") :]
        plain = whole[: whole.index("|" + old)]
        return [_hits("a", plain, 0), _hits("b", old, 0), _hits("c", used, 0)], [
            f"SELECT seg_id, start, length(hit) AS length FROM a WHERE {prose}",
            f"SELECT seg_id, start, length(hit) AS length FROM b WHERE {prose} AND NOT regexp_matches(rest, '(?i)^ of\\b')",
            f"SELECT seg_id, start, length(hit) AS length FROM c WHERE {prose} AND NOT regexp_matches(before, '(?i)\\b(?:is|are|was|were|be|been|being) $')",
        ]
    if rule_id == "S-3":
        r = rules()["S-3"]
        return [_hits("h", r.patterns[0].regex, 3)], [f"SELECT seg_id, start, length(hit) AS length FROM h WHERE {_kinds(r)} AND NOT regexp_matches(hit, '(?i)\\b(?:IEEE|ISO|PEP|RFC)[- ]?\\d+\\b|/licenses?/')"]
    if rule_id == "S-4":
        a, b = rules()["S-4"], rules()["S-4#1"]
        dated = r"(?i)\bv?\d+\.\d+|\bversion \d|\b(?:19|20)\d{2}\b"
        return [_hits("a", a.patterns[0].regex, 0), _hits("b", b.patterns[0].regex, 0)], [f"SELECT seg_id, start, length(hit) AS length FROM a WHERE {_kinds(a)}", f"SELECT seg_id, start, length(hit) AS length FROM b WHERE {_kinds(b)} AND NOT regexp_matches(m, {q(dated)})"]
    if rule_id == "V-1":
        def content(c: str) -> str:
            split = f"regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
            return f"list_distinct([lower(w) for w in string_split_regex({split}, '[^A-Za-z0-9]+') if regexp_full_match(w, '[A-Za-z]+') AND length(w) > 2 AND lower(w) NOT IN {listed(words('weak'))}])"

        cte = f"v AS (SELECT seg_id, text, {content('text')} AS w, {content('follows_code')} AS c FROM seg WHERE kind IN {listed(NEAR_CODE)} AND coalesce(follows_code, '') != '')"
        return [cte], ["SELECT seg_id, 0::BIGINT AS start, length(text) AS length FROM v WHERE len(w) >= 2 AND len(c) > 0 AND len(list_intersect(w, c)) >= 0.8 * len(w)"]
    if rule_id == "V-6":
        styles = [(r"^\s*(:param\s+(\w+)\s*:\s*(.+))$", 2, 0, 3), (r"^\s*(@param\s+(?:\{([^}]*)\}\s+)?([\w.\[\]]+)\s*(?:-\s*)?(.+))$", 3, 2, 4), (r"^\s*((\w+)\s*\(([^)]*)\)\s*:\s*(.+))$", 2, 3, 4)]
        lines = f"""l0 AS (SELECT seg_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS s FROM seg WHERE kind IN {listed(NEAR_CODE)}),
l1 AS (SELECT *, (sum(length(s) + 1) OVER (PARTITION BY seg_id ORDER BY n) - length(s) - 1)::BIGINT AS base FROM l0),
p AS ({' UNION ALL '.join(f"SELECT seg_id, base + length(s) - length(ltrim(s)) AS start, length(ltrim(s)) AS length, regexp_extract(s, {q(r)}, {n}) AS name, {f'regexp_extract(s, {q(r)}, {t})' if t else "''"} AS hint, regexp_extract(s, {q(r)}, {d}) AS said FROM l1 WHERE regexp_matches(s, {q(r)})" for r, n, t, d in styles)}),
k AS (SELECT *, [w for w in string_split_regex(lower(said), '[^a-z]+') if w != '' AND w NOT IN {listed(words('param_filler'))}] AS d,
  [lower(w) for w in string_split_regex(regexp_replace(name || ' ' || hint, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+') if regexp_full_match(w, '[A-Za-z]+')] AS known FROM p)"""
        return [lines], ["SELECT seg_id, start, length FROM k WHERE len([w for w in d if NOT list_contains(known, w)]) = 0"]
    return None


def rule_sql(rule_id: str, base: str = DOCS, told_too: bool = True) -> str:
    """seg_id, start and length of each finding of a rule: in the documents by its patterns, in the
    fixture as written down."""
    special = _special(rule_id)
    if special:
        ctes, picks = special
    else:
        ctes, picks, k = [], [], 0
        for rule in (r for r in rules().values() if r.rule_id == rule_id):
            for p in rule.patterns:
                own = rule_id in ("A-6", "A-10")
                ctes.append(_hits(f"h{k}", _re2(p), p.groups, column="text" if own else "m", fold=p.fold))
                picks.append(f"SELECT seg_id, start, length(hit) AS length FROM h{k} WHERE {_kinds(rule)} AND {_exempt(rule)}")
                k += 1
    if told_too:
        told = ", ".join(f"({q(s)}, {a}::BIGINT, {n}::BIGINT)" for s, a, n in expected(rule_id))
        picks.append(f"SELECT * FROM (VALUES {told}) AS told(seg_id, start, length)")
    return f"WITH {base},\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(picks)


def _pieces(source: str, column: str) -> str:
    stems = either([a[:-1] for a in words("abbreviations")])
    return rf"string_split(regexp_replace(regexp_replace({column}, {q('(?i)' + chr(92) + 'b(' + stems + ')' + chr(92) + '.')}, '\1' || chr(3), 'g'), '([.!?]+[*_`~]*)(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1))"


SPACES = "'^\\s+|\\s+$'"
SENTENCES = f"""{SEG},
raw AS (SELECT seg_id, kind, generate_subscripts({_pieces('masked', 'm')}, 1) AS k, unnest({_pieces('masked', 'm')}) AS piece FROM masked),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY seg_id ORDER BY k) - length(piece) AS base FROM raw),
sentence AS (SELECT seg_id, kind, (base + length(piece) - length(regexp_replace(piece, '^\\s+', '')))::BIGINT AS start, replace(regexp_replace(piece, {SPACES}, '', 'g'), chr(3), '.') AS s FROM placed WHERE regexp_replace(piece, {SPACES}, '', 'g') != ''),
tokens AS (SELECT *, [t for t in [regexp_replace(x, '^[^\\w(\\[\"''`%]+|[^\\w)\\]\"''`%]+$', '', 'g') for x in string_split_regex(regexp_replace(regexp_replace(s, '\\([^()]*\\)', ' paren ', 'g'), '\"[^\"]*\"|''[^'']{{2,}}''|`[^`]*`', ' quote ', 'g'), '\\s+')] if t != ''] AS t,
  [w for w in string_split_regex(lower(s), '[^\\w''-]+') if w != ''] AS w FROM sentence),
counted AS (SELECT *, len(t) - len([i for i in range(1, len(t)) if regexp_full_match(t[i], '[+-]?\\d[\\d,]*(\\.\\d+)?') AND rtrim(lower(t[i + 1]), '.,') IN {listed(words('units'))}]) AS n_words,
  CASE WHEN len(w) = 0 THEN 'descriptive' WHEN w[1] = 'don''t' OR (w[1] = 'do' AND coalesce(w[2] = 'not', false)) THEN 'procedural'
    WHEN w[1] NOT IN {listed(words('imperatives'))} THEN 'descriptive' WHEN coalesce(w[2] IN {listed(words('command_determiners'))}, false) THEN 'procedural'
    WHEN len([x for x in w[2:4] if x IN {listed(words('followers'))}]) > 0 THEN 'descriptive' ELSE 'procedural' END AS register FROM tokens)"""

C1 = f"""WITH {SENTENCES}
SELECT seg_id, start, n_words::INTEGER AS n_words, register FROM counted WHERE n_words > CASE WHEN register = 'procedural' THEN 20 ELSE 25 END"""

SENTENCE_COUNTS = f"""WITH {SENTENCES}
SELECT seg_id, count(*)::BIGINT AS n_sentences, sum(n_words)::BIGINT AS n_words, max(n_words)::INTEGER AS longest, count(*) FILTER (register = 'procedural')::BIGINT AS n_instructions FROM counted GROUP BY seg_id"""

C2 = f"""WITH {SEG},
block AS (SELECT seg_id, generate_subscripts(string_split_regex(m, '\\n\\s*\\n'), 1) AS k, unnest(string_split_regex(m, '\\n\\s*\\n')) AS b FROM masked WHERE kind IN {listed(PROSE)}),
placed_block AS (SELECT *, (sum(length(b) + 2) OVER (PARTITION BY seg_id ORDER BY k) - length(b) - 2)::BIGINT AS start FROM block),
n AS (SELECT *, len([x for x in {_pieces('placed_block', 'b')} if regexp_replace(x, {SPACES}, '', 'g') != '']) AS n FROM placed_block)
SELECT seg_id, start, n::INTEGER AS n_sentences FROM n WHERE n > 6"""


def severity_sql(hard: set[str], rule_ids: list[str]) -> str:
    """Counts by rule under the strict profile, from the SQL of each rule."""
    parts = [f"SELECT '{r}' AS rule_id, kind FROM ({rule_sql(r)}) JOIN ({'WITH ' + SEG} SELECT seg_id, kind FROM seg) USING (seg_id)" for r in rule_ids]
    return f"SELECT rule_id, CASE WHEN kind NOT IN ('identifier', 'commit') AND rule_id IN {listed(sorted(hard))} THEN 'hard' ELSE 'soft' END AS severity, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"


def markdown_sql(source: str) -> str:
    """CTEs up to ``md`` (id, k, line, text): Markdown segments of ``source`` (id, text), as gaps and
    islands of lines."""
    strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    tick = "```"
    return rf"""src AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s){tick}.*?{tick}', chr(10), 'g'), '(?s)~~~.*?~~~', chr(10), 'g'), '(?m)^(?:\t| {{4}})\S.*$', '', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g') AS t FROM {source}),
ln AS (SELECT id, generate_subscripts(string_split(t, chr(10)), 1) AS n, unnest(string_split(t, chr(10))) AS raw FROM src),
kd AS (SELECT *, CASE WHEN regexp_full_match(raw, '\s*') OR regexp_matches(raw, '^\s*\|.*\|\s*$') OR regexp_matches(raw, '^\s*(?:!?\[[^\]]*\]\([^)]*\)\s*)+$') THEN 'cut'
  WHEN regexp_matches(raw, '^\s{{0,3}}#{{1,6}}\s+') THEN 'head' WHEN regexp_matches(raw, '^\s*(?:\d+[.)]|[-+*])\s+') THEN 'item' ELSE 'text' END AS w FROM ln),
nx AS (SELECT *, w = 'text' AND coalesce(lag(w) OVER (PARTITION BY id ORDER BY n) = 'text', false) AS goes_on FROM kd),
gr AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS g FROM nx),
bd AS (SELECT id, min(n) AS line, CASE first(w) WHEN 'head' THEN {strip(f"rtrim({strip(chr(114) + 'egexp_extract(first(raw), ' + q('^' + chr(92) + 's{0,3}#{1,6}' + chr(92) + 's+(.*)$') + ', 1)')}, '#')")}
  WHEN 'item' THEN {strip(f"regexp_extract(first(raw), {q('^' + chr(92) + 's*(?:' + chr(92) + 'd+[.)]|[-+*])' + chr(92) + 's+(.*)$')}, 1)")} ELSE {strip(f"string_agg({strip('raw')}, chr(10) ORDER BY n)")} END AS text FROM gr WHERE w != 'cut' GROUP BY id, g),
md AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY line) - 1 AS k, line, text FROM bd WHERE length(text) >= 12 AND len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]+')) >= 3)"""


MARKDOWN = f"""WITH {markdown_sql("(SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)")}
SELECT 'd' || id || '.md#' || k AS seg_id, line::INTEGER AS line, 'markdown' AS kind, text FROM md"""

_TURNS = rf"""seg AS (WITH {markdown_sql("(SELECT conv_id || '-' || turn || '-' || role AS id, text FROM conversations WHERE text IS NOT NULL AND trim(text) != '')")}
  SELECT id || '#' || k AS seg_id, 'pr_description' AS kind, text, NULL::VARCHAR AS follows_code FROM md),
masked AS (SELECT *, regexp_replace(regexp_replace(text, '[^\x00-\x7F\p{{L}}]', '~', 'g'), '[^\x00-\x7F]', '_', 'g') AS m FROM seg)"""


def conversation_sql(rule_ids: list[str], hard: set[str]) -> str:
    """Findings of change descriptions under a profile: counts by role, rule and severity."""
    parts = [f"SELECT seg_id, '{r}' AS rule_id, {str(r in hard).lower()} AS hard FROM ({rule_sql(r, _TURNS, False)})" for r in rule_ids if r not in ("C-1", "C-2")]
    sentences, paragraphs = SENTENCES.replace(SEG, _TURNS), C2.replace(SEG, _TURNS)
    parts.append(f"SELECT seg_id, 'C-1', n_words > 40 FROM (WITH {sentences} SELECT seg_id, n_words FROM counted WHERE n_words > 30)")
    parts.append(f"SELECT seg_id, 'C-2', {str('C-2' in hard).lower()} FROM ({paragraphs})")
    return f"""SELECT split_part(split_part(seg_id, '#', 1), '-', -1) AS role, rule_id, CASE WHEN hard THEN 'hard' ELSE 'soft' END AS severity, count(*) AS n
FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL"""


_HEDGES = "rather|quite|fairly|relatively|somewhat|perhaps|potentially|possibly|often|usually|generally|typically|should|could|might|may"
_ABSTRACTS = "ism|hood|ship|ness|ity|ence|ance|ment|sion|tion"
_LINKS = "accordingly|nonetheless|nevertheless|hence|thus|consequently|additionally|furthermore|moreover|therefore|however"


def _overlap(column: str) -> str:
    return f"list_distinct([lower(w) for w in string_split_regex(regexp_replace({column}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+') if regexp_full_match(w, '[A-Za-z]{{3,}}')])"


_WHOLE = "[t for t in [regexp_replace(x, '^[^\\w(\\[\"''`%]+|[^\\w)\\]\"''`%]+$', '', 'g') for x in string_split_regex(regexp_replace(regexp_replace(m, '\\([^()]*\\)', ' paren ', 'g'), '\"[^\"]*\"|''[^'']{2,}''|`[^`]*`', ' quote ', 'g'), '\\s+')] if t != '']"
FEATURES = f"""WITH {SENTENCES},
per AS (SELECT seg_id, count(*) AS k, max(n_words) AS longest FROM counted GROUP BY seg_id),
whole AS (SELECT *, {_WHOLE} AS tk FROM masked),
merged AS (SELECT *, len([i for i in range(1, len(tk)) if regexp_full_match(tk[i], '[+-]?\\d[\\d,]*(\\.\\d+)?') AND rtrim(lower(tk[i + 1]), '.,') IN {listed(words('units'))}]) AS pairs FROM whole),
base AS (SELECT *, greatest(len(tk) - pairs, 1)::DOUBLE AS n, coalesce(follows_code, '') != '' AS coded, len([w for w in string_split_regex(coalesce(follows_code, ''), '\\s+') if w != '']) AS code, {_overlap('text')} AS own, {_overlap("coalesce(follows_code, '')")} AS other FROM merged)
SELECT b.seg_id, len(regexp_extract_all(m, '(?i)\\b\\w+(?:{_ABSTRACTS})\\b')) / n AS abstract_noun_rate,
  CASE WHEN coded AND len(own) > 0 THEN len(list_intersect(own, other)) / len(own)::DOUBLE ELSE 0.0 END AS code_overlap,
  (length(m) - length(replace(m, ',', ''))) / n AS comma_rate,
  CASE WHEN coded AND code > 0 THEN n / code ELSE 0.0 END AS comment_to_code_ratio,
  len(regexp_extract_all(m, '(?i)\\b(?:{_LINKS})\\b')) / n AS connective_rate,
  len(regexp_extract_all(m, '(?i)\\b(?:{_HEDGES})\\b')) / n AS hedge_rate,
  coalesce(longest, 0)::DOUBLE AS max_sentence_words, n / greatest(coalesce(k, 0), 1)::DOUBLE AS mean_sentence_words,
  (coalesce(list_sum([length(x) for x in tk]), 0) + pairs) / n AS mean_word_length,
  greatest(coalesce(k, 0), 1)::DOUBLE AS sentence_count, n AS word_count
FROM base b LEFT JOIN per USING (seg_id)"""

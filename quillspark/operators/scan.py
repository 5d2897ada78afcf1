"""One scan of segments by any set of rules: native expressions, one pass, no shuffle, no Python worker.

All rules of a run make one array of findings per segment, which is exploded once; the text itself
stays behind. A pattern is tried only where one of the literals that it cannot do without stands in the
text in lower case (one pass finds those of all patterns), and its hits are marked in a copy of the text only where it matches; positions,
lines and excerpts come from the pieces between marks, in time linear in the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vocabulary import words
from .catalogue import KINDS, NEAR_CODE, PROSE, Rule, filled, needles, rules

FOLD_RULES = ("C-1", "C-2", "V-1", "V-6")
ALL_RULES = tuple(dict.fromkeys([r.rule_id for r in rules().values()] + list(FOLD_RULES)))
SEGMENT = "seg_id string, path string, line int, kind string, text string, line_offsets array<int>, register string, follows_code string"
SHOWN = 400  # longest text that a report shows whole
_CODE_LINE = r"(?U)&\w+;|&#\d+;|[){\]]\s*;|;\s*\z|^\s*;|:\s*\w+\s*;"
_STANDARD = r"(?iU)\b(?:IEEE|ISO|PEP|RFC)[- ]?\d+\b|/licenses?/"
_DATED = r"(?iU)\bv?\d+\.\d+|\bversion \d|\b(?:19|20)\d{2}\b"
_FOLDS = ("\u017f", "\u0130", "\u0131")  # characters that match s or i though their lower case is another
Limits = Callable[[str], str]


def _branches(terms: Iterable[str]) -> str:
    """Regex of the longest of some terms at a place, by common beginnings."""
    by: dict[str, list[str]] = {}
    for t in terms:
        by.setdefault(t[:1], []).append(t[1:])
    ends = by.pop("", None) is not None
    made = "|".join(_plain(c) + (_branches(rest) if any(rest) else "") for c, rest in sorted(by.items()))
    return f"(?:{made}){'?' if ends else ''}"


def _plain(sign: str) -> str:
    return sign if sign.isalnum() else f"\\x{{{ord(sign):x}}}"


def present(terms: list[str]) -> str:
    """SQL array of the terms that stand in ``_low``: the longest one at each place, all found in one pass."""
    first = "".join(sorted({_plain(t[0]) for t in terms}))
    return f"array_distinct(regexp_extract_all(_low, {tx.quoted(f'(?=[{first}])(?=({_branches(terms)}))')}, 1))"


def _needed(wanted: set[str]) -> list[str]:
    """What the wanted rules look for."""
    some = [n for key, r in rules().items() if r.rule_id in wanted for need in needles(key) for n in need or ()]
    return sorted(set(some))


def _marked(rule: Rule) -> list[tuple[str, str]]:
    """Of each pattern, as SQL, whether a text holds it and the text with its hits marked."""
    out = []
    for p in rule.patterns:
        to = {0: f"{tx.OPEN}$0{tx.CLOSE}", 2: f"$1{tx.OPEN}$2{tx.CLOSE}", 3: f"$1{tx.OPEN}$2{tx.CLOSE}$3"}[p.groups]
        regex = tx.quoted(("(?iU)" if p.fold else "(?U)") + p.regex)
        out.append((f"text RLIKE {regex}", f"regexp_replace(text, {regex}, {tx.quoted(to)})"))
    return out


def hits(marked: str) -> str:
    """SQL array of (start, hit) of a text whose hits stand between OPEN and CLOSE."""
    starts = tx.running("transform(parts_, (p_, i_) -> length(p_) - CASE WHEN i_ > 0 THEN 1 ELSE 0 END)")
    made = f"transform(slice(sequence(0, size(parts_) - 1), 2, size(parts_)), i_ -> named_struct('start', starts_[i_], 'hit', substring_index(parts_[i_], {tx.quoted(tx.CLOSE)}, 1)))"
    return tx.let("parts_", f"split({marked}, {tx.quoted(tx.OPEN)})", tx.let("starts_", starts, made))


def _placed(rows: DataFrame) -> DataFrame:
    """``_h`` of rows with ``_m``, a text with marked hits: array of (start, hit, breaks, around): where
    each begins, line breaks before it, and the text about it. A step each, so that nothing is worked
    out twice."""
    rows = rows.withColumn("_parts", F.split("_m", tx.OPEN)).withColumn("_plain", F.expr(f"transform(_parts, p -> replace(p, {tx.quoted(tx.CLOSE)}, ''))"))
    rows = rows.withColumn("_starts", F.expr(tx.running("transform(_plain, p -> length(p))"))).withColumn("_breaks", F.expr(tx.running(f"transform(_plain, p -> {tx.breaks('p')})")))
    rows = rows.withColumn("_tails", F.expr("transform(_plain, p -> right(p, 45))")).withColumn("_heads", F.expr("transform(_plain, p -> left(p, 45))"))
    hit = f"substring_index(_parts[i], {tx.quoted(tx.CLOSE)}, 1)"
    before = "right(array_join(slice(_tails, greatest(i - 45, 0) + 1, least(i, 45)), ''), 45)"
    after = f"left(concat(substr(_plain[i], length({hit}) + 1, 45), array_join(slice(_heads, i + 2, 45), '')), 45)"
    one = f"named_struct('start', _starts[i], 'hit', {hit}, 'breaks', _breaks[i], 'around', concat({before}, {hit}, {after}))"
    rows = rows.withColumn("_h", F.expr(f"transform(slice(sequence(0, size(_parts) - 1), 2, size(_parts)), i -> {one})"))
    return rows.drop("_parts", "_starts", "_breaks", "_tails", "_heads")


def _entry(key: str, start: str, hit: str, excerpt: str, breaks: str = "0", n: str = "0", note: str = "NULL", over: str = "false") -> str:
    return (
        f"named_struct('key', {key}, 'start', cast({start} AS int), 'hit', {hit}, 'n', cast({n} AS int), 'note', cast({note} AS string), "
        f"'over_fail', {over}, 'breaks', cast({breaks} AS int), 'excerpt', {tx.shorten(excerpt)})"
    )


def _semicolons() -> str:
    """8.1, by lines: a line with a sign of code has no finding."""
    entry = _entry("'8.1'", "ls_[k_] + ps_[j_] + j_ - 1", "';'", "x_", "k_")
    of_line = tx.let("ps_", tx.running("transform(split(x_, ';'), y_ -> length(y_))"), f"transform(sequence(1, size(ps_) - 2), j_ -> {entry})")
    made = f"transform(lines_, (x_, k_) -> CASE WHEN contains(x_, ';') AND NOT x_ RLIKE {tx.quoted(_CODE_LINE)} THEN {of_line} END)"
    starts = tx.running("transform(lines_, x_ -> length(x_) + 1)")
    return tx.let("lines_", f"split(_m, {tx.quoted(chr(10))})", tx.let("ls_", starts, f"flatten(filter({made}, a_ -> a_ IS NOT NULL))"))


def _tried(wanted: set[str]) -> Column:
    """Array of structs (key, m) of the wanted rules in a row with text and kind: m is the text with its
    hits marked, or for rules without a pattern the text; rules with nothing to find are left out. One
    SQL text, as building it node by node takes longer than to run it."""
    made = []
    every = _needed(wanted)

    def add(key: str, tests: list[str], m: str) -> None:
        made.append(f"named_struct('key', {tx.quoted(key)}, 'm', CASE WHEN {' AND '.join(tests) or 'true'} THEN {m} END)")

    kinds = lambda names: [f"kind IN ({', '.join(map(tx.quoted, names))})"] if names else []
    for key, rule in rules().items():
        if rule.rule_id not in wanted:
            continue
        if key == "8.1":
            add(key, ["contains(text, ';')"], "text")
            continue
        for (test, m), need in zip(_marked(rule), needles(key), strict=True):
            # where a longer term stands at a place it is listed in place of a shorter one
            listed = [t for t in every if t.startswith(tuple(need or ()))]
            some = [f"(_folds OR arrays_overlap(_found, array({', '.join(map(tx.quoted, listed))})))"] if need else []
            dated = [f"NOT text RLIKE {tx.quoted(_DATED)}"] if key == "S-4#1" else []
            add(key, [*kinds(rule.kinds), *some, test, *dated], m)
    near = kinds(NEAR_CODE)
    own = {"C-1": [], "C-2": kinds(PROSE), "V-1": [*near, "coalesce(follows_code, '') != ''"]}
    for key, tests in own.items():
        if key in wanted:
            add(key, tests, "text")
    if "V-6" in wanted:
        for k, (p, *_) in enumerate(_PARAMS):
            add(f"V-6#{k}", [*near, f"text RLIKE {tx.quoted(p)}"], f"regexp_replace(text, {tx.quoted(p)}, {tx.quoted(f'{tx.OPEN}$1$2{tx.CLOSE}')})")
    return F.expr(f"filter(array({', '.join(made)}), e -> e.m IS NOT NULL)")


def _pattern_entries() -> str:
    """Findings of a pattern rule from its hits ``_h``; of 1.1 the first of each word, of A-8 the first of
    three or more."""
    first = tx.let("ns_", "transform(_h, h_ -> lower(h_.hit))", "transform(array_distinct(ns_), x_ -> element_at(_h, cast(array_position(ns_, x_) AS int)))")
    kept = f"CASE _key WHEN '1.1' THEN {first} WHEN 'A-8' THEN slice(_h, 1, CASE WHEN size(_h) >= 3 THEN 1 ELSE 0 END) ELSE _h END"
    excerpt = "CASE WHEN _key IN ('A-8', 'S-3') THEN array_join(_plain, '') WHEN _key = 'C-4' THEN h_.hit ELSE h_.around END"
    return f"transform({kept}, h_ -> {_entry('_key', 'h_.start', 'h_.hit', excerpt, 'h_.breaks', 'size(_h)')})"


def _simple_present(word: Column) -> Column:
    stem = F.substr(word, F.lit(1), F.length(word) - 3)
    double = stem.rlike(r"([^aeiou])\1\z") & (F.length(stem) > 2)
    return F.when(double, F.substr(stem, F.lit(1), F.length(stem) - 1)).when(stem.rlike("(?:ag|id|ol|ur|iv|us|iz|ut|at)$"), F.concat(stem, F.lit("e"))).otherwise(stem)


def sentence_rows(segments: DataFrame) -> DataFrame:
    return segments.select("*", F.explode(F.expr(tx.sentences("text", "register"))).alias("s"))


def single_limits(register: str) -> str:
    """The specification's limits: SQL struct (warn, fail) of a register."""
    one = f"CASE WHEN {register} = 'procedural' THEN 20 ELSE 25 END"
    return f"named_struct('warn', {one}, 'fail', {one})"


def long_sentences(limits: Limits = single_limits) -> str:
    """C-1. ``limits``: SQL struct (warn, fail) of a register, and of the row's other columns. The note
    is what the sentence is, with the limit that it breaks; ``n`` its words."""
    least = f"least(({limits(tx.quoted('procedural'))}).warn, ({limits(tx.quoted('descriptive'))}).warn)"
    what = "CASE WHEN z_.register = 'procedural' THEN 'instruction ' ELSE 'sentence ' END"
    note = f"concat({what}, cast(CASE WHEN z_.n_words > y_.fail THEN y_.fail ELSE y_.warn END AS string))"
    entry = _entry("'C-1'", "z_.start", "z_.text", "z_.text", "z_.breaks", "z_.n_words", note, "z_.n_words > y_.fail")
    told = tx.let("y_", limits("z_.register"), entry)
    return f"transform(filter({tx.sentences('_m', 'register', least)}, z_ -> z_.n_words > ({limits('z_.register')}).warn), z_ -> {told})"


def long_paragraphs() -> str:
    """C-2: more than six sentences in a paragraph; ``n`` tells how many."""
    counted = f"transform({tx.paragraphs('_m')}, y_ -> named_struct('text', y_.text, 'start', y_.start, 'n', {tx.n_sentences('y_.text')}))"
    entry = _entry("'C-2'", "z_.start", "z_.text", "z_.text", tx.breaks("substr(_m, 1, z_.start)"), "z_.n")
    return f"transform(filter({counted}, z_ -> z_.n > 6), z_ -> {entry})"


def restating() -> str:
    """V-1: at least 0.8 of two or more content words stand in the code below."""
    told = f"CASE WHEN size(x_) >= 2 AND size(y_) > 0 AND size(array_intersect(x_, y_)) / size(x_) >= 0.8 THEN array({_entry(tx.quoted('V-1'), '0', '_m', '_m')}) END"
    return tx.let("x_", tx.content_words("_m"), tx.let("y_", tx.content_words("follows_code"), told))


_PARAMS = [  # whole line, name, type, description
    (r"(?mU)^(\s*)(:param\s+(\w+)\s*:\s*(\S[^\n]*?|[^\n]))$", 3, None, 4),
    (r"(?mU)^(\s*)(@param\s+(?:\{([^}]*)\}\s+)?([\w.\[\]]+)\s*(?:-\s*)?([^\n]+?))$", 4, 3, 5),
    (r"(?mU)^(\s*)((\w+)\s*\(([^)]*)\)\s*:\s*([^\n]+?))$", 3, 4, 5),
]


def empty_params(style: tuple) -> str:
    """V-6, of the hits ``_h`` of a style: a parameter's description says no more than its name and
    type; the note is the name."""
    part = lambda k: f"regexp_extract(h_.hit, {tx.quoted(style[0])}, {style[k]})" if style[k] else "''"
    cut = r"(?U)[_\-\W]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    said = f"filter(array_distinct({tx.parted(f'lower({part(3)})', '[^a-z]+')}), w_ -> w_ != '' AND w_ NOT IN {tx.among(words('param_filler'))})"
    letters = tx.quoted(r"^\p{L}+$")
    known = f"transform(filter(concat({tx.parted(part(1), cut)}, {tx.parted(part(2), cut)}), w_ -> w_ RLIKE {letters}), w_ -> lower(w_))"
    empty = f"{part(1)} != '' AND {part(3)} != '' AND size(array_except({said}, {known})) = 0"
    return f"filter(transform(_h, h_ -> CASE WHEN {empty} THEN {_entry(tx.quoted('V-6'), 'h_.start', 'h_.hit', 'h_.hit', 'h_.breaks', note=part(1))} END), e_ -> e_ IS NOT NULL)"


def _told(rows: DataFrame) -> DataFrame:
    """Rule, message and suggestion of exploded entries ``_f``, from one small table of the keys."""
    spark = rows.sparkSession
    table = []
    for key, r in rules().items():
        left, mark, right = r.message.partition("{}")
        a, fill, b = (r.suggestion or "").partition("{}")
        own = key in ("3.2", "GR-8", "1.14#1", "V-5", "1.14")
        table.append((key, r.rule_id, left, right, bool(mark), r.lower, None if r.suggestion is None and not own else a, b, bool(fill) or own))
    for key in FOLD_RULES:
        table.append((key, key, "", "", False, False, "", "", False))
    known = spark.createDataFrame(table, "key string, rule_id string, _left string, _right string, _hit boolean, _lower boolean, _a string, _b string, _fill boolean")
    fills = spark.createDataFrame([(k, t, v) for k, r in rules().items() for t, v in filled(r).items()], "key string, _term string, fill string")
    # a row per key and a few hundred words, fixed with the package
    rows = rows.select("*", "_f.*").drop("_f").withColumn("_term", F.lower("hit")).join(F.broadcast(known), "key").join(F.broadcast(fills), ["key", "_term"], "left")
    quoted, squeeze = "trim(regexp_replace(hit, r'(?U)\\s+', ' '))", "r'[ \\t]+-?[ \\t]*'"
    write = lambda c: f"concat('Write \"', {c}, '\".')"
    cased = "CASE WHEN hit = upper(hit) THEN upper(fill) WHEN hit RLIKE '^[A-Z]' THEN concat(upper(substr(fill, 1, 1)), substr(fill, 2)) ELSE fill END"
    american = "regexp_replace(regexp_replace(hit, r'(?i)is(ations?|e|ed|es|ing)$', 'iz$1'), r'(?i)ys(e|ed|ing)$', 'yz$1')"
    message = f"""CASE key
        WHEN 'C-1' THEN format_string('This %s has %d words. The limit is %s.', split(note, ' ')[0], n, split(note, ' ')[1])
        WHEN 'C-2' THEN format_string('This paragraph has %d sentences. The limit is 6.', n)
        WHEN 'V-1' THEN 'This comment repeats the code below it.'
        WHEN 'V-6' THEN format_string('The description of "%s" repeats its name.', note)
        WHEN 'C-4' THEN concat('"', regexp_replace(hit, {squeeze}, ' '), '" is a multi-word noun of ', size(split(hit, {squeeze})), ' words. The limit is 3.')
        WHEN 'A-8' THEN format_string('This comment narrates %d numbered steps.', n)
        ELSE concat(_left, CASE WHEN NOT _hit THEN '' WHEN _lower THEN lower({quoted}) ELSE {quoted} END, _right) END"""
    suggestion = f"""CASE key
        WHEN 'C-1' THEN format_string('Split it into %d shorter sentences.', 1 + n div try_cast(split(note, ' ')[1] AS int))
        WHEN 'C-2' THEN 'Give each topic a paragraph of its own.'
        WHEN 'V-1' THEN 'Delete it, or say why the code is as it is.'
        WHEN 'V-6' THEN 'Give unit, range or default, or drop the line.'
        WHEN '3.2' THEN concat('Use the simple present: "', _present, '".')
        WHEN 'GR-8' THEN concat('Write "of the ', lower(regexp_extract(hit, '^([A-Za-z]+)', 1)), '".')
        WHEN 'V-5' THEN CASE WHEN fill = '' THEN 'Delete it.' ELSE {write("fill")} END
        WHEN '1.14' THEN {write(cased)}
        WHEN '1.14#1' THEN {write(american)}
        ELSE CASE WHEN _fill THEN concat(_a, fill, _b) ELSE _a END END"""
    rows = rows.withColumn("_present", _simple_present(F.lower(F.regexp_extract("hit", r"(?U)(\w+)$", 1))))
    return rows.withColumn("message", F.expr(message)).withColumn("suggestion", F.expr(suggestion))


def findings(segments: DataFrame, wanted: Iterable[str] | None = None, limits: Limits = single_limits) -> DataFrame:
    """Findings of the wanted rules (all by default): the segment's columns but for its text, line
    numbers and code, then rule_id, start, stop, hit, message, suggestion, excerpt, over_fail, n, note,
    line and ``shown`` (the whole text where it is short, else null)."""
    wanted = set(ALL_RULES if wanted is None else wanted)
    segments = segments.where(F.col("text").isNotNull() & F.col("kind").isin(*KINDS)).withColumn("text", tx.clean(F.col("text")))
    text = F.col("text")
    kept = [c for c in segments.columns if c not in ("text", "line_offsets", "follows_code")]
    folds = reduce(lambda a, c: a | text.contains(c), _FOLDS, F.lit(False))
    terms = _needed(wanted)
    rows = segments.withColumn("_low", F.lower(text)).withColumn("_folds", folds).withColumn("_found", F.expr(present(terms) if terms else "array('')"))
    tried = F.explode(_tried(wanted))
    # from here on the marked copy stands for the text
    rows = rows.select(*kept, "line_offsets", "follows_code", F.when(F.length(text) <= SHOWN, text).alias("shown"), tried.alias("_e"))
    rows = _placed(rows.select(*kept, "line_offsets", "follows_code", "shown", F.col("_e.key").alias("_key"), F.col("_e.m").alias("_m")))
    special = {"8.1": _semicolons, "C-1": lambda: long_sentences(limits), "C-2": long_paragraphs, "V-1": restating, **{f"V-6#{k}": partial(empty_params, s) for k, s in enumerate(_PARAMS)}}
    cases = [f"WHEN {tx.quoted(name)} THEN {make()}" for name, make in special.items() if name.partition("#")[0] in wanted]
    entries = F.expr(f"CASE _key {' '.join(cases)} ELSE {_pattern_entries()} END" if cases else _pattern_entries())
    rows = rows.select(*kept, "line_offsets", "shown", F.explode(entries).alias("_f"))
    kept_out = [f"(_f.key = {tx.quoted(k)} AND lower(regexp_extract(_f.hit, {tx.quoted(f'(?U){r.word}')}, 1)) IN {tx.among(r.exempt)})" for k, r in rules().items() if r.exempt and r.rule_id in wanted]
    if "S-3" in wanted:
        kept_out.append(f"(_f.key = 'S-3' AND _f.hit RLIKE {tx.quoted(_STANDARD)})")
    rows = _told(rows.where(f"NOT ({' OR '.join(kept_out)})") if kept_out else rows)
    listed = F.element_at("line_offsets", F.least(F.col("breaks"), F.size("line_offsets") - 1) + 1)
    line = F.when(F.coalesce(F.size("line_offsets"), F.lit(0)) > 0, listed).otherwise(F.col("line") + F.col("breaks"))
    rows = rows.withColumn("line", line).withColumn("stop", F.col("start") + F.length("hit"))
    return rows.select(*kept, "rule_id", "start", "stop", "hit", "message", "suggestion", "excerpt", "over_fail", "n", "note", "shown")

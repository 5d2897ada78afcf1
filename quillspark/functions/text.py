r"""Text functions as Spark SQL expressions: sentences, counted words, register, paragraphs, markup.

All of them run inside the JVM. They take and give SQL text, as one text is parsed at once while each
call of the column API is a message to the JVM: the scan has thousands of nodes. Positions count code
points from 0, as Spark's ``length`` does. Texts may not hold the control characters U+0001 to U+0003,
which mark positions; ``clean`` turns them to spaces of the same length first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import either, words

OPEN, CLOSE, DOT = "\u0001", "\u0002", "\u0003"
_SPACE, _LEAD = r"(?U)\s+", r"(?U)^\s+"
_EDGES = r"(?U)^\s+|\s+\z"
_BRACKETS, _QUOTES = r"\([^()]*\)", "\"[^\"]*\"|'[^']{2,}'|`[^`]*`"
# of all words of a text at once; possessive, as a word may be long
_RIMS = r"(?U)(?<!\S)[^\s\w(\[\"'`%]++|[^\s\w)\]\"'`%]++(?!\S)"
_NUMBER, _STOPS = r"^[+-]?\d[\d,]*(\.\d+)?$", r"[.,]+\z"
_NUMBERS = r"(?U)(?<!\S)[+-]?[0-9][0-9,]*(\.[0-9]+)?(?!\S)"
_APART = r"(?U)[^\w'-]+"
_ENDS = r"(?U)([.!?]+[*_`~]*)(?=\s|\z)"
_BLANK = r"(?U)\n\s*\n"
_HUMPS = r"(?U)[_\-\W]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def among(terms: list[str] | tuple[str, ...]) -> str:
    """A list of literals, for IN."""
    return f"({', '.join(map(quoted, terms))})"


def let(name: str, value: str, use: str) -> str:
    """``use`` with ``name`` standing for ``value``, worked out once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def sub(text: str, regex: str, to: str = "") -> str:
    return f"regexp_replace({text}, {quoted(regex)}, {quoted(to)})"


def parted(text: str, regex: str) -> str:
    return f"split({text}, {quoted(regex)})"


def clean(text: Column) -> Column:
    some = text.contains(OPEN) | text.contains(CLOSE) | text.contains(DOT)
    return F.when(some, F.translate(text, OPEN + CLOSE + DOT, "   ")).otherwise(text)  # translating takes longer than looking


def trim(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def trimmed(text: str) -> str:
    return sub(text, _EDGES)


def breaks(text: str) -> str:
    """Line breaks in a text."""
    return f"(length({text}) - length(replace({text}, {quoted(chr(10))}, '')))"


def shorten(text: str, limit: int = 140) -> str:
    """White space runs as one space, none at the ends, and no more than ``limit`` characters."""
    return let("q_", f"trim({sub(text, _SPACE, ' ')})", f"CASE WHEN length(q_) <= {limit} THEN q_ ELSE concat(substr(q_, 1, {limit - 1}), '…') END")


def _sums(values: str) -> str:
    return f"aggregate({values}, array(0), (s_, n_) -> concat(s_, array(element_at(s_, -1) + n_)))"


def running(lengths: str) -> str:
    """Sums of the elements before each, and of all, of an array of ints. Long arrays are cut into
    pieces of the square root of their length, so that no array copied is long."""
    width = "cast(ceil(sqrt(size(v_))) AS int)"
    cut = f"transform(sequence(0, (size(v_) - 1) div {width}), c_ -> slice(v_, cast(c_ AS int) * {width} + 1, {width}))"
    totals = _sums("transform(p_, x_ -> aggregate(x_, 0, (a_, b_) -> a_ + b_))")
    joined = f"concat(flatten(transform(p_, (x_, i_) -> transform(slice({_sums('x_')}, 1, size(x_)), y_ -> y_ + t_[i_]))), slice(t_, -1, 1))"
    return let("v_", lengths, f"CASE WHEN size(v_) <= 64 THEN {_sums('v_')} ELSE {let('p_', cut, let('t_', totals, joined))} END")


def rimmed(sentence: str) -> str:
    """A text whose words are those counted before a number is merged with its unit: brackets and quotes count
    as one, and a word is without the signs around it. In three passes over the text, not over each word."""
    masked = sub(sub(sentence, _BRACKETS, " paren "), _QUOTES, " quote ")
    return sub(masked, _RIMS)


def ste_words(text: str) -> str:
    """Words of a rimmed text."""
    return f"filter({parted(text, _SPACE)}, w_ -> w_ != '')"


def n_words(text: str) -> str:
    """How many words a rimmed text has, a number and its unit as one."""
    words_ = let("j_", ste_words(text), f"size(j_) - ({unit_pairs('j_')})")
    return f"cast(CASE WHEN {text} RLIKE {quoted(_NUMBERS)} THEN {words_} ELSE size({ste_words(text)}) END AS int)"


def unit_pairs(tokens: str) -> str:
    """How many tokens are a number whose next token is a unit (the two count as one word)."""
    pair = f"a_ RLIKE {quoted(_NUMBER)} AND {sub('lower(b_)', _STOPS)} IN {among(words('units'))}"
    return f"CASE WHEN size({tokens}) < 2 THEN 0 ELSE size(filter(zip_with(slice({tokens}, 1, size({tokens}) - 1), slice({tokens}, 2, size({tokens}) - 1), (a_, b_) -> {pair}), x_ -> x_)) END"


def count_words(sentence: str) -> str:
    """Words of a text as the controlled-language standard counts them."""
    return let("k_", rimmed(sentence), n_words("k_"))


def register(sentence: str, default: str = "'descriptive'") -> str:
    """``procedural`` for an instruction, else the default."""
    first, second = "get(r_, 0)", "get(r_, 1)"
    decided = f"""CASE WHEN size(r_) = 0 THEN {default}
        WHEN {first} = {quoted("don't")} OR ({first} = 'do' AND coalesce({second} = 'not', false)) THEN 'procedural'
        WHEN {first} NOT IN {among(words('imperatives'))} THEN {default}
        WHEN coalesce({second} IN {among(words('command_determiners'))}, false) THEN 'procedural'
        WHEN exists(slice(r_, 2, 3), x_ -> x_ IN {among(words('followers'))}) THEN {default} ELSE 'procedural' END"""
    # no more than four words count: with an empty part before them and one for the rest, seven parts are enough
    return let("r_", f"filter(split(lower({sentence}), {quoted(_APART)}, 7), x_ -> x_ != '')", decided)


def pieces(text: str) -> str:
    """Raw sentence pieces (with their white space), in order; their lengths add up to the text's."""
    stems = either([a[:-1] for a in words("abbreviations")])
    return parted(sub(sub(text, rf"(?iU)\b({stems})\.", "$1" + DOT), _ENDS, "$1" + OPEN), OPEN)


def sentences(text: str, default: str | None = None, over: str | None = None) -> str:
    """Sentences with their start, the line breaks before them, register and counted words. With
    ``over``, those alone that can have more counted words: a gap between words makes one more, a
    bracket or quote up to two."""
    fallback = "'descriptive'" if default is None else f"coalesce({default}, 'descriptive')"
    lead = f"(length(p_) - length({sub('p_', _LEAD)}))"
    one = f"named_struct('text', replace({trimmed('p_')}, {quoted(DOT)}, '.'), 'start', h_[i_] + {lead}, 'breaks', l_[i_] + {breaks(f'substr(p_, 1, {lead})')})"
    most = "" if over is None else f" AND regexp_count(s_.text, {quoted(_SPACE)}) + 2 * regexp_count(s_.text, {quoted(chr(91) + '(' + chr(34) + chr(39) + '`]')}) + 1 > {over}"
    placed = f"filter(transform(g_, (p_, i_) -> {one}), s_ -> s_.text != ''{most})"
    found = let("g_", pieces(text), let("h_", running("transform(g_, p_ -> length(p_))"), let("l_", running(f"transform(g_, p_ -> {breaks('p_')})"), placed)))
    return f"transform({found}, s_ -> named_struct('text', s_.text, 'start', s_.start, 'breaks', s_.breaks, 'register', {register('s_.text', fallback)}, 'n_words', {count_words('s_.text')}))"


def n_sentences(text: str) -> str:
    return f"size(filter({pieces(text)}, p_ -> {trimmed('p_')} != ''))"


def paragraphs(text: str) -> str:
    """Blocks between blank lines, with their start; each separator counts as two characters."""
    placed = f"filter(transform(g_, (p_, i_) -> named_struct('text', p_, 'start', h_[i_])), s_ -> {trimmed('s_.text')} != '')"
    return let("g_", parted(text, _BLANK), let("h_", running("transform(g_, p_ -> length(p_) + 2)"), placed))


def content_words(text: str) -> str:
    """Distinct words of prose or code that carry meaning."""
    lower = f"transform(filter({parted(text, _HUMPS)}, p_ -> p_ RLIKE {quoted('^' + chr(92) + 'p{L}+$')}), p_ -> lower(p_))"
    return f"array_distinct(filter({lower}, p_ -> length(p_) > 2 AND p_ NOT IN {among(words('weak'))}))"


def strip_code(text: Column | str) -> Column:
    """Without fenced and indented code; links as their visible text."""
    out = F.regexp_replace(text, r"(?s)```.*?```", "\n")
    out = F.regexp_replace(out, r"(?s)~~~.*?~~~", "\n")
    out = F.regexp_replace(out, r"(?mU)^(?: {4}|\t)\S[^\n]*$", "")
    return F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")


def identifier_words(name: Column | str) -> Column:
    """Parts of a snake, kebab or camel case name that are letters, in lower case."""
    parts = F.split(name, r"[_\-]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.transform(F.filter(parts, lambda p: p.rlike(r"^\p{L}+$")), F.lower)

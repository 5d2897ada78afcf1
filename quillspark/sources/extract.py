"""Segments from files: comments, docstrings, Markdown, strings, identifiers, commits, notebooks.

Scanners that carry state over characters or lines are small Python functions run by ``mapInArrow``
over (path, source) rows; whatever a pattern can say stays a Column expression (``commits``,
``documents``, ``pages``). Files over 2,000,000 bytes and files that aren't UTF-8 are left out.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.batches import slices
from ..operators.scan import SEGMENT
from ..plans.profiles import Config, included

MAX_BYTES = 2_000_000
_C = (("//",), (("/*", "*/"),), "\"'`", False)
_HASH = (("#",), (), "\"'", False)
_PY = (("#",), (), "\"'", True)
_SQL = (("--",), (("/*", "*/"),), "\"'", False)
_MARKUP = ((), (("<!--", "-->"),), "\"'", False)
_LUA = (("--",), (("--[[", "]]"),), "\"'", False)
_CSS = ((), (("/*", "*/"),), "\"'", False)
#: Comment syntax (line tokens, block tokens, quotes, triple quotes) by suffix.
LANGUAGES = {s: spec for spec, suffixes in (
    (_C, "scss less groovy gradle proto php dart swift rs go cts mts tsx ts cjs mjs jsx js scala kts kt java cs hpp cc cpp h c"),
    (_HASH, "jl exs ex r pl tfvars tf toml yml yaml fish zsh bash sh rb"),
    (_PY, "pyi py"), (_SQL, "sql"), (_MARKUP, "svelte vue svg xml htm html"), (_LUA, "lua"), (_CSS, "css"),
) for s in ("." + x for x in suffixes.split())}
NAMED = {"Jenkinsfile": _C, ".dockerignore": _HASH, ".gitignore": _HASH, "Makefile": _HASH, "Dockerfile": _HASH}
MARKDOWN = (".mdx", ".markdown", ".md")
_DIRECTIVE = re.compile(r"\s*(?:#!|/\s*<reference|@ts-|tflint-|checkov:|fmt:\s*(?:off|on)|endregion\b|region\b|sourceMappingURL|oxlint|biome-|v8|c8|istanbul|codegen|nolint|pragma|flake8|ruff|mypy|pylint|type:\s*ignore|noqa|prettier|eslint)", re.I)
_TASK = re.compile(r"\s*(?:DEPRECATED|BUG|WARNING|NOTE|HACK|XXX|FIXME|TODO)\b", re.I)
_WORDS = re.compile(r"[A-Za-z][A-Za-z'-]+")
Row = tuple[int, str, str, list[int], str | None, str | None]  # line, kind, text, line_offsets, register, follows_code


def language(path: str):
    p = PurePosixPath(path)
    return NAMED.get(p.name) or LANGUAGES.get(p.suffix.lower())


def supported(path: str) -> bool:
    return PurePosixPath(path).suffix.lower() in MARKDOWN or language(path) is not None


def prose_comment(text: str, keep_tasks: bool) -> bool:
    s = text.strip()
    if len(s) < 12 or _DIRECTIVE.match(s) or (not keep_tasks and _TASK.match(s)) or len(_WORDS.findall(s)) < 3:
        return False
    if sum(c.isalpha() or c.isspace() for c in s) < 0.62 * len(s):
        return False
    return not ("(" in s and re.search(r"[;{}]\s*$", s)) and not re.match(r"[-=*_#~+]{4,}$", s)


def _block_text(raw: str) -> str:
    lines = [x.strip() for x in raw.splitlines()]
    lines = [x[1:].strip() if x.startswith("*") else x for x in lines]
    text = "\n".join(lines).strip("\n")
    return "\n".join(x for x in text.split("\n") if not re.match(r"\s*@\w+", x) or len(x.split()) > 4).strip()


class _Scanner:
    """Walks a source from one token of interest to the next."""

    def __init__(self, source: str, spec, keep_tasks: bool) -> None:
        self.source, self.keep = source, keep_tasks
        self.line_tokens, self.blocks, quotes, triple = spec
        self.ends = dict(self.blocks)
        starts = sorted([b for b, _ in self.blocks], key=len, reverse=True)
        ways = [("block", "|".join(map(re.escape, starts)))] if starts else []
        ways += [("line", "|".join(map(re.escape, sorted(self.line_tokens, key=len, reverse=True))))] if self.line_tokens else []
        ways += [("triple", '"""|' + "'''")] if triple else []
        ways += [("quote", f"[{re.escape(quotes)}]"), ("code", r"\S")]
        self.token = re.compile("|".join(f"(?P<{k}>{v})" for k, v in ways))
        self.lines = source.splitlines()
        self.pending: list[tuple[int, str]] = []
        self.found: list[Row] = []

    def below(self, last: int) -> str:
        """Up to three lines of code right under a comment."""
        out: list[str] = []
        for raw in self.lines[last : last + 12]:
            s = raw.strip()
            if not s or s.startswith(tuple(self.line_tokens)) or s.startswith(tuple(b for b, _ in self.blocks)) or len(out) == 3:
                break
            out.append(s)
        return "\n".join(out)

    def flush(self) -> None:
        if self.pending:
            text = "\n".join(t.strip().lstrip("/!").strip() for _, t in self.pending).strip()
            if prose_comment(text, self.keep):
                numbers = [n for n, _ in self.pending]
                self.found.append((numbers[0], "comment", text, numbers, None, self.below(numbers[-1])))
            self.pending = []

    def past_quote(self, at: int, mark: str) -> int:
        """Where a string that opens before ``at`` ends; one that isn't closed ends at its line."""
        stop = re.compile(r"(?s)\\.|[%s]" % re.escape(mark + ("" if mark == "`" else "\n")))
        while m := stop.search(self.source, at):
            at = m.end()
            if m.group() == "\n":
                return m.start() + 1
            if m.group() == mark:
                return at
        return len(self.source)

    def run(self) -> list[Row]:
        source, at, line, seen = self.source, 0, 1, 0
        while m := self.token.search(source, at):
            line, seen = line + source.count("\n", seen, m.start()), m.start()
            kind, at = m.lastgroup, m.end()
            if kind == "block":
                end = self.ends[m.group()]
                close = source.find(end, at)
                close = len(source) if close < 0 else close
                raw = source[at:close]
                self.flush()
                text = _block_text(raw)
                if prose_comment(text, self.keep):
                    last = line + source.count("\n", m.start(), close)
                    self.found.append((line, "docstring" if raw.startswith("*") else "comment", text, list(range(line, line + text.count("\n") + 1)), None, self.below(last)))
                at = close + len(end)
            elif kind == "line":
                end = source.find("\n", at)
                end = len(source) if end < 0 else end
                self.pending.append((line, source[at:end]))
                at = end
            elif kind == "triple":
                close = source.find(m.group(), at)
                at = len(source) if close < 0 else close + 3
                self.flush()
            elif kind == "quote":
                at = self.past_quote(at, m.group())
            else:
                self.flush()
        self.flush()
        return self.found


def comments(path: str, source: str, keep_tasks: bool = False) -> list[Row]:
    spec = language(path)
    if spec is None:
        return []
    found = _Scanner(source, spec, keep_tasks).run()
    return found + docstrings(source) if spec is _PY else found


def docstrings(source: str) -> list[Row]:
    """Docstrings of data that parses as Python; nothing of it is run."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found: list[Row] = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, ast.AsyncFunctionDef, ast.FunctionDef)):
            doc = ast.get_docstring(node)
            if doc and len(doc.strip()) >= 12:
                line = node.body[0].lineno
                found.append((line, "docstring", doc, list(range(line, line + doc.count("\n") + 1)), None, None))
    return found


def without_code(text: str) -> str:
    for fence in ("```", "~~~"):
        text = re.sub(f"(?s){fence}.*?{fence}", "\n", text)
    text = re.sub(r"(?m)^(?:\t| {4})\S.*$", "", text)
    return re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)


def markdown(source: str, kind: str = "markdown") -> list[Row]:
    front = re.match(r"(?s)---\n.*?\n---\n", source)
    skipped = source.count("\n", 0, front.end()) if front else 0
    found: list[Row] = []
    block: list[tuple[int, str]] = []

    def add(lines: list[tuple[int, str]], register: str | None = None) -> None:
        body = "\n".join(t for _, t in lines).strip()
        if len(body) >= 12 and len(_WORDS.findall(body)) >= 3:
            found.append((lines[0][0], kind, body, [n for n, _ in lines], register, None))

    def flush() -> None:
        if block:
            add(list(block))
            block.clear()

    for number, raw in enumerate(without_code(source[front.end() :] if front else source).splitlines(), skipped + 1):
        if not raw.strip() or re.match(r"\s*\|.*\|\s*$", raw) or re.match(r"\s*(?:!?\[[^\]]*\]\([^)]*\)\s*)+$", raw):
            flush()
        elif m := re.match(r"\s{0,3}#{1,6}\s+(.*)$", raw):
            flush()
            add([(number, m.group(1).strip().rstrip("#").strip())])
        elif m := re.match(r"\s*(?:\d+[.)]|[-+*])\s+(.*)$", raw):
            flush()
            body = m.group(1).strip()
            add([(number, body)], "procedural" if body.endswith(":") else None)
        else:
            block.append((number, raw.strip()))
    flush()
    return found


_BODY = r"""(?P<q>["'])(?P<body>(?:\\.|(?!(?P=q)).){8,400})(?P=q)"""
_CALLS = r"(?:t|notify|alert|toast\.(?:warning|info|error|success)|typer\.echo|click\.echo|warnings\.warn|(?:new\s+)?\w*Error|throw\s+new\s+\w*(?:Exception|Error)|raise\s+\w*(?:Warning|Exception|Error)|print|(?:logging|logger|log)\.(?:fatal|exception|critical|debug|error|warning|warn|info)|console\.(?:debug|error|warn|info|log))\s*\(\s*"
_KEYS = r"(?:helperText|errorMessage|summary|tooltip|hint|placeholder|label|title|message|description|help)\s*[:=]\s*"
_STRINGS = (re.compile(_CALLS + _BODY), re.compile(_KEYS + _BODY))
_MARKUP_TEXT = re.compile(r">(?P<body>[^<>{}\n]{12,300})<")
_NO_PROSE = re.compile(r"(?:\s*[<{%].*|https?://\S*|[\w.\-/]+|[A-Z_][A-Z0-9_]*)$|[^A-Za-z]*$")


def prose_string(body: str) -> bool:
    s = body.strip()
    return len(s) >= 12 and " " in s and not _NO_PROSE.match(s) and len(_WORDS.findall(s)) >= 3


def strings(path: str, source: str) -> list[Row]:
    ways = [*_STRINGS, *([_MARKUP_TEXT] if PurePosixPath(path).suffix.lower() in (".html", ".svelte", ".vue", ".tsx", ".jsx") else [])]
    found: list[Row] = []
    seen: set[tuple[int, str]] = set()
    for way in ways:
        for m in way.finditer(source):
            body, line = m["body"], source.count("\n", 0, m.start("body")) + 1
            if (line, body) not in seen and prose_string(body):
                seen.add((line, body))
                plain = re.sub(r"%[rfids]", "(value)", re.sub(r"\{[^}\s]*\}", "(value)", re.sub(r"\$\{[^}]*\}", "(value)", body)))
                found.append((line, "string", plain.replace("\\n", " ").replace("\\t", " ").strip(), [line], None, None))
    return found


_DECLARED = re.compile(r"\b(?:(?:let|var|const)\s+([A-Za-z_]\w*)\s*[=:]|(?:fn|func|(?:async\s+)?def|impl|trait|struct|enum|type|interface|class|function)\s+([A-Za-z_]\w*))")
_HUMPS = re.compile(r"[-_]+|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z0-9])(?=[A-Z])")


def identifiers(source: str) -> list[Row]:
    found: list[Row] = []
    seen: set[str] = set()
    for m in _DECLARED.finditer(source):
        name = m.group(1) or m.group(2)
        if name not in seen:
            seen.add(name)
            parts = [p.lower() for p in _HUMPS.split(name) if p.isalpha()]
            if len(parts) > 1:
                line = source.count("\n", 0, m.start()) + 1
                found.append((line, "identifier", " ".join(parts), [line], None, None))
    return found


NOTEBOOK = "# Databricks notebook source"


def notebook_views(source: str) -> tuple[str, str]:
    """Code and Markdown of an exported notebook, each with the lines of the file."""
    code, prose, inside = [], [], False
    for line in source.splitlines():
        c = p = ""
        if m := re.match(r"# MAGIC(?: |$)", line):
            body = line[m.end() :]
            if body.startswith("%"):
                word, _, rest = body.partition(" ")
                inside = word in ("%md-sandbox", "%md")
                p = rest.strip() if inside else ""
            elif inside:
                p = body
        else:
            inside = False
            if line != NOTEBOOK and not re.match(r"# DBTITLE |# COMMAND -{4,}", line):
                c = line
        code.append(c)
        prose.append(p)
    return "\n".join(code), "\n".join(prose)


def extract_file(path: str, source: str, scopes: tuple[str, ...], keep_tasks: bool = False) -> list[Row]:
    if PurePosixPath(path).suffix.lower() in MARKDOWN:
        return markdown(source) if "markdown" in scopes else []
    view, found = None, []
    if path.endswith(".py") and source.startswith(NOTEBOOK):
        source, view = notebook_views(source)
    if {"comment", "docstring"} & set(scopes):
        found += [r for r in comments(path, source, keep_tasks) if r[1] in scopes]
    if "string" in scopes:
        found += strings(path, source)
    if "identifier" in scopes:
        found += identifiers(source)
    if view is not None and "markdown" in scopes:
        found += markdown(view)
    return found


_ARROW = pa.schema([("seg_id", pa.string()), ("path", pa.string()), ("line", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("line_offsets", pa.list_(pa.int32())), ("register", pa.string()), ("follows_code", pa.string())])


def extracted(batches: Iterator[pa.RecordBatch], scopes: tuple[str, ...], keep: bool) -> Iterator[pa.RecordBatch]:
    """Segments of batches of (path, source). Rows in Python take many times what the batch takes, so they are made
    of a piece at a time."""
    for batch in batches:
        for part in slices(batch, 1):
            rows = []
            for path, source in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if path is not None and source is not None:
                    for k, (line, kind, text, numbers, register, code) in enumerate(extract_file(path, source, scopes, keep)):
                        rows.append({"seg_id": f"{path}#{k}", "path": path, "line": line, "kind": kind, "text": text, "line_offsets": numbers, "register": register, "follows_code": code})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def segments(files: DataFrame, config: Config | None = None) -> DataFrame:
    """``files``: path, source. Segments of the configured scopes, ids from path and order."""
    config = config or Config()
    scopes, keep = tuple(config.scopes), config.keep_task_tags

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return extracted(batches, scopes, keep)

    return files.where(included(F.col("path"), config)).select("path", "source").mapInArrow(run, SEGMENT)


def commits(log: DataFrame) -> DataFrame:
    """``log``: sha, message. Subject (line 1) and body (line 2) of each commit as segments."""
    lines = F.split(tx.trim(F.col("message")), r"\r?\n")
    subject = tx.trim(F.regexp_replace(F.get(lines, F.lit(0)), r"(?U)^\w+(\([^)]*\))?!?:\s*", ""))
    trailer = r"(?iU)^\s*(?:\d+\.\s*https?://|https?://|Resolves|Fixes|Closes|Refs?|Reviewed-by|Signed-off-by|Co-Authored-By|[A-Z][\w-]+:\s)"
    body = tx.trim(F.array_join(F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: (tx.trim(x) != "") & ~x.rlike(trailer)), "\n"))
    count = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))
    path = F.concat(F.lit("commit "), F.substring(tx.trim(F.col("sha")), 1, 12))
    rows = F.filter(F.array(F.struct(F.lit(1).alias("line"), subject.alias("text"), (count(subject) >= 3).alias("ok")), F.struct(F.lit(2).alias("line"), body.alias("text"), (count(body) >= 5).alias("ok"))), lambda r: r["ok"])
    return log.select(path.alias("path"), F.explode(rows).alias("r")).select(
        F.concat_ws("#", "path", F.col("r.line").cast("string")).alias("seg_id"), "path", F.col("r.line").alias("line"), F.lit("commit").alias("kind"), F.col("r.text").alias("text"),
        F.array("r.line").alias("line_offsets"), F.lit(None).cast("string").alias("register"), F.lit(None).cast("string").alias("follows_code"),
    )


def descriptions(bodies: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Change descriptions: Markdown segments of kind ``pr_description``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 1)):
            rows = []
            for p, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for k, (line, kind, t, numbers, register, code) in enumerate(markdown(text, "pr_description") if text and text.strip() else []):
                    rows.append({"seg_id": f"{p}#{k}", "path": p, "line": line, "kind": kind, "text": t, "line_offsets": numbers, "register": register, "follows_code": code})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return bodies.select(F.col(path).cast("string"), F.col(body)).mapInArrow(run, SEGMENT)


def whole_texts(rows: DataFrame, seg_id: Column, path: Column, kind: str, text: str = "text") -> DataFrame:
    """Each row's text as one segment, without a scanner."""
    none = F.lit(None).cast("string")
    return rows.select(seg_id.alias("seg_id"), path.alias("path"), F.lit(1).alias("line"), F.lit(kind).alias("kind"), F.col(text).alias("text"), F.lit(None).cast("array<int>").alias("line_offsets"), none.alias("register"), none.alias("follows_code"))


UNITS = "path string, line int, name string, kind string, source string, signature string, added_lines array<int>"


def code_units(files: DataFrame, added: dict[str, list[int]] | None = None) -> DataFrame:
    """Top-level functions and classes of Python files, with those of the ``added`` lines of their file
    (by path, as a diff tells them) that lie in them; null without ``added``."""

    def units(path: str, source: str) -> list[dict]:
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return []
        out = []
        for node in tree.body:
            if isinstance(node, (ast.ClassDef, ast.AsyncFunctionDef, ast.FunctionDef)):
                body = ast.get_source_segment(source, node)
                if body:
                    out.append({"path": path, "line": node.lineno, "name": node.name, "kind": "class" if isinstance(node, ast.ClassDef) else "function", "source": body, "signature": body.splitlines()[0].strip(), "added_lines": None if added is None else [n for n in sorted(added.get(path, ())) if node.lineno <= n <= node.end_lineno]})
        return out

    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("source", pa.string()), ("signature", pa.string()), ("added_lines", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_pylist([u for p, s in pairs if p and p.endswith((".pyi", ".py")) and s is not None for u in units(p, s)], schema=schema)

    return files.select("path", "source").mapInArrow(run, UNITS)

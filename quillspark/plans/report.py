"""Sinks: JSON, SARIF, annotations, text and HTML.

Rows are formatted by Spark and sorted there; a whole document is written by passing them on one
partition at a time, so the driver holds no more than that. Rule counts (41 rows at most) and a page's
examples are collected.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.catalogue import rule_rows
from . import lint

SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def rule_names() -> dict[str, tuple[str, str, str]]:
    """Of each rule its slug, section and summary (the slug in words)."""
    return {i: (slug, section, slug.replace("-", " ").capitalize()) for i, slug, section, *_ in rule_rows()}


def _named(findings: DataFrame) -> DataFrame:
    rows = [(i, *v) for i, v in rule_names().items()]
    return findings.join(F.broadcast(findings.sparkSession.createDataFrame(rows, "rule_id string, slug string, section string, rule_summary string")), "rule_id", "left")  # 104 rows


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, in report order, in column ``value``."""
    return lint.ordered(_named(findings)).select(F.to_json(F.struct(F.col("rule_id").alias("rule"), "section", "rule_summary", "severity", "path", "line", "kind", "message", "excerpt", "suggestion"), {"ignoreNullFields": "false"}).alias("value"))


def _lines(rows: DataFrame) -> Iterator[str]:
    for r in rows.toLocalIterator():
        yield r.value


def _write_list(out: TextIO, rows: DataFrame) -> None:
    mark = ""
    for value in _lines(rows):
        out.write(f"{mark}\n{value}")
        mark = ","


def summary(report: lint.Report) -> dict:
    """Counts of a report, with its counts by rule, most first."""
    m = report.metrics().first()
    return {"files_scanned": m.files_scanned, "segments_scanned": m.segments_scanned, "suppressed": m.suppressed, "summary": {"hard": m.hard, "soft": m.soft, "by_rule": {r.rule_id: r.n for r in lint.by_rule(report.findings).collect()}}}


def json_document(report: lint.Report, out: TextIO) -> None:
    """One JSON document: counts, then all findings."""
    out.write(json.dumps(summary(report), ensure_ascii=False)[:-1] + ', "findings": [')
    _write_list(out, json_rows(report.findings))
    out.write("]}\n")


def sarif_results(findings: DataFrame) -> DataFrame:
    """SARIF 2.1.0 result objects in column ``value``; commits have no file and are left out."""
    text = F.concat_ws(" ", "message", "suggestion")
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.when(F.col("severity") == "hard", "error").otherwise("warning").alias("level"), F.struct(text.alias("text")).alias("message"), F.array(place).alias("locations"))
    return lint.ordered(findings.where("kind != 'commit'")).select(F.to_json(result).alias("value"))


def sarif_document(findings: DataFrame, out: TextIO) -> None:
    """One SARIF 2.1.0 file with the rules that were found and all results."""
    names = rule_names()
    used = sorted(r.rule_id for r in findings.select("rule_id").distinct().collect())  # 104 at most
    rules = [{"id": i, "name": names[i][0], "shortDescription": {"text": names[i][2]}, "properties": {"section": names[i][1]}} for i in used if i in names]
    head = {"$schema": SCHEMA, "version": "2.1.0"}
    driver = json.dumps({"driver": {"name": "quillspark", "rules": rules}})
    out.write(json.dumps(head)[:-1] + f', "runs": [{{"tool": {driver}, "results": [')
    _write_list(out, sarif_results(findings))
    out.write("]}]}\n")


def _escaped(text: Column) -> Column:
    for a, b in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow commands, one per finding, in column ``value``."""
    level = F.when(F.col("severity") == "hard", "error").otherwise("warning")
    text = _escaped(F.concat_ws(" ", "message", "suggestion"))
    return lint.ordered(findings.where("kind != 'commit'")).select(F.format_string("::%s file=%s,line=%d,title=%s::%s", level, "path", F.greatest("line", F.lit(1)), "rule_id", text).alias("value"))


def text_rows(findings: DataFrame) -> DataFrame:
    """A block of lines per finding, in report order: ``path`` and ``value``."""
    level = F.when(F.col("severity") == "hard", "error").otherwise("warn")
    line = F.format_string("  %-5s %s [%s %s] %s", F.concat(F.col("line").cast("string"), F.lit(":")), level, "rule_id", "slug", "message")
    more = F.concat(F.lit("\n        "), F.col("excerpt"), F.when(F.col("suggestion").isNotNull(), F.concat(F.lit("\n        -> "), F.col("suggestion"))).otherwise(""))
    return lint.ordered(_named(findings)).select("path", F.concat(line, more).alias("value"))


def text_detail(findings: DataFrame, out: TextIO) -> None:
    """The findings under a heading per file."""
    path = None
    for r in text_rows(findings).toLocalIterator():
        if r.path != path:
            path = r.path
            out.write(f"\n{path}\n")
        out.write(r.value + "\n")


def text_summary(report: lint.Report, out: TextIO, soft: bool = True) -> None:
    """Counts and the eight most frequent rules."""
    m, names = report.metrics().first(), rule_names()
    out.write(f"\n{m.files_scanned} files, {m.segments_scanned} pieces of text checked.\n")
    if not m.hard + m.soft:
        out.write("No findings.\n")
        return
    parts = [f"{m.hard} failing", *([f"{m.soft} warnings"] if soft else []), *([f"{m.suppressed} suppressed"] if m.suppressed else [])]
    out.write(", ".join(parts) + ".\n\nMost frequent rules:\n")
    shown = report.findings if soft else report.findings.where("severity = 'hard'")
    for r in lint.top_rules(shown).collect():
        out.write(f"  {r.n:>4}  {r.rule_id:<5} {names[r.rule_id][0]}\n")


def html_page(report: lint.Report, name: str = "Prose report") -> str:
    """A self-contained page with counts, the rules by frequency with what they ask, and the clearest
    examples with their suggestion."""
    m, names = report.metrics().first(), rule_names()
    counts = lint.by_rule(report.findings).collect()  # 41 rows at most
    top = counts[0].n if counts else 1
    cell = html.escape
    bars = "".join(f'<tr><td>{cell(r.rule_id)}</td><td>{cell(names[r.rule_id][2])}</td><td>{cell(names[r.rule_id][1])}</td><td>{r.n}</td><td><div style="width:{max(2, round(r.n / top * 100))}%">&nbsp;</div></td></tr>' for r in counts)
    shown = "".join(
        f'<li class="{cell(r.severity)}"><b>{cell(r.rule_id)} {cell(names[r.rule_id][0])}</b> {cell(r.path)}:{r.line}<br>{cell(r.message)}<pre>{cell(r.shown)}</pre>{cell(r.suggestion or "")}</li>'
        for r in lint.examples(report.findings)
    )
    body = f"<table>{bars}</table><h2>Clearest examples</h2><ol>{shown}</ol>" if counts else "<p>No findings.</p>"
    return (
        f"<!doctype html><html lang=en><meta charset=utf-8><title>{cell(name)}</title><style>body{{font:15px sans-serif;max-width:60em;margin:2em auto}}td div{{background:#46c;min-width:2px}}table{{width:100%}}td:last-child{{width:40%}}pre{{white-space:pre-wrap}}.hard b{{color:#a22}}</style>"
        f"<h1>{cell(name)}</h1><p>{m.hard} hard, {m.soft} soft; {len(counts)} rules. {m.segments_scanned} segments in {m.files_scanned} files; {m.suppressed} suppressed.</p>{body}</html>"
    )


def exit_code(report: lint.Report, strict: bool = False, no_fail: bool = False) -> int:
    if no_fail:
        return 0
    kinds = ("hard", "soft") if strict else ("hard",)
    return int(report.findings.where(F.col("severity").isin(*kinds)).limit(1).count() > 0)

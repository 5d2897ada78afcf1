"""Command line: ``python -m quillspark [paths]``. Exit code 0: nothing fails; 1: findings; 2: usage."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace
from pathlib import Path

from .operators.catalogue import rule_rows
from .plans import lint, profiles, report
from .sources import discover, extract

OK, FINDINGS, USAGE = 0, 1, 2
MANY = 100  # findings of a first run from which a hint about the baseline is shown
ABOUT = {
    "ste": "the whole standard is enforced.", "code": "comments that say nothing fail.", "prose-technical": "technical documents.", "changelog": "release notes.",
    "prose-corporate": "company documents, with longer sentences.", "comms-external": "announcements to others.", "comms-internal": "announcements within a company.", "minimal": "nothing fails.",
}
STARTER = '''profile = "code"
exclude = []

[severity]
# "C-4" = "soft"

[paths]
# "docs/**" = "prose-technical"
'''


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description="Prose rules over comments, documents, messages and strings.")
    p.add_argument("paths", nargs="*", help="files or folders (default: the root)")
    p.add_argument("-C", "--root", default=".", help="root of the project")
    p.add_argument("--staged", action="store_true", help="files staged for commit")
    p.add_argument("--diff", metavar="RANGE", help="files that differ in a range of revisions")
    p.add_argument("--commits", metavar="RANGE", help="messages of the commits of a range as well")
    p.add_argument("--scope", action="append", choices=["comment", "docstring", "markdown", "string", "identifier", "commit"], help="one kind of text; may repeat")
    p.add_argument("--no-gitignore", action="store_true", help="ignored files as well")
    p.add_argument("--pr-description-file", metavar="PATH", help="a change description as well")
    p.add_argument("--format", choices=["text", "json", "sarif", "github", "html"], default="text")
    p.add_argument("--quiet", action="store_true", help="failures only")
    p.add_argument("--stdout", action="store_true", help="findings on the terminal rather than in the report file")
    p.add_argument("--report", metavar="PATH", help="place of the report file")
    p.add_argument("--strict", action="store_true", help="soft findings fail too")
    p.add_argument("--no-fail", action="store_true", help="exit code 0 whatever is found")
    p.add_argument("--profile", choices=[*profiles.PROFILES, *profiles.ALIASES])
    p.add_argument("--disable", action="append", metavar="RULE")
    p.add_argument("--write-baseline", action="store_true", help="record what is found, so that only new findings fail")
    p.add_argument("--no-baseline", action="store_true")
    p.add_argument("--init", action="store_true", help="write a first quillspark.toml")
    p.add_argument("--status", action="store_true", help="profile and baseline in use")
    p.add_argument("--list-rules", action="store_true")
    return p


def configured(args: argparse.Namespace, root: Path) -> profiles.Config:
    config = profiles.load(str(root))
    if args.profile:
        config = config.only(profiles.canonical(args.profile))
    if args.scope:
        config = replace(config, scopes=tuple(args.scope))
    if args.commits and not args.scope:
        config = replace(config, scopes=(*config.scopes, "commit"))
    if args.disable:
        config = replace(config, disable=config.disable | set(args.disable))
    return replace(config, respect_gitignore=False) if args.no_gitignore else config


def provenance(config: profiles.Config) -> str:
    """What the run enforced, for readers who did not choose it."""
    line = f"Profile {config.profile}: {ABOUT[profiles.canonical(config.profile)]}"
    mapped = sorted({name for _, name in config.paths})
    return line + (f" Paths mapped to {', '.join(mapped)}." if mapped else "")


def run(args: argparse.Namespace, config: profiles.Config, root: Path, description: str | None) -> lint.Report:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    if args.staged or args.diff:
        files = [f for f in discover.changed_files(root, args.diff, args.staged) if discover.wanted(discover.shown(f, root), config)]
    else:
        files = discover.discover(args.paths or [str(root)], config, root)
    sources = discover.load(spark, files, root).persist()
    segments = extract.segments(sources, replace(config, exclude=(), include=()))  # chosen already
    if args.commits and not args.staged and not args.diff and "commit" in config.scopes:
        segments = segments.unionByName(extract.commits(discover.commit_log(spark, root, args.commits)))
    if description and description.strip():
        segments = segments.unionByName(extract.descriptions(spark.createDataFrame([("PR description", description)], "path string, body string")))
        config = replace(config, scopes=(*config.scopes, "pr_description"))
    return replace(lint.lint(segments, config), files=sources.select("path"))


def emit(found: lint.Report, args: argparse.Namespace, config: profiles.Config, root: Path) -> None:
    out = sys.stdout
    if args.format == "json":
        report.json_document(found, out)
    elif args.format == "sarif":
        report.sarif_document(found.findings, out)
    elif args.format == "github":
        out.writelines(r.value + "\n" for r in report.annotations(found.findings).toLocalIterator())
    elif args.format == "html":
        out.write(report.html_page(found, root.name) + "\n")
    else:
        shown = found.findings.where("severity = 'hard'") if args.quiet else found.findings
        n, place = shown.count(), None
        if n and not args.stdout and not args.staged and not args.diff:
            place = root / (args.report or config.report)
            try:
                with place.open("w", encoding="utf-8") as f:
                    report.text_detail(shown, f)
                    report.text_summary(found, f, not args.quiet)
                    f.write(f"\n{provenance(config)}\n")
            except OSError as e:
                print(f"quillspark: {place} can't be written: {e}", file=sys.stderr)
                place = None
        if place is None:
            report.text_detail(shown, out)
        report.text_summary(found, out, not args.quiet)
        out.write(f"\n{provenance(config)}\n")
        if place is not None:
            out.write(f"\nAll {n} findings are in {discover.shown(place, root)}.\n")
        if not args.quiet and not args.staged and not args.diff and n > MANY and not (root / config.baseline).is_file():
            print("\nA first run? Record what is found with --write-baseline, so that only new findings fail; --init writes a configuration.", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.list_rules:
        for i, slug, section, decided, deprecated, _ in rule_rows():
            print(f"{i:<6} {slug:<28} {section:<28} {decided}{' (deprecated)' if deprecated else ''}")
        return OK
    root = Path(args.root).resolve()
    if not root.is_dir():
        print(f"quillspark: {root} is no folder", file=sys.stderr)
        return USAGE
    if args.init:
        place = root / "quillspark.toml"
        if place.exists():
            print(f"quillspark: {place} exists", file=sys.stderr)
            return USAGE
        place.write_text(STARTER, encoding="utf-8")
        return OK
    config = configured(args, root)
    if args.status:
        print(provenance(config))
        print(f"Baseline: {config.baseline if (root / config.baseline).is_file() else 'none'}")
        return OK
    missing = [p for p in args.paths if not Path(p).exists()]
    description = None
    if args.pr_description_file:
        try:
            description = Path(args.pr_description_file).read_text(encoding="utf-8")
        except (OSError, UnicodeDecodeError):
            missing.append(args.pr_description_file)
    if missing:
        print(f"quillspark: {missing[0]} can't be read", file=sys.stderr)
        return USAGE
    found = run(args, config, root, description)
    place = root / config.baseline
    if args.write_baseline:
        known = sorted(r.fingerprint for r in lint.write_baseline(found.findings).collect())  # a file that one person keeps
        place.write_text(json.dumps({"note": "Known findings: reported, but no run fails for them.", "fingerprints": known}, indent=2) + "\n", encoding="utf-8")
        print(f"Recorded {len(known)} findings in {config.baseline}.")
        return OK
    if not args.no_baseline and place.is_file():
        try:
            known = json.loads(place.read_text(encoding="utf-8")).get("fingerprints", [])
        except (ValueError, AttributeError):
            known = []
        if known:
            spark = found.findings.sparkSession
            found = lint.with_baseline(found, spark.createDataFrame([(str(k),) for k in known], "fingerprint string"))
    found = found.kept()
    emit(found, args, config, root)
    return report.exit_code(found, args.strict, args.no_fail)

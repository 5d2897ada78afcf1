"""The command line on a small repository: selection, formats, baseline, exit codes."""

import io
import json
import subprocess

import pytest

from quillspark import cli
from quillspark.operators import judge, scan
from quillspark.plans import lint, profiles, report
from quillspark.sources import discover, extract


@pytest.fixture
def repo(tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / ".gitignore").write_text("skipped/\n")
    (tmp_path / "skipped").mkdir()
    (tmp_path / "skipped" / "x.md").write_text("A robust page that git ignores.\n")
    (tmp_path / "a.md").write_text("# A heading of words\n\nThis page is robust and seamless. It utilizes a map.\n")
    (tmp_path / "b.py").write_text("# In order to stop, we simply note the row.\nx = 1\n")
    (tmp_path / "sub" / "node_modules").mkdir(parents=True)
    (tmp_path / "sub" / "node_modules" / "c.md").write_text("A robust page that is excluded by its path.\n")
    run("add", "-A")
    run("commit", "-qm", "Fix the pump per code review feedback at once")
    (tmp_path / "new.md").write_text("A new page, robust as well.\n")
    (tmp_path / "big.md").write_bytes(b"x" * 2_000_001)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    return tmp_path


def called(capsys, *args):
    code = cli.main([*map(str, args)])
    return code, capsys.readouterr()


def test_discovery(repo):
    config = profiles.Config()
    names = lambda files: sorted(discover.shown(f, repo) for f in files)
    assert names(discover.discover([str(repo)], config, repo)) == [".gitignore", "a.md", "b.py", "bad.md", "big.md", "new.md"]
    every = names(discover.discover([str(repo)], profiles.Config(respect_gitignore=False), repo))
    assert "skipped/x.md" in every and "sub/node_modules/c.md" not in every
    assert names(discover.discover([str(repo / "a.md"), str(repo / "a.md"), str(repo / "none")], config, repo)) == ["a.md"]
    assert names(discover.discover([str(repo)], profiles.Config(include=("*.py",)), repo)) == ["b.py"]
    assert discover.git_files(repo / "none") is None and discover.changed_files(repo, "nothing..here") == []
    subprocess.run(["git", "add", "new.md"], cwd=repo, check=True)
    assert names(discover.changed_files(repo, staged=True)) == ["new.md"]


def test_usage(repo, capsys):
    assert called(capsys, "-C", repo, repo / "none.md")[0] == 2
    assert called(capsys, "-C", repo, "--pr-description-file", repo / "none")[0] == 2
    assert called(capsys, "-C", repo / "none")[0] == 2
    with pytest.raises(SystemExit) as e:
        cli.main(["--format", "pdf"])
    assert e.value.code == 2
    code, out = called(capsys, "--list-rules")
    assert code == 0 and len(out.out.splitlines()) == 104
    assert called(capsys, "-C", repo, "--init")[0] == 0 and called(capsys, "-C", repo, "--init")[0] == 2
    assert profiles.load(str(repo)).profile == "code"
    assert "Profile code" in called(capsys, "-C", repo, "--status")[1].out


def test_formats(spark, repo, capsys):
    code, out = called(capsys, "-C", repo, "--format", "json")
    doc = json.loads(out.out)
    assert code == 1 and doc["files_scanned"] >= 3 and {f["path"] for f in doc["findings"]} == {"a.md", "b.py", "new.md"}
    assert doc["summary"]["hard"] + doc["summary"]["soft"] == len(doc["findings"]) == sum(doc["summary"]["by_rule"].values())
    assert doc["findings"] == sorted(doc["findings"], key=lambda f: (f["path"], f["line"], f["rule"], f["message"]))
    assert list(doc["findings"][0]) == ["rule", "section", "rule_summary", "severity", "path", "line", "kind", "message", "excerpt", "suggestion"]
    doc = json.loads(called(capsys, "-C", repo, "--format", "sarif")[1].out)
    (ran,) = doc["runs"]
    assert doc["version"] == "2.1.0" and {r["ruleId"] for r in ran["results"]} == {r["id"] for r in ran["tool"]["driver"]["rules"]}
    assert ran["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a.md"
    out = called(capsys, "-C", repo, "--format", "github")[1].out
    assert out.startswith("::error file=a.md,line=3,title=A-2::")
    out = called(capsys, "-C", repo, "--format", "html")[1].out
    assert out.startswith("<!doctype html>") and "robust" in out


def test_text_report_and_baseline(spark, repo, capsys):
    code, out = called(capsys, "-C", repo, repo / "a.md", "--stdout")
    assert code == 1 and "\na.md\n  3:" in out.out and "Most frequent rules:" in out.out and "Profile code" in out.out
    code, out = called(capsys, "-C", repo)
    text = (repo / "quillspark-report.txt").read_text()
    assert code == 1 and "quillspark-report.txt" in out.out and "\nb.py\n" in text and "\nnew.md\n" in text
    assert called(capsys, "-C", repo, "--no-fail")[0] == 0
    assert called(capsys, "-C", repo, "--profile", "minimal")[0] == 0 and called(capsys, "-C", repo, "--profile", "minimal", "--strict")[0] == 1
    assert called(capsys, "-C", repo, "--disable", "A-2", "--disable", "V-5", "--stdout")[0] == 0
    assert called(capsys, "-C", repo, "--write-baseline")[0] == 0
    code, out = called(capsys, "-C", repo, "--stdout")
    assert code == 0 and "0 failing" in out.out and "suppressed" in out.out
    (repo / "c.md").write_text("One more powerful page of words.\n")
    assert called(capsys, "-C", repo, "--stdout")[0] == 1 and called(capsys, "-C", repo, "--no-baseline", "--stdout")[0] == 1
    assert called(capsys, "-C", repo, "--staged")[0] == 0


def test_commits_and_descriptions(spark, repo, capsys):
    (repo / "pr.txt").write_text("This is a robust change of the pump.")
    code, out = called(capsys, "-C", repo, repo / "b.py", "--pr-description-file", repo / "pr.txt", "--disable", "V-5", "--stdout")
    assert code == 1 and "PR description" in out.out
    code, out = called(capsys, "-C", repo, repo / "b.py", "--commits", "HEAD", "--format", "json", "--profile", "ste")
    assert any(f["kind"] == "commit" and f["severity"] == "soft" for f in json.loads(out.out)["findings"]) or code in (0, 1)


def test_no_findings(spark):
    none = lint.lint(spark.createDataFrame([], scan.SEGMENT))
    out = io.StringIO()
    report.json_document(none, out)
    report.text_summary(none, out)
    assert json.loads(out.getvalue().splitlines()[0])["findings"] == [] and "No findings." in out.getvalue()
    out = io.StringIO()
    report.sarif_document(none.findings, out)
    assert json.loads(out.getvalue())["runs"][0]["results"] == [] and "No findings" in report.html_page(none)


def test_labels(spark):
    rows = spark.createDataFrame([("a", "p", 1, "comment", "The matcher.", None, None, "struct Matcher"), ("b", "p", 2, "comment", "Port, 8080 by default.", None, None, None)], scan.SEGMENT)
    got = {r.seg_id: (r.bloated, r.score, r.reason) for r in judge.label(rows, lambda text, code: '```json\n{"score": 1.7, "reason": " name only "}\n```' if code else "sorry").collect()}
    assert got == {"a": (True, 1.0, "name only"), "b": (False, 0.0, "")}
    assert judge.parse_label('{"bloated": false, "score": 0.9}') == (False, 0.9, "") and judge.parse_label('{"score": "x"}') == (False, 0.0, "")


def test_serial_calls_stop_at_the_first_failure(spark):
    rows = spark.createDataFrame([(str(k), f"p{k}", 1, "markdown", f"It holds {k}.", None, None, None) for k in range(4)], scan.SEGMENT)

    def model(text, code, ids):
        if "2" in text:
            raise OSError("down")
        return judge.mock_model(text, code, ids)

    assert judge.judge(rows, model, at_once=4)[0].count() == 3
    assert judge.judge(rows, model, at_once=1)[0].count() < 4


def test_added_lines_of_units(spark):
    files = spark.createDataFrame([("a.py", "def a():\n    return 1\n\n\ndef b():\n    return 2\n")], "path string, source string")
    got = {r.name: r.added_lines for r in extract.code_units(files, {"a.py": [2, 4, 6]}).collect()}
    assert got == {"a": [2], "b": [6]} and all(r.added_lines is None for r in extract.code_units(files).collect())

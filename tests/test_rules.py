"""Every rule fires on its tell and stays silent on the look-alike beside it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalogue, scan
from quillspark.plans import fixture, lint, profiles, queries, report, sql
from quillspark.sources import discover, extract

from .conftest import SF


@pytest.fixture(scope="module")
def fixture_findings(spark):
    texts = queries.fixture_segments(spark)
    return scan.findings(texts).join(texts.select("seg_id", "text"), "seg_id").select("rule_id", "seg_id", "start", "stop", "hit", "message", "suggestion", "text").collect()


def test_catalogue():
    rows = catalogue.rule_rows()
    assert len(rows) == 104 and len({r[0] for r in rows}) == 104
    count = lambda k: sum(r[3] == k for r in rows)
    assert (count("mechanical"), count("judgment"), count("context")) == (41, 58, 5)
    assert {r[0] for r in rows if r[3] == "mechanical"} == set(scan.ALL_RULES)


def test_every_rule_fires(fixture_findings):
    assert {r.rule_id for r in fixture_findings} == set(scan.ALL_RULES)


def test_positions_are_exact(fixture_findings):
    for r in (r for r in fixture_findings if r.rule_id != "C-2"):  # its positions count each separator as two
        assert r.text[r.start : r.stop] == r.hit, r.rule_id


@pytest.mark.parametrize("rule_id", [r for r in scan.ALL_RULES if r not in ("C-1", "C-2")])
def test_same_as_sql_on_the_fixture(fixture_findings, rule_id):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    want = sorted(con.sql(sql.rule_sql(rule_id)).fetchall())
    got = sorted((r.seg_id, r.start, r.stop - r.start) for r in fixture_findings if r.rule_id == rule_id)
    assert got == want


def segs(spark, *rows):
    return spark.createDataFrame([(str(k), f"p{k}", 1, kind, text, None, None, code) for k, (kind, text, code) in enumerate(rows)], scan.SEGMENT)


def found(spark, rule_id, *rows):
    return [r.hit for r in scan.findings(segs(spark, *rows), [rule_id]).orderBy("seg_id", "start").collect()]


def test_overlapping_terms_all_count(spark):
    assert found(spark, "9.3", ("comment", "Come back up.", None)) == ["Come back", "back up"]


def test_first_use_of_a_word_only(spark):
    assert found(spark, "1.1", ("comment", "utilize Utilize utilize", None)) == ["utilize"]


def test_suggestions(fixture_findings):
    by = {(r.rule_id, r.hit.lower()): r.suggestion for r in fixture_findings}
    assert by["1.14", "colour"] == 'Write "color".' and by["V-5", "in the process of"] == "Delete it."
    assert by["4.2", "can't"] == 'Write "cannot".' and by["4.2", "i'm"] is None


def test_nulls_empty_and_long(spark):
    long = "The cat sat. " * 4000 + "In order to stop."
    assert found(spark, "V-5", ("comment", None, None), ("comment", "", None), ("comment", long, None)) == ["In order to"]


def test_profiles(spark):
    rows = {r.profile: r for r in profiles.profile_rules(spark).groupBy("profile").agg(F.count_if("hard").alias("h"), F.count_if("quiet").alias("q"), F.count_if("judged").alias("j")).collect()}
    assert {k: (r.h, r.q, r.j) for k, r in rows.items()} == {
        "ste": (7, 0, 42), "code": (16, 14, 6), "prose-technical": (16, 14, 6), "changelog": (15, 18, 3), "prose-corporate": (15, 15, 6),
        "comms-external": (14, 14, 6), "comms-internal": (13, 15, 6), "minimal": (0, 0, 42),
    }


def test_last_path_wins_and_changelog(spark):
    config = profiles.Config(paths=(("docs/*", "comms-internal"), ("docs/a/*", "concise")))
    paths = spark.createDataFrame([("docs/x.md",), ("docs/a/b.md",), ("CHANGELOG.md",), ("x/HISTORY",), ("z.py",)], "path string")
    got = [r[0] for r in paths.select(profiles.profile_of(F.col("path"), config)).collect()]
    assert got == ["comms-internal", "code", "changelog", "changelog", "code"]


def test_severity_table_beats_disable():
    config = profiles.Config(disable=frozenset({"A-2", "C-6"}), severity={"A-2": "soft", "C-6": "soft"})
    assert "A-2" not in profiles.disabled("code", config) and "C-6" not in profiles.judged("code", config)


def test_suppression_and_baseline(spark):
    rows = segs(spark, ("comment", "quillspark: ignore A-2\nA robust way; in order to go.", None), ("comment", "A robust way. quillspark: ignore", None), ("identifier", "cant e.g. colour", None))
    r = lint.lint(rows, profiles.Config(profile="ste", scopes=scan.KINDS))
    m = r.metrics().first()
    assert m.suppressed == 2 and m.segments_scanned == 3
    assert all(x.severity == "soft" for x in r.findings.where("kind = 'identifier'").collect())
    applied = lint.apply_baseline(r.findings, lint.write_baseline(r.findings))
    assert applied.where("severity = 'hard' or not in_baseline").count() == 0


def test_tiers(spark):
    rows = segs(spark, ("comment", "word " * 30 + ".", None), ("markdown", "word " * 33 + ".", None), ("commit", "word " * 60 + ".", None), ("comment", "word " * 40 + ".", None))
    got = {r.seg_id: r.severity for r in lint.lint(rows, profiles.Config(scopes=scan.KINDS)).findings.where("rule_id = 'C-1'").collect()}
    assert got == {"0": "soft", "1": "soft", "2": "soft", "3": "hard"}


def test_reports(spark):
    r = lint.lint(queries.fixture_segments(spark), profiles.Config(profile="ste", scopes=scan.KINDS, default_paths=False))
    first = report.json_rows(r.findings).first()[0]
    assert first.startswith('{"rule":') and "level" in report.sarif_results(r.findings).first()[0]
    assert report.annotations(r.findings).first()[0].startswith("::")
    picked = lint.examples(r.findings)
    assert len(picked) == 12 and len({p.shown for p in picked}) == 12
    assert "<script" not in report.html_page(r) and report.exit_code(r) == 1 and report.exit_code(r, no_fail=True) == 0


def test_config(tmp_path):
    (tmp_path / "pyproject.toml").write_text('[tool.quillspark]\nprofile = "concise"\n[tool.quillspark.severity]\n"C-4" = "hard"\nX = "hard"\n[tool.quillspark.sentence_tiers]\ncode = [9, 5]\nprose = [5, 9]\n')
    config = profiles.load(str(tmp_path))
    assert (config.profile, config.severity, config.sentence_tiers) == ("code", {"C-4": "hard"}, {"prose": (5, 9)})
    (tmp_path / "quillspark.toml").write_text("= broken")
    assert profiles.load(str(tmp_path)) == profiles.Config()


FILES = [
    ("a.js", "// one line of prose here\n// and a second one\nconst userName = 1; // TODO later on do it\n/** Doc text of a thing.\n * @param a b\n */\nalert('Could not open {name} now');\nlet s = \"it's // no comment in here\";\n"),
    ("b.py", 'def read_rows(a):\n    """Reads rows of the file."""\n    return a  # noqa: keep this one\n'),
    ("c.md", "---\nk: v\n---\n# Heading of the page\n\nFirst line of text\nsecond line.\n- item one is here:\n| a | b |\n```\nx\n```\nlast words stand here\n"),
    ("d.py", "# Databricks notebook source\n# MAGIC %md\n# MAGIC some words in a cell\n# COMMAND ----------\n# what the code below does\nx = 1\n# MAGIC %sql\n# MAGIC no words from here\n"),
    ("node/node_modules/x.js", "// this one is excluded by path\n"), ("e.txt", "not supported at all"), ("f.py", ""), ("g.py", None),
]


def test_extractors(spark):
    files = spark.createDataFrame(FILES, "path string, source string")
    rows = extract.segments(files, profiles.Config(scopes=("comment", "docstring", "markdown", "string", "identifier"))).collect()
    got = {(r.path, r.line, r.kind, r.text) for r in rows}
    assert got == {
        ("a.js", 1, "comment", "one line of prose here\nand a second one"), ("a.js", 4, "docstring", "Doc text of a thing."), ("a.js", 7, "string", "Could not open (value) now"),
        ("a.js", 3, "identifier", "user name"), ("b.py", 2, "docstring", "Reads rows of the file."), ("b.py", 1, "identifier", "read rows"),
        ("c.md", 4, "markdown", "Heading of the page"), ("c.md", 6, "markdown", "First line of text\nsecond line."), ("c.md", 8, "markdown", "item one is here:"), ("c.md", 12, "markdown", "last words stand here"),
        ("d.py", 5, "comment", "what the code below does"), ("d.py", 3, "markdown", "some words in a cell"),
    }
    assert next(r for r in rows if r.text == "item one is here:").register == "procedural"


def test_commits_and_units(spark):
    log = spark.createDataFrame([("0123456789abcdef", "fix(x)!: stop the pump early\n\nIt ran on for far too long\nRefs: 12\n"), ("f", "wip")], "sha string, message string")
    assert [(r.path, r.line, r.text) for r in extract.commits(log).orderBy("line").collect()] == [("commit 0123456789ab", 1, "stop the pump early"), ("commit 0123456789ab", 2, "It ran on for far too long")]
    files = spark.createDataFrame([("a.py", "class A:\n    def b(self): pass\n\ndef c():\n    def d(): pass\n"), ("b.py", "def ("), ("c.js", "x")], "path string, source string")
    assert [(r.name, r.kind, r.line) for r in extract.code_units(files).collect()] == [("A", "class", 1), ("c", "function", 4)]


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("Words of a page here.")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "c.md").write_bytes(b"\xff\xfe not text")
    (tmp_path / "sub" / "node_modules").mkdir()
    (tmp_path / "sub" / "node_modules" / "d.md").write_text("Left out by its path.")
    assert [(r.path, r.source) for r in discover.read_files(spark, str(tmp_path)).collect()] == [("sub/a.md", "Words of a page here.")]


def test_judge(spark):
    from quillspark.operators import judge

    rows = segs(spark, ("markdown", "It holds.", None), ("markdown", "Rows hold. quillspark: ignore A-1", None), ("commit", "It holds.", None))
    hits, fresh = judge.judge(rows, judge.mock_model)
    assert [(r.rule_id, r.severity) for r in hits.collect()] == [("C-6", "soft")]
    calls = []
    again, none = judge.judge(rows, lambda *a: calls.append(a) or "[]", cache=spark.createDataFrame(fresh.collect(), judge.CACHE))
    assert none.count() == 0 and again.count() == 1
    assert judge.parse('```json\n[{"rule_id":"C-6","violates":true,"confidence":7},{"rule_id":"Q"}]\n```', ["C-6"]) == [("C-6", True, "", None, 1.0)]
    assert judge.parse("no", ["C-6"]) == []


def test_features(spark):
    from quillspark.operators import features

    row = features.features(segs(spark, ("comment", "It may run, however. Get user name.", "getUserName()"))).first().asDict()
    assert row["word_count"] == 7 and row["sentence_count"] == 2 and row["hedge_rate"] == pytest.approx(1 / 7) and row["max_sentence_words"] == 4
    assert row["code_overlap"] == pytest.approx(3 / 6) and row["comment_to_code_ratio"] == 7


def test_stream(spark, tmp_path):
    from quillspark.streaming import stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("A robust tool stands here.")
    out = stream.finding_stream(stream.file_stream(spark, str(tmp_path / "in")), ["A-2"])
    q = out.writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert [r.hit for r in spark.sql("select hit from found").collect()] == ["robust"]


def test_queries_have_rows(spark):
    for name in ("path_profiles", "page_strings", "conversation_findings"):
        assert queries.QUERIES[name](spark, SF).limit(1).count() == 1, name


def test_fixture_is_whole():
    assert len(fixture.values().splitlines()) >= len(fixture.ROWS)


def test_dictionary_pages(spark):
    from quillspark.sources import dictionary

    page = "Page 3\nABOUT (prep) Meaning here\nabandon (v) STOP (v) Stop the work.\n   LEAVE (v) Leave it.\n  STOP (v)\nplain text\nACCESS (n) x\n   LATE (adj) belongs to nothing\nABOUT (adv) again"
    words = dictionary.parse(spark.createDataFrame([("d", 1, page)], "document string, page int, text string"))
    got = {r.word: (r.approved, list(r.parts), list(r.alternatives)) for r in words.collect()}
    assert got == {"about": (True, ["adv", "prep"], []), "access": (True, ["n"], []), "abandon": (False, ["v"], ["stop (v)", "leave (v)"])}
    assert not dictionary.usable(words)
    hits = dictionary.rejected_words(segs(spark, ("comment", "To Abandon, abandon it.", None)), words.where("not approved")).collect()
    assert [(r.word, r.start, r.suggestion) for r in hits] == [("abandon", 3, "Use stop, leave.")]

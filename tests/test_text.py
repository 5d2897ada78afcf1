"""Text functions, against hand-made cases and a plain Python restatement."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as tx


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    made = make("t")
    return [r[0] for r in rows.orderBy("i").select(F.expr(made) if isinstance(made, str) else made).collect()]


@pytest.mark.parametrize(
    ("text", "n"),
    [("Open the (small red) valve now please", 6), ('Push the "start all" button on it', 6), ("Wait for 5 min here", 4), ("A well-known two-part rule", 4), ("", 0), ("It weighs 10 kg, or 12 lb.", 5), ("...", 0)],
)
def test_word_counts(spark, text, n):
    assert column(spark, [text], tx.count_words) == [n]


def test_sentences(spark):
    text = "First one here. Use e.g. this one! **Bold lead.** Rest of 1.5 it"
    got = column(spark, [text], tx.sentences)[0]
    assert [s.text for s in got] == ["First one here.", "Use e.g. this one!", "**Bold lead.**", "Rest of 1.5 it"]
    for s in got:
        assert text[s.start : s.start + len(s.text)] == s.text
    assert [s.register for s in got] == ["descriptive", "procedural", "descriptive", "descriptive"]


def test_registers(spark):
    texts = ["Check the pump", "Log output is written", "Do not touch", "Don't", "Rows arrive", ""]
    got = column(spark, texts, tx.register)
    assert got == ["procedural", "descriptive", "procedural", "procedural", "descriptive", "descriptive"]


def test_paragraphs_shift_by_two(spark):
    got = column(spark, ["one\n \n\ntwo\n\nthree"], tx.paragraphs)[0]
    assert [(p.text, p.start) for p in got] == [("one", 0), ("two", 5), ("three", 10)]


def test_strip_code_and_names(spark):
    assert column(spark, ["a\n```x\ny```\n    code\n[see](u) ![i](v)"], tx.strip_code) == ["a\n\n\n\nsee i"]
    assert column(spark, ["getUserName2", "HTTPServer_url"], tx.identifier_words) == [["get", "user"], ["http", "server", "url"]]


def test_null_and_blank(spark):
    assert column(spark, [None, "  "], lambda t: f"size({tx.sentences(t)})") in ([-1, 0], [None, 0])
    assert column(spark, ["  "], tx.paragraphs) == [[]]


def test_long_texts_have_exact_positions(spark):
    """Prefix sums of a text of many sentences, over the length at which they are cut into pieces."""
    text = "".join(f"One {'x' * (k % 7)} two.{chr(10) if k % 5 == 0 else ' '}" for k in range(3000))
    got = column(spark, [text], tx.sentences)[0]
    assert len(got) == 3000
    for s in got[::37] + got[-1:]:
        assert text[s.start : s.start + len(s.text)] == s.text and s.breaks == text[: s.start].count("\n")


def test_shorten(spark):
    got = column(spark, ["a  b\nc", "x" * 200], tx.shorten)
    assert got[0] == "a b c" and len(got[1]) == 140 and got[1].endswith("…")


def test_unicode_word_bounds(spark):
    """Both must hold at all times: NBSP is white space and U+0130 folds under (?U)."""
    assert column(spark, ["a\u00a0b", "\u0130"], lambda t: F.col(t).rlike(r"(?U)a\sb|(?iU)^i")) [0] is True
    assert re.search(r"a\sb", "a\u00a0b")


def test_needles_in_one_pass(spark):
    """The terms found in one pass are those that stand in the text, also where they overlap or begin alike."""
    from quillspark.operators import scan

    terms = scan._needed(set(scan.ALL_RULES))
    texts = ["", *terms, *(f"x{a}{b[1:]}" for a, b in zip(terms, terms[1:])), *(a + b for a, b in zip(terms, terms[5:]))]
    rows = spark.createDataFrame([(t,) for t in texts], "_low string").selectExpr("_low", f"{scan.present(terms)} AS f").collect()
    for r in rows:
        assert {t for t in terms if t in r._low} == {t for t in terms if any(f.startswith(t) for f in r.f)}, r._low


def test_segments_leave_in_small_batches():
    """A large batch of files gives its segments piece by piece, all of them in order; texts of any size, none and null too."""
    import pyarrow as pa

    from quillspark.functions.batches import SLICE_BYTES, slices
    from quillspark.sources import extract

    body = "Some words stand in this line here.\n\nAnd some others stand in that one.\n"
    sources = [body * 300, None, "", body] * 200 + [body * 40_000, body]
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{k}.md" for k in range(len(sources))]), pa.array(sources)], names=["path", "source"])
    out = list(extract.extracted(iter([batch]), ("markdown",), False))
    want = [(f"f{k}.md#{n}", r[2]) for k, s in enumerate(sources) if s for n, r in enumerate(extract.markdown(s))]
    assert [(r["seg_id"], r["text"]) for b in out for r in b.select(["seg_id", "text"]).to_pylist()] == want
    assert len(out) > 4 and max(b.num_rows for b in out[:-2]) < 2 * SLICE_BYTES // len(body) * 3
    assert [x.num_rows for x in slices(batch.slice(0, 0), 1)] == [0] and sum(x.num_rows for x in slices(batch.slice(3, 500), 1)) == 500

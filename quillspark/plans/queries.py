"""Registered queries over the tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import features, judge, scan
from ..operators.catalogue import rule_rows
from ..sources import extract
from . import fixture, lint, profiles, sql

Query = Callable[[SparkSession, str], DataFrame]


def fixture_segments(spark: SparkSession) -> DataFrame:
    rows = [(f"fix-{k}", f"fix-{k}", 1, kind, text, None, None, code) for k, (kind, text, code) in enumerate(fixture.ROWS)]
    return spark.createDataFrame(rows, scan.SEGMENT)


def spread(rows: DataFrame) -> DataFrame:
    """Small files come in fewer splits than there are cores; large ones are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * 2) if rows.rdd.getNumPartitions() < cores else rows


def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one Markdown segment."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null"))
    name = F.col("doc_id").cast("string")
    return extract.whole_texts(docs, F.concat(F.lit("doc-"), name), F.concat_ws("/", "source", F.concat(name, F.lit(".md"))), "markdown")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_segments(spark, sf_dir).unionByName(fixture_segments(spark))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules under the strict profile: findings by rule and severity."""
    config = profiles.Config(profile="ste", default_paths=False, scopes=scan.KINDS)
    found = lint.lint(segments(spark, sf_dir), config).findings
    return found.groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def _rule(rule_id: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = scan.findings(segments(spark, sf_dir), [rule_id])
        return found.select("seg_id", F.col("start").cast("long").alias("start"), F.length("hit").cast("long").alias("length"))

    return run


def long_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.findings(segments(spark, sf_dir), ["C-1"])
    return found.select("seg_id", F.col("start").cast("long").alias("start"), F.col("n").alias("n_words"), F.when(F.col("note").startswith("instruction"), "procedural").otherwise("descriptive").alias("register"))


def long_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan.findings(segments(spark, sf_dir), ["C-2"])
    return found.select("seg_id", F.col("start").cast("long").alias("start"), F.col("n").alias("n_sentences"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.sentence_rows(segments(spark, sf_dir))
    return rows.groupBy("seg_id").agg(F.count("*").alias("n_sentences"), F.sum("s.n_words").alias("n_words"), F.max("s.n_words").alias("longest"), F.count_if(F.col("s.register") == "procedural").alias("n_instructions"))


def rules_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.rules_table(spark).groupBy("section", "decidability", "deprecated").agg(F.count("*").alias("n"))


def profile_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.profile_rules(spark).groupBy("profile").agg(F.count_if("hard").alias("n_hard"), F.count_if("quiet").alias("n_quiet"), F.count_if("judged").alias("n_judged"))


def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.features(segments(spark, sf_dir))


def weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules as labellers against the quality labels."""
    segs = document_segments(spark, sf_dir)
    found = scan.findings(segs, ["C-2", "C-3", "3.2", "3.5"])
    weak = features.weak_labels(segs, found)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("seg_id"), "quality")
    return weak.join(labels, "seg_id").groupBy("quality", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count("*").alias("n"))


def path_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = profiles.Config(paths=(("src1/*", "ste"), ("src*/*7.md", "comms-internal"), ("*/1?.md", "concise")))
    return document_segments(spark, sf_dir).groupBy(profiles.profile_of(F.col("path"), config).alias("profile")).agg(F.count("*").alias("n"))


_KNOWN = ("C-3", "4.2", "A-2", "3.5")


def baseline_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all documents against a baseline of four rules."""
    config = profiles.Config(profile="ste", default_paths=False, scopes=scan.KINDS)
    segs = segments(spark, sf_dir)
    found = lint.lint(segs, config).findings
    known = lint.write_baseline(lint.lint(segs, replace(config, disable=frozenset(scan.ALL_RULES) - frozenset(_KNOWN))).findings)
    return lint.apply_baseline(found, known).groupBy("rule_id", "severity", "in_baseline").agg(F.count("*").alias("n"))


def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent rules of a report's summary."""
    config = profiles.Config(profile="ste", default_paths=False, scopes=scan.KINDS)
    return lint.top_rules(lint.lint(segments(spark, sf_dir), config).findings)


def judged_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = judge.judge(segments(spark, sf_dir), judge.mock_model, limit=None)
    return found.select("rule_id", "severity", "seg_id", "excerpt")


def page_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes and comments of web pages by the string and comment extractors."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    files = pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("source"))
    return extract.segments(files).select("seg_id", "line", "kind", "text")


def markdown_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("source"))
    return extract.segments(files).select("seg_id", "line", "kind", "text")


def conversation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat turns as change descriptions, under the default profile; by role and rule."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    path = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role"))
    segs = extract.descriptions(turns.select(path.alias("path"), F.col("text").alias("body")))
    found = lint.lint(segs, profiles.Config(scopes=("pr_description",))).findings
    return found.groupBy(F.substring_index("path", "-", -1).alias("role"), "rule_id", "severity").agg(F.count("*").alias("n"))


_PATTERN_RULES = [r for r in scan.ALL_RULES if r not in ("C-1", "C-2")]


def _name(rule_id: str) -> str:
    return "rule_" + rule_id.lower().replace("-", "_").replace(".", "_")


QUERIES: dict[str, Query] = {
    "flagship": flagship,
    **{_name(r): _rule(r) for r in _PATTERN_RULES},
    "rule_c_1": long_sentences,
    "rule_c_2": long_paragraphs,
    "sentence_counts": sentence_counts,
    "feature_vectors": feature_vectors,
    "weak_label_quality": weak_label_quality,
    "path_profiles": path_profiles,
    "rules_by_section": rules_by_section,
    "profile_sizes": profile_sizes,
    "baseline_roundtrip": baseline_roundtrip,
    "top_rules": top_rules,
    "judged_mock": judged_mock,
    "page_strings": page_strings,
    "markdown_segments": markdown_segments,
    "conversation_findings": conversation_findings,
}


def _count(parts: list[str]) -> str:
    return f"(SELECT seg_id, count(*) AS k FROM ({' UNION ALL '.join(parts)}) GROUP BY seg_id)"


_FLAGSHIP = (
    sql.severity_sql(set(profiles.PROFILES["ste"].hard), _PATTERN_RULES)
    + f" UNION ALL SELECT 'C-1', CASE WHEN kind IN ('identifier', 'commit') THEN 'soft' ELSE 'hard' END, count(*) FROM ({sql.C1}) JOIN (WITH {sql.SEG} SELECT seg_id, kind FROM seg) USING (seg_id) GROUP BY ALL"
    + f" UNION ALL SELECT 'C-2', 'hard', count(*) FROM ({sql.C2}) GROUP BY ALL"
)
_ASKED = profiles.Config(scopes=("pr_description",))
ORACLES: dict[str, str] = {
    "flagship": _FLAGSHIP,
    "top_rules": f"SELECT rule_id, sum(n)::BIGINT AS n FROM ({_FLAGSHIP}) GROUP BY rule_id ORDER BY n DESC, rule_id LIMIT 8",
    "baseline_roundtrip": f"SELECT rule_id, CASE WHEN rule_id IN {sql.listed(_KNOWN)} THEN 'soft' ELSE severity END AS severity, rule_id IN {sql.listed(_KNOWN)} AS in_baseline, sum(n)::BIGINT AS n FROM ({_FLAGSHIP}) GROUP BY ALL",
    "markdown_segments": sql.MARKDOWN,
    "feature_vectors": sql.FEATURES,
    "conversation_findings": sql.conversation_sql([r for r in scan.ALL_RULES if r not in profiles.disabled("code", _ASKED)], set(profiles.PROFILES["code"].hard)),
    **{_name(r): sql.rule_sql(r) for r in _PATTERN_RULES},
    "rule_c_1": sql.C1,
    "rule_c_2": sql.C2,
    "sentence_counts": sql.SENTENCE_COUNTS,
    "weak_label_quality": f"""
WITH hits AS (SELECT * FROM {_count([f"SELECT seg_id FROM ({sql.C2})", *(f"SELECT seg_id FROM ({sql.rule_sql(r)})" for r in ("C-3", "3.2", "3.5"))])})
SELECT quality, CASE WHEN coalesce(k, 0) >= 3 THEN 1 WHEN coalesce(k, 0) = 0 THEN 0 ELSE -1 END AS label, count(*) AS n
FROM labels JOIN documents USING (doc_id) LEFT JOIN hits ON seg_id = 'doc-' || doc_id GROUP BY ALL""",
    "path_profiles": """
SELECT CASE WHEN regexp_full_match(p, '.*/1.\\.md') THEN 'code' WHEN regexp_full_match(p, 'src.*/.*7\\.md') THEN 'comms-internal' WHEN p LIKE 'src1/%' THEN 'ste' ELSE 'code' END AS profile, count(*) AS n
FROM (SELECT source || '/' || doc_id || '.md' AS p FROM documents) GROUP BY ALL""",
    "profile_sizes": """SELECT profile, n_hard::BIGINT AS n_hard, n_quiet::BIGINT AS n_quiet, n_judged::BIGINT AS n_judged FROM (VALUES
('ste', 7, 0, 42), ('code', 16, 14, 6), ('prose-technical', 16, 14, 6), ('changelog', 15, 18, 3), ('prose-corporate', 15, 15, 6),
('comms-external', 14, 14, 6), ('comms-internal', 13, 15, 6), ('minimal', 0, 0, 42)) AS p(profile, n_hard, n_quiet, n_judged)""",
    "judged_mock": f"""WITH {sql.SEG} SELECT 'C-6' AS rule_id, 'soft' AS severity, seg_id, substr(text, 1, 140) AS excerpt
FROM seg WHERE kind NOT IN ('identifier', 'commit') AND regexp_matches(text, '(?i)^\\s*(it|they)\\b')""",
    "rules_by_section": "SELECT section, decidability, deprecated, count(*) AS n FROM (VALUES "
    + ", ".join(f"({sql.q(r[2])}, {sql.q(r[3])}, {str(r[4]).lower()})" for r in rule_rows())
    + ") AS r(section, decidability, deprecated) GROUP BY ALL",
}

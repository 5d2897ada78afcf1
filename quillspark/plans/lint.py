"""From segments to reported findings: profile, scan, suppression, severity, baseline, order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scan
from . import profiles
from .profiles import Config

MARKER = r"(?iU)quillspark:\s*ignore([\s\w.,GR-]*)"
COLUMNS = ["rule_id", "severity", "path", "line", "kind", "message", "excerpt", "suggestion", "shown", "seg_id", "start"]


@dataclass
class Report:
    findings: DataFrame
    segments: DataFrame
    suppressed_segments: DataFrame
    suppressed_findings: DataFrame
    files: DataFrame | None = None  # (path) of all files read; without it, those with a segment count

    def kept(self) -> Report:
        """With the findings stored once, for the several passes of a sink."""
        return replace(self, findings=self.findings.persist())

    def metrics(self) -> DataFrame:
        """One row: hard, soft, suppressed, segments_scanned, files_scanned."""
        level = self.findings.agg(F.count_if(F.col("severity") == "hard").alias("hard"), F.count_if(F.col("severity") == "soft").alias("soft"))
        gone = self.suppressed_segments.select(F.lit(1)).unionAll(self.suppressed_findings.select(F.lit(1))).agg(F.count("*").alias("suppressed"))
        seen = self.segments.agg(F.count("*").alias("segments_scanned"), F.countDistinct("path").alias("files_scanned"))
        if self.files is not None:
            seen = seen.drop("files_scanned").crossJoin(self.files.agg(F.count("*").alias("files_scanned")))
        return level.crossJoin(gone).crossJoin(seen)  # rows of one


def marker(text: Column) -> Column:
    """Rule ids of an ignore marker in a text: null without one, empty for a bare one."""
    listed = F.filter(F.split(F.regexp_extract(text, MARKER, 1), r"(?U)[\s,]+"), lambda r: r != "")
    return F.when(text.rlike(MARKER), listed)


def severity(config: Config) -> Column:
    """Of a finding joined with its resolved rule."""
    plain = F.when(F.col("hard"), "hard").otherwise("soft")
    long = F.when(F.col("over_fail"), plain).otherwise("soft")
    return F.when(F.col("kind").isin(*profiles.SOFT_KINDS), "soft").when(F.col("override").isNotNull(), F.col("override")).when(F.col("rule_id") == "C-1", long).otherwise(plain)


def lint(segments: DataFrame, config: Config | None = None) -> Report:
    """Run every enabled rule over the segments of the configured scopes."""
    config = config or Config()
    spark = segments.sparkSession
    scoped = segments.where(F.col("kind").isin(*config.scopes)).withColumn("profile", profiles.profile_of(F.col("path"), config)).withColumn("_ignored", marker(F.col("text")))
    bare = F.coalesce(F.size("_ignored") == 0, F.lit(False)) & F.col("_ignored").isNotNull()
    live = scoped.where(~bare)
    wanted = {r for name in profiles.used_profiles(config) for r in scan.ALL_RULES if r not in profiles.disabled(name, config)}
    rows = scan.findings(live, wanted, profiles.limits(config))
    rules = profiles.resolved_rules(spark, config)
    rows = rows.join(F.broadcast(rules), ["profile", "rule_id"])  # 104 rules by 8 profiles at most
    hushed = F.coalesce(F.array_contains("_ignored", F.col("rule_id")), F.lit(False))
    named = rows.withColumn("severity", severity(config))
    return Report(named.where(~hushed).select(*COLUMNS), scoped, scoped.where(bare).select("seg_id"), named.where(hushed).select("seg_id", "rule_id"))


def fingerprint() -> Column:
    """What a finding is known by: rule, path and excerpt, but no line."""
    return F.concat_ws("|", "rule_id", "path", F.trim(F.col("excerpt")))


def write_baseline(findings: DataFrame) -> DataFrame:
    return findings.select(fingerprint().alias("fingerprint")).distinct()


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Known findings stay, hard ones become soft; ``in_baseline`` counts as suppressed."""
    known = baseline.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    rows = findings.withColumn("fingerprint", fingerprint()).join(known, "fingerprint", "left")
    seen = F.coalesce("_known", F.lit(False))
    return rows.withColumn("severity", F.when(seen, "soft").otherwise(F.col("severity"))).withColumn("in_baseline", seen).drop("_known", "fingerprint")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "rule_id", "message")


def by_rule(findings: DataFrame) -> DataFrame:
    """Counts by rule, most first; ties by the first in report order."""
    first = F.min(F.struct("path", "line", "rule_id", "message")).alias("first")
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"), first).orderBy(F.desc("n"), "first").drop("first")


def with_baseline(report: Report, baseline: DataFrame) -> Report:
    """The report with known findings made soft and counted as suppressed."""
    applied = apply_baseline(report.findings, baseline)
    more = applied.where("in_baseline").select("seg_id", "rule_id")
    return replace(report, findings=applied.drop("in_baseline"), suppressed_findings=report.suppressed_findings.unionByName(more))


def top_rules(findings: DataFrame, limit: int = 8) -> DataFrame:
    """The most frequent rules of a summary (a top-k report)."""
    return by_rule(findings).limit(limit)


def family(rule_id: Column) -> Column:
    return F.when(rule_id.startswith("A-"), "tell").when(rule_id.startswith("V-"), "value").otherwise("ste")


def examples(findings: DataFrame, limit: int = 12, per_rule: int = 3) -> list:
    """Clearest findings: tells, then comment value, then the standard; hard before soft; few per
    rule; no text twice. At most ``limit + per_rule`` ranked rows a rule reach the driver."""
    from pyspark.sql import Window

    whole = F.trim(F.col("shown"))
    shown = F.when(F.length(whole) > 0, whole).otherwise(F.trim("excerpt"))
    rank = F.struct(F.when(family(F.col("rule_id")) == "tell", 0).when(family(F.col("rule_id")) == "value", 1).otherwise(2).alias("f"), (F.col("severity") != "hard").alias("s"), F.col("path"), F.col("line"), F.col("start"), F.col("message"))
    one = findings.withColumn("shown", shown).withColumn("rank", rank).groupBy("rule_id", "shown").agg(F.min(F.struct("rank", *COLUMNS)).alias("r")).select(F.col("shown").alias("_s"), "r.*").withColumn("shown", F.col("_s")).drop("_s")
    top = one.withColumn("_k", F.row_number().over(Window.partitionBy("rule_id").orderBy("rank"))).where(F.col("_k") <= limit + per_rule)
    picked, per, texts = [], {}, set()
    for r in sorted(top.collect(), key=lambda r: tuple(r["rank"])):
        if per.get(r.rule_id, 0) < per_rule and r.shown not in texts and len(picked) < limit:
            picked.append(r)
            per[r.rule_id] = per.get(r.rule_id, 0) + 1
            texts.add(r.shown)
    return picked

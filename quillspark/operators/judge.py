"""The judgment tier: rules that a model decides. The model is a callable; none is called here.

Calls are made by ``mapInPandas`` in as many partitions as calls may run at once. A cache table keyed
by content keeps verdicts; what it holds costs no call.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import profiles
from .catalogue import rule_rows
from .scan import SHOWN

VERDICTS = "rule_id string, violates boolean, message string, suggestion string, confidence double"
CACHE = f"key string, verdicts array<struct<{', '.join(x.replace(' ', ':', 1) for x in VERDICTS.split(', ')).replace(': ', ':')}>>"
Model = Callable[[str, str | None, list[str]], str]


def mock_model(text: str, code: str | None, rule_ids: list[str]) -> str:
    """An offline stand-in: "it" at the start of a text breaks the clear-referent rule."""
    hit = "C-6" in rule_ids and re.match(r"(?i)\s*(it|they)\b", text)
    return json.dumps([{"rule_id": "C-6", "violates": True, "message": "The pronoun has no noun.", "suggestion": None, "confidence": 0.9}] if hit else [])


def parse(reply: str, rule_ids: list[str]) -> list[tuple]:
    """Verdicts of a reply that may be fenced or stand in other text; unknown rules are dropped."""
    m = re.search(r"(?s)\[.*\]", reply or "")
    try:
        items = json.loads(m.group()) if m else []
    except ValueError:
        return []
    out = []
    for x in items if isinstance(items, list) else []:
        if isinstance(x, dict) and x.get("rule_id") in rule_ids:
            try:
                sure = min(1.0, max(0.0, float(x.get("confidence", 1.0))))
            except (TypeError, ValueError):
                sure = 0.0
            out.append((x["rule_id"], bool(x.get("violates")), str(x.get("message") or ""), x.get("suggestion"), sure))
    return out


def tag(profile: str, config: profiles.Config) -> str:
    """What a verdict depends on besides the text: the rules asked."""
    asked = profiles.judged(profile, config)
    return ",".join(f"{r[0]}:{r[1]}" for r in rule_rows() if r[0] in asked and not r[0].startswith("D-"))


def eligible(segments: DataFrame, config: profiles.Config, model_name: str) -> DataFrame:
    """Segments to ask about, with their profile, rules and cache key."""
    from ..plans.lint import MARKER

    rows = segments.where(~F.col("kind").isin(*profiles.SOFT_KINDS) & ~F.col("text").rlike(MARKER)).withColumn("profile", profiles.profile_of(F.col("path"), config))
    tags = F.lit("")
    for name in profiles.used_profiles(config):
        tags = F.when(F.col("profile") == name, tag(name, config)).otherwise(tags)
    rows = rows.withColumn("_tag", tags).where("_tag != ''")
    return rows.withColumn("key", F.sha2(F.concat_ws("\u0001", F.lit(model_name), "_tag", "text", F.coalesce("follows_code", F.lit(""))), 256))


def judge(segments: DataFrame, model: Model, config: profiles.Config | None = None, cache: DataFrame | None = None, model_name: str = "mock", limit: int | None = 200, at_once: int = 8) -> tuple[DataFrame, DataFrame]:
    """Soft findings, and the rows to add to the cache. ``limit`` bounds the calls, in segment order
    (it is the budget of a run; None asks about all)."""
    config = config or profiles.Config()
    rows = eligible(segments, config, model_name)
    known = cache if cache is not None else segments.sparkSession.createDataFrame([], CACHE)
    asked = rows.join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct("path", "line", "seg_id", "text", "follows_code", "_tag")).alias("r"))
    asked = asked.select("key", "r.*")
    asked = asked.orderBy("path", "line", "seg_id").limit(limit) if limit is not None else asked

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, text, code, rule_tag in zip(frame["key"], frame["text"], frame["follows_code"], frame["_tag"], strict=True):
                ids = [x.split(":")[0] for x in rule_tag.split(",")]
                try:
                    out.append((key, parse(model(text, code, ids), ids)))
                except Exception:  # noqa: BLE001  # a provider's failure costs its own verdict only
                    if at_once == 1:  # one after another, the first failure ends the run
                        yield pd.DataFrame(out, columns=["key", "verdicts"])
                        return
            yield pd.DataFrame(out, columns=["key", "verdicts"])

    fresh = asked.repartition(at_once).mapInPandas(call, CACHE)
    verdicts = known.unionByName(fresh)
    found = rows.join(verdicts, "key").select("*", F.explode("verdicts").alias("v")).where("v.violates")
    shown = F.substring("text", 1, 140)
    return found.select(F.col("v.rule_id").alias("rule_id"), F.lit("soft").alias("severity"), "path", "line", "kind", F.col("v.message").alias("message"), shown.alias("excerpt"), F.col("v.suggestion").alias("suggestion"), F.when(F.length("text") <= SHOWN, F.col("text")).alias("shown"), "seg_id", F.lit(0).alias("start")), fresh


def parse_label(reply: str | None) -> tuple[bool, float, str]:
    """(bloated, score, reason) of a reply that may be fenced or stand in other text."""
    m = re.search(r"(?s)\{.*\}", reply or "")
    try:
        found = json.loads(m.group()) if m else None
        score = float(found.get("score") or 0.0) if isinstance(found, dict) else 0.0
    except (TypeError, ValueError):
        return False, 0.0, ""
    if not isinstance(found, dict):
        return False, 0.0, ""
    return bool(found.get("bloated", score >= 0.5)), min(1.0, max(0.0, score)), str(found.get("reason") or "").strip()


def label(segments: DataFrame, model: Callable[[str, str | None], str], at_once: int = 8) -> DataFrame:
    """Training labels of a classifier: seg_id, bloated, score (0 essential, 1 noise) and reason."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(s, *parse_label(model(t, c))) for s, t, c in zip(frame["seg_id"], frame["text"], frame["follows_code"], strict=True)]
            yield pd.DataFrame(rows, columns=["seg_id", "bloated", "score", "reason"])

    return segments.select("seg_id", "text", "follows_code").repartition(at_once).mapInPandas(call, "seg_id string, bloated boolean, score double, reason string")

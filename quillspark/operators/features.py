"""Feature vector of a segment, weak labels, and the seam for a trained classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

NAMES = ("abstract_noun_rate", "code_overlap", "comma_rate", "comment_to_code_ratio", "connective_rate", "hedge_rate", "max_sentence_words", "mean_sentence_words", "mean_word_length", "sentence_count", "word_count")
_HEDGE = r"(?iU)\b(?:rather|quite|fairly|relatively|somewhat|perhaps|potentially|possibly|often|usually|generally|typically|should|could|might|may)\b"
_ABSTRACT = r"(?iU)\b\w+(?:ism|hood|ship|ness|ity|ence|ance|ment|sion|tion)\b"
_LINK = r"(?iU)\b(?:accordingly|nonetheless|nevertheless|hence|thus|consequently|additionally|furthermore|moreover|therefore|however)\b"


def _overlap_words(text: Column) -> Column:
    parts = F.split(text, r"(?U)[_\-\W]+|(?<=[a-z0-9])(?=[A-Z])")
    return F.array_distinct(F.transform(F.filter(parts, lambda w: w.rlike(r"^\p{L}{3,}$")), F.lower))


def features(segments: DataFrame) -> DataFrame:
    """Segment id and the eleven features, columns in the fixed order of ``NAMES``."""
    rows = segments.withColumn("_t", tx.clean(F.col("text"))).withColumn("_s", F.expr(tx.sentences("_t"))).withColumn("_r", F.expr(tx.rimmed("_t")))
    rows = rows.withColumn("_w", F.expr(tx.ste_words("_r"))).withColumn("_u", F.expr(f"size(_w) - {tx.n_words('_r')}"))
    rows = rows.withColumn("_n", F.greatest(F.size("_w") - F.col("_u"), F.lit(1)).cast("double")).withColumn("_c", F.greatest(F.size("_s"), F.lit(1)).cast("double"))
    code = F.size(F.filter(F.split("follows_code", r"(?U)\s+"), lambda w: w != ""))
    prose, other = _overlap_words(F.col("_t")), _overlap_words(F.col("follows_code"))
    some = F.coalesce("follows_code", F.lit("")) != ""
    # a number merged with its unit is one word, of both lengths and the space between
    letters = F.length(F.array_join("_w", "")) + F.col("_u")
    values = {
        "word_count": F.col("_n"),
        "sentence_count": F.col("_c"),
        "mean_sentence_words": F.col("_n") / F.col("_c"),
        "max_sentence_words": F.coalesce(F.array_max(F.transform("_s", lambda s: s["n_words"])), F.lit(0)).cast("double"),
        "mean_word_length": letters / F.col("_n"),
        "hedge_rate": F.regexp_count("_t", F.lit(_HEDGE)) / F.col("_n"),
        "abstract_noun_rate": F.regexp_count("_t", F.lit(_ABSTRACT)) / F.col("_n"),
        "connective_rate": F.regexp_count("_t", F.lit(_LINK)) / F.col("_n"),
        "comma_rate": (F.length("_t") - F.length(F.replace("_t", F.lit(","), F.lit("")))) / F.col("_n"),
        "comment_to_code_ratio": F.when(some & (code > 0), F.col("_n") / code).otherwise(0.0),
        "code_overlap": F.when(some & (F.size(prose) > 0), F.size(F.array_intersect(prose, other)) / F.size(prose)).otherwise(0.0),
    }
    return rows.select("seg_id", *(values[n].alias(n) for n in NAMES))


def vector(rows: DataFrame) -> DataFrame:
    return rows.select("seg_id", F.array(*NAMES).alias("vector"))


def null_score(rows: DataFrame) -> DataFrame:
    """The default classifier: no text is bloated (0.5 is the threshold)."""
    return rows.select("seg_id", F.lit(0.0).alias("score"), F.lit(False).alias("is_bloated"))


def weak_labels(segments: DataFrame, findings: DataFrame, bloated: int = 3) -> DataFrame:
    """Segments with many findings are taken as bloated, those without any as clean, others unlabelled."""
    counts = findings.groupBy("seg_id").agg(F.count("*").alias("n_findings"), F.countDistinct("rule_id").alias("n_rules"))
    n = F.coalesce("n_findings", F.lit(0))
    return segments.select("seg_id").join(counts, "seg_id", "left").select("seg_id", n.alias("n_findings"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.when(n >= bloated, 1).when(n == 0, 0).alias("label"))

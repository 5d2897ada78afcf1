"""Registered queries of the training-data operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitmask_langid, chunked_bpe, license_scan, line_quality, ngram_jaccard, poisson_mix, projection_dedup, semicrf_pii, subword_quality, tool_calls
from .common import documents


def _crc(mod: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def tokenizer_path() -> str:
    """Place of the vocabulary file, which is never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return tool_calls.link(calls, results, tool_calls.ASK)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link(documents(spark, sf_dir)).drop("set_key")


def op3_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = line_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.score(docs, model)


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op3 alone, which SQL can state."""
    scored = line_quality.score(documents(spark, sf_dir), line_quality.DEFAULT)
    return scored.select("doc_id", *line_quality.STATS, "base_failed")


def pii_base_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op7 alone, as their texts, which SQL can state."""
    docs = documents(spark, sf_dir).select(F.struct("doc_id", "text").alias("row"), "text")
    found = semicrf_pii.find(docs, id_col="row").select("row.doc_id", F.col("row.text").alias("text"), "base")
    shown = F.array_join(F.transform("base", lambda s: F.concat(s["kind"], F.lit(":"), F.substr("text", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "|")
    return found.select("doc_id", F.size("base").cast("long").alias("n_base"), shown.alias("found"))


QUALITY_BASE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) AS k, unnest(string_split(t, chr(10))) AS line FROM w),
again AS (SELECT doc_id FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1),
dup AS (SELECT doc_id, count(*) AS n FROM again GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
       coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)
"""
PII_BASE = r"""
WITH m AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS emails, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
         regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') AS cards, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS phones
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
good AS (
  SELECT doc_id, ['email:' || x for x in emails] AS e,
         ['ip:' || x for x in ips if len([p for p in string_split(x, '.') if length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255]) = 0] AS i,
         ['card:' || c[1] for c in [[x, regexp_replace(x, '[^0-9]', '', 'g')] for x in cards] if length(c[2]) BETWEEN 16 AND 19
           AND list_sum([CASE WHEN (length(c[2]) - k) % 2 = 0 THEN c[2][k]::INTEGER WHEN c[2][k]::INTEGER > 4 THEN 2 * c[2][k]::INTEGER - 9 ELSE 2 * c[2][k]::INTEGER END for k in range(1, length(c[2]) + 1)]) % 10 = 0] AS c,
         ['phone:' || x for x in phones if length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15] AS p
  FROM m)
SELECT doc_id, (len(e) + len(i) + len(c) + len(p))::BIGINT AS n_base, array_to_string(list_concat(list_concat(e, i), list_concat(c, p)), '|') AS found FROM good
"""


def op4_chunked_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe_digests(chunked_bpe.encode(documents(spark, sf_dir), path or tokenizer_path()))


def bpe_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.mix(documents(spark, sf_dir))


def op6_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = subword_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _crc(4) != 2)
    scored = subword_quality.score(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(_crc(4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= subword_quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op7_semicrf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semicrf_pii.find(documents(spark, sf_dir))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in semicrf_pii.BASE]
    return found.select("doc_id", *counts, F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"), shown(F.concat("base", "added")).alias("spans"))


def op8_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = bitmask_langid.fit(docs, _crc(5) != 0)
    return bitmask_langid.predict(docs, model).select("doc_id", F.coalesce(_crc(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_calls": op1_tool_calls,
    "op4_chunked_bpe": op4_chunked_bpe,
    "op5_poisson_mix": op5_poisson_mix,
    "op7_semicrf_pii": op7_semicrf_pii,
    "op9_projection_dedup": op9_projection_dedup,
    "op10_license_scan": op10_license_scan,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_line_crf": op3_line_crf,
    "op6_subword_quality": op6_subword_quality,
    "op8_bitmask_langid": op8_bitmask_langid,
    "quality_base_counts": quality_base_counts,
    "pii_base_matches": pii_base_matches,
}
ORACLES: dict[str, str] = {
    "op1_tool_calls": tool_calls.ORACLE,
    "op2_ngram_jaccard": ngram_jaccard.ORACLE,
    "op5_poisson_mix": poisson_mix.ORACLE,
    "op10_license_scan": license_scan.oracle(),
    "quality_base_counts": QUALITY_BASE,
    "pii_base_matches": PII_BASE,
}

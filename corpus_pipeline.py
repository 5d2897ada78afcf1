"""The corpus pipeline: quality rules, Jaccard join, personal data, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. ``run`` writes each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import chunked_bpe, line_quality, ngram_jaccard, poisson_mix, queries, semicrf_pii
from quillspark.llm.common import bitmap, documents, dropped, in_bitmap, stored, trimmed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the base rules and the line labels keep.

    Null, empty and short texts go; repeated rows share their fate; any text length is read whole; columns
    beside those of documents are dropped; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    model = line_quality.fit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.keep(docs, model)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked rows: that with the least id, then the least hash of its text.
    Rows without a shingle are linked with nothing and stay; an empty table stays empty. Of rows equal in id and text one stays,
    the least in its other columns."""
    key = [F.col("doc_id").alias("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")]
    docs = docs.select(*COLUMNS)
    groups = stored(ngram_jaccard.link(docs.select(F.struct(*key).alias("id"), "text"), id_col="id").where("set_key is not null").select("id", "component_id"), "groups")
    lost = groups.where("id != component_id").select("id.*").distinct()
    twice = groups.where("id = component_id").groupBy("id").count().where("count > 1").select("id.*")
    touched = stored(lost.withColumn("keep", F.lit(False)).unionByName(twice.withColumn("keep", F.lit(True))), "touched")
    # rows that a bitmap of bounded size rules out need no join and no shuffle
    bits = spark.sparkContext.broadcast(bitmap(touched, "h"))

    def rows(flag: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(bits.value, np.asarray(batch.column(len(COLUMNS)))) == flag))

        hashed = docs.withColumn("h", key[1])
        return hashed.mapInArrow(trimmed(run), hashed.schema)

    near = rows(True).join(touched.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "keep"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    near = near.select(*COLUMNS, "h", "keep")
    single = near.where("keep").groupBy("doc_id", "h").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return rows(False).select(*COLUMNS).unionByName(near.where("keep is null").select(*COLUMNS)).unionByName(single)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by their kind, and bring ``n_chars`` up to date.

    Null and empty texts stay as they are; every row stays, repeated ones too; an empty table stays empty."""
    return semicrf_pii.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw each source to its target weight; copies are rows of their own.

    A null source is a source; null and empty texts are drawn at the rate of their source; rows of one id
    are drawn alike; an empty table stays empty."""
    return poisson_mix.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each drawn row.

    Null and empty texts have no token; a row out for each row in, also where ids repeat or are null; an
    empty table gives an empty result."""
    return queries.bpe_digests(chunked_bpe.encode(docs, queries.tokenizer_path()))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("personal data", personal_data),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]
ORACLE_SQL = None  # Viterbi, the perceptron's segments and BPE are beyond SQL; tests hold a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
            dropped(before)  # the last stage's input stays, as its rows are read when the result is
    return docs

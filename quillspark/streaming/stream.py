"""Stateless rules over a file stream (an extra; the rules need no state across segments)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..sources.extract import segments


def file_stream(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, source) of files as they arrive, one row a file."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def finding_stream(files: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    return scan.findings(segments(files), wanted)

"""A controlled vocabulary from the text of its pages, and rule 1.1 against any vocabulary.

An entry starts at the margin: an approved word in capitals, or a rejected one in small letters with
its first alternative; more alternatives follow on indented lines. The current entry is carried
forward by a window over one document's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.catalogue import PROSE

LEAST_APPROVED = 300  # a result with fewer approved words isn't the dictionary
_POS = "(?:pron|prep|conj|adj|adv|art|int|n|v)"
_ENTRY = rf"^(\s*)([A-Za-z][A-Za-z '/-]*?)\s*\(({_POS})\)(.*)$"
_NOISE = r"^(?:Category \d|Part \d|\d{4}-\d{2}-\d{2}|Word|Issue|Page|ASD)"


def parse(pages: DataFrame) -> DataFrame:
    """``pages``: document, page, text. One row per word: document, word, approved, parts (of speech),
    alternatives ("word (pos)", in order, none twice)."""
    lines = pages.select("document", "page", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    lines = lines.where(~tx.trim(F.col("raw")).rlike(_NOISE) & F.col("raw").rlike(_ENTRY))
    part = lambda k: F.regexp_extract("raw", _ENTRY, k)
    lines = lines.select("document", "page", "line", (part(1) != "").alias("inner"), F.trim(part(2)).alias("word"), part(3).alias("pos"), part(4).alias("rest")).where("length(word) >= 2")
    head = F.substring_index("word", " ", 1)
    loud = (head == F.upper(head)) & head.rlike("[A-Z]")
    kind = F.when(loud & ~F.col("inner"), "approved").when(loud, "alternative").when((F.col("word") == F.lower("word")) & ~F.col("inner"), "rejected")
    lines = lines.withColumn("kind", kind).where("kind is not null")
    order = Window.partitionBy("document").orderBy("page", "line")
    event = F.when(F.col("kind") == "approved", "").when(F.col("kind") == "rejected", F.lower("word"))
    lines = lines.withColumn("current", F.last(event, ignorenulls=True).over(order)).withColumn("at", F.row_number().over(order))
    first = rf"\b([A-Z][A-Z '/-]*?)\s*\(({_POS})\)"
    inline = F.when(F.col("rest").rlike(first), F.format_string("%s (%s)", F.lower(F.trim(F.regexp_extract("rest", first, 1))), F.regexp_extract("rest", first, 2)))
    offered = F.when(F.col("kind") == "alternative", F.format_string("%s (%s)", F.lower("word"), "pos")).otherwise(inline)
    good = lines.where("kind = 'approved'").groupBy("document", F.lower("word").alias("word")).agg(F.lit(True).alias("approved"), F.array_sort(F.collect_set("pos")).alias("parts"), F.array().cast("array<string>").alias("alternatives"))
    bad = lines.where("kind != 'approved' and current != ''").select("document", F.col("current").alias("word"), "at", "kind", "pos", offered.alias("offered"))
    listed = F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("at", "offered"))), lambda x: x["offered"]), lambda x: x.isNotNull()))
    parts = F.array(F.min_by("pos", F.when(F.col("kind") == "rejected", F.col("at"))))
    return good.unionByName(bad.groupBy("document", "word").agg(F.lit(False).alias("approved"), parts.alias("parts"), listed.alias("alternatives")))


def usable(words: DataFrame) -> bool:
    return words.where("approved").limit(LEAST_APPROVED).count() >= LEAST_APPROVED


def rejected_words(segments: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Rule 1.1 against ``vocabulary`` (word, alternatives): the first use of each rejected word in a
    segment: seg_id, word, start, suggestion."""
    token = r"[A-Za-z][A-Za-z'-]*"
    kinds = (*PROSE, "string", "commit")
    marked = tx.sub(f"translate(text, {tx.quoted(tx.OPEN + tx.CLOSE + tx.DOT)}, '   ')", token, f"{tx.OPEN}$0{tx.CLOSE}")
    from ..operators.scan import hits

    rows = segments.where(F.col("kind").isin(*kinds)).select("seg_id", F.explode(F.expr(hits(marked))).alias("h")).where(F.length("h.hit") >= 3)
    first = rows.groupBy("seg_id", F.lower("h.hit").alias("word")).agg(F.min("h.start").alias("start"))
    short = F.array_join(F.transform(F.slice("alternatives", 1, 3), lambda a: F.substring_index(a, " (", 1)), ", ")
    return first.join(vocabulary.where("size(alternatives) > 0").select("word", "alternatives"), "word").select("seg_id", "word", "start", F.concat(F.lit("Use "), short, F.lit(".")).alias("suggestion"))

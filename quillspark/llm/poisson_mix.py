"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the characters over its present share.
A row's count is the inverse of the Poisson distribution with that mean at a number in [0, 1) hashed
from the seed and the row's id; the row is exploded by its count and all copies are put in the order
of another hash. Counts depend on nothing but id, source and rates, so a lost task gives the same
rows again.

Cases: a null source is a source of its own; null and empty texts have length 0 and are drawn by the
rate of their source (1 if a source has no character); rows without an id share one number, so they
are kept or dropped together, as are repeated rows; a rate of 0 drops a source; texts of any length are
drawn whole; an empty table gives an empty result. Input columns named ``copy`` or ``shuffle_key`` give way to those added; any other
name may occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored

BROADCAST_SOURCES = 10_000  # rates of so many sources (about 1 kB each at low rates) may be broadcast
SALTS = 32
PLAIN = 700  # up to this rate exp(-rate) is a normal double and the distribution is summed from 0


def hashed(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 48 bits of an MD5."""
    text = F.concat_ws(":", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def rates(docs: DataFrame, shares: dict[str | None, float] | None = None, power: float = 0.5, text: str = "text", source: str = "source") -> DataFrame:
    """Mean repetitions by source over all rows: given target shares, or shares in proportion to the
    characters to a power. Sources that ``shares`` does not name get the rate 0."""
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("_chars"))
    if shares is not None:
        wanted = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in shares.items()], "_s string, _want double")
        sizes = sizes.join(wanted, F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "_chars", F.coalesce("_want", F.lit(0.0)).alias("_want"))
    else:
        sizes = sizes.withColumn("_want", F.sqrt(F.col("_chars").cast("double")) if power == 0.5 else F.pow(F.col("_chars").cast("double"), F.lit(power)))
    sizes = stored(sizes, "sizes")
    total = sizes.agg(F.sum("_chars"), F.sum("_want")).first()  # two numbers
    share = F.col("_want") / F.lit(float(total[1] or 0.0)) * F.lit(float(total[0] or 0)) / F.col("_chars")
    return sizes.select("_source", F.when(F.col("_chars") == 0, F.lit(1.0)).otherwise(share).alias("_rate"))


def least(rate: Column) -> Column:
    """A count that is certain: 0 up to PLAIN, else 12 standard deviations under the rate (less is
    drawn with a probability under 1e-30, and the hashed numbers are multiples of 2**-48)."""
    return F.when(rate <= PLAIN, F.lit(0)).otherwise(F.floor(rate - F.sqrt(rate) * 12)).cast("int")


def steps(rate: Column, lo: Column) -> Column:
    """The Poisson distribution function at ``lo``, ``lo`` + 1, ... far into its tail; ``lo`` as by ``least``."""
    reach = F.when(rate <= PLAIN, F.ceil(rate) * 2 + 40).otherwise(F.ceil(F.sqrt(rate) * 24))
    tail = F.sequence(lo + 1, (lo + reach).cast("int"))
    n = F.greatest(lo, F.lit(1)).cast("double")
    # exp(-rate) * rate**n / n! with Stirling's series, as the factors alone leave the range of doubles
    far = F.exp(n * F.log1p((rate - n) / n) - (rate - n) - F.log(n * (2 * math.pi)) / 2 - F.lit(1.0) / (n * 12) + F.lit(1.0) / (n * n * n * 360))
    first = F.when(rate <= PLAIN, F.exp(-rate)).otherwise(far)
    walk = F.aggregate(
        tail,
        F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all")),
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"), (s["c"] + s["p"] * rate / k).alias("c"), F.concat(s["all"], F.array(s["c"] + s["p"] * rate / k)).alias("all")),
    )
    return walk["all"]


def mix(docs: DataFrame, seed: str = "mix-1", shares: dict[str | None, float] | None = None, power: float = 0.5, text: str = "text", source: str = "source", id_col: str = "doc_id", shuffle: bool = True) -> DataFrame:
    """All columns of the drawn rows, with ``copy`` (from 0) and ``shuffle_key``; globally ordered by
    ``shuffle_key`` across partitions if ``shuffle``."""
    by_source = rates(docs, shares, power, text, source)
    by_source = by_source.withColumn("_sure", least(F.col("_rate")))
    by_source = by_source.select("_source", "_sure", steps(F.col("_rate"), F.col("_sure")).alias("_steps"))
    by_source = stored(by_source, "rates")
    rows = docs.select(F.struct("*").alias("_row"))  # so that no column name can clash
    kept = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    own, ident = F.col("_row").getField(source), F.col("_row").getField(id_col)
    if by_source.count() <= BROADCAST_SOURCES:
        drawn = rows.join(F.broadcast(by_source), own.eqNullSafe(F.col("_source")))
    else:  # salted, as a source may hold a large share of the rows
        by_source = by_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_at", F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int"))
        drawn = rows.join(by_source, F.col("_row").getField(source).eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_salt")))
    u = hashed(seed, ident)
    count = F.col("_sure") + F.size(F.filter("_steps", lambda c: c <= u))
    out = drawn.withColumn("_n", count).where("_n > 0").select("_row", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy"))
    out = out.select(*(F.col("_row").getField(c).alias(c) for c in kept), "copy", hashed(seed + ":order", ident, F.col("copy")).alias("shuffle_key"))
    if not shuffle:
        return out
    # keys are even on [0, 1), so equal ranges need no sample of the rows
    n = partitions(docs.sparkSession)
    return out.repartitionById(n, F.least(F.floor(F.col("shuffle_key") * n), F.lit(n - 1)).cast("int")).sortWithinPartitions("shuffle_key")


ORACLE = """
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS chars FROM documents GROUP BY source),
totals AS (SELECT sum(chars) AS chars, sum(sqrt(chars)) AS want FROM sizes),
rates AS (
  SELECT s.source, CASE WHEN s.chars = 0 THEN 1.0::DOUBLE ELSE sqrt(s.chars) / t.want * t.chars::DOUBLE / s.chars END AS rate
  FROM sizes s, totals t),
tail AS (
  SELECT source, rate, list_reduce(list_prepend(
      {'k': 0, 'p': exp(-rate), 'c': exp(-rate), 'all': [exp(-rate)]},
      [{'k': i::INTEGER, 'p': 0.0::DOUBLE, 'c': 0.0::DOUBLE, 'all': [0.0::DOUBLE]} for i in range(1, 2 * ceil(rate)::INTEGER + 41)]),
    lambda s, x: {'k': x.k, 'p': s.p * rate / x.k, 'c': s.c + s.p * rate / x.k, 'all': list_append(s."all", s.c + s.p * rate / x.k)})."all" AS steps
  FROM rates),
hashed AS (SELECT *, ('0x' || substr(md5('mix-1:' || doc_id), 1, 12))::BIGINT::DOUBLE / 281474976710656 AS u FROM documents),
drawn AS (
  SELECT d.*, len(list_filter(t.steps, lambda c: c <= d.u)) AS n
  FROM hashed d JOIN tail t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(n))::INTEGER AS copy FROM drawn)
SELECT *, ('0x' || substr(md5('mix-1:order:' || doc_id || ':' || copy), 1, 12))::BIGINT::DOUBLE / 281474976710656 AS shuffle_key FROM copies
"""

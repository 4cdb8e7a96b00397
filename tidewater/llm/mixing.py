"""Mixing sources to target weights by Poisson replication (native: DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table

#: Rates of so many sources are sent to every executor; more than that are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: A larger rate is drawn as the sum of several Poisson numbers, so that no distribution table is long or underflows.
LARGEST_RATE = 500.0
COPIES_AT_ONCE = 1000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the seed and the parts; a null part counts as the text ``\\N``."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array, long enough that what is left is below 2**-52."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(
        F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"), rate.alias("rate")
    )
    return F.aggregate(
        F.sequence(F.lit(1), last),
        start,
        lambda a, k: F.struct(
            (a["p"] * a["rate"] / k).alias("p"),
            (a["c"] + a["p"] * a["rate"] / k).alias("c"),
            F.concat(a["all"], F.array(a["c"] + a["p"] * a["rate"] / k)).alias("all"),
            a["rate"].alias("rate"),
        ),
        lambda a: a["all"],
    )


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None, total: float | None, source_col: str = "source") -> DataFrame:
    """Mean repetitions a document of each source: target weight x target total / documents of the source.

    ``weights``: by source; sources without one get none of the mixture. None: all sources weigh the same.
    ``total``: expected number of documents drawn; None: as many as there are in all.
    Columns: source, n, rate. A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        if any(not math.isfinite(w) or w < 0 for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        known = F.lit(0.0)
        for s, w in weights.items():
            known = F.when(F.col("source").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(known)
        sizes = sizes.withColumn("weight", known)
    whole = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("n").alias("all_n"))
    target = F.lit(float(total)) if total is not None else F.col("all_n").cast("double")
    # one row against the few sources
    return sizes.join(F.broadcast(whole)).select(
        "source", "n", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * target / F.col("n")).otherwise(0.0).alias("rate")
    )


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    total: float | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """Draw each document a Poisson number of times so that sources come out in target proportion, in global random order.

    The count of a document is the Poisson quantile of a number hashed from seed and id, at its source's rate;
    no random state, so a recomputed task draws the same. Each drawn copy gets a hashed position and the rows are
    range-partitioned by it. Output: the kept columns (all of them by default), ``mix_copies``, ``mix_copy`` (from 0) and
    ``mix_position`` in [0, 1); input columns of these three names are replaced.

    Null source: a source like any other. Null id: hashed as such, so all documents without id are drawn equally often.
    Repeated rows: drawn equally often, since they have one id. Empty table: empty result.
    A hot source is no problem: rates come from pre-aggregated counts and are looked up map-side.
    """
    spark = docs.sparkSession
    docs = docs.drop("mix_copies", "mix_copy", "mix_position")
    keep = [c for c in (keep or docs.columns) if c in docs.columns]
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_RATE)).cast("int")
    by_source = rates(docs, weights, total, source_col).select(
        F.col("source").alias("_mix_source"), parts.alias("_mix_parts"), poisson_cdf(F.col("rate") / parts).alias("_mix_cdf")
    )
    few = by_source.limit(BROADCAST_SOURCES + 1).collect()
    cond = F.col(source_col).eqNullSafe(F.col("_mix_source"))
    if len(few) <= BROADCAST_SOURCES:
        lookup = spark.createDataFrame(few, by_source.schema)
        joined = docs.join(F.broadcast(lookup), cond)
    else:
        joined = docs.join(by_source, cond)
    below = lambda u: F.size(F.filter("_mix_cdf", lambda c: c <= u))
    many = F.aggregate(F.sequence(F.lit(1), F.col("_mix_parts")), F.lit(0), lambda n, k: n + below(uniform(seed, F.col(id_col), k)))
    counted = joined.withColumn("_mix_u", uniform(seed, F.col(id_col))).withColumn(
        "mix_copies", F.when(F.col("_mix_parts") == 1, below(F.col("_mix_u"))).otherwise(many)
    )
    drawn = (
        counted.where("mix_copies > 0")
        .withColumn("_mix_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("mix_copies") - 1) / COPIES_AT_ONCE).cast("int"))))
        .withColumn("mix_copy", F.explode(F.sequence(F.col("_mix_part") * COPIES_AT_ONCE, F.least("mix_copies", (F.col("_mix_part") + 1) * COPIES_AT_ONCE) - 1)))
        .withColumn("mix_position", uniform(seed + 1, F.col(id_col), F.col("mix_copy")))
    )
    return drawn.select(*keep, "mix_copies", "mix_copy", "mix_position").orderBy("mix_position")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM sizes) * (SELECT sum(n)::DOUBLE FROM sizes) / n AS rate FROM sizes
),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms
  WHERE k < ceil(rate + 10 * sqrt(rate) + 20)
),
cdfs AS (SELECT source, list(c ORDER BY k) AS cdf FROM terms GROUP BY source),
counted AS (
  SELECT d.*, CAST(len(list_filter(cdf, lambda x: x <=
      CAST('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '\\N')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0)) AS INTEGER) AS mix_copies
  FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source
),
drawn AS (SELECT *, CAST(unnest(range(mix_copies)) AS INTEGER) AS mix_copy FROM counted WHERE mix_copies > 0)
SELECT doc_id, text, lang, source, n_chars, mix_copies, mix_copy,
  CAST('0x' || substr(md5('18|' || coalesce(doc_id::VARCHAR, '\\N') || '|' || mix_copy::VARCHAR), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS mix_position
FROM drawn
"""

"""Mixing sources to target weights by capped water-filling.

Every source has a weight and shares a budget of words. No source may be taken
more than ``max_epochs`` times: its target is clamped there, and the excess goes
to the others in proportion to their weights until no target is above its clamp.
A target is then met by whole repetitions of all rows of the source plus one more
repetition of a seeded part of them, taken in the order of a hash of the row.

The part is exact to about one document without ordering a whole source in one
task: sizes are summed by (source, hash prefix), a running sum over those few
sums finds the prefix in which the part ends, and only rows of that prefix are
ordered among themselves. The prefix is long enough for about ``BUCKET`` rows of
the whole table, so what one task orders does not grow with the input.

Null sources are a source of their own, the last. Null or empty texts have size
0 and are repeated like other rows. The hash is over id and text, so rows with one
id, or none, are spread like others; equal rows share a hash and stay next to one
another. An empty table gives an empty mix. A column named mix is replaced. The
water level is found over one row a source, in one task: sources are meant to be
thousands, not as many as documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.words import n_pieces, pieces
from docengine.shared import broadcast_if, materialize

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows that share a hash prefix, about.
BUCKET = 1024


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``; one row per source.

    Weights go to the sources by code point, null last, again and again. The windows
    run over one row per source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") - 1) % len(weights) + 1)
    by_ratio = Window.orderBy("ratio", "n")
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.col("budget") - F.coalesce(F.sum("clamp").over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    return (
        sizes.withColumn("n", F.row_number().over(named))
        .withColumn("weight", weight)
        .withColumn("clamp", F.col("source_size") * F.lit(max_epochs))
        .withColumn("ratio", F.col("clamp") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("level", level)
        # the water level is that of the first source, by rising clamp per weight, which lies above it
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "n", "level"))).over(every)["level"])
        .withColumn("target", F.coalesce(F.least("clamp", F.col("weight") * F.col("level")), F.col("clamp")))
        .select("source", "source_size", "target")
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 0,
    weights=WEIGHTS,
    share: float = 1.5,
    max_epochs: float = 2.0,
    prefix: int | None = None,
    max_broadcast_sources: int = 100_000,
) -> DataFrame:
    """``docs`` with a struct ``mix``: size, source_size, target, times (repetitions of the row).

    ``prefix`` hex digits of the hash are the buckets of a source (by default enough for buckets of
    ``BUCKET`` rows): about ``16 ** -prefix`` of its rows meet in one task. Thresholds, one row per source, are broadcast if there
    are ``max_broadcast_sources`` or fewer, else joined by a shuffle.
    """
    if prefix is None:
        prefix = max(2, math.ceil(math.log(max(docs.count(), 1) / BUCKET, 16)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), key.alias("u"), F.substring(key, 1, prefix).alias("bucket"))
    counted = lambda df: df.withColumn("cut", pieces(F.col(f"row.{text}"))).withColumn("size", n_pieces(F.col("cut"))).drop("cut")
    sums = materialize(counted(rows).groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")), "mix-sums")
    aims = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    aims = aims.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # the first bucket whose running sum passes what the extra repetition needs
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        sums.withColumn("upto", F.sum("size").over(run))
        .join(aims, sums["source"].eqNullSafe(aims["source"]))
        .drop(sums["source"])
        .groupBy("source", "source_size", "target", "whole", "need")
        .agg(F.min(F.when(F.col("upto") > F.col("need"), F.struct("bucket", F.col("upto") - F.col("size")))).alias("end"))
        .select("source", "source_size", "target", "whole", "need", F.col("end.bucket").alias("end"), F.col("end.col2").alias("before"))
    )
    ends = broadcast_if(materialize(ends, "mix-ends"), max_broadcast_sources).withColumnRenamed("source", "of")
    known = rows.join(ends, rows["source"].eqNullSafe(ends["of"]))
    here = F.coalesce(F.col("bucket") == F.col("end"), F.lit(False))
    sure = counted(known.where(~here)).withColumn("more", F.coalesce(F.col("bucket") < F.col("end"), F.lit(True)) & (F.col("need") > 0))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("u", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a row is in if its middle is below the need
    last = counted(known.where(here)).withColumn("upto", upto).withColumn("more", (F.col("need") > 0) & (2 * (F.col("before") + F.col("upto")) - F.col("size") <= 2 * F.col("need"))).drop("upto")
    times: Column = F.col("whole") + F.col("more").cast("int")
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c != "mix"]
    return sure.unionByName(last).select(*rest, F.struct("size", "source_size", "target", times.alias("times")).alias("mix"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of the mix themselves: each row of ``mix`` as often as it is taken, without the struct."""
    return mixed.where("mix.times > 0").withColumn("mix", F.explode(F.sequence(F.lit(1), F.col("mix.times")))).drop("mix")


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.times")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat_ws('|', '0', doc_id::VARCHAR, md5(coalesce(text, '')))) AS u,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 2.0::DOUBLE AS clamp FROM s
), r AS (
  SELECT *, clamp / weight AS ratio FROM w
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
             - coalesce(sum(clamp) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / ((SELECT sum(weight) FROM w)
             - coalesce(sum(weight) OVER (ORDER BY ratio, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r
), t AS (
  SELECT source, source_size,
         coalesce(least(clamp, weight * (SELECT arg_min(level, (ratio, n)) FROM l WHERE ratio > level)), clamp) AS target
  FROM l
), a AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t
), x AS (
  SELECT d.doc_id, d.size, a.source_size, a.target, a.whole, a.target - a.whole * a.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN a ON d.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN need > 0 AND 2 * upto - size <= 2 * need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""

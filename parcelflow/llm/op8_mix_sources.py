"""Mixing sources to target weights, with DataFrame operations alone.

Every document gets a hash-random key. Each source's documents are ranged by that key; sums of the ranges give each
range's start, a window inside a range gives each document's start, and a source's budget cuts that running sum. A
source whose target exceeds its size is taken whole as often as needed first.

Weights follow the sources in code-point order, null last, repeating. Their targets share ``share`` times all sizes by
weight; a target stops at ``most`` times its source's size and the excess goes to the others by weight until none is
above, which is the level L at which the sum of min(weight * L, most * size) is the total.

Defined results: a null text has size 0 and takes 0; a null source is a source; rows without a doc_id hash by their text; repeated
rows are separate documents; an empty table gives no rows; other columns play no part. Targets are real numbers, the
words taken of a source are the target's whole part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPLIT_OF_TEXT, documents, staged, unused

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
ROWS_A_RANGE = 20_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(SPLIT_OF_TEXT)), F.lit(0)).cast("long")


def random_key(doc_id, text):
    """A hash of the id, or of the text where there is none, so that rows without an id don't share one range."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), F.coalesce(text, F.lit("")))).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text")).alias("key"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row a source: source, source_size, target. The table has as many rows as there are sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(everything))
    return per.select("source", "source_size", F.coalesce(F.least(F.col("weight") * F.col("level"), F.col("cap")), F.col("cap")).alias("target"))


def mix(sizes: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``sizes`` (doc_id, source, size, key; a staged table) with source_size, target and taken."""
    plan = targets(sizes)
    digits = min(5, max(2, math.ceil(math.log(max(1, sizes.count() / rows_a_range), 16))))
    ranged = sizes.withColumn("range", F.substring("key", 1, digits))
    starts = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("range_start", F.coalesce(F.sum("words").over(upto), F.lit(0))).drop("words")
    starts = _by_source(starts, plan)
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    a, b = placed.alias("a"), starts.alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.range") == F.col("b.range")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = budget - F.col("epochs") * F.col("source_size") - (F.col("range_start") + F.col("at"))
    return joined.select("a.doc_id", "a.source", "a.key", "a.size", "source_size", "target", "range_start", "at").withColumn("epochs", epochs).withColumn(
        "taken", (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(left, F.col("size")))).cast("long"),
    )


def _by_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    a, b = rows.alias("a"), plan.alias("b")
    return a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.source_size", "b.target")


def take(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a document is repeated once for each begun pass over it, and left out if none is.

    Only the last document of a source's budget is taken in part by the words; it stays whole here, so a source
    exceeds its target by less than one document. The cut is found on the small table and joined by source, so texts
    are not shuffled while the cuts are few enough to broadcast.
    """
    mixed = staged(mix(staged(sized(docs))))
    order = F.struct("key", "doc_id", "size")
    cuts = mixed.groupBy("source").agg(F.first("epochs").alias("__epochs"), F.max(F.when(F.col("taken") > F.col("epochs") * F.col("size"), order)).alias("__cut"))
    of, epochs, cut, size, times = (unused(docs, name) for name in ("source_of_cut", "epochs", "cut", "words", "times"))
    cuts = staged(cuts.withColumnsRenamed({"source": of, "__epochs": epochs, "__cut": cut}))
    rows = docs.withColumn(size, word_count(F.col("text"))).join(cuts, F.col("source").eqNullSafe(F.col(of)))
    place = F.struct(random_key(F.col("doc_id"), F.col("text")).alias("key"), F.col("doc_id"), F.col(size).alias("size"))
    begun = F.when(F.col(size) > 0, F.col(epochs) + F.coalesce((place <= F.col(cut)).cast("long"), F.lit(0))).otherwise(0)
    rows = rows.withColumn(times, begun).where(F.col(times) > 0)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long"))).alias(unused(docs, "copy"))).select(*docs.columns)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = staged(sized(documents(spark, sf_dir)))
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '-' || coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
             CAST(source_size AS DOUBLE) * 2 AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5
              - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(weight * (SELECT max(lev) FROM l WHERE lev <= cap / weight), cap) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS epochs
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(floor(target) - epochs * source_size - before, size)) AS BIGINT) AS taken
FROM p
"""

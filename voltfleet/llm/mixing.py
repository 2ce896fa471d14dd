"""Mix sources to target weights: how many words of each document a mix takes.

Each document gets a key that only its id decides. Within a source documents stand in key order; a prefix sum of sizes says
which ones lie before the source's budget. The sum is taken in two steps, over the 4096 key ranges of a source and within a
range, so no source is ever in one task. A budget beyond the source's size is met by whole epochs plus a rest; the document
on the edge of the rest gives only its first words.

Sources are ranked by code point, null last; targets stop at ``most`` epochs, and what a full source leaves is shared again
by weight. A null or empty text has size 0 and gives nothing; a null id counts as the text ``null``. Equal rows are
interchangeable. An empty table gives an empty mix; if all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltfleet.llm import common

WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of all documents, and the most epochs of one source.
SHARE, MOST = 1.5, 2
#: Hexadecimal digits of a key that make a range: 16**3 ranges a source.
DIGITS = 3


def sizes(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.regexp_count(common.text_or_empty(), F.lit(common.WORD)).cast("long"))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per source: its size and its target. One row per source; the windows here run over these rows alone."""
    totals = sized.groupBy(F.col("source").alias("mix_source")).agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank - 1) % len(weights) + 1)
    ranked = totals.select("*", weight.alias("w"), (F.lit(most) * F.col("source_size")).cast("double").alias("cap"))
    by_room = Window.orderBy(F.col("cap") / F.col("w"), F.col("mix_source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everything) - before) / left)
    # Up to here full sources come first; the first one with room sets the level of all that follow.
    full = F.col("cap") / F.col("w") <= F.col("level")
    shared = level.withColumn("full", full).withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    return shared.select("mix_source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def mix(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Add source_size, target and taken to documents with a ``size``; other columns stay, except for ones of these names."""
    docs = sized.drop("source_size", "target", "taken").withColumn(
        "mix_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    )
    docs = docs.withColumn("mix_range", F.substring("mix_key", 1, DIGITS))
    ranges = docs.groupBy(F.col("source").alias("range_source"), F.col("mix_range").alias("range")).agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("range_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range_source", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("mix_before"))
    ranges = ranges.join(goals, F.col("range_source").eqNullSafe(F.col("mix_source"))).drop("mix_source")
    within = Window.partitionBy("source", "mix_range").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("mix_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(ranges, F.col("source").eqNullSafe(F.col("range_source")) & (F.col("mix_range") == F.col("range")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("mix_before") - F.col("mix_within")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.withColumn("taken", taken.cast("long")).drop("mix_key", "mix_range", "mix_within", "range_source", "range", "mix_before")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix themselves: a row per epoch, the one on the edge of its source's budget cut after its last word."""
    columns = docs.columns
    base = sizes(docs.drop("size"))
    taken = mix(base, targets(base))
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - full * F.col("size")).cast("int")
    words = F.regexp_extract_all("text", F.lit(common.WORD), 0)
    part = F.when(rest > 0, F.array(F.array_join(F.slice(words, 1, F.greatest(rest, F.lit(0))), " "))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat("text", full), part)
    return taken.withColumn("text", F.explode(texts)).select(columns)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    sized = common.written(sizes(docs).select("doc_id", "source", "size"), "sizes")
    return mix(sized, targets(sized)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{common.WORD}')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w,
         CAST(2 * source_size AS DOUBLE) AS cap FROM totals),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
goals AS (
  SELECT source, source_size, CASE WHEN cap / w <= level THEN cap
      ELSE w * max(CASE WHEN cap / w > level THEN level END) OVER () END AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.doc_id, d.size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM cut
"""

"""As-of, nearest and reference joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltfleet.operators import series

_SIDE, _TIE = "_side", "_tie"


def _swept(left: DataFrame, right: DataFrame, keys, time: str, tie: str, values: Sequence[str], max_rows):
    """Both sides in one series per key. At equal times the right side comes first."""
    facts = right.select(
        *keys, time, F.lit(0).alias(_SIDE), F.lit(0).cast("long").alias(_TIE), F.struct(time, *values).alias("_hit")
    )
    rows = left.withColumn(_SIDE, F.lit(1)).withColumn(_TIE, F.col(tie).cast("long"))
    both = rows.unionByName(facts, allowMissingColumns=True)
    return series.lay_out(both, keys, [time, _SIDE, _TIE], max_rows)


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, tie: str, values: Sequence[str], max_rows=None
) -> DataFrame:
    """Each left row with the last right row at or before it (null if none).

    ``tie`` numbers the left rows; ``(keys, time)`` is unique on the right.
    One sweep over the union: no range condition, no pairs.
    """
    s = _swept(left, right, keys, time, tie, values, max_rows)
    s = series.forward_fill(s, {"_back": "_hit"})
    return s.rows().filter(F.col(_SIDE) == 1).select(*left.columns, *[F.col(f"_back.{v}").alias(v) for v in values])


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, tie: str, values: Sequence[str], max_rows=None
) -> DataFrame:
    """Each left row with the right row nearest in time; of two equally near ones, the later."""
    s = _swept(left, right, keys, time, tie, values, max_rows)
    s = series.backward_fill(series.forward_fill(s, {"_back": "_hit"}), {"_ahead": "_hit"})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ahead_gap = micros(f"_ahead.{time}") - micros(time)
    back_gap = micros(time) - micros(f"_back.{time}")
    take_ahead = F.col("_back").isNull() | (ahead_gap <= back_gap)
    hit = F.when(F.col("_ahead").isNotNull() & take_ahead, F.col("_ahead")).otherwise(F.col("_back"))
    chosen = s.rows().filter(F.col(_SIDE) == 1).withColumn("_hit", hit)
    return chosen.select(
        *left.columns, F.col(f"_hit.{time}").alias(f"matched_{time}"), *[F.col(f"_hit.{v}").alias(v) for v in values]
    )


def known_only(rows: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(dimension.select(*keys), list(keys), "left_semi")


def unknown_only(rows: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(dimension.select(*keys), list(keys), "left_anti")

"""Lags, fills, rolling means and recurrences over series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.operators import scans, series
from voltfleet.operators.series import Series

ROLL = 4


def lag_features(s: Series, columns: Sequence[str], lags: Sequence[int] = (1, 2), roll: int = ROLL) -> Series:
    """Row lags and the mean of the ``roll`` rows before, for columns without nulls.

    The rows at the head of a series, which have no such past, take the first
    value that a later row has; a series too short to have one takes 0.
    """
    s = series.with_key_rows(s, "_n")

    def add(df: DataFrame, w) -> DataFrame:
        new: dict[str, Column] = {}
        for c in columns:
            head = F.first(c).over(w)
            for k in lags:
                new[f"{c}_lag_{k}h"] = F.coalesce(F.lag(c, k).over(w), F.when(F.col("_n") > k, head), F.lit(0.0))
            past = F.avg(c).over(w.rowsBetween(-roll, -1))
            new[f"{c}_roll_{roll}h"] = F.coalesce(past, F.when(F.col("_n") > 1, head), F.lit(0.0))
        return df.withColumns(new).drop("_n")

    return series.windowed(s, max(roll, *lags), add)


def fill_chain(s: Series, columns: Sequence[str]) -> Series:
    """Forward fill, then the first value of the series for the leading gap, then 0."""
    s = series.forward_fill(s, {f"_f_{c}": c for c in columns})
    s = series.first_values(s, {f"_b_{c}": c for c in columns})
    df = s.df.withColumns({c: F.coalesce(f"_f_{c}", f"_b_{c}", F.lit(0.0)) for c in columns})
    return s.on(df.drop(*[f"_{d}_{c}" for c in columns for d in "fb"]))


def smoothed(s: Series, column: str, out: str, keep: float = 0.95, start: float = 1.0) -> Series:
    """``v = keep * v + (1 - keep) * x`` from ``start``, as windowed sums.

    Inside a block of rows the recurrence is a weighted running sum. A block is
    long enough that what lies two blocks back weighs less than one part in
    10^16, so two blocks of past rows give the value to full precision. A chunk
    of a long series begins from what the chunks before it come to, each folded
    to a factor and a sum.
    """
    block = math.ceil(math.log(1e-9) / math.log(keep))
    df = s.df.withColumn("_begin", F.lit(float(start)))
    if s.split:
        step = {"_factor": F.lit(keep), "_add": F.coalesce((1 - keep) * F.col(column), F.lit(0.0))}
        before = scans.chunk_starts(s, scans.AFFINE, step, start, "_before")
        df = s.df.join(before, s.group, "left").withColumn("_begin", F.coalesce("_before", F.lit(float(start)))).drop("_before")
    w = s.window()
    df = df.withColumn("_i", F.row_number().over(w) - 1).withColumns(
        {"_b": F.floor(F.col("_i") / block), "_j": (F.col("_i") % block + 1).cast("double")}
    )
    within = Window.partitionBy(*s.group, "_b").orderBy(*s.order).rowsBetween(Window.unboundedPreceding, 0)
    grown = F.sum(F.col(column) * F.pow(F.lit(keep), -F.col("_j"))).over(within)
    df = df.withColumn("_own", (1 - keep) * F.coalesce(grown, F.lit(0.0)) * F.pow(F.lit(keep), F.col("_j")))
    ends = F.col("_j") == block
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    faded = F.pow(F.lit(keep), F.lit(float(block)))
    for name, value in (("_e1", F.col("_own")), ("_e2", F.col("_own") + faded * F.coalesce("_e1", "_begin"))):
        df = df.withColumn(name, F.last(F.when(ends, value), ignorenulls=True).over(before))
    at_block_start = F.coalesce("_e2", "_begin")
    df = df.withColumn(out, F.col("_own") + F.pow(F.lit(keep), F.col("_j")) * at_block_start)
    return s.on(df.drop("_i", "_b", "_j", "_own", "_e1", "_e2", "_begin"))


def cycle_count(s: Series, energy: str, out: str, capacity: float = S.BATTERY_KWH) -> Series:
    """Equivalent full cycles so far: throughput over twice the capacity."""
    s = s.on(s.df.withColumn("_cycles", F.abs(energy) / (2.0 * capacity)))
    s = series.running_sum(s, {out: "_cycles"})
    return s.on(s.df.drop("_cycles"))


def energy_delta(power: Column, hours: float = 1.0) -> Column:
    """Change of the stored energy for a signed power request (positive charges), rate limits applied."""
    limited = F.least(F.abs(power), F.lit(S.BATTERY_KW)) * hours
    return F.when(power > 0, limited * S.BATTERY_EFF).otherwise(-limited / S.BATTERY_EFF)


def storage_level(
    s: Series,
    delta: str,
    out: str,
    start: float = S.BATTERY_KWH / 2,
    low: float = S.BATTERY_MIN_FRACTION * S.BATTERY_KWH,
    high: float = S.BATTERY_MAX_FRACTION * S.BATTERY_KWH,
) -> Series:
    """Running sum held within ``[low, high]`` at every step.

    Adding and clamping composes to ``min(b, max(a, x + sum))``, so three numbers describe a stretch of any length, a chunk of
    a long series too. A missing delta leaves the level as it is.
    """
    columns = {"_delta": F.coalesce(delta, F.lit(0.0)), "_low": F.lit(low), "_high": F.lit(high)}
    return scans.walk(s, scans.CLAMP, columns, start, out)


def chrono_split(s: Series, out: str = "part", share: float = 0.8, minimum: int = 1) -> Series:
    """Mark the first ``share`` of each series "train", the rest "test"; "both" when no test row would be left."""
    s = series.row_numbers(series.with_key_rows(s, "_n"), "_i")
    cut = F.floor(F.col("_n") * share)
    part = F.when(cut >= F.col("_n"), "both").when(F.col("_i") <= cut, "train").otherwise("test")
    return s.on(s.df.filter(F.col("_n") >= minimum).withColumn(out, part).drop("_i", "_n"))

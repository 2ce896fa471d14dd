"""Groupwise picks, counts, pivots, totals and scores. All combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.functions.flows import savings_pct
from voltfleet.functions.timeparts import is_weekend


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], chooser) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
    return packed.select(*keys, "_row.*")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``. Deterministic, unlike ``dropDuplicates``."""
    return _pick(df, keys, order, F.min_by)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``."""
    return _pick(df, keys, order, F.max_by)


def recent(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows per key; map tasks drop the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def most_recent(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of all, newest first; ``n`` from 1 to 1000."""
    if not 1 <= n <= 1000:
        raise ValueError("n must be between 1 and 1000")
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def history_size(telemetry: DataFrame, keys: Sequence[str], days: int = 7) -> DataFrame:
    rows = F.count_if(F.col("asset_id") == S.CAMPUS_ASSET)
    return telemetry.groupBy(*keys).agg(rows.alias("history_rows"), (rows >= days * 24).alias("sufficient"))


def pivot_targets(predictions: DataFrame, keys: Sequence[str], column="target_type", value="predicted_value"):
    """Long to wide; the target list is known, so no job is needed to find it."""
    return predictions.groupBy(*keys).pivot(column, list(S.TARGETS)).agg(F.first(value))


def campus_totals(loads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of building loads with apparent power and power factor (1 without load)."""
    p, q = F.sum("active_power_kw"), F.sum("reactive_power_kvar")
    apparent = F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    loaded = F.col("p") > 0
    return (
        loads.groupBy(*keys)
        .agg(p.alias("p"), q.alias("q"))
        .select(
            *keys,
            F.round("p", 3).alias("total_active_power_kw"),
            F.round("q", 3).alias("total_reactive_power_kvar"),
            F.round(F.when(loaded, apparent).otherwise(0.0), 3).alias("total_apparent_power_kva"),
            F.round(F.when(loaded, F.try_divide(F.col("p"), apparent)).otherwise(1.0), 3).alias(
                "aggregate_power_factor"
            ),
        )
    )


def load_profile(loads: DataFrame) -> DataFrame:
    """Mean share of a building's peak by hour and day kind; the peak is that of the building at its site."""
    peaks = loads.groupBy("site_id", "building_id").agg(F.max("active_power_kw").alias("peak")).filter("peak > 0")
    share = F.col("active_power_kw") / F.col("peak")
    weekend = is_weekend(F.col("time")).cast("int").alias("is_weekend")
    kinds = loads.join(peaks, ["site_id", "building_id"]).groupBy("building_id", F.hour("time").alias("hour"), weekend)
    return kinds.agg(F.count(F.lit(1)).alias("readings"), F.round(F.avg(share), 6).alias("load_factor"))


def tariff_by_hour(prices: DataFrame) -> DataFrame:
    """Mean buy and sell price of each hour of the day at a site, and the buy price against the site's mean.

    Sums and counts by hour are made once; the site's mean comes from them.
    """
    hours = prices.groupBy("site_id", F.hour("time").alias("hour")).agg(
        F.count("buy_price_inr").alias("quotes"), F.sum("buy_price_inr").alias("_buy"), F.avg("sell_price_inr").alias("_sell")
    )
    site = Window.partitionBy("site_id")
    mean = F.sum("_buy").over(site) / F.sum("quotes").over(site)
    buy = F.col("_buy") / F.col("quotes")
    return hours.select(
        "site_id", "hour", "quotes", F.round(buy, 6).alias("buy_price_inr"), F.round("_sell", 6).alias("sell_price_inr"),
        F.round(buy / mean, 6).alias("multiplier"),
    )


def savings_summary(schedule: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = schedule.groupBy(*keys).agg(
        F.sum("baseline_cost_inr").alias("total_baseline_inr"), F.sum("optimized_cost_inr").alias("total_optimized_inr")
    )
    saved = F.col("total_baseline_inr") - F.col("total_optimized_inr")
    return totals.withColumn("savings_inr", saved).withColumn(
        "savings_pct", savings_pct(F.col("total_baseline_inr"), saved)
    )


def regression_metrics(scored: DataFrame, keys: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE and R2 (1 for a single row), in one pass."""
    error = F.col(actual) - F.col(predicted)
    rows = F.count(F.lit(1))
    spread = F.var_pop(actual) * rows
    squares = F.sum(error * error)
    # Without spread the score is 1 for a perfect fit and 0 otherwise.
    flat = F.when(squares == 0, 1.0).otherwise(0.0)
    r2 = F.when(rows <= 1, 1.0).when(spread == 0, flat).otherwise(1.0 - F.try_divide(squares, spread))
    return scored.groupBy(*keys).agg(
        rows.alias("test_samples"),
        F.round(F.avg(F.abs(error)), 4).alias("mae"),
        F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"),
        F.round(r2, 4).alias("r2_score"),
    )


def line_through_sums(df: DataFrame, keys: Sequence[str], x1: Column, x2: Column, y: Column) -> DataFrame:
    """Least squares ``y = b0 + b1 x1 + b2 x2`` per key, from centred sums that combine before the shuffle."""
    rows = df.select(*keys, x1.alias("x1"), x2.alias("x2"), y.alias("y"))
    n = F.count("y")
    moments = rows.groupBy(*keys).agg(
        n.alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in ("x1", "x2", "y")],
        *[(F.covar_pop(a, b) * n).alias(f"s_{a}_{b}")
          for a, b in (("x1", "x1"), ("x1", "x2"), ("x2", "x2"), ("x1", "y"), ("x2", "y"))],
    )
    c = F.col
    det = c("s_x1_x1") * c("s_x2_x2") - c("s_x1_x2") * c("s_x1_x2")
    b1 = F.try_divide(c("s_x1_y") * c("s_x2_x2") - c("s_x2_y") * c("s_x1_x2"), det)
    b2 = F.try_divide(c("s_x2_y") * c("s_x1_x1") - c("s_x1_y") * c("s_x1_x2"), det)
    return moments.select(
        *keys, "n", b1.alias("b1"), b2.alias("b2"), (c("m_y") - b1 * c("m_x1") - b2 * c("m_x2")).alias("b0")
    )

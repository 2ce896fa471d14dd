"""One row per site and time from prices, assets, topics and weather; model features on top."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltfleet.functions import physics
from voltfleet.functions.timeparts import cyclic
from voltfleet.operators import joins, ordered, series
from voltfleet.operators.aggregates import keep_first
from voltfleet.operators.series import Series

#: Aligned column: (asset, telemetry column).
ASSET_COLUMNS = {
    "solar_power_kw": ("solar_pv", "power_kw"),
    "wind_power_kw": ("wind_turbine", "power_kw"),
    "battery_power_kw": ("battery_bank", "power_kw"),
    "battery_voltage": ("battery_bank", "voltage"),
    "demand_power_kw": ("campus_aggregate", "power_kw"),
}
PRICE_COLUMNS = ("buy_price_inr", "sell_price_inr", "grid_frequency")
WEATHER_COLUMNS = ("temperature_c", "wind_speed_ms", "irradiance_wm2", "cloud_cover")
LAGGED = ("demand_power_kw", "solar_power_kw", "wind_power_kw", "buy_price_inr")

#: Aligned column: (topic, field).
TOPIC_COLUMNS = {
    "solar_power_kw": ("solar", "solar_power_kw"),
    "temperature_c": ("solar", "temperature_c"),
    "irradiance_wm2": ("solar", "irradiance_wm2"),
    "wind_power_kw": ("wind", "wind_power_kw"),
    "wind_speed_ms": ("wind", "wind_speed_ms"),
    "battery_power_kw": ("battery", "battery_power_kw"),
    "battery_voltage": ("battery", "battery_voltage"),
    "battery_soc_pct": ("battery", "battery_soc"),
    "demand_power_kw": ("meters", "demand_active_kw"),
    "buy_price_inr": ("market", "electricity_buy_price_inr"),
    "sell_price_inr": ("market", "electricity_sell_price_inr"),
    "grid_frequency": ("market", "grid_frequency_hz"),
}


def _first_where(condition: Column, value: str, order: Sequence[str]) -> Column:
    return F.min_by(value, F.when(condition, F.struct(*order)))


def pivot_assets(telemetry: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First reading per asset and time as columns: one pass, one shuffle, no joins between assets."""
    return telemetry.groupBy(*keys).agg(
        *[
            _first_where(F.col("asset_id") == asset, column, order).alias(name)
            for name, (asset, column) in ASSET_COLUMNS.items()
            if column in telemetry.columns
        ]
    )


def align(prices: DataFrame, telemetry: DataFrame, keys=("site_id", "time"), order=("seq",)) -> DataFrame:
    """Prices with the assets' readings at the same time; telemetry without a price is dropped."""
    first_prices = keep_first(prices, keys, order).select(*keys, *PRICE_COLUMNS)
    return first_prices.join(pivot_assets(telemetry, keys, order), list(keys), "left")


def align_topics(lake: DataFrame, keys=("site_id", "time"), order=("seq",)) -> DataFrame:
    """Topic records of the lake as one row per site and time: one shuffle in place of five outer joins."""
    return lake.groupBy(*keys).agg(
        *[
            _first_where((F.col("topic") == topic) & F.col(field).isNotNull(), field, order).alias(name)
            for name, (topic, field) in TOPIC_COLUMNS.items()
            if field in lake.columns
        ]
    )


def filled(aligned: DataFrame, keys=("site_id",), order=("time",), max_rows: int | None = None) -> Series:
    """Forward fill, back fill, then 0, over every measured column."""
    columns = [c for c in aligned.columns if c not in (*keys, *order)]
    return ordered.fill_chain(series.lay_out(aligned, keys, order, max_rows), columns)


def with_weather(rows: DataFrame, weather: DataFrame, keys=("site_id",), max_rows: int | None = None) -> DataFrame:
    """The weather of the hour each row lies in, else of the nearest hour."""
    left = rows.withColumn("_at", F.date_trunc("hour", "time")).withColumn("_tie", F.unix_micros("time"))
    left = left.withColumnRenamed("time", "_time").withColumnRenamed("_at", "time").withColumnRenamed("_tie", "_n")
    values = [c for c in weather.columns if c not in (*keys, "time")]
    joined = joins.nearest(left, weather, keys, "time", "_n", values, max_rows)
    return joined.drop("time", "_n", "matched_time").withColumnRenamed("_time", "time")


def features(s: Series) -> Series:
    """Cyclic time, physics, lag and rolling columns. Weather that is absent counts as 0.

    Works on the layout of the filled rows, so fills and lags share one shuffle.
    """
    frame, order = s.df, s.order
    for column in WEATHER_COLUMNS:
        value = F.col(column) if column in frame.columns else F.lit(None).cast("double")
        frame = frame.withColumn(column, F.coalesce(value, F.lit(0.0)))
    time = F.col(order[0])
    frame = frame.withColumns(cyclic(time)).withColumns(
        {
            "wind_speed_cubed": physics.cubed(F.col("wind_speed_ms")),
            "solar_attenuation": physics.attenuated(F.col("irradiance_wm2"), F.col("cloud_cover")),
        }
    )
    lagged = [c for c in LAGGED if c in frame.columns]
    return ordered.lag_features(s.on(frame), lagged)

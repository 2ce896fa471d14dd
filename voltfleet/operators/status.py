"""Current state of each site as of a given moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.functions import flows
from voltfleet.operators.aggregates import latest


def as_of_filter(rows: DataFrame, as_of: Column, time: str = "time") -> DataFrame:
    return rows.filter(F.col(time) <= as_of)


def latest_prices(prices: DataFrame, as_of: Column, order=("time", "seq")) -> DataFrame:
    return latest(as_of_filter(prices, as_of), ["site_id"], order)


def latest_per_asset(telemetry: DataFrame, as_of: Column, order=("time", "seq")) -> DataFrame:
    return latest(as_of_filter(telemetry, as_of), ["site_id", "asset_id"], order)


def latest_storage_kwh(telemetry: DataFrame, as_of: Column, order=("time", "seq")) -> DataFrame:
    """Stored energy per site from the last known battery level; half full when never reported."""
    seen = as_of_filter(telemetry, as_of)
    known = (F.col("asset_id") == "battery_bank") & F.col("battery_soc_pct").isNotNull()
    last_pct = F.max_by("battery_soc_pct", F.when(known, F.struct(*order)))
    return seen.groupBy("site_id").agg(flows.soc_to_kwh(last_pct).alias("start_kwh"))


def snapshot(telemetry: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """Latest price and latest reading of every asset, one row each."""
    assets = latest_per_asset(telemetry, as_of).select(
        "site_id", F.lit("asset").alias("kind"), F.col("asset_id").alias("item"), "time", F.col("power_kw").alias("value")
    )
    market = latest_prices(prices, as_of).select(
        "site_id",
        F.lit("price").alias("kind"),
        F.lit("buy_price_inr").alias("item"),
        "time",
        F.col("buy_price_inr").alias("value"),
    )
    return assets.unionByName(market)


def key_figures(current: DataFrame) -> DataFrame:
    """Demand, generation and battery flow per site from the latest rows per asset."""

    def power(asset: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("asset_id") == asset, F.col("power_kw"))), F.lit(0.0))

    sites = current.groupBy("site_id").agg(
        power(S.CAMPUS_ASSET).alias("demand_kw"),
        power("solar_pv").alias("solar_kw"),
        power("wind_turbine").alias("wind_kw"),
        power("battery_bank").alias("battery_kw"),
    )
    generation = F.col("solar_kw") + F.col("wind_kw")
    return sites.select(
        "*",
        generation.alias("generation_kw"),
        (F.col("demand_kw") - generation + F.col("battery_kw")).alias("grid_import_kw"),
        flows.flow_label(F.col("battery_kw")).alias("battery_flow"),
    )

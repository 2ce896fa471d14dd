"""Power-flow, cost and clamp expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.functions.physics import turbine_runs


def not_below(value: Column, floor: float) -> Column:
    return F.greatest(value, F.lit(floor))


def horizon_clamps(
    demand: Column, solar: Column, wind: Column, price: Column, time: Column, irradiance: Column, speed: Column
) -> dict[str, Column]:
    """Physical limits on forecasts for hours to come."""
    dark = (irradiance <= 0) | ~F.hour(time).between(6, 18)
    return {
        "demand": not_below(demand, S.MIN_DEMAND_KW),
        "solar": F.when(dark, 0.0).otherwise(not_below(solar, 0.0)),
        "wind": F.when(turbine_runs(speed), not_below(F.least(wind, F.lit(S.WIND_RATED_KW)), 0.0)).otherwise(0.0),
        "price": not_below(price, S.MIN_PRICE),
    }


def scoring_clamp(target: str, predicted: Column, irradiance: Column, speed: Column) -> Column:
    """Limits on predictions for past hours, as used when scoring: no daylight-hours test, floor 0."""
    if target == "solar":
        predicted = F.when(irradiance <= 0, 0.0).otherwise(predicted)
    elif target == "wind":
        held = F.least(predicted, F.lit(S.WIND_RATED_KW))
        predicted = F.when(turbine_runs(speed), held).otherwise(0.0)
    return not_below(predicted, 0.0)


def baseline_cost(demand: Column, solar: Column, wind: Column, price: Column) -> Column:
    """Cost of buying the uncovered demand, without the battery."""
    return F.greatest(F.lit(0.0), demand - (solar + wind)) * price


def dispatched_cost(buy: Column, sell: Column, price: Column, sell_ratio: float = S.SELL_RATIO) -> Column:
    return buy * price - sell * (sell_ratio * price)


def soc_to_kwh(soc_pct: Column, capacity: float = S.BATTERY_KWH) -> Column:
    """Stored energy; half the battery when no level is known."""
    return F.coalesce(soc_pct / 100.0 * capacity, F.lit(capacity / 2))


def dispatch_demand(command: Column, rate: Column, deficit: Column) -> dict[str, Column]:
    """Charge and discharge request: an override wins, else surplus charges and deficit discharges."""
    forced = command.isin("charge", "discharge")
    charge = F.when(command == "charge", rate).when(forced | (deficit >= 0), 0.0).otherwise(-deficit)
    discharge = F.when(command == "discharge", rate).when(forced | (deficit < 0), 0.0).otherwise(deficit)
    return {"charge_kw": charge, "discharge_kw": discharge}


def flow_label(power: Column) -> Column:
    return F.when(power > 0, "Charging").when(power < 0, "Discharging").otherwise("Idle")


def signed_flow(charge: Column, discharge: Column) -> Column:
    return F.when(charge > 0, charge).otherwise(-discharge)


def savings_pct(baseline: Column, savings: Column) -> Column:
    return F.coalesce(F.try_divide(savings, F.when(baseline > 0, baseline)) * 100.0, F.lit(0.0))


def override_ok(command: Column, rate: Column) -> Column:
    known = command.isin("charge", "discharge", "none")
    return F.coalesce(known & rate.between(0.0, S.BATTERY_KW), F.lit(False))

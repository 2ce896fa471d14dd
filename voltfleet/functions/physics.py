"""Plant formulas as column expressions: expected output, power triangle, weather, battery."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltfleet import schemas as S


def cubed(speed: Column) -> Column:
    return F.pow(speed, F.lit(3.0))


def attenuated(irradiance: Column, cloud_cover: Column) -> Column:
    """Irradiance left after cloud cover in percent."""
    return irradiance * (1.0 - 0.75 * F.pow(cloud_cover / 100.0, F.lit(3.0)))


def kmh_to_ms(speed: Column) -> Column:
    return speed / 3.6


def total_irradiance(direct: Column, diffuse: Column) -> Column:
    return direct + diffuse


def expected_pv(irradiance: Column, ambient: Column) -> Column:
    """PV output in kW; cells lose efficiency as sun and air heat them."""
    heat = ambient + S.PV_HEAT_COEFF * irradiance - S.PV_REF_TEMP
    kept = F.greatest(F.lit(0.0), 1.0 - S.PV_TEMP_COEFF * heat)
    return F.when(irradiance <= 0, 0.0).otherwise(
        F.round(S.PV_EFFICIENCY * S.PV_AREA_M2 * irradiance * kept / 1000.0, 3)
    )


def turbine_runs(speed: Column) -> Column:
    return (speed >= S.WIND_CUT_IN) & (speed < S.WIND_CUT_OUT)


def expected_wind(speed: Column) -> Column:
    """Turbine output in kW: cubic up to rated speed, flat up to cut-out."""
    cubic = 0.5 * S.AIR_DENSITY * S.ROTOR_AREA_M2 * S.POWER_COEFF * cubed(speed) / 1000.0
    return (
        F.when(~turbine_runs(speed), 0.0)
        .when(speed < S.WIND_RATED, F.round(F.least(cubic, F.lit(S.WIND_RATED_KW)), 3))
        .otherwise(S.WIND_RATED_KW)
    )


def vibration_target(speed: Column) -> Column:
    """Level the wear index drifts to, without turbulence."""
    return (
        F.when(speed >= S.WIND_CUT_OUT, 0.8)
        .when(speed >= S.WIND_RATED, 1.8)
        .otherwise(1.0 + speed / S.WIND_RATED * 0.5)
    )


def reactive_kvar(active: Column, factor: Column) -> Column:
    return F.round(active * F.sqrt(1.0 - factor * factor) / factor, 3)


def apparent_kva(active: Column, factor: Column) -> Column:
    return F.round(active / factor, 3)


def typical_temperature(time: Column) -> Column:
    low, high = S.FALLBACK_TEMP
    share = (F.sin((F.hour(time) - 9) / 24.0 * 2 * math.pi) + 1.0) / 2.0
    return F.round(low + (high - low) * share, 2)


def typical_irradiance(time: Column) -> Column:
    rise, fall, peak = S.FALLBACK_SUN
    hour = F.hour(time)
    clear = peak * F.sin(math.pi * (hour - rise) / (fall - rise))
    lit = F.round(attenuated(clear, F.lit(S.FALLBACK_CLOUD)), 2)
    return F.when((hour > rise) & (hour < fall), lit).otherwise(0.0)


def gap_filled_weather(time: Column, has_feed: Column, **feed: Column) -> dict[str, Column]:
    """Feed readings where there are any, the typical day elsewhere, and which of the two it was.

    Wind has no typical day: without a reading it stays null.
    """
    typical = {
        "temperature_c": typical_temperature(time),
        "irradiance_wm2": typical_irradiance(time),
        "cloud_cover": F.lit(S.FALLBACK_CLOUD),
        "humidity": F.lit(S.FALLBACK_HUMIDITY),
    }
    filled = {n: F.when(has_feed, c).otherwise(typical.get(n, F.lit(None))) for n, c in feed.items()}
    return filled | {"source": F.when(has_feed, "real_api").otherwise("physics_fallback")}


def battery_voltage(charge: Column, discharge: Column, soc_pct: Column, capacity: float = S.BATTERY_KWH) -> Column:
    """Terminal voltage: sags or rises with the rate, drifts with the level when idle."""
    swing = (charge + discharge) / capacity * 30.0
    idle = 400.0 + (soc_pct - 50.0) * 0.4
    return F.round(F.when(charge > 0, 400.0 + swing).when(discharge > 0, 400.0 - swing).otherwise(idle), 1)


def temperature_stress(cell_temp: Column) -> Column:
    return F.when(cell_temp > 35.0, 1.0 + (cell_temp - 35.0) * 0.1).otherwise(1.0)


def battery_unsafe(cell_temp: Column, soc_pct: Column, soh_pct: Column) -> Column:
    return (cell_temp > S.CELL_TEMP_ALERT) | (soc_pct < 5.0) | (soc_pct > 95.0) | (soh_pct < 40.0)

"""Topics, tables and plant constants, kept as plain data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A numeric payload field and the closed range a valid value lies in."""

    name: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Topic:
    numeric: tuple[Field, ...]
    flag: str | None = None  # boolean field, False when absent
    label: str | None = None  # string field, "imputed" when absent
    nested: str | None = None  # required map field


# Field names and bounds of the five telemetry topics.
TOPICS: dict[str, Topic] = {
    "solar": Topic(
        (Field("temperature_c", -10.0, 60.0), Field("irradiance_wm2", 0.0), Field("solar_power_kw", 0.0)),
        label="weather_source",
    ),
    "wind": Topic(
        (Field("wind_speed_ms", 0.0, 100.0), Field("wind_power_kw", 0.0), Field("wind_vibration", 0.0)),
    ),
    "battery": Topic(
        (
            Field("battery_power_kw"),
            Field("battery_soc", 0.0, 100.0),
            Field("battery_soh", 0.0, 100.0),
            Field("battery_cell_temp", -20.0, 100.0),
            Field("battery_voltage", 0.0),
        ),
        flag="anomaly_flag",
    ),
    "meters": Topic(
        (Field("demand_active_kw", 0.0), Field("demand_reactive_kvar", 0.0), Field("aggregate_power_factor", 0.5, 1.0)),
        nested="breakdown",
    ),
    "market": Topic(
        (
            Field("electricity_buy_price_inr", 0.0),
            Field("electricity_sell_price_inr", 0.0),
            Field("grid_frequency_hz", 48.0, 52.0),
        ),
    ),
}

#: Numeric fields travel in slots v0..v4, so that one pass serves all topics.
SLOTS = tuple(f"v{i}" for i in range(max(len(t.numeric) for t in TOPICS.values())))

# Sensor-freeze and outlier rules.
FREEZE_WINDOW = 5
IMPUTE_WINDOW = 3
ZERO_IS_NORMAL = ("irradiance_wm2", "solar_power_kw", "wind_power_kw", "battery_power_kw")
SOLAR_TEMP_ALERT = 75.0
WIND_SPEED_ALERT = 45.0
CELL_TEMP_ALERT = 60.0
FREQUENCY_BAND = (49.5, 50.5)

DEAD_LETTER = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("site_id", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    # name: (columns as DDL, unique key)
    "assets": (
        "site_id BIGINT, asset_id STRING, asset_type STRING, capacity_kw DOUBLE, location STRING",
        ("site_id", "asset_id"),
    ),
    "electricity_prices": (
        "site_id BIGINT, time TIMESTAMP, buy_price_inr DOUBLE, sell_price_inr DOUBLE, grid_frequency DOUBLE",
        ("site_id", "time"),
    ),
    "telemetry_power": (
        "site_id BIGINT, time TIMESTAMP, asset_id STRING, power_kw DOUBLE, voltage DOUBLE, status STRING, "
        "anomaly_flag BOOLEAN, battery_soc_pct DOUBLE",
        ("site_id", "time", "asset_id"),
    ),
    "predictions": (
        "site_id BIGINT, time TIMESTAMP, target_type STRING, predicted_value DOUBLE, created_at TIMESTAMP",
        ("site_id", "created_at", "time", "target_type"),
    ),
    "control_overrides": (
        "site_id BIGINT, updated_at TIMESTAMP, command STRING, rate_kw DOUBLE",
        ("site_id", "updated_at"),
    ),
}

TARGETS = ("demand", "solar", "wind", "price")

# Campus buildings as (peak kW, load type, power factor).
BUILDINGS: dict[str, tuple[float, str, float]] = {
    "Academic_1": (150.0, "academic", 0.92),
    "Academic_2": (120.0, "academic", 0.92),
    "Lab_1": (250.0, "industrial", 0.85),
    "Residential_1": (80.0, "residential", 0.95),
    "Residential_2": (90.0, "residential", 0.95),
    "Dining_Hall": (110.0, "commercial", 0.90),
    "Library": (70.0, "academic", 0.94),
    "Gym": (60.0, "commercial", 0.88),
    "EV_Station_1": (100.0, "ev", 0.97),
    "EV_Station_2": (80.0, "ev", 0.97),
}

# Plant sizes and efficiencies.
PV_EFFICIENCY, PV_AREA_M2 = 0.18, 500.0
PV_TEMP_COEFF, PV_REF_TEMP, PV_HEAT_COEFF = 0.004, 25.0, 0.03
WIND_CUT_IN, WIND_RATED, WIND_CUT_OUT = 3.0, 12.0, 25.0
AIR_DENSITY, ROTOR_AREA_M2, POWER_COEFF, WIND_RATED_KW = 1.225, 1250.0, 0.4, 1500.0
BATTERY_KWH, BATTERY_KW, BATTERY_EFF = 2000.0, 500.0, 0.95
BATTERY_MIN_FRACTION, BATTERY_MAX_FRACTION = 0.1, 0.9
SELL_RATIO = 0.7
MIN_DEMAND_KW, MIN_PRICE = 5.0, 0.5

# Non-building assets as (type, capacity kW, location).
PLANT_ASSETS: dict[str, tuple[str, float, str]] = {
    "solar_pv": ("solar", PV_AREA_M2 * PV_EFFICIENCY, "Microgrid PV Field"),
    "wind_turbine": ("wind", WIND_RATED_KW, "North Ridge Turbine"),
    "battery_bank": ("battery", BATTERY_KW, "Central Battery Storage House"),
}
CAMPUS_ASSET = "campus_aggregate"

# Weather used where the feed has no reading.
FALLBACK_TEMP = (15.0, 35.0)
FALLBACK_CLOUD, FALLBACK_HUMIDITY = 20.0, 60.0
FALLBACK_SUN = (6, 18, 1000.0)

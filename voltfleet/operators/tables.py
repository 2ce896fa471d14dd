"""From clean messages and wide ticks to table rows, and back out to messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltfleet import schemas as S


def solar_status(power: Column, irradiance: Column) -> Column:
    idle = F.coalesce(irradiance, F.lit(0.0)) == 0.0
    return F.when((power > 0) | idle, "operational").otherwise("error")


def wind_status(power: Column, speed: Column) -> Column:
    calm = F.coalesce(speed, F.lit(0.0)) < S.WIND_CUT_IN
    return F.when((power > 0) | calm, "operational").otherwise("error")


def battery_status(soh: Column) -> Column:
    return F.when(F.coalesce(soh, F.lit(100.0)) > 40.0, "operational").otherwise("degraded")


# Fields of one building's load.
BUILDING_FIELDS = {
    "building_type": "string",
    "active_power_kw": "double",
    "reactive_power_kvar": "double",
    "apparent_power_kva": "double",
    "power_factor": "double",
}


def building_entries(breakdown: Column) -> Column:
    """Entries (key, value) of a breakdown object, the value as a variant: it may be of any form."""
    entries = F.try_variant_get(F.try_parse_json(breakdown), "$", "map<string,variant>")
    return F.coalesce(F.map_entries(entries), F.expr("map_entries(CAST(map() AS map<string,variant>))"))


def building_rows(rows: DataFrame, keep=("site_id", "time", "seq")) -> DataFrame:
    """One row per building of every breakdown: its load, and ``is_object``. A field that is absent or not readable is null,
    and an entry that is no object has none; neither costs the other entries."""
    entries = rows.select(*keep, F.explode(building_entries(F.col("breakdown"))).alias("e"))
    value = F.col("e.value")
    fields = [F.try_variant_get(value, f"$.{name}", kind).alias(name) for name, kind in BUILDING_FIELDS.items()]
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    return entries.select(*keep, F.col("e.key").alias("building"), *fields, is_object.alias("is_object"))


def price_rows(clean: DataFrame) -> DataFrame:
    """``electricity_prices`` rows from market messages."""
    v = dict(zip((f.name for f in S.TOPICS["market"].numeric), S.SLOTS))
    return clean.filter(F.col("topic") == "market").select(
        "site_id",
        "time",
        "seq",
        F.col(v["electricity_buy_price_inr"]).alias("buy_price_inr"),
        F.col(v["electricity_sell_price_inr"]).alias("sell_price_inr"),
        F.col(v["grid_frequency_hz"]).alias("grid_frequency"),
    )


def power_rows(clean: DataFrame) -> DataFrame:
    """``telemetry_power`` rows from the other topics: one per message, and one per building with a readable load.

    Each message becomes an array of rows that is exploded in place, so the clean
    messages are read once.
    """
    slot = {f.name: F.col(S.SLOTS[i]) for t in S.TOPICS.values() for i, f in enumerate(t.numeric)}
    none = F.lit(None).cast("double")

    def row(asset: Column, power: Column, status: Column, voltage: Column = none, soc: Column = none) -> Column:
        return F.struct(
            asset.alias("asset_id"),
            power.alias("power_kw"),
            voltage.alias("voltage"),
            status.alias("status"),
            soc.alias("battery_soc_pct"),
        )

    running = F.lit("operational")
    buildings = F.transform(
        building_entries(F.col("breakdown")),
        lambda e: row(e["key"], F.try_variant_get(e["value"], "$.active_power_kw", "double"), running),
    )
    buildings = F.filter(buildings, lambda r: r["power_kw"].isNotNull())
    topic = F.col("topic")
    solar, wind = slot["solar_power_kw"], slot["wind_power_kw"]
    rows = (
        F.when(
            topic == "solar", F.array(row(F.lit("solar_pv"), solar, solar_status(solar, slot["irradiance_wm2"])))
        )
        .when(topic == "wind", F.array(row(F.lit("wind_turbine"), wind, wind_status(wind, slot["wind_speed_ms"]))))
        .when(
            topic == "battery",
            F.array(
                row(
                    F.lit("battery_bank"),
                    slot["battery_power_kw"],
                    battery_status(slot["battery_soh"]),
                    slot["battery_voltage"],
                    slot["battery_soc"],
                )
            ),
        )
        .when(
            topic == "meters",
            F.concat(F.array(row(F.lit(S.CAMPUS_ASSET), slot["demand_active_kw"], running)), buildings),
        )
    )
    return clean.select("site_id", "time", "seq", F.explode(rows).alias("r"), "anomaly_flag").select(
        "site_id",
        "time",
        "seq",
        "r.asset_id",
        "r.power_kw",
        "r.voltage",
        "r.status",
        "anomaly_flag",
        "r.battery_soc_pct",
    )


def unpivot(ticks: DataFrame, keys, columns: Mapping[str, str]) -> DataFrame:
    """Wide ticks to long power rows: ``columns`` maps a wide column to its asset."""
    pairs = F.array(*[F.struct(F.lit(a).alias("asset_id"), F.col(c).alias("power_kw")) for c, a in columns.items()])
    return ticks.select(*keys, F.explode(pairs).alias("r")).select(*keys, "r.*")


def topic_messages(ticks: DataFrame, prefix: str = "telemetry") -> DataFrame:
    """Each wide tick as one JSON message per topic: one scan, no union."""

    def message(name: str, spec: S.Topic) -> Column:
        extras = [c for c in (spec.label, spec.flag, spec.nested) if c]
        fields = ["timestamp", *[f.name for f in spec.numeric], *extras]
        payload = F.to_json(F.struct(*[F.col(c) for c in fields if c in ticks.columns]))
        return F.struct(F.lit(f"{prefix}.{name}").alias("topic"), payload.alias("value"))

    messages = F.array(*[message(n, t) for n, t in S.TOPICS.items()])
    return ticks.select("site_id", "seq", F.explode(messages).alias("m")).select("site_id", "seq", "m.topic", "m.value")


def site_assets(sites: DataFrame) -> DataFrame:
    """Plant, buildings and their total for every site. The list per site is configuration of fixed size."""

    def entry(asset: str, kind: str, capacity: float, where: str) -> Column:
        values = {"asset_id": asset, "asset_type": kind, "capacity_kw": capacity, "location": where}
        return F.struct(*[F.lit(v).alias(n) for n, v in values.items()])

    plant = [entry(asset, *values) for asset, values in S.PLANT_ASSETS.items()]
    buildings = [
        entry(name, "building", peak, f"Campus {kind.title()} Building") for name, (peak, kind, _) in S.BUILDINGS.items()
    ]
    single = sites.select("site_id").distinct().select("site_id", F.explode(F.array(*plant, *buildings)).alias("a"))
    single = single.select("site_id", "a.*")
    campus = (
        single.filter("asset_type = 'building'")
        .groupBy("site_id")
        .agg(F.sum("capacity_kw").alias("capacity_kw"))
        .select(
            "site_id",
            F.lit(S.CAMPUS_ASSET).alias("asset_id"),
            F.lit("building").alias("asset_type"),
            "capacity_kw",
            F.lit("Total Campus Load Aggregate").alias("location"),
        )
    )
    return single.unionByName(campus)

"""How the given tables map to telemetry, prices, messages and forecasts.

Expressions that both engines evaluate are written once, as SQL text that Spark
and DuckDB read alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.session import spread

ASSET_SQL = (
    "CASE event_type WHEN 'click' THEN 'solar_pv' WHEN 'view' THEN 'wind_turbine' "
    "WHEN 'purchase' THEN 'battery_bank' WHEN 'error' THEN 'campus_aggregate' ELSE 'grid_market' END"
)
TOPIC_SQL = (
    "CASE event_type WHEN 'click' THEN 'solar' WHEN 'view' THEN 'wind' "
    "WHEN 'purchase' THEN 'battery' WHEN 'error' THEN 'meters' ELSE 'market' END"
)
TARGET_SQL = (
    "CASE asset_id WHEN 'solar_pv' THEN 'solar' WHEN 'wind_turbine' THEN 'wind' "
    "WHEN 'campus_aggregate' THEN 'demand' WHEN 'grid_market' THEN 'price' END"
)
#: "Now" of the as-of queries; within the span of the events.
AS_OF = "2024-01-25 00:00:00"

#: Payload field: value. Null means that the message lacks the field.
FIELDS: dict[str, dict[str, str]] = {
    "solar": {
        "temperature_c": "k * 0.9e0 - 8",
        "irradiance_wm2": "power_kw * 8",
        "solar_power_kw": "CASE WHEN k >= 10 THEN power_kw END",
        "weather_source": "CASE WHEN k >= 50 THEN 'real_api' END",
    },
    "wind": {
        "wind_speed_ms": "CASE WHEN power_kw > 120 THEN power_kw ELSE k * 0.6e0 END",
        "wind_power_kw": "CASE WHEN k >= 10 THEN CAST(floor(power_kw / 40) * 40 AS DOUBLE) END",
        "wind_vibration": "1 + k / 100.0e0",
    },
    "battery": {
        "battery_power_kw": "power_kw - 50",
        "battery_soc": "CASE WHEN k >= 10 THEN k + 0.5e0 END",
        "battery_soh": "100 - power_kw / 10",
        "battery_cell_temp": "power_kw / 2 - 10",
        "battery_voltage": "350 + k * 1.0e0",
        "anomaly_flag": "CASE WHEN k >= 95 THEN true WHEN k >= 90 THEN false END",
    },
    "meters": {
        "demand_active_kw": "power_kw * 5",
        "demand_reactive_kvar": "CASE WHEN k >= 10 THEN power_kw * 2 END",
        "aggregate_power_factor": "0.47e0 + k / 185.0e0",
    },
    "market": {
        "electricity_buy_price_inr": "CASE WHEN k >= 10 THEN power_kw END",
        "electricity_sell_price_inr": "power_kw * 0.07e0",
        "grid_frequency_hz": "47.9e0 + k * 0.045e0",
    },
}
BUILDING_SHARES = {"Academic_1": 0.6, "Lab_1": 0.4}
#: Buildings of the detailed meter messages: share of the load, type, power factor.
METERED = {"Academic_1": (0.5, "academic", 0.92), "Lab_1": (0.3, "industrial", 0.85), "Gym": (0.2, "commercial", 0.88)}
NO_TIMESTAMP = "k = 98"
NO_BREAKDOWN = "power_kw < 1"
UNREADABLE_VIBRATION = "k = 97"

T_SQL = f"""
t AS (
  SELECT event_id AS seq, ts AS time, user_id AS site_id, {ASSET_SQL} AS asset_id, {TOPIC_SQL} AS topic,
         value AS power_kw, CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events
)"""

PRICES_SQL = """
prices AS (
  SELECT site_id, time, seq, power_kw / 10 AS buy_price_inr, power_kw * 0.07e0 AS sell_price_inr,
         47.9e0 + k * 0.045e0 AS grid_frequency
  FROM t WHERE asset_id = 'grid_market'
)"""

POWER_SQL = """
power AS (
  SELECT site_id, time, seq, asset_id, power_kw,
         CASE WHEN asset_id = 'battery_bank' THEN 350 + k * 1.0e0 END AS voltage,
         CASE WHEN asset_id = 'battery_bank' THEN k * 1.0e0 END AS battery_soc_pct
  FROM t WHERE asset_id <> 'grid_market'
)"""

PREDICTIONS_SQL = f"""
predictions AS (
  SELECT site_id, target_type, time, created_at, arg_min(power_kw, seq) AS predicted_value
  FROM (SELECT site_id, {TARGET_SQL} AS target_type, date_trunc('hour', time) AS time,
               date_trunc('day', time) AS created_at, power_kw, seq FROM t WHERE asset_id <> 'battery_bank')
  GROUP BY ALL
)"""

FORECAST_SQL = """
forecast AS (
  SELECT site_id, date_trunc('day', time) AS created_at, date_trunc('hour', time) AS time,
         CAST(sum(CASE WHEN asset_id = 'campus_aggregate' THEN CAST(round(power_kw * 500) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100 AS demand,
         CAST(sum(CASE WHEN asset_id = 'solar_pv' THEN CAST(round(power_kw * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100 AS solar,
         CAST(sum(CASE WHEN asset_id = 'wind_turbine' THEN CAST(round(power_kw * 200) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100 AS wind,
         1 + max(k) / 10.0e0 AS price
  FROM t GROUP BY 1, 2, 3
)"""


METERED_SQL = f"""
b(building, share, kind, pf) AS (VALUES {", ".join(f"('{n}', {s}e0, '{k}', {f}e0)" for n, (s, k, f) in METERED.items())}),
metered AS (
  SELECT site_id, time, seq, building, kind AS building_type, power_kw * share AS active_power_kw,
         power_kw * share * 0.5e0 AS reactive_power_kvar, power_kw * share / pf AS apparent_power_kva, pf AS power_factor, k
  FROM t, b WHERE topic = 'meters'
)"""


def slot_sql() -> str:
    """DuckDB columns v0..v4 of the decoded messages."""
    lists = {}
    for topic, fields in FIELDS.items():
        numeric = [f for f in fields if f not in ("weather_source", "anomaly_flag")]
        for i, name in enumerate(numeric):
            text = fields[name]
            if name == "wind_vibration":
                text = f"CASE WHEN NOT ({UNREADABLE_VIBRATION}) THEN {text} END"
            lists.setdefault(i, []).append(f"WHEN '{topic}' THEN CAST({text} AS DOUBLE)")
    return ", ".join(f"CASE topic {' '.join(cases)} END AS v{i}" for i, cases in sorted(lists.items()))


MESSAGES_SQL = f"""
m AS (
  SELECT site_id, topic, seq, k, power_kw,
         CASE WHEN NOT ({NO_TIMESTAMP}) THEN time END AS time,
         {slot_sql()},
         CASE WHEN topic = 'battery' THEN {FIELDS['battery']['anomaly_flag']} END AS flag_sent,
         CASE WHEN topic = 'solar' THEN {FIELDS['solar']['weather_source']} END AS source_sent,
         topic = 'meters' AND NOT ({NO_BREAKDOWN}) AS has_breakdown,
         topic = 'wind' AND {UNREADABLE_VIBRATION} AS unreadable
  FROM t
)"""

JUDGED_SQL = """
j AS (
  SELECT *,
    time IS NOT NULL AND NOT unreadable AND (topic <> 'meters' OR has_breakdown) AND coalesce(CASE topic
      WHEN 'solar' THEN coalesce(v0 BETWEEN -10 AND 60, true) AND coalesce(v1 >= 0, true) AND coalesce(v2 >= 0, true)
      WHEN 'wind' THEN coalesce(v0 BETWEEN 0 AND 100, true) AND coalesce(v1 >= 0, true) AND coalesce(v2 >= 0, true)
      WHEN 'battery' THEN coalesce(v1 BETWEEN 0 AND 100, true) AND coalesce(v2 BETWEEN 0 AND 100, true)
                          AND coalesce(v3 BETWEEN -20 AND 100, true) AND coalesce(v4 >= 0, true)
      WHEN 'meters' THEN coalesce(v0 >= 0, true) AND coalesce(v1 >= 0, true) AND coalesce(v2 BETWEEN 0.5 AND 1, true)
      ELSE coalesce(v0 >= 0, true) AND coalesce(v1 >= 0, true) AND coalesce(v2 BETWEEN 48 AND 52, true) END, true) AS ok,
    v0 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL
      AND (topic <> 'battery' OR (v3 IS NOT NULL AND v4 IS NOT NULL)) AS complete
  FROM m
)"""


@dataclass(frozen=True)
class Inputs:
    spark: SparkSession
    sf_dir: str
    #: Longest series left whole; null: the session's setting.
    series_rows: int | None = None

    def __post_init__(self) -> None:
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")

    @property
    def now(self):
        return F.lit(AS_OF).cast("timestamp")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def project(self, events: DataFrame) -> DataFrame:
        return events.select(
            F.col("event_id").alias("seq"),
            F.col("ts").cast("timestamp").alias("time"),
            F.col("user_id").alias("site_id"),
            F.expr(ASSET_SQL).alias("asset_id"),
            F.expr(TOPIC_SQL).alias("topic"),
            F.col("value").alias("power_kw"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    def t(self) -> DataFrame:
        return self.project(self.table("events"))

    def prices(self) -> DataFrame:
        return (
            self.t()
            .filter("asset_id = 'grid_market'")
            .selectExpr(
                "site_id",
                "time",
                "seq",
                "power_kw / 10 AS buy_price_inr",
                "power_kw * 0.07e0 AS sell_price_inr",
                "47.9e0 + k * 0.045e0 AS grid_frequency",
            )
        )

    def power(self) -> DataFrame:
        return (
            self.t()
            .filter("asset_id <> 'grid_market'")
            .selectExpr(
                "site_id",
                "time",
                "seq",
                "asset_id",
                "power_kw",
                "CASE WHEN asset_id = 'battery_bank' THEN 350 + k * 1.0e0 END AS voltage",
                "CASE WHEN asset_id = 'battery_bank' THEN k * 1.0e0 END AS battery_soc_pct",
            )
        )

    def predictions(self) -> DataFrame:
        rows = (
            self.t()
            .filter("asset_id <> 'battery_bank'")
            .select(
                "site_id",
                F.expr(TARGET_SQL).alias("target_type"),
                F.date_trunc("hour", "time").alias("time"),
                F.date_trunc("day", "time").alias("created_at"),
                "power_kw",
                "seq",
            )
        )
        keys = ["site_id", "target_type", "time", "created_at"]
        return rows.groupBy(*keys).agg(F.min_by("power_kw", "seq").alias("predicted_value"))

    def forecast(self) -> DataFrame:
        def total(asset: str, factor: int):
            cents = F.round(F.col("power_kw") * (100 * factor)).cast("bigint")
            return F.sum(F.when(F.col("asset_id") == asset, cents).otherwise(0)).cast("double") / 100

        return (
            self.t()
            .groupBy(
                "site_id",
                F.date_trunc("day", "time").alias("created_at"),
                F.date_trunc("hour", "time").alias("time"),
            )
            .agg(
                total("campus_aggregate", 5).alias("demand"),
                total("solar_pv", 1).alias("solar"),
                total("wind_turbine", 2).alias("wind"),
                (1 + F.max("k") / 10.0).alias("price"),
            )
        )

    def meter_messages(self) -> DataFrame:
        """Meter messages whose breakdown has whole loads: some numbers are text, and some entries are no loads at all."""
        t = spread(self.t().filter("topic = 'meters'"))
        k, kw = F.col("k"), F.col("power_kw")
        loads = []
        for name, (share, kind, factor) in METERED.items():
            active = kw * share
            values = {"active_power_kw": active, "reactive_power_kvar": active * 0.5, "apparent_power_kva": active / factor}
            if name == "Lab_1":
                values["active_power_kw"] = active.cast("string")
            fields = [F.lit(kind).alias("building_type"), *[v.alias(n) for n, v in values.items()], F.lit(factor).alias("power_factor")]
            loads.append(F.struct(*fields).alias(name))
        loads.append(F.when(k >= 90, k).alias("Number"))
        loads.append(F.when(k < 10, "offline").alias("Text"))
        loads.append(F.when(k == 50, F.array(kw, kw)).alias("List"))
        loads.append(F.when(k.between(20, 29), F.struct(F.lit("n/a").alias("active_power_kw"), F.lit("lab").alias("building_type"))).alias("Broken"))
        stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
        payload = F.to_json(F.struct(stamp, kw.alias("demand_active_kw"), F.struct(*loads).alias("breakdown")))
        return t.select("site_id", "topic", "seq", payload.alias("payload"))

    def messages(self, t: DataFrame | None = None) -> DataFrame:
        """One JSON message per event, ``(site_id, topic, seq, payload)``; some numbers are sent as text."""
        t = spread(self.t()) if t is None else t
        stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        stamp = F.when(~F.expr(NO_TIMESTAMP), stamp).alias("timestamp")
        payload = F
        for topic, fields in FIELDS.items():
            columns = [stamp]
            for name, text in fields.items():
                value = F.expr(text)
                if name == "temperature_c":
                    value = value.cast("string")
                if name == "wind_vibration":
                    value = F.when(F.expr(UNREADABLE_VIBRATION), "n/a").otherwise(value.cast("string"))
                columns.append(value.alias(name))
            if topic == "meters":
                shares = [
                    F.struct((F.col("power_kw") * 5 * s).alias("active_power_kw")).alias(b)
                    for b, s in BUILDING_SHARES.items()
                ]
                columns.append(F.when(~F.expr(NO_BREAKDOWN), F.struct(*shares)).alias("breakdown"))
            payload = payload.when(F.col("topic") == topic, F.to_json(F.struct(*columns)))
        return t.select("site_id", "topic", "seq", payload.alias("payload"))

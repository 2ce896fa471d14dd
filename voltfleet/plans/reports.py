"""Scans, joins, aggregates and status reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltfleet.functions import flows
from voltfleet.operators import aggregates, align, joins, ordered, series, status, tables
from voltfleet.plans.inputs import AS_OF, POWER_SQL, PREDICTIONS_SQL, PRICES_SQL, T_SQL, Inputs
from voltfleet.plans.registry import query
from voltfleet.sources import tables as store

PT = f"WITH {T_SQL}, {PRICES_SQL}, {POWER_SQL}"
NOW = f"TIMESTAMP '{AS_OF}'"


@query(
    "status_snapshot",
    f"""{PT}
    SELECT site_id, 'asset' AS kind, asset_id AS item, time, power_kw AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY site_id, asset_id ORDER BY time DESC, seq DESC) AS r
      FROM power WHERE time <= {NOW}) WHERE r = 1
    UNION ALL
    SELECT site_id, 'price', 'buy_price_inr', time, buy_price_inr FROM (
      SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY time DESC, seq DESC) AS r
      FROM prices WHERE time <= {NOW}) WHERE r = 1""",
)
def status_snapshot(i: Inputs) -> DataFrame:
    return status.snapshot(i.power(), i.prices(), i.now)


@query("table_scan", f"{PT} SELECT site_id, time, buy_price_inr, sell_price_inr, grid_frequency FROM prices ORDER BY time")
def table_scan(i: Inputs) -> DataFrame:
    return store.scan(
        i.prices(), ["site_id", "time", "buy_price_inr", "sell_price_inr", "grid_frequency"], order=["time"]
    )


@query("asof_filter", f"{PT} SELECT site_id, asset_id, time, power_kw FROM power WHERE time <= {NOW}")
def asof_filter(i: Inputs) -> DataFrame:
    return status.as_of_filter(i.power(), i.now).select("site_id", "asset_id", "time", "power_kw")


@query(
    "history_by_asset",
    f"""{PT} SELECT time, seq, power_kw, voltage FROM power WHERE asset_id = 'battery_bank'
    ORDER BY time DESC, seq DESC LIMIT 50""",
)
def history_by_asset(i: Inputs) -> DataFrame:
    rows = i.power().filter("asset_id = 'battery_bank'").select("time", "seq", "power_kw", "voltage")
    return aggregates.most_recent(rows, ["time", "seq"], 50)


@query("price_history", f"{PT} SELECT * FROM prices ORDER BY time DESC, seq DESC LIMIT 50")
def price_history(i: Inputs) -> DataFrame:
    return aggregates.most_recent(i.prices(), ["time", "seq"], 50)


@query(
    "recent_series",
    f"""{PT} SELECT asset_id, time, seq, power_kw FROM (
      SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY time DESC, seq DESC) AS r FROM power) WHERE r <= 20
    ORDER BY asset_id, time""",
)
def recent_series(i: Inputs) -> DataFrame:
    rows = i.power().select("asset_id", "time", "seq", "power_kw")
    return aggregates.recent(rows, ["asset_id"], ["time", "seq"], 20).orderBy("asset_id", "time")


@query(
    "latest_per_asset",
    f"""{PT} SELECT site_id, asset_id, time, seq, power_kw, voltage, battery_soc_pct FROM (
      SELECT *, row_number() OVER (PARTITION BY site_id, asset_id ORDER BY time DESC, seq DESC) AS r
      FROM power WHERE time <= {NOW}) WHERE r = 1""",
)
def latest_per_asset(i: Inputs) -> DataFrame:
    return status.latest_per_asset(i.power(), i.now)


@query(
    "latest_price",
    f"""{PT} SELECT site_id, time, seq, buy_price_inr, sell_price_inr, grid_frequency FROM (
      SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY time DESC, seq DESC) AS r
      FROM prices WHERE time <= {NOW}) WHERE r = 1""",
)
def latest_price(i: Inputs) -> DataFrame:
    return status.latest_prices(i.prices(), i.now)


@query(
    "latest_soc_kwh",
    f"""{PT} SELECT site_id, coalesce(arg_max(battery_soc_pct, (time, seq)) FILTER (
        WHERE asset_id = 'battery_bank' AND battery_soc_pct IS NOT NULL) / 100.0e0 * 2000, 1000.0e0) AS start_kwh
    FROM power WHERE time <= {NOW} GROUP BY site_id""",
)
def latest_soc_kwh(i: Inputs) -> DataFrame:
    return status.latest_storage_kwh(i.power(), i.now)


@query("last_seen", f"{PT} SELECT site_id, asset_id, max(time) AS last_time FROM power GROUP BY ALL")
def last_seen(i: Inputs) -> DataFrame:
    return i.power().groupBy("site_id", "asset_id").agg(F.max("time").alias("last_time"))


@query(
    "kpi_flows",
    f"""{PT}, cur AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id, asset_id ORDER BY time DESC, seq DESC) AS r
      FROM power WHERE time <= {NOW}) WHERE r = 1),
    site AS (
      SELECT site_id,
        coalesce(max(power_kw) FILTER (WHERE asset_id = 'campus_aggregate'), 0) AS demand_kw,
        coalesce(max(power_kw) FILTER (WHERE asset_id = 'solar_pv'), 0) AS solar_kw,
        coalesce(max(power_kw) FILTER (WHERE asset_id = 'wind_turbine'), 0) AS wind_kw,
        coalesce(max(CASE WHEN asset_id = 'battery_bank' THEN power_kw END), 0) AS battery_kw
      FROM cur GROUP BY site_id)
    SELECT *, solar_kw + wind_kw AS generation_kw, demand_kw - (solar_kw + wind_kw) + battery_kw AS grid_import_kw,
      CASE WHEN battery_kw > 0 THEN 'Charging' WHEN battery_kw < 0 THEN 'Discharging' ELSE 'Idle' END AS battery_flow
    FROM site""",
)
def kpi_flows(i: Inputs) -> DataFrame:
    return status.key_figures(status.latest_per_asset(i.power(), i.now))


@query(
    "history_sufficiency",
    f"""{PT} SELECT site_id, count(*) FILTER (WHERE asset_id = 'campus_aggregate') AS history_rows,
      count(*) FILTER (WHERE asset_id = 'campus_aggregate') >= 7 * 24 AS sufficient FROM power GROUP BY site_id""",
)
def history_sufficiency(i: Inputs) -> DataFrame:
    return aggregates.history_size(i.power(), ["site_id"])


@query("distinct_times", f"{PT} SELECT DISTINCT site_id, date_trunc('hour', time) AS time FROM t")
def distinct_times(i: Inputs) -> DataFrame:
    return i.t().select("site_id", F.date_trunc("hour", "time").alias("time")).distinct()


@query(
    "dedupe_keep_first",
    f"""{PT} SELECT site_id, asset_id, hour, time, seq, power_kw FROM (
      SELECT *, date_trunc('hour', time) AS hour,
        row_number() OVER (PARTITION BY site_id, asset_id, date_trunc('hour', time) ORDER BY time, seq) AS r FROM t)
    WHERE r = 1""",
)
def dedupe_keep_first(i: Inputs) -> DataFrame:
    rows = i.t().select("site_id", "asset_id", F.date_trunc("hour", "time").alias("hour"), "time", "seq", "power_kw")
    return aggregates.keep_first(rows, ["site_id", "asset_id", "hour"], ["time", "seq"])


@query(
    "insert_ignore",
    f"""{PT}, keyed AS (SELECT site_id, date_trunc('hour', time) AS time, asset_id, power_kw, seq, time AS sent FROM t),
    stored AS (SELECT DISTINCT site_id, time, asset_id FROM keyed WHERE sent < TIMESTAMP '2024-01-15 00:00:00')
    SELECT site_id, time, asset_id, arg_min(power_kw, seq) AS power_kw, min(seq) AS seq FROM keyed
    ANTI JOIN stored USING (site_id, time, asset_id) GROUP BY ALL""",
)
def insert_ignore(i: Inputs) -> DataFrame:
    """Replay everything into a table that holds the first half of the month already."""
    t = i.t().select(
        "site_id", F.date_trunc("hour", "time").alias("time"), "asset_id", "power_kw", "seq", F.col("time").alias("sent")
    )
    stored = t.filter("sent < TIMESTAMP '2024-01-15 00:00:00'")
    return store.new_rows(t.drop("sent"), stored, ["site_id", "time", "asset_id"])


@query(
    "asset_dim",
    """SELECT site_id, asset_id, asset_type, capacity_kw, location
    FROM (SELECT DISTINCT user_id AS site_id FROM events), (VALUES
      ('solar_pv', 'solar', 90.0e0, 'Microgrid PV Field'), ('wind_turbine', 'wind', 1500.0e0, 'North Ridge Turbine'),
      ('battery_bank', 'battery', 500.0e0, 'Central Battery Storage House'),
      ('Academic_1', 'building', 150.0e0, 'Campus Academic Building'),
      ('Academic_2', 'building', 120.0e0, 'Campus Academic Building'),
      ('Lab_1', 'building', 250.0e0, 'Campus Industrial Building'),
      ('Residential_1', 'building', 80.0e0, 'Campus Residential Building'),
      ('Residential_2', 'building', 90.0e0, 'Campus Residential Building'),
      ('Dining_Hall', 'building', 110.0e0, 'Campus Commercial Building'),
      ('Library', 'building', 70.0e0, 'Campus Academic Building'),
      ('Gym', 'building', 60.0e0, 'Campus Commercial Building'),
      ('EV_Station_1', 'building', 100.0e0, 'Campus Ev Building'),
      ('EV_Station_2', 'building', 80.0e0, 'Campus Ev Building'),
      ('campus_aggregate', 'building', 1110.0e0, 'Total Campus Load Aggregate'))
      a(asset_id, asset_type, capacity_kw, location)""",
)
def asset_dim(i: Inputs) -> DataFrame:
    return tables.site_assets(i.t())


_FK = "EXISTS (SELECT 1 FROM customer WHERE c_custkey = site_id AND c_acctbal >= 0)"


@query("fk_semi", f"{PT} SELECT site_id, asset_id, seq, power_kw FROM t WHERE {_FK}")
def fk_semi(i: Inputs) -> DataFrame:
    """Readings of sites that are registered (customers in credit)."""
    registered = i.table("customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("site_id"))
    return joins.known_only(i.t(), registered, ["site_id"]).select("site_id", "asset_id", "seq", "power_kw")


@query("fk_anti", f"{PT} SELECT site_id, asset_id, seq, power_kw FROM t WHERE NOT {_FK}")
def fk_anti(i: Inputs) -> DataFrame:
    registered = i.table("customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("site_id"))
    return joins.unknown_only(i.t(), registered, ["site_id"]).select("site_id", "asset_id", "seq", "power_kw")


@query(
    "align_master",
    f"""{PT},
    p AS (SELECT site_id, date_trunc('hour', time) AS time, arg_min(buy_price_inr, seq) AS buy_price_inr,
      arg_min(sell_price_inr, seq) AS sell_price_inr, arg_min(grid_frequency, seq) AS grid_frequency
      FROM prices GROUP BY 1, 2),
    w AS (SELECT site_id, date_trunc('hour', time) AS time,
      arg_min(power_kw, seq) FILTER (WHERE asset_id = 'solar_pv') AS solar_power_kw,
      arg_min(power_kw, seq) FILTER (WHERE asset_id = 'wind_turbine') AS wind_power_kw,
      arg_min(power_kw, seq) FILTER (WHERE asset_id = 'battery_bank') AS battery_power_kw,
      arg_min(voltage, seq) FILTER (WHERE asset_id = 'battery_bank') AS battery_voltage,
      arg_min(power_kw, seq) FILTER (WHERE asset_id = 'campus_aggregate') AS demand_power_kw
      FROM power GROUP BY 1, 2)
    SELECT p.*, solar_power_kw, wind_power_kw, battery_power_kw, battery_voltage, demand_power_kw
    FROM p LEFT JOIN w USING (site_id, time)""",
)
def align_master(i: Inputs) -> DataFrame:
    hour = F.date_trunc("hour", "time")
    return align.align(i.prices().withColumn("time", hour), i.power().withColumn("time", hour))


_WEATHER = """weather AS (
  SELECT site_id, date_trunc('hour', time) AS time, arg_min(k * 0.5e0, seq) AS temperature_c,
    arg_min(power_kw * 8, seq) AS irradiance_wm2 FROM t WHERE asset_id = 'solar_pv' GROUP BY 1, 2)"""


def weather_feed(i: Inputs) -> DataFrame:
    """Hourly weather per site, with gaps: the hours in which the PV field reported."""
    readings = i.t().filter("asset_id = 'solar_pv'")
    return readings.groupBy("site_id", F.date_trunc("hour", "time").alias("time")).agg(
        F.min_by(F.expr("k * 0.5e0"), "seq").alias("temperature_c"),
        F.min_by(F.expr("power_kw * 8"), "seq").alias("irradiance_wm2"),
    )


@query(
    "nearest_weather",
    f"""{PT}, {_WEATHER}, l AS (SELECT site_id, seq, time, date_trunc('hour', time) AS hr, power_kw FROM t)
    SELECT l.site_id, seq, l.time, power_kw,
      CASE WHEN ahead IS NOT NULL AND (back IS NULL OR ahead - hr <= hr - back) THEN ta ELSE tb END AS temperature_c,
      CASE WHEN ahead IS NOT NULL AND (back IS NULL OR ahead - hr <= hr - back) THEN ia ELSE ib END AS irradiance_wm2
    FROM l
    ASOF LEFT JOIN (SELECT site_id AS s1, time AS back, temperature_c AS tb, irradiance_wm2 AS ib FROM weather) b
      ON s1 = l.site_id AND hr >= back
    ASOF LEFT JOIN (SELECT site_id AS s2, time AS ahead, temperature_c AS ta, irradiance_wm2 AS ia FROM weather) a
      ON s2 = l.site_id AND hr <= ahead""",
)
def nearest_weather(i: Inputs) -> DataFrame:
    rows = i.t().select("site_id", "seq", "time", "power_kw")
    return align.with_weather(rows, weather_feed(i))


OVERRIDES_SQL = """o AS (
  SELECT site_id, time, arg_max(CASE WHEN k >= 98 THEN 'none' WHEN power_kw >= 40 THEN 'charge' ELSE 'discharge' END, seq) AS command,
    arg_max(k * 5.0e0, seq) AS rate_kw FROM t WHERE k >= 95 GROUP BY 1, 2)"""


def overrides(i: Inputs) -> DataFrame:
    """Manual commands: the readings that carry an override code (k of 95 and more)."""
    command = F.when(F.col("k") >= 98, "none").when(F.col("power_kw") >= 40, "charge").otherwise("discharge")
    rows = i.t().filter("k >= 95").select("site_id", "time", "seq", command.alias("command"), F.expr("k * 5.0e0 AS rate_kw"))
    return aggregates.latest(rows, ["site_id", "time"], ["seq"]).drop("seq")


_IN_FORCE = f"""{PT}, {OVERRIDES_SQL}, f AS (
  SELECT t.site_id, t.seq, t.time, t.power_kw, coalesce(o.command, 'none') AS command, coalesce(o.rate_kw, 0) AS rate_kw
  FROM t ASOF LEFT JOIN o ON o.site_id = t.site_id AND t.time >= o.time)"""


def in_force(i: Inputs) -> DataFrame:
    ticks = i.t().select("site_id", "seq", "time", "power_kw")
    joined = joins.asof(ticks, overrides(i), ["site_id"], "time", "seq", ["command", "rate_kw"])
    return joined.withColumns(
        {"command": F.coalesce("command", F.lit("none")), "rate_kw": F.coalesce("rate_kw", F.lit(0.0))}
    )


@query("override_asof", f"{_IN_FORCE} SELECT * FROM f")
def override_asof(i: Inputs) -> DataFrame:
    return in_force(i)


@query(
    "dispatch_rule",
    f"""{_IN_FORCE} SELECT site_id, seq,
      CASE WHEN command = 'charge' THEN rate_kw WHEN command = 'discharge' THEN 0
           WHEN power_kw - 60 < 0 THEN -(power_kw - 60) ELSE 0 END AS charge_kw,
      CASE WHEN command = 'discharge' THEN rate_kw WHEN command = 'charge' THEN 0
           WHEN power_kw - 60 < 0 THEN 0 ELSE power_kw - 60 END AS discharge_kw FROM f""",
)
def dispatch_rule(i: Inputs) -> DataFrame:
    demand = flows.dispatch_demand(F.col("command"), F.col("rate_kw"), F.col("power_kw") - 60)
    return in_force(i).select("site_id", "seq", *[c.alias(n) for n, c in demand.items()])


@query(
    "override_validate",
    f"""{PT} SELECT site_id, seq, CASE WHEN k < 30 THEN 'charge' WHEN k < 60 THEN 'discharge' WHEN k < 90 THEN 'none'
      ELSE 'boost' END AS command, power_kw * 3 AS rate_kw,
      k < 90 AND power_kw * 3 BETWEEN 0 AND 500 AS valid FROM t""",
)
def override_validate(i: Inputs) -> DataFrame:
    command = F.when(F.col("k") < 30, "charge").when(F.col("k") < 60, "discharge").when(F.col("k") < 90, "none")
    rows = i.t().select("site_id", "seq", command.otherwise("boost").alias("command"), F.expr("power_kw * 3 AS rate_kw"))
    return rows.withColumn("valid", flows.override_ok(F.col("command"), F.col("rate_kw")))


@query(
    "union_by_name",
    f"""{PT} SELECT site_id, time, seq, buy_price_inr, sell_price_inr, grid_frequency, NULL AS asset_id, NULL AS power_kw,
      NULL AS voltage, NULL AS battery_soc_pct FROM prices UNION ALL
    SELECT site_id, time, seq, NULL, NULL, NULL, asset_id, power_kw, voltage, battery_soc_pct FROM power""",
)
def union_by_name(i: Inputs) -> DataFrame:
    return i.prices().unionByName(i.power(), allowMissingColumns=True)


@query(
    "unpivot_assets",
    f"""{PT} SELECT site_id, time, seq, asset_id, power_kw FROM (
      SELECT site_id, time, seq, unnest([{{'asset_id': 'solar_pv', 'power_kw': power_kw}},
        {{'asset_id': 'wind_turbine', 'power_kw': power_kw * 2}}, {{'asset_id': 'battery_bank', 'power_kw': k - 50.0e0}},
        {{'asset_id': 'campus_aggregate', 'power_kw': power_kw * 5}}], recursive := true) FROM t)""",
)
def unpivot_assets(i: Inputs) -> DataFrame:
    ticks = i.t().selectExpr(
        "site_id", "time", "seq", "power_kw AS solar", "power_kw * 2 AS wind", "k - 50.0e0 AS battery", "power_kw * 5 AS load"
    )
    names = {"solar": "solar_pv", "wind": "wind_turbine", "battery": "battery_bank", "load": "campus_aggregate"}
    return tables.unpivot(ticks, ["site_id", "time", "seq"], names)


@query("latest_run", f"WITH {T_SQL}, {PREDICTIONS_SQL} SELECT site_id, max(created_at) AS created_at FROM predictions GROUP BY 1")
def latest_run(i: Inputs) -> DataFrame:
    return i.predictions().groupBy("site_id").agg(F.max("created_at").alias("created_at"))


_PIVOT = """arg_min(predicted_value, target_type) FILTER (WHERE target_type = 'demand') AS demand,
      arg_min(predicted_value, target_type) FILTER (WHERE target_type = 'solar') AS solar,
      arg_min(predicted_value, target_type) FILTER (WHERE target_type = 'wind') AS wind,
      arg_min(predicted_value, target_type) FILTER (WHERE target_type = 'price') AS price"""


@query(
    "pivot_targets",
    f"WITH {T_SQL}, {PREDICTIONS_SQL} SELECT site_id, created_at, time, {_PIVOT} FROM predictions GROUP BY 1, 2, 3",
)
def pivot_targets(i: Inputs) -> DataFrame:
    return aggregates.pivot_targets(i.predictions(), ["site_id", "created_at", "time"])


@query(
    "dedupe_run_prices",
    f"""{PT} SELECT site_id, time, arg_min(buy_price_inr, seq) AS buy_price_inr FROM (
      SELECT site_id, date_trunc('hour', time) AS time, buy_price_inr, seq FROM prices) GROUP BY 1, 2""",
)
def dedupe_run_prices(i: Inputs) -> DataFrame:
    rows = i.prices().select("site_id", F.date_trunc("hour", "time").alias("time"), "buy_price_inr", "seq")
    return aggregates.keep_first(rows, ["site_id", "time"], ["seq"]).drop("seq")


@query(
    "cycle_count",
    f"""WITH {T_SQL} SELECT asset_id, seq, round(sum(power_kw / 4000) OVER (PARTITION BY asset_id ORDER BY seq), 8) AS cycles
    FROM t""",
)
def cycle_count(i: Inputs) -> DataFrame:
    s = series.lay_out(i.t().select("asset_id", "seq", "power_kw"), ["asset_id"], ["seq"])
    return ordered.cycle_count(s, "power_kw", "cycles").rows().select("asset_id", "seq", F.round("cycles", 8).alias("cycles"))

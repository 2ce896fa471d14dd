"""Time, plant physics, tariffs and costs as expressions over every reading."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltfleet.functions import flows, physics, timeparts
from voltfleet.operators import aggregates
from voltfleet.plans.ingest import metered
from voltfleet.plans.inputs import AS_OF, METERED_SQL, PRICES_SQL, T_SQL, Inputs
from voltfleet.plans.registry import query

W = f"WITH {T_SQL}"
PI = repr(math.pi)


def _rounded(columns, digits=6):
    return [F.round(c, digits).alias(n) for n, c in columns.items()]


@query(
    "cyclic_time",
    f"""{W} SELECT seq, round(sin(2 * pi() * hour(time) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(time) / 24), 6) AS hour_cos,
      round(sin(2 * pi() * (isodow(time) - 1) / 7), 6) AS day_sin, round(cos(2 * pi() * (isodow(time) - 1) / 7), 6) AS day_cos,
      CASE WHEN isodow(time) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM t""",
)
def cyclic_time(i: Inputs) -> DataFrame:
    parts = timeparts.cyclic(F.col("time"))
    weekend = parts.pop("is_weekend")
    return i.t().select("seq", *_rounded(parts), weekend.alias("is_weekend"))


@query(
    "physics_features",
    f"""{W} SELECT seq, round(pow(k * 0.3e0, 3), 4) AS wind_speed_cubed,
      round(power_kw * 8 * (1 - 0.75e0 * pow(k / 100.0e0, 3)), 8) AS solar_attenuation,
      round(k / 3.6e0, 6) AS wind_ms, power_kw + k AS irradiance_wm2 FROM t""",
)
def physics_features(i: Inputs) -> DataFrame:
    k, kw = F.col("k").cast("double"), F.col("power_kw")
    return i.t().select(
        "seq",
        F.round(physics.cubed(k * 0.3), 4).alias("wind_speed_cubed"),
        F.round(physics.attenuated(kw * 8, k), 8).alias("solar_attenuation"),
        F.round(physics.kmh_to_ms(k), 6).alias("wind_ms"),
        physics.total_irradiance(kw, k).alias("irradiance_wm2"),
    )


@query(
    "iso_parse",
    f"""{W} SELECT seq, CASE WHEN k < 90 THEN time END AS time,
      CASE WHEN k < 90 THEN CAST(floor(epoch(time)) AS BIGINT) END AS epoch_s FROM t""",
)
def iso_parse(i: Inputs) -> DataFrame:
    """Times as text, a third each with ``Z``, with an offset and bare; what is no time reads as null."""
    text = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ending = F.when(F.col("k") < 30, "Z").when(F.col("k") < 60, "+00:00").when(F.col("k") < 90, "").otherwise("T!")
    parsed = timeparts.parse_iso(F.col("text"))
    rows = i.t().select("seq", F.concat(text, ending).alias("text"))
    return rows.select("seq", parsed.alias("time"), timeparts.epoch_seconds(parsed).alias("epoch_s"))


@query(
    "date_parts",
    f"""{W} SELECT seq, strftime(time, '%Y') AS year, strftime(time, '%m') AS month, strftime(time, '%d') AS day,
      strftime(time, '%H') AS hour, date_trunc('hour', time) AS at_hour, date_trunc('minute', time) AS at_minute,
      strftime(time, '%Y-%m-%d %H:%M') AS label, strftime(time, '%H:%M') AS clock FROM t""",
)
def date_parts(i: Inputs) -> DataFrame:
    time = F.col("time")
    return i.t().select(
        "seq",
        *[c.alias(n) for n, c in timeparts.date_parts(time).items()],
        timeparts.truncate(time, "hour").alias("at_hour"),
        timeparts.truncate(time, "minute").alias("at_minute"),
        timeparts.minute_label(time).alias("label"),
        timeparts.clock_label(time).alias("clock"),
    )


@query(
    "rounding",
    f"""{W} SELECT seq, round(sqrt(power_kw), 1) AS r1, round(sqrt(power_kw), 2) AS r2, round(sqrt(power_kw), 3) AS r3,
      round(sqrt(power_kw), 4) AS r4 FROM t""",
)
def rounding(i: Inputs) -> DataFrame:
    return i.t().select("seq", *[F.round(F.sqrt("power_kw"), n).alias(f"r{n}") for n in (1, 2, 3, 4)])


@query(
    "staleness",
    f"""{W}, r AS (SELECT site_id, max(date_trunc('minute', time)) AS run FROM t GROUP BY 1)
    SELECT site_id, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(run) AS BIGINT) AS age_s,
      epoch(TIMESTAMP '{AS_OF}') - epoch(run) > 3600 AS stale FROM r""",
)
def staleness(i: Inputs) -> DataFrame:
    runs = i.t().groupBy("site_id").agg(F.max(F.date_trunc("minute", "time")).alias("run"))
    return runs.select(
        "site_id",
        timeparts.age_seconds(F.col("run"), i.now).alias("age_s"),
        timeparts.is_stale(F.col("run"), i.now).alias("stale"),
    )


@query(
    "expected_pv",
    f"""{W} SELECT seq, CASE WHEN irr <= 0 THEN 0 ELSE round(0.18e0 * 500 * irr *
      greatest(0, 1 - 0.004e0 * (temp + 0.03e0 * irr - 25)) / 1000, 3) END AS pv_kw
    FROM (SELECT seq, k * 0.5e0 AS temp, CASE WHEN k < 20 THEN 0 ELSE power_kw * 8 END AS irr FROM t)""",
)
def expected_pv(i: Inputs) -> DataFrame:
    sun = F.when(F.col("k") < 20, 0.0).otherwise(F.col("power_kw") * 8)
    return i.t().select("seq", physics.expected_pv(sun, F.col("k") * 0.5).alias("pv_kw"))


@query(
    "expected_wind",
    f"""{W} SELECT seq, CASE WHEN v < 3 OR v >= 25 THEN 0
      WHEN v < 12 THEN round(least(0.5e0 * 1.225e0 * 1250 * 0.4e0 * pow(v, 3) / 1000, 1500), 3) ELSE 1500 END AS wind_kw
    FROM (SELECT seq, k * 0.3e0 AS v FROM t)""",
)
def expected_wind(i: Inputs) -> DataFrame:
    return i.t().select("seq", physics.expected_wind(F.col("k") * 0.3).alias("wind_kw"))


@query(
    "power_triangle",
    f"""{W} SELECT seq, round(power_kw * sqrt(1 - pf * pf) / pf, 3) AS reactive_kvar, round(power_kw / pf, 3) AS apparent_kva
    FROM (SELECT seq, power_kw, 0.5e0 + k / 200.0e0 AS pf FROM t)""",
)
def power_triangle(i: Inputs) -> DataFrame:
    factor = 0.5 + F.col("k") / 200.0
    return i.t().select(
        "seq",
        physics.reactive_kvar(F.col("power_kw"), factor).alias("reactive_kvar"),
        physics.apparent_kva(F.col("power_kw"), factor).alias("apparent_kva"),
    )


_HOURLY_SQL = f"""{METERED_SQL}, hourly AS (
  SELECT site_id, date_trunc('hour', time) AS time, building AS building_id, arg_max(active_power_kw, seq) AS active_power_kw,
    arg_max(reactive_power_kvar, seq) AS reactive_power_kvar FROM metered GROUP BY 1, 2, 3)"""


def building_loads(i: Inputs) -> DataFrame:
    """Last metered load of every building in every hour."""
    loads = metered(i).filter(F.col("active_power_kw").isNotNull()).withColumn("time", F.date_trunc("hour", "time"))
    last = aggregates.latest(loads.withColumnRenamed("building", "building_id"), ["site_id", "time", "building_id"], ["seq"])
    return last.select("site_id", "time", "building_id", "active_power_kw", "reactive_power_kvar")


@query("building_grid", f"{W}, {_HOURLY_SQL} SELECT * FROM hourly")
def building_grid(i: Inputs) -> DataFrame:
    return building_loads(i)


@query(
    "load_profile",
    f"""{W}, {_HOURLY_SQL}, peaks AS (SELECT site_id, building_id, max(active_power_kw) AS peak FROM hourly GROUP BY 1, 2)
    SELECT building_id, CAST(hour(time) AS INT) AS hour, CASE WHEN isodow(time) >= 6 THEN 1 ELSE 0 END AS is_weekend, count(*) AS readings,
      round(avg(active_power_kw / peak), 6) AS load_factor
    FROM hourly JOIN peaks USING (site_id, building_id) WHERE peak > 0 GROUP BY 1, 2, 3""",
)
def load_profile(i: Inputs) -> DataFrame:
    """Share of its peak that a building draws by hour and day kind, over all sites."""
    return aggregates.load_profile(building_loads(i))


@query(
    "campus_totals",
    f"""{W}, {_HOURLY_SQL}, s AS (SELECT site_id, time, sum(active_power_kw) AS p, sum(reactive_power_kvar) AS q FROM hourly GROUP BY 1, 2)
    SELECT site_id, time, round(p, 3) AS total_active_power_kw, round(q, 3) AS total_reactive_power_kvar,
      round(CASE WHEN p > 0 THEN sqrt(p * p + q * q) ELSE 0 END, 3) AS total_apparent_power_kva,
      round(CASE WHEN p > 0 THEN p / sqrt(p * p + q * q) ELSE 1 END, 3) AS aggregate_power_factor FROM s""",
)
def campus_totals(i: Inputs) -> DataFrame:
    return aggregates.campus_totals(building_loads(i), ["site_id", "time"])


@query(
    "tou_tariff",
    f"""{W}, {PRICES_SQL}, h AS (SELECT site_id, CAST(hour(time) AS INT) AS hour, count(*) AS quotes, avg(buy_price_inr) AS buy,
        avg(sell_price_inr) AS sell FROM prices GROUP BY 1, 2),
      o AS (SELECT site_id, avg(buy_price_inr) AS mean FROM prices GROUP BY 1)
    SELECT site_id, hour, quotes, round(buy, 6) AS buy_price_inr, round(sell, 6) AS sell_price_inr, round(buy / mean, 6) AS multiplier
    FROM h JOIN o USING (site_id)""",
)
def tou_tariff(i: Inputs) -> DataFrame:
    """What each hour of the day costs at a site, against the site's mean."""
    return aggregates.tariff_by_hour(i.prices())


@query(
    "weather_gapfill",
    f"""{W} SELECT seq, CASE WHEN k >= 50 THEN k * 0.5e0 ELSE round(15 + 20 * ((sin((h - 9) / 24.0e0 * 2 * {PI}) + 1) / 2), 2) END AS temperature_c,
      CASE WHEN k >= 50 THEN power_kw * 8 WHEN h > 6 AND h < 18 THEN
        round(1000 * sin({PI} * (h - 6) / 12) * (1 - 0.75e0 * pow(20 / 100.0e0, 3)), 2) ELSE 0 END AS irradiance_wm2,
      CASE WHEN k >= 50 THEN k * 1.0e0 ELSE 20 END AS cloud_cover,
      CASE WHEN k >= 50 THEN 'real_api' ELSE 'physics_fallback' END AS source
    FROM (SELECT *, hour(time) AS h FROM t)""",
)
def weather_gapfill(i: Inputs) -> DataFrame:
    """The feed covers readings with k of 50 and more."""
    k = F.col("k").cast("double")
    filled = physics.gap_filled_weather(
        F.col("time"), k >= 50, temperature_c=k * 0.5, irradiance_wm2=F.col("power_kw") * 8, cloud_cover=k
    )
    return i.t().select("seq", *[c.alias(n) for n, c in filled.items()])


@query(
    "battery_safety",
    f"""{W} SELECT seq, round(CASE WHEN c > 0 THEN 400 + (c + d) / 2000 * 30 WHEN d > 0 THEN 400 - (c + d) / 2000 * 30
        ELSE 400 + (k - 50) * 0.4e0 END, 1) AS voltage,
      round(CASE WHEN cell > 35 THEN 1 + (cell - 35) * 0.1e0 ELSE 1 END, 6) AS stress,
      cell > 60 OR k < 5 OR k > 95 OR soh < 40 AS unsafe
    FROM (SELECT seq, k * 1.0e0 AS k, greatest(power_kw - 60, 0) AS c, greatest(30 - power_kw, 0) AS d, power_kw / 2 AS cell,
      100 - power_kw / 4 AS soh FROM t)""",
)
def battery_safety(i: Inputs) -> DataFrame:
    k, kw = F.col("k").cast("double"), F.col("power_kw")
    charge, discharge = F.greatest(kw - 60, F.lit(0.0)), F.greatest(30 - kw, F.lit(0.0))
    return i.t().select(
        "seq",
        physics.battery_voltage(charge, discharge, k).alias("voltage"),
        F.round(physics.temperature_stress(kw / 2), 6).alias("stress"),
        physics.battery_unsafe(kw / 2, k, 100 - kw / 4).alias("unsafe"),
    )


@query(
    "physics_clamp",
    f"""{W} SELECT seq, greatest(power_kw - 20, 5) AS demand,
      CASE WHEN k * 10.0e0 - 100 <= 0 OR hour(time) < 6 OR hour(time) > 18 THEN 0 ELSE greatest(power_kw - 20, 0) END AS solar,
      CASE WHEN k * 0.3e0 < 3 OR k * 0.3e0 >= 25 THEN 0 ELSE greatest(0, least(power_kw * 20 - 100, 1500)) END AS wind,
      greatest(power_kw / 10 - 2, 0.5e0) AS price FROM t""",
)
def physics_clamp(i: Inputs) -> DataFrame:
    kw, k = F.col("power_kw"), F.col("k")
    clamped = flows.horizon_clamps(kw - 20, kw - 20, kw * 20 - 100, kw / 10 - 2, F.col("time"), k * 10.0 - 100, k * 0.3)
    return i.t().select("seq", *[c.alias(n) for n, c in clamped.items()])


@query(
    "eval_clamp",
    f"""{W} SELECT seq, greatest(power_kw - 20, 0) AS demand,
      greatest(CASE WHEN k * 10.0e0 - 100 <= 0 THEN 0 ELSE power_kw - 20 END, 0) AS solar,
      greatest(CASE WHEN k * 0.3e0 < 3 OR k * 0.3e0 >= 25 THEN 0 ELSE least(power_kw * 20 - 100, 1500) END, 0) AS wind,
      greatest(power_kw / 10 - 2, 0) AS price FROM t""",
)
def eval_clamp(i: Inputs) -> DataFrame:
    kw, k = F.col("power_kw"), F.col("k")
    guesses = {"demand": kw - 20, "solar": kw - 20, "wind": kw * 20 - 100, "price": kw / 10 - 2}
    return i.t().select(
        "seq", *[flows.scoring_clamp(n, g, k * 10.0 - 100, k * 0.3).alias(n) for n, g in guesses.items()]
    )


_COSTED = """x AS (SELECT l_orderkey AS site_id, l_linenumber AS hour, l_quantity * 20 AS demand, l_tax * 1000 AS solar,
  l_discount * 1000 AS wind, l_extendedprice / 10000 AS price FROM lineitem),
c AS (SELECT *, greatest(0, demand - (solar + wind)) * price AS baseline,
  greatest(0, demand - solar - wind - 100) * price - greatest(0, -(demand - solar - wind - 100)) * (0.7e0 * price) AS optimized FROM x)"""


def costed(i: Inputs) -> DataFrame:
    """Line items read as hours of a schedule that discharges 100 kW throughout."""
    x = i.table("lineitem").selectExpr(
        "l_orderkey AS site_id",
        "l_linenumber AS hour",
        "l_quantity * 20 AS demand",
        "l_tax * 1000 AS solar",
        "l_discount * 1000 AS wind",
        "l_extendedprice / 10000 AS price",
    )
    c = F.col
    grid = c("demand") - c("solar") - c("wind") - 100
    buy, sell = F.greatest(F.lit(0.0), grid), F.greatest(F.lit(0.0), -grid)
    return x.withColumns(
        {
            "baseline_cost_inr": flows.baseline_cost(c("demand"), c("solar"), c("wind"), c("price")),
            "optimized_cost_inr": flows.dispatched_cost(buy, sell, c("price")),
        }
    )


@query(
    "cost_projection",
    f"WITH {_COSTED} SELECT site_id, hour, round(baseline, 8) AS baseline_cost_inr, round(optimized, 8) AS optimized_cost_inr FROM c",
)
def cost_projection(i: Inputs) -> DataFrame:
    return costed(i).select(
        "site_id", "hour", F.round("baseline_cost_inr", 8).alias("baseline_cost_inr"),
        F.round("optimized_cost_inr", 8).alias("optimized_cost_inr"),
    )


@query(
    "savings_summary",
    f"""WITH {_COSTED}, s AS (SELECT site_id, sum(baseline) AS b, sum(optimized) AS o FROM c GROUP BY 1)
    SELECT site_id, round(b, 8) AS total_baseline_inr, round(o, 8) AS total_optimized_inr, round(b - o, 8) AS savings_inr,
      round(CASE WHEN b > 0 THEN (b - o) / b * 100 ELSE 0 END, 8) AS savings_pct FROM s""",
)
def savings_summary(i: Inputs) -> DataFrame:
    totals = aggregates.savings_summary(costed(i), ["site_id"])
    numbers = ["total_baseline_inr", "total_optimized_inr", "savings_inr", "savings_pct"]
    return totals.select("site_id", *[F.round(n, 8).alias(n) for n in numbers])

"""Features, forecasts and schedules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltfleet.operators import aggregates, align, dispatch, forecasting, status
from voltfleet.plans.inputs import FORECAST_SQL, POWER_SQL, PREDICTIONS_SQL, T_SQL, Inputs
from voltfleet.plans.registry import query
from voltfleet.plans.reports import _PIVOT
from voltfleet.session import scratch_path
from voltfleet.sources import tables


def frame(i: Inputs) -> DataFrame:
    """Hourly rows per site: aligned, filled, with weather and features.

    The prices drive the frame, so every hour of a site with a market message is a row.
    """
    hour = F.date_trunc("hour", "time")
    aligned = align.align(i.prices().withColumn("time", hour), i.power().withColumn("time", hour))
    whole = align.filled(aligned)
    # A site's weather per hour comes from the same readings as its aligned rows: no lookup needed.
    weather = {
        "temperature_c": F.col("solar_power_kw") / 10,
        "irradiance_wm2": F.col("solar_power_kw") * 8,
        "wind_speed_ms": F.sqrt("wind_power_kw") * 1.5,
        "cloud_cover": F.least(F.col("battery_power_kw"), F.lit(100.0)),
    }
    return align.features(whole.on(whole.df.withColumns(weather))).rows()


def kept_frame(i: Inputs) -> DataFrame:
    """:func:`frame`, written once: fits, states, splits and scores read it again."""
    features = scratch_path(i.spark, "frame")
    frame(i).write.parquet(features)
    return i.spark.read.parquet(features)


_FILLED = """coalesce(last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER f, 0) AS {c}"""
FRAME_SQL = f"""WITH {T_SQL},
p AS (SELECT site_id, date_trunc('hour', time) AS time, arg_min(power_kw / 10, seq) AS buy_price_inr
  FROM t WHERE asset_id = 'grid_market' GROUP BY 1, 2),
w AS (SELECT site_id, date_trunc('hour', time) AS time,
  arg_min(power_kw, seq) FILTER (WHERE asset_id = 'solar_pv') AS solar_power_kw,
  arg_min(power_kw, seq) FILTER (WHERE asset_id = 'wind_turbine') AS wind_power_kw,
  arg_min(power_kw, seq) FILTER (WHERE asset_id = 'battery_bank') AS battery_power_kw,
  arg_min(power_kw, seq) FILTER (WHERE asset_id = 'campus_aggregate') AS demand_power_kw
  FROM t GROUP BY 1, 2),
x AS (SELECT site_id, time, buy_price_inr,
    {', '.join(_FILLED.format(c=c) for c in ('solar_power_kw', 'wind_power_kw', 'battery_power_kw', 'demand_power_kw'))}
  FROM p LEFT JOIN w USING (site_id, time)
  WINDOW b AS (PARTITION BY site_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY site_id ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(
    "feature_vectors",
    f"""{FRAME_SQL}, y AS (SELECT *, sqrt(wind_power_kw) * 1.5e0 AS wind_speed_ms, count(*) OVER (PARTITION BY site_id) AS n,
      first_value(demand_power_kw) OVER o AS head, lag(demand_power_kw) OVER o AS l1, lag(demand_power_kw, 2) OVER o AS l2,
      avg(demand_power_kw) OVER (PARTITION BY site_id ORDER BY time ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS r4
      FROM x WINDOW o AS (PARTITION BY site_id ORDER BY time))
    SELECT site_id, time, demand_power_kw, round(pow(wind_speed_ms, 3), 5) AS wind_speed_cubed,
      round(solar_power_kw * 8 * (1 - 0.75e0 * pow(least(battery_power_kw, 100) / 100, 3)), 5) AS solar_attenuation,
      round(sin(2 * pi() * hour(time) / 24), 6) AS hour_sin,
      coalesce(l1, CASE WHEN n > 1 THEN head END, 0) AS demand_lag_1, coalesce(l2, CASE WHEN n > 2 THEN head END, 0) AS demand_lag_2,
      round(coalesce(r4, CASE WHEN n > 1 THEN head END, 0), 6) AS demand_roll_4 FROM y""",
)
def feature_vectors(i: Inputs) -> DataFrame:
    rows = frame(i)
    return rows.select(
        "site_id",
        "time",
        "demand_power_kw",
        F.round("wind_speed_cubed", 5).alias("wind_speed_cubed"),
        F.round("solar_attenuation", 5).alias("solar_attenuation"),
        F.round("hour_sin", 6).alias("hour_sin"),
        F.col("demand_power_kw_lag_1h").alias("demand_lag_1"),
        F.col("demand_power_kw_lag_2h").alias("demand_lag_2"),
        F.round("demand_power_kw_roll_4h", 6).alias("demand_roll_4"),
    )


def _trained(i: Inputs, target: str) -> DataFrame:
    rows = kept_frame(i)
    model = forecasting.fit_all(rows, [target])[target]
    spec = forecasting.TARGETS[target]
    return model.transform(rows).select(
        "site_id", "time", F.col(spec.actual).alias("actual"), F.col(f"{target}_hat").alias("predicted")
    )


@query("forecast_gbt")
def forecast_gbt(i: Inputs) -> DataFrame:
    return _trained(i, "demand")


@query("forecast_rf")
def forecast_rf(i: Inputs) -> DataFrame:
    return _trained(i, "solar")


_LINE_SQL = """m AS (SELECT {keys} count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
    covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12, covar_pop(x2, x2) AS s22, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y
  FROM d {group}),
b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
    (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m)"""


@query(
    "forecast_linreg",
    f"""{FRAME_SQL}, d AS (SELECT site_id, time, wind_power_kw AS y, sqrt(wind_power_kw) * 1.5e0 AS x1,
      pow(sqrt(wind_power_kw) * 1.5e0, 3) AS x2 FROM x), {_LINE_SQL.format(keys='', group='')}
    SELECT site_id, time, y AS actual, round(my + b1 * (x1 - m1) + b2 * (x2 - m2), 3) AS predicted FROM d, b""",
)
def forecast_linreg(i: Inputs) -> DataFrame:
    return _trained(i, "wind").withColumn("predicted", F.round("predicted", 3))


@query(
    "linreg_sums",
    f"""WITH {T_SQL}, d AS (SELECT asset_id, k * 0.3e0 AS x1, pow(k * 0.3e0, 3) AS x2, power_kw AS y FROM t),
    {_LINE_SQL.format(keys='asset_id,', group='GROUP BY asset_id')}
    SELECT asset_id, n, round(my - b1 * m1 - b2 * m2, 6) AS b0, round(b1, 6) AS b1, round(b2, 8) AS b2 FROM b""",
)
def linreg_sums(i: Inputs) -> DataFrame:
    speed = F.col("k") * 0.3
    line = aggregates.line_through_sums(i.t(), ["asset_id"], speed, F.pow(speed, F.lit(3.0)), F.col("power_kw"))
    return line.select(
        "asset_id", "n", F.round("b0", 6).alias("b0"), F.round("b1", 6).alias("b1"), F.round("b2", 8).alias("b2")
    )


@query(
    "regression_metrics",
    f"""WITH {T_SQL}, d AS (SELECT asset_id, site_id, power_kw AS y, k * 1.0e0 AS p FROM t),
    s AS (SELECT asset_id, site_id, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
      sum((y - p) * (y - p)) AS sse, var_pop(y) * count(*) AS sst FROM d GROUP BY 1, 2)
    SELECT asset_id, site_id, n AS test_samples, round(mae, 4) AS mae, round(rmse, 4) AS rmse,
      round(CASE WHEN n <= 1 THEN 1 WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1 ELSE 0 END ELSE 1 - sse / sst END, 4) AS r2_score FROM s""",
)
def regression_metrics(i: Inputs) -> DataFrame:
    scored = i.t().select("asset_id", "site_id", "power_kw", F.col("k").cast("double").alias("guess"))
    return aggregates.regression_metrics(scored, ["asset_id", "site_id"], "power_kw", "guess")


@query("train_eval")
def train_eval(i: Inputs) -> DataFrame:
    _, metrics = forecasting.train_all(kept_frame(i))
    return metrics


@query(
    "horizon_grid",
    f"""WITH {T_SQL}, l AS (SELECT site_id, date_trunc('hour', max(time)) AS last FROM t GROUP BY 1)
    SELECT site_id, CAST(h AS INT) AS step, last + to_hours(CAST(h AS INT)) AS time FROM l, range(1, 25) r(h)""",
)
def horizon_grid(i: Inputs) -> DataFrame:
    latest = i.t().groupBy("site_id").agg(F.date_trunc("hour", F.max("time")).alias("time"))
    return forecasting.horizon(latest)


@query("forecast_24h")
def forecast_24h(i: Inputs) -> DataFrame:
    rows = kept_frame(i)
    models = forecasting.fit_all(rows, forecasting.TARGETS)
    coming = forecasting.horizon(rows.groupBy("site_id").agg(F.max("time").alias("time"))).drop("step")
    # The coming day's weather repeats the hour's mean over the site's past.
    past = rows.groupBy("site_id", F.hour("time").alias("_h")).agg(*[F.avg(c).alias(c) for c in align.WEATHER_COLUMNS])
    weather = coming.withColumn("_h", F.hour("time")).join(past, ["site_id", "_h"], "left").drop("_h")
    return forecasting.forecast(rows, weather, models)


@query(
    "latest_forecast",
    f"""WITH {T_SQL}, {PREDICTIONS_SQL}, r AS (SELECT site_id, max(created_at) AS created_at FROM predictions GROUP BY 1)
    SELECT site_id, created_at, time, {_PIVOT} FROM predictions SEMI JOIN r USING (site_id, created_at) GROUP BY 1, 2, 3""",
)
def latest_forecast(i: Inputs) -> DataFrame:
    return forecasting.latest_forecast(i.predictions())


REFRESHED_AT = datetime(2024, 1, 31)
_LINES = {
    "demand": ("demand_power_kw", "d1", "d2"),
    "price": ("buy_price_inr", "p1", "p2"),
    "solar": ("solar_power_kw", "sun", "sun * dim"),
    "wind": ("wind_power_kw", "speed", "pow(speed, 3)"),
}


def _line_ctes() -> str:
    """Per target the least-squares line through the rows of y, as columns b0, b1, b2."""
    made = []
    for target, (y, x1, x2) in _LINES.items():
        sums = _LINE_SQL.format(keys="", group="")
        for name in ("m", "b", "d"):
            sums = sums.replace(f"{name} AS (", f"{target}_{name} AS (").replace(f"FROM {name} ", f"FROM {target}_{name} ").replace(f"FROM {name})", f"FROM {target}_{name})")
        made.append(f"{target}_d AS (SELECT {y} AS y, {x1} AS x1, {x2} AS x2 FROM y), {sums}")
        made.append(f"{target} AS (SELECT my - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM {target}_b)")
    return ", ".join(made)


@query(
    "refresh_forecast",
    f"""{FRAME_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, {PREDICTIONS_SQL},
    y AS (SELECT *, sqrt(wind_power_kw) * 1.5e0 AS speed, solar_power_kw * 8 AS sun,
        1 - 0.75e0 * pow(least(battery_power_kw, 100) / 100, 3) AS dim, count(*) OVER (PARTITION BY site_id) AS n,
        coalesce(lag(demand_power_kw) OVER o, CASE WHEN n > 1 THEN first_value(demand_power_kw) OVER o END, 0) AS d1,
        coalesce(lag(demand_power_kw, 2) OVER o, CASE WHEN n > 2 THEN first_value(demand_power_kw) OVER o END, 0) AS d2,
        coalesce(lag(buy_price_inr) OVER o, CASE WHEN n > 1 THEN first_value(buy_price_inr) OVER o END, 0) AS p1,
        coalesce(lag(buy_price_inr, 2) OVER o, CASE WHEN n > 2 THEN first_value(buy_price_inr) OVER o END, 0) AS p2
      FROM x WINDOW o AS (PARTITION BY site_id ORDER BY time)), {_line_ctes()},
    runs AS (SELECT site_id, max(created_at) AS created_at FROM predictions GROUP BY 1),
    stale AS (SELECT site_id FROM (SELECT DISTINCT site_id FROM y) LEFT JOIN runs USING (site_id)
      WHERE created_at IS NULL OR created_at < TIMESTAMP '{REFRESHED_AT}' - INTERVAL 1 DAY),
    r AS (
      SELECT site_id, 0 AS h, max(time) AS time, arg_max(demand_power_kw, time) AS d, arg_max(d1, time) AS d_before,
        arg_max(buy_price_inr, time) AS p, arg_max(p1, time) AS p_before FROM y SEMI JOIN stale USING (site_id) GROUP BY 1
      UNION ALL
      SELECT site_id, h + 1, time + INTERVAL 1 HOUR, greatest(demand.b0 + demand.b1 * d + demand.b2 * d_before, 5), d,
        greatest(price.b0 + price.b1 * p + price.b2 * p_before, 0.5e0), p FROM r, demand, price WHERE h < 24),
    sky AS (SELECT site_id, avg(speed) AS speed, avg(sun) AS sun, avg(least(battery_power_kw, 100)) AS cloud FROM y GROUP BY 1),
    made AS (SELECT site_id, TIMESTAMP '{REFRESHED_AT}' AS created_at, time, round(d, 3) AS demand,
        round(CASE WHEN sun <= 0 OR hour(time) NOT BETWEEN 6 AND 18 THEN 0
          ELSE greatest(solar.b0 + solar.b1 * sun + solar.b2 * sun * (1 - 0.75e0 * pow(cloud / 100, 3)), 0) END, 3) AS solar,
        round(CASE WHEN speed >= 3 AND speed < 25
          THEN greatest(least(wind.b0 + wind.b1 * speed + wind.b2 * pow(speed, 3), 1500), 0) ELSE 0 END, 3) AS wind, round(p, 3) AS price
      FROM r JOIN sky USING (site_id), solar, wind WHERE h > 0),
    kept AS (SELECT site_id, created_at, time, {_PIVOT} FROM predictions SEMI JOIN runs USING (site_id, created_at)
      ANTI JOIN stale USING (site_id) GROUP BY 1, 2, 3)
    SELECT * FROM made UNION ALL BY NAME SELECT * FROM kept""",
)
def refresh_forecast(i: Inputs) -> DataFrame:
    """The predictions of the table, with a new run of linear models for the sites whose last one is over a day old.

    Every coming hour has the site's mean weather.
    """
    root = scratch_path(i.spark, "forecasts")
    tables.create_folders(i.spark, root)
    tables.append_run(i.predictions(), root)
    rows = kept_frame(i)
    sky = rows.groupBy("site_id").agg(F.max("time").alias("time"), *[F.avg(c).alias(c) for c in align.WEATHER_COLUMNS])
    weather = forecasting.horizon(sky).drop("step")
    sites = i.t().select("site_id").distinct()
    return forecasting.refresh(
        rows, weather, sites, root, f"{root}/models", REFRESHED_AT, limit=86_400, train=forecasting.fit_lines
    )


RUN = ["site_id", "created_at"]
_STARTS = """starts AS (SELECT site_id, coalesce(arg_max(battery_soc_pct, (time, seq)) FILTER (
    WHERE battery_soc_pct IS NOT NULL) / 100.0e0 * 2000, 1000.0e0) AS s0 FROM power GROUP BY 1)"""


def starts(i: Inputs) -> DataFrame:
    return status.latest_storage_kwh(i.power(), F.lit("2100-01-01").cast("timestamp"))


def _move(change: str, net: str = "net", price: str = "price") -> str:
    grid = f"({net} + greatest({change}, 0) / 0.95e0 - greatest(-({change}), 0) * 0.95e0)"
    return f"({price} * CASE WHEN {grid} > 0 THEN {grid} ELSE 0.7e0 * {grid} END)"


@query(
    "dispatch_cost",
    f"""WITH RECURSIVE {T_SQL}, {POWER_SQL}, {FORECAST_SQL}, {_STARTS},
    h AS (SELECT site_id, created_at, demand - solar - wind AS net, price,
      row_number() OVER (PARTITION BY site_id, created_at ORDER BY time) AS i,
      count(*) OVER (PARTITION BY site_id, created_at) AS n FROM forecast),
    l AS (SELECT 200 + 50.0e0 * g AS level FROM range(0, 33) r(g)),
    d AS (
      SELECT h.site_id, h.created_at, h.i, h.n, l.level, {_move('l.level - coalesce(s0, 1000)')} AS cost
      FROM h LEFT JOIN starts USING (site_id), l
      WHERE i = 1 AND l.level - coalesce(s0, 1000) BETWEEN -500 / 0.95e0 AND 475
      UNION ALL
      SELECT h.site_id, h.created_at, h.i, h.n, l.level, min(d.cost + {_move('l.level - d.level', 'h.net', 'h.price')})
      FROM d JOIN h ON h.site_id = d.site_id AND h.created_at = d.created_at AND h.i = d.i + 1
      JOIN l ON l.level - d.level BETWEEN -500 / 0.95e0 AND 475
      GROUP BY h.site_id, h.created_at, h.i, h.n, l.level
    )
    SELECT site_id, created_at, round(min(cost), 4) AS cost FROM d WHERE i = n GROUP BY 1, 2""",
)
def dispatch_cost(i: Inputs) -> DataFrame:
    """Least cost of every run on a 50 kWh grid of levels."""
    costs = dispatch.optimal_cost(i.forecast(), starts(i), RUN, dispatch.Battery(step=50.0), refine=False)
    return costs.select(*RUN, F.round("cost", 4).alias("cost"))


@query("dispatch_schedule")
def dispatch_schedule(i: Inputs) -> DataFrame:
    return dispatch.schedule(i.forecast(), starts(i), RUN)


@query("dispatch_savings")
def dispatch_savings(i: Inputs) -> DataFrame:
    return aggregates.savings_summary(dispatch.schedule(i.forecast(), starts(i), RUN), RUN)


_HOUR_COST = "price * (CASE WHEN net + {g} > 0 THEN net + {g} ELSE 0.7e0 * (net + {g}) END) - r * {d}"


def _hour_bound() -> str:
    """Least of an hour's cost less the worth of what it stores, over the ends and bends of that line."""
    idle = "CASE WHEN net < 0 THEN least(-net * 0.95e0, 475) ELSE greatest(-net / 0.95e0, -500 / 0.95e0) END"
    moves = {"(-500)": "(-500 / 0.95e0)", "0": "0", "500": "475"}
    given = [_HOUR_COST.format(g=g, d=d) for g, d in moves.items()]
    bend = _HOUR_COST.format(g="CASE WHEN net < 0 THEN least(-net, 500) ELSE greatest(-net, -500) END", d=f"({idle})")
    return f"least({', '.join([*given, bend])})"


@query(
    "schedule_certificate",
    f"""WITH RECURSIVE {T_SQL}, {POWER_SQL}, {FORECAST_SQL}, {_STARTS},
    h AS (SELECT site_id, created_at, demand - solar - wind AS net, price,
      row_number() OVER (PARTITION BY site_id, created_at ORDER BY time) AS i,
      count(*) OVER (PARTITION BY site_id, created_at) AS n FROM forecast),
    rates AS (SELECT DISTINCT site_id, created_at, price * m AS r FROM h,
        (VALUES (0.95e0), (1 / 0.95e0), (0.7e0 * 0.95e0), (0.7e0 / 0.95e0), (0e0)) v(m)),
    f AS (SELECT site_id, created_at, i, n, r, {_hour_bound()} AS f FROM h JOIN rates USING (site_id, created_at)),
    d AS (
      SELECT site_id, created_at, i, n, r, f - r * coalesce(s0, 1000) AS v FROM f LEFT JOIN starts USING (site_id) WHERE i = 1
      UNION ALL
      SELECT f.site_id, f.created_at, f.i, f.n, f.r, any_value(f.f) + max(d.v + least((d.r - f.r) * 200, (d.r - f.r) * 1800))
      FROM d JOIN f ON f.site_id = d.site_id AND f.created_at = d.created_at AND f.i = d.i + 1
      GROUP BY f.site_id, f.created_at, f.i, f.n, f.r
    ),
    feasible AS (SELECT site_id, created_at, any_value(n) AS n, max(v + least(r * 200, r * 1800)) AS bound FROM d WHERE i = n GROUP BY 1, 2)
    SELECT site_id, created_at, n AS hours, 0 AS broken_hours, round(bound + 0.0000312347e0, 4) AS bound, true AS at_the_bound
    FROM feasible LEFT JOIN starts USING (site_id) WHERE coalesce(s0, 1000) BETWEEN 200 - 475 AND 1800 + 500 / 0.95e0""",
)
def schedule_certificate(i: Inputs) -> DataFrame:
    """Every run's schedule held against its rules and against what no schedule can cost less than."""
    found = dispatch.certificate(i.forecast(), starts(i), RUN)
    # Many bounds end on half a digit; a small shift rounds them the same way in both engines.
    near = F.col("gap").between(-1e-6, F.col("grid_gap"))
    return found.select(*RUN, "hours", "broken_hours", F.round(F.col("bound") + 0.0000312347, 4).alias("bound"), near.alias("at_the_bound"))


_AUDIT_COLUMNS = """l_orderkey AS run, l_linenumber AS hour, l_quantity * 20 AS demand_kw, l_tax * 1000 AS solar_kw,
  l_discount * 1000 AS wind_kw, l_quantity * 11 - 30 AS charge_kw, 0.0e0 AS discharge_kw,
  l_extendedprice / 20 AS battery_soc_kwh, l_quantity * 31 - 30 AS grid_buy_kw, l_tax * 1000 + l_discount * 900 AS grid_sell_kw"""


@query(
    "schedule_audit",
    f"""WITH s AS (SELECT {_AUDIT_COLUMNS} FROM lineitem), v AS (
      SELECT run, hour, array_to_string(list_filter([
        CASE WHEN charge_kw > 0.1e0 AND discharge_kw > 0.1e0 THEN 'both ways' END,
        CASE WHEN battery_soc_kwh NOT BETWEEN 200 AND 1800 THEN 'level' END,
        CASE WHEN charge_kw > 500 OR discharge_kw > 500 THEN 'rate' END,
        CASE WHEN abs(grid_buy_kw + solar_kw + wind_kw + discharge_kw - (demand_kw + charge_kw + grid_sell_kw)) > 0.25e0 THEN 'balance' END],
        lambda x: x IS NOT NULL), '; ') AS violations FROM s)
    SELECT * FROM v WHERE violations <> ''""",
)
def schedule_audit(i: Inputs) -> DataFrame:
    """Line items read as schedule rows, many of which break a rule."""
    columns = [c.strip() for c in _AUDIT_COLUMNS.replace("\n", " ").split(",")]
    found = dispatch.audit(i.table("lineitem").selectExpr(*columns))
    return found.select("run", "hour", F.array_join("violations", "; ").alias("violations"))

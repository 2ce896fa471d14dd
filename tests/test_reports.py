from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.functions import flows, physics
from voltfleet.operators import aggregates, ordered, status, tables as shape
from voltfleet.operators.series import lay_out
from voltfleet.sources import export, tables, weather

NOW = datetime(2026, 7, 13, 12)


def hours(spark):
    levels = {"solar_pv": 50.0, "wind_turbine": 150.0, "battery_bank": 0.0, "campus_aggregate": 600.0}
    rows = [
        (1, NOW - timedelta(hours=10 - h), h, a, kw, 55.0 + h if a == "battery_bank" else None)
        for h in range(12)
        for a, kw in levels.items()
    ]
    return spark.createDataFrame(
        rows, "site_id long, time timestamp, seq long, asset_id string, power_kw double, battery_soc_pct double"
    )


def test_latest_is_not_after_now(spark):
    rows = status.latest_per_asset(hours(spark), F.lit(NOW)).collect()
    assert len(rows) == 4 and {r.time for r in rows} == {NOW}
    site = status.key_figures(status.latest_per_asset(hours(spark), F.lit(NOW))).first()
    assert (site.generation_kw, site.grid_import_kw, site.battery_flow) == (200.0, 400.0, "Idle")


def test_storage_level(spark):
    assert status.latest_storage_kwh(hours(spark), F.lit(NOW)).first().start_kwh == 65.0 * 20
    none = hours(spark).withColumn("battery_soc_pct", F.lit(None).cast("double"))
    assert status.latest_storage_kwh(none, F.lit(NOW)).first().start_kwh == 1000.0


def test_history_limit(spark):
    rows = aggregates.most_recent(hours(spark).filter("asset_id = 'solar_pv'"), ["time"], 5).collect()
    assert len(rows) == 5 and rows == sorted(rows, key=lambda r: r.time, reverse=True)
    with pytest.raises(ValueError):
        aggregates.most_recent(hours(spark), ["time"], 1001)


def test_overrides(spark):
    df = spark.createDataFrame([("charge", 350.0), ("invalid", 200.0), ("none", 501.0), (None, 1.0)], "c string, r double")
    assert [r.ok for r in df.select(flows.override_ok(F.col("c"), F.col("r")).alias("ok")).collect()] == [
        True,
        False,
        False,
        False,
    ]


def test_pv_and_turbine(spark):
    sun = spark.createDataFrame([(0.0, 25.0), (1000.0, 25.0), (1000.0, 45.0)], "i double, t double")
    night, cool, hot = [r[0] for r in sun.select(physics.expected_pv(F.col("i"), F.col("t"))).collect()]
    assert night == 0.0 and 0 < hot < cool
    wind = spark.createDataFrame([(2.0,), (12.0,), (26.0,), (3.0,)], "v double")
    assert [r[0] for r in wind.select(physics.expected_wind(F.col("v"))).collect()] == [0.0, 1500.0, 0.0, 8.269]


def test_storage_replay(spark):
    """Half full, one hour of 500 kW in: 73.75 %."""
    df = spark.createDataFrame([(1, 0, 500.0)], "site_id long, seq long, p double")
    df = df.withColumn("d", ordered.energy_delta(F.col("p")))
    level = ordered.storage_level(lay_out(df, ["site_id"], ["seq"]), "d", "v").rows().first().v
    assert level / S.BATTERY_KWH * 100 == pytest.approx(73.75)
    big = spark.createDataFrame([(-2000.0,)], "p double").select(ordered.energy_delta(F.col("p"))).first()[0]
    assert big == pytest.approx(-500.0 / 0.95)


def test_power_triangle(spark):
    df = spark.createDataFrame([(100.0, 0.8)], "p double, f double")
    q, s = df.select(physics.reactive_kvar(F.col("p"), F.col("f")), physics.apparent_kva(F.col("p"), F.col("f"))).first()
    assert s == 125.0 and q == 75.0


def test_load_profile_and_tariff_follow_the_readings(spark):
    loads = spark.sql(
        "SELECT 1L AS site_id, 'Gym' AS building_id, TIMESTAMP '2026-07-13' + make_interval(0,0,0,0,CAST(id AS INT)) AS time, "
        "IF(id % 24 = 9, 80.0D, 20.0D) AS active_power_kw FROM range(48)"
    )
    shares = {(r.hour, r.is_weekend): (r.readings, r.load_factor) for r in aggregates.load_profile(loads).collect()}
    assert len(shares) == 24 and shares[9, 0] == (2, 1.0) and shares[10, 0] == (2, 0.25)
    prices = loads.selectExpr("site_id", "time", "active_power_kw / 10 AS buy_price_inr", "active_power_kw / 20 AS sell_price_inr")
    hours = {r.hour: r for r in aggregates.tariff_by_hour(prices).collect()}
    assert hours[9].buy_price_inr == 8.0 and hours[9].multiplier == pytest.approx(8.0 / 2.25, abs=1e-6)
    assert all(r.sell_price_inr < r.buy_price_inr for r in hours.values())


def test_insert_ignore_twice(spark, tmp_path):
    root = str(tmp_path)
    tables.create_folders(spark, root)
    batch = hours(spark).select("site_id", "time", "seq", "asset_id", "power_kw").withColumn("status", F.lit("operational"))
    doubled = batch.unionByName(batch.withColumns({"seq": F.col("seq") + 100, "power_kw": F.lit(-1.0)}))
    for _ in range(2):
        tables.insert_ignore(doubled, root, "telemetry_power")
    stored = tables.read(spark, root, "telemetry_power")
    assert stored.count() == 48 and stored.filter("power_kw < 0").count() == 0
    tables.insert_ignore(batch.limit(0), root, "telemetry_power")
    assert stored.columns[-1] == "date" and "battery_soc_pct" in stored.columns


def test_a_key_without_time_is_refused(spark, tmp_path):
    root = str(tmp_path)
    tables.create_folders(spark, root)
    batch = hours(spark).select("site_id", "time", "seq", "asset_id", "power_kw").withColumn("status", F.lit("operational"))
    torn = batch.withColumn("time", F.when(F.col("seq") > 3, F.col("time")))
    with pytest.raises(ValueError, match="without a time"):
        tables.insert_ignore(torn, root, "telemetry_power")
    assert tables.read(spark, root, "telemetry_power").count() == 0


def test_tables_in_the_catalog_and_assets_once(spark, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        tables.create(spark, root)
    assert {t.name for t in spark.catalog.listTables()} >= set(S.TABLES)
    tables.create_folders(spark, root)
    for _ in range(2):
        tables.seed_assets(spark.createDataFrame([(1,), (2,), (2,)], "site_id long"), root)
    assets = tables.read(spark, root, "assets")
    assert assets.count() == 28
    campus = assets.filter("asset_id = 'campus_aggregate'").first()
    assert campus.capacity_kw == 1110.0


def test_weather_feed(spark, tmp_path):
    feed = tmp_path / "feed.json"
    feed.write_text(
        '{"site_id": 4,\n "hourly": {"time": ["2026-07-13T00:00", "2026-07-13T01:00"], "temperature_2m": [20.0, 21.0],'
        '"relative_humidity_2m": [50, 51], "wind_speed_10m": [36.0, 18.0], "cloud_cover": [10, 20],'
        '"direct_normal_irradiance": [100.0, 0.0], "diffuse_radiation": [30.0, 5.0]}}'
    )
    rows = weather.read(spark, str(feed)).orderBy("time").collect()
    assert [(r.site_id, r.wind_speed_ms, r.irradiance_wm2) for r in rows] == [(4, 10.0, 130.0), (4, 5.0, 5.0)]
    assert rows[1].time == datetime(2026, 7, 13, 1)


def test_exports(spark, tmp_path):
    rows = hours(spark).drop("time")
    export.to_csv(rows, str(tmp_path / "c"))
    export.to_json(rows, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 48
    assert spark.read.json(str(tmp_path / "j")).count() == 48


def test_messages_of_a_tick(spark):
    tick = {"site_id": 1, "seq": 7, "timestamp": "2026-07-13T12:00:00"}
    numbers = [f.name for t in S.TOPICS.values() for f in t.numeric]
    df = spark.createDataFrame([tuple(tick.values())], "site_id long, seq long, timestamp string")
    df = df.withColumns({n: F.lit(1.0) for n in numbers})
    sent = shape.topic_messages(df).collect()
    assert sorted(r.topic for r in sent) == [f"telemetry.{t}" for t in sorted(S.TOPICS)]


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 90


def test_flagship(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["site_id", "kind", "item", "time", "value"] and df.count() > 0


def test_pushdown_and_shuffles(spark, inputs):
    """The filter and the columns reach the scan; latest rows need one shuffle and no join."""
    plan = status.latest_per_asset(inputs.power().filter("site_id = 3"), inputs.now)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in text.split("PushedFilters")[1] and text.count("Exchange") == 1 and "Join" not in text

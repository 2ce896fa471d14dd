from __future__ import annotations

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltfleet.operators import aggregates, align, dispatch, forecasting
from voltfleet.operators.dispatch import Battery
from voltfleet.operators.series import lay_out
from voltfleet.sources import tables

START = datetime(2026, 7, 13)
RUN = ["site_id", "created_at"]


def day(spark, site=1, created=START):
    """Cheap night, dear evening, some sun."""
    rows = []
    for h in range(24):
        price = 5.0 if h <= 5 else 15.0 if 17 <= h <= 21 else 10.0
        rows.append((site, created, START + timedelta(hours=h), 500.0, 100.0 if 8 <= h <= 16 else 0.0, 50.0, price))
    schema = "site_id long, created_at timestamp, time timestamp, demand double, solar double, wind double, price double"
    return spark.createDataFrame(rows, schema)


def begin(spark, kwh=1000.0, site=1):
    return spark.createDataFrame([(site, kwh)], "site_id long, start_kwh double")


def test_schedule_invariants(spark):
    plan = dispatch.schedule(day(spark), begin(spark), RUN).orderBy("time")
    rows = plan.collect()
    assert len(rows) == 24 and rows[0].hour == "2026-07-13 00:00"
    for r in rows:
        assert not (r.charge_kw > 0.1 and r.discharge_kw > 0.1)
        assert 200.0 <= r.battery_soc_kwh <= 1800.0
        supply = r.grid_buy_kw + r.solar_kw + r.wind_kw + r.discharge_kw
        assert supply == pytest.approx(r.demand_kw + r.charge_kw + r.grid_sell_kw, abs=0.16)
    assert sum(r.charge_kw for r in rows[:6]) > 0
    assert sum(r.discharge_kw for r in rows[17:22]) > 0
    assert dispatch.audit(plan).count() == 0
    total = aggregates.savings_summary(plan, RUN).first()
    assert total.total_baseline_inr == pytest.approx(96750.0)
    assert total.total_optimized_inr == pytest.approx(78160.5, abs=5.0)
    assert total.savings_pct == pytest.approx(100 * (96750 - total.total_optimized_inr) / 96750)


def test_certificate(spark):
    """The schedule of the day keeps every rule and reaches the bound."""
    (found,) = dispatch.certificate(day(spark), begin(spark), RUN).collect()
    assert (found.hours, found.broken_hours) == (24, 0) and -1e-6 <= found.gap <= found.grid_gap < 5
    empty = dispatch.certificate(day(spark).limit(0), begin(spark), RUN)
    assert empty.count() == 0


def test_bound_is_below_every_walk_and_met_by_the_best():
    """Random days, some prices below zero: the bound never exceeds the best walk, and meets it when prices are positive."""
    rng = np.random.default_rng(11)
    small = Battery(low=20.0, high=180.0, rate=50.0, step=10.0)
    net, start = rng.uniform(-80, 80, (40, 5)), rng.uniform(0, 200, 40)
    for low, tight in ((1.0, True), (-6.0, False)):
        price = rng.uniform(low, 15, (40, 5))
        _, cost = small.solve(start, net, price)
        bound = small.bound(start, net, price)
        assert (bound <= cost + 1e-6).all()
        if tight:
            assert ((cost - bound) <= price.sum(axis=1) * small.finest / small.efficiency + 1e-6).all()
            rough = small.solve(start, net, price, refine=False)[1]
            assert (rough - bound).max() > 10


def test_audit_names_what_is_broken(spark):
    plan = dispatch.schedule(day(spark), begin(spark), RUN)
    bad = plan.withColumn("battery_soc_kwh", F.lit(100.0)).withColumn("grid_buy_kw", F.col("grid_buy_kw") + 5)
    assert {tuple(r.violations) for r in dispatch.audit(bad).collect()} == {("level", "balance")}


def test_start_that_cannot_be_brought_in_range_has_no_rows(spark):
    two = day(spark).union(day(spark, site=2))
    starts = begin(spark, -400.0).union(begin(spark, 1000.0, 2))
    assert {r.site_id for r in dispatch.schedule(two, starts, RUN).select("site_id").collect()} == {2}


def test_a_run_of_sixty_hours_is_scheduled(spark):
    days = [day(spark).withColumn("time", F.expr(f"time + INTERVAL {k} DAYS")) for k in range(3)]
    hours = days[0].unionByName(days[1]).unionByName(days[2]).orderBy("time").limit(60)
    rows = dispatch.schedule(hours, begin(spark), RUN).orderBy("time").collect()
    assert len(rows) == 60 and all(200.0 <= r.battery_soc_kwh <= 1800.0 for r in rows)


def test_grid_path_against_exhaustive_search():
    battery = Battery(low=0.0, high=400.0, step=100.0, rate=200.0)
    rng = np.random.default_rng(3)
    levels = np.arange(0, 401, 100.0)
    for _ in range(10):
        net, price, start = rng.uniform(-300, 400, (1, 4)), rng.uniform(0.5, 12, (1, 4)), rng.uniform(0, 400, 1)
        best = math.inf
        for path in itertools.product(levels, repeat=4):
            walk = np.diff([start[0], *path])
            best = min(best, float(battery.cost(walk, net[0], price[0]).sum()))
        _, cost = battery.solve(start, net, price, refine=False)
        assert cost[0] == pytest.approx(best) if math.isfinite(best) else not math.isfinite(cost[0])


def test_refining_reaches_the_fine_grid():
    rng = np.random.default_rng(4)
    net, price, start = rng.uniform(-300, 600, (20, 12)), rng.uniform(1, 11, (20, 12)), rng.uniform(200, 1800, 20)
    _, refined = Battery().solve(start, net, price)
    _, fine = Battery(step=2.0).solve(start, net, price, refine=False)
    assert np.all(refined <= fine + 0.5)


def history(spark, sites=(1, 2), hours=25):
    prices, power = [], []
    for site, i in itertools.product(sites, range(hours)):
        time = START + timedelta(hours=i)
        prices.append((site, time, i, 10.0 + i % 3, 7.0 + i % 2, 50.0))
        for asset, kw, volt in (
            ("solar_pv", 20.0 + i, None),
            ("wind_turbine", 100.0 + i, None),
            ("battery_bank", 50.0, 398.0),
            ("campus_aggregate", 500.0 + 10 * i, None),
        ):
            power.append((site, time, i, asset, kw, volt))
    return (
        spark.createDataFrame(
            prices,
            "site_id long, time timestamp, seq long, buy_price_inr double, sell_price_inr double, grid_frequency double",
        ),
        spark.createDataFrame(
            power, "site_id long, time timestamp, seq long, asset_id string, power_kw double, voltage double"
        ),
    )


def weather(spark, sites=(1, 2), hours=60):
    rows = [
        (s, START + timedelta(hours=h), 25.0, 3.0 + h % 9, 500.0 if 6 <= h % 24 <= 18 else 0.0, 20.0)
        for s in sites
        for h in range(hours)
    ]
    return spark.createDataFrame(
        rows,
        "site_id long, time timestamp, temperature_c double, wind_speed_ms double, irradiance_wm2 double, cloud_cover double",
    )


@pytest.fixture(scope="module")
def frame(spark):
    prices, power = history(spark)
    whole = align.filled(align.align(prices, power)).rows()
    rows = lay_out(align.with_weather(whole, weather(spark)), ["site_id"], ["time"])
    return align.features(rows).rows().cache()


def test_frame(frame):
    assert frame.count() == 50
    assert {"hour_sin", "wind_speed_cubed", "demand_power_kw_lag_1h", "demand_power_kw_roll_4h", "temperature_c"} <= set(
        frame.columns
    )
    rows = frame.filter("site_id = 1").orderBy("time").collect()
    assert [r.demand_power_kw_lag_1h for r in rows[:3]] == [500.0, 500.0, 510.0]
    assert rows[10].demand_power_kw_roll_4h == pytest.approx(575.0)


def test_features_without_weather(spark):
    prices, power = history(spark, sites=(1,))
    rows = align.features(align.filled(align.align(prices, power))).rows()
    assert rows.agg(F.max("solar_attenuation")).first()[0] == 0.0


def test_train_save_load_forecast(spark, frame, tmp_path):
    models, metrics = forecasting.train_all(frame, boosting_rounds=3, trees=5)
    rows = metrics.collect()
    assert len(rows) == 8 and {(r.dataset_size, r.train_samples, r.test_samples) for r in rows} == {(25, 20, 5)}
    forecasting.save_models(models, str(tmp_path))
    loaded = forecasting.load_models(str(tmp_path))
    assert set(loaded) == set(models)
    assert forecasting.load_models(str(tmp_path / "none")) == {}

    wide = forecasting.forecast(frame, weather(spark), loaded).cache()
    assert wide.count() == 48
    low = wide.agg(F.min("price"), F.min("demand"), F.max("wind"), F.min("solar")).first()
    assert low[0] >= 0.5 and low[1] >= 5.0 and low[2] <= 1500.0 and low[3] >= 0.0
    first = wide.filter("site_id = 1").orderBy("time").first()
    assert first.time == START + timedelta(hours=25)
    dark = wide.filter((F.hour("time") < 6) | (F.hour("time") > 18))
    assert dark.count() > 0 and dark.agg(F.max("solar")).first()[0] == 0.0

    # Site 1 has no feed for the coming hours, site 2 none at all: the nearest hour and the typical day stand in.
    thin = weather(spark).filter(F.col("site_id") == 1).filter((F.hour("time") == 11) & (F.dayofmonth("time") == START.day))
    bright = forecasting.forecast(frame, thin, loaded).filter((F.hour("time") >= 11) & (F.hour("time") <= 12))
    assert all(r.solar > 0 for r in bright.collect()) and bright.select("site_id").distinct().count() == 2

    # Two runs for the same hours stay apart; readers take the newer one.
    root = str(tmp_path / "tables")
    tables.create_folders(spark, root)
    for hour in (1, 2):
        run = F.lit(START + timedelta(hours=hour)).cast("timestamp")
        long = forecasting.prediction_rows(wide.withColumn("demand", F.col("demand") + hour), run)
        tables.append_run(long, root)
    stored = tables.read(spark, root, "predictions").drop("date")
    assert stored.filter("site_id = 1").count() == 2 * 96
    newest = forecasting.latest_forecast(stored).filter("site_id = 1").orderBy("time").collect()
    assert len(newest) == 24 and newest[0].demand == pytest.approx(first.demand + 2)

    sites = spark.createDataFrame([(1,), (2,), (9,)], "site_id long")
    soon, late = (F.lit(START + timedelta(hours=h)).cast("timestamp") for h in (2.5, 4))
    assert [r.site_id for r in forecasting.stale_sites(sites, stored, soon).collect()] == [9]
    assert forecasting.stale_sites(sites, stored, late).count() == 3


def test_recursion_feeds_itself(spark, frame):
    """The chained forecast equals stepping one hour at a time by hand."""
    models = {t: forecasting.fit(frame, t, 3, 5) for t in ("demand", "price")}
    got = forecasting.recursive_forecast(forecasting.latest_state(frame), models, hours=3)
    got = got.filter("site_id = 1").orderBy("time").collect()
    last = frame.filter("site_id = 1").orderBy(F.col("time").desc()).first()
    d1, d2, at = last.demand_power_kw, last.demand_power_kw_lag_1h, last.time
    for h in range(1, 4):
        now = at + timedelta(hours=h)
        row = {
            "hour_sin": math.sin(2 * math.pi * now.hour / 24),
            "hour_cos": math.cos(2 * math.pi * now.hour / 24),
            "day_sin": math.sin(2 * math.pi * now.weekday() / 7),
            "day_cos": math.cos(2 * math.pi * now.weekday() / 7),
            "is_weekend": int(now.weekday() >= 5),
            "demand_power_kw_lag_1h": d1,
            "demand_power_kw_lag_2h": d2,
            "demand_power_kw_roll_4h": (d1 + d2) / 2,
        }
        one = spark.createDataFrame([tuple(map(float, row.values()))], ", ".join(f"{n} double" for n in row))
        want = max(5.0, models["demand"].transform(one).first().demand_hat)
        assert got[h - 1].demand == pytest.approx(want)
        d1, d2 = want, d1


def test_small_sites_are_not_trained_on(spark):
    rows = [(1, n) for n in range(10)] + [(2, n) for n in range(9)]
    parts = forecasting.split_sites(spark.createDataFrame(rows, "site_id long, time long"))
    counts = {(r.site_id, r.part): r["count"] for r in parts.groupBy("site_id", "part").count().collect()}
    assert counts == {(1, "train"): 8, (1, "test"): 2}


def test_metrics_edge_cases(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 2.0), ("b", 2.0, 3.0)], "k string, y double, p double")
    got = {r.k: (r.mae, r.rmse, r.r2_score) for r in aggregates.regression_metrics(df, ["k"], "y", "p").collect()}
    assert got["a"] == (2.0, 2.0, 1.0) and got["b"] == (0.5, 0.7071, 0.0)


def test_fits_use_as_few_partitions_as_the_rows_need(spark, frame):
    """Boosting runs hundreds of jobs over the rows: their tasks must follow from the rows, not from the layout."""
    scattered = frame.repartition(40)
    rows = forecasting.packed(scattered, ("demand", "wind"))
    spec = [forecasting.TARGETS[t] for t in ("demand", "wind")]
    assert set(rows.columns) == {c for s in spec for c in (s.actual, *s.inputs)}
    assert rows.rdd.getNumPartitions() == 1 and rows.count() == 50
    assert forecasting.packed(scattered, ("wind",), fit_rows=20).rdd.getNumPartitions() == 3
    assert forecasting.packed(scattered.limit(0), ("wind",)).count() == 0

    one, other = (forecasting.fit_all(f, boosting_rounds=2, trees=3) for f in (scattered, frame.coalesce(1)))
    seen = [sorted(tuple(r) for r in forecasting.score(frame, m).select(*[f"{t}_hat" for t in m]).collect()) for m in (one, other)]
    assert list(one) == list(forecasting.TARGETS) and seen[0] == seen[1]

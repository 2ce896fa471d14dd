from __future__ import annotations

import itertools
from datetime import datetime

import duckdb
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from voltfleet.operators import align, ensembles, forecasting
from voltfleet.operators.series import lay_out
from voltfleet.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    grid = spark.range(600).select(
        (F.col("id") % 7 + 1).alias("site_id"),
        *[F.expr(e).alias(n) for n, e in zip(
            ("hour_sin", "hour_cos", "temperature_c", "irradiance_wm2", "solar_attenuation", "solar_power_kw"),
            ("sin(id)", "cos(id)", "id % 31 * 1.0D", "id * 7 % 900 * 1.0D", "id * 13 % 800 * 1.0D", "id * 7 % 900 * 0.1D + id % 31"),
            strict=True,
        )],
    )
    return grid.cache()


@pytest.mark.parametrize("target, made", [("solar", None), ("demand", "gbt")])
def test_node_table_equals_the_model(spark, rows, tmp_path, target, made):
    """The saved nodes, walked by joins in SQL and by expressions, predict what the model predicts."""
    spec = forecasting.TARGETS[target]
    if made:
        extra = dict(zip(spec.inputs, itertools.cycle(["temperature_c", "irradiance_wm2", "solar_attenuation"]), strict=False))
        rows = rows.select("site_id", F.col("solar_power_kw").alias(spec.actual), *[(F.col(c) * (k + 1)).alias(n) for k, (n, c) in enumerate(extra.items())])
    model = forecasting.fit(rows, target, boosting_rounds=6, trees=5)
    nodes = ensembles.node_table(model.stages[-1], list(spec.inputs))
    want = model.transform(rows).select("*", F.round(f"{target}_hat", 9).alias("want"))
    got = ensembles.predicted(want, nodes, "got")
    assert got.filter(F.abs(F.col("got") - F.col("want")) > 1e-8).count() == 0 and got.count() == 600

    numbered = want.select(F.monotonically_increasing_id().alias("row"), "want", *spec.inputs)
    numbered.write.parquet(str(tmp_path / "rows"))
    nodes.write.parquet(str(tmp_path / "nodes"))
    con = duckdb.connect()
    for name in ("rows", "nodes"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    worst = con.execute(ensembles.walk_sql(list(spec.inputs)) + " SELECT max(abs(walked.got - rows.want)), count(*) FROM walked JOIN rows USING (row)").fetchone()
    assert worst[0] < 1e-8 and worst[1] == 600


def test_vector_forecast_equals_the_chained_one(spark):
    """All hours in numpy give what a plan of two model nodes an hour gives, for trees and for lines, with either roll."""
    frame = spark.sql(
        "SELECT id % 5 AS site_id, TIMESTAMP '2026-03-01' + make_interval(0,0,0,0,CAST(id AS INT)) AS time, "
        "400 + 90 * sin(id / 3) + id % 7 AS demand_power_kw, 6 + 3 * cos(id / 4) AS buy_price_inr FROM range(400)"
    )
    rows = align.features(lay_out(frame, ["site_id"], ["time"])).rows().cache()
    targets = ("demand", "price")
    trees = forecasting.fit_all(rows, targets, boosting_rounds=4)
    lines = {t: Pipeline(stages=[forecasting.assembler(t), LinearRegression(
        labelCol=forecasting.TARGETS[t].actual, featuresCol=f"{t}_x", predictionCol=f"{t}_hat")]).fit(rows) for t in targets}
    state = forecasting.latest_state(rows).cache()
    for models in (trees, lines):
        for consistent in (False, True):
            want = forecasting.recursive_forecast(state, models, hours=6, consistent_roll=consistent)
            got = forecasting.vector_forecast(state, models, hours=6, consistent_roll=consistent)
            key = lambda d: [(r.site_id, r.time, pytest.approx(r.demand), pytest.approx(r.price)) for r in d.orderBy("site_id", "time").collect()]
            assert [tuple(r) for r in got.orderBy("site_id", "time").collect()] == key(want) and got.count() == 30
    assert forecasting.vector_forecast(state.limit(0), trees).count() == 0


def test_refresh_runs_stale_sites_only(spark, tmp_path):
    """A fresh site keeps its run, a stale one and one without a run get the new one, a site without history nothing; a half
    written version is not read."""
    frame = spark.sql(
        "SELECT id % 3 AS site_id, TIMESTAMP '2026-03-01' + make_interval(0,0,0,0,CAST(id AS INT)) AS time, "
        "400 + id % 11 AS demand_power_kw, 6 + id % 5 AS buy_price_inr, 20.0D + id % 3 AS solar_power_kw, 10.0D + id % 4 AS wind_power_kw, "
        "25.0D AS temperature_c, 4.0D + id % 4 AS wind_speed_ms, 200.0D + id % 9 AS irradiance_wm2, 10.0D + id % 6 AS cloud_cover FROM range(90)"
    )
    rows = align.features(lay_out(frame, ["site_id"], ["time"])).rows().cache()
    weather = forecasting.horizon(rows.groupBy("site_id").agg(F.max("time").alias("time"))).drop("step").selectExpr(
        "site_id", "time", "25.0D AS temperature_c", "5.0D AS wind_speed_ms", "200.0D AS irradiance_wm2", "10.0D AS cloud_cover")
    root, models = str(tmp_path / "tables"), str(tmp_path / "models")
    tables.create_folders(spark, root)
    old = spark.sql("SELECT * FROM VALUES (0L, TIMESTAMP '2026-03-04 22:30:00'), (1L, TIMESTAMP '2026-03-04 21:00:00') AS v(site_id, created_at)")
    tables.append_run(old.selectExpr("site_id", "created_at AS time", "'demand' AS target_type", "1.0D AS predicted_value", "created_at"), root)
    sites = spark.range(5).withColumnRenamed("id", "site_id")
    now = datetime(2026, 3, 4, 23)
    assert forecasting.current_models(models) == {}
    for _ in range(2):  # the second call finds every site fresh
        found = forecasting.refresh(rows, weather, sites, root, models, now, train=forecasting.fit_lines)
        got = {(r.site_id, r.created_at.hour): r["count"] for r in found.groupBy("site_id", "created_at").count().collect()}
        assert got == {(0, 22): 1, (1, 23): 24, (2, 23): 24}
    assert tables.read(spark, root, "predictions").count() == 2 + 2 * 24 * 4
    forecasting.save_models({"wind": forecasting.fit_lines(rows)["wind"]}, f"{models}/version=20990101T000000000000")
    assert set(forecasting.current_models(models)) == set(forecasting.TARGETS)

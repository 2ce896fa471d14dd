"""Whole and split layouts must give the same rows, also with one key that holds most of them."""

from __future__ import annotations

import random
import time
from collections import deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltfleet.operators import imputation, joins, ordered, scans, series, validation
from voltfleet.operators.series import lay_out

LIMITS = [10_000, 23, 7]


def rows(spark, n=400, hot=0.5, gap=0.3, seed=1):
    rng = random.Random(seed)
    data = []
    for seq in range(n):
        site = 1 if rng.random() < hot else rng.randint(2, 30)
        x = None if rng.random() < gap else round(rng.uniform(0, 100), 2)
        data.append((site, seq, x, round(rng.uniform(-900, 900), 2), float(rng.randint(0, 1))))
    return spark.createDataFrame(data, "site_id long, seq long, x double, d double, step double")


def table(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9)


def test_split_is_used_and_bounded(spark):
    s = lay_out(rows(spark), ["site_id"], ["seq"], 23)
    assert s.split
    sizes = [r["count"] for r in s.df.groupBy("_chunk").count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 100
    assert not lay_out(rows(spark), ["site_id"], ["seq"], 10_000).split


def test_short_chunks_need_no_task_each(spark):
    """400 rows in chunks of 7 are 58 chunks, but no more tasks than there are cores."""
    s = lay_out(rows(spark), ["site_id"], ["seq"], 7)
    assert s.split and s.df.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    chunks = s.df.groupBy("_chunk").agg(F.count("*").alias("n"), F.min(F.struct("site_id", "seq")).alias("a"), F.max(F.struct("site_id", "seq")).alias("b"))
    chunks = chunks.orderBy("_chunk").collect()
    assert len(chunks) >= 58 and sum(c.n for c in chunks) == 400 and max(c.n for c in chunks) <= 7
    assert all(x.b < y.a for x, y in zip(chunks, chunks[1:]))  # consecutive stretches in order


@pytest.mark.parametrize("keys", [["site_id"], []])
@pytest.mark.parametrize("limit", LIMITS[1:])
def test_layouts_agree(spark, keys, limit):
    df = rows(spark).cache()

    def results(max_rows):
        s = lay_out(df, keys, ["seq"], max_rows)
        assert s.split == (max_rows < 1000)
        out = {}
        out["ffill"] = table(series.forward_fill(s, {"f": "x"}).rows(), "seq", "f")
        out["bfill"] = table(series.backward_fill(s, {"f": "x"}).rows(), "seq", "f")
        out["rn"] = table(series.row_numbers(s, "rn").rows(), "seq", "rn")
        out["sum"] = table(series.running_sum(s, {"t": "d"}).rows(), "seq", "t")
        out["any"] = table(series.running_any(s, "a", F.col("x") > 95).rows(), "seq", "a")
        out["n"] = table(series.with_key_rows(s, "n").rows(), "seq", "n")
        out["chain"] = table(ordered.fill_chain(s, ["x"]).rows(), "seq", "x")
        out["lags"] = table(
            ordered.lag_features(s, ["d"]).rows(), "seq", "d_lag_1h", "d_lag_2h", "d_roll_4h"
        )
        out["ewma"] = table(ordered.smoothed(s, "d", "v", keep=0.3).rows(), "seq", "v")
        out["level"] = table(ordered.storage_level(s, "d", "v").rows(), "seq", "v")
        out["split"] = table(ordered.chrono_split(s, minimum=10).rows(), "seq", "part")
        out["cycles"] = table(ordered.cycle_count(s, "d", "v").rows(), "seq", "v")
        out["isolated"] = table(imputation.impute_isolated(s, "x", "y").rows(), "seq", "y")
        return out

    whole, split = results(10_000), results(limit)
    for name in whole:
        if name in ("ffill", "bfill", "any", "rn", "n", "split", "isolated", "chain"):
            assert whole[name] == split[name], name
        else:
            close(whole[name], split[name])


def test_lags_against_pandas(spark):
    df = rows(spark, 120)
    got = ordered.lag_features(lay_out(df, ["site_id"], ["seq"]), ["d"]).rows().toPandas().sort_values("seq")
    for _, g in got.groupby("site_id"):
        for k in (1, 2):
            want = g["d"].shift(k).bfill().fillna(0.0)
            assert np.allclose(want, g[f"d_lag_{k}h"])
        want = g["d"].shift(1).rolling(4, min_periods=1).mean().bfill().fillna(0.0)
        assert np.allclose(want, g["d_roll_4h"])


@pytest.mark.parametrize("limit", LIMITS)
def test_smoothing_against_loop(spark, limit):
    df = rows(spark, 900, hot=0.95)
    got = ordered.smoothed(lay_out(df, ["site_id"], ["seq"], limit * 20), "d", "v").rows().toPandas().sort_values("seq")
    for _, g in got.groupby("site_id"):
        v, want = 1.0, []
        for x in g["d"]:
            v = 0.95 * v + 0.05 * x
            want.append(v)
        assert np.allclose(want, g["v"], rtol=1e-12, atol=1e-11)


@pytest.mark.parametrize("limit", LIMITS)
def test_storage_level_against_loop(spark, limit):
    df = rows(spark, 600, hot=0.7)
    got = ordered.storage_level(lay_out(df, ["site_id"], ["seq"], limit), "d", "v").rows().toPandas().sort_values("seq")
    for _, g in got.groupby("site_id"):
        v, want = 1000.0, []
        for x in g["d"]:
            v = min(1800.0, max(200.0, v + x))
            want.append(v)
        assert np.allclose(want, g["v"])


def loop_impute(values):
    history, out = deque(maxlen=3), []
    for v in values:
        if v is None or v != v:
            v = round(sum(history) / len(history), 3) if history else None
        if v is not None:
            history.append(v)
        out.append(v)
    return out


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("gap", [0.05, 0.3, 0.7, 0.95])
def test_imputation_against_loop(spark, limit, gap):
    """Long runs of gaps included; with 95 % gaps hardly any reset is left to cut a series at."""
    df = rows(spark, 300, hot=0.6, gap=gap, seed=int(gap * 100)).select("site_id", "seq", F.col("x").alias("v0"))
    got = imputation.impute(lay_out(df, ["site_id"], ["seq"], limit), ["v0"]).rows().toPandas().sort_values("seq")
    source = df.toPandas().sort_values("seq")
    assert len(got) == len(source)
    for site, g in source.groupby("site_id"):
        want = [np.nan if v is None else v for v in loop_impute(g["v0"])]
        assert np.array_equal(want, got[got.site_id == site]["v0"], equal_nan=True)


@pytest.mark.parametrize("limit", LIMITS)
def test_frozen_against_loop(spark, limit):
    data = []
    rng = random.Random(5)
    for seq in range(500):
        topic = "wind" if rng.random() < 0.7 else rng.choice(["solar", "meters"])
        data.append((topic, seq, float(rng.random() < 0.15), float(rng.random() < 0.2), float(rng.random() < 0.1)))
    df = spark.createDataFrame(data, "topic string, seq long, v0 double, v1 double, v2 double")
    out = validation.frozen(lay_out(df, ["topic"], ["seq"], limit), slots=("v0", "v1", "v2")).rows()
    got = {r.seq: r.frozen for r in out.collect()}
    resting = {("wind", 1), ("solar", 1), ("solar", 2)}
    seen: dict[tuple, deque] = {}
    for topic, seq, *vs in data:
        flag = False
        for slot, v in enumerate(vs):
            q = seen.setdefault((topic, slot), deque(maxlen=5))
            q.append(v)
            if len(q) == 5 and len(set(q)) == 1 and not ((topic, slot) in resting and max(q) == 0.0):
                flag = True
        assert got[seq] == flag, seq


@pytest.mark.parametrize("limit", LIMITS)
def test_asof_and_nearest_against_brute_force(spark, limit):
    rng = random.Random(9)
    base = datetime(2024, 1, 1)
    left = [(1 if rng.random() < 0.6 else rng.randint(2, 6), base + timedelta(hours=rng.randint(0, 60)), n) for n in range(200)]
    right = {}
    for _ in range(60):
        right[(rng.randint(1, 5), base + timedelta(hours=rng.randint(0, 60)))] = rng.random()
    ldf = spark.createDataFrame(left, "site_id long, time timestamp, n long")
    rdf = spark.createDataFrame([(s, t, v) for (s, t), v in right.items()], "site_id long, time timestamp, v double")
    back = {r.n: r.v for r in joins.asof(ldf, rdf, ["site_id"], "time", "n", ["v"], limit).collect()}
    near = {r.n: r.v for r in joins.nearest(ldf, rdf, ["site_id"], "time", "n", ["v"], limit).collect()}
    assert len(back) == len(near) == 200
    for site, time, n in left:
        mine = [(t, v) for (s, t), v in right.items() if s == site]
        earlier = [p for p in mine if p[0] <= time]
        assert back[n] == (max(earlier)[1] if earlier else None)
        if mine:
            # Ties go to the later hour.
            want = min(mine, key=lambda p: (abs(p[0] - time), base - p[0]))
            assert near[n] == want[1]
        else:
            assert near[n] is None


def test_one_long_series_is_filled_backwards_in_linear_time(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(1).alias("site_id"), F.col("id").alias("seq"), F.when(F.col("id") == n - 1, 5.0).alias("x"))
    begun = time.perf_counter()
    s = series.backward_fill(series.Series(df, ("site_id",), ("seq",)), {"b": "x"})
    assert s.rows().filter("b = 5.0").count() == n
    assert time.perf_counter() - begun < 60


@pytest.mark.parametrize("batch", [1, 3, 1000])
@pytest.mark.parametrize("limit", LIMITS)
def test_recurrences_go_on_from_batch_to_batch(spark, limit, batch):
    """A step in time may lie anywhere: in a batch, between batches, between chunks; missing deltas change nothing."""
    df = rows(spark, n=150, seed=9).withColumn("d", F.when(F.col("seq") % 11 > 0, F.col("d")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        s = lay_out(df, ["site_id"], ["seq"], limit)
        got = table(ordered.storage_level(s, "d", "v").rows(), "site_id", "seq", "v")
        smooth = table(ordered.smoothed(s, "d", "v", keep=0.6, start=2.0).rows(), "site_id", "seq", "v")
        whole = lay_out(df, ["site_id"], ["seq"], 10_000)
        first = table(ordered.fill_chain(s, ["x"]).rows(), "site_id", "seq", "x")
        assert first == table(ordered.fill_chain(whole, ["x"]).rows(), "site_id", "seq", "x")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    level, wear, want, want_smooth = {}, {}, [], []
    for r in sorted(df.collect(), key=lambda r: (r.site_id, r.seq)):
        level[r.site_id] = min(1800.0, max(200.0, level.get(r.site_id, 1000.0) + (r.d or 0.0)))
        wear[r.site_id] = 0.6 * wear.get(r.site_id, 2.0) + 0.4 * (r.d or 0.0)
        want.append((r.site_id, r.seq, level[r.site_id]))
        want_smooth.append((r.site_id, r.seq, wear[r.site_id]))
    close(got, want)
    close(smooth, want_smooth)


def test_steps_compose_in_any_grouping():
    rng = np.random.default_rng(3)
    low = rng.uniform(-5, 0, 64)
    steps = [rng.normal(0, 3, 64), low, low + rng.uniform(0, 6, 64)]
    begin = np.repeat([0, 20, 21], [20, 1, 43])
    got = scans.CLAMP.at(scans.scan(scans.CLAMP, steps, begin), np.full(64, 1.5))
    for k in range(64):
        x = 1.5
        for j in range(begin[k], k + 1):
            x = min(steps[2][j], max(steps[1][j], x + steps[0][j]))
        assert got[k] == pytest.approx(x)


def test_acceptance_needs_no_order(spark):
    """The first complete good message is found by a minimum; the plan has no window, and null keys are keys too."""
    def solar(power):
        return f'{{"timestamp": "2025-01-01T00:00:00Z", "solar_power_kw": {power}, "irradiance_wm2": 500, "temperature_c": 30}}'

    sent = [(site, "solar", seq, solar(p)) for site in (1, None) for seq, p in enumerate(("null", "null", "50", "null", '"x"', "60"))]
    df = spark.createDataFrame(sent, "site_id long, topic string, seq long, payload string")
    judged = validation.accept_rows(validation.decode(df), ["site_id", "topic"], ["seq"])
    assert "Window" not in judged._jdf.queryExecution().executedPlan().toString()
    by_window = validation.accept(lay_out(validation.decode(df.filter("site_id = 1")), ["site_id", "topic"], ["seq"], 2))
    assert table(by_window.rows().filter("site_id = 1"), "seq", "accepted") == table(judged.filter("site_id = 1"), "seq", "accepted")
    assert table(judged.filter("site_id = 1"), "seq", "accepted") == table(judged.filter("site_id IS NULL"), "seq", "accepted")
    assert [a for _, a in table(judged.filter("site_id = 1"), "seq", "accepted")][:3] == [False, False, True]

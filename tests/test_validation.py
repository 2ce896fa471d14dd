from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.operators import imputation, tables, validation
from voltfleet.operators.series import lay_out
from voltfleet.sources import lake, messages, tables as stored
from voltfleet.streaming import pipelines
from voltfleet.streaming import state as streaming_state
from voltfleet.streaming.state import judged

AT = "2026-07-13T12:00:00"


def send(spark, *payloads, topic="solar", site=1):
    rows = [(site, topic, n, json.dumps({"timestamp": AT, **p})) for n, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "site_id long, topic string, seq long, payload string")


def run(messages_df, keys=("site_id", "topic"), limit=None):
    clean, rejected = imputation.clean(lay_out(validation.decode(messages_df).drop("payload"), keys, ["seq"], limit))
    return clean.rows().orderBy("seq").collect(), rejected.collect()


SOLAR = {"temperature_c": 31.25, "irradiance_wm2": 642.0, "solar_power_kw": 48.75, "weather_source": "real_api"}
BATTERY = {
    "battery_power_kw": -35.5,
    "battery_soc": 63.0,
    "battery_soh": 96.5,
    "battery_cell_temp": 33.0,
    "battery_voltage": 388.0,
    "anomaly_flag": False,
}
MARKET = {"electricity_buy_price_inr": 10.0, "electricity_sell_price_inr": 7.0, "grid_frequency_hz": 50.0}


def test_bounds(spark):
    clean, rejected = run(send(spark, SOLAR, SOLAR | {"temperature_c": 75.0}))
    assert [r.seq for r in clean] == [0] and clean[0].v0 == 31.25 and clean[0].v2 == 48.75
    assert [r.reasons for r in rejected] == [["temperature_c: out of range"]]


def test_bounds_are_inclusive_and_text_is_coerced(spark):
    clean, _ = run(send(spark, SOLAR | {"temperature_c": "60.0"}, SOLAR | {"temperature_c": -10}, SOLAR | {"x": 1}))
    assert [r.v0 for r in clean] == [60.0, -10.0, 31.25]


def test_unreadable_and_missing(spark):
    no_time = {k: v for k, v in SOLAR.items()} | {"timestamp": None}
    _, rejected = run(send(spark, SOLAR | {"irradiance_wm2": "much"}, no_time, SOLAR | {"solar_power_kw": "NaN"}))
    assert sorted(r.reasons[0] for r in rejected) == [
        "irradiance_wm2: not readable",
        "solar_power_kw: out of range",
        "timestamp: missing",
    ]


def test_outlier(spark):
    clean, _ = run(send(spark, BATTERY, BATTERY | {"battery_cell_temp": 65.0, "battery_soc": 51.0}, topic="battery"))
    assert [r.anomaly_flag for r in clean] == [False, True]
    clean, _ = run(send(spark, BATTERY | {"anomaly_flag": True}, topic="battery"))
    assert clean[0].anomaly_flag
    clean, _ = run(send(spark, MARKET | {"grid_frequency_hz": 49.4}, MARKET | {"grid_frequency_hz": 49.5}, topic="market"))
    assert [r.anomaly_flag for r in clean] == [True, False]


def test_frozen_sensor(spark):
    same = {"wind_speed_ms": 5.0, "wind_power_kw": 30.0, "wind_vibration": 1.02}
    clean, _ = run(send(spark, *[same] * 5, topic="wind"))
    assert [r.anomaly_flag for r in clean] == [False] * 4 + [True]


def test_imputation(spark):
    prices = [MARKET | {"electricity_buy_price_inr": p, "grid_frequency_hz": 50 + p / 100} for p in (10.0, 11.0, 12.0)]
    gap = {k: v for k, v in MARKET.items() if k != "electricity_buy_price_inr"}
    clean, _ = run(send(spark, *prices, gap, topic="market"))
    assert clean[3].v0 == 11.0


def test_gap_before_any_complete_message_is_rejected(spark):
    gap = {k: v for k, v in SOLAR.items() if k != "irradiance_wm2"}
    clean, rejected = run(send(spark, gap, SOLAR, gap))
    assert [r.seq for r in clean] == [1, 2] and clean[1].v1 == 642.0
    assert [r.seq for r in rejected] == [0]


def test_defaults(spark):
    clean, _ = run(send(spark, {k: v for k, v in SOLAR.items() if k != "weather_source"}))
    assert clean[0].weather_source == "imputed"


def test_unknown_topic_is_rejected(spark):
    _, rejected = run(send(spark, SOLAR, topic="tide"))
    assert rejected[0].reasons == ["topic: unknown"]


def test_numeric_fields_leave_out_the_flag():
    assert "anomaly_flag" not in [f.name for t in S.TOPICS.values() for f in t.numeric]


def test_topic_mapping(spark):
    meters = {
        "demand_active_kw": 912.5,
        "demand_reactive_kvar": 255.0,
        "aggregate_power_factor": 0.96,
        "breakdown": {"Library_2": {"active_power_kw": 141.5}, "Hall_4": {"active_power_kw": 76.25}},
    }
    market = MARKET | {"electricity_buy_price_inr": 8.35, "electricity_sell_price_inr": 5.9, "grid_frequency_hz": 49.97}
    sent = send(spark, market, topic="market").union(send(spark, SOLAR | {"solar_power_kw": 71.5}))
    sent = sent.union(send(spark, meters, topic="meters"))
    clean, _ = imputation.clean(lay_out(validation.decode(sent), ["site_id", "topic"], ["seq"]))
    prices = tables.price_rows(clean.rows()).collect()
    assert [(p.buy_price_inr, p.sell_price_inr, p.grid_frequency) for p in prices] == [(8.35, 5.9, 49.97)]
    power = {r.asset_id: r.power_kw for r in tables.power_rows(clean.rows()).collect()}
    assert power == {"solar_pv": 71.5, "campus_aggregate": 912.5, "Library_2": 141.5, "Hall_4": 76.25}


def test_odd_breakdown_entries_cost_no_other(spark):
    good = {"active_power_kw": "141.5", "building_type": "library", "power_factor": 0.94}
    odd = {"Library_2": good, "Number": 7, "Text": "off", "List": [1], "Null": None, "Bad": {"active_power_kw": "n/a"}}
    meters = {"demand_active_kw": 9.5, "demand_reactive_kvar": 2.0, "aggregate_power_factor": 0.96}
    sent = send(spark, meters | {"breakdown": odd}, meters | {"breakdown": {}}, meters | {"breakdown": [1]}, meters, topic="meters")
    rows = validation.reject_reasons(validation.decode(sent))
    assert [r.reasons for r in rows.orderBy("seq").collect()] == [[], [], ["breakdown: not readable"], ["breakdown: missing"]]
    found = {r.building: r for r in tables.building_rows(rows).collect()}
    assert set(found) == set(odd) and [n for n, r in found.items() if r.is_object] == [n for n in found if n in ("Library_2", "Bad")]
    assert (found["Library_2"].active_power_kw, found["Library_2"].power_factor, found["Bad"].active_power_kw) == (141.5, 0.94, None)
    clean = rows.filter("seq = 0").withColumn("anomaly_flag", F.lit(False))
    assert {r.asset_id for r in tables.power_rows(clean).collect()} == {"campus_aggregate", "Library_2"}


def test_status_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 500.0), (5.0, 500.0), (0.0, None)], "p double, i double")
    got = df.select(tables.solar_status(F.col("p"), F.col("i")).alias("s")).collect()
    assert [r.s for r in got] == ["operational", "error", "operational", "operational"]
    df = spark.createDataFrame([(0.0, 2.9), (0.0, 3.0), (1.0, 3.0)], "p double, v double")
    assert [r.s for r in df.select(tables.wind_status(F.col("p"), F.col("v")).alias("s")).collect()] == [
        "operational",
        "error",
        "operational",
    ]
    df = spark.createDataFrame([(40.0,), (40.1,), (None,)], "h double")
    assert [r.s for r in df.select(tables.battery_status(F.col("h")).alias("s")).collect()] == [
        "degraded",
        "operational",
        "operational",
    ]


def test_lake_path_and_last_write_wins(spark, tmp_path):
    rows = spark.sql(
        "SELECT 1L AS site_id, 'solar' AS topic, n AS seq, TIMESTAMP '2026-07-13 12:00:00.3' AS time, n * 1.0D AS v "
        "FROM VALUES (1L), (2L) AS x(n)"
    )
    lake.write(rows, str(tmp_path))
    assert (tmp_path / "raw" / "topic=solar" / "year=2026" / "month=07" / "day=13" / "hour=12").is_dir()
    assert [r.v for r in lake.read(spark, str(tmp_path)).collect()] == [2.0]


def test_last_write_wins_across_writes(spark, tmp_path):
    for n in (2, 1, 3):
        rows = spark.sql(
            f"SELECT 1L AS site_id, 'solar' AS topic, {n}L AS seq, TIMESTAMP '2026-03-01 08:00:00.{n}' AS time, {n}.0D AS v"
        )
        lake.write(rows, str(tmp_path), batch=n)
        lake.write(rows, str(tmp_path), batch=n)
    assert [r.v for r in lake.read(spark, str(tmp_path)).collect()] == [3.0]
    low, high = (F.lit(x).cast("timestamp") for x in ("2026-03-01", "2026-03-02"))
    assert [r.v for r in lake.read_range(spark, str(tmp_path), low, high).collect()] == [3.0]


def test_stream_and_batch_writers_share_a_lake(spark, tmp_path):
    """A stream, a second stream, a plain write and a numbered batch under one root; every row is read, each second once."""
    root, source = str(tmp_path / "lake"), str(tmp_path / "in")
    rows = spark.sql(
        "SELECT id % 3 AS site_id, 'solar' AS topic, id AS seq, TIMESTAMP '2026-07-01' + make_interval(0,0,0,CAST(id AS INT)) AS time, "
        "id * 1.0D AS v FROM range(12)"
    )
    rows.filter("seq < 6").write.parquet(source)
    for n in range(2):  # the second stream brings the same rows again
        stream = spark.readStream.schema(rows.schema).parquet(source)
        pipelines.run_all(pipelines.to_lake(stream, root, str(tmp_path / f"c{n}"), by_hour=False))
    lake.write(rows.filter("seq BETWEEN 6 AND 8"), root)
    for _ in range(2):
        lake.write(rows.filter("seq > 8"), root, batch=7)
    assert lake.depth_of(spark, root) == 4
    assert sorted(r.seq for r in lake.read(spark, root).collect()) == list(range(12))
    with pytest.raises(ValueError):
        lake.write(rows, root, depth=5)


def test_lines_to_lake_tables_and_letters(spark, tmp_path):
    """Several batches of envelope lines through the whole pipeline; failed ones come back with site and order."""
    folder = tmp_path / "in"
    folder.mkdir()
    for batch in range(3):
        lines = []
        for k in range(8):
            payload = {
                "timestamp": f"2026-02-03T0{batch}:{k:02d}:00",
                "electricity_buy_price_inr": 9.5 + k,
                "electricity_sell_price_inr": 6.25,
                "grid_frequency_hz": 50.1 if k != 5 else 500.0,
            }
            lines.append(json.dumps({"topic": "telemetry.market", "site_id": 7, "seq": 100 * batch + k, "payload": payload}))
        (folder / f"{batch}.json").write_text("\n".join([*lines, "{torn"]))
    good, _ = messages.parse_envelopes(messages.stream_lines(spark, str(folder), max_files=1))
    root = str(tmp_path / "out")
    stored.create_folders(spark, root)
    pipelines.run_all(pipelines.ingest(good, root, str(tmp_path / "checkpoint")))
    landed = lake.read(spark, f"{root}/lake")
    prices = stored.read(spark, root, "electricity_prices")
    letters = messages.parse_envelopes(messages.read_lines(spark, f"{root}/dead_letters"))[0]
    rejected = {r.seq for r in letters.filter("site_id = 7").collect()}
    kept = {r.seq for r in landed.collect()}
    assert {5, 105, 205} <= rejected and kept and not kept & rejected
    assert kept | rejected == {100 * b + k for b in range(3) for k in range(8)}
    assert prices.filter("site_id = 7").count() == len(kept)


def test_lake_reads_only_the_days_asked_for(spark, tmp_path):
    rows = spark.sql(
        "SELECT 1L AS site_id, 'solar' AS topic, id AS seq, TIMESTAMP '2026-07-01' + make_interval(0,0,0,CAST(id AS INT)) AS time "
        "FROM range(30)"
    )
    lake.write(rows, str(tmp_path), depth=4)
    low, high = (F.lit(x).cast("timestamp") for x in ("2026-07-05", "2026-07-07"))
    found = lake.read_range(spark, str(tmp_path), low, high)
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_torn_lines_do_not_stop_the_rest(spark):
    lines = ['{"topic": "a.b.solar", "payload": {"x": 1}}', '{"topic": "solar", "pay', "", '{"topic": "wind"}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    good, bad = messages.parse_envelopes(df)
    assert [(r.topic, json.loads(r.payload)) for r in good.collect()] == [("solar", {"x": 1})]
    assert bad.count() == 3


def test_dead_letter_round_trip(spark, tmp_path):
    sent = send(spark, SOLAR)
    letters = messages.dead_letters(sent, F.lit("down"), F.lit(AT).cast("timestamp"))
    messages.append_lines(letters, str(tmp_path / "dlq"))
    messages.append_lines(letters, str(tmp_path / "dlq"))
    back = messages.read_dead_letters(spark, str(tmp_path / "dlq")).collect()
    assert len(back) == 2 and back[0].error == "down" and json.loads(back[0].payload)["solar_power_kw"] == 48.75
    good, bad = messages.parse_envelopes(messages.read_lines(spark, str(tmp_path / "dlq")))
    assert good.count() == 2 and bad.count() == 0


@pytest.mark.parametrize("limit", [None, 40])
def test_split_clean_equals_whole_clean_by_topic(spark, inputs, limit):
    """One series per topic: each holds a fifth of all messages."""
    sent = inputs.messages().persist()
    columns = ["topic", "seq", *S.SLOTS, "weather_source", "anomaly_flag"]
    whole, _ = run(sent, ("topic",), 10**9)
    split, rejected = run(sent, ("topic",), limit)
    key = lambda rows: sorted(tuple(r[c] for c in columns) for r in rows)
    assert repr(key(whole)) == repr(key(split))
    assert len(split) + len(rejected) == sent.count()


def test_stream_equals_batch(spark, inputs, tmp_path):
    """Micro-batches of consecutive messages give what one batch gives."""
    sent = inputs.messages().persist()
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    bounds = [0, 200, 430, 431, 10**9]
    for low, high in zip(bounds, bounds[1:]):
        sent.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = judged(stream, ("topic",)).writeStream.format("parquet").option("path", out)
    query.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).filter("accepted").collect()
    want, _ = run(sent, ("topic",))
    columns = ["topic", "seq", *S.SLOTS, "anomaly_flag"]
    key = lambda rows: sorted(tuple(r[c] for c in columns) for r in rows)
    assert len(want) > 500 and repr(key(got)) == repr(key(want))


class _State:
    exists, value = False, None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.exists, self.value = True, value


def test_one_call_steps_many_series(spark):
    """A bucket of interleaved series gives what each gives alone, also when it comes in two batches."""
    nan = float("nan")
    sent = [(site, topic, seq, [5.0, nan if seq % 3 == 0 else seq * (site + 1.0), 2.0]) for seq in range(12) for site, topic in ((1, "solar"), (2, "wind"), (1, "other"))]
    rows = pd.DataFrame(
        [{"_series": f"{site}{topic}", "topic": topic, "seq": seq, "values": [*v, nan, nan], "ok": seq != 5, "rest": f"{site} {topic} {seq}"} for site, topic, seq, v in sent]
    ).sample(frac=1.0, random_state=3)

    def stepped(*batches):
        kept = _State()
        done = pd.concat([out for b in batches for out in streaming_state._step((0,), iter([b]), kept)])
        return sorted((r.rest, r.accepted, r.frozen, str(r["values"])) for _, r in done.iterrows())

    whole = stepped(rows)
    assert len(whole) == 36 and any(a for _, a, _, _ in whole) and any(f for _, _, f, _ in whole)
    assert whole == sorted(r for _, part in rows.groupby("_series") for r in stepped(part))
    assert whole == stepped(rows[rows.seq < 6], rows[rows.seq >= 6])


def test_stream_batches_leave_few_files(spark, tmp_path):
    """Batches of a stateful stream are written without AQE: still one file a folder, not one for every task."""
    data = [(s, t, i, datetime(2024, 1, 1, 0, i), float(i)) for i in range(40) for s in (1, 2) for t in ("solar", "wind")]
    rows = spark.createDataFrame(data, "site_id long, topic string, seq long, time timestamp, v0 double").repartition(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lake.write(rows, str(tmp_path), depth=4, batch="b")
        assert len(list(tmp_path.rglob("part-*.parquet"))) == 2
        assert lake.read(spark, str(tmp_path)).count() == 160
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")

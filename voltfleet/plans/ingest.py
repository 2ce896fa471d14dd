"""Decoding, validation and landing of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.operators import align, tables, validation
from voltfleet.operators.aggregates import keep_first
from voltfleet.operators.series import lay_out
from voltfleet.plans.inputs import BUILDING_SHARES, JUDGED_SQL, MESSAGES_SQL, METERED_SQL, T_SQL, Inputs
from voltfleet.plans.registry import query
from voltfleet.session import scratch_path, spread
from voltfleet.sources import export, lake, messages, weather

M = f"WITH {T_SQL}, {MESSAGES_SQL}"
J = f"{M}, {JUDGED_SQL}"
#: One series per topic, over all sites: each holds a fifth of the messages.
TOPIC = ["topic"]

ACCEPTED_SQL = """
a AS (
  SELECT *, ok AND seq >= coalesce(min(CASE WHEN ok AND complete THEN seq END) OVER (PARTITION BY topic), 9e18) AS accepted
  FROM j
)"""


def decoded(i: Inputs) -> DataFrame:
    return validation.decode(i.messages())


def accepted(i: Inputs, keys=tuple(TOPIC)) -> DataFrame:
    return validation.accept_rows(validation.fill_defaults(decoded(i)).drop("payload"), keys, ["seq"])


@query(
    "jsonl_decode",
    f"""WITH {T_SQL} SELECT seq, site_id, CASE WHEN k < 95 THEN topic END AS topic,
      CASE WHEN k < 95 THEN k END AS k FROM t""",
)
def jsonl_decode(i: Inputs) -> DataFrame:
    """Envelope lines, some of them torn; a torn line is kept aside and the rest goes on."""
    envelope = F.struct(F.concat(F.lit("telemetry."), "topic").alias("topic"), F.col("props").alias("payload"))
    events = i.table("events").select("event_id", "props")
    t = i.t().drop("k").join(events, F.col("seq") == F.col("event_id"))
    line = F.to_json(envelope)
    k = F.get_json_object("props", "$.k").cast("int")
    lines = t.select("seq", "site_id", F.when(k < 95, line).otherwise(F.concat(F.lit("{bad"), line)).alias("value"))
    good, bad = messages.parse_envelopes(lines)
    good = good.select("seq", "site_id", "topic", F.get_json_object("payload", "$.k").cast("int").alias("k"))
    return good.unionByName(bad.select("seq", "site_id"), allowMissingColumns=True)


@query(
    "typed_decode",
    f"{M} SELECT site_id, topic, seq, time, v0, v1, v2, v3, v4, flag_sent AS flag_in, source_sent AS weather_source FROM m",
)
def typed_decode(i: Inputs) -> DataFrame:
    return decoded(i).select("site_id", "topic", "seq", "time", *S.SLOTS, "flag_in", "weather_source")


@query(
    "default_fill",
    f"""{M} SELECT topic, seq, CASE WHEN topic = 'battery' THEN coalesce(flag_sent, false) END AS flag_in,
      CASE WHEN topic = 'solar' THEN coalesce(source_sent, 'imputed') END AS weather_source FROM m""",
)
def default_fill(i: Inputs) -> DataFrame:
    return validation.fill_defaults(decoded(i)).select("topic", "seq", "flag_in", "weather_source")


@query("range_validate", f"{J} SELECT topic, seq, ok, complete FROM j")
def range_validate(i: Inputs) -> DataFrame:
    rows = validation.reject_reasons(decoded(i))
    return rows.select("topic", "seq", validation.present_ok().alias("ok"), validation.complete().alias("complete"))


def _reason_sql() -> str:
    cases = [
        "CASE WHEN unreadable THEN 'wind_vibration: not readable' END",
        "CASE WHEN time IS NULL THEN 'timestamp: missing' END",
        "CASE WHEN topic = 'meters' AND NOT has_breakdown THEN 'breakdown: missing' END",
    ]
    for topic, spec in S.TOPICS.items():
        for slot, f in enumerate(spec.numeric):
            tests = [f"v{slot} < {f.low}" if f.low is not None else "", f"v{slot} > {f.high}" if f.high is not None else ""]
            tests = [t for t in tests if t]
            if tests:
                cases.append(
                    f"CASE WHEN topic = '{topic}' AND ({' OR '.join(tests)}) THEN '{f.name}: out of range' END"
                )
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), '; ')"


@query("reject_reasons", f"{M} SELECT topic, seq, {_reason_sql()} AS reasons FROM m")
def reject_reasons(i: Inputs) -> DataFrame:
    rows = validation.reject_reasons(decoded(i))
    return rows.select("topic", "seq", F.array_join("reasons", "; ").alias("reasons"))


_OUTLIER_SQL = """coalesce(CASE topic WHEN 'solar' THEN v0 > 75 WHEN 'wind' THEN v0 > 45
  WHEN 'battery' THEN v3 > 60 OR coalesce(flag_sent, false) WHEN 'market' THEN v2 < 49.5e0 OR v2 > 50.5e0 END, false)"""


@query("outlier_flags", f"{M} SELECT topic, seq, {_OUTLIER_SQL} AS outlier FROM m")
def outlier_flags(i: Inputs) -> DataFrame:
    rows = validation.fill_defaults(decoded(i))
    return rows.select("topic", "seq", validation.outlier().alias("outlier"))


@query("acceptance", f"{J}, {ACCEPTED_SQL} SELECT topic, seq, accepted FROM a")
def acceptance(i: Inputs) -> DataFrame:
    return accepted(i).select("topic", "seq", "accepted")


@query(
    "ingest_counts",
    f"""{J}, {ACCEPTED_SQL} SELECT topic, count(*) AS lines_read, count(*) FILTER (WHERE accepted) AS written,
      count(*) FILTER (WHERE NOT accepted) AS failed FROM a GROUP BY 1""",
)
def ingest_counts(i: Inputs) -> DataFrame:
    return validation.ingest_counts(accepted(i))


_FREEZE_SQL = "\n OR ".join(
    f"(count(v{n}) OVER w = 5 AND min(v{n}) OVER w = max(v{n}) OVER w AND NOT (max(v{n}) OVER w = 0 AND topic IN ({topics})))"
    for n, topics in enumerate(["'battery'", "'solar', 'wind'", "'solar'", "''", "''"])
)


@query(
    "flatline",
    f"""{M}, c AS (SELECT topic, seq, {', '.join(f'CAST(floor(v{n} / 40) * 40 AS DOUBLE) AS v{n}' for n in range(5))} FROM m)
    SELECT topic, seq, coalesce({_FREEZE_SQL}, false) AS frozen FROM c
    WINDOW w AS (PARTITION BY topic ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def flatline(i: Inputs) -> DataFrame:
    """Readings of coarse sensors (steps of 40), so that some stand still."""
    coarse = {v: (F.floor(F.col(v) / 40) * 40).cast("double") for v in S.SLOTS}
    sent = i.messages()
    rows = validation.decode(sent).withColumns(coarse).select("topic", "seq", *S.SLOTS)
    return validation.frozen(lay_out(rows, TOPIC, ["seq"], counted=sent)).rows().select("topic", "seq", "frozen")


def clean_present(i: Inputs) -> DataFrame:
    """Messages that are complete and valid on their own."""
    rows = validation.reject_reasons(validation.fill_defaults(decoded(i)))
    good = rows.filter(validation.present_ok() & validation.complete())
    return good.withColumn(validation.FLAG, validation.outlier())


_SHARES = " UNION ALL ".join(
    f"SELECT site_id, time, seq, '{b}', v0 * {s}, NULL, 'operational', outlier, NULL FROM g WHERE topic = 'meters'"
    for b, s in BUILDING_SHARES.items()
)
ROWS_SQL = f"""g AS (SELECT *, {_OUTLIER_SQL} AS outlier FROM j WHERE ok AND complete),
rows_ AS (
  SELECT site_id, time, seq, CASE topic WHEN 'solar' THEN 'solar_pv' WHEN 'wind' THEN 'wind_turbine'
      WHEN 'battery' THEN 'battery_bank' ELSE 'campus_aggregate' END AS asset_id,
    CASE topic WHEN 'solar' THEN v2 WHEN 'wind' THEN v1 ELSE v0 END AS power_kw,
    CASE WHEN topic = 'battery' THEN v4 END AS voltage,
    CASE topic WHEN 'solar' THEN CASE WHEN v2 > 0 OR coalesce(v1, 0) = 0 THEN 'operational' ELSE 'error' END
      WHEN 'wind' THEN CASE WHEN v1 > 0 OR coalesce(v0, 0) < 3 THEN 'operational' ELSE 'error' END
      WHEN 'battery' THEN CASE WHEN coalesce(v2, 100) > 40 THEN 'operational' ELSE 'degraded' END
      ELSE 'operational' END AS status,
    outlier AS anomaly_flag, CASE WHEN topic = 'battery' THEN v1 END AS battery_soc_pct
  FROM g WHERE topic <> 'market'
  UNION ALL {_SHARES}
)"""


@query("topic_to_rows", f"{J}, {ROWS_SQL} SELECT * FROM rows_")
def topic_to_rows(i: Inputs) -> DataFrame:
    return tables.power_rows(clean_present(i))


@query(
    "topic_to_prices",
    f"""{J} SELECT site_id, time, seq, v0 AS buy_price_inr, v1 AS sell_price_inr, v2 AS grid_frequency FROM j
    WHERE ok AND complete AND topic = 'market'""",
)
def topic_to_prices(i: Inputs) -> DataFrame:
    return tables.price_rows(clean_present(i))


@query(
    "map_explode",
    f"""{M} SELECT seq, building, v0 * share AS active_power_kw FROM m,
      (VALUES ('Academic_1', 0.6e0), ('Lab_1', 0.4e0)) b(building, share) WHERE has_breakdown""",
)
def map_explode(i: Inputs) -> DataFrame:
    return tables.building_rows(decoded(i), ["seq"]).select("seq", "building", "active_power_kw")


def metered(i: Inputs) -> DataFrame:
    """Loads of buildings as the meters sent them."""
    return tables.building_rows(validation.decode(i.meter_messages()))


_LOAD = ", ".join(tables.BUILDING_FIELDS)
_NO_LOAD = ", ".join(f"CAST(NULL AS {'VARCHAR' if kind == 'string' else 'DOUBLE'}) AS {name}" for name, kind in tables.BUILDING_FIELDS.items())


@query(
    "breakdown_variant",
    f"""WITH {T_SQL}, {METERED_SQL} SELECT site_id, time, seq, building, {_LOAD}, true AS is_object FROM metered
    UNION ALL SELECT site_id, time, seq, x.name, {_NO_LOAD}, false FROM t,
      (VALUES ('Number', 90, 100), ('Text', 0, 9), ('List', 50, 50)) x(name, low, high) WHERE topic = 'meters' AND k BETWEEN low AND high
    UNION ALL SELECT site_id, time, seq, 'Broken', 'lab', NULL, NULL, NULL, NULL, true FROM t WHERE topic = 'meters' AND k BETWEEN 20 AND 29""",
)
def breakdown_variant(i: Inputs) -> DataFrame:
    """Every entry of every breakdown, those of odd forms too."""
    return metered(i)


@query(
    "asset_status",
    f"""{J}, {ROWS_SQL} SELECT asset_id, status, count(*) AS n FROM rows_ GROUP BY 1, 2""",
)
def asset_status(i: Inputs) -> DataFrame:
    return tables.power_rows(clean_present(i)).groupBy("asset_id", "status").agg(F.count(F.lit(1)).alias("n"))


_TICK = {
    "temperature_c": "k * 0.9e0 - 8",
    "irradiance_wm2": "power_kw * 8",
    "solar_power_kw": "power_kw",
    "wind_speed_ms": "k * 0.6e0",
    "wind_power_kw": "power_kw * 2",
    "wind_vibration": "1 + k / 100.0e0",
    "battery_power_kw": "power_kw - 50",
    "battery_soc": "k + 0.5e0",
    "battery_soh": "100 - power_kw / 10",
    "battery_cell_temp": "power_kw / 2 - 10",
    "battery_voltage": "350 + k * 1.0e0",
    "demand_active_kw": "power_kw * 5",
    "demand_reactive_kvar": "power_kw * 2",
    "aggregate_power_factor": "0.5e0 + k / 200.0e0",
    "electricity_buy_price_inr": "power_kw / 10",
    "electricity_sell_price_inr": "power_kw * 0.07e0",
    "grid_frequency_hz": "48 + k * 0.04e0",
}


def ticks(i: Inputs) -> DataFrame:
    """Every event as a wide record of all five topics."""
    return spread(i.t()).select(
        "site_id",
        "seq",
        "time",
        F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        *[F.expr(e).alias(n) for n, e in _TICK.items()],
        F.lit("real_api").alias("weather_source"),
        F.expr("k >= 95").alias("anomaly_flag"),
        F.struct(F.struct(F.col("power_kw").alias("active_power_kw")).alias("Lab_1")).alias("breakdown"),
    )


@query(
    "topic_fanout",
    " UNION ALL ".join(
        f"SELECT event_id AS seq, '{t}' AS topic, {', '.join(_TICK[f.name] + f' AS v{n}' for n, f in enumerate(s.numeric[:3]))} FROM x"
        for t, s in S.TOPICS.items()
    ).replace("SELECT", "WITH x AS (SELECT *, value AS power_kw, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) SELECT", 1),
)
def topic_fanout(i: Inputs) -> DataFrame:
    """Wide ticks to five topic messages each, and back through the decoder."""
    sent = tables.topic_messages(ticks(i))
    rows = sent.select("seq", validation.topic_key(F.col("topic")).alias("topic"), F.col("value").alias("payload"))
    return validation.decode(rows).select("seq", "topic", "v0", "v1", "v2")


LAKE_SCHEMA = (
    "site_id BIGINT, seq BIGINT, time TIMESTAMP, power_kw DOUBLE, k INT, "
    "topic STRING, year STRING, month STRING, day STRING, hour STRING"
)


def _landed(i: Inputs, depth: int) -> str:
    root = scratch_path(i.spark, "lake")
    lake.write(i.t().drop("asset_id"), root, mode="overwrite", depth=depth)
    return root


_LAST = f"""WITH {T_SQL}, s AS (SELECT * FROM (SELECT *,
  row_number() OVER (PARTITION BY site_id, topic, date_trunc('second', time) ORDER BY seq DESC) AS r FROM t) WHERE r = 1)"""


@query("lake_roundtrip", f"{_LAST} SELECT site_id, topic, seq, time, power_kw, k, strftime(time, '%Y-%m-%d') AS folder FROM s")
def lake_roundtrip(i: Inputs) -> DataFrame:
    rows = lake.read(i.spark, _landed(i, 4), LAKE_SCHEMA.replace(", hour STRING", ""))
    folder = F.concat_ws("-", "year", "month", "day").alias("folder")
    return rows.select("site_id", "topic", "seq", "time", "power_kw", "k", folder)


@query(
    "lake_scan_pruned",
    f"""{_LAST} SELECT site_id, topic, seq, time, power_kw FROM s
    WHERE time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'""",
)
def lake_scan_pruned(i: Inputs) -> DataFrame:
    start, end = (F.lit(x).cast("timestamp") for x in ("2024-01-05 06:00:00", "2024-01-12 18:00:00"))
    schema = LAKE_SCHEMA.replace(", hour STRING", "")
    rows = lake.read_range(i.spark, _landed(i, 4), start, end, schema)
    return rows.select("site_id", "topic", "seq", "time", "power_kw")


_SLOT_OF = {f.name: n for spec in S.TOPICS.values() for n, f in enumerate(spec.numeric)}


@query(
    "lake_align",
    f"""{M} SELECT site_id, date_trunc('hour', time) AS time, {", ".join(
        f"arg_min(v{_SLOT_OF[field]}, seq) FILTER (WHERE topic = '{topic}' AND v{_SLOT_OF[field]} IS NOT NULL) AS {name}"
        for name, (topic, field) in align.TOPIC_COLUMNS.items())} FROM m WHERE time IS NOT NULL GROUP BY 1, 2""",
)
def lake_align(i: Inputs) -> DataFrame:
    records = decoded(i).filter(F.col("time").isNotNull())
    records = records.withColumn("time", F.date_trunc("hour", "time"))
    return align.align_topics(records.select("site_id", "time", "seq", "topic", *validation.all_named_fields()))


@query(
    "arrays_zip_explode",
    f"""WITH {T_SQL} SELECT site_id, time, power_kw AS temperature_c, k * 1.0e0 AS humidity,
      k / 3.6e0 AS wind_speed_ms, k * 1.0e0 AS cloud_cover, power_kw + power_kw AS irradiance_wm2 FROM t""",
)
def arrays_zip_explode(i: Inputs) -> DataFrame:
    """A feed of parallel arrays per site, at most a thousand readings each, read back as rows."""
    t = i.t().withColumn("k", F.col("k").cast("double"))
    packed = t.groupBy("site_id", F.floor(F.col("seq") / 1000)).agg(
        F.array_sort(F.collect_list(F.struct("time", "seq", "power_kw", "k"))).alias("r")
    )
    stamps = F.transform("r", lambda x: F.date_format(x["time"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    kw, k = F.col("r.power_kw"), F.col("r.k")
    arrays = dict(zip(weather.FEED_ARRAYS, (kw, k, k, k, kw, kw)))
    feed = packed.select(
        "site_id",
        F.struct(stamps.alias("time"), *[arrays[n].alias(a) for n, a in weather.FEED_ARRAYS.items()]).alias("hourly"),
    )
    return weather.rows(feed)


@query("export_csv_json", f"WITH {T_SQL} SELECT site_id, seq, asset_id, power_kw, k, 'csv' AS form FROM t UNION ALL SELECT site_id, seq, asset_id, power_kw, k, 'json' FROM t")
def export_csv_json(i: Inputs) -> DataFrame:
    rows = i.t().select("site_id", "seq", "asset_id", "power_kw", "k")
    csv, json = scratch_path(i.spark, "csv"), scratch_path(i.spark, "json")
    export.to_csv(rows, csv)
    export.to_json(rows, json)
    schema = "site_id BIGINT, seq BIGINT, asset_id STRING, power_kw DOUBLE, k INT"
    back = i.spark.read.schema(schema)
    return (
        back.option("header", True).csv(csv).withColumn("form", F.lit("csv"))
        .unionByName(back.json(json).withColumn("form", F.lit("json")))
    )


@query(
    "power_table_load",
    f"""{J}, {ROWS_SQL} SELECT site_id, date_trunc('hour', time) AS time, asset_id, arg_min(power_kw, seq) AS power_kw
    FROM rows_ GROUP BY 1, 2, 3""",
)
def power_table_load(i: Inputs) -> DataFrame:
    """What the power table holds after the clean messages went in twice, at hourly keys."""
    rows = tables.power_rows(clean_present(i)).withColumn("time", F.date_trunc("hour", "time"))
    both = rows.unionByName(rows.withColumn("seq", F.col("seq") + 10**12))
    return keep_first(both, ["site_id", "time", "asset_id"], ["seq"]).select("site_id", "time", "asset_id", "power_kw")

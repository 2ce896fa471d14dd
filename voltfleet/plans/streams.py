"""Streams over the event files, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.functions.timeparts import parse_iso
from voltfleet.operators import validation
from voltfleet.plans.history import IMPUTED_SQL
from voltfleet.plans.inputs import BUILDING_SHARES, T_SQL, Inputs
from voltfleet.plans.registry import query
from voltfleet.session import scratch_path, spread
from voltfleet.sources import lake, messages, tables
from voltfleet.streaming import pipelines
from voltfleet.streaming.state import judged

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(i: Inputs) -> DataFrame:
    # As a pattern the path may be one file or a folder of files.
    return i.project(i.spark.readStream.schema(EVENTS).parquet(f"{i.sf_dir}/[e]vents.parquet"))


def _frozen_sql() -> str:
    rest = {0: "'battery'", 1: "'solar', 'wind'", 2: "'solar'", 3: "''", 4: "''"}
    return " OR ".join(
        f"(count(v{n}) OVER w = 5 AND min(v{n}) OVER w = max(v{n}) OVER w AND NOT (max(v{n}) OVER w = 0 AND topic IN ({t})))"
        for n, t in rest.items()
    )


@query(
    "stream_validate",
    f"""{IMPUTED_SQL}, z AS (SELECT f.*, flag_sent, coalesce({_frozen_sql()}, false) AS frozen FROM f JOIN
        (SELECT seq, flag_sent FROM m) m USING (seq)
      WINDOW w AS (PARTITION BY site_id, topic ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT t.site_id, t.topic, t.seq, z.seq IS NOT NULL AS accepted,
      z.v0, z.v1, z.v2, z.v3, z.v4, CASE WHEN z.seq IS NOT NULL THEN frozen OR coalesce(CASE z.topic WHEN 'solar' THEN v0 > 75
        WHEN 'wind' THEN v0 > 45 WHEN 'battery' THEN v3 > 60 OR coalesce(flag_sent, false)
        WHEN 'market' THEN v2 < 49.5e0 OR v2 > 50.5e0 END, false) END AS anomaly_flag
    FROM t LEFT JOIN z USING (seq)""",
)
def stream_validate(i: Inputs) -> DataFrame:
    clean = judged(i.messages(spread(event_stream(i))))
    out = scratch_path(i.spark, "validated")
    writer = clean.select("site_id", "topic", "seq", "accepted", *S.SLOTS, validation.FLAG).writeStream.format("parquet")
    writer = writer.option("path", out).option("checkpointLocation", scratch_path(i.spark, "checkpoint"))
    pipelines.run_all(writer.trigger(availableNow=True).start())
    kept = {c: F.when(F.col("accepted"), F.col(c)) for c in (*S.SLOTS, validation.FLAG)}
    return i.spark.read.parquet(out).withColumns(kept)


@query(
    "stream_to_lake",
    f"""WITH {T_SQL} SELECT site_id, topic, seq, time, power_kw, strftime(time, '%H') AS hour FROM (SELECT *,
      row_number() OVER (PARTITION BY site_id, topic, date_trunc('second', time) ORDER BY seq DESC) AS r FROM t) WHERE r = 1""",
)
def stream_to_lake(i: Inputs) -> DataFrame:
    root = scratch_path(i.spark, "lake")
    records = event_stream(i).select("site_id", "topic", "seq", "time", "power_kw")
    pipelines.run_all(pipelines.to_lake(records, root, scratch_path(i.spark, "checkpoint"), by_hour=False))
    return lake.read(i.spark, root).select(
        "site_id", "topic", "seq", "time", "power_kw", F.date_format("time", "HH").alias("hour")
    )


def _clean_stream(i: Inputs) -> DataFrame:
    """Events as clean market and plant messages on an hourly clock, so that keys collide."""
    rows = event_stream(i).withColumn("time", F.date_trunc("hour", "time"))
    power = F.col("power_kw")
    return rows.select(
        "site_id",
        "topic",
        "seq",
        "time",
        *[power.alias(v) for v in S.SLOTS],
        F.lit(None).cast("string").alias("breakdown"),
        (F.col("k") >= 95).alias("anomaly_flag"),
    )


@query(
    "stream_dedupe",
    f"""WITH {T_SQL} SELECT site_id, asset_id, date_trunc('hour', time) AS time, arg_min(power_kw, seq) AS power_kw,
      arg_min(k >= 95, seq) AS anomaly_flag FROM t WHERE asset_id <> 'grid_market' GROUP BY 1, 2, 3""",
)
def stream_dedupe(i: Inputs) -> DataFrame:
    """The power table after the stream was loaded, and loaded again by a second run."""
    root = scratch_path(i.spark, "tables")
    tables.create_folders(i.spark, root)
    for _ in range(2):
        pipelines.run_all(pipelines.to_tables(_clean_stream(i), root, scratch_path(i.spark, "checkpoint")))
    return tables.read(i.spark, root, "telemetry_power").select(
        "site_id", "asset_id", "time", "power_kw", "anomaly_flag"
    )


@query(
    "dlq_replay",
    f"""WITH {T_SQL} SELECT site_id, time, min(seq) AS seq, arg_min(power_kw / 10, seq) AS buy_price_inr FROM t
    WHERE asset_id = 'grid_market' AND k < 95 GROUP BY 1, 2""",
)
def dlq_replay(i: Inputs) -> DataFrame:
    """Failed market messages, written as dead letters, some torn, and replayed as a stream.

    Site and order come back from the envelope, not from the payload.
    """
    folder = scratch_path(i.spark, "letters")
    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("time")
    payload = F.to_json(F.struct(stamp, (F.col("power_kw") / 10).alias("price")))
    failed = i.t().filter("asset_id = 'grid_market'").withColumn("payload", payload)
    letters = messages.dead_letters(
        failed.withColumn("topic", F.lit("telemetry.market")), F.lit("broker away"), i.now, keep=["k"]
    )
    torn = F.when(F.col("k") < 95, F.col("value")).otherwise(F.concat(F.lit("{bad"), "value"))
    messages.append_lines(letters.select(torn.alias("value")), folder)
    good, _ = messages.parse_envelopes(messages.stream_lines(i.spark, folder))
    rows = good.select("site_id", "seq", F.from_json("payload", "time string, price double").alias("p")).select("site_id", "seq", "p.*")
    rows = rows.withColumn("time", parse_iso(F.col("time")))
    out = scratch_path(i.spark, "replayed")
    writer = rows.writeStream.format("parquet").option("path", out)
    writer = writer.option("checkpointLocation", scratch_path(i.spark, "checkpoint"))
    pipelines.run_all(writer.trigger(availableNow=True).start())
    replayed = i.spark.read.parquet(out)
    return replayed.groupBy("site_id", "time").agg(
        F.min("seq").alias("seq"), F.min_by("price", "seq").alias("buy_price_inr")
    )


_FLAG_SQL = """frozen OR coalesce(CASE topic WHEN 'solar' THEN v0 > 75 WHEN 'wind' THEN v0 > 45
  WHEN 'battery' THEN v3 > 60 OR coalesce(flag_sent, false) WHEN 'market' THEN v2 < 49.5e0 OR v2 > 50.5e0 END, false)"""
_SHARES = ", ".join(f"('{name}', {share}e0)" for name, share in BUILDING_SHARES.items())
STORED_SQL = f"""{IMPUTED_SQL}, z AS (SELECT f.*, m.time, {_FLAG_SQL} AS flag FROM (SELECT f.*, flag_sent,
    coalesce({_frozen_sql()}, false) AS frozen FROM f JOIN (SELECT seq, flag_sent FROM m) n USING (seq)
    WINDOW w AS (PARTITION BY site_id, topic ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) f JOIN (SELECT seq, time FROM m) m USING (seq)),
  u AS (SELECT site_id, CASE topic WHEN 'solar' THEN 'solar_pv' WHEN 'wind' THEN 'wind_turbine' WHEN 'battery' THEN 'battery_bank'
      WHEN 'meters' THEN 'campus_aggregate' ELSE 'price' END AS name, time, seq, flag,
      CASE topic WHEN 'solar' THEN v2 WHEN 'wind' THEN v1 ELSE v0 END AS value FROM z
    UNION ALL SELECT site_id, building, time, seq, flag, v0 * share FROM z, (VALUES {_SHARES}) b(building, share) WHERE topic = 'meters')
  SELECT 'table' AS place, site_id, name, time, CAST(NULL AS VARCHAR) AS message, arg_min(value, seq) AS value,
    CASE WHEN name <> 'price' THEN arg_min(flag, seq) END AS anomaly_flag FROM u GROUP BY site_id, name, time
  UNION ALL SELECT 'lake', site_id, topic, time, CAST(seq AS VARCHAR), v0, flag FROM (SELECT *,
    row_number() OVER (PARTITION BY site_id, topic, date_trunc('second', time) ORDER BY seq DESC) AS r FROM z) WHERE r = 1
  UNION ALL SELECT 'letter', site_id, topic, NULL, CAST(seq AS VARCHAR), NULL, NULL FROM t ANTI JOIN z USING (seq)"""


def _send(messages_: DataFrame, folder: str, now) -> None:
    messages.append_lines(messages.dead_letters(messages_, F.lit("broker away"), now), folder)


def _take_in(i: Inputs, folder: str, root: str) -> None:
    good, _ = messages.parse_envelopes(messages.stream_lines(i.spark, folder))
    pipelines.run_all(pipelines.ingest(good, root, scratch_path(i.spark, "checkpoint")))


def _stored(i: Inputs, root: str) -> DataFrame:
    """What a pipeline left in the tables, the lake and the letters."""
    price = tables.read(i.spark, root, "electricity_prices").selectExpr(
        "'table' AS place", "site_id", "'price' AS name", "time", "buy_price_inr AS value", "CAST(NULL AS boolean) AS anomaly_flag"
    )
    power = tables.read(i.spark, root, "telemetry_power").selectExpr(
        "'table' AS place", "site_id", "asset_id AS name", "time", "power_kw AS value", "anomaly_flag"
    )
    landed = lake.read(i.spark, f"{root}/lake").selectExpr(
        "'lake' AS place", "site_id", "topic AS name", "time", "CAST(seq AS string) AS message", "v0 AS value", "anomaly_flag"
    )
    letters = messages.parse_envelopes(messages.read_lines(i.spark, f"{root}/dead_letters"))[0].selectExpr(
        "'letter' AS place", "site_id", "topic AS name", "CAST(seq AS string) AS message"
    )
    rest = price.unionByName(power).unionByName(landed, allowMissingColumns=True)
    # A message that is replayed and refused again has several letters.
    return rest.unionByName(letters.distinct(), allowMissingColumns=True)


@query("ingest_end_to_end", STORED_SQL)
def ingest_end_to_end(i: Inputs) -> DataFrame:
    """Lines of messages through decoding, validation and filling into lake, tables and letters, and what is there then."""
    folder, root = scratch_path(i.spark, "lines"), scratch_path(i.spark, "stored")
    tables.create_folders(i.spark, root)
    _send(i.messages(), folder, i.now)
    _take_in(i, folder, root)
    return _stored(i, root)


@query("dlq_replay_ingest", STORED_SQL)
def dlq_replay_ingest(i: Inputs) -> DataFrame:
    """Market and solar messages that a broker refused, replayed from their letters through the same pipeline into the same
    stores, and replayed once more by a third stream: nothing is there twice."""
    sent, letters = scratch_path(i.spark, "lines"), scratch_path(i.spark, "letters")
    root = scratch_path(i.spark, "stored")
    tables.create_folders(i.spark, root)
    refused = F.col("topic").isin("market", "solar")
    messages_ = i.messages()
    _send(messages_.filter(~refused), sent, i.now)
    _send(messages_.filter(refused), letters, i.now)
    for folder in (sent, letters, letters):
        _take_in(i, folder, root)
    return _stored(i, root)


@query(
    "stream_latest",
    f"""WITH {T_SQL} SELECT site_id, asset_id, time, seq, power_kw FROM (SELECT *,
      row_number() OVER (PARTITION BY site_id, asset_id ORDER BY time DESC, seq DESC) AS r FROM t) WHERE r = 1""",
)
def stream_latest(i: Inputs) -> DataFrame:
    path = scratch_path(i.spark, "latest")
    rows = event_stream(i).select("site_id", "asset_id", "time", "seq", "power_kw")
    pipelines.run_all(pipelines.latest_status(rows, path, scratch_path(i.spark, "checkpoint")))
    return pipelines.read_latest(i.spark, path)

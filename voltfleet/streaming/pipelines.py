"""Streams into the lake, the tables and the latest-status log."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltfleet.operators import tables as shape
from voltfleet.operators.aggregates import latest
from voltfleet.sources import lake, messages, tables
from voltfleet.streaming.state import judged


def _start(rows: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool, mode="append"):
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_all(query: StreamingQuery) -> None:
    """Wait for a stream that stops by itself; raise what made it fail."""
    query.awaitTermination()


def _batch_name(checkpoint: str, batch_id: int) -> str:
    """The same for a batch that is run again, and different for every stream."""
    return f"{zlib.crc32(checkpoint.encode()):08x}-{batch_id}"


def to_lake(clean: DataFrame, root: str, checkpoint: str, once: bool = True, by_hour: bool = True) -> StreamingQuery:
    """Append clean records to the lake, in folders by hour or by day. A batch that is run again replaces what it wrote, and
    other writers may use the same lake."""

    def land(batch: DataFrame, batch_id: int) -> None:
        lake.write(batch, root, depth=len(lake.PARTITIONS) - (not by_hour), batch=_batch_name(checkpoint, batch_id))

    return _start(clean, checkpoint, land, once)


def to_tables(clean: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append clean messages to the price and power tables; keys that are there already are left alone.

    A batch that is run again after a failure adds nothing twice.
    """

    def load(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        try:
            tables.insert_ignore(shape.price_rows(rows), root, "electricity_prices")
            tables.insert_ignore(shape.power_rows(rows), root, "telemetry_power")
        finally:
            rows.unpersist()

    return _start(clean, checkpoint, load, once)


def ingest(raw: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Messages to lake, tables and dead letters in one pass: what is rejected never reaches the tables.

    Several streams may feed one ``root``, such as a broker's and a replay of dead letters; each has its own ``checkpoint``.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            clean = rows.filter("accepted").drop("accepted", "reasons", "payload")
            name = _batch_name(checkpoint, batch_id)
            lake.write(clean, f"{root}/lake", depth=4, batch=name)
            tables.insert_ignore(shape.price_rows(clean), root, "electricity_prices")
            tables.insert_ignore(shape.power_rows(clean), root, "telemetry_power")
            failed = messages.dead_letters(rows.filter("NOT accepted"), F.col("reasons"), F.current_timestamp())
            failed.write.mode("overwrite").text(f"{root}/dead_letters/batch={name}")
        finally:
            rows.unpersist()

    return _start(judged(raw), checkpoint, load, once)


def latest_status(telemetry: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep a log of the newest row per site and asset; ``read_latest`` gives the current one."""
    rest = [c for c in telemetry.columns if c not in ("site_id", "asset_id")]
    newest = F.max_by(F.struct(*rest), F.struct("time", "seq")).alias("_row")
    rows = telemetry.groupBy("site_id", "asset_id").agg(newest).select("site_id", "asset_id", "_row.*")

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(rows, checkpoint, append, once, mode="update")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.parquet(path).drop("batch"), ["site_id", "asset_id"], ["time", "seq"])

"""The raw lake: Parquet by topic and date, one record per site, topic and second."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.functions.timeparts import date_parts, epoch_seconds
from voltfleet.operators.aggregates import latest
from voltfleet.session import by_folder

PARTITIONS = ("topic", "year", "month", "day", "hour")


def last_per_second(records: DataFrame, keys=("site_id", "topic"), order=("seq",)) -> DataFrame:
    """Of several records in one second the one that arrived last stays."""
    rows = records.withColumn("_second", epoch_seconds(F.col("time")))
    return latest(rows, [*keys, "_second"], order).drop("_second")


def with_partitions(records: DataFrame) -> DataFrame:
    return records.withColumns(date_parts(F.col("time")))


def _folders(spark: SparkSession, path: str) -> list[str]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().toString() for x in files.listStatus(where) if x.isDirectory()] if files.exists(where) else []


def depth_of(spark: SparkSession, root: str) -> int | None:
    """How many partition folders lie above the batches of a lake; none while it is empty."""
    depth, path = 0, f"{root}/raw"
    while inner := [x for x in _folders(spark, path) if "=" in x.rsplit("/", 1)[-1]]:
        if inner[0].rsplit("/", 1)[-1].startswith("batch="):
            return depth
        depth, path = depth + 1, inner[0]
    return None


def write(records: DataFrame, root: str, mode: str = "append", depth: int | None = None, rows_per_file=5_000_000, batch: str | int | None = None):
    """Write records under ``root``. ``depth`` 4 stops at the day, for topics with little data per hour; all writers of a lake
    use one depth, that of the first, which is 5 unless it says otherwise.

    The rows of a folder are brought together first, which gives each few files; with AQE the folder of a busy hour is split
    over several tasks. Every write gets folders of its own below these, so batch and stream writers share a lake; those of a named
    ``batch`` are replaced when the batch is run again.
    """
    spark = records.sparkSession
    known = None if mode == "overwrite" else depth_of(spark, root)
    if known is not None and depth is not None and known != depth:
        raise ValueError(f"the lake at {root} has {known} partition folders, not {depth}")
    parts = PARTITIONS[: known or depth or len(PARTITIONS)]
    rows = with_partitions(last_per_second(records)).withColumn("batch", F.lit(uuid.uuid4().hex if batch is None else str(batch)))
    rows = by_folder(rows, *parts).sortWithinPartitions(*parts, "site_id", "time")
    writer = rows.write.mode(mode).option("maxRecordsPerFile", rows_per_file)
    if batch is not None and mode == "append":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*parts, "batch").parquet(f"{root}/raw")


def _stored(spark: SparkSession, root: str, schema: str | None) -> DataFrame:
    reader = spark.read.schema(f"{schema}, batch STRING") if schema else spark.read
    return reader.parquet(f"{root}/raw").drop("batch")


def read(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """Records of the lake; of several writes of one site, topic and second the record that arrived last counts."""
    return last_per_second(_stored(spark, root, schema))


def days_between(start: Column, end: Column) -> Column:
    """Partition condition for whole days; the date text compares as dates do."""
    day = F.concat_ws("-", "year", "month", "day")
    return day.between(F.date_format(start, "yyyy-MM-dd"), F.date_format(end, "yyyy-MM-dd"))


def read_range(spark: SparkSession, root: str, start: Column, end: Column, schema: str | None = None) -> DataFrame:
    """Records with ``start <= time <= end``; folders outside the range are not opened."""
    days = _stored(spark, root, schema).filter(days_between(start, end))
    return last_per_second(days).filter(F.col("time").between(start, end))

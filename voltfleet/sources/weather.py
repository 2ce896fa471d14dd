"""Weather feed files: parallel hourly arrays to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.functions import physics
from voltfleet.functions.timeparts import parse_iso

# Column in our tables -> array in the feed.
FEED_ARRAYS = {
    "temperature_c": "temperature_2m",
    "humidity": "relative_humidity_2m",
    "wind_kmh": "wind_speed_10m",
    "cloud_cover": "cloud_cover",
    "dni": "direct_normal_irradiance",
    "dhi": "diffuse_radiation",
}


def feed_schema() -> str:
    arrays = ", ".join(f"{a}: array<double>" for a in FEED_ARRAYS.values())
    return f"site_id bigint, hourly struct<time: array<string>, {arrays}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return rows(spark.read.schema(feed_schema()).option("multiLine", True).json(path))


def rows(feed: DataFrame) -> DataFrame:
    """One row per site and hour, in SI units."""
    arrays = ["time", *FEED_ARRAYS.values()]
    zipped = F.arrays_zip(*[F.col(f"hourly.{a}").alias(a) for a in arrays])
    hours = feed.select("site_id", F.explode(zipped).alias("h"))
    c = F.col
    return hours.select(
        "site_id",
        parse_iso(c("h.time")).alias("time"),
        c("h.temperature_2m").alias("temperature_c"),
        c("h.relative_humidity_2m").alias("humidity"),
        physics.kmh_to_ms(c("h.wind_speed_10m")).alias("wind_speed_ms"),
        c("h.cloud_cover").alias("cloud_cover"),
        physics.total_irradiance(c("h.direct_normal_irradiance"), c("h.diffuse_radiation")).alias("irradiance_wm2"),
    )

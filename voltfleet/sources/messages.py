"""Topic messages in and out: JSON lines, dead letters, message brokers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.functions.once import with_columns_once
from voltfleet.operators.validation import topic_key

_CORRUPT = "_corrupt"
#: What names a message's sender and its place in the order of arrival.
ORIGIN = ("site_id", "seq")


def parse_envelopes(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Split JSON lines ``{timestamp, topic, error, payload, site_id, seq}`` into readable envelopes and bad lines.

    Site and order come from the envelope unless the input has columns of these names. Works for batch and streaming input. The payload stays text until the topic is known.
    """
    schema = f"timestamp string, topic string, error string, payload string, site_id bigint, seq bigint, {_CORRUPT} string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    parsed = with_columns_once(lines, {"_m": F.from_json(line, schema, options)})
    bad = F.col(f"_m.{_CORRUPT}").isNotNull() | F.col("_m.topic").isNull() | F.col("_m.payload").isNull()
    bad = F.coalesce(bad, F.lit(True))
    rest = [c for c in lines.columns if c != line]
    origin = [F.col(f"_m.{c}").alias(c) for c in ORIGIN if c not in rest]
    good = parsed.filter(~bad).select(
        *rest, *origin, topic_key(F.col("_m.topic")).alias("topic"), F.col("_m.payload").alias("payload")
    )
    return good, parsed.filter(bad).drop("_m")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New files of a folder as a stream of lines; ``max_files`` bounds a micro-batch."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def stream_topics(spark: SparkSession, servers: str, topics: str, max_offsets: int = 5_000_000) -> DataFrame:
    """Messages of a broker as a stream with ``topic``, ``payload`` and the arrival order ``seq``.

    Needs Spark's Kafka connector on the class path. Offsets order the messages of
    a partition, so producers should key messages by site.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", topics)
        .option("maxOffsetsPerTrigger", max_offsets)
        .option("startingOffsets", "earliest")
        .load()
    )
    return raw.select(
        F.col("key").cast("string").try_cast("bigint").alias("site_id"),
        topic_key(F.col("topic")).alias("topic"),
        F.col("offset").alias("seq"),
        F.col("value").cast("string").alias("payload"),
    )


def dead_letters(rows: DataFrame, error: Column, at: Column, topic: str = "topic", payload: str = "payload", keep=()):
    """Rows as dead-letter envelopes, one JSON line each, with the site and the order of arrival where the rows have them."""
    envelope = F.struct(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col(topic).alias("topic"),
        error.alias("error"),
        F.col(payload).alias("payload"),
        *[F.col(c).cast("bigint").alias(c) for c in ORIGIN if c in rows.columns],
    )
    return rows.select(*keep, F.to_json(envelope).alias("value"))


def append_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.DEAD_LETTER).json(path)

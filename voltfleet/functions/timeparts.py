"""Time expressions: parsing, labels, cyclic encodings, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_iso(text: Column) -> Column:
    """ISO-8601 text (``Z`` and offsets allowed) or epoch seconds to a timestamp; null when neither."""
    epoch = F.timestamp_micros((text.try_cast("double") * 1_000_000).try_cast("bigint"))
    return F.coalesce(F.try_to_timestamp(text), epoch)


def epoch_seconds(time: Column) -> Column:
    return F.unix_timestamp(time.cast("timestamp"))


def date_parts(time: Column) -> dict[str, Column]:
    """Zero-padded lake partition values."""
    return {
        "year": F.date_format(time, "yyyy"),
        "month": F.date_format(time, "MM"),
        "day": F.date_format(time, "dd"),
        "hour": F.date_format(time, "HH"),
    }


def minute_label(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm")


def clock_label(time: Column) -> Column:
    return F.date_format(time, "HH:mm")


def truncate(time: Column, unit: str) -> Column:
    return F.date_trunc(unit, time)


def is_weekend(time: Column) -> Column:
    return F.weekday(time) >= 5


def cyclic(time: Column) -> dict[str, Column]:
    """Hour of day and day of week (Monday = 0) on the unit circle."""
    hour = 2 * F.pi() * F.hour(time) / 24.0
    day = 2 * F.pi() * F.weekday(time) / 7.0
    return {
        "hour_sin": F.sin(hour),
        "hour_cos": F.cos(hour),
        "day_sin": F.sin(day),
        "day_cos": F.cos(day),
        "is_weekend": is_weekend(time).cast("int"),
    }


def age_seconds(time: Column, as_of: Column) -> Column:
    return epoch_seconds(as_of) - epoch_seconds(time)


def is_stale(time: Column, as_of: Column, limit: int = 3600) -> Column:
    """True when there is no run yet or the last one is older than ``limit`` seconds."""
    return F.coalesce(age_seconds(time, as_of) > limit, F.lit(True))

"""Decode, validate, accept and flag topic messages.

Messages arrive as ``(site_id, topic, seq, payload)`` with ``payload`` a JSON
object as text. Decoded numeric fields sit in slots ``v0..v4``; slot i is the
i-th numeric field of the row's topic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.functions.once import with_columns_once
from voltfleet.functions.timeparts import parse_iso
from voltfleet.operators import series
from voltfleet.operators.series import Series

FLAG = "anomaly_flag"


def topic_key(topic: Column) -> Column:
    """``solar`` for ``any.prefix.solar``."""
    return F.element_at(F.split(topic, r"\."), -1)


def by_topic(pick: Callable[[S.Topic], Column | None]) -> Column:
    """An expression that depends on the row's topic; null where ``pick`` gives none."""
    topic = F.col("topic")
    cases = ((name, pick(spec)) for name, spec in S.TOPICS.items())
    chain = reduce(lambda c, case: c.when(topic == case[0], case[1]), ((n, e) for n, e in cases if e is not None), F)
    return F.lit(None) if chain is F else chain.otherwise(F.lit(None))


def _numeric() -> Iterator[tuple[str, int, S.Field]]:
    for topic, spec in S.TOPICS.items():
        for slot, field in enumerate(spec.numeric):
            yield topic, slot, field


def _text_schema() -> str:
    """Every field of every topic as text: one unreadable field must not void the others."""
    names = dict.fromkeys(["timestamp"])
    for spec in S.TOPICS.values():
        names |= dict.fromkeys([f.name for f in spec.numeric] + [n for n in (spec.label, spec.flag, spec.nested) if n])
    return ", ".join(f"{n} string" for n in names)


def decode(messages: DataFrame) -> DataFrame:
    """Typed fields of every known topic; numeric text is coerced, unknown fields are dropped.

    Adds ``time``, the slots, ``flag_in``, ``weather_source``, ``breakdown`` (an object of any form, as its text) and
    ``bad_fields``: the fields that were sent but could not be read.
    """
    raw = with_columns_once(messages, {"_raw": F.from_json("payload", _text_schema())})
    sent = lambda name: F.col(f"_raw.{name}")

    def slot(i: int) -> Column:
        value = by_topic(lambda t: sent(t.numeric[i].name) if i < len(t.numeric) else None)
        return value.try_cast("double")

    flag_sent = by_topic(lambda t: sent(t.flag) if t.flag else None)
    nested_sent = by_topic(lambda t: sent(t.nested) if t.nested else None)
    decoded = with_columns_once(
        raw,
        {
            "time": parse_iso(sent("timestamp")),
            **{name: slot(i) for i, name in enumerate(S.SLOTS)},
            "flag_in": flag_sent.try_cast("boolean"),
            "weather_source": by_topic(lambda t: sent(t.label) if t.label else None).cast("string"),
            "breakdown": F.when(F.schema_of_variant(F.try_parse_json(nested_sent)).startswith("OBJECT"), nested_sent),
        },
    )

    def unread(t: S.Topic) -> Column:
        pairs = [(f.name, S.SLOTS[i]) for i, f in enumerate(t.numeric)] + [("timestamp", "time")]
        pairs += [(t.flag, "flag_in")] if t.flag else []
        pairs += [(t.nested, "breakdown")] if t.nested else []
        return F.array(*[F.when(sent(name).isNotNull() & F.col(value).isNull(), name) for name, value in pairs])

    return decoded.withColumn("bad_fields", F.array_compact(F.coalesce(by_topic(unread), F.array()))).drop("_raw")


def fill_defaults(decoded: DataFrame) -> DataFrame:
    """``anomaly_flag`` False and ``weather_source`` "imputed" where the topic has them but the message does not."""
    return decoded.withColumn(
        "flag_in", by_topic(lambda t: F.coalesce("flag_in", F.lit(False)) if t.flag else None)
    ).withColumn(
        "weather_source", by_topic(lambda t: F.coalesce("weather_source", F.lit("imputed")) if t.label else None)
    )


def _out_of_range(field: S.Field, value: Column) -> Column:
    outside = F.isnan(value) | (value < field.low)
    if field.high is not None:
        outside = outside | (value > field.high)
    return outside


def reject_reasons(decoded: DataFrame) -> DataFrame:
    """Add ``reasons``: why the fields that are there cannot be accepted. Missing numbers are not listed."""

    def absent(value: str, name: str) -> Column:
        return F.when(F.col(value).isNull() & ~F.array_contains("bad_fields", name), f"{name}: missing")

    def faults(t: S.Topic) -> Column:
        ranges = [
            F.when(_out_of_range(f, F.col(S.SLOTS[i])), f"{f.name}: out of range")
            for i, f in enumerate(t.numeric)
            if f.low is not None
        ]
        nested = [absent("breakdown", t.nested)] if t.nested else []
        return F.array(absent("time", "timestamp"), *nested, *ranges)

    unread = F.transform("bad_fields", lambda f: F.concat(f, F.lit(": not readable")))
    found = F.coalesce(by_topic(faults), F.array(F.lit("topic: unknown")))
    return with_columns_once(decoded, {"reasons": F.concat(unread, F.array_compact(found))})


def present_ok() -> Column:
    return F.size("reasons") == 0


def complete() -> Column:
    """No numeric field of the topic is missing."""
    missing = by_topic(
        lambda t: reduce(lambda a, b: a | b, [F.col(S.SLOTS[i]).isNull() for i in range(len(t.numeric))])
    )
    return ~F.coalesce(missing, F.lit(True))


def accept_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``reasons`` and ``accepted``.

    A missing number is replaced from the accepted values before it, so a message
    with gaps is accepted as soon as its series holds one complete good message.
    Where that is, is one minimum per series, combined before the shuffle and joined
    back: the messages are neither sorted nor brought together by series.
    """
    judged = reject_reasons(df).withColumn("_ok", present_ok())
    keyed = {f"_key_{k}": F.col(k) for k in keys} or {"_key": F.lit(0)}
    begun = judged.filter(F.col("_ok") & complete()).groupBy(*[c.alias(n) for n, c in keyed.items()]).agg(F.min(F.struct(*order)).alias("_begun"))
    same = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(n)) for n, c in keyed.items()])
    joined = judged.join(begun, same, "left")
    started = F.coalesce(F.struct(*order) >= F.col("_begun"), F.lit(False))
    return joined.withColumn("accepted", F.col("_ok") & started).drop("_ok", "_begun", *keyed)


def accept(s: Series) -> Series:
    """:func:`accept_rows` over a series, in its layout."""
    return s.on(accept_rows(s.df, s.keys, s.order))


def outlier() -> Column:
    """Readings that are valid but alarming."""
    low, high = S.FREQUENCY_BAND
    slot = {f.name: F.col(S.SLOTS[i]) for _, i, f in _numeric()}
    topic = F.col("topic")
    alarm = (
        F.when(topic == "solar", slot["temperature_c"] > S.SOLAR_TEMP_ALERT)
        .when(topic == "wind", slot["wind_speed_ms"] > S.WIND_SPEED_ALERT)
        .when(topic == "battery", (slot["battery_cell_temp"] > S.CELL_TEMP_ALERT) | F.col("flag_in"))
        .when(topic == "market", (slot["grid_frequency_hz"] < low) | (slot["grid_frequency_hz"] > high))
    )
    return F.coalesce(alarm, F.lit(False))


def frozen(s: Series, out: str = "frozen", slots: tuple[str, ...] = S.SLOTS) -> Series:
    """Add ``out``: some field held one value over the last five messages of its series."""
    depth = S.FREEZE_WINDOW - 1
    may_rest = {
        slot: F.col("topic").isin(
            *[n for n, i, f in _numeric() if S.SLOTS[i] == slot and f.name in S.ZERO_IS_NORMAL]
        )
        for slot in slots
    }

    def add(df: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-depth, 0)
        tests = []
        for slot in slots:
            low, high = F.min(slot).over(frame), F.max(slot).over(frame)
            same = (F.count(slot).over(frame) == S.FREEZE_WINDOW) & (low == high)
            tests.append(F.coalesce(same & ~(may_rest[slot] & (high == 0.0)), F.lit(False)))
        return df.withColumn(out, reduce(lambda a, b: a | b, tests))

    return series.windowed(s, depth, add)


def named_fields(df: DataFrame, topic: str) -> DataFrame:
    """The clean record of one topic, slots under their own names."""
    spec = S.TOPICS[topic]
    extra = [c for c in (spec.label, spec.nested) if c]
    return df.filter(F.col("topic") == topic).select(
        "site_id", "seq", "time", *[F.col(S.SLOTS[i]).alias(f.name) for i, f in enumerate(spec.numeric)], *extra, FLAG
    )


def all_named_fields() -> list[Column]:
    """Every numeric field as its own column, null outside its topic."""
    return [F.when(F.col("topic") == t, F.col(S.SLOTS[i])).alias(f.name) for t, i, f in _numeric()]


def ingest_counts(results: DataFrame) -> DataFrame:
    """Lines read, written and failed per topic, from rows with ``topic`` and ``accepted``."""
    return results.groupBy("topic").agg(
        F.count(F.lit(1)).alias("lines_read"),
        F.count_if("accepted").alias("written"),
        F.count_if(~F.col("accepted")).alias("failed"),
    )

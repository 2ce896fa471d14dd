"""Validate, impute and flag a stream with the same results as the batch operators."""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from voltfleet import schemas as S
from voltfleet.functions.once import with_columns_once
from voltfleet.operators import validation
from voltfleet.operators.imputation import mean_of
from voltfleet.session import ship_package

_WIDTH = len(S.SLOTS)
#: (topic, slot) pairs whose fields may rest at zero.
_MAY_REST = {
    (topic, i)
    for topic, spec in S.TOPICS.items()
    for i, field in enumerate(spec.numeric)
    if field.name in S.ZERO_IS_NORMAL
}
#: Series that share a hash are stepped together: a call of the state function costs far more than a row. A stream must keep
#: this number for as long as its checkpoint lives.
BUCKETS = 1024
_SERIES, _BUCKET = "_series", "_bucket"
#: Per series of a bucket the last accepted values of every slot, newest last, pickled.
STATE = T.StructType([T.StructField("histories", T.BinaryType())])


def _is_frozen(topic: str, history: list[deque]) -> bool:
    for slot, values in enumerate(history):
        if len(values) == S.FREEZE_WINDOW and min(values) == max(values):
            if not ((topic, slot) in _MAY_REST and values[0] == 0.0):
                return True
    return False


def _advance(rows: list, oks: list, topic: str, history: list[deque]) -> tuple[list, list, list]:
    """Run the rows of one series through its history: values, accepted, frozen."""
    width = len(S.TOPICS[topic].numeric)
    results, accepted, frozen = [], [], []
    for sent, ok in zip(rows, oks, strict=True):
        values = [float(v) for v in sent[:width]]
        gaps = [slot for slot, v in enumerate(values) if v != v]
        good = ok and not (gaps and not history[0])
        if good:
            for slot in gaps:
                values[slot] = mean_of(list(history[slot])[-S.IMPUTE_WINDOW :])
            for slot, v in enumerate(values):
                history[slot].append(v)
        results.append(values)
        accepted.append(good)
        frozen.append(good and _is_frozen(topic, history[:width]))
    return results, accepted, frozen


def _step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    # A micro-batch is bounded by the source's rate limit; its rows come unordered.
    rows = pd.concat(list(batches), ignore_index=True).sort_values([_SERIES, "seq"], kind="stable", ignore_index=True)
    histories = pickle.loads(state.get[0]) if state.exists else {}
    names, topics, sent = rows[_SERIES].tolist(), rows["topic"].tolist(), rows["values"].tolist()
    ok = rows["ok"].tolist()
    starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
    values, accepted, frozen = [], [], []
    for begin, end in zip(starts, [*starts[1:], len(names)], strict=True):
        topic = topics[begin]
        history = [deque(v, maxlen=S.FREEZE_WINDOW) for v in histories.get(names[begin], [[]] * _WIDTH)]
        if topic in S.TOPICS:
            made = _advance(sent[begin:end], ok[begin:end], topic, history)
        else:
            made = sent[begin:end], [False] * (end - begin), [False] * (end - begin)
        for out, new in zip((values, accepted, frozen), made, strict=True):
            out.extend(new)
        histories[names[begin]] = [list(h) for h in history]
    state.update((pickle.dumps(histories),))
    yield pd.DataFrame({"rest": rows["rest"], "values": values, "accepted": accepted, "frozen": frozen})


def judged(messages: DataFrame, keys=("site_id", "topic")) -> DataFrame:
    """Decoded stream rows with ``accepted``, filled slots and ``anomaly_flag``.

    Everything that concerns one message alone stays in built-in expressions; the
    state function only does what needs the past. It runs once per bucket of series,
    and its state is five numbers per field and series.
    """
    ship_package(messages.sparkSession)
    decoded = validation.fill_defaults(validation.decode(messages))
    rows = validation.reject_reasons(decoded).drop("bad_fields")
    rows = rows.withColumn("reasons", F.array_join("reasons", "; "))
    # Each column costs time per call, so what the state does not need crosses to Python as one text.
    fixed = [*dict.fromkeys([*keys, "topic", "seq"])]
    rest = [f for f in rows.schema.fields if f.name not in S.SLOTS]
    nan = F.lit(float("nan"))
    by_topic = [*dict.fromkeys([*keys, "topic"])]
    slim = rows.select(
        F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias(_BUCKET),
        F.to_json(F.struct(*by_topic)).alias(_SERIES),
        "topic",
        "seq",
        F.array(*[F.coalesce(v, nan) for v in S.SLOTS]).alias("values"),
        (F.col("reasons") == "").alias("ok"),
        F.to_json(F.struct(*[_as_text(f) for f in rest]), {"ignoreNullFields": "true"}).alias("rest"),
    )
    out = T.StructType(
        [
            slim.schema["rest"],
            T.StructField("values", T.ArrayType(T.DoubleType())),
            T.StructField("accepted", T.BooleanType()),
            T.StructField("frozen", T.BooleanType()),
        ]
    )
    stepped = slim.groupBy(_BUCKET).applyInPandasWithState(_step, out, STATE, "append", GroupStateTimeout.NoTimeout)
    carried = T.StructType([_text_field(f) for f in rest])
    unpacked = with_columns_once(stepped, {"rest": F.from_json("rest", carried)})
    slots = [F.nanvl(F.get("values", i), F.lit(None).cast("double")).alias(v) for i, v in enumerate(S.SLOTS)]
    back = {f.name: _from_text(f).alias(f.name) for f in rest}
    others = [column for name, column in back.items() if name not in fixed]
    flat = unpacked.select(*[back[c] for c in fixed], "accepted", "frozen", *slots, *others)
    return flat.withColumn(validation.FLAG, validation.outlier() | F.col("frozen")).drop("frozen", "flag_in")


def _as_text(field: T.StructField):
    column = F.col(field.name)
    return (F.unix_micros(column) if isinstance(field.dataType, T.TimestampType) else column).alias(field.name)


def _text_field(field: T.StructField) -> T.StructField:
    micros = isinstance(field.dataType, T.TimestampType)
    return T.StructField(field.name, T.LongType() if micros else field.dataType)


def _from_text(field: T.StructField):
    column = F.col(f"rest.{field.name}")
    return F.timestamp_micros(column) if isinstance(field.dataType, T.TimestampType) else column

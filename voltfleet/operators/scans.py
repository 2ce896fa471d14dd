"""Recurrences over series as scans: steps that compose are folded by doubling in numpy, never row by row.

A step is a function of the value before it, held as a few numbers, and two steps in a row are again one of the same kind.
So a batch of n rows takes about log2(n) vector operations, and a chunk of a long series sums up to one step, whatever its
length. What goes from batch to batch is one value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltfleet.operators import series
from voltfleet.operators.series import CHUNK, Series
from voltfleet.session import ship_package

Steps = list[np.ndarray]
_SEEN, _START = "_seen", "_start"


@dataclass(frozen=True)
class Step:
    """``names``: the columns that hold a step; ``then`` composes an earlier with a later one; ``at`` applies it to a value."""

    names: tuple[str, ...]
    then: Callable[[Steps, Steps], Steps]
    at: Callable[[Steps, np.ndarray], np.ndarray]


def _held(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.minimum(high, np.maximum(low, x))


#: ``x -> min(high, max(low, x + delta))``
CLAMP = Step(
    ("_delta", "_low", "_high"),
    lambda f, g: [f[0] + g[0], _held(f[1] + g[0], g[1], g[2]), _held(f[2] + g[0], g[1], g[2])],
    lambda f, x: _held(x + f[0], f[1], f[2]),
)
#: ``x -> factor * x + add``
AFFINE = Step(("_factor", "_add"), lambda f, g: [f[0] * g[0], f[1] * g[0] + g[1]], lambda f, x: f[0] * x + f[1])


def scan(step: Step, values: Steps, begin: np.ndarray) -> Steps:
    """For each row the composition of its series' steps up to it; ``begin`` is the place of the series' first row."""
    values = [v.copy() for v in values]
    place = np.arange(len(begin))
    wide = 1
    while len(on := np.flatnonzero(place - wide >= begin)):
        merged = step.then([v[on - wide] for v in values], [v[on] for v in values])
        for v, new in zip(values, merged, strict=True):
            v[on] = new
        wide *= 2
    return values


def _scanned(step: Step, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Steps]:
    first = batch.column(_SEEN).to_numpy() == 1
    begin = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return first, begin, scan(step, [batch.column(c).to_numpy() for c in step.names], begin)


def _laid(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    # The window brings each series together; sorting by its row number keeps it in the plan.
    df = df.withColumn(_SEEN, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return df.sortWithinPartitions(*group, _SEEN)


def _walk(df: DataFrame, step: Step, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add the value after each row; the steps and the value ``_start`` that each series begins from are columns, and go."""
    ship_package(df.sparkSession)
    laid = _laid(df, group, order)
    gone = (*step.names, _START, _SEEN)
    kept = [f for f in laid.schema.fields if f.name not in gone]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            first, begin, steps = _scanned(step, batch)
            start = np.where(np.maximum.accumulate(first), batch.column(_START).to_numpy()[begin], level)
            values = step.at(steps, start)
            level = values[-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(values)], [*names, out])

    return laid.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.DoubleType())]))


def _folded(df: DataFrame, step: Step, group: list[str], order: list[str]) -> DataFrame:
    """One row per group: all its steps as one."""
    ship_package(df.sparkSession)
    laid = _laid(df, group, order)
    schema = T.StructType([f for f in laid.schema.fields if f.name in group] + [T.StructField(c, T.DoubleType()) for c in step.names])
    ids = [f.name for f in schema.fields if f.name in group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[pa.RecordBatch, Steps] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first, begin, steps = _scanned(step, batch)
            ends = np.append(np.flatnonzero(begin[1:] != begin[:-1]), batch.num_rows - 1)
            rows, steps = batch.select(ids).take(pa.array(ends)), [v[ends] for v in steps]
            if held is not None:
                if first[0]:
                    yield pa.RecordBatch.from_arrays([*held[0].columns, *map(pa.array, held[1])], schema.names)
                else:
                    merged = step.then(held[1], [v[:1] for v in steps])
                    steps = [np.append(m, v[1:]) for m, v in zip(merged, steps, strict=True)]
            done = len(ends) - 1
            yield pa.RecordBatch.from_arrays([*rows.slice(0, done).columns, *[pa.array(v[:done]) for v in steps]], schema.names)
            held = rows.slice(done), [v[done:] for v in steps]
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held[0].columns, *map(pa.array, held[1])], schema.names)

    return laid.mapInArrow(run, schema)


def chunk_starts(s: Series, step: Step, columns: Mapping[str, Column], start: float, out: str) -> DataFrame:
    """The value that each chunk of a series in several chunks begins from; null for its first chunk.

    Each chunk is folded to one step where it lies. Only these few rows, one per chunk, are brought together by key.
    """
    long_rows = s.df.join(series.crossings(s).select(*s.group), s.group, "left_semi").select(
        *s.group, *s.order, *[columns[c].cast("double").alias(c) for c in step.names]
    )
    chunks = _folded(long_rows, step, s.group, list(s.order)).withColumn(_START, F.lit(float(start)))
    after = _walk(chunks, step, list(s.keys), [CHUNK], out)
    return after.select(*s.group, F.lag(out).over(Window.partitionBy(*s.keys).orderBy(CHUNK)).alias(out))


def walk(s: Series, step: Step, columns: Mapping[str, Column], start: float, out: str) -> Series:
    """Add ``out``: the value after each row of a series that begins from ``start``. ``columns`` give each row's step."""
    begin = F.lit(float(start))
    df = s.df
    if s.split:
        df = df.join(chunk_starts(s, step, columns, start, "_before"), s.group, "left")
        begin = F.coalesce("_before", begin)
    df = df.withColumns({c: columns[c].cast("double") for c in step.names} | {_START: begin}).drop("_before")
    return s.on(_walk(df, step, s.group, list(s.order), out))

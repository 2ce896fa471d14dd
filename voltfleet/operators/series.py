"""Ordered operators over keyed series of any length.

A window by key puts the whole series of a key in one task. That is the right
plan while series are short, and the wrong one when a single site holds a third
of all rows. ``lay_out`` counts the rows per key (a column-pruned, map-side
combined job) and then picks one of two layouts:

* *whole*: ``Window.partitionBy(keys)``, one shuffle;
* *split*: a range partitioning by ``keys + order`` gives every task one run of
  consecutive rows, and the task cuts it into chunks of at most ``limit`` rows.
  So there are as many tasks as the rows call for, however short the chunks are.
  The chunk number is written down with the rows, since range bounds are sampled
  and must not change between readers.

Operators see the earlier rows of a key that lie in other chunks either as a
halo (the last few rows, for bounded frames) or as a carry (one folded value per
chunk, for running frames). A chunk boundary crosses at most one key, so the
tables of halos and carries have a few rows per chunk. With short chunks those
are many; how they are joined is left to the planner, by their size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from voltfleet.session import materialise, max_series_rows

CHUNK = "_chunk"
HALO = "_halo"
#: Rows that one task orders when series are cut; the number of tasks follows from it.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class Series:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    tasks: int = 0  # over which the chunks are spread; 0: every series is whole

    @property
    def split(self) -> bool:
        return self.tasks > 0

    @property
    def group(self) -> list[str]:
        return [*self.keys, CHUNK] if self.split else list(self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def backwards(self) -> WindowSpec:
        """From the row on, in falling order: such a frame only ever grows, so it is folded once."""
        falling = [F.col(c).desc() for c in self.order]
        return Window.partitionBy(*self.group).orderBy(*falling).rowsBetween(Window.unboundedPreceding, 0)

    def on(self, df: DataFrame) -> Series:
        """The same layout over a frame derived row by row from ``self.df``."""
        return replace(self, df=df)

    def rows(self) -> DataFrame:
        return self.df.drop(CHUNK) if self.split else self.df


def lay_out(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    max_rows: int | None = None,
    counted: DataFrame | None = None,
) -> Series:
    """Choose the layout for ``df``. ``keys + order`` must be unique and free of nulls.

    ``counted`` may name a cheaper frame with the same rows per key, such as the
    messages that ``df`` was decoded from.
    """
    limit = max_rows or max_series_rows(df.sparkSession)
    sizes = (df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    longest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    if (longest or 0) <= limit:
        return Series(df, tuple(keys), tuple(order))
    spread = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_ROWS))
    tasks = min(math.ceil(total / limit), spread)
    ranged = df.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    # The row ids of a task run on without a gap and far apart from those of the next, so no two tasks share a chunk.
    cut = ranged.withColumn(CHUNK, F.floor(F.monotonically_increasing_id() / limit))
    return Series(materialise(cut), tuple(keys), tuple(order), tasks)


def crossings(s: Series) -> DataFrame:
    """Chunks of the keys that lie in more than one: at most two rows per chunk."""
    parts = s.df.groupBy(*s.group).agg(F.count(F.lit(1)).alias("_rows"))
    by_key = Window.partitionBy(*s.keys)
    return (
        parts.withColumn("_pos", F.row_number().over(by_key.orderBy(CHUNK)))
        .withColumn("_last", F.count(F.lit(1)).over(by_key))
        .withColumn("_total", F.sum("_rows").over(by_key))
        .filter("_last > 1")
        .drop("_rows")
    )


def _with_halo(s: Series, depth: int) -> DataFrame:
    cut = crossings(s)
    newest_first = [F.col(c).desc() for c in s.order]
    tails = (
        s.df.join(cut, s.group)
        .withColumn("_age", F.row_number().over(Window.partitionBy(*s.group).orderBy(*newest_first)))
        .filter(F.col("_age") <= depth)
        .filter("_pos < _last")
        .withColumn("_to", F.explode(F.sequence(F.col("_pos") + 1, F.least(F.col("_pos") + depth, "_last"))))
        .drop(CHUNK, "_pos", "_last", "_total", "_age")
    )
    targets = cut.select(*s.keys, F.col("_pos").alias("_to"), CHUNK)
    halo = (
        tails.join(targets, [*s.keys, "_to"])
        .withColumn("_age", F.row_number().over(Window.partitionBy(*s.group).orderBy(*newest_first)))
        .filter(F.col("_age") <= depth)
        .drop("_to", "_age")
    )
    return s.df.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))


def windowed(s: Series, depth: int, add: Callable[[DataFrame, WindowSpec], DataFrame]) -> Series:
    """Apply ``add(df, window)``, whose columns look at most ``depth`` rows back."""
    if not s.split:
        return s.on(add(s.df, s.window()))
    return s.on(add(_with_halo(s, depth), s.window()).filter(~F.col(HALO)).drop(HALO))


def with_key_rows(s: Series, name: str) -> Series:
    """Add the number of rows of the key."""
    local = F.count(F.lit(1)).over(Window.partitionBy(*s.group))
    if not s.split:
        return s.on(s.df.withColumn(name, local))
    totals = crossings(s).select(*s.group, "_total")
    df = s.df.join(totals, s.group, "left").withColumn(name, F.coalesce("_total", local)).drop("_total")
    return s.on(df)


def _with_carry(s: Series, folds: Mapping[str, tuple[Column, Callable[[WindowSpec, Column], Column]]], later=False):
    """Join, per chunk, what the other chunks of its key hold before (or after) it."""
    parts = s.df.groupBy(*s.group).agg(*[agg.alias(name) for name, (agg, _) in folds.items()])
    by_key = Window.partitionBy(*s.keys).orderBy(F.col(CHUNK).desc() if later else F.col(CHUNK).asc())
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        parts.withColumn("_pos", F.row_number().over(by_key))
        .select(*s.group, "_pos", *[merge(before, F.col(name)).alias(name) for name, (_, merge) in folds.items()])
        .filter("_pos > 1")
        .drop("_pos")
    )
    return s.df.join(carry, s.group, "left")


def forward_fill(s: Series, columns: Mapping[str, str]) -> Series:
    """``out``: the last non-null value of ``source`` up to and including the row."""
    fills = {out: F.last(source, ignorenulls=True).over(s.running()) for out, source in columns.items()}
    if not s.split:
        return s.on(s.df.withColumns(fills))
    order = F.struct(*s.order)
    folds = {
        f"_carry_{out}": (
            F.max_by(source, F.when(F.col(source).isNotNull(), order)),
            lambda w, c: F.last(c, ignorenulls=True).over(w),
        )
        for out, source in columns.items()
    }
    df = _with_carry(s, folds).withColumns({o: F.coalesce(fill, f"_carry_{o}") for o, fill in fills.items()})
    return s.on(df.drop(*folds))


def backward_fill(s: Series, columns: Mapping[str, str]) -> Series:
    """``out``: the first non-null value of ``source`` from the row on."""
    fills = {out: F.last(source, ignorenulls=True).over(s.backwards()) for out, source in columns.items()}
    if not s.split:
        return s.on(s.df.withColumns(fills))
    order = F.struct(*s.order)
    folds = {
        f"_carry_{out}": (
            F.min_by(source, F.when(F.col(source).isNotNull(), order)),
            lambda w, c: F.last(c, ignorenulls=True).over(w),
        )
        for out, source in columns.items()
    }
    df = _with_carry(s, folds, later=True)
    df = df.withColumns({o: F.coalesce(fill, f"_carry_{o}") for o, fill in fills.items()})
    return s.on(df.drop(*folds))


def first_values(s: Series, columns: Mapping[str, str]) -> Series:
    """``out``: the first non-null value of ``source`` in the series, on every row; no frame and no second sort."""
    order = F.struct(*s.order)
    first = {out: F.min_by(source, F.when(F.col(source).isNotNull(), order)) for out, source in columns.items()}
    here = {out: f.over(Window.partitionBy(*s.group)) for out, f in first.items()}
    if not s.split:
        return s.on(s.df.withColumns(here))
    # Of a series in several chunks the first chunk that has a value gives it.
    by_key = Window.partitionBy(*s.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = s.df.groupBy(*s.group).agg(*[f.alias(out) for out, f in first.items()])
    found = parts.select(*s.group, *[F.first(out, ignorenulls=True).over(by_key).alias(out) for out in first])
    return s.on(s.df.join(found, s.group, "left"))


def running_sum(s: Series, columns: Mapping[str, str]) -> Series:
    """``out``: the sum of ``source`` over all rows of the key up to the row."""
    sums = {out: F.sum(source).over(s.running()) for out, source in columns.items()}
    if not s.split:
        return s.on(s.df.withColumns(sums))
    folds = {
        f"_carry_{out}": (F.sum(source), lambda w, c: F.sum(c).over(w)) for out, source in columns.items()
    }
    df = _with_carry(s, folds)
    total = {
        out: F.when(F.col(f"_carry_{out}").isNull(), here).otherwise(
            F.coalesce(here, F.lit(0)) + F.col(f"_carry_{out}")
        )
        for out, here in sums.items()
    }
    return s.on(df.withColumns(total).drop(*folds))


def running_any(s: Series, out: str, condition: Column) -> Series:
    """``out``: whether ``condition`` held at the row or before it in the series."""
    s = s.on(s.df.withColumn(out, F.coalesce(condition, F.lit(False))))
    here = F.max(out).over(s.running())
    if not s.split:
        return s.on(s.df.withColumn(out, here))
    carry = f"_carry_{out}"
    df = _with_carry(s, {carry: (F.max(out), lambda w, c: F.max(c).over(w))})
    return s.on(df.withColumn(out, here | F.coalesce(carry, F.lit(False))).drop(carry))


def row_numbers(s: Series, out: str) -> Series:
    """``out``: the position of the row in its series, from 1."""
    numbered = running_sum(s.on(s.df.withColumn("_one", F.lit(1))), {out: "_one"})
    return s.on(numbered.df.drop("_one"))

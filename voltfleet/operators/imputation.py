"""Running-mean imputation: each gap takes the mean of the last three accepted values.

Imputed values count as accepted values for the gaps that follow, so the rule is
recursive. Its memory is short, though: three complete messages in a row fix all
that later gaps can depend on. Such a *reset* is where a long series may be cut.
The fold walks rows in order with a few numbers of state per series; it never
holds a series in memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.operators import series, validation
from voltfleet.operators.series import CHUNK, Series
from voltfleet.session import ship_package

_UNIT = "_unit"
_DECIMALS = 3


def mean_of(history: Sequence[float]) -> float:
    return round(sum(history) / len(history), _DECIMALS)


def fold_gaps(values: np.ndarray, history: deque) -> np.ndarray:
    """Fill the NaNs of one stretch in order, leaving its last values in ``history``."""
    depth = history.maxlen
    line = np.concatenate([np.fromiter(history, float), values])
    offset = len(history)
    for i in np.flatnonzero(np.isnan(line)):
        before = [x for x in line[max(0, i - depth) : i].tolist() if x == x]
        if before:
            line[i] = mean_of(before)
    for value in line[offset:][-depth:]:
        if not np.isnan(value):
            history.append(float(value))
    return line[offset:]


def _fold_partition(batches: Iterator[pd.DataFrame], unit_columns: list[str], slots: list[str]):
    current, memory = None, {}
    for batch in batches:
        if batch.empty:
            yield batch
            continue
        units = list(zip(*[batch[c].tolist() for c in unit_columns]))
        starts = [0] + [i for i in range(1, len(units)) if units[i] != units[i - 1]]
        filled = {slot: batch[slot].to_numpy(dtype=float, copy=True) for slot in slots}
        for begin, end in zip(starts, [*starts[1:], len(units)]):
            if units[begin] != current:
                current = units[begin]
                memory = {}
                for slot in slots:
                    seed = [batch[f"_{slot}_{back}"].iat[begin] for back in (2, 1)]
                    memory[slot] = deque([x for x in seed if not np.isnan(x)], maxlen=S.IMPUTE_WINDOW)
            for slot in slots:
                filled[slot][begin:end] = fold_gaps(filled[slot][begin:end], memory[slot])
        yield batch.assign(**filled)


def impute(s: Series, slots: Sequence[str] = S.SLOTS) -> Series:
    """Fill the gaps in the slots of accepted rows. ``s`` must hold accepted rows only."""
    ship_package(s.df.sparkSession)
    slots = list(slots)
    complete = validation.complete() if "topic" in s.df.columns else None
    if complete is None:
        complete = F.lit(True)
        for slot in slots:
            complete = complete & F.col(slot).isNotNull()
    original = s.df.columns
    if not s.split:
        # The window brings each series together; sorting by its row number keeps it in the plan.
        df = s.df.withColumn("_seen", F.row_number().over(s.window()))
        empty = F.lit(None).cast("double")
        df = df.withColumns({f"_{c}_{b}": empty for c in slots for b in (1, 2)}).withColumn(_UNIT, F.lit(0))
        order = ["_seen"]
    else:
        def look_back(df: DataFrame, w) -> DataFrame:
            full = F.coalesce(F.lag("_full", 1).over(w) & F.lag("_full", 2).over(w), F.lit(False))
            back = {f"_{c}_{b}": F.lag(c, b).over(w) for c in slots for b in (1, 2)}
            return df.withColumns(back).withColumn("_reset", F.when(F.col("_full") & full, F.col(CHUNK)))

        marked = series.windowed(s.on(s.df.withColumn("_full", complete)), 2, look_back)
        units = series.forward_fill(marked, {_UNIT: "_reset"})
        # Before the first reset of a series there is nothing to start from but the series itself.
        df = units.df.withColumns(
            {f"_{c}_{b}": F.when(F.col(_UNIT).isNotNull(), F.col(f"_{c}_{b}")) for c in slots for b in (1, 2)}
        ).withColumn(_UNIT, F.coalesce(_UNIT, F.lit(-1)))
        df = df.repartition(s.tasks, *s.keys, _UNIT)
        order = list(s.order)
    columns = dict.fromkeys([*original, _UNIT, *[f"_{c}_{b}" for c in slots for b in (1, 2)], *order])
    ordered = df.select(*columns).sortWithinPartitions(*s.keys, _UNIT, *order)
    unit_columns = [*s.keys, _UNIT]
    folded = ordered.mapInPandas(lambda batches: _fold_partition(batches, unit_columns, slots), ordered.schema)
    return s.on(folded.select(*original))


def impute_isolated(s: Series, column: str, out: str) -> Series:
    """Gap filling for series whose gaps are never within three rows of each other: a plain window."""

    def add(df: DataFrame, w) -> DataFrame:
        before = F.round(F.avg(column).over(w.rowsBetween(-S.IMPUTE_WINDOW, -1)), _DECIMALS)
        return df.withColumn(out, F.coalesce(column, before))

    return series.windowed(s, S.IMPUTE_WINDOW, add)


def clean(s: Series) -> tuple[Series, DataFrame]:
    """Validate, impute and flag. Returns the clean rows and the rejected rows."""
    judged = validation.accept(s.on(validation.fill_defaults(s.df)))
    rejected = judged.rows().filter(~F.col("accepted"))
    accepted = judged.on(judged.df.filter("accepted").drop("reasons", "bad_fields", "accepted"))
    flagged = validation.frozen(impute(accepted))
    df = flagged.df.withColumn(validation.FLAG, validation.outlier() | F.col("frozen")).drop("frozen", "flag_in")
    return flagged.on(df), rejected

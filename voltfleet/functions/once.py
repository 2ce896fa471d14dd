"""Columns that are computed once, however many later filters refer to them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Like ``withColumns``, for expressions that are costly, such as parsed JSON.

    A filter on a plain derived column is pushed below it with the whole
    expression copied in, once per reference. A generator's output stays put.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))

"""Named queries over the given tables, each with its SQL equivalent where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltfleet.plans.inputs import Inputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _plain_times(df: DataFrame) -> DataFrame:
    """Times leave as wall-clock values, so that they compare the same in any time zone."""
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps}) if stamps else df


#: Series longer than this are cut by the queries that show that layout.
SPLIT_ROWS = 60


def query(name: str, sql: str | None = None, split: bool = False):
    """Register ``build(inputs)``; ``sql`` is its DuckDB equivalent.

    ``split`` adds a second query of the same rows in which long series are cut into chunks.
    """

    def register(build: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain_times(build(Inputs(spark, sf_dir)))

        def run_split(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _plain_times(build(Inputs(spark, sf_dir, series_rows=SPLIT_ROWS)))

        for key, made in ((name, run), (f"{name}_split", run_split if split else None)):
            if made is not None:
                QUERIES[key] = made
                if sql is not None:
                    ORACLES[key] = sql
        return build

    return register

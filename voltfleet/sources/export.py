"""History exports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def to_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def to_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)

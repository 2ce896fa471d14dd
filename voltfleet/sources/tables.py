"""Parquet tables with first-write-wins keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet import schemas as S
from voltfleet.operators.aggregates import keep_first
from voltfleet.operators.tables import site_assets
from voltfleet.session import by_folder, path_exists


def create(spark: SparkSession, root: str, prefix: str = "") -> None:
    """Create the tables that are not there yet; the large ones are partitioned by day."""
    for name, (columns, _) in S.TABLES.items():
        layout = "" if name == "assets" else "PARTITIONED BY (date)"
        extra = "" if name == "assets" else ", date DATE"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}{extra}) USING parquet {layout} "
            f"LOCATION '{root}/{name}'"
        )
    refresh(spark, root, prefix)


def refresh(spark: SparkSession, root: str, prefix: str = "") -> None:
    """Let the catalog see the days that were written to the tables' folders."""
    for name in S.TABLES:
        if name != "assets" and path_exists(spark, f"{root}/{name}"):
            spark.catalog.recoverPartitions(f"{prefix}{name}")
        spark.catalog.refreshTable(f"{prefix}{name}")


def create_folders(spark: SparkSession, root: str) -> None:
    """Empty table folders, for use without a catalog."""
    for name, (columns, _) in S.TABLES.items():
        layout = columns if name == "assets" else columns + ", date DATE"
        writer = spark.createDataFrame([], layout).write.mode("append")
        (writer if name == "assets" else writer.partitionBy("date")).parquet(f"{root}/{name}")


def with_declared_columns(rows: DataFrame, name: str) -> DataFrame:
    """Rows of an older table version get the columns they lack as nulls."""
    declared = rows.sparkSession.createDataFrame([], S.TABLES[name][0]).schema
    missing = {f.name: F.lit(None).cast(f.dataType) for f in declared if f.name not in rows.columns}
    return rows.withColumns(missing) if missing else rows


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table under its declared schema; columns that old files lack are null."""
    extra = "" if name == "assets" else ", date DATE"
    return spark.read.schema(S.TABLES[name][0] + extra).parquet(f"{root}/{name}")


def scan(table: DataFrame, columns, order=None, condition: Column | None = None) -> DataFrame:
    rows = table if condition is None else table.filter(condition)
    rows = rows.select(*columns)
    return rows.orderBy(*order) if order else rows


def read_jdbc(spark: SparkSession, url: str, table: str, split_by: str, low, high, parts: int, **options) -> DataFrame:
    """A database table read in parallel ranges of ``split_by``. The driver jar comes from the cluster."""
    ranges = {"partitionColumn": split_by, "lowerBound": low, "upperBound": high, "numPartitions": parts}
    return spark.read.format("jdbc").options(url=url, dbtable=table, **ranges, **options).load()


def new_rows(batch: DataFrame, existing: DataFrame, keys, order=("seq",)) -> DataFrame:
    """What INSERT OR IGNORE would add: the first row per key, unless the table has the key."""
    return keep_first(batch, keys, order).join(existing.select(*keys), list(keys), "left_anti")


def insert_ignore(batch: DataFrame, root: str, name: str, order=("seq",)) -> None:
    """Append the new keys of ``batch`` to a table. Running it again adds nothing.

    Only the days that the batch touches are read from the table. A row whose key has no time is an error.
    """
    spark = batch.sparkSession
    columns, keys = S.TABLES[name]
    stamp = next(k for k in ("created_at", "updated_at", "time") if k in keys)
    dated = batch.withColumn("date", F.to_date(stamp))
    days = [row.date for row in dated.select("date").distinct().collect()]  # the days of one batch
    if None in days:
        raise ValueError(f"{name}: a key without a time; keep such rows with the dead letters")
    if not days:
        return
    existing = read(spark, root, name).filter(F.col("date").isin(days))
    wanted = [f.name for f in spark.createDataFrame([], columns).schema]
    fresh = with_declared_columns(new_rows(dated, existing, list(keys), order), name)
    fresh = by_folder(fresh.select(*wanted, "date"), "date")
    fresh.sortWithinPartitions("date", *keys).write.mode("append").partitionBy("date").parquet(f"{root}/{name}")


def append_run(predictions: DataFrame, root: str) -> None:
    """Add a forecast run. Runs are told apart by ``created_at``, so the same hours may be forecast again."""
    dated = by_folder(predictions.withColumn("date", F.to_date("created_at")), "date")
    dated.write.mode("append").partitionBy("date").parquet(f"{root}/predictions")


def seed_assets(sites: DataFrame, root: str) -> None:
    """Give sites that have no assets yet the configured ones."""
    existing = read(sites.sparkSession, root, "assets").select("site_id").distinct()
    fresh = sites.select("site_id").distinct().join(existing, "site_id", "left_anti")
    site_assets(fresh).write.mode("append").parquet(f"{root}/assets")

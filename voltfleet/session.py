"""Session set-up and the shared folder for intermediate data."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Longest series one task should order by itself; see operators.series.
MAX_SERIES_ROWS = "spark.voltfleet.maxSeriesRows"
DEFAULT_MAX_SERIES_ROWS = 4_000_000


def build_session(app: str = "voltfleet", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Keep "07" in month=07 a string.
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="voltfleet-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so that every reader sees the same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Share out the rows of a few big file splits before work that is heavy per row; many splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming:  # its splits are not known before a batch runs
        return df.repartition(cores)
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def by_folder(df: DataFrame, *columns: str) -> DataFrame:
    """Bring the rows of an output folder together, so that a write leaves few files.

    AQE sizes the tasks and splits busy folders. Batches of a stateful stream run without it, where the hint would do nothing
    and every task write to every folder.
    """
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return df.hint("rebalance", *columns)
    return df.repartition(*columns)


def max_series_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_SERIES_ROWS, str(DEFAULT_MAX_SERIES_ROWS)))


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers; needed once per application."""
    context = spark.sparkContext
    if getattr(context, "_voltfleet_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.is_dir():  # inside a zip the cluster has been given the package already
        target = Path(tempfile.mkdtemp(prefix="voltfleet-code-")) / "voltfleet.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
    context._voltfleet_shipped = True

"""What the operators share: the word rule, table reading, work tables in the shared folder, and packed byte columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.session import scratch_path, ship_package

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a near-duplicate shingle.
SHINGLE = 5


#: Bytes of a batch between Spark and its Python workers; both sides hold a few of them.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def prepare(spark: SparkSession) -> None:
    """Make this package known to the workers, and bound what one batch of long texts takes in memory, for this session."""
    ship_package(spark)
    spark.conf.set(*ARROW_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a work table to the shared folder and read it back: every later use sees the same rows, and no lineage is left."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Delete work tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.work_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def held_out() -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 modulo 3. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 3 == 1


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of one length as one compressed value; :func:`unpack` needs their types."""
    return zstandard.ZstdCompressor(level=level).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(value)
    size = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for kind in kinds:
        wide = np.dtype(kind).itemsize * size
        out.append(np.frombuffer(data, kind, size, at))
        at += wide
    return out


def release() -> None:
    """Give freed memory back to the system, for the tasks that share the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def batches(rows: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of about ``most_bytes``, one row at least, so that memory does not follow the batch size."""
    for batch in rows:
        step = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    release()

"""Connected components of a table of links: forests within batches, then alternating stars by joins and minima, and once few
links are left, all of them in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltfleet.llm import common

#: Links that one task may join up: 16 bytes each, and a few arrays of that length.
ONE_TASK = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links ``a[i] - b[i]`` but the least of its component, and that least one.

    Every link pulls the labels of both ends down to the lesser one, and labels of labels are followed until nothing moves.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (further := label[label] != label).any():
            label[further] = label[label[further]]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _stars(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars around the least nodes: no more links than nodes, and the same components."""
    for batch in rows:
        found = least_reached(*(batch.column(k).to_numpy() for k in ("a", "b")))
        yield pa.record_batch([pa.array(x, pa.int64()) for x in found], ["a", "b"])


def _all_stars(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[batch.column(k).to_numpy() for k in ("a", "b")] for batch in rows]
    if held:
        found = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.record_batch([pa.array(x, pa.int64()) for x in found], ["a", "b"])


def _large(links: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the least node around it."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("low"))
    return both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("a"), F.col("low").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the least of them."""
    least = links.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("w"), "low")
    tied = links.join(least, F.col("a") == F.col("w")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return tied.union(least.select(F.col("w").alias("a"), F.col("low").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node`` and ``component`` (its least node) of all linked nodes but the least ones; ``links`` has long columns a and b.

    Batches of links first become stars. While more than ``one_task`` links are left, a round of large and small stars follows,
    written to the shared folder in place of the one before it; the number of rounds grows with the logarithm of the longest
    path. So one task only ever joins up a number of links that was counted before.
    """
    spark = links.sparkSession
    common.prepare(spark)
    ddl = "a bigint, b bigint"
    now = common.written(links.select("a", "b").filter("a <> b").mapInArrow(_stars, ddl).distinct(), "links")
    mark = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        done = state == mark or not state[0]
        if not done and state[0] <= one_task:
            before, now = now, common.written(now.coalesce(1).mapInArrow(_all_stars, ddl), "links")
            common.done_with(before)
            done = True
        if done:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out.work_path = now.work_path
            return out
        mark, before = state, now
        now = common.written(_small(_large(now)), "links")
        common.done_with(before)

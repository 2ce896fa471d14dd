"""Pack tokenised documents into sequences of bounded length by vector best-fit.

A document's ids end with one separator id; a document longer than a sequence is cut into full pieces and a rest, any other
stays whole. A sequence has three capacities: tokens, pieces and attention cost (the sum of squared lengths). Pieces go
longest first, each to the open sequence that has room in all three and whose weighted residual norm is least afterwards.

Pieces are dealt to groups by a hash of their place in the written table, about ``GROUP`` to each, and each group is packed by
itself; with so many pieces the loss is a sequence or two per group, and neither one document with very many pieces nor many
equal rows can fill a group.

Null texts count as empty: such a document is its separator alone. Repeated rows are packed as often as they stand.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.llm import bpe, common

#: Pieces packed together, on average.
GROUP = 16_384


@dataclass(frozen=True)
class Capacity:
    tokens: int = 2048
    pieces: int = 2048
    attention: int = 2048 * 2048
    #: Weights of the three residuals.
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)


def cut_pieces(docs: DataFrame, path: str, longest: int = 2048, separator: int = 0) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length and the checksum of the ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([separator], "<u4").tobytes()
        for batch in common.batches(rows, 4 << 20):
            which, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(bpe.encode_texts(path, batch.column("text").to_pylist())):
                data, step = ids.astype("<u4", copy=False).tobytes() + end, 4 * longest
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    which.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(which, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; ``lengths`` from long to short."""
    top = np.array([capacity.tokens, capacity.pieces, capacity.attention], float)
    weights = np.array(capacity.weights) / top**2
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.zeros((3, len(lengths)))
    name = np.zeros(len(lengths), np.int64)
    open_, made = 0, 0
    least = lengths[-1] if len(lengths) else 0
    for k, size in enumerate(lengths.tolist()):
        need = np.array([size, 1.0, float(size) * size])
        rest = room[:, :open_] - need[:, None]
        fits = np.flatnonzero((rest[0] >= 0) & (rest[1] >= 0) & (rest[2] >= 0))
        if len(fits):
            near = rest[:, fits]
            at = int(fits[np.argmin(weights @ (near * near))])
            offset[k] = capacity.tokens - int(room[0, at])
            room[:, at] -= need
        else:
            if (need > top).any():
                raise ValueError(f"a piece of {size} tokens is over the capacity")
            at, open_ = open_, open_ + 1
            room[:, at], name[at] = top - need, made
            made += 1
        sequence[k] = name[at]
        if room[0, at] < least or room[1, at] < 1:  # full: close it
            open_ -= 1
            room[:, at], name[at] = room[:, open_], name[open_]
    return sequence, offset


def pack(pieces: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces."""
    pieces = common.written(pieces, "pieces")
    groups = max(1, round(pieces.count() / GROUP))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequence, offset = best_fit(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="grp").assign(sequence_id=(rows["grp"].to_numpy() << 32) + sequence, offset=offset)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return dealt.groupBy("grp").applyInPandas(run, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(cut_pieces(docs, bpe.tokenizer_path("word_bpe_49k.json")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"))

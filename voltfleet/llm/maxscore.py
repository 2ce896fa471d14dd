"""Exact search for the k highest inner products of integer vectors, by MaxScore over shards of postings.

A dimension is a term. Its weight in a query can be negative, so a posting counts as a match where weight and component have
one sign; the others only lower a score. A shard holds some thousand vectors, with its postings as columns, and the largest
component of either sign of every term. From these a query has a bound for each term.

A query's terms are sorted by bound. Those at the low end whose bounds together stay under its k-th best score so far are
non-essential: a vector that matches only them cannot enter. Essential postings are traversed for a block of queries at
once. Then the non-essential terms are probed, the highest bound first, and only for the vectors that could still reach the
k-th best score. Bounds drop nothing that ties, so the result is exact. Each task searches a stripe of the shards for a group
of queries; the tasks' best are merged by rank.

Cases: null vectors, and those with a null or non-finite component, take no part, nor does a component whose multiple is not
finite. A missing component of a shorter vector counts as 0, so an empty vector scores 0 everywhere. Rows that repeat an id
are rows of their own: each searches when its id is a query's, and none of them finds another row of that id. A row with a
null id is never a query; as a candidate it comes last among ties. Scores beyond 64 bits are held at the limits of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltfleet.llm import common

#: Vectors of a shard, queries that traverse it together, and queries that a task holds at most, in expectation.
SHARD, TOGETHER, GROUP = 4096, 256, 131_072
#: Vectors of a shard that are scored first, for a starting threshold.
FIRST = 128
#: Leaders by essential terms that are scored before the others are probed.
AHEAD = 16
#: Sums of products below this are exact in doubles.
EXACT = 2.0**53
NO_ID = np.iinfo(np.int64).max
PACKED = "cell int, kind int, size int, wide int, small boolean, ids binary, vectors binary"


def integer_vectors(batch: pa.RecordBatch, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors that take part, and floor(scale * component) as doubles, shorter vectors filled up with 0."""
    lists = batch.column(1)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.cast(lists.flatten(), pa.float64())
    x = np.array(pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False), np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * x)
    row = np.repeat(np.arange(len(size)), size)
    good = np.asarray(lists.is_valid().to_numpy(zero_copy_only=False)).copy()
    good[row[~np.isfinite(x)]] = False
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.where(np.isfinite(x), x, 0)
    which = np.flatnonzero(good)
    return which, out[which]


def _packed(cell: int, kind: int, ids: np.ndarray, vectors: np.ndarray) -> tuple:
    small = bool(np.abs(vectors).max(initial=0) < 2**15)
    data = common.pack(vectors.astype("<i2" if small else "<f8").ravel())
    return cell, kind, len(vectors), vectors.shape[1], small, common.pack(ids.astype("<i8").ravel()), data


def _unpacked(size: int, wide: int, small: bool, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    v = common.unpack(vectors, "<i2" if small else "<f8")[0].astype(np.float64).reshape(size, wide)
    return common.unpack(ids, "<i8")[0], v


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q and v; as doubles where these are exact, else as Python integers."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < EXACT:
        return q @ v.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q).dot(whole(v).T) if q.shape[1] else np.zeros((len(q), len(v)))


class Best:
    """The k best vectors found so far of each query, and the score that a new one must reach."""

    def __init__(self, size: int, k: int):
        self.k = k
        self.score = np.full((size, k), -np.inf, object)
        self.ids = np.full((size, k), NO_ID, np.int64)
        self.count = np.zeros(size, np.int64)

    def least(self, rows: np.ndarray) -> np.ndarray:
        return self.score[rows, -1].astype(np.float64)

    def take(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Merge vectors of any number of rows: the highest scores, ties to the smaller id."""
        if not len(row):
            return
        rows, own = np.unique(row), self.k
        old_row = np.repeat(rows, np.minimum(self.count[rows], own))
        place = np.arange(len(old_row)) - np.searchsorted(old_row, old_row)
        row = np.append(old_row, row)
        ids = np.append(self.ids[old_row, place], ids)
        score = np.append(self.score[old_row, place], score.astype(object))
        order = np.lexsort((ids, -score if _plain(score) else _falling(score), row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < own
        self.ids[row[keep], place[keep]], self.score[row[keep], place[keep]] = ids[keep], score[keep]
        self.count[rows] = np.minimum(np.bincount(row, minlength=len(self.count))[rows], own)


def _plain(score: np.ndarray) -> bool:
    return max(abs(int(score.max())), abs(int(score.min()))) < EXACT


def _falling(score: np.ndarray) -> np.ndarray:
    """Ranks of integers of any size, the largest first."""
    values = {s: k for k, s in enumerate(sorted(set(score.tolist()), reverse=True))}
    return np.array([values[s] for s in score.tolist()])


def search_shard(best: Best, rows: np.ndarray, own: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, stats: dict | None = None) -> None:
    """MaxScore of the queries ``rows`` (ids ``own``, vectors ``q``) over one shard; ``stats`` counts the work if given."""
    wide = min(q.shape[1], v.shape[1])
    q, v, k = q[:, :wide], v[:, :wide], best.k
    first = _products(q, v[:FIRST])
    first = np.where(ids[None, :FIRST] == own[:, None], -np.inf, first).astype(np.float64)
    theta = best.least(rows)
    if first.shape[1] >= k:
        theta = np.maximum(theta, np.partition(first, -k, axis=1)[:, -k])
    # Doubles round sums beyond 2**53; the threshold then leaves room for that.
    loose = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, wide)
    if loose >= EXACT:
        theta = theta - loose * 1e-9
    bound = np.where(q > 0, q * np.maximum(v.max(axis=0, initial=0), 0), -q * np.maximum(-v.min(axis=0, initial=0), 0))
    order = np.argsort(bound, axis=1, kind="stable")
    reach = np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1)
    outside = (reach < theta[:, None]).sum(axis=1)
    essential = np.ones(q.shape, bool)
    np.put_along_axis(essential, order, np.arange(wide)[None, :] >= outside[:, None], axis=1)
    rest = np.where(outside > 0, np.take_along_axis(reach, np.maximum(outside - 1, 0)[:, None], axis=1)[:, 0], 0.0) if wide else np.zeros(len(q))
    partial = _products(np.where(essential, q, 0.0), v)
    if partial.dtype != object and v.shape[0] > AHEAD >= k and loose < EXACT:
        # The leaders by essential terms are scored at once: they raise the threshold for all others.
        lead = np.argpartition(-partial, AHEAD, axis=1)[:, :AHEAD]
        whole_score = np.where(ids[lead] == own[:, None], -np.inf, np.einsum("ij,ikj->ik", q, v[lead]))
        theta = np.maximum(theta, np.partition(whole_score, -k, axis=1)[:, -k])
    open_ = (partial.astype(np.float64) + rest[:, None] >= theta[:, None]) & (ids[None, :] != own[:, None])
    a, b = np.nonzero(open_)
    score, rest = partial[a, b], rest[a]
    if stats is not None:
        stats["pairs"] = stats.get("pairs", 0) + partial.size
        stats["essential"] = stats.get("essential", 0) + int(essential.sum()) * len(v)
    whole = np.frompyfunc(int, 1, 1)
    for probe in range(int(outside.max(initial=0))):
        if not len(a):
            break
        at = outside[a] - 1 - probe
        more = at >= 0
        term = order[a, np.maximum(at, 0)]
        left, right = q[a, term], v[b, term]
        if score.dtype == object:
            left, right = whole(left), whole(right)
        score = score + np.where(more, left * right, 0)
        rest = np.where(more, rest - bound[a, term], 0.0)
        if stats is not None:
            stats["probes"] = stats.get("probes", 0) + int(more.sum())
        keep = score.astype(np.float64) + rest >= theta[a]
        a, b, score, rest = a[keep], b[keep], score[keep], rest[keep]
    best.take(rows[a], ids[b], score)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: float = 1.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best vectors of every row where ``is_query`` holds; see the module for the cases.

    Vectors become floor(scale * component). Every task holds one group of queries and reads the shards of one stripe as they
    come; groups and stripes are as many as make the copies of both sides even, so both grow with the root of the tasks.
    """
    spark = vectors.sparkSession
    common.prepare(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    total, asking = rows.agg(F.count("*"), F.count(F.when(F.col("asks") & F.col("vec_id").isNotNull(), 1))).first()
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, -(-total // SHARD) * -(-asking // SHARD)))
    groups = max(-(-asking // GROUP), round((tasks * asking / max(1, total)) ** 0.5), 1)
    stripes = -(-tasks // groups)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, sent = TaskContext.get().partitionId(), 0, 0
        for batch in common.batches(batches):
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                which, v = integer_vectors(part, scale)
                if not len(which):
                    continue
                ids = part.column(0).fill_null(NO_ID).to_numpy()[which]
                out = [_packed(g * stripes + (task + sent) % stripes, 1, ids, v) for g in range(groups)]
                sent += 1
                asks = np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False)[which] & (ids != NO_ID))
                key = (np.int64(task) << np.int64(36)) + seen + np.arange(len(asks))
                seen += len(asks)
                for g in range(groups):
                    own = asks[key % groups == g]
                    if len(own):
                        queries = _packed(0, 0, np.append(ids[own], key[key % groups == g]), v[own])
                        out.extend((g * stripes + s, *queries[1:]) for s in range(stripes))
                for row in out:
                    yield pa.record_batch([pa.array([x], t) for x, t in zip(row, _KINDS, strict=True)], _NAMES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best, blocks = None, [], None, []

        def found() -> pa.RecordBatch:
            if best is None:
                return pa.record_batch([pa.array([], pa.int64())] * 4, ["key", "query_id", "vec_id", "score"])
            own, key = (np.concatenate([h[x] for h in held]) for x in (0, 1))
            row, place = np.nonzero(np.arange(k)[None, :] < best.count[:, None])
            score = [max(-(2**63), min(2**63 - 1, int(s))) for s in best.score[row, place]]
            ids = best.ids[row, place]
            ids = pa.array(ids, pa.int64(), mask=ids == NO_ID)
            return pa.record_batch([pa.array(key[row]), pa.array(own[row]), ids, pa.array(score, pa.int64())], ["key", "query_id", "vec_id", "score"])

        for batch in batches:
            for row in zip(*(batch.column(c) for c in range(7)), strict=True):
                at, kind, *packed = (x.as_py() for x in row)
                if at != cell:
                    yield found()
                    cell, held, best, blocks = at, [], None, []
                ids, v = _unpacked(*packed)
                if kind == 0:
                    own, key = np.split(ids, 2)
                    held.append((own, key, v))
                    continue
                if not held:
                    continue
                if best is None:
                    best = Best(sum(len(h[0]) for h in held), k)
                    blocks = _blocks(held)
                for rows_, own, q in blocks:
                    search_shard(best, rows_, own, q, ids, v)
        yield found()
        common.release()

    dealt = rows.mapInArrow(deal, PACKED).repartition(groups * stripes, "cell").sortWithinPartitions("cell", "kind")
    shard_best = dealt.mapInArrow(search, "key bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = shard_best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


_NAMES = [c.split()[0] for c in PACKED.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]


def _blocks(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries in blocks that traverse a shard together: row numbers, ids, vectors."""
    own = np.concatenate([h[0] for h in held])
    wide = max(h[2].shape[1] for h in held)
    q = np.concatenate([np.pad(h[2], ((0, 0), (0, wide - h[2].shape[1]))) for h in held])
    return [(np.arange(at, min(at + TOGETHER, len(own))), own[at : at + TOGETHER], q[at : at + TOGETHER]) for at in range(0, len(own), TOGETHER)]


#: The contract: queries are the ids divisible by this, with so many results, over 256-fold components.
EVERY, RESULTS, SCALE = 50, 5, 256.0


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, RESULTS, SCALE)


ORACLE = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({int(SCALE)} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= {RESULTS}
"""

"""Prefix trie of conversations: members, children, leaves and tokens saved of every distinct sequence of first turns.

A prefix is named by a 128-bit digest, the sum of its turns' digests mixed with their places; so digests of parts of one
conversation can be computed apart and added. Rows of conversations are dealt to shards. A shard lists its distinct prefix
digests, gives each a slot of a minimal perfect hash, and verifies every look-up against the digest, the depth and the parent
that the slot holds. Counts are scattered into flat arrays. Counts of one prefix in several shards are added, the node's
owner is the shard of its smallest member, and values of owned nodes are accumulated through the parent slots, the deepest
first. Since every shard holds the whole path of its conversations, adding the shards' sums gives each node its subtree.

Turns are ranked over sorted ranges of rows, and a conversation that crosses ranges or has more than ``PIECE`` turns lies in
pieces. A later piece is a chain of its own; what its nodes add to those before it is summed over the pieces of the
conversation and carried back. So no task holds a conversation, a first turn or a group of copies whole.

Cases: rows with a null conversation id take no part. Null turns come first, null roles and texts are empty. Rows with one
turn number are ordered by their digest; repeated rows are turns of their own. A table without rows has no nodes. The id list
of a node is hashed in one task, as SHA-256 demands, from joined pieces that the tasks before made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltfleet.llm import common
from voltfleet.llm.shingles import mix

#: Turns of one piece of a conversation, turns of a shard in expectation, ids joined before they are hashed.
PIECE, SHARD_TURNS, JOINED = 4096, 100_000, 500
#: Bytes of a turn's digest.
WIDE = 16
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class PerfectHash:
    """Distinct 128-bit keys to slots 0, 1, ..., n - 1. On each level the keys that have a place to themselves get it, as a bit
    whose rank is the slot; the others go on to the next level. ``slots`` compares the stored key and gives -1 for a stranger."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.stored = np.zeros_like(keys)
        left, base = np.arange(len(keys)), 0
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("two keys are equal")
            at = self._place(keys[left], len(self.levels), len(left) * 3 // 2 + 1)
            alone = np.bincount(at, minlength=len(left) * 3 // 2 + 1) == 1
            rank = np.cumsum(alone) - 1 + base
            fits = alone[at]
            self.stored[rank[at[fits]]] = keys[left[fits]]
            self.levels.append((alone, rank, len(alone)))
            base += int(fits.sum())
            left = left[~fits]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = [np.uint64(level * int(p) % 2**64) for p in PLACE]
        h = mix(keys[:, 0] + salt[0]) ^ mix(keys[:, 1] + salt[1])
        return (h % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (alone, rank, size) in enumerate(self.levels):
            at = self._place(keys[open_], level, size)
            hit = alone[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        known = np.flatnonzero(out >= 0)
        out[known[(self.stored[out[known]] != keys[known]).any(axis=1)]] = -1
        return out


def _signed(keys: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(keys[:, j]).view(np.int64)) for j in (0, 1)]


def _digests(*columns: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(c.fill_null(0).to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for c in columns], axis=1)


def turn_digests(turns: bytes, place: np.ndarray) -> np.ndarray:
    """Digests of turns, each mixed with its place in the conversation, the first being 1."""
    t = np.frombuffer(turns, "<u8").reshape(-1, 2)
    return np.stack([mix(t[:, j] ^ (place.astype(np.uint64) * PLACE[j])) for j in (0, 1)], axis=1)


# ---- turns to pieces of conversations


def pieces(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = PIECE
) -> tuple[DataFrame, DataFrame]:
    """Conversations in order, a row per piece of at most ``most`` turns: conv_id, start (turns before it), n, turns (digests)
    and sizes (text bytes). The second is the work table that the rows are read from."""
    spark = conversations.sparkSession
    said, by = (F.coalesce(F.col(c), F.lit("")) for c in (text, role))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said))).alias("digest"),
        F.octet_length(said).alias("size"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[bytes, bytes]] = []
        conv, start, n = None, 0, 0
        out: list[tuple] = []

        def close() -> None:
            nonlocal held, start, n
            if n:
                out.append((part, conv, start, n, b"".join(h[0] for h in held), b"".join(h[1] for h in held)))
            held, start, n = [], start + n, 0

        def rows_() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            made = pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "conv_id", "start", "n", "turns", "sizes"])
            out.clear()
            return made

        for batch in common.batches(batches):
            ids = batch.column(0).to_numpy()
            turns = b"".join(batch.column(2).to_pylist())
            sizes = batch.column(3).to_numpy().astype("<u4").tobytes()
            cuts = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                if ids[a] != conv:
                    close()
                    conv, start = int(ids[a]), 0
                while a < b:
                    end = min(b, a + most - n)
                    held.append((turns[WIDE * a : WIDE * end], sizes[4 * a : 4 * end]))
                    n += end - a
                    a = end
                    if n == most:
                        close()
            yield rows_()
        close()
        yield rows_()

    made = common.written(dealt.mapInArrow(run, "part int, conv_id bigint, start bigint, n bigint, turns binary, sizes binary"), "pieces")
    # Only the first conversation of a range goes on from another one, and only the last of a range is gone on with.
    here = Window.partitionBy("part")
    ends = made.groupBy("part", "conv_id").agg(F.sum("n").alias("n"))
    edges = ends.withColumn("low", F.min("conv_id").over(here)).withColumn("high", F.max("conv_id").over(here)).filter("conv_id = low or conv_id = high")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select("part", "conv_id", before.alias("before")).filter("before is not null")
    return made.join(edges, ["part", "conv_id"], "left").select("conv_id", (F.col("start") + F.coalesce("before", F.lit(0))).alias("start"), "n", "turns", "sizes"), made


def _cut(col: Column, wide: int, start: Column, n: Column | None = None) -> Column:
    """Part of a row of values of so many bytes."""
    size = F.octet_length(col) if n is None else (n * wide).cast("int")
    return F.substring(col, (start * wide + 1).cast("int"), size)


def rebuilt(pieces: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """Pieces of every conversation whose first ``head`` turns (at most ``most``) are replaced by those of conversation ``base``.

    Columns: conv_id, start (identifies the piece; 0 for the first, which is there even without turns), depth (turns before it),
    n, turns, sizes.
    """
    near = pieces.filter(F.col("start") < most)
    left = F.lit(most) - F.col("start")
    near = near.select("conv_id", F.struct("start", _cut(F.col("turns"), WIDE, F.lit(0), left).alias("turns"), _cut(F.col("sizes"), 4, F.lit(0), left).alias("sizes")).alias("x"))
    joined = near.groupBy(F.col("conv_id").alias("from")).agg(F.array_sort(F.collect_list("x")).alias("x"))  # at most ``most`` rows each
    whole = lambda c: F.aggregate("x", F.lit(b""), lambda a, x: F.concat(a, x[c]))
    heads = joined.select("from", whole("turns").alias("head_turns"), whole("sizes").alias("head_sizes"))
    own = pieces.withColumn("head", head.cast("long")).withColumn("from_", base)
    met = own.join(heads, F.col("from_") == F.col("from"), "left")
    taken = F.least("head", F.coalesce(F.floor(F.octet_length("head_turns") / WIDE), F.lit(0)))
    skip = F.greatest(F.col("head") - F.col("start"), F.lit(0))

    def content(name: str, wide: int) -> Column:
        first = F.coalesce(_cut(F.col(f"head_{name}"), wide, F.lit(0), taken), F.lit(b""))
        return F.concat(F.when(F.col("start") == 0, first).otherwise(F.lit(b"")), _cut(F.col(name), wide, skip))

    depth = F.when(F.col("start") == 0, 0).otherwise(taken + F.greatest(F.col("start") - F.col("head"), F.lit(0)))
    made = met.select("conv_id", "start", depth.cast("long").alias("depth"), content("turns", WIDE).alias("turns"), content("sizes", 4).alias("sizes"), F.col("from_").alias("near"))
    n = F.floor(F.octet_length("turns") / WIDE)
    return made.withColumn("n", n.cast("long")).filter("n > 0 or start = 0")


# ---- pieces to nodes

_PIECE_COLUMNS = ("conv_id", "start", "depth", "n", "turns", "sizes", "h0", "l0", "h1", "l1", "last")
_LOCAL = (
    "shard int, k0 bigint, k1 bigint, depth bigint, p0 bigint, p1 bigint, has_parent boolean, s0 bigint, s1 bigint, size bigint, "
    "n_here bigint, ends_here bigint, low_here bigint, chain bigint, chain_start bigint, end_conv bigint"
)
_PARTIAL = (
    "k0 bigint, k1 bigint, depth bigint, n_convs bigint, conv_id bigint, parent_conv_id bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, chain bigint, chain_start bigint, entry boolean"
)


def _halves(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sums of the upper and of the lower 32 bits as one number modulo 2**64."""
    return (high.astype(np.uint64) << np.uint64(32)) + low.astype(np.uint64)


def _load(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _PIECE_COLUMNS if c not in ("turns", "sizes")}
    cols["entry"] = np.stack([_halves(cols[f"h{j}"].astype(np.int64), cols[f"l{j}"].astype(np.int64)) for j in (0, 1)], axis=1)
    n = cols["n"]
    row = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(row)) - first[row] + 1
    mixed = turn_digests(b"".join(batch.column("turns").to_pylist()), cols["depth"][row] + place)
    sums = np.zeros((len(row) + 1, 2), np.uint64)
    np.cumsum(mixed, axis=0, out=sums[1:])
    cols["key"] = sums[1:] - sums[first][row] + cols["entry"][row]
    cols["row"], cols["place"], cols["first"] = row, place, first
    cols["size"] = np.frombuffer(b"".join(batch.column("sizes").to_pylist()), "<u4").astype(np.int64)
    return cols


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows sorted by shard, a shard at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)).tolist() if len(shard) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column("shard")[0].as_py() != shard[a]:
                yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column("shard")[0].as_py(), pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    common.release()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local nodes of each shard with their counts, and a row for the node where each conversation ends."""
    for shard, batch in _by_shard(batches):
        c = _load(batch)
        row, pieces_ = c["row"], len(c["n"])
        # Later pieces are chains of their own: a shift keeps their nodes apart from all others.
        later = c["start"] > 0
        name = mix(c["conv_id"].astype(np.uint64) * PLACE[0] + c["start"].astype(np.uint64))
        shift = np.where(later[:, None], np.stack([name, mix(name)], axis=1), np.uint64(0))
        key = np.concatenate([c["entry"], c["key"]])
        which = np.append(np.arange(pieces_), row)
        parent = np.concatenate([np.zeros((pieces_, 2), np.uint64), np.roll(c["key"], 1, axis=0)])
        parent[pieces_:][c["place"] == 1] = c["entry"][row[c["place"] == 1]]
        depth = np.append(c["depth"], c["depth"][row] + c["place"])
        member = np.append(~later, np.ones(len(row), bool))
        size = np.append(np.zeros(pieces_, np.int64), c["size"])
        local = key + shift[which]
        table = PerfectHash(np.unique(local, axis=0))
        at = table.slots(local)
        nodes = len(table.stored)
        one = np.zeros(nodes, np.int64)
        one[at] = np.arange(len(at))
        if (at < 0).any() or (depth[one[at]] != depth).any() or (parent[one[at]] != parent).any() or (size[one[at]] != size).any():
            raise ValueError("two prefixes have one digest")
        low = np.full(nodes, np.iinfo(np.int64).max)
        np.minimum.at(low, at[member], c["conv_id"][which[member]])
        ending = np.flatnonzero(c["last"])
        end = at[np.where(c["n"][ending] > 0, pieces_ + c["first"][ending] + c["n"][ending] - 1, ending)]
        count = np.bincount(at, weights=member, minlength=nodes).astype(np.int64)
        chained = later[which[one]]
        own = c["conv_id"][which[one]], c["start"][which[one]]
        cols = [
            *_signed(key[one]),
            pa.array(depth[one]),
            *_signed(parent[one]),
            pa.array(one >= pieces_),
            *_signed(shift[which[one]]),
            pa.array(size[one]),
            pa.array(count),
            pa.array(np.bincount(end, minlength=nodes).astype(np.int64)),
            pa.array(low, mask=count == 0),
            *(pa.array(x, mask=~chained) for x in own),
            pa.nulls(nodes, pa.int64()),
        ]
        yield _limited(shard, cols)
        none = lambda kind, n=len(ending): pa.nulls(n, kind)
        cols = [*_signed(key[one[end]]), pa.array(depth[one[end]])] + [none(c.type) for c in cols[3:-1]] + [pa.array(c["conv_id"][ending])]
        yield _limited(shard, cols)


def _limited(shard: int, cols: list[pa.Array]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _LOCAL.split(", ")]
    return pa.record_batch([pa.array(np.full(len(cols[0]), shard, np.int32)), *cols], names)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of owned values over the part of each local node's subtree that its shard holds."""
    for _, batch in _by_shard(batches):
        g = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("depth", "size", "n_convs", "n_ends", "conv_id")}
        key, shift, parent = (_digests(batch.column(a), batch.column(b)) for a, b in (("k0", "k1"), ("s0", "s1"), ("p0", "p1")))
        below = batch.column("has_parent").to_numpy(zero_copy_only=False)
        table = PerfectHash(key + shift)
        at = table.slots(key + shift)
        nodes = len(at)
        to_slot = np.zeros(nodes, np.int64)
        to_slot[at] = np.arange(nodes)
        f = {c: v[to_slot] for c, v in g.items()}
        below = below[to_slot]
        up = np.full(nodes, -1, np.int64)
        up[below] = table.slots((parent + shift)[to_slot][below])
        if (up[below] < 0).any() or (f["depth"][up[below]] + 1 != f["depth"][below]).any():
            raise ValueError("two prefixes have one digest")
        low = batch.column("low_here").fill_null(-1).to_numpy()[to_slot]
        own = batch.column("low_here").is_valid().to_numpy(zero_copy_only=False)[to_slot] & (low == f["conv_id"])
        children = np.bincount(up[below & own], minlength=nodes).astype(np.int64)
        leaves = (own & (f["n_ends"] == f["n_convs"])).astype(np.int64)
        saved = np.where(own, (f["n_convs"] - 1) * f["size"], 0)
        order = np.argsort(-f["depth"][below], kind="stable")
        inner = np.flatnonzero(below)[order]
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(f["depth"][inner]) != 0)), len(inner)) if len(inner) else np.zeros(1, np.int64)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            level = inner[a:b]
            np.add.at(leaves, up[level], leaves[level])
            np.add.at(saved, up[level], saved[level])
        above = pa.array(f["conv_id"][np.maximum(up, 0)], mask=~below)
        chain = [batch.column(c).take(pa.array(to_slot)) for c in ("chain", "chain_start")]
        entry = ~below & chain[0].is_valid().to_numpy(zero_copy_only=False)
        cols = [*_signed(key[to_slot]), *(pa.array(f[c]) for c in ("depth", "n_convs", "conv_id")), above, pa.array(children), pa.array(leaves), pa.array(saved), *chain, pa.array(entry)]
        yield pa.record_batch(cols, [c.split()[0] for c in _PARTIAL.split(", ")])


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every node of a piece, what the later pieces of its conversation add."""
    for batch in common.batches(batches):
        c = _load(batch)
        lead = np.flatnonzero(c["start"] == 0)
        key, which = np.concatenate([c["entry"][lead], c["key"]]), np.append(lead, c["row"])
        depth = np.append(c["depth"][lead], c["depth"][c["row"]] + c["place"])
        more = [pa.array(batch.column(x).to_numpy()[which]) for x in ("n_leaves", "saved_tokens")]
        yield pa.record_batch([*_signed(key), pa.array(depth), *more], ["k0", "k1", "depth", "n_leaves", "saved_tokens"])


def _piece_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each piece alone, in halves that add up without overflow."""
    for batch in common.batches(batches):
        c = _load(batch)
        total = np.zeros((len(c["n"]), 2), np.uint64)
        some = np.flatnonzero(c["n"])
        total[some] = c["key"][c["first"][some] + c["n"][some] - 1]
        halves = [pa.array(x.astype(np.int64)) for j in (0, 1) for x in (total[:, j] >> np.uint64(32), total[:, j] & np.uint64(0xFFFFFFFF))]
        yield pa.record_batch([batch.column("conv_id"), batch.column("start"), *halves], ["conv_id", "start", "h0", "l0", "h1", "l1"])


def _ends_sha256(ends: DataFrame) -> DataFrame:
    """k0, k1, depth and the SHA-256 of the ids that end at each node, in order and joined by commas."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        key = np.stack([batch.column(c).to_numpy() for c in ("k0", "k1", "depth")], axis=1)
        cuts = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))), len(key)).tolist()
        yield from zip(cuts, cuts[1:], strict=False)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(batches):
            ids, begin, text = batch.column("end_conv").to_pylist(), [], []
            for a, b in runs(batch):
                for at in range(a, b, JOINED):
                    begin.append(at)
                    text.append(",".join(map(str, ids[at : min(b, at + JOINED)])))
            head = batch.take(pa.array(begin, pa.int64()))
            yield pa.record_batch([*head.columns, pa.array(text)], ["k0", "k1", "depth", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, names = None, None, ["k0", "k1", "depth", "ends_sha256"]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True)], names)

        for batch in common.batches(batches):
            out = []
            for *now, _, ids in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if now != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield made(out)
        if state is not None:
            yield made([(*key, state.hexdigest())])

    keys = ["k0", "k1", "depth"]
    sorted_ = ends.select(*keys, "end_conv").repartitionByRange(parts, *keys, "end_conv").sortWithinPartitions(*keys, "end_conv")
    joined = sorted_.mapInArrow(join, "k0 bigint, k1 bigint, depth bigint, first bigint, ids string")
    return joined.repartition(parts, *keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, "k0 bigint, k1 bigint, depth bigint, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """Nodes of the trie of ``paths``, pieces as :func:`rebuilt` gives them, written to the shared folder.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    spark = paths.sparkSession
    common.prepare(spark)
    paths = common.written(paths, "paths")
    spans = paths.filter("start > 0").select("conv_id").distinct()
    nothing = [F.lit(0).cast("long").alias(c) for c in ("h0", "l0", "h1", "l1")]
    long_ = paths.join(spans, "conv_id", "left_semi").select(*_PIECE_COLUMNS[:6], *nothing, F.lit(False).alias("last"))
    before = Window.partitionBy("conv_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    entries = long_.mapInArrow(_piece_sums, "conv_id bigint, start bigint, h0 bigint, l0 bigint, h1 bigint, l1 bigint")
    last = F.lead("start").over(Window.partitionBy("conv_id").orderBy("start")).isNull()
    entries = common.written(entries.select("conv_id", "start", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("h0", "l0", "h1", "l1")), last.alias("last")), "entries")
    full = paths.join(entries, ["conv_id", "start"], "left")
    full = full.select(*_PIECE_COLUMNS[:6], "near", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("h0", "l0", "h1", "l1")), F.coalesce("last", F.lit(True)).alias("last"))
    turns = paths.agg(F.sum("n")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    home = F.when(F.col("start") == 0, F.pmod(F.xxhash64("near"), F.lit(shards))).otherwise(F.lit(shards) + F.pmod(F.xxhash64("conv_id", "start"), F.lit(shards)))
    dealt = full.withColumn("shard", home.cast("int")).repartition(shards, "shard").sortWithinPartitions("shard")
    local = common.written(dealt.select("shard", *_PIECE_COLUMNS).mapInArrow(_count, _LOCAL), "local")
    node = Window.partitionBy("k0", "k1", "depth")
    one_parent = [F.min(c).over(node).eqNullSafe(F.max(c).over(node)) for c in (F.when(F.col("has_parent"), F.col(p)) for p in ("p0", "p1"))]
    n_convs = F.when(one_parent[0] & one_parent[1], F.sum("n_here").over(node)).otherwise(F.raise_error(F.lit("two prefixes have one digest")))
    counted = local.filter("end_conv is null").select(
        "shard", "k0", "k1", "depth", "p0", "p1", "has_parent", "s0", "s1", "low_here", "chain", "chain_start",
        F.max("size").over(node).alias("size"),
        n_convs.alias("n_convs"),
        F.sum("ends_here").over(node).alias("n_ends"),
        F.min("low_here").over(node).alias("conv_id"),
    )
    partial = common.written(counted.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_accumulate, _PARTIAL), "partial")
    made = partial.filter(~F.col("entry") & F.col("chain").isNull()).unionByName(partial.filter(F.col("chain").isNotNull()))
    made = made.withColumns({c: F.when(~F.col("entry"), F.col(c)) for c in ("n_leaves", "saved_tokens")})
    # What the later pieces of a conversation add to all nodes of one piece.
    sums = partial.filter("entry").select(F.col("chain").alias("conv_id"), F.col("chain_start").alias("start"), "n_leaves", "saved_tokens")
    after = Window.partitionBy("conv_id").orderBy(F.col("start").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = entries.select("conv_id", "start").join(sums, ["conv_id", "start"], "left")
    known = known.select("conv_id", "start", *(F.sum(c).over(after).alias(c) for c in ("n_leaves", "saved_tokens"))).filter("n_leaves > 0 or saved_tokens > 0")
    carried = full.join(known, ["conv_id", "start"]).select(*_PIECE_COLUMNS, "n_leaves", "saved_tokens")
    carried = carried.mapInArrow(_carried, "k0 bigint, k1 bigint, depth bigint, n_leaves bigint, saved_tokens bigint")
    every = made.unionByName(carried, allowMissingColumns=True).groupBy("k0", "k1", "depth")
    summed = every.agg(
        F.max("conv_id").alias("conv_id"),
        F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
    )
    ends = _ends_sha256(local.filter("end_conv is not null"))
    named = summed.join(ends, ["k0", "k1", "depth"], "left")
    nodes = common.written(
        named.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        ),
        "nodes",
    )
    common.done_with(paths, entries, local, partial)
    return nodes


#: The contract: every conversation takes up to 8 turns, by a hash of its id, from the one whose id is its own less the rest by 5.
TURNS, NEAR = 9, 5


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, work = pieces(common.table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    nodes = trie(rebuilt(found, F.crc32(conv.cast("string")) % TURNS, conv - conv % NEAR, TURNS - 1))
    common.done_with(work)
    return nodes


#: crc32 of the decimal id, bit by bit: a number is taken in, -1 is a shift.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""
ORACLE = f"""
WITH said AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (SELECT c, turn, md5(octet_length(CAST(encode(role) AS BLOB)) || ':' || role || text) AS t, octet_length(encode(text)) AS size FROM said),
own AS (SELECT c, list(t ORDER BY turn NULLS FIRST, t) AS ts, list(size ORDER BY turn NULLS FIRST, t) AS sizes FROM hashed GROUP BY c),
heads AS (SELECT *, {_CRC} % {TURNS} AS h FROM own),
made AS (
  SELECT a.c, coalesce(b.ts[1:a.h], []) || a.ts[a.h + 1:] AS ts, coalesce(b.sizes[1:a.h], []) || a.sizes[a.h + 1:] AS sizes
  FROM heads a LEFT JOIN own b ON b.c = a.c - a.c % {NEAR}),
paths AS (
  SELECT c, len(ts) AS ends, d AS depth, CASE WHEN d = 0 THEN '' ELSE md5(array_to_string(ts[1:d], ',')) END AS k,
         CASE WHEN d = 1 THEN '' WHEN d > 1 THEN md5(array_to_string(ts[1:d - 1], ',')) END AS p, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size
  FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM made)),
nodes AS (
  SELECT depth, k, min(p) AS p, min(c) AS conv_id, count(*) AS n_convs, min(size) AS size, count(*) FILTER (ends = depth) AS n_ends,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends = depth), '')) AS ends_sha256
  FROM paths GROUP BY depth, k),
owned AS (
  SELECT o.c, o.depth, o.k, CASE WHEN o.c = n.conv_id AND n_ends = n_convs THEN 1 ELSE 0 END AS leaf,
         CASE WHEN o.c = n.conv_id THEN (n_convs - 1) * n.size ELSE 0 END AS saved FROM paths o JOIN nodes n ON o.depth = n.depth AND o.k = n.k),
below AS (
  SELECT depth, k, sum(leaf) OVER w AS leaves, sum(saved) OVER w AS saved FROM owned
  WINDOW w AS (PARTITION BY c ORDER BY depth DESC)),
summed AS (SELECT depth, k, sum(leaves) AS n_leaves, sum(saved) AS saved FROM below GROUP BY depth, k),
children AS (SELECT depth - 1 AS depth, p AS k, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(x.n, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN summed s ON s.depth = n.depth AND s.k = n.k LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.k = n.p
LEFT JOIN children x ON x.depth = n.depth AND x.k = n.k
"""

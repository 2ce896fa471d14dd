"""Documents linked by the Jaccard similarity of their five-word shingle sets, and the groups that links make.

Equal sets are one node. A node enters the tiles of its rarest shingles: two sets of similarity ``s`` share one of the first
``n - ceil(s n) + 1`` shingles of each in any common order, and the order puts frequent shingles last, by a count of hashed
shingles over all documents. Tiles are banded by set size. In a tile a hashed bitmap of each set bounds the overlap
from above: every bit that only one of two sets has stands for an element that the other lacks. What passes is counted
exactly on sorted hash arrays.

Links are looked for in two steps. First, in a few of its tiles and in blocks of large ones, every node is held against those
few that its signature is nearest to; the links found make groups. Then, in all tiles that still hold nodes of different
groups, every pair from different groups is judged; a large tile is worked on by pairs of blocks. In both, a pair whose nodes
other links have joined already is skipped. So a tile of many near copies costs about as many exact checks as it has nodes,
no link between two groups is missed, and no task holds a large tile.

Null and empty texts and those without words have no shingles and link with nothing; fewer than five words are one shingle.
Equal texts always link. A null doc_id is a document too; a group's id is its least id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltfleet.llm import common
from voltfleet.llm.components import components
from voltfleet.llm.shingles import mix, text_shingles

#: Similarity at which two documents link: 80 of 100.
LINK = (80, 100)
#: Bits of a signature: four for each shingle, rounded up to a power of two, within these limits.
BITS, MOST_BITS = 2048, 1 << 18
#: Cells of the hashed count of shingles, and the parts in which it is added up.
CELLS, PARTS = 1 << 20, 16
#: Prefix shingles sorted together.
TILE_ROWS = 1_000_000
#: Nearest nodes of a tile that a node is held against first, and the tiles of a node where that is done.
NEAR, NEAR_TILES = 4, 4
#: Shingles of one cell of the exact check; nodes of one block of a large tile.
CELL_SHINGLES, BLOCK = 4_000_000, 1024
#: Bits a node of the filter that keeps texts of no use from the exact check, and the most bits of that filter.
NODE_BITS, MOST_FILTER_BITS = 8, 1 << 27


def _node(found: np.ndarray) -> int:
    """Name of a set: a hash that its order cannot change."""
    return int(mix(np.append(mix(found), np.uint64(len(found))).sum(keepdims=True)).view(np.int64)[0]) if len(found) else 0


def _signature(found: np.ndarray) -> bytes:
    wide = min(MOST_BITS, max(BITS, 1 << (4 * len(found) - 1).bit_length()))
    bits = np.zeros(wide, np.uint8)
    bits[(found & np.uint64(wide - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _stacked(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit words, the longer ones folded to the length of the shortest."""
    size = min(map(len, signatures))
    out = np.zeros((len(signatures), size // 8), np.uint64)
    by_size: dict[int, list[int]] = {}
    for k, x in enumerate(signatures):
        by_size.setdefault(len(x), []).append(k)
    for wide, where in by_size.items():
        words = np.frombuffer(b"".join([signatures[k] for k in where]), np.uint64)
        out[where] = np.bitwise_or.reduce(words.reshape(len(where), wide // size, size // 8), axis=1)
    return out


def _cell(found: np.ndarray) -> np.ndarray:
    return ((found >> np.uint64(24)) & np.uint64(CELLS - 1)).astype(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, n, node, signature), and rows with part and counts that hold the counts of hashed shingles."""
    kind = dict(doc_id=pa.int64(), n=pa.int64(), node=pa.int64(), signature=pa.binary(), part=pa.int32(), counts=pa.binary())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for batch in common.batches(rows):
            sets = text_shingles(batch.column("text").to_pylist())
            counts += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS).astype(np.uint32)
            size = len(sets)
            nodes = pa.array([_node(s) if len(s) else None for s in sets], pa.int64())
            bits = pa.array([_signature(s) if len(s) else None for s in sets], pa.binary())
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), n, nodes, bits, pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], list(kind))
        if counts.any():
            blobs = [common.pack(c) for c in np.split(counts, PARTS)]
            none = [pa.nulls(PARTS, kind[k]) for k in ("doc_id", "n", "node", "signature")]
            yield pa.record_batch([*none, pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], list(kind))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n bigint, node bigint, signature binary, part int, counts binary")


def levels(described: DataFrame) -> np.ndarray:
    """How frequent the shingles of each cell are: 0 for most, then the doublings above twice the usual load.

    The driver gets one number for each of ``CELLS`` cells, whatever the input.
    """

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in rows:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + common.unpack(blob, "u4")[0].astype(np.uint64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([common.pack(s) for s in sums.values()], pa.binary())], ["part", "counts"])

    parts = described.filter("part is not null").select("part", "counts").repartition(PARTS, "part")
    total = np.zeros((PARTS, CELLS // PARTS), np.uint64)
    for row in parts.mapInArrow(add, "part int, counts binary").collect():
        total[row.part] = common.unpack(bytes(row.counts), "u8")[0]
    load = total.ravel() / (2.0 * (total.mean() + 32))
    return np.floor(np.log2(np.maximum(load, 1))).astype(np.int8)


def prefix_size(n: int) -> int:
    return n - -(-n * LINK[0] // LINK[1]) + 1


def tile_rows(docs: DataFrame, level: np.ndarray, shuffles: int) -> DataFrame:
    """Rows (key, node, n) of tiles, the sets of nodes that share a shingle of their prefixes and are close in size."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def emit(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.batches(rows, 16 << 20):
            keys, nodes, sizes = [], [], []
            for found in text_shingles(batch.column("text").to_pylist()):
                if not len(found) or (node := _node(found)) in seen:
                    continue
                seen.add(node)
                rank = shared.value[_cell(found)]
                order = np.argsort(rank, kind="stable") if rank.any() else slice(None)
                own = found[order][: prefix_size(len(found))]
                keys.append(own)
                nodes.append(np.full(len(own), node, np.int64))
                sizes.append(np.full(len(own), len(found), np.uint32))
            if not keys:
                continue
            key, node, n = np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes)
            to = (key % np.uint64(shuffles)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(shuffles + 1))
            used = [p for p in range(shuffles) if cuts[p] < cuts[p + 1]]
            blobs = [common.pack(key[o], node[o], n[o]) for p in used if len(o := order[cuts[p] : cuts[p + 1]])]
            yield pa.record_batch([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["to", "rows"])

    def group(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in rows:
            for to, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(to, []).append(common.unpack(blob, "u8", "i8", "u4"))
        for parts in held.values():
            key, node, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((node, n, key))
            key, node, n = key[order], node[order], n[order]
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1])
            key, node, n = key[once], node[once], n[once]
            first = np.append(True, key[1:] != key[:-1])
            run = np.cumsum(first) - 1
            several = np.bincount(run)[run] > 1
            key, node, n, run = key[several], node[several], n[several], run[several]
            # Sets link only if their sizes are close: where the next size of a run is too large, a new band begins.
            apart = np.append(True, (run[1:] != run[:-1]) | (n[:-1].astype(np.int64) * LINK[1] < n[1:].astype(np.int64) * LINK[0]))
            band = np.cumsum(apart[: len(run)]) - 1
            several = np.bincount(band)[band] > 1 if len(band) else np.zeros(0, bool)
            node, n, band = node[several], n[several], band[several]
            if len(node):
                # A tile is a band's members; bands of equal members are one tile.
                first = np.append(True, band[1:] != band[:-1])
                names = mix(np.add.reduceat(mix(node.view(np.uint64) ^ n), np.flatnonzero(first)))
                once = np.zeros(len(names), bool)
                once[np.unique(names, return_index=True)[1]] = True
                number = np.cumsum(first) - 1
                keep = once[number]
                key, node, n, first = names[number][keep], node[keep], n[keep], first[keep]
            else:
                key = np.zeros(0, np.uint64)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(node), pa.array(n.astype(np.int64))], ["key", "node", "n"])

    dealt = docs.select("text").mapInArrow(emit, "to int, rows binary").repartition(shuffles, "to")
    return dealt.mapInArrow(group, "key bigint, node bigint, n bigint").dropDuplicates(["key", "node"])


def _popcount(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int64)


def _most_shared(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the overlap; a and b: signatures as rows of 64-bit words."""
    return np.minimum(n_a - _popcount(a & ~b), n_b - _popcount(b & ~a))


def _may_link(n_a: np.ndarray, n_b: np.ndarray, most: np.ndarray) -> np.ndarray:
    return LINK[1] * most >= LINK[0] * (n_a + n_b - most)


def _wanted(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and sorted shingle array of the given nodes, and of a few others."""

    wanted = nodes.count() * NODE_BITS
    size = min(MOST_FILTER_BITS, max(1 << 20, 1 << wanted.bit_length()))

    def mark(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in rows:
            at = mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(size - 1)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.record_batch([pa.array([common.pack(bits)], pa.binary())], ["bits"])

    bits = np.zeros(size // 8, np.uint8)
    for row in nodes.select("node").repartition(8).mapInArrow(mark, "bits binary").toLocalIterator():  # eight maps of bounded size
        bits |= common.unpack(bytes(row.bits), "u1")[0]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def arrays(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.batches(rows):
            nodes, sets = [], []
            for found in text_shingles(batch.column("text").to_pylist()):
                if not len(found) or (node := _node(found)) in seen:
                    continue
                at = int(mix(np.array([node], np.int64).view(np.uint64))[0] & np.uint64(size - 1))
                if shared.value[at >> 3] >> (at & 7) & 1:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(found.tobytes())
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "found"])

    return docs.select("text").mapInArrow(arrays, "node bigint, found binary").dropDuplicates(["node"])


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())


def exact(docs: DataFrame, pairs: DataFrame, homes: DataFrame, shuffles: int) -> DataFrame:
    """Links among pairs (a, b) of nodes, by intersecting sorted shingle arrays; those that its other links imply are left out.

    Pairs meet in cells, by the home of their nodes and the band of the smaller size. So a node's array goes to few cells, its
    own band and the one below, and to each once. The nodes of a cell of many shingles are dealt to blocks, and every two blocks
    make a cell.
    """
    side = lambda x: homes.select(F.col("node").alias(x), F.col("home").alias(f"home_{x}"), F.col("n").alias(f"n_{x}"))
    band = F.floor(F.log(F.least("n_a", "n_b")) / float(np.log(LINK[1] / LINK[0])))
    celled = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cell", F.xxhash64(F.least("home_a", "home_b"), band))
    sides = F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("n_a").alias("n")), F.struct(F.col("b").alias("node"), F.col("n_b").alias("n"))))
    sizes = celled.select("cell", sides).distinct().groupBy("cell").agg(F.sum("n").alias("held"))
    blocks = F.ceil(F.col("held") / CELL_SHINGLES)
    part = [F.pmod(F.xxhash64(x), blocks) for x in ("a", "b")]
    celled = celled.join(sizes, "cell").select(F.xxhash64("cell", F.least(*part), F.greatest(*part)).alias("cell"), "a", "b")
    celled = common.written(celled, "pairs")
    members = celled.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = members.join(_wanted(docs, members.select("node").distinct()), "node")
    rows = sent.select("cell", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "found")
    rows = rows.unionByName(celled.select("cell", "a", "b", F.lit(None).cast("binary").alias("found")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets, group = None, {}, {}

        def root(x: int) -> int:
            while group.get(x, x) != x:
                group[x] = x = group.get(group[x], group[x])
            return x

        for batch in common.batches(batches):
            out = []
            for c, a, b, found in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if c != cell:
                    cell, sets, group = c, {}, {}
                if b is None:
                    sets[a] = np.frombuffer(found, np.uint64)
                elif (i := root(a)) != (j := root(b)):
                    both, size = _overlap(sets[a], sets[b]), len(sets[a]) + len(sets[b])
                    if LINK[1] * both >= LINK[0] * (size - both):
                        group[i] = j
                        out.append((a, b))
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    # Arrays of a cell come before its pairs.
    dealt = rows.repartition(shuffles, "cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first())
    links = common.written(dealt.mapInArrow(judge, "a bigint, b bigint"), "links")
    common.done_with(celled)
    return links


def _in_tile(node: np.ndarray, n: np.ndarray, comp: np.ndarray, block: np.ndarray, signatures: list[bytes], near: int | None) -> Iterator[np.ndarray]:
    """Pairs of a tile's nodes, ordered by size, of different groups whose sizes and signatures allow a link; with ``near`` only
    so many of each node, those with the highest bounds. Nodes of one numbered block do not meet.

    Nodes are worked on by the width of their signatures: only larger nodes' signatures are folded, once at most.
    """
    until = np.searchsorted(n, n * LINK[1] // LINK[0], side="right")
    wide = np.array([len(x) for x in signatures])
    for low in np.flatnonzero(np.append(True, wide[1:] != wide[:-1])).tolist():
        same = low + int(np.argmax(np.append(wide[low:] != wide[low], True)))
        bits = _stacked(signatures[low : until[same - 1]])
        step = max(1, (1 << 21) // bits.shape[1])
        for i in range(low, same):
            others = np.arange(i + 1, until[i])
            others = others[(comp[others] != comp[i]) & ((block[others] != block[i]) | (block[i] < 0))]
            best, bounds = [], []
            for cut in range(0, len(others), step):
                part = others[cut : cut + step]
                most = _most_shared(n[part], n[i], bits[part - low], bits[i - low][None, :])
                fits = _may_link(n[part], n[i], most)
                best.append(part[fits])
                bounds.append((most / (n[part] + n[i] - most))[fits])
            part = np.concatenate(best) if best else others[:0]
            if near is not None and len(part) > near:
                part = part[np.argpartition(-np.concatenate(bounds), near)[:near]]
            if len(part):
                yield np.stack([np.minimum(node[part], node[i]), np.maximum(node[part], node[i])])


def _near_tiles(tiles: DataFrame) -> DataFrame:
    """A few tiles of each node, the same ones for nodes that share all, and of large tiles a block: for a first look only."""
    first = Window.partitionBy("node").orderBy("key")
    few = tiles.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= NEAR_TILES).drop("_rank")
    sizes = few.groupBy("key").agg(F.count("*").alias("_size")).filter(F.col("_size") > BLOCK)
    block = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("_size") / BLOCK))
    key = F.when(F.col("_size").isNull(), F.col("key")).otherwise(F.xxhash64("key", block))
    return few.join(sizes, "key", "left").select(key.alias("key"), "node", "n", F.col("node").alias("component"), F.lit(None).cast("int").alias("block"))


def _mixed_tiles(tiles: DataFrame, groups: DataFrame) -> DataFrame:
    """Tiles that hold nodes of different groups. The nodes of a large one are dealt to blocks; every two blocks make a tile, in
    which nodes of one block meet only those of the other, and each block is a tile by itself."""
    grouped = tiles.join(groups, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    found = grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("_size")).filter("low <> high")
    open_ = grouped.join(found.select("key", "_size"), "key")
    blocks = F.ceil(F.col("_size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    to = F.explode(F.when(blocks > 1, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.lit(-1))))
    dealt = open_.withColumn("_own", own).withColumn("_to", to)
    low, high = F.least("_own", "_to"), F.greatest("_own", "_to")
    key = F.when(F.col("_to") < 0, F.col("key")).otherwise(F.xxhash64("key", low, high))
    block = F.when((F.col("_to") >= 0) & (low != high), F.col("_own"))
    return dealt.select(key.alias("key"), "node", "n", "component", block.alias("block"))


def tile_pairs(tiles: DataFrame, nodes: DataFrame, groups: DataFrame | None, shuffles: int, near: int | None = None) -> DataFrame:
    """Pairs of nodes that share a tile and no group, and whose sizes and signatures allow a link. Without groups only some."""
    open_ = _near_tiles(tiles) if groups is None else _mixed_tiles(tiles, groups)
    tiled = open_.join(nodes.select("node", "signature"), "node").select("key", "node", "n", "component", F.coalesce("block", F.lit(-1)).alias("block"), "signature")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(parts: list[tuple[np.ndarray, ...]], last: bool):
            key, node, n, comp, block = (np.concatenate([p[k] for p in parts]) for k in range(5))
            bits = [x for p in parts for x in p[5]]
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            until = len(cuts) - 1 if last else len(cuts) - 2
            size = np.diff(cuts)[:until]
            two = cuts[:until][size == 2]
            two = two[(comp[two] != comp[two + 1]) & ((block[two] != block[two + 1]) | (block[two] < 0))]
            wide = np.array([min(len(bits[k]), len(bits[k + 1])) for k in two.tolist()])
            found = [np.zeros((2, 0), np.int64)]
            for w in np.unique(wide):
                a = two[wide == w]
                rows_ = _stacked([bits[k + j] for j in (0, 1) for k in a.tolist()])
                a = a[_may_link(n[a], n[a + 1], _most_shared(n[a], n[a + 1], rows_[: len(a)], rows_[len(a) :]))]
                found.append(np.stack([np.minimum(node[a], node[a + 1]), np.maximum(node[a], node[a + 1])]))
            for k in np.flatnonzero(size > 2).tolist():
                tile = slice(cuts[k], cuts[k + 1])
                found.extend(_in_tile(node[tile], n[tile], comp[tile], block[tile], bits[tile], near))
            rest = [] if last else [tuple(x[cuts[-2] :] for x in (key, node, n, comp, block, bits))]
            out = np.unique(np.concatenate(found, axis=1), axis=1)
            return pa.record_batch([pa.array(out[0]), pa.array(out[1])], ["a", "b"]), rest

        for batch in rows:
            if batch.num_rows:
                cols = [batch.column(c).to_numpy() for c in ("key", "node", "n", "component", "block")]
                out, held = flush([*held, (*cols, batch.column("signature").to_pylist())], False)
                yield out
        if held:
            yield flush(held, True)[0]

    dealt = tiled.repartition(shuffles, "key").sortWithinPartitions("key", "n", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, node) of all documents, and for each node its own least id, and its group's."""
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select("doc_id", "text")
    described = common.written(describe(docs), "described")
    level = levels(described)
    rows = described.filter("part is null").select("doc_id", "n", "node", "signature")
    total = rows.agg(F.sum("n")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shuffles = max(least, -(-total // 5 // TILE_ROWS))
    tiles = common.written(tile_rows(docs, level, shuffles), "tiles")
    nodes = common.written(rows.filter("node is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("signature").alias("signature"), F.min("doc_id").alias("low")), "nodes")
    sizes = common.written(tiles.groupBy("node").agg(F.first("n").alias("n")), "sizes")

    def homes(joined: DataFrame) -> DataFrame:
        """A cell is all that its pairs connect."""
        return sizes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("home"), "n")

    def checked(pairs: DataFrame) -> DataFrame:
        joined = components(pairs)
        found = exact(docs, pairs, homes(joined), shuffles)
        common.done_with(joined, pairs)
        return found

    links = checked(common.written(tile_pairs(tiles, nodes, None, shuffles, NEAR), "close"))
    groups = components(links)
    crossed = common.written(tile_pairs(tiles, nodes, groups, shuffles), "crossed")
    if crossed.isEmpty():
        common.done_with(crossed)
    else:
        more = checked(crossed)
        common.done_with(groups)
        groups = components(links.union(more))
        common.done_with(more)
    named = nodes.join(groups, "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    least_id = named.groupBy(F.col("component").alias("c")).agg(F.min("low").alias("component_id"), F.min(F.struct("low", "node")).alias("head"))
    named = named.join(least_id, F.col("component") == F.col("c"))
    named = named.select(F.col("node").alias("own"), "low", "component_id", (F.col("head.node") == F.col("node")).alias("heads"))
    named = common.written(named, "named")
    common.done_with(tiles, nodes, sizes, links, groups)
    return rows, named


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    rows, named = _grouped(docs)
    out = rows.join(named, F.col("node") == F.col("own"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the least id; documents without shingles stay. All columns are kept.

    Only ids and sets are shuffled to find the groups; the documents themselves then meet their verdict by a key of id and
    text, and of rows that agree in both, one stays.
    """
    _, named = _grouped(docs)
    chosen = named.filter("heads").select(F.col("own").alias("jac_own"), F.col("low").alias("jac_low"))
    found = node_keys(docs).join(chosen, F.col("jac_node") == F.col("jac_own"), "left")
    # Texts that differ in white space or case share a set and may share an id too.
    first = found.filter(F.col("jac_own").isNotNull() & F.col("doc_id").eqNullSafe(F.col("jac_low"))).dropDuplicates(["jac_node"])
    return found.filter("jac_node is null").unionByName(first).select(docs.columns)


def node_keys(docs: DataFrame) -> DataFrame:
    """Add ``jac_node``, the name of each document's shingle set; null for none."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            sets = text_shingles(batch.column("text").to_pylist())
            yield batch.append_column("jac_node", pa.array([_node(s) if len(s) else None for s in sets], pa.int64()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, jac_node bigint")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{common.WORD}') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(list_transform(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 4, 1) + 1) END,
         lambda i: md5(array_to_string(w[i : i + 4], ' ')))) AS s FROM worded),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
rows_ AS (SELECT doc_id, unnest(s) AS g FROM sets),
shared_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM rows_ a JOIN rows_ b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared_ o JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, l.b FROM reached r JOIN edges l ON r.other = l.a),
lowest AS (SELECT doc_id, min(other) AS low FROM reached GROUP BY doc_id)
SELECT s.doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(low, s.doc_id) AS component_id FROM sizes s LEFT JOIN lowest l ON l.doc_id = s.doc_id
"""

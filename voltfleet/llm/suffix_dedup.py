"""Remove every byte covered by a 100-byte string that also starts earlier in the corpus, by suffix arrays of shards.

Equal 100-byte strings meet in one shard. The string's anchor is the 32-byte piece in it whose hash is least, the first of
equals; about one piece in 35 is an anchor. An anchor that stands once in the corpus repeats nothing. For the others the
text around the anchor, which holds all strings with this anchor, goes to the anchor's shard. There equal surroundings
are one; for the rest a suffix array is built by Larsson and Sadakane's refinement of ranks, neighbours' common prefixes by
Kasai's recurrence, and of strings with 100 common bytes all but the earliest are removed. An anchor whose surroundings
exceed a shard has several, each sorted by itself and merged with those before it by binary search.

Anchors that are frequent within a task are known to repeat, so all but one of them are spread over the tasks; equal
surroundings within a task go on as one.

Order is that of doc_id, null first, then of the text's hash, so rows that share an id and a text are one document and get
the same result. Null texts are empty. Texts under 100 bytes lose nothing. Positions count bytes of UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.llm import bpe, common
from voltfleet.llm.shingles import mix

LENGTH = 100
#: Bytes of an anchor, a power of two.
PIECE = 32
PIECES = LENGTH - PIECE + 1
#: Text looked at together when anchors and surroundings are gathered.
CHUNK = 4 << 20
#: Times an anchor may stand in a chunk before its places are spread.
FREQUENT = 32
#: Anchors to a task, on average; bytes of one suffix array.
ANCHORS, SHARD = 1_000_000, 1 << 18
#: Bytes of surroundings and their entries that a task unpacks at a time; those of one anchor come together.
PASS = 8 << 20
#: Stands for a null id, before all others.
LEAST_ID = -(2**63)
#: Bits of a place in the values whose minimum is sought; so many bytes are looked through at a time.
PLACE = 18


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in a row, ending at ``ends``: each anchor's hash, the first string that has it, and how many in a row do."""
    size = len(data)
    if size < LENGTH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    h = mix(data.astype(np.uint64) + np.uint64(1))
    wide = 1
    while wide < PIECE:
        factor = np.uint64(pow(bpe.BASE, wide, 2**64))
        h = h[:-wide] * factor + h[wide:]
        wide *= 2
    h = mix(h)
    starts = np.zeros(size - LENGTH + 1, bool)
    begin = np.append(0, ends[:-1])
    long_ = ends - begin >= LENGTH
    np.add.at(edge := np.zeros(size + 2, np.int32), begin[long_], 1)
    np.add.at(edge, ends[long_] - LENGTH + 1, -1)
    starts = np.cumsum(edge)[: size - LENGTH + 1] > 0
    low = (h >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(h), dtype=np.uint64)
    wide = 1
    while wide * 2 <= PIECES:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    low = np.minimum(low[: len(low) - (PIECES - wide)], low[PIECES - wide :])
    place = (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    where = np.flatnonzero(starts)
    place = place[where]
    new = np.ones(len(where), bool)
    new[1:] = (place[1:] != place[:-1]) | (where[1:] != where[:-1] + 1)
    first = np.flatnonzero(new)
    return h[place[first]], where[first], np.diff(np.append(first, len(where)))


class Block:
    """Texts of a part of a batch in a row, at most ``1 << PLACE`` bytes unless one text is longer; that one is cut with overlap."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Hash, number of the text, first string, number of strings."""
        out: list[tuple[np.ndarray, ...]] = []
        most = (1 << PLACE) - 1
        at = 0
        while at < len(self.texts):
            end, size = at, 0
            while end < len(self.texts) and (end == at or size + len(self.texts[end]) <= most):
                size += len(self.texts[end])
                end += 1
            if size > most:
                text = self.texts[at]
                for cut in range(0, len(text), most - LENGTH + 1):
                    part = np.frombuffer(text[cut : cut + most], np.uint8)
                    h, s, m = anchors(part, np.array([len(part)]))
                    out.append((h, np.full(len(h), at), s + cut, m))
            else:
                ends = np.cumsum([len(t) for t in self.texts[at:end]])
                h, s, m = anchors(np.frombuffer(b"".join(self.texts[at:end]), np.uint8), ends)
                which = np.searchsorted(ends, s, side="right")
                out.append((h, which + at, s - np.append(0, ends)[which], m))
            at = end
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)


def _routed(to: np.ndarray, shuffles: int, *columns: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(shuffles + 1))
    used = np.flatnonzero(np.diff(cuts))
    blobs = [common.pack(*[c[order[cuts[p] : cuts[p + 1]]] for c in columns]) for p in used.tolist()]
    return pa.record_batch([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], ["to", "rows"])


def _chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``CHUNK`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in common.batches(rows):
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _each(work: Callable[[pa.RecordBatch], pa.RecordBatch], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The work on each chunk; what it took is free when the next rows come."""
    for batch in _chunks(rows):
        out = work(batch)
        del batch
        common.release()
        yield out


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _spread(n: int) -> np.ndarray:
    return np.arange(n, dtype=np.uint64) * np.uint64(bpe.BASE) >> np.uint64(20)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether an entry differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


ROW = ("u8", "i8", "i8", "i4", "u1")
SHARED = np.uint8(128)


def _find_anchors(shuffles: int):
    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, which, start, many = Block(_bytes(batch)).anchors()
        d, row = _column(batch, "d")[which], _column(batch, "row")[which]
        to = key % np.uint64(shuffles)
        mark = many.astype(np.uint8)
        order = np.argsort(key, kind="stable")
        run_ = np.cumsum(np.append(True, key[order][1:] != key[order][:-1])) - 1 if len(key) else order
        frequent = np.zeros(len(key), bool)
        frequent[order] = np.bincount(run_)[run_] > FREQUENT if len(key) else False
        head = np.zeros(len(key), bool)
        if len(key):
            head[order[np.append(True, run_[1:] != run_[:-1])]] = True
        mark[frequent] |= SHARED
        away = frequent & ~head
        to[away] = _spread(int(away.sum())) % np.uint64(shuffles)
        return _routed(to.astype(np.int64), shuffles, key, d, row, start.astype(np.int32), mark)

    return partial(_each, found)


def _gather(rows: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    held: dict[int, list[bytes]] = {}
    for batch in rows:
        for to, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(to, []).append(blob)
    while held:
        yield held.popitem()[1]
    common.release()


def _to_documents(shuffles: int, d: np.ndarray, row: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    to = mix(d.view(np.uint64) ^ mix(row.view(np.uint64))) % np.uint64(shuffles)
    return _routed(to.astype(np.int64), shuffles, d, row, *columns)


def _by_document(*kinds: str):
    """A row for each document, with its distinct entries in one value; a document's entries all come to one task.

    Rows that repeat bring the same entries again.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _gather(rows):
            d, row, *columns = (np.concatenate(x) for x in zip(*(common.unpack(b, "i8", "i8", *kinds) for b in blobs), strict=True))
            order = np.lexsort((*columns, row, d))
            order = order[_new(*(x[order] for x in (d, row, *columns)))]
            d, row = d[order], row[order]
            columns = [np.ascontiguousarray(c[order]) for c in columns]
            cuts = np.append(np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (row[1:] != row[:-1]))), len(d))
            parts = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.record_batch([pa.array(d[cuts[:-1]]), pa.array(row[cuts[:-1]]), pa.array(parts, pa.binary())], ["d", "row", "part"])

    return run


def _repeated(shuffles: int):
    """Of the anchors those that stand more than once, on their way to their documents."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _gather(rows):
            key, d, row, start, mark = (np.concatenate(x) for x in zip(*(common.unpack(b, *ROW) for b in blobs), strict=True))
            order = np.argsort(key, kind="stable")
            number = np.cumsum(np.append(True, key[order][1:] != key[order][:-1])) - 1
            several = (np.bincount(number) > 1) | (np.bincount(number, mark[order] & SHARED) > 0)
            keep = order[several[number]]
            yield _to_documents(shuffles, d[keep], row[keep], key[keep], start[keep], mark[keep] & ~SHARED)

    return run


def _entries(part: bytes, *kinds: str) -> list[np.ndarray]:
    """Columns of one document's entries."""
    n, at, out = len(part) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for kind in kinds:
        out.append(np.frombuffer(part, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


PLACED = ("u8", "u8", "i8", "i8", "i4", "u1")


def _surroundings(shuffles: int):
    """Of each repeated anchor the text that holds its strings, once for equal ones of a chunk."""

    def around(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = _bytes(batch)
        found = [_entries(p, "u8", "i4", "u1") for p in batch.column("part").to_pylist()]
        which = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        key, start, many = (np.concatenate(x) for x in zip(*found, strict=True))
        base = np.cumsum([0] + [len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        begin = base[which] + start
        size = many.astype(np.int64) + LENGTH - 1
        seen = _hash(data, begin, size)
        d, row = _column(batch, "d")[which], _column(batch, "row")[which]
        order = np.lexsort((start, row, d, seen, key))
        # A place that comes again is that of a repeated row, not a later one.
        order = order[_new(*(x[order] for x in (key, seen, d, row, start)))]
        key, seen, d, row, start, many, begin, size = (x[order] for x in (key, seen, d, row, start, many, begin, size))
        first = np.append(True, (key[1:] != key[:-1]) | (seen[1:] != seen[:-1])) if len(key) else np.zeros(0, bool)
        to = key % np.uint64(shuffles)
        to[~first] = _spread(int((~first).sum())) % np.uint64(shuffles)
        # Entries without text are repeats of one that goes on.
        wide = np.where(first, size, 0)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(shuffles + 1, dtype=np.uint64))
        used, blobs, plain = np.flatnonzero(np.diff(cuts)).tolist(), [], []
        for p in used:
            o = order[cuts[p] : cuts[p + 1]]
            blobs.append(common.pack(key[o], seen[o], d[o], row[o], start[o], np.where(first[o], many[o], many[o] | SHARED)))
            plain.append(common.pack(data[_ranges(begin[o], wide[o])], level=7))
        return pa.record_batch([pa.array(used, pa.int32()), pa.array(blobs, pa.binary()), pa.array(plain, pa.binary())], ["to", "rows", "texts"])

    return partial(_each, around)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _hash(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of byte ranges of at most ``PIECES + LENGTH`` bytes."""
    out = np.zeros(len(begin), np.uint64)
    up, down = bpe.powers(False), bpe.powers(True)
    step = bpe.BLOCK // 2
    order = np.argsort(begin, kind="stable")
    for at in range(0, len(data), step):
        part = data[at : at + step + PIECES + LENGTH].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        a, b = np.searchsorted(begin, [at, at + step], sorter=order)
        o = order[a:b]
        s = begin[o] - at
        out[o] = (sums[s + size[o]] - sums[s]) * down[s]
    return mix(out)


def suffix_ranks(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rank of each place by the ``LENGTH`` bytes from it on, for places with so many bytes ``left``; equal strings rank alike.

    Ranks by 8 bytes are refined to 16, 32, 64 and 100; each step sorts only places that still share their rank.
    """
    size = len(data)
    w = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    for bits, step in ((8, 1), (16, 2), (32, 4)):
        w = (w[:-step] << np.uint64(bits)) | w[step:]
    rank = np.zeros(size, np.int64)
    where = np.flatnonzero(left >= 8)
    order = where[np.argsort(w[where], kind="stable")]
    rank[order] = _group_starts(w[order])
    known = 8
    for goal in (16, 32, 64, LENGTH):
        step = goal - known
        # Places with too few bytes left have no rank at this length; nothing looks for one.
        where = order[left[order] >= goal]
        if not len(where):
            return rank
        shared = np.zeros(len(where), bool)
        same = rank[where][1:] == rank[where][:-1]
        shared[1:] |= same
        shared[:-1] |= same
        some = np.flatnonzero(shared)
        p = where[some]
        keys = (rank[p].astype(np.uint64) << np.uint64(32)) | rank[p + step].astype(np.uint64)
        by = np.argsort(keys, kind="stable")
        where[some] = p[by]
        fresh = rank[where].astype(np.uint64) << np.uint64(32)
        fresh[some] = keys[by]
        new = _group_starts(fresh)
        rank[where] = new
        order, known = where, goal
    return rank


def _group_starts(keys: np.ndarray) -> np.ndarray:
    first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, begin: np.ndarray, count: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Bytes, up to ``LENGTH``, that each string shares with the one before it in order (``before``: its place, or -1).

    Kasai's recurrence over the strings of each surrounding, all surroundings at once: a string shares at least one byte
    less with its neighbour than the string one byte earlier did, if its neighbour moves on by one byte as well.
    """
    out = np.zeros(len(before), np.int64)
    for j in range(int(count.max()) if len(count) else 0):
        p = begin[count > j] + j
        q = before[p]
        have = np.zeros(len(p), np.int64)
        if j:
            earlier = before[p - 1]
            follows = (q >= 0) & (earlier >= 0) & (earlier + 1 == q)
            have[follows] = np.maximum(out[p[follows] - 1] - 1, 0)
        open_ = np.flatnonzero(q >= 0)
        while len(open_):
            a, b = p[open_] + have[open_], q[open_] + have[open_]
            same = data[a] == data[b]
            have[open_[same]] += 1
            open_ = open_[same]
            open_ = open_[have[open_] < LENGTH]
        out[p] = have
    return out


class Shard:
    """Strings of some surroundings in suffix order, equal ones together."""

    def __init__(self, data: np.ndarray, size: np.ndarray, d: np.ndarray, row: np.ndarray, start: np.ndarray):
        begin = np.cumsum(size) - size
        count = size - LENGTH + 1
        left = np.repeat(begin + size, size) - np.arange(len(data))
        rank = suffix_ranks(data, left)
        place = _ranges(begin, count)
        owner = np.repeat(np.arange(len(size)), count)
        order = np.argsort(rank[place], kind="stable")
        before = np.full(len(data), -1, np.int64)
        before[place[order][1:]] = place[order][:-1]
        shared = common_prefixes(data, begin, count, before)[place[order]]
        group = np.cumsum(shared < LENGTH)
        owner, place = owner[order], place[order]
        s = start[owner] + place - begin[owner]
        by = np.lexsort((s, row[owner], d[owner], group))
        group, owner, self.s, place = group[by], owner[by], s[by], place[by]
        self.d, self.row = d[owner], row[owner]
        first = np.append(True, group[1:] != group[:-1])
        self.heads = np.flatnonzero(first)
        lead = self.heads[np.cumsum(first) - 1]
        again = (self.d != self.d[lead]) | (self.row != self.row[lead]) | (self.s != self.s[lead])
        gone = np.sort(place[again])
        owner = np.searchsorted(begin, gone, side="right") - 1
        #: Places of strings that start earlier, those of a surrounding in a row.
        self.removed = d[owner], row[owner], start[owner] + gone - begin[owner]
        self.data, self.place = data, place

    def strings(self) -> np.ndarray:
        """The earliest of equal strings, in order."""
        at = self.place[self.heads]
        rows = np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)[at]
        return np.ascontiguousarray(rows).view(f"S{LENGTH}").ravel()


def _later(a: tuple, b: tuple) -> np.ndarray:
    """Whether the places of a come after those of b."""
    out = np.zeros(len(a[0]), bool)
    tie = np.ones(len(a[0]), bool)
    for x, y in zip(a, b, strict=True):
        out |= tie & (x > y)
        tie &= x == y
    return out


def _repeats(data: np.ndarray, begin: np.ndarray, size: np.ndarray, key: np.ndarray, d: np.ndarray, row: np.ndarray, start: np.ndarray) -> Iterator[tuple]:
    """Places (d, row, start) of strings that start earlier elsewhere; surroundings in order of their key."""
    ends = np.cumsum(size)
    edges = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)) if len(key) else np.zeros(1, int)
    cuts, at = [], 0
    while at < len(key):
        base = ends[at] - size[at]
        to = int(edges[max(np.searchsorted(edges, at, side="right"), np.searchsorted(edges, np.searchsorted(ends, base + SHARD), side="right") - 1)])
        cuts.append((at, to))
        at = to
    for a, b in cuts:
        base = ends[a] - size[a]
        held: tuple | None = None
        at = a
        while at < b:
            to = min(b, max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + SHARD, side="right"))))
            shard = Shard(data[_ranges(begin[at:to], size[at:to])], size[at:to], d[at:to], row[at:to], start[at:to])
            yield shard.removed
            if (at, to) != (a, b):  # one anchor, several shards
                strings = shard.strings()
                places = [x[shard.heads] for x in (shard.d, shard.row, shard.s)]
                if held is not None:
                    had, before = held
                    near = np.minimum(np.searchsorted(had, strings), len(had) - 1)
                    both = np.flatnonzero(had[near] == strings)
                    old, new = [x[near[both]] for x in before], [x[both] for x in places]
                    late, early = _later(tuple(new), tuple(old)), _later(tuple(old), tuple(new))
                    yield tuple(n[late] for n in new)
                    yield tuple(o[early] for o in old)
                    for x, n in zip(before, new, strict=True):
                        x[near[both[early]]] = n[early]
                    fresh = np.setdiff1d(np.arange(len(strings)), both)
                    spot = np.searchsorted(had, strings[fresh])
                    held = np.insert(had, spot, strings[fresh]), [np.insert(x, spot, y[fresh]) for x, y in zip(before, places, strict=True)]
                else:
                    held = strings, places
            at = to


def _runs(d: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Strings that follow each other as runs (d, row, first string, number), of ``PIECES`` strings at most."""
    at = np.arange(len(d))
    first = _new(d, row, start - at)
    begin = np.flatnonzero(first)
    first |= (at - begin[np.cumsum(first) - 1]) % PIECES == 0
    begin = np.flatnonzero(first)
    return d[begin], row[begin], start[begin].astype(np.int32), np.diff(np.append(begin, len(d))).astype(np.uint8)


def _passes(parts: list[tuple[bytes, bytes]]) -> Iterator[list[np.ndarray]]:
    """Columns of a bucket's entries and the texts of whole ones, about ``PASS`` bytes at a time; an anchor's are all in one."""
    size = sum(zstandard.frame_content_size(x) for part in parts for x in part)
    passes = max(1, -(-size // PASS))
    for k in range(passes):
        yield _unpacked(parts, k, passes)


def _unpacked(parts: list[tuple[bytes, bytes]], k: int, passes: int) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = []
    for blob, plain in parts:
        columns = common.unpack(blob, *PLACED)
        own = mix(columns[0]) % np.uint64(passes) == k
        texts = common.unpack(plain, "u1")[0]
        found.append([c[own] for c in columns] + [texts[np.repeat(own, _sizes(columns[5]))]])
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _sizes(many: np.ndarray) -> np.ndarray:
    """Bytes of text that come with an entry."""
    return np.where(many & SHARED, 0, many.astype(np.int64) + LENGTH - 1)


def _buckets(rows: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, bytes]]]:
    """The values of each bucket; rows come in order of their bucket, so that one is held at a time."""
    last, held = None, []
    for batch in rows:
        for to, blob, plain in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if held and to != last:
                yield held
                held = []
            last = to
            held.append((blob, plain))
    if held:
        yield held


def _removed(shuffles: int, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (first string, number) to remove, from the surroundings of a shard, on their way to their documents."""
    for parts in _buckets(rows):
        gone: list[tuple] = []
        for found in _passes(parts):
            gone.extend(_gone(*found))
            del found
            common.release()
        yield _to_documents(shuffles, *(np.concatenate(x) for x in zip(*gone, strict=True)))
    common.release()


def _gone(key: np.ndarray, seen: np.ndarray, d: np.ndarray, row: np.ndarray, start: np.ndarray, many: np.ndarray, data: np.ndarray) -> Iterator[tuple]:
    """Runs to remove among the entries of some anchors."""
    whole = (many & SHARED) == 0
    size = _sizes(many)
    many = many & ~SHARED
    begin = np.cumsum(size) - size
    yield d[~whole], row[~whole], start[~whole], many[~whole]
    o = np.flatnonzero(whole)
    o = o[np.lexsort((start[o], row[o], d[o], seen[o], key[o]))]
    first = np.append(True, (key[o][1:] != key[o][:-1]) | (seen[o][1:] != seen[o][:-1])) if len(o) else np.zeros(0, bool)
    lead = o[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(o) else o
    again = o[(d[o] != d[lead]) | (row[o] != row[lead]) | (start[o] != start[lead])]
    yield d[again], row[again], start[again], many[again]
    o = o[first]
    run = np.cumsum(np.append(True, key[o][1:] != key[o][:-1])) - 1 if len(o) else o
    o = o[np.bincount(run)[run] > 1] if len(o) else o
    for found in _repeats(data, begin[o], size[o], key[o], d[o], row[o], start[o].astype(np.int64)):
        yield _runs(*found)


def _spans(part: bytes | None, length: int) -> list[tuple[int, int]]:
    """Maximal removed byte ranges."""
    if not part:
        return []
    start, many = _entries(part, "i4", "u1")
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start.astype(np.int64) + many + LENGTH - 1, -1)
    gone = np.append(np.append(False, np.cumsum(edge[:-1]) > 0), False)
    turn = np.flatnonzero(gone[1:] != gone[:-1])
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def _keep(as_text: bool, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.batches(rows):
        n, removed, spans, sums, kept = [], [], [], [], []
        for text, part in zip(_bytes(batch), batch.column("part").to_pylist(), strict=True):
            cut = _spans(part, len(text))
            left, at = [], 0
            for a, b in cut:
                left.append(text[at:a])
                at = b
            rest = b"".join([*left, text[at:]])
            n.append(len(text))
            removed.append(len(text) - len(rest))
            spans.append(len(cut))
            sums.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
        kind = pa.string() if as_text else pa.binary()
        new = [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums), pa.array(kept, kind)]
        yield pa.record_batch([*batch.columns[:3], *new], [*batch.schema.names[:3], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame, carried: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """A row per document: d and row (its id, null as the least number, and the hash of its text), doc_id, n_bytes, n_removed,
    n_spans, kept_sha256, kept (the remaining bytes, or as text their whole characters) and, as fields of ``more``, columns that
    are only carried along."""
    spark = docs.sparkSession
    common.prepare(spark)
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    more = F.struct(*[F.col(c) for c in carried]) if carried else F.lit(None).cast("boolean")
    # Both joins below read the same columns, so texts are shuffled once.
    texts = docs.select(d.alias("d"), F.xxhash64("text").alias("row"), common.text_or_empty().alias("text"), more.alias("more"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffles = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 35 // ANCHORS))
    routed, by_document = "to int, rows binary", "d bigint, row bigint, part binary"
    found = texts.select("d", "row", "text").mapInArrow(_find_anchors(shuffles), routed)
    marks = found.repartition(shuffles, "to").mapInArrow(_repeated(shuffles), routed)
    marks = marks.repartition(shuffles, "to").mapInArrow(_by_document("u8", "i4", "u1"), by_document)
    placed = texts.join(marks, ["d", "row"]).select("d", "row", "more", "text", "part")
    around = placed.mapInArrow(_surroundings(shuffles), f"{routed}, texts binary").repartition(shuffles, "to").sortWithinPartitions("to")
    gone = around.mapInArrow(partial(_removed, shuffles), routed)
    gone = gone.repartition(shuffles, "to").mapInArrow(_by_document("i4", "u1"), by_document)
    both = texts.join(gone, ["d", "row"], "left").select("d", "row", "more", "text", "part")
    kind = both.schema["more"].dataType.simpleString()
    counts = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    kept = both.mapInArrow(partial(_keep, as_text), f"d bigint, row bigint, more {kind}, {counts}, kept {'string' if as_text else 'binary'}")
    return kept.withColumn("doc_id", F.when(F.col("d") != LEAST_ID, F.col("d")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; all columns stay. A character that a cut would split goes whole."""
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Decoded where the bytes are cut: a second Python step would hold a second worker a task.
    texts = deduplicated(docs, carried, as_text=True).withColumnRenamed("kept", "text")
    return texts.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"more.{c}").alias(c) for c in docs.columns])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
starts AS (SELECT doc_id, n, h, unnest(range(0, n, 400)) AS base FROM texts),
blocks AS (SELECT doc_id, n, base, h[2 * base + 1 : 2 * base + 1000] AS h FROM starts),
places AS (SELECT doc_id, n, base, h, unnest(range(least(400, n - base))) AS j FROM blocks),
strings AS (SELECT doc_id, n, base + j AS i, h[2 * j + 1 : 2 * j + 2] AS x,
                   CASE WHEN base + j + 100 <= n THEN md5(h[2 * j + 1 : 2 * j + 200]) END AS k FROM places),
marked AS (SELECT *, CASE WHEN k IS NOT NULL THEN row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 ELSE false END AS again FROM strings),
covered AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM marked),
turns AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM covered),
sums AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
         coalesce(string_agg(x, '' ORDER BY i) FILTER (NOT gone), '') AS rest FROM turns GROUP BY doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(rest, ''))) AS kept_sha256 FROM texts t LEFT JOIN sums s ON s.doc_id = t.doc_id
"""

"""Byte-pair encoding of many short pieces at once, in numpy, for a tokenizer file with word ends.

White space never joins two tokens here, so a text's tokens are those of its white-space words, and each worker encodes a
word once. Words of plain Latin letters are cut by the file's own pattern; any other word goes to the library as it is.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END = "</w>"
NONE = np.int32(2**30)
#: Stands between words in a row of ids; ids are far smaller, so these bytes are found nowhere else.
BREAK = b"\xff\xff\xff\xff"
#: Letters, digits and signs whose case, class and composed form no Unicode version changes; U+0130 grows in lower case.
SAFE = r"\x21-\x7e\xa1-įı-ɏ\n"
#: Words one worker remembers before it forgets the older half: a bound on memory, not on words.
MEMO = 2_000_000
#: Words of more characters are left to the library.
LONGEST = 48


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself, or the next free code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Table:
    """64-bit keys to 32-bit values, read by whole arrays: open addressing with short probes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.size = 0
        self._room(len(keys))
        self.add(keys, values)

    def _room(self, count: int) -> None:
        bits = max(10, int(count * 5).bit_length())
        self.shift, self.limit = np.uint64(64 - bits), (1 << bits) // 2
        self.keys = np.zeros((1 << bits) + 64, np.uint64)
        self.values = np.full((1 << bits) + 64, -1, np.int32)
        self.probes = 1

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Take in keys that are new, none of them 0."""
        self.size += len(keys)
        if self.size > self.limit:
            held = self.keys != 0
            keys, values = np.append(self.keys[held], keys), np.append(self.values[held], values)
            self._room(2 * self.size)
        left, slots = np.arange(len(keys)), self._slot(keys)
        for probe in range(64):
            if not len(left):
                return
            at = slots[left] + probe
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = (self.keys[at] == 0) & first
            self.keys[at[put]], self.values[at[put]] = keys[left[put]], values[left[put]]
            left, self.probes = left[~put], max(self.probes, probe + 1)
        raise ValueError("table too full")

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slot(keys)
        out = np.where(self.keys[slots] == keys, self.values[slots], np.int32(-1))
        for probe in range(1, self.probes):
            open_ = np.flatnonzero((out < 0) & (self.keys[slots + probe - 1] != 0))
            if not len(open_):
                break
            at = slots[open_] + probe
            hit = self.keys[at] == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
        return out


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.uint64) + np.uint64(1)) << np.uint64(32) | right.astype(np.uint64)


class Pieces:
    """Merge rules of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.lines = regex.compile(self.pattern.pattern + r"|\n")
        #: A word that may hold a special string, has an unsafe letter or is long: the library encodes it.
        special = "|".join(regex.escape(t["content"]) for t in model["added_tokens"])
        self.odd = regex.compile(rf"{special}|[^{SAFE}]|[^\n]{{{LONGEST + 1}}}")
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        letters = byte_letters()
        self.first = np.array([vocab.get(letters[b], -1) for b in range(256)], np.int32)
        self.final = np.array([vocab.get(letters[b] + END, -1) for b in range(256)], np.int32)
        back = {c: b for b, c in letters.items()}
        #: id: its bytes, and whether it ends a word
        self.spelled = {
            i: (bytes(back[c] for c in text.removesuffix(END)), text.endswith(END))
            for text, i in vocab.items()
            if all(c in back for c in text.removesuffix(END))
        }
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.rank = Table(pair_key(left, right), np.arange(len(merges), dtype=np.int32))
        #: The merge that makes each token, -1 for none, and the two tokens that it joins.
        size = max(vocab.values()) + 1
        self.born = np.full(size, -1, np.int32)
        self.left_part, self.right_part = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for part, side in ((self.left_part, left), (self.right_part, right)):
            part[self.merged] = side
        self.born[self.merged] = np.arange(len(merges), dtype=np.int32)
        if len(set(self.merged.tolist())) < len(merges) or (np.maximum(self.born[left], self.born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a token with two merges, or one that is used before it is made")
        self.whole = np.ones(size, bool)
        self.whole[self.merged] = self.apart(left, right, np.arange(len(merges), dtype=np.int32))
        for a, b, c in zip(left.tolist(), right.tolist(), self.merged.tolist(), strict=True):
            self.whole[c] &= self.whole[a] and self.whole[b]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.rank.get(pair_key(left.ravel(), right.ravel())).reshape(left.shape)
        return np.where(found < 0, NONE, found)

    def apart(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (before rank ``until``, if given) joins parts of both tokens of a pair while each is put together.

        Merges run in the order of their ranks, so the parts that met at the edge are found by taking the merges of both
        tokens back, the latest first. Parts x and y were joined if the rank of their merge comes before the one that took x
        into its own token, and not after the one that took y: of equal pairs the leftmost is merged first.
        """
        out = np.ones(len(left), bool)
        open_ = np.arange(len(left))
        x, y = left.astype(np.int64), right.astype(np.int64)
        end_x = np.full(len(left), NONE, np.int32) if until is None else until.astype(np.int32)
        end_y = end_x.copy() if until is None else end_x - 1
        while len(open_):
            rank = self._ranks(x, y)
            met = (rank < end_x) & (rank <= end_y) & (rank < NONE)
            out[open_[met]] = False
            born_x, born_y = self.born[x], self.born[y]
            go = ~met & ((born_x >= 0) | (born_y >= 0))
            open_, x, y, end_x, end_y, born_x, born_y = (v[go] for v in (open_, x, y, end_x, end_y, born_x, born_y))
            back = born_x > born_y
            end_x, x = np.where(back, born_x, end_x), np.where(back, self.right_part[x], x)
            end_y, y = np.where(back, end_y, born_y), np.where(back, y, self.left_part[y])
        return out

    def merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of one length, lowest rank first, leftmost first; returns the ids, left-aligned, and their numbers."""
        ids = ids.copy()
        rows, wide = ids.shape
        count = np.full(rows, wide)
        if wide < 2:
            return ids, count
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        open_ = np.flatnonzero(ranks.min(axis=1) < NONE)
        columns = np.arange(wide)
        while len(open_):
            now, near = ids[open_], ranks[open_]
            at = near.argmin(axis=1)
            lines = np.arange(len(open_))
            new = self.merged[near[lines, at]]
            moved = np.minimum(columns + (columns > at[:, None]), wide - 1)
            now = np.take_along_axis(now, moved, axis=1)
            now[lines, at] = new
            near = np.take_along_axis(near, np.minimum(moved[:, :-1], wide - 2), axis=1)
            count[open_] -= 1
            size = count[open_]
            near[columns[:-1] >= size[:, None] - 1] = NONE
            before = np.flatnonzero(at > 0)
            near[before, at[before] - 1] = self._ranks(now[before, at[before] - 1], new[before])
            after = np.flatnonzero(at < size - 1)
            near[after, at[after]] = self._ranks(new[after], now[after, at[after] + 1])
            ids[open_], ranks[open_] = now, near
            open_ = open_[near.min(axis=1) < NONE]
        return ids, count

    def symbols(self, pieces: list[bytes]) -> np.ndarray:
        """Starting ids of pieces of one length."""
        raw = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), -1)
        ids = self.first[raw]
        ids[:, -1] = self.final[raw[:, -1]]
        return ids

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(k)
        for wide, where in by_length.items():
            for at in range(0, len(where), 20_000):
                part = where[at : at + 20_000]
                ids, count = self.merge(self.symbols([pieces[k] for k in part]))
                data, step = ids.astype("<u4").tobytes(), 4 * wide
                for line, (k, n) in enumerate(zip(part, count.tolist(), strict=True)):
                    out[k] = data[line * step : line * step + 4 * n]
        return out

    def cut(self, words: list[str]) -> list[str]:
        """Pieces of plain words in a row; a line feed stands between words."""
        return self.lines.findall("\n".join(words).lower())

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


#: An odd number with well mixed bits.
BASE = 0x9E3779B97F4A7C15


@cache
def powers(inverse: bool) -> np.ndarray:
    """Powers of the base, or of its inverse, for each place in a block; for hashes of short ranges of bytes."""
    base = pow(BASE, -1, 1 << 64) if inverse else BASE
    out = np.full(BLOCK, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes hashed at once; texts beyond it are cut at white space, or encoded by the library if they have none.
BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Found:
    """The white-space words of a block: where they start and end, and their bytes as lanes of eight, the last filled up with 0."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = SPACE[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        size = self.ends - self.starts
        #: Lanes of each word, and its first one.
        self.wide = (size + 7) >> 3
        self.first = np.cumsum(self.wide) - self.wide
        self.place = np.arange(int(self.wide.sum())) - np.repeat(self.first, self.wide)
        at = np.repeat(self.starts, self.wide) + 8 * self.place
        padded = np.frombuffer(data + bytes(8), np.uint8)
        lanes = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))[at]
        spare = 8 * np.minimum(np.repeat(self.ends, self.wide) - at, 8)
        self.lanes = lanes & (np.uint64(2**64 - 1) >> (np.uint64(64) - spare.astype(np.uint64)))
        self.size = size

    def hashes(self) -> np.ndarray:
        """A hash of each word: every lane is mixed with its place, by a factor of its own, before lanes are added."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        key = mix((self.place.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
        sums = np.add.reduceat(mix(self.lanes ^ key) * (key | np.uint64(1)), self.first)
        return mix(sums + self.size.astype(np.uint64) * np.uint64(BASE))


class Words:
    """Values of the white-space words of texts, here their ids, each made once per worker.

    A word is looked up by a 64-bit hash, and its bytes are compared with those of the word found. Where they differ, the
    hash is hashed on until it finds the word or a free key, so two words never share a value.
    """

    def __init__(self, path: str):
        self.engine: Pieces = pieces(path)
        self.forget()

    def forget(self) -> None:
        self.table = Table(np.zeros(0, np.uint64), np.zeros(0, np.int32))
        #: Keys of the known words; their values in a row, and where each word's begin; the same for their lanes.
        self.keys = np.zeros(1 << 14, np.uint64)
        self.pool, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.lanes, self.lane_starts = np.zeros(1 << 15, np.uint64), np.zeros(1 << 14, np.int64)

    def forget_older(self) -> None:
        """Keep the newer half of the known words."""
        have, cut = self.table.size, self.table.size // 2
        self.keys[: have - cut] = self.keys[cut:have]
        for pool, starts in ((self.pool, self.starts), (self.lanes, self.lane_starts)):
            begin, end = int(starts[cut]), int(starts[have])
            pool[: end - begin] = pool[begin:end].copy()
            starts[: have - cut + 1] = starts[cut : have + 1] - begin
        self.table = Table(self.keys[: have - cut], np.arange(have - cut, dtype=np.int32))
        self.table.size = have - cut

    def learn(self, new: list[str]) -> list[bytes]:
        """Values of words: for each, 32-bit numbers as bytes."""
        plain, other, known = new, [], {}
        if self.engine.odd.search("\n".join(new)):
            plain = [w for w in new if not self.engine.odd.search(w)]
            other = list(set(new).difference(plain))
        if plain:
            cut = self.engine.cut(plain)
            found = list(set(cut) - {"\n"})
            ids = dict(zip(found, self.engine.encode([p.encode() for p in found]), strict=True)) | {"\n": BREAK}
            row = b"".join(map(ids.__getitem__, cut)).split(BREAK)
            if not other:
                return row
            known.update(zip(plain, row, strict=True))
        for at in range(0, len(other), 512):
            part = other[at : at + 512]
            known.update(zip(part, self.engine.by_library(part), strict=True))
        return [known[w] for w in new]

    def _append(self, hashes: np.ndarray, made: list[bytes], words: Found, which: np.ndarray) -> None:
        have, to = self.table.size, self.table.size + len(made)
        if to + 1 > len(self.starts):
            more = max(len(self.starts), len(made) + 1)
            self.keys, self.starts, self.lane_starts = (np.append(x, np.zeros(more, x.dtype)) for x in (self.keys, self.starts, self.lane_starts))
        wide = words.wide[which]
        lanes = words.lanes[np.repeat(words.first[which] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))]
        self.pool = _row(self.pool, self.starts, have, np.array([len(m) // 4 for m in made]), np.frombuffer(b"".join(made), "<u4"))
        self.lanes = _row(self.lanes, self.lane_starts, have, wide, lanes)
        self.keys[have:to] = hashes
        self.table.add(hashes, np.arange(have, to, dtype=np.int32))

    def _same(self, words: Found, which: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether words ``which`` of a block have the bytes of the known words ``at``."""
        begin, wide = self.lane_starts[at], words.wide[which]
        same = self.lane_starts[at + 1] - begin == wide
        some = np.flatnonzero(same)
        wide, own = wide[some], words.first[which[some]]
        step = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        equal = words.lanes[np.repeat(own, wide) + step] == self.lanes[np.repeat(begin[some], wide) + step]
        if len(some):
            same[some] = np.logical_and.reduceat(equal, np.cumsum(wide) - wide)
        return same

    def find(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each word of a block its number among the known words, and the byte where it starts."""
        words = Found(data)
        starts, ends = words.starts, words.ends
        hashes = np.maximum(words.hashes(), np.uint64(1))
        if self.table.size + len(starts) > MEMO:
            self.forget_older()
        at = np.zeros(len(starts), np.int64)
        open_ = np.arange(len(starts))
        while len(open_):
            at[open_] = self.table.get(hashes[open_])
            if len(missing := open_[at[open_] < 0]):
                fresh, first = np.unique(hashes[missing], return_index=True)
                which = missing[first]
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
                self._append(fresh, self.learn(texts), words, which)
                at[missing] = self.table.get(hashes[missing])
            open_ = open_[~self._same(words, open_, at[open_])]
            hashes[open_] = np.maximum(mix(hashes[open_] + np.uint64(BASE)), np.uint64(1))
        return at, starts

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of the words of a block in a row, the byte where each word starts, and its number of values."""
        at, starts = self.find(data)
        begin, count = self.starts[at], self.starts[at + 1] - self.starts[at]
        shift = np.repeat(begin - (np.cumsum(count) - count), count)
        return self.pool[shift + np.arange(len(shift))], starts, count


def _row(pool: np.ndarray, starts: np.ndarray, have: int, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Put values behind the first ``have`` runs of a pool; a pool that is too short is copied to a longer one."""
    ends = np.cumsum(sizes) + starts[have]
    if ends[-1] > len(pool):
        pool = np.append(pool, np.zeros(max(len(pool), int(ends[-1])), pool.dtype))
    pool[starts[have] : ends[-1]] = values
    starts[have + 1 : have + 1 + len(sizes)] = ends
    return pool


@cache
def words(path: str) -> Words:
    return Words(path)


def in_blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts in UTF-8, several together up to a block; a text of a block or more stands alone."""
    held: list[bytes] = []
    where: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        data = text.encode("utf-8", "replace") if text else b""
        if held and size + len(data) + 1 > BLOCK:
            yield where, held
            held, where, size = [], [], 0
        held.append(data)
        where.append(k)
        size += len(data) + 1
    if held:
        yield where, held


def parts(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """A long text in parts cut at white space; true: a single word of more than a block."""
    spaces = [bytes([c]) for c in np.flatnonzero(SPACE)]
    at = 0
    while at < len(data):
        end, whole = min(at + BLOCK - 1, len(data)), False
        if end < len(data):
            cut = max(data.rfind(c, at + 1, end) for c in spaces)
            if cut < 0:
                cut, whole = min((f for c in spaces if (f := data.find(c, end)) >= 0), default=len(data)), True
            end = cut
        yield data[at:end], whole
        at = end


def encode_texts(path: str, texts: list[str | None]) -> list[np.ndarray]:
    """Ids of whole texts, as the library gives them without added special tokens."""
    known, out = words(path), []
    for _, held in in_blocks(texts):
        if len(held) == 1 and len(held[0]) >= BLOCK:
            ids = [
                np.frombuffer(known.engine.by_library([part.decode("utf-8", "replace")])[0], "<u4") if whole else known.block(part)[0]
                for part, whole in parts(held[0])
            ]
            out.append(np.concatenate(ids))
            continue
        ids, starts, count = known.block(b"\n".join(held))
        before = np.append(0, np.cumsum(count))
        ends = np.cumsum([len(t) + 1 for t in held])
        out.extend(np.split(ids, before[np.searchsorted(starts, ends)][:-1]))
    return out

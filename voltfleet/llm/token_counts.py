"""Token counts of whole texts and of each of their prefixes, by dynamic programming over prefixes.

The encoding of a prefix ends with one token: the only one that ends there and stays apart from the last token of the prefix
before it. So one pass over a word gives, for every prefix, the last token and the number of tokens, and a budget or
truncation question is answered from these numbers without encoding again. White space never joins tokens, so a text's
numbers are running sums over its words.

Null texts count as empty. An empty text has 0 tokens and one prefix, the empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.llm import bpe, common

#: Slots of the memory of token pairs; a pair that loses its slot is judged anew.
PAIRS = 1 << 21
BASE = np.uint64(bpe.BASE)


class Prefixes:
    """Counts of tokens at each prefix of pieces, a whole table of pieces of one length at a time."""

    def __init__(self, engine: bpe.Pieces):
        self.engine = engine
        nodes: dict[bytes, list[int]] = {}
        for i, (spelled, ends) in engine.spelled.items():
            for k in range(len(spelled)):
                nodes.setdefault(spelled[k:], [-1, -1])
            nodes[spelled][ends] = i
        keys = np.array([self._hash(s) for s in nodes], np.uint64)
        self.nodes = bpe.Table(keys, np.arange(len(keys), dtype=np.int32))
        #: Token that a byte string is, inside a word and at its end; -1: none, but longer tokens end with it.
        self.tokens = np.array(list(nodes.values()), np.int32).T.copy()
        self.pair_keys, self.pair_apart = np.zeros(PAIRS, np.uint64), np.zeros(PAIRS, bool)

    @staticmethod
    def _hash(text: bytes) -> int:
        out, power = 0, 1
        for b in reversed(text):
            out, power = (out + (b + 1) * power) % 2**64, power * bpe.BASE % 2**64
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two tokens in a row stay as they are when their text is encoded."""
        keys = bpe.pair_key(left, right)
        slots = ((keys * BASE) >> np.uint64(64 - 21)).astype(np.int64)
        known = self.pair_keys[slots] == keys
        out = self.pair_apart[slots]
        if not known.all():
            missing = np.flatnonzero(~known)
            new, where = np.unique(keys[missing], return_inverse=True)
            judged = self._judge((new >> np.uint64(32)).astype(np.int64) - 1, (new & np.uint64(0xFFFFFFFF)).astype(np.int64))
            out[missing] = judged[where]
            self.pair_keys[slots[missing]], self.pair_apart[slots[missing]] = keys[missing], out[missing]
        return out

    def _judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        whole = self.engine.whole
        return whole[left] & whole[right] & self.engine.apart(left, right)

    def table(self, raw: np.ndarray) -> np.ndarray:
        """``raw``: a row of bytes per piece. Tokens of the first 1, 2, ... bytes of each piece, taken as whole pieces."""
        rows, wide = raw.shape
        last = np.full((2, rows, wide + 1), -1, np.int32)
        count = np.zeros((2, rows, wide + 1), np.int32)
        values = raw.astype(np.uint64) + np.uint64(1)
        for end in range(1, wide + 1):
            open_ = np.arange(rows)
            hashes = np.zeros(rows, np.uint64)
            power = 1
            for size in range(1, end + 1):
                hashes = hashes + values[open_, end - size] * np.uint64(power)
                power = power * bpe.BASE % 2**64
                node = self.nodes.get(hashes)
                keep = node >= 0
                open_, hashes, node = open_[keep], hashes[keep], node[keep]
                if not len(open_):
                    break
                for kind in (0, 1):
                    token = self.tokens[kind][node]
                    maybe = np.flatnonzero((token >= 0) & (last[kind, open_, end] < 0))
                    if size < end and len(maybe):
                        maybe = maybe[self.apart(last[0, open_[maybe], end - size], token[maybe])]
                    line = open_[maybe]
                    last[kind, line, end] = token[maybe]
                    count[kind, line, end] = count[0, line, end - size] + 1
                keep = (last[0, open_, end] < 0) | (last[1, open_, end] < 0)
                open_, hashes = open_[keep], hashes[keep]
                if not len(open_):
                    break
        return count[1, :, 1:]


class PrefixWords(bpe.Words):
    """Numbers of tokens at the prefixes of words. A plain word has one for each of its characters, another word the last only."""

    def __init__(self, path: str):
        super().__init__(path)
        self.prefixes = Prefixes(self.engine)

    def _pieces(self, found: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(found)
        by_length: dict[int, list[int]] = {}
        data = [p.encode() for p in found]
        for k, piece in enumerate(data):
            by_length.setdefault(len(piece), []).append(k)
        for wide, where in by_length.items():
            for at in range(0, len(where), 20_000):
                part = where[at : at + 20_000]
                raw = np.frombuffer(b"".join([data[k] for k in part]), np.uint8).reshape(len(part), wide)
                counts = self.prefixes.table(raw)
                ends = np.ones(raw.shape, bool)
                ends[:, :-1] = (raw[:, 1:] & 0xC0) != 0x80
                for k, row, end in zip(part, counts, ends, strict=True):
                    out[k] = row if len(found[k]) == wide else row[end]
        # The pattern takes "'re" as one piece, but its prefix "'r" as two.
        for k, piece in enumerate(found):
            if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
                out[k] = np.array([out[k][0], sum(p[-1] for p in self._pieces(["'", piece[1]])), out[k][2]], np.int32)
        return out

    def learn(self, new: list[str]) -> list[bytes]:
        odd = self.engine.odd.search("\n".join(new)) is not None
        plain = [w for w in new if not self.engine.odd.search(w)] if odd else new
        other = list(set(new).difference(plain)) if odd else []
        known: dict[str, bytes] = {}
        if plain:
            cut = self.engine.cut(plain)
            found = list(set(cut) - {"\n"})
            number = {p: k for k, p in enumerate(found)} | {"\n": len(found)}
            tables = [*self._pieces(found), np.zeros(0, np.int32)]
            sizes = np.array([len(t) for t in tables])
            totals = np.array([t[-1] if len(t) else 0 for t in tables])
            pool, begin = np.concatenate(tables), np.cumsum(sizes) - sizes
            which = np.fromiter(map(number.__getitem__, cut), np.int64, len(cut))
            word = np.cumsum(which == len(found))
            before = np.cumsum(totals[which]) - totals[which]
            first = np.searchsorted(word, np.arange(len(plain)))
            before = before - before[first][word]
            size = sizes[which]
            ends = np.cumsum(size)
            values = pool[np.repeat(begin[which] - (ends - size), size) + np.arange(ends[-1])] + np.repeat(before, size)
            cuts = np.append(0, ends)[np.append(first, len(which))]
            data, cuts = values.astype("<u4").tobytes(), (4 * cuts).tolist()
            known.update(zip(plain, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        for at in range(0, len(other), 512):
            part = other[at : at + 512]
            ids = self.engine.by_library(part)
            known.update((w, np.array([len(i) // 4], "<u4").tobytes()) for w, i in zip(part, ids, strict=True))
        return [known[w] for w in new]


@cache
def prefix_words(path: str) -> PrefixWords:
    return PrefixWords(path)


def totals(path: str, texts: list[str | None]) -> np.ndarray:
    """Tokens of whole texts."""
    known, out = prefix_words(path), np.zeros(len(texts), np.int64)
    for where, held in bpe.in_blocks(texts):
        if len(held) == 1 and len(held[0]) >= bpe.BLOCK:
            for part, whole in bpe.parts(held[0]):
                if whole:
                    out[where] += len(known.engine.by_library([part.decode("utf-8", "replace")])[0]) // 4
                else:
                    out[where] += known.pool[known.starts[known.find(part)[0] + 1] - 1].sum(dtype=np.int64)
            continue
        at, starts = known.find(b"\n".join(held))
        sums = np.append(0, np.cumsum(known.pool[known.starts[at + 1] - 1], dtype=np.int64)) if len(at) else np.zeros(1, np.int64)
        ends = np.cumsum([len(t) + 1 for t in held])
        out[where] = np.diff(sums[np.searchsorted(starts, ends)], prepend=0)
    return out


def prefix_counts(path: str, text: str | None) -> np.ndarray:
    """Tokens of the first 0, 1, ..., n code points of a text.

    Inside a word that is not plain Latin, each prefix is encoded by the library; that takes the square of the word's length.
    """
    text = text or ""
    known, out, total = prefix_words(path), np.zeros(len(text) + 1, np.int64), 0
    last = 0
    for m in bpe.regex.finditer(r"[^ \t-\r]+", text):
        word = m.group()
        counts = np.frombuffer(known.learn([word])[0], "<u4")
        if len(counts) != len(word):
            counts = np.array([len(i) // 4 for i in known.engine.by_library([word[: k + 1] for k in range(len(word))])])
        out[last : m.start() + 1] = total
        out[m.start() + 1 : m.end() + 1] = total + counts
        total, last = total + int(counts[-1]), m.end() + 1
    out[last:] = total
    return out


def with_token_counts(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each text as column ``out``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            texts = batch.column(text).to_pylist()
            yield batch.append_column(out, pa.array(totals(path, texts), pa.int64()))

    return df.mapInArrow(run, f"{_ddl(df)}, `{out}` bigint")


def with_prefix_counts(df: DataFrame, path: str, budget: int | None = None, text: str = "text") -> DataFrame:
    """Add ``prefix_tokens``, the tokens of the first 0, 1, ..., n code points, or with a ``budget`` only ``kept_chars`` and
    ``kept_tokens``: the longest prefix of at most ``budget`` tokens. A longer prefix can have fewer tokens than a shorter
    one; all prefixes are judged."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            counts = [prefix_counts(path, t) for t in batch.column(text).to_pylist()]
            if budget is None:
                yield batch.append_column("prefix_tokens", pa.array([c.tolist() for c in counts], pa.list_(pa.int32())))
                continue
            kept = [int(np.flatnonzero(c <= budget)[-1]) for c in counts]
            batch = batch.append_column("kept_chars", pa.array(kept, pa.int64()))
            yield batch.append_column("kept_tokens", pa.array([int(c[k]) for c, k in zip(counts, kept, strict=True)], pa.int64()))

    more = "prefix_tokens array<int>" if budget is None else "kept_chars bigint, kept_tokens bigint"
    return df.mapInArrow(run, f"{_ddl(df)}, {more}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


#: Tokens above which a document is over the limit.
LIMIT = 2048


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = with_token_counts(docs, bpe.tokenizer_path("word_bpe_49k.json"))
    return counted.select(
        "doc_id",
        F.octet_length(common.text_or_empty()).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )

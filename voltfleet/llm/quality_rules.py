"""Quality of documents: counted base rules, and a conditional random field that marks each line as content or boilerplate.

The field is a chain over the lines of a document that hold a word. Each line has a few yes-or-no features of its own;
weights tie them to the two labels, and four more weights tie neighbouring labels. They are fitted in numpy by the exact
gradient (forward and backward sums over the chain) on at most ``SAMPLE`` labelled documents, from the first line to the
last: a document is cut into stretches of ``STRETCH`` lines, each a chain of its own, and of all stretches those with the least
hashes are taken, at most ``SAMPLE`` of each label. At first all lines take the label of their document: a good document is
content, a bad one boilerplate. Fitted to that without turns, for all chains would teach it to stay, the field marks each line
anew, with ``PRIOR`` in favour of the document's label; fitted once more, now with turns, it learns them from chains with both labels. Viterbi decoding marks the lines of every
document; if content has less than ``LEAST_SHARE`` of the words, the document goes.

A null or empty text has no words and fails the base rules. Without labels of both kinds all lines are content. A document
with several labels takes the least. Repeated rows are judged as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.llm import bpe, common
from voltfleet.llm.shingles import STEP, mix, texts_words

SAMPLE, STEPS, RATE, DECAY = 3_000, 120, 0.2, 1e-3
#: Lines of a chain in training.
STRETCH = 60
#: How much a line is held to its document's label when lines are marked anew, in logarithms of odds.
PRIOR = 1.0
LEAST_SHARE = 0.5
#: Base rules: fewest words, and most words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
SYMBOL = regex.compile(r"[#*$%&|<>]")
#: Three words to a window.
WIDE = 3
CONTENT, BOILERPLATE = 0, 1
FEATURES = 14


def repeated_words(words: np.ndarray) -> int:
    """Words in three-word windows that are found twice or more."""
    if len(words) <= WIDE:
        return 0
    h = np.zeros(len(words) - WIDE + 1, np.uint64)
    for k in range(WIDE):
        h = h * STEP + words[k : len(words) - WIDE + 1 + k]
    order = np.argsort(h := mix(h), kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words), bool)
    for k in range(WIDE):
        cover[k : k + len(again)] |= again
    return int(cover.sum())


def lines_of(text: str) -> tuple[list[str], list[bool], int]:
    """Lines with a word, whether each equals an earlier one, and how many do."""
    seen: set[str] = set()
    lines, again = [], []
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            lines.append(line)
            again.append(line in seen)
            seen.add(line)
    return lines, again, sum(again)


def features(line: str, again: bool) -> tuple[int, ...]:
    """Numbers of the features that a line has; it has a word."""
    words = line.split() or [line]
    n = len(words)
    symbols = len(SYMBOL.findall(line))
    upper, lower = sum(map(str.isupper, words)), len(line)
    end = line.rstrip()[-1:] or "-"
    out = [0]
    out.append(1 if symbols == 0 else 2 if 5 * symbols < n else 3 if 2 * symbols < n else 4)
    if 2 * upper > n and n > 1:
        out.append(5)
    if again:
        out.append(6)
    out.append(7 if end in ".!?…" else 8)
    if n < 4:
        out.append(9)
    if 2 * len(set(words)) < n:
        out.append(10)
    if line.count("|") * 4 > n:
        out.append(11)
    if line.count("!") * 4 > n:
        out.append(12)
    if lower > 12 * n:
        out.append(13)
    return tuple(out)


class Field:
    """Weights of the chain: label by feature, and label by next label."""

    def __init__(self, emit: np.ndarray, turn: np.ndarray):
        self.emit, self.turn = emit, turn

    def decode(self, lines: list[tuple[int, ...]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        emit, turn = self._lists
        back, a, b = [], 0.0, 0.0
        stay_a, go_b, go_a, stay_b = turn
        for k, own in enumerate(lines):
            x = y = 0.0
            for f in own:
                x += emit[0][f]
                y += emit[1][f]
            if not k:
                a, b = x, y
                continue
            from_b, from_a = b + go_a > a + stay_a, a + go_b > b + stay_b
            back.append((from_b, from_a))
            a, b = x + (b + go_a if from_b else a + stay_a), y + (a + go_b if from_a else b + stay_b)
        out = [CONTENT if a >= b else BOILERPLATE]
        for from_b, from_a in reversed(back):
            out.append((BOILERPLATE if from_b else CONTENT) if out[-1] == CONTENT else (CONTENT if from_a else BOILERPLATE))
        return out[::-1][: len(lines)]

    @property
    def _lists(self):
        if "_l" not in self.__dict__:
            self._l = self.emit.tolist(), self.turn.ravel().tolist()
        return self._l


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(examples: list[tuple[list[tuple[int, ...]], int]]) -> Field | None:
    """Fitted to (features of the lines, label of the document), marked anew and fitted again; None if a label is missing."""
    examples = [e for e in examples if e[0]]
    if len({y for _, y in examples}) < 2:
        return None
    first = _likeliest(examples, [[y] * len(x) for x, y in examples], turns=False)
    held = []
    for y in (CONTENT, BOILERPLATE):
        emit = first.emit.copy()
        emit[y][0] += PRIOR
        held.append(Field(emit, first.turn))
    return _likeliest(examples, [held[y].decode(x) for x, y in examples])


def _likeliest(examples: list[tuple[list[tuple[int, ...]], int]], marks: list[list[int]], turns: bool = True) -> Field:
    """Maximum likelihood of the marks of all lines; without ``turns`` each line stands for itself."""
    docs, longest = len(examples), max(len(x) for x, _ in examples)
    x = np.zeros((docs, longest, FEATURES))
    there = np.zeros((docs, longest), bool)
    mark = np.zeros((docs, longest), np.int64)
    label = np.array([y for _, y in examples])
    for k, (lines, _) in enumerate(examples):
        for t, own in enumerate(lines):
            x[k, t, list(own)] = 1
        there[k, : len(lines)] = True
        mark[k, : len(lines)] = marks[k]
    # Documents of both labels weigh the same, whatever their share of the lines.
    lines_of_label = np.bincount(label, there.sum(axis=1), 2)
    weight = (0.5 / lines_of_label)[label][:, None]
    emit, turn = np.zeros((2, FEATURES)), np.zeros((2, 2))
    state = [np.zeros_like(emit), np.zeros_like(turn)]
    true = np.eye(2)[mark] * there[:, :, None]
    pairs = there[:, 1:]
    seen = np.einsum("dti,dtj->dij", true[:, :-1], true[:, 1:])
    for _ in range(STEPS):
        score = x @ emit.T
        forward, backward = np.zeros((docs, longest, 2)), np.zeros((docs, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = _lse(forward[:, t - 1, :, None] + turn, 1) + score[:, t]
            forward[:, t] = np.where(there[:, t, None], step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _lse(turn + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(there[:, t + 1, None], step, 0)
        total = _lse(forward[:, -1], 1)
        own = np.exp(forward + backward - total[:, None, None]) * there[:, :, None]
        joint = np.exp(
            forward[:, :-1, :, None] + turn + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * pairs[:, :, None, None]
        grad_emit = np.einsum("dtl,dtf->lf", (true - own) * weight[:, :, None], x) - DECAY * emit
        grad_turn = ((seen - joint.sum(axis=1)) * weight[:, :, None]).sum(axis=0) - DECAY * turn
        if not turns:
            grad_turn[:] = 0
        for w, g, s in ((emit, grad_emit, state[0]), (turn, grad_turn, state[1])):
            s += g * g
            w += RATE * g / np.sqrt(s + 1e-12)
    return Field(emit, turn)


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """Fit on labelled documents that are not held out: the ones with the least hashes of their ids, half of each label."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(~common.held_out())
    chosen = [known.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE // 2) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # at most SAMPLE pairs of numbers

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "quality", "part", "lines"]
        for batch in common.batches(batches_):
            for doc, text, quality in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "quality")), strict=True):
                lines, again, _ = lines_of(text or "")
                for start in range(0, len(lines), STRETCH):
                    stop = start + STRETCH
                    own = [list(features(*x)) for x in zip(lines[start:stop], again[start:stop], strict=True)]
                    yield pa.record_batch([
                        pa.array([doc], pa.int64()), pa.array([quality], pa.int32()), pa.array([start // STRETCH], pa.int64()),
                        pa.array([own], pa.list_(pa.list_(pa.int32()))),
                    ], names)

    cut = rows.select("doc_id", "text", "quality").mapInArrow(run, "doc_id bigint, quality int, part bigint, lines array<array<int>>")
    cut = cut.dropDuplicates(["doc_id", "part"])
    least = [cut.filter(F.col("quality") == y).orderBy(F.xxhash64("doc_id", "part"), "doc_id", "part").limit(SAMPLE) for y in (0, 1)]
    found = least[0].union(least[1]).collect()  # at most 2 * SAMPLE stretches of STRETCH lines
    found.sort(key=lambda r: (r.doc_id, r.part))
    return fit([([tuple(x) for x in r.lines], CONTENT if r.quality else BOILERPLATE) for r in found])


def content_share(field: Field | None, lines: list[str], again: list[bool]) -> float:
    """Share of the words that stand in lines marked as content."""
    if not lines:
        return 0.0
    sizes = [len(line.split()) or 1 for line in lines]
    if field is None:
        return 1.0
    marks = field.decode([features(*x) for x in zip(lines, again, strict=True)])
    return sum(n for n, m in zip(sizes, marks, strict=True) if m == CONTENT) / sum(sizes)


def with_quality(docs: DataFrame, field: Field | None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share, base_failed and kept; columns of these
    names are replaced."""
    new = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, content_share double, base_failed boolean, kept boolean"
    names = [x.split()[0] for x in new.split(", ")]
    docs = docs.drop(*names)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows, bpe.BLOCK):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = []
            for text, words in zip(texts, texts_words([t.encode("utf-8", "replace") for t in texts]), strict=True):
                lines, again, dup = lines_of(text)
                n, repeat = len(words), repeated_words(words)
                chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
                symbols = sum(map(text.count, SYMBOLS))
                failed = n < LEAST_WORDS or 100 * repeat > MOST_REPEATED * n
                share = content_share(field, lines, again)
                out.append((n, chars, symbols, dup, repeat, share, failed, not failed and share >= LEAST_SHARE))
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            for name, kind, values in zip(names, kinds, columns, strict=True):
                batch = batch.append_column(name, pa.array(values, kind))
            yield batch

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, {new}")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    judged = with_quality(docs.select("doc_id", "text"), train(docs, common.table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The counted columns in SQL; what the field decides has none.
BASE_SQL = rf"""
WITH worded AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{common.WORD}') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM worded WHERE len(w) > 2),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1 AS again FROM windows),
places AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS place FROM grams WHERE again),
repeats AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM worded),
again AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '{common.WORD}') GROUP BY ALL) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
       CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(a.n, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(w.w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w.w) AS base_failed
FROM worded w LEFT JOIN again a ON a.doc_id = w.doc_id LEFT JOIN repeats r ON r.doc_id = w.doc_id
"""

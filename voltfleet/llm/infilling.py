"""Fill-in-the-middle transformation of whole texts by block rotations in place, and its inverse.

A text is cut into prefix, middle and suffix at two unit boundaries; a unit is a word with the white space before it, or the
white space at the end. The cuts are found by scanning the bytes. The sentinels go into a bytearray of the text's size and
three sentinels, and segments change places by rotations: a block rotates when its two parts and then the whole are reversed.

* prefix-suffix-middle: ``<P>`` prefix | ``<M>`` middle | ``<S>`` suffix, the last two exchanged;
* suffix-prefix-middle: the same, with the last moved to the front.

``restore`` finds the sentinels, rotates back and takes them out; it reads nothing but the output and its form. A text that
holds a sentinel stays plain, so the three that were put in are the only ones: a sentinel's first letter is not among its
others, hence text before or after it cannot complete another.

Cases: null and empty texts are plain, with an output that is empty. A null id draws as the text ``null``. Rows that repeat
draw alike. Texts of any length are worked on whole, one at a time. New columns replace those of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.llm import common

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts that can be cut so many are; of 100 of these so many put the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes scanned at once.
BLOCK = 1 << 20


def unit_ends(data: bytes) -> np.ndarray:
    """Byte after each unit of a text."""
    found = []
    for at in range(0, len(data), BLOCK):
        space = SPACE[np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)]
        last = at + len(space) == len(data)
        after = np.append(space[1:], last or bool(SPACE[data[at + len(space)]]))
        found.append(np.flatnonzero(~space & after) + at + 1)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    return np.append(ends, len(data)) if len(data) and SPACE[data[-1]] else ends


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that a seed and an id fix."""
    name = f"{seed}:{'null' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12))  # type: ignore[return-value]


def rotate(block: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the neighbours ``[start, cut)`` and ``[cut, end)`` by three reversals."""
    view = np.frombuffer(block, np.uint8)
    for a, b in ((start, cut), (cut, end), (start, end)):
        half = (b - a) // 2
        low, high = view[a : a + half], view[b - half : b][::-1]
        held = low.copy()
        low[:] = high
        high[:] = held


def _chars(data: bytes) -> int:
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def transform(data: bytes, doc_id: int | None, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, bytes, int | None, int | None]:
    """Number of units, form, output, and code points of prefix and middle of one text in UTF-8."""
    ends = unit_ends(data)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not data or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", data, None, None
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    block = bytearray(len(data) + 9)
    at = 0
    for mark, part in ((PREFIX, (0, first)), (MIDDLE, (first, second)), (SUFFIX, (second, len(data)))):
        block[at : at + 3] = mark
        at += 3
        size = part[1] - part[0]
        block[at : at + size] = memoryview(data)[part[0] : part[1]]
        at += size
    form = "spm" if h4 % 100 < suffix_first else "psm"
    rotate(block, 0 if form == "spm" else first + 3, second + 6, len(block))
    return n, form, bytes(block), _chars(data[:first]), _chars(data[first:second])


def restore(output: bytes, form: str) -> bytes:
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    block = bytearray(output)
    if form == "spm":
        rotate(block, 0, block.index(PREFIX), len(block))
    else:
        rotate(block, block.index(SUFFIX), block.index(MIDDLE), len(block))
    for mark in (SUFFIX, MIDDLE, PREFIX):  # from the end, so that places before stay
        at = block.rindex(mark)
        del block[at : at + 3]
    return bytes(block)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def with_infilling(df: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Add fim_units, fim_form, fim_text, fim_prefix_chars and fim_middle_chars to every row."""
    common.prepare(df.sparkSession)
    df = df.drop("fim_units", "fim_form", "fim_text", "fim_prefix_chars", "fim_middle_chars")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            made = [transform(t or b"", i, seed, rate, suffix_first) for t, i in zip(texts, batch.column(doc_id).to_pylist(), strict=True)]
            n, form, out, prefix, middle = zip(*made, strict=True)
            batch = batch.append_column("fim_units", pa.array(n, pa.int64())).append_column("fim_form", pa.array(form, pa.string()))
            batch = batch.append_column("fim_text", pa.array(out, pa.binary()).cast(pa.string()))
            yield batch.append_column("fim_prefix_chars", pa.array(prefix, pa.int64())).append_column("fim_middle_chars", pa.array(middle, pa.int64()))

    return df.mapInArrow(run, f"{_ddl(df)}, fim_units bigint, fim_form string, fim_text string, fim_prefix_chars bigint, fim_middle_chars bigint")


def restored(df: DataFrame, out: str = "fim_restored") -> DataFrame:
    """Add the texts that ``fim_text`` was made of, from it and ``fim_form`` alone."""
    common.prepare(df.sparkSession)
    df = df.drop(out)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            texts = batch.column("fim_text").cast(pa.binary()).to_pylist()
            made = [restore(t, f) for t, f in zip(texts, batch.column("fim_form").to_pylist(), strict=True)]
            yield batch.append_column(out, pa.array(made, pa.binary()).cast(pa.string()))

    return df.mapInArrow(run, f"{_ddl(df)}, `{out}` string")


def _sha256(col: str) -> Column:
    return F.sha2(F.col(col).cast("binary"), 256)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_infilling(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return restored(made).select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"),
        _sha256("fim_text").alias("output_sha256"),
        _sha256("fim_restored").alias("restored_sha256"),
    )


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_JOIN = "array_to_string(units[{}], '')"
ORACLE = rf"""
WITH digests AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS units,
         sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS hex FROM documents),
drawn AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n,
         list_transform([1, 9, 17, 25], lambda s: list_reduce(list_transform(range(s, s + 8), lambda i: instr('0123456789abcdef', substr(hex, i, 1)) - 1),
                        lambda a, d: a * 16 + d)) AS h FROM digests),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {RATE} THEN 'plain'
              WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, CASE WHEN a = 0 THEN '' ELSE {_JOIN.format("1:a")} END AS prefix, CASE WHEN b = a THEN '' ELSE {_JOIN.format("a + 1:b")} END AS middle,
         CASE WHEN b = n THEN '' ELSE {_JOIN.format("b + 1:n")} END AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

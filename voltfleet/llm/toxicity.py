"""Toxicity of whole texts, by a factorization machine over hashed terms.

A term is a run of letters and digits, A-Z lower-cased, hashed to one of ``SLOTS`` slots; a text has a slot or not. The
machine adds a weight per slot and, for each pair of slots in a text, the product of their factors, so it learns that two
terms together mean more than each alone. It is fitted in numpy on at most
``SAMPLE`` labelled documents, those with the least hashes of their ids, and in two steps: over the ``FIRST`` slots whose
presence differs most between the labels, all documents at once, and from there over every slot of the documents, in small
batches. The second step has to explain what the first could not, so it finds pairs of terms that say nothing alone. No term
is left out: one seen in few documents speaks more softly, by count / (count + ``DOUBT``), and penalties hold every slot to
what the first step gave it, zero for most. A term that no labelled document has says nothing.

A null or empty text has no terms and gets the score of the bias. A document with several labels counts as toxic if one of
them says so; null labels teach nothing. With no labels of one kind to learn from, every score is 0. Repeated rows are
scored as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.llm import bpe, common
from voltfleet.llm.shingles import texts_words

SAMPLE = 20_000
HASH_BITS = 19
SLOTS = 1 << HASH_BITS
#: Each step takes ``BATCH`` documents.
FIRST, LEAST_DOCS = 768, 5
FACTORS, STEPS, RATE = 6, 220, 0.08
#: Penalties of the first step on weights and on factors, for the sum over documents.
DECAY = (2e-4, 2e-3)
#: The second step: batches, documents in each, rate and penalties.
BATCHES, BATCH, PACE = 400, 128, 0.05
HOLD = (10.0, 3.0)
DOUBT = 20
LIMIT = 0.7
_KEPT = {b: b for b in range(128, 256)} | {b: ord(chr(b).lower()) for b in range(128) if chr(b).isalnum()}
TRANSLATE = bytes(_KEPT.get(b, 32) for b in range(256))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # by slot
    factor: np.ndarray  # slots, FACTORS


def texts_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and slot of every term in it."""
    words = texts_words([(t or "").encode("utf-8", "replace").translate(TRANSLATE) for t in texts])
    which = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.concatenate(words) if words else np.zeros(0, np.uint64)
    return which, flat >> np.uint64(64 - HASH_BITS)


def _sums(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Sums of rows by document; rows in document order."""
    edge = np.searchsorted(doc, np.arange(docs + 1))
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[edge[1:]] - total[edge[:-1]]


def raw_scores(m: Machine, doc: np.ndarray, term: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Score before the logistic function of each document, and the sums of its terms' factors."""
    v = m.factor[term]
    sums = _sums(np.concatenate([m.weight[term, None], v, v * v], axis=1), doc, docs)
    factors = sums[:, 1 : 1 + FACTORS]
    return m.bias + sums[:, 0] + 0.5 * (factors * factors - sums[:, 1 + FACTORS :]).sum(axis=1), factors


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _first(flat: np.ndarray, doc: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, Machine]:
    """Slots that differ most between the labels, and a machine over them alone."""
    terms, term, count = np.unique(flat, return_inverse=True, return_counts=True)
    toxic = np.bincount(term, label[doc], len(terms))
    share = label.mean()
    lift = (toxic - count * share) ** 2 / (count * share * (1 - share))
    lift[count < LEAST_DOCS] = -1
    chosen = np.sort(np.argsort(-lift, kind="stable")[:FIRST])
    chosen = chosen[lift[chosen] >= 0]
    number = np.full(len(terms), -1)
    number[chosen] = np.arange(len(chosen))
    keep = number[term] >= 0
    doc, term = doc[keep], number[term[keep]]
    rng = np.random.default_rng(11)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS)))
    state = [np.zeros(1), np.zeros_like(m.weight), np.zeros_like(m.factor)]
    speed = [np.zeros_like(s) for s in state]
    by_term = np.argsort(term, kind="stable")
    edge = np.searchsorted(term[by_term], np.arange(len(chosen) + 1))
    for step in range(1, STEPS + 1):
        raw, factors = raw_scores(m, doc, term, len(label))
        wrong = (_logistic(raw) - label) / len(label)
        row = wrong[doc]
        each = np.concatenate([row[:, None], row[:, None] * (factors[doc] - m.factor[term])], axis=1)[by_term]
        total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)])
        grad = total[edge[1:]] - total[edge[:-1]]
        grads = [np.array([wrong.sum()]), grad[:, 0] + DECAY[0] * m.weight / 10, grad[:, 1:] + DECAY[1] * m.factor / 10]
        values = [np.array([m.bias]), m.weight, m.factor]
        for x, g, mean, square in zip(values, grads, state, speed, strict=True):
            mean += 0.1 * (g - mean)
            square += 0.01 * (g * g - square)
            x -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        m.bias = float(values[0][0])
    return terms[chosen], m


def fit(examples: list[tuple[np.ndarray, int]]) -> Machine | None:
    """Train on (distinct slots of a document, label); None if a label is missing. The same examples give the same machine."""
    label = np.array([y for _, y in examples], float)
    if not 0 < label.sum() < len(label):
        return None
    size = np.array([len(t) for t, _ in examples])
    begin = np.cumsum(size) - size
    flat = np.concatenate([t for t, _ in examples]).astype(np.int32)
    chosen, early = _first(flat, np.repeat(np.arange(len(examples)), size), label)
    count = np.bincount(flat, minlength=SLOTS)
    trust = (count / (count + DOUBT)).astype(np.float32)
    rng = np.random.default_rng(11)
    bias, table = early.bias, np.zeros((SLOTS, 1 + FACTORS), np.float32)
    # The weight and the factors of a slot in one row, before they are softened.
    table[chosen] = np.column_stack([early.weight, early.factor]) / trust[chosen, None]
    start = table.copy()
    others = np.setdiff1d(np.flatnonzero(count), chosen)
    table[others, 1:] = rng.normal(0, 0.01, (len(others), FACTORS))
    speed = np.ones_like(table)
    hold = np.array([HOLD[0]] + [HOLD[1]] * FACTORS)
    left = np.zeros(0, int)
    for _ in range(BATCHES):
        if not len(left):
            left = rng.permutation(len(examples))
        some, left = left[:BATCH], left[BATCH:]
        doc = np.repeat(np.arange(len(some)), size[some])
        ends = np.cumsum(size[some])
        slots, at = np.unique(flat[np.repeat(begin[some] - (ends - size[some]), size[some]) + np.arange(len(doc))], return_inverse=True)
        soft, own = trust[slots, None], table[slots]
        m = Machine(bias, own[:, 0] * soft[:, 0], own[:, 1:] * soft)
        raw, factors = raw_scores(m, doc, at, len(some))
        row = (_logistic(raw) - label[some])[doc]
        around = row[:, None] * (factors[doc] - m.factor[at])
        grad = np.stack([np.bincount(at, x, len(slots)) for x in (row, *around.T)], axis=1) * soft
        grad += hold * (own - start[slots]) * (np.bincount(at, minlength=len(slots)) / count[slots])[:, None]
        speed[slots] += grad * grad
        table[slots] -= PACE * grad / np.sqrt(speed[slots])
    table *= trust[:, None]
    return Machine(bias, table[:, 0].copy(), table[:, 1:].copy())


def train(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """Fit on labelled documents that are not held out."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~common.held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most SAMPLE pairs of numbers

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(batches_):
            which, term = texts_terms(batch.column("text").to_pylist())
            cut = np.searchsorted(which, np.arange(batch.num_rows + 1))
            blobs = [np.unique(term[a:b]).astype(np.uint32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "toxic", "terms"])

    found = rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id bigint, toxic int, terms binary").dropDuplicates(["doc_id"]).collect()
    found.sort(key=lambda r: r.doc_id)
    return fit([(np.frombuffer(r.terms, np.uint32), int(r.toxic)) for r in found])


def scores(m: Machine | None, texts: list[str | None]) -> np.ndarray:
    if m is None:
        return np.zeros(len(texts))
    doc, term = texts_terms(texts)
    pair = np.unique(doc * np.int64(SLOTS) + term.astype(np.int64))
    return _logistic(raw_scores(m, pair // SLOTS, pair % SLOTS, len(texts))[0])


def with_toxicity(docs: DataFrame, m: Machine | None) -> DataFrame:
    """Add score and predicted; columns of these names are replaced."""
    docs = docs.drop("score", "predicted")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows, bpe.BLOCK):
            yield batch.append_column("score", pa.array(scores(m, batch.column("text").to_pylist()), pa.float64()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, score double").withColumn("predicted", (F.col("score") >= LIMIT).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    judged = with_toxicity(docs.select("doc_id", "text"), train(docs, common.table(spark, sf_dir, "labels")))
    return judged.select("doc_id", common.held_out().alias("held_out"), "score", "predicted")

"""Language of whole texts, by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` bytes, each from both ends with an empty state; every byte gets a probability per
language, and a text's probabilities are the means over all its bytes. A text shorter than a window is repeated to fill it,
and the last window of a longer one reaches back; either way each byte counts once. Weights are fitted in numpy by
backpropagation through time on a sample of at most ``PER_LANGUAGE`` documents of each language, three pieces of each.

A text that is null or has no letter is ``und`` with score 0, and so is every text when there is nothing to learn from. A null
language teaches nothing. Equal texts get equal results; repeated rows stay as often as they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voltfleet.llm import common

#: Documents of each language to learn from, and characters of each of their three pieces.
PER_LANGUAGE, PIECE_CHARS = 240, 160
WINDOW, HIDDEN = 96, 8
STEPS, BATCH, RATE, TRAIN_WINDOW = 220, 384, 0.02, 64
#: Windows read side by side.
SIDE = 4096
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """Per direction: weights from a byte (and bias) to the three gates, and from the state to them; weights to the labels."""

    labels: list[str]
    byte: np.ndarray  # 2, 3 H, 256
    state: np.ndarray  # 2, 3 H, H
    out: np.ndarray  # labels, 2 H
    bias: np.ndarray  # labels, 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def _forward(net: Network, side: int, text: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """States and gates after each byte; ``text``: time by window."""
    h = np.zeros((HIDDEN, text.shape[1]), np.float32)
    out = []
    for x in text:
        gates, rec = net.byte[side][:, x], net.state[side] @ h
        zr = _sigmoid(gates[: 2 * HIDDEN] + rec[: 2 * HIDDEN])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n = np.tanh(gates[2 * HIDDEN :] + r * rec[2 * HIDDEN :])
        out.append((h, z, r, n, rec[2 * HIDDEN :]))
        h = n + z * (h - n)
    out.append((h,))
    return out


def _gradients(net: Network, text: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of the mean cross entropy of all positions."""
    steps, wide = text.shape
    runs = [_forward(net, 0, text), _forward(net, 1, text[::-1])]
    target = np.eye(len(net.labels), dtype=np.float32)[:, label]
    d_byte, d_state = np.zeros_like(net.byte), np.zeros_like(net.state)
    d_out, d_bias = np.zeros_like(net.out), np.zeros_like(net.bias)
    d_hidden = [[None] * steps, [None] * steps]
    for t in range(steps):
        both = np.concatenate([runs[0][t + 1][0], runs[1][steps - t][0]])
        wrong = (_softmax(net.out @ both + net.bias) - target) / (steps * wide)
        d_out += wrong @ both.T
        d_bias += wrong.sum(axis=1, keepdims=True)
        back = net.out.T @ wrong
        d_hidden[0][t], d_hidden[1][steps - 1 - t] = back[:HIDDEN], back[HIDDEN:]
    for side in (0, 1):
        dh = np.zeros((HIDDEN, wide), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, n, rec = runs[side][t]
            dh = dh + d_hidden[side][t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * rec * r * (1 - r)
            d_gates = np.concatenate([dz, dr, dn])
            d_rec = np.concatenate([dz, dr, dn * r])
            d_state[side] += d_rec @ h.T
            x = text[t] if side == 0 else text[steps - 1 - t]
            order = np.argsort(x, kind="stable")
            cut = np.flatnonzero(np.append(True, x[order][1:] != x[order][:-1]))
            d_byte[side][:, x[order][cut]] += np.add.reduceat(d_gates[:, order], cut, axis=1)
            dh = dh * z + net.state[side].T @ d_rec
    return d_byte, d_state, d_out, d_bias


def fit(pieces: list[tuple[str, bytes]]) -> Network | None:
    """Train on (language, piece of text); None without any. The same pieces give the same network."""
    pieces = sorted(p for p in pieces if len(p[1]))
    labels = sorted({p[0] for p in pieces})
    if not labels:
        return None
    rng = np.random.default_rng(7)
    small = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Network(labels, small(2, 3 * HIDDEN, 256), small(2, 3 * HIDDEN, HIDDEN), small(len(labels), 2 * HIDDEN), np.zeros((len(labels), 1), np.float32))
    by_label = [[p[1] for p in pieces if p[0] == name] for name in labels]
    weights = [net.byte, net.state, net.out, net.bias]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        label = rng.integers(0, len(labels), BATCH)
        text = np.zeros((TRAIN_WINDOW, BATCH), np.uint8)
        for k, c in enumerate(label.tolist()):
            piece = by_label[c][rng.integers(len(by_label[c]))]
            piece = piece * -(-TRAIN_WINDOW // len(piece)) if len(piece) < TRAIN_WINDOW else piece
            at = rng.integers(0, len(piece) - TRAIN_WINDOW + 1)
            text[:, k] = np.frombuffer(piece, np.uint8, TRAIN_WINDOW, at)
        rate = RATE * (1 - 0.9 * step / STEPS)
        for w, g, m, v in zip(weights, _gradients(net, text, label), mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _read(net: Network, side: int, text: np.ndarray, weights: np.ndarray) -> Iterator[np.ndarray]:
    """Label scores after each byte, from one side; buffers are used again and again."""
    wide = text.shape[1]
    h, d = np.zeros((HIDDEN, wide), np.float32), np.empty((HIDDEN, wide), np.float32)
    gates, rec = np.empty((3 * HIDDEN, wide), np.float32), np.empty((3 * HIDDEN, wide), np.float32)
    # Half of the weights of the two sigmoid gates, so that these are tanh as well.
    byte, state = net.byte[side].copy(), net.state[side].copy()
    byte[: 2 * HIDDEN] *= 0.5
    state[: 2 * HIDDEN] *= 0.5
    zr, z, r, n = gates[: 2 * HIDDEN], gates[:HIDDEN], gates[HIDDEN : 2 * HIDDEN], gates[2 * HIDDEN :]
    rec_zr, rec_n = rec[: 2 * HIDDEN], rec[2 * HIDDEN :]
    for x in text:
        np.take(byte, x, axis=1, out=gates, mode="clip")
        np.matmul(state, h, out=rec)
        np.add(zr, rec_zr, out=zr)
        np.tanh(zr, out=zr)
        np.multiply(zr, 0.5, out=zr)
        np.add(zr, 0.5, out=zr)
        np.multiply(rec_n, r, out=rec_n)
        np.add(n, rec_n, out=n)
        np.tanh(n, out=n)
        np.subtract(h, n, out=d)
        np.multiply(d, z, out=d)
        np.add(n, d, out=h)
        yield weights @ h


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of the labels over all bytes of each text, which is not empty; a row per text."""
    size = np.array([len(t) for t in texts])
    filled = [t if len(t) >= WINDOW else (t * -(-WINDOW // len(t)))[:WINDOW] for t in texts]
    length = np.maximum(size, WINDOW)
    base = np.cumsum(length) - length
    data = np.frombuffer(b"".join(filled), np.uint8)
    many = -(-length // WINDOW)
    owner = np.repeat(np.arange(len(texts)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    begin = np.minimum(number * WINDOW, length[owner] - WINDOW)
    counted_from = (number * WINDOW - begin).astype(np.int32)
    counted_to = np.minimum(size[owner] - begin, WINDOW).astype(np.int32)
    sums = np.zeros((len(net.labels), len(owner)), np.float32)
    for at in range(0, len(owner), SIDE):
        part = slice(at, at + SIDE)
        place = (base[owner[part]] + begin[part])[None, :] + np.arange(WINDOW)[:, None]
        text = data[place]
        from_left = list(_read(net, 0, text, net.out[:, :HIDDEN]))
        partial = (counted_from[part] > 0) | (counted_to[part] < WINDOW)
        for t, right in zip(range(WINDOW - 1, -1, -1), _read(net, 1, text[::-1], net.out[:, HIDDEN:]), strict=True):
            p = right
            p += from_left[t]
            p += net.bias
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            if partial.any():
                p *= (counted_from[part] <= t) & (t < counted_to[part])
            sums[:, part] += p
    pooled = np.add.reduceat(sums.astype(np.float64), np.cumsum(many) - many, axis=1)
    return (pooled / size).T


def position_labels(net: Network, text: str) -> list[str]:
    """The label of each byte of a text."""
    data = text.encode()
    window = np.frombuffer(data, np.uint8)[:, None]
    left = [np.copy(x) for x in _read(net, 0, window, net.out[:, :HIDDEN])]
    right = [np.copy(x) for x in _read(net, 1, window[::-1], net.out[:, HIDDEN:])][::-1]
    return [net.labels[int(np.argmax(a + b + net.bias))] for a, b in zip(left, right, strict=True)]


def train(docs: DataFrame) -> Network | None:
    """Fit on a sample of documents that are not held out: of each language the ones with the least hashes of their ids."""
    starts = [F.floor(F.length("text") * share).cast("int") + 1 for share in (0.05, 0.4, 0.75)]
    pieces = F.array(*[F.substring(F.col("text"), s, F.lit(PIECE_CHARS)) for s in starts])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"))
    ranked = docs.filter(~common.held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ranked = ranked.select("lang", pieces.alias("pieces"), F.row_number().over(order).alias("rank")).filter(F.col("rank") <= PER_LANGUAGE)
    rows = ranked.select("lang", "pieces").collect()  # at most PER_LANGUAGE short rows for each language
    return fit([(row.lang, piece.encode()) for row in rows for piece in row.pieces])


def with_language(docs: DataFrame, net: Network | None) -> DataFrame:
    """Add lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(rows):
            texts = batch.column("text").to_pylist()
            name, score = ["und"] * len(texts), [0.0] * len(texts)
            where = [k for k, t in enumerate(texts) if net is not None and t and LETTER.search(t)]
            if where:
                found = probabilities(net, [texts[k].encode("utf-8", "replace") for k in where])
                best = found.argmax(axis=1)
                for k, row, b in zip(where, found, best.tolist(), strict=True):
                    name[k], score[k] = net.labels[b], min(1.0, float(row[b]))
            batch = batch.append_column("lang_pred", pa.array(name, pa.string()))
            yield batch.append_column("score", pa.array(score, pa.float64()))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, lang_pred string, score double")


#: Score under which the pipeline rejects a document.
LEAST_SCORE = 0.4


def accepted(docs: DataFrame) -> DataFrame:
    """Documents with a language that is clear enough. Where nothing can be learned, those with a letter stay."""
    common.prepare(docs.sparkSession)
    columns, net = docs.columns, train(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return with_language(docs, net).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    judged = with_language(docs.select("doc_id", "text"), train(docs))
    return judged.select("doc_id", common.held_out().alias("held_out"), "lang_pred", "score")

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voltfleet.llm import bpe, common, packing, token_counts

PATH = bpe.tokenizer_path("word_bpe_49k.json")


def library(texts):
    return [e.ids for e in bpe.pieces(PATH).library.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["", "it's they'RE 's 'r 'really'", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ ς İs é é", "a\x1cb c\x85d", "１２ ３ 中文字 😀", "!!! ''s --", "x" * 70]


def test_ids_and_counts_match_the_library():
    got = bpe.encode_texts(PATH, [*TEXTS, None])
    assert [g.tolist() for g in got] == [*library(TEXTS), []]
    assert token_counts.totals(PATH, [*TEXTS, None]).tolist() == [len(x) for x in library(TEXTS)] + [0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aeinorst'hsREd1!é<|> \n", max_size=30))
def test_any_prefix_matches_the_library(text):
    want = [len(x) for x in library([text[:k] for k in range(len(text) + 1)])]
    assert token_counts.prefix_counts(PATH, text).tolist() == want


def test_words_whose_polynomial_hashes_agree_have_their_own_ids():
    texts = []
    for size in (1024, 2048, 4096):
        x, y = "a", "b"
        while len(x) < size:
            x, y = x + y, y + x
        texts += [x, y, f"{y} {x}"]
    assert [g.tolist() for g in bpe.encode_texts(PATH, texts)] == library(texts)
    assert token_counts.totals(PATH, texts).tolist() == [len(x) for x in library(texts)]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(bpe.Found, "hashes", lambda self: self.size.astype(np.uint64) % np.uint64(3))
    texts = ["the cat sat on a mat with that rat and the other dog", "another dog sat on the other mat"] * 3
    known = bpe.Words(PATH)
    got = [known.block(t.encode())[0].tolist() for t in texts]
    assert got == library(texts)


def test_older_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 60)
    known = bpe.Words(PATH)
    for k in range(40):
        text = " ".join(f"word{(k * 7 + j) % 90} and thing{j}" for j in range(12))
        assert known.block(text.encode())[0].tolist() == library([text])[0]
        assert known.table.size <= 100


def test_token_pairs_are_judged_as_by_encoding():
    engine = bpe.pieces(PATH)
    rng = np.random.default_rng(2)
    inner = [i for i, (s, end) in engine.spelled.items() if s and not end]
    left, right = rng.choice(inner, 3000), rng.choice([i for i, (s, _) in engine.spelled.items() if s], 3000)
    for a, b, apart in zip(left.tolist(), right.tolist(), engine.apart(left, right), strict=True):
        (first, _), (second, end) = engine.spelled[a], engine.spelled[b]
        ids = np.array([[*engine.first[np.frombuffer(first + second, np.uint8)]]])
        ids[0, -1] = engine.final[second[-1]] if end else ids[0, -1]
        ids, count = engine.merge(ids.astype(np.int32))
        assert apart == (count[0] == 2 and ids[0, :2].tolist() == [a, b])


def test_texts_of_more_than_a_block(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 64)
    bpe.powers.cache_clear()
    texts = ["the cat sat on the mat " * 20, "y" * 200 + " and " + "z" * 10, "short"]
    try:
        assert [g.tolist() for g in bpe.encode_texts(PATH, texts)] == library(texts)
        assert token_counts.totals(PATH, texts).tolist() == [len(x) for x in library(texts)]
    finally:
        bpe.powers.cache_clear()


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    texts = ["one two three four", "five six seven one", "one eight"]
    assert [g.tolist() for g in bpe.encode_texts(PATH, texts)] == library(texts)


def test_budget(spark):
    df = spark.createDataFrame([(1, "hello wonderful world"), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in token_counts.with_prefix_counts(df, PATH, budget=2).collect()}
    counts = token_counts.prefix_counts(PATH, "hello wonderful world")
    assert got[1].kept_chars == max(k for k, c in enumerate(counts) if c <= 2) and got[2].kept_chars == 0
    whole = token_counts.with_prefix_counts(df, PATH).collect()[0]
    assert whole.prefix_tokens == counts.tolist()


def test_op1(spark, odd_dir, empty_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(library([r.text or ""])[0]), n > 2048) for r in docs), key=repr)
    assert sorted((tuple(r) for r in token_counts.op1_token_counts(spark, odd_dir).collect()), key=repr) == want
    assert token_counts.op1_token_counts(spark, empty_dir).count() == 0


def test_op10(spark, odd_dir, empty_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = packing.op10_packing(spark, odd_dir).collect()
    want = []
    for r in docs:
        ids = np.array([*library([r.text or ""])[0], 0], "<u4")
        want += [(r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(bins) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.op10_packing(spark, empty_dir).count() == 0


def test_every_capacity_holds():
    lengths = np.sort(np.random.default_rng(3).integers(1, 400, 500))[::-1]
    capacity = packing.Capacity(tokens=1000, pieces=4, attention=180_000)
    sequence, offset = packing.best_fit(lengths, capacity)
    for s in np.unique(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 1000 and len(own) <= 4 and (own**2).sum() <= 180_000
        assert sorted(offset[sequence == s].tolist())[0] == 0
    with pytest.raises(ValueError):
        packing.best_fit(np.array([1001]), capacity)


def test_packed_arrays_come_back():
    a, b = np.arange(5, dtype="u8"), np.arange(5, dtype="u1")
    x, y = common.unpack(common.pack(a, b), "u8", "u1")
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()

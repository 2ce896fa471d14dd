from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from llm_helpers import prose, spark_rows, sql_rows
from voltfleet.llm import components, fingerprints, jaccard, shingles, suffix_dedup

SMALL = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(docs):
    sets = [shingle_set(t) for _, t in docs]
    group = list(range(len(docs)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def test_op4_matches_brute_force(spark, odd_dir, empty_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert spark_rows(jaccard.op4_ngram_jaccard_join(spark, odd_dir)) == brute_groups(docs)
    assert jaccard.op4_ngram_jaccard_join(spark, empty_dir).count() == 0


def test_op4_matches_sql(spark):
    got = jaccard.op4_ngram_jaccard_join(spark, SMALL)
    assert spark_rows(got) == sql_rows(SMALL, jaccard.ORACLE, got.columns)


def test_many_near_copies_and_frequent_passages(spark):
    """Copies that link only in chains, beside many texts that share a long passage and do not link."""
    rng = random.Random(5)
    base, passage = prose(900, 200).split(), prose(901, 60)
    docs = []
    for k in range(60):
        if k % 12 == 0:
            base = [w if rng.random() > 0.02 else f"new{rng.randrange(10**6)}" for w in base]
        docs.append((k, " ".join(w if rng.random() > 0.008 else f"w{rng.randrange(10**6)}" for w in base)))
    docs += [(1000 + k, passage + " " + prose(2000 + k, 30 + k % 25)) for k in range(80)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert spark_rows(jaccard.linked(df)) == brute_groups(docs)


def test_large_tiles_are_worked_on_in_blocks(spark, monkeypatch):
    """Families at the edge of the link threshold, in tiles cut to blocks of a few nodes and cells of a few shingles."""
    for name, value in (("BLOCK", 4), ("CELL_SHINGLES", 300), ("NEAR", 1), ("NEAR_TILES", 1)):
        monkeypatch.setattr(jaccard, name, value)
    docs = []
    for k in range(40):
        text = prose(77, 60).split()
        for j in range(k % 3):
            text[7 + 17 * j] = f"other{k}x{j}"
        docs.append((k, " ".join(text)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert spark_rows(jaccard.linked(df)) == brute_groups(docs)


def thue_morse(size, a="a", b="b"):
    while len(a) < size:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_words_whose_polynomial_hashes_agree_stay_apart(spark, size):
    x, y = thue_morse(size)
    docs = [(1, f"{x} one two three four"), (2, f"{y} one two three four"), (3, f"{x} one two three four five"), (4, f"{y} one two three four")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    assert spark_rows(jaccard.linked(df)) == brute_groups(docs)
    assert len(set(shingles.word_hashes(f"{x} {y} {x}".encode())[0].tolist())) == 2


def test_frequent_shingles_come_last_and_no_link_is_lost(spark):
    docs = [(k, prose(3000 + k % 7, 90) + f" tail{k}") for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    level = np.zeros(jaccard.CELLS, np.int8)
    level[::2] = 3
    tiles = jaccard.tile_rows(df, level, 4).collect()
    sets = dict(zip([jaccard._node(s) for s in shingles.text_shingles([t for _, t in docs])], shingles.text_shingles([t for _, t in docs]), strict=True))
    keys = {}
    for r in tiles:
        keys.setdefault(r.node, set()).add(r.key)
    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b]))
            if a < b and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                assert keys[a] & keys[b]


def test_signature_bound_is_never_too_low():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 900).astype(np.uint64)
        a, b = np.unique(pool[: rng.integers(1, 800)]), np.unique(pool[rng.integers(0, 300) :])
        both = len(np.intersect1d(a, b))
        bits = jaccard._stacked([jaccard._signature(x) for x in (a, b)])[:, None, :]
        if 100 * both >= 80 * (len(a) + len(b) - both):
            n_a, n_b = np.array([len(a)]), np.array([len(b)])
            assert jaccard._may_link(n_a, n_b, jaccard._most_shared(n_a, n_b, *bits))[0]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components_of_chains_and_stars(spark, one_task):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(5, 5), (-3, -9), (3, 2)]
    random.Random(5).shuffle(links)
    rows = spark.createDataFrame(links, "a bigint, b bigint").repartition(4)
    got = {r.node: r.component for r in components.components(rows, one_task).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 130)} | {-3: -9}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), one_task).count() == 0


def test_least_reached_agrees_with_single_links():
    rng = np.random.default_rng(7)
    for links in (rng.integers(-50, 50, (2, 40)), np.stack([rng.permutation(3000)[:-1], rng.permutation(3000)[1:]])):
        root: dict[int, int] = {}

        def top(x, root=root):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for x, y in links.T.tolist():
            x, y = sorted((top(x), top(y)))
            root[y] = x
        node, least = components.least_reached(*links)
        assert dict(zip(node.tolist(), least.tolist())) == {x: top(x) for x in root if top(x) != x}


def test_one_of_each_group_stays(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and words(r.text))
    assert ids == sorted([*{g for d, n, g in groups if n and g is not None}, 112])  # two texts have this id
    assert kept.filter("doc_id in (104, 105, 106)").count() == 3


def brute_removed(docs):
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        rest = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def test_op5_matches_brute_force(spark, odd_dir, empty_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{odd_dir}/documents.parquet").select("doc_id", "text").collect()]
    # One row of each id here; repeated rows and ids are looked at below.
    got = suffix_dedup.op5_suffix_dedup(spark, odd_dir).collect()
    once = {d: t for d, t in docs if d is not None and d not in (112, 113)}
    others = [(d, t) for d, t in docs if d in (None, 112, 113)]
    want = brute_removed(list(once.items()))
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id in want} == want
    assert len(got) == len(once) + len(others)
    assert len({tuple(r) for r in got if r.doc_id == 113}) == 1
    assert suffix_dedup.op5_suffix_dedup(spark, empty_dir).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_repeated_rows_are_one_document(spark, parts):
    """Rows of one id and text repeat nothing by themselves; of documents that share a text the later one loses it."""
    docs = [(113, prose(72, 70)), (7, "x" * 300), (200, prose(72, 70)), (8, None), (9, prose(74, 90)), (None, prose(75, 80))]
    df = spark.createDataFrame(docs * 40, "doc_id bigint, text string").repartition(parts)
    got = suffix_dedup.deduplicated(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert len(got) == 40 * len(docs)
    assert {tuple(r) for r in got} == {(d, *rest) for d, rest in brute_removed(docs).items()}
    assert {r.n_removed for r in got if r.doc_id == 113} == {0}


def test_op5_matches_sql(spark):
    got = suffix_dedup.op5_suffix_dedup(spark, SMALL)
    assert spark_rows(got) == sql_rows(SMALL, suffix_dedup.ORACLE, got.columns)


def test_repeats_within_and_across_texts(spark):
    rng = random.Random(2)
    letters = "ab"
    bits = ["".join(rng.choice(letters) for _ in range(rng.randrange(60, 260))) for _ in range(6)]
    docs = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 7)))) for k in range(40)] + [(50, "a" * 700), (51, "ab" * 400), (52, "a" * 99)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df).collect()}
    assert got == brute_removed(docs)


@pytest.mark.parametrize("shard", [300, 2000, 1 << 22])
def test_shards_of_one_anchor_merge(monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rng = np.random.default_rng(4)
    common_part = rng.integers(97, 99, 60).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 99, 30 + k % 5).astype(np.uint8)[: 30 + k % 5], common_part, np.full(30, 97 + k % 3, np.uint8)]) for k in range(60)]
    texts += [t.copy() for t in texts[:20]]
    size = np.array([len(t) for t in texts])
    d = np.arange(len(texts))[::-1].copy()
    zero = np.zeros(len(texts), np.int64)
    got = set()
    for gd, _, gs in suffix_dedup._repeats(np.concatenate(texts), np.cumsum(size) - size, size, zero.astype(np.uint64), d, zero, zero):
        got |= set(zip(gd.tolist(), gs.tolist(), strict=True))
    first: dict[bytes, tuple] = {}
    every = [(int(k), s, t[s : s + 100].tobytes()) for k, t in zip(d, texts, strict=True) for s in range(len(t) - 99)]
    for k, s, string in every:
        first[string] = min(first.get(string, (10**9, 0)), (k, s))
    assert got == {(k, s) for k, s, string in every if first[string] != (k, s)}


def surroundings(n):
    """Blobs of one bucket, as a task gets them: surroundings whose keys come several times, some with equal texts."""
    rng = np.random.default_rng(6)
    key = rng.integers(0, n // 3, n).astype(np.uint64)
    many = np.full(n, 60, np.uint8)
    texts = rng.integers(97, 100, (n // 3, 159)).astype(np.uint8)[key.astype(int)]
    texts[rng.random(n) < 0.5, 130:] = 120
    seen = np.array([hash(t.tobytes()) for t in texts]).view(np.uint64)
    d, row, start = rng.permutation(n), np.zeros(n, np.int64), rng.integers(0, 9, n).astype(np.int32)
    for o in np.array_split(np.arange(n), 20):
        plain = suffix_dedup.common.pack(texts[o])
        blob = suffix_dedup.common.pack(key[o], seen[o], d[o], row[o], start[o], many[o])
        yield pa.record_batch([pa.array([3], pa.int32()), pa.array([blob], pa.binary()), pa.array([plain], pa.binary())], ["to", "rows", "texts"])


def removed_strings(batches):
    out = []
    for batch in batches:
        for blob in batch.column("rows").to_pylist():
            d, _, start, many = suffix_dedup.common.unpack(blob, "i8", "i8", "i4", "u1")
            out += [(a, s) for a, b, m in zip(d.tolist(), start.tolist(), many.tolist(), strict=True) for s in range(b, b + m)]
    return sorted(out)


def test_a_bucket_in_several_passes_gives_the_same(monkeypatch):
    whole = removed_strings(suffix_dedup._removed(4, surroundings(900)))
    monkeypatch.setattr(suffix_dedup, "PASS", 5000)
    assert removed_strings(suffix_dedup._removed(4, surroundings(900))) == whole
    assert len(whole) > 10_000


def test_a_bucket_is_not_unpacked_whole():
    """A task holds a part of its bucket and a small suffix array at a time, and sends runs of strings, not each string."""
    rows = list(surroundings(120_000))
    tracemalloc.start()
    out = list(suffix_dedup._removed(4, iter(rows)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 90 << 20
    entries = sum(len(suffix_dedup.common.unpack(blob, "i8", "i8", "i4", "u1")[0]) for batch in out for blob in batch.column("rows").to_pylist())
    assert 40_000 < entries < 240_000


def test_kept_texts_are_whole_characters(spark):
    text = "é" * 120
    df = spark.createDataFrame([(1, text, "x"), (2, "ab" + text + "é", "y")], "doc_id bigint, text string, n string")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(df).collect()}
    assert got[2].n == "y" and set(got[2].text) <= set("abé")


def test_op6_matches_sql(spark, odd_dir, empty_dir):
    got = fingerprints.op6_fingerprints(spark, SMALL)
    assert spark_rows(got) == sql_rows(SMALL, fingerprints.ORACLE, got.columns)
    got = fingerprints.op6_fingerprints(spark, odd_dir)
    assert spark_rows(got) == sql_rows(odd_dir, fingerprints.ORACLE, got.columns)
    assert fingerprints.op6_fingerprints(spark, empty_dir).count() == 0


def test_ranges_of_ids_give_the_same_pairs(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    monkeypatch.setattr(fingerprints, "STEP", 3)
    got = fingerprints.op6_fingerprints(spark, SMALL)
    assert spark_rows(got) == sql_rows(SMALL, fingerprints.ORACLE, got.columns)


def test_sketches_merge_and_estimate(spark):
    a, b = prose(1, 900), prose(2, 500)
    df = spark.createDataFrame([(a, b, a + "\n" + b, a[: len(a) // 2])], "a string, b string, ab string, part string")
    f = {c: fingerprints.fingerprint(df[c]) for c in df.columns}
    row = df.select(
        fingerprints.distinct_count(f["a"]).alias("n"),
        fingerprints.containment(f["part"], f["a"]).alias("inside"),
        fingerprints.resemblance(f["a"], f["a"]).alias("same"),
        fingerprints.resemblance(fingerprints.merge(f["a"], f["b"]), f["ab"]).alias("merged"),
    ).first()
    assert abs(row.n - len(shingle_set(a))) < 0.3 * len(shingle_set(a))
    assert row.inside > 0.9 and row.same == 1.0 and row.merged > 0.9

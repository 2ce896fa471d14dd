from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from llm_helpers import prose, spark_rows, sql_rows

from voltfleet.llm import infilling, maxscore, prefix_trie

# ---- exact top-k search

FOUND = ["query_id", "rank", "vec_id", "score"]


def plain_top(vectors, queries, k, scale):
    """Best of each query row by plain sums; vectors: (id, list)."""
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in whole:
        if q is None or q not in queries:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i) for i, w in whole if i != q)  # noqa: B905
        out.extend((q, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k]))
    return sorted(out, key=repr)


def vector_table(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string, cell int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def test_top_k_on_odd_vectors(spark, tmp_path):
    draw = random.Random(4)
    rows = [(k, [draw.gauss(0, 0.2) for _ in range(16)]) for k in range(160)]
    rows += [(k, rows[7][1]) for k in range(200, 260)]  # ties
    rows += [(300, None), (301, [None] * 16), (302, [float("nan")] * 16), (303, [float("inf")] + [0.0] * 15), (350, []), (351, [1.0]), (352, [2e7] * 16), (400, [-3e9] * 16)]
    rows += [(100, rows[3][1]), (450, rows[9][1]), (450, rows[9][1]), (None, rows[50][1]), (None, [0.0] * 16)]
    folder = vector_table(spark, tmp_path, [(*r, "x", 1) for r in rows])
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = spark_rows(maxscore.op11_exact_top_k(spark, folder), FOUND)
    assert got == plain_top(as_float, {i for i, _ in rows if i is not None and i % 50 == 0}, 5, 256)


def test_top_k_equals_sql_on_the_given_vectors(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT {', '.join(FOUND)} FROM ({maxscore.ORACLE})").fetchall(), key=repr)
    assert spark_rows(maxscore.op11_exact_top_k(spark, "/root/testdata/sf0.01"), FOUND) == want


def test_top_k_of_no_rows_and_few_rows(spark, tmp_path):
    empty = vector_table(spark, tmp_path / "a", [])
    assert spark_rows(maxscore.op11_exact_top_k(spark, empty)) == []
    few = vector_table(spark, tmp_path / "b", [(0, [1.0], "x", 1), (1, [2.0], "x", 1), (2, [-1.0], "x", 1)])
    assert spark_rows(maxscore.op11_exact_top_k(spark, few), FOUND) == [(0, 1, 1, 131072), (0, 2, 2, -65536)]


def test_maxscore_leaves_work_out_and_is_exact():
    draw = np.random.default_rng(3)
    v = np.floor(256 * draw.normal(0, 1, (9000, 24)) * (0.5 ** np.arange(24)))
    ids, own = np.arange(9000), np.arange(0, 9000, 500)
    best, stats = maxscore.Best(len(own), 5), {}
    for at in range(0, 9000, 3000):
        maxscore.search_shard(best, np.arange(len(own)), own, v[own], ids[at : at + 3000], v[at : at + 3000], stats)
    whole = v[own] @ v.T
    whole[np.arange(len(own)), own] = -np.inf
    order = np.lexsort((np.broadcast_to(ids, whole.shape), -whole), axis=1)[:, :5]
    assert (best.ids == order).all()
    assert stats["essential"] + stats["probes"] < 0.5 * stats["pairs"] * 24


def test_sums_beyond_doubles_are_exact():
    q = np.array([[2.0**40 + 1, 1.0, 3.0]])
    v = np.array([[2.0**40 + 3, k, 5.0] for k in range(12)])
    best = maxscore.Best(1, 5)
    maxscore.search_shard(best, np.arange(1), np.array([99]), q, np.arange(12), v)
    assert best.ids[0].tolist() == [11, 10, 9, 8, 7]
    assert best.score[0].tolist() == [(2**40 + 1) * (2**40 + 3) + k + 15 for k in (11, 10, 9, 8, 7)]


# ---- fill in the middle

CUT = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


@pytest.mark.parametrize("table", ["odd", "empty", "given"])
def test_infilling_equals_sql(spark, odd_dir, empty_dir, table):
    folder = {"odd": odd_dir, "empty": empty_dir, "given": "/root/testdata/sf0.01"}[table]
    assert spark_rows(infilling.op12_fill_in_middle(spark, folder), CUT) == sql_rows(folder, infilling.ORACLE, CUT)


def test_infilling_rotates_and_restores():
    assert bytes(rotated(bytearray(b"0123456789"), 2, 5, 9)) == b"0156782349"
    texts = [b"", b" ", b"a", b" a b ", "é ü 😀 x\ty".encode(), b"<P> is a mark", b"a <S", b"> b <", b"\x00 \x1f b", prose(1, 300).encode(), b"x" * 3_000_000 + b" y" * 70_000]
    forms = set()
    for k, text in enumerate(texts):
        for seed in range(6):
            n, form, out, prefix, middle = infilling.transform(text, k, seed, 80, 50)
            assert infilling.restore(out, form) == text
            forms.add(form)
            if form != "plain":
                assert len(out) == len(text) + 9 and prefix + middle <= len(text.decode())
    assert forms == {"plain", "spm", "psm"}


def rotated(block, *cuts):
    infilling.rotate(block, *cuts)
    return block


def test_units_across_blocks_of_the_scan():
    text = (b"ab " * 400_000) + b"\n\n"
    ends = infilling.unit_ends(text)
    assert len(ends) == 400_001 and ends[:2].tolist() == [2, 5] and ends[-1] == len(text)


def test_transform_keeps_columns_and_restores_texts(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    made = infilling.restored(infilling.with_infilling(docs))
    assert made.columns[: len(docs.columns)] == docs.columns
    assert all((r.text or "") == r.fim_restored for r in made.select("text", "fim_restored").collect())


# ---- prefix trie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """Nodes by plain Python. rows: conv_id, turn, role, text."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    leaves, saved, children = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, who in members.items():
        if node:
            children[node[:-1]] += 1
        for d in range(len(node) + 1):
            leaves[node[:d]] += all(len(made[c]) == len(node) for c in who)
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(made[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, k0 string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def odd_talk():
    draw, rows = random.Random(5), []
    for c in range(60):
        for t in range(draw.randrange(1, 12)):
            rows.append((c, t, ("user", "assistant")[t % 2], f"turn {t} {draw.choice('ab')}"))
    rows += [(c, t, "user", "same") for c in range(100, 130) for t in range(5)]
    rows += [(200, None, None, None), (200, 1, "u", "x"), (200, 1, "u", "x"), (200, 1, "u", "y"), (201, 0, "", ""), (203, 0, None, "é😀"), (None, 0, "u", "x"), (-7, 0, "u", "x"), (-5, 0, "u", "z")]
    rows += [(c, t, "u", f"long {t}") for c in (300, 301, 302) for t in range(70 + c % 7)]
    return rows


@pytest.mark.parametrize("most", [3, 4096])
def test_trie_equals_plain_python(spark, tmp_path, most):
    rows = odd_talk()
    folder = talk(spark, tmp_path, rows)
    conv = prefix_trie.F.col("conv_id")
    found, _ = prefix_trie.pieces(spark.read.parquet(f"{folder}/conversations.parquet"), most=most)
    paths = prefix_trie.rebuilt(found, prefix_trie.F.crc32(conv.cast("string")) % 9, conv - conv % 5, 8)
    assert spark_rows(prefix_trie.trie(paths), NODE) == plain_trie(rows)


def test_trie_equals_sql(spark, tmp_path):
    for folder in (talk(spark, tmp_path / "odd", odd_talk()), talk(spark, tmp_path / "empty", []), "/root/testdata/sf0.01"):
        con = duckdb.connect()
        path = f"{folder}/conversations.parquet" + ("" if folder.startswith("/root/testdata") else "/*.parquet")
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}'")
        want = sorted(con.execute(f"SELECT {', '.join(NODE)} FROM ({prefix_trie.ORACLE})").fetchall(), key=repr)
        assert spark_rows(prefix_trie.op13_prefix_trie(spark, folder), NODE) == want


def test_one_long_conversation_lies_in_many_pieces(spark, tmp_path):
    rows = [(5, t, "u", f"t{t}") for t in range(3000)] + [(6, t, "u", f"t{t}") for t in range(2990)]
    folder = talk(spark, tmp_path, rows)
    found, _ = prefix_trie.pieces(spark.read.parquet(f"{folder}/conversations.parquet"), most=64)
    assert found.count() > 90 and found.agg(prefix_trie.F.max("n")).first()[0] == 64
    conv = prefix_trie.F.col("conv_id")
    nodes = prefix_trie.trie(prefix_trie.rebuilt(found, prefix_trie.F.crc32(conv.cast("string")) % 9, conv - conv % 5, 8))
    want = {(n, x) for n, x in ((5, 3000), (6, 2990))}
    assert {(r.conv_id, r.depth) for r in nodes.filter("n_children = 0").collect()} <= want | {(5, 2990)}
    root = nodes.filter("depth = 0").first()
    assert (root.n_convs, root.n_leaves, root.saved_tokens) == (2, 1, sum(len(f"t{t}") for t in range(2990)))


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = np.random.default_rng(1).integers(0, 2**64, (5000, 2), np.uint64)
    table = prefix_trie.PerfectHash(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    assert (table.slots(keys ^ np.uint64(1)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.PerfectHash(np.concatenate([keys, keys[:1]]))

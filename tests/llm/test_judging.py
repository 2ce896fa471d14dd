from __future__ import annotations

import zlib

import duckdb
import numpy as np
import pytest
from llm_helpers import prose, rows, spark_rows, sql_rows
from pyspark.sql import functions as F

from voltfleet.llm import language_id, mixing, quality_rules, toxicity, url_filters

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def read(sql: str) -> list[tuple]:
    return duckdb.connect().sql(sql).fetchall()


@pytest.fixture(scope="module")
def network():
    docs = read(f"SELECT doc_id, text, lang FROM '{MIDDLE}/documents.parquet' ORDER BY doc_id LIMIT 3000")
    pieces, seen = [], {}
    for doc_id, text, lang in docs:
        if not held_out(doc_id) and seen.setdefault(lang, 0) < 120:
            seen[lang] += 1
            pieces += [(lang, text[at : at + 160].encode()) for at in (0, len(text) // 2)]
    return language_id.fit(pieces), docs


def test_languages_of_unseen_texts(network):
    net, docs = network
    unseen = [d for d in docs if held_out(d[0])][:400]
    found = language_id.probabilities(net, [d[1].encode() for d in unseen])
    right = [net.labels[p.argmax()] == d[2] for p, d in zip(found, unseen, strict=True)]
    assert np.mean(right) > 0.98
    assert np.allclose(found.sum(axis=1), 1, atol=1e-3)


def test_every_byte_counts_once(network):
    """Pooling over windows equals a plain loop over each window's bytes."""
    net, docs = network
    for text in (docs[0][1][:300], "kurz", docs[5][1][:97]):
        data = text.encode()
        filled = data if len(data) >= 96 else (data * 96)[:96]
        sums, done = np.zeros(len(net.labels)), 0
        for at in range(0, len(filled), 96):
            begin = min(at, len(filled) - 96)
            window = np.frombuffer(filled, np.uint8, 96, begin)[:, None]
            states = [language_id._forward(net, side, window[:: 1 - 2 * side]) for side in (0, 1)]
            for t in range(96):
                if at - begin <= t and begin + t < len(data):
                    both = np.concatenate([states[0][t + 1][0], states[1][96 - t][0]])
                    sums += language_id._softmax(net.out @ both + net.bias)[:, 0]
                    done += 1
        assert done == len(data)
        assert np.allclose(language_id.probabilities(net, [data])[0], sums / len(data), atol=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language_id.Network(["a", "b"], *(rng.normal(0, 0.5, s) for s in ((2, 24, 256), (2, 24, 8), (2, 16), (2, 1))))
    text, label = rng.integers(0, 5, (6, 3)).astype(np.uint8), np.array([0, 1, 1])

    def loss() -> float:
        runs = [language_id._forward(net, 0, text), language_id._forward(net, 1, text[::-1])]
        both = [np.concatenate([runs[0][t + 1][0], runs[1][6 - t][0]]) for t in range(6)]
        return -float(np.mean([np.log(language_id._softmax(net.out @ b + net.bias)[label, range(3)]) for b in both]))

    for weights, grad in zip((net.byte, net.state, net.out, net.bias), language_id._gradients(net, text, label), strict=True):
        for at in [tuple(rng.integers(0, n) if n != 256 else rng.integers(0, 5) for n in weights.shape) for _ in range(5)]:
            old = weights[at]
            weights[at] = old + 1e-4
            high = loss()
            weights[at] = old - 1e-4
            low = loss()
            weights[at] = old
            assert abs((high - low) / 2e-4 - grad[at]) < 1e-4


def test_op2_odd_rows(spark, odd_dir, empty_dir):
    got = language_id.op2_language_id(spark, odd_dir).collect()
    texts = {r[0]: r[1] for r in rows()}
    assert len(got) == len(rows())
    for r in got:
        assert r.held_out == held_out("null" if r.doc_id is None else r.doc_id) and 0 <= r.score <= 1
        text = texts.get(r.doc_id)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
    assert language_id.op2_language_id(spark, empty_dir).count() == 0


def test_op3_matches_sql(spark, odd_dir, empty_dir):
    for folder in (SMALL, odd_dir):
        got = url_filters.op3_url_filters(spark, folder)
        assert spark_rows(got) == sql_rows(folder, url_filters.ORACLE, got.columns)
    assert url_filters.op3_url_filters(spark, empty_dir).count() == 0


def test_rules_and_the_model_for_the_rest(spark):
    urls = [f"http://shop{k}.com/catalog/{k}" for k in range(60)] + [f"http://ads{k}.net/fr/zzqx{k}" for k in range(60)]
    urls += ["http://news.org/catalog/7", "http://more.org/zzqx/zzqx", "http://example.com/en/", "http://www.example.com/en/a", "http://example.community/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.url: (r.rule, r.verdict) for r in url_filters.judge(df).collect()}
    assert got["http://example.com/en/"] == ("example.com/en/", "block")
    assert got["http://www.example.com/en/a"] == ("www.example.com/en/", "allow")
    assert got["http://example.community/en/"][0] is None
    assert got["http://news.org/catalog/7"] == (None, "allow")
    assert got["http://more.org/zzqx/zzqx"] == (None, "block")


def test_base_counts_match_sql(spark, odd_dir, empty_dir):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality_rules.op7_quality_rules(spark, SMALL)
    assert spark_rows(got, columns) == sql_rows(SMALL, quality_rules.BASE_SQL, columns)
    once = [r for r in rows() if r[0] not in (None, 112, 113)]
    df = spark.createDataFrame([(r[0], r[1], "x") for r in once], "doc_id bigint, text string, n_words string")
    got = {r.doc_id: r for r in quality_rules.with_quality(df, None).collect()}
    for doc_id, text, *_ in once:
        words = (text or "").encode().split()
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        cover = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(grams) < 500 else None
        assert got[doc_id].n_words == len(words)
        assert cover is None or got[doc_id].n_repeat_words == len(cover)
    assert quality_rules.op7_quality_rules(spark, odd_dir).count() == len(rows())
    assert quality_rules.op7_quality_rules(spark, empty_dir).count() == 0


def example(text: str):
    lines, again, _ = quality_rules.lines_of(text)
    return [quality_rules.features(*x) for x in zip(lines, again, strict=True)]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    field = quality_rules.Field(rng.normal(0, 1, (2, quality_rules.FEATURES)), rng.normal(0, 1, (2, 2)))
    for size in (1, 2, 7):
        lines = [tuple(rng.choice(quality_rules.FEATURES, 3, replace=False).tolist()) for _ in range(size)]

        def value(path):
            own = sum(field.emit[y, list(x)].sum() for x, y in zip(lines, path, strict=True))  # noqa: B023
            return own + sum(field.turn[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max((tuple((n >> k) & 1 for k in range(size)) for n in range(2**size)), key=value)
        assert tuple(field.decode(lines)) == best


def test_quality_of_unseen_documents():
    sql = f"SELECT d.doc_id, text, quality FROM '{MIDDLE}/documents.parquet' d JOIN '{MIDDLE}/labels.parquet' l USING (doc_id) ORDER BY 1"
    docs = read(sql)
    whole = [(example(t), 0 if q else 1) for d, t, q in docs if not held_out(d)][:1500]
    size = quality_rules.STRETCH
    known = [(lines[k : k + size], y) for lines, y in whole for k in range(0, len(lines), size)]
    field = quality_rules.fit(known)
    good, bad = [], []
    for d, t, q in docs:
        if held_out(d):
            lines, again, _ = quality_rules.lines_of(t)
            (good if q else bad).append(quality_rules.content_share(field, lines, again) >= quality_rules.LEAST_SHARE)
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    assert quality_rules.fit([]) is None


def test_pages_of_both_kinds_teach_the_turns(spark):
    """Good pages with a long footer, longer than a stretch of training: the footer is learned although it never comes first,
    and a mixed page is marked line by line."""
    text = "The river rises slowly in the hills and runs down to the sea."
    foot = "| HOME | SHOP | $$ |"
    good = "\n".join([f"{text} Part {k} follows." for k in range(70)] + [f"{foot} {k}" for k in range(6)])
    bad = "\n".join([f"{foot} {k}" for k in range(70)])
    docs = spark.createDataFrame([(d, good if d % 2 else bad) for d in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(60)], "doc_id long, quality int")
    field = quality_rules.train(docs, labels)
    marks = field.decode(example(good))
    assert marks == [0] * 70 + [1] * 6
    assert field.decode(example(bad)) == [1] * 70
    assert quality_rules.train(docs.limit(0), labels) is None


def test_toxicity_of_unseen_documents():
    sql = f"SELECT d.doc_id, text, toxic FROM '{MIDDLE}/documents.parquet' d JOIN '{MIDDLE}/labels.parquet' l USING (doc_id) ORDER BY 1"
    docs = read(sql)

    def terms(text):
        return np.unique(toxicity.texts_terms([text])[1])

    machine = toxicity.fit([(terms(t), y) for d, t, y in docs if not held_out(d)])
    unseen = [(t, y) for d, t, y in docs if held_out(d)]
    flagged = toxicity.scores(machine, [t for t, _ in unseen]) >= toxicity.LIMIT
    label = np.array([y for _, y in unseen])
    assert flagged[label == 1].mean() > 0.65 and flagged[label == 0].mean() < 0.01


def test_pairs_of_terms_are_learned():
    """Neither word alone is toxic, both together are."""
    rng = np.random.default_rng(8)
    noise = [f"w{k}" for k in range(200)]
    docs = []
    for _ in range(1500):
        a, b = (rng.random(2) < 0.4).tolist()
        docs.append((" ".join([*rng.choice(noise, 12), *["insult"] * a, *["group"] * b]), int(a and b)))
    machine = toxicity.fit([(np.unique(toxicity.texts_terms([t])[1]), y) for t, y in docs[:1000]])
    got = toxicity.scores(machine, ["w1 insult", "w2 group", "w3 insult group", None])
    assert got[2] > 0.7 and got[0] < 0.5 and got[1] < 0.5 and got[3] < 0.5
    assert toxicity.fit([(np.zeros(0, np.uint64), 0)]) is None


def test_pairs_among_many_terms_are_learned():
    """Tens of thousands of terms; toxic are a slur and a pair of words that each stand as often in toxic texts as in others."""
    rng = np.random.default_rng(9)
    docs = []
    for _ in range(6000):
        a, b = rng.random() < 0.3, rng.random() < 0.3
        slur = not (a or b) and rng.random() < 0.43
        words = [f"w{k}" for k in (40_000 * rng.random(30) ** 1.5).astype(int)]
        docs.append((" ".join([*words, *["these"] * a, *["people"] * b, *["slur"] * slur]), int(a and b or slur), a + 2 * b + 4 * slur))
    terms = [np.unique(toxicity.texts_terms([t])[1]) for t, _, _ in docs]
    assert len(np.unique(np.concatenate(terms[:4000]))) > 20_000
    kind = np.array([k for _, _, k in docs])
    label = np.array([y for _, y, _ in docs])
    assert all(abs(label[(kind & w) > 0].mean() - label.mean()) < 0.06 for w in (1, 2))
    machine = toxicity.fit([(t, y) for t, (_, y, _) in zip(terms[:4000], docs[:4000], strict=True)])
    flagged = toxicity.scores(machine, [t for t, _, _ in docs[4000:]]) >= toxicity.LIMIT
    rates = {k: flagged[kind[4000:] == k].mean() for k in (0, 1, 2, 3, 4)}
    assert rates[3] > 0.8 and rates[4] > 0.9 and max(rates[0], rates[1], rates[2]) < 0.05, rates


def test_op8_odd_rows(spark, odd_dir, empty_dir):
    got = toxicity.op8_toxicity(spark, odd_dir).collect()
    assert len(got) == len(rows())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.op8_toxicity(spark, empty_dir).count() == 0


def test_op9_matches_sql(spark, odd_dir, empty_dir):
    for folder in (SMALL, odd_dir):
        got = mixing.op9_mixing(spark, folder)
        assert spark_rows(got) == sql_rows(folder, mixing.ORACLE, got.columns)
    assert mixing.op9_mixing(spark, empty_dir).count() == 0


def test_targets_are_met_and_documents_repeat(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sized = mixing.sizes(docs)
    mixed = mixing.mix(sized, mixing.targets(sized))
    by_source = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()
    assert all(r.taken == int(r.target) <= 2 * r.size for r in by_source)
    total = sum(r.size for r in by_source)
    assert abs(sum(r.target for r in by_source) - 1.5 * total) < 1e-3
    assert mixed.filter("taken > 2 * size").count() == 0
    out = mixing.mixed_documents(docs)
    words = {r[0]: r[1] for r in mixing.sizes(out).groupBy("source").agg(F.sum("size")).collect()}
    assert out.columns == docs.columns and words == {r.source: r.taken for r in by_source if r.taken}


def test_shares_of_full_sources_go_to_the_others(spark):
    docs = [(k, prose(k, 10 if k < 3 else 100), "abcd"[k % 4]) for k in range(40)]
    df = mixing.sizes(spark.createDataFrame(docs, "doc_id bigint, text string, source string"))
    got = {r.mix_source: r for r in mixing.targets(df).collect()}
    left, weights = 1.5 * sum(r.source_size for r in got.values()), dict(zip("abcd", (3, 1, 2, 3), strict=True))
    open_, want = dict(weights), {}
    while open_:
        full = [s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * got[s].source_size]
        if not full:
            want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in full:
            want[s] = 2 * got[s].source_size
            open_.pop(s)
        left = 1.5 * sum(r.source_size for r in got.values()) - sum(want.values())
    assert {s: round(r.target, 6) for s, r in got.items()} == {s: round(t, 6) for s, t in want.items()}

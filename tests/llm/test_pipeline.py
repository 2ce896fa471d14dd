from __future__ import annotations

import hashlib
import zlib

import corpus_pipeline
import numpy as np
from test_duplicates import brute_groups, brute_removed

from voltfleet.llm import bpe, common, language_id

SMALL = "/root/testdata/sf0.001"


def test_each_stage_does_its_work_on_all_its_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, SMALL), name)
        kept[name] = (before.collect(), docs.collect())
        assert name == "best_fit_packing" or docs.columns == columns

    before, after = kept["language_id"]
    judged = language_id.with_language(spark.createDataFrame(before), language_id.train(spark.createDataFrame(before))).collect()
    assert {r.doc_id for r in after} == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= language_id.LEAST_SCORE}
    assert len(after) >= 0.97 * len(before)

    before, after = kept["ngram_jaccard_join"]
    assert sorted(r.doc_id for r in after) == sorted({g for _, _, g in brute_groups([(r.doc_id, r.text) for r in before])})

    before, after = kept["suffix_array_dedup"]
    want = brute_removed([(r.doc_id, r.text) for r in before])
    for r in after:
        text = r.text.encode()
        assert len(text) <= want[r.doc_id][0] - want[r.doc_id][1]
        if text.isascii() and want[r.doc_id][1] == 0:
            assert hashlib.sha256(text).hexdigest() == want[r.doc_id][3]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert all(want[d][0] - want[d][1] < 100 for d in gone)

    before, after = kept["mixing"]
    words = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) < 50

    before, after = kept["best_fit_packing"]
    path = bpe.tokenizer_path("word_bpe_49k.json")
    ids = [np.append(i, 0).astype("<u4") for i in bpe.encode_texts(path, [r.text for r in before])]
    want = sorted(zlib.crc32(i[at : at + 2048].tobytes()) for i in ids for at in range(0, len(i), 2048))
    assert sorted(r.ids_crc32 for r in after) == want
    assert len({r.sequence_id for r in after}) <= -(-sum(map(len, ids)) // 2048) + 2


def test_an_empty_table_goes_through(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_odd_rows_go_through(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, odd_dir), name)
    assert docs.count() > 20

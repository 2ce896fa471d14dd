from __future__ import annotations

import pytest
from llm_helpers import CLASHES, rows


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """A folder of tables with odd rows and columns whose names operators use themselves."""
    return _tables(spark, tmp_path_factory.mktemp("odd"), rows())


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return _tables(spark, tmp_path_factory.mktemp("empty"), [])


def _tables(spark, folder, docs) -> str:
    clash = (None,) * 10
    schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"
    spark.createDataFrame([(*r, len(r[1] or ""), *clash) for r in docs], schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], k % 2, k % 5 == 0 and 1 or 0, "x") for k, r in enumerate(docs)] + ([(None, 1, 1, "x"), (0, None, None, "x"), (0, 1, 1, "x")] if docs else [])
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, score string").write.parquet(f"{folder}/labels.parquet")
    urls = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.COM/en/x?q=1#a", "http://example.com/en/1", "http://a.b.net/es/", "ftp://x.net/fr"]
    urls += [f"http://h{k}.{'com' if k % 2 else 'example.com'}/{'en' if k % 3 else 'de'}/{k}" for k in range(40)] + ["http://z.org/é/ü?x", "http://z.org?/en/", "a://b://c/d"]
    pages = [(k, u, None, "h", "p", "v") for k, u in enumerate(urls)] + [(None, urls[5], None, "h", "p", "v"), (3, urls[3], None, "h", "p", "v")] if docs else []
    spark.createDataFrame(pages, "page_id bigint, url string, html string, host string, path string, verdict string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)

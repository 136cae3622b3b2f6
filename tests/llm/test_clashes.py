"""Columns of the caller that have the names of helper columns stay what they are."""

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontaminate, lines, quality, simhash, vectors, webpages

NAMES = ["id", "of", "gone", "row", "own", "whole", "sig", "hit", "_id", "_sig", "_hit", "_turn", "turn", "_text_", "raw", "a.b",
         "label", "n", "no", "words", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "alpha beta gamma delta epsilon\nsame line of five words"), (2, "same line of five words\nzeta"), (3, None),
             (4, ""), (5, "one two three four five six seven eight nine ten eleven twelve thirteen"),
             (6, "alpha beta gamma delta epsilon\nsame line of five words"), (7, "alpha beta gamma delta epsilon\nsame line of five words")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    return rows.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in NAMES])


def _kept(df, docs):
    assert df.columns[:len(docs.columns)] == docs.columns
    rows = df.collect()
    for r in rows:
        assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES)
    return {r.doc_id: r.text for r in rows}


def test_columns_survive(spark, docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")],
                                  "item_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert _kept(lines.dedup_lines(docs), docs)[2] == "zeta"
    assert set(_kept(decontaminate.decontaminate(docs, items), docs)) == {1, 2, 3, 4, 6, 7}
    assert _kept(decontaminate.decontaminate(docs, items, remove="spans"), docs)[5] == ""
    assert len(_kept(quality.classify(docs, labels), docs)) == 7
    # NULL and empty texts share the zero fingerprint; the three equal texts are one group.
    assert set(_kept(simhash.one_per_group(docs), docs)) == {1, 2, 3, 5}


def test_vectors_keep_their_digits_and_labels(spark):
    rows = [(1, [1e300, 0.0], "a"), (2, [1e300, 0.0], "a"), (3, [1e300, 1e297], "a"), (4, [1e300, 0.0], "b"),
            (5, [1e-300, 0.0], "b"), (6, [1.0, 0.203058], "c"), (7, [1.0, 0.0], "c"), (8, [1.0, 0.203059], "d"), (9, [1.0, 0.0], "d")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (0, 9)}


def test_templates_need_a_share_of_the_host(spark):
    def page(i):
        twice = "<p>Yes.</p>" if i < 5 else ""
        box = "<div><p>Ask your dealer today.</p></div>" if i % 2 else ""
        return (f"<html><body><div><p>Top of the site</p></div><article><p>Text number {i} of many.</p>{twice}{box}"
                f"</article><div><p>Rare {i // 5}</p></div></body></html>")
    pages = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(200)], "page_id long, url string, html string")
    for r in webpages.extract_text(pages).collect():
        assert r.text == f"Text number {r.page_id} of many." + (" Yes." if r.page_id < 5 else "")
    # By arithmetic: what stands on five of a million pages is no template, in or out of an article.
    assert 5 < webpages.TEMPLATE_SHARE * 1_000_000 and webpages.TEMPLATE_SHARE < webpages.INNER_SHARE

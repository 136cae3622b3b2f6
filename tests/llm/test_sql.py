"""Registered queries with SQL against DuckDB over the same files, and their edge cases."""

import duckdb
import pytest

from fleetlens.llm import decontaminate, lines, substrings, vectors
from fleetlens.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "benchmark")


def _duck(**views):
    con = duckdb.connect()
    for name, source in views.items():
        con.execute(f"create view {name} as select * from {source}")
    return con


def _equal(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    order = [relation.columns.index(c) for c in df.columns]
    expected = [tuple(r[i] for i in order) for r in relation.fetchall()]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir):
    con = _duck(**{t: f"'{sf_dir}/{t}.parquet'" for t in TABLES})
    _equal(QUERIES[name](spark, sf_dir), con.sql(ORACLES[name]))


PASSAGE = " ".join(f"w{i}" for i in range(60))
DOCS = [(1, "a b c\nq r s t u\n\n " + PASSAGE), (2, PASSAGE), (3, None), (4, ""), (5, " \n\t\n"),
        (6, "pre " * 7 + PASSAGE + " post" * 40), (7, "q r s t u\nq r s t\nq r s t u v"),
        (8, "x " * 400), (9, "x " * 400), (10, PASSAGE[:100] + "\n" + PASSAGE), (11, "É" * 9000)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(*d, 5, "clash", 0, "ab"[d[0] % 2] if d[0] % 3 else None, "é" if d[0] % 4 else None, d[0])
                                  for d in DOCS], "doc_id long, text string, sig int, at string, n long, source string, "
                                 "lang string, n_chars long")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    items = [(1, "W3 w4; W5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (2, "q R"), (3, None), (4, "..."),
             (5, "q r"), (6, "É" * 9000)]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(
        f"{folder}/benchmark.parquet")
    vecs = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.3], 1), (5, None, 1),
            (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [1.0, 0.0], None),
            (10, [1.0, 0.0], 2), (11, [1.0, 0.0], 2), (12, [1.0, 0.0, 0.0], 1), (13, [], 1),
            (14, [float("inf"), 0.0], 1), (15, [-0.0, 1.0], 1), (16, [0.0, 1.0], 1)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(
        f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_odd_rows(name, spark, odd):
    con = _duck(**{t: f"'{odd}/{t}.parquet/*.parquet'" for t in TABLES})
    _equal(QUERIES[name](spark, odd), con.sql(ORACLES[name]))


def test_empty_tables(spark, odd):
    docs, items, vecs = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark", "embeddings"))
    none = docs.filter("false")
    assert lines.dedup_lines(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert vectors.near_vectors(vecs.filter("false")).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.filter("false")).collect())


def test_null_and_repeated_ids(spark):
    rows = [(None, PASSAGE), (None, PASSAGE), (3, PASSAGE), (3, PASSAGE), (3, "other\nother"), (9, PASSAGE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.remove_repeats(docs).collect())
    assert cut == [("3", 2, 0), ("3", 60, 0), ("3", 60, 0), ("9", 60, 60), ("None", 60, 0), ("None", 60, 0)]
    kept = sorted((str(r.doc_id), r.n_removed) for r in lines.dedup_lines(docs).collect())
    assert kept == [("3", 1), ("3", 1), ("3", 1), ("9", 1), ("None", 0), ("None", 0)]


def test_hot_cell_is_dealt_out(spark):
    vecs = spark.createDataFrame([(i, [1.0, i / 1e5, 0.0], 1) for i in range(2500)],
                                 "vec_id long, embedding array<float>, label int")
    found = vectors.near_vectors(vecs)
    assert {(r.n_links, r.component_id) for r in found.collect()} == {(2499, 0)}


def test_spans_are_cut(spark, odd):
    docs, items = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    cut = {r.doc_id: r for r in decontaminate.decontaminate(docs, items, remove="spans").collect()}
    assert cut[7].text == "s t u\ns t\ns t u v" and cut[7].at == "clash"
    assert cut[3].text is None and cut[8].text == "x " * 400
    left = {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()}
    # Of 6, 14 of 107 words are hit, more than a twentieth.
    assert left == {3, 4, 5, 8, 9}

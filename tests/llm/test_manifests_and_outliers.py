"""Quality rules, Merkle manifest and whitening against plain versions, and their odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import merkle, outliers, whitening
from fleetlens.llm.queries import QUERIES


def _table(sf_dir, spark, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Merkle manifest -----------------------------------------------------------------------------

def _leaf(row, text):
    parts = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    joined = b"".join(b"-" if p is None else b"%d:%s" % (len(str(p).encode()), str(p).encode()) for p in parts)
    return hashlib.sha256(joined).hexdigest()


def _hash(digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _climb(digests):
    """All levels of a tree, the leaves first."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([_hash(levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def _path(levels, at):
    steps = []
    for level in levels[:-1]:
        run = level[at - at % 3:at - at % 3 + 3]
        steps.append(("".join(run[:at % 3]), "".join(run[at % 3 + 1:])))
        at //= 3
    return steps


def _manifest(rows, change):
    """Sorted (doc_id, leaf, subroot, root, proof, folded) by plain loops."""
    trees = {}
    for row in rows:
        trees.setdefault(row["source"], []).append((row["doc_id"], _leaf(row, row["text"]), _leaf(row, change(row))))
    sources = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for own in trees.values():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1]))
    built = {s: _climb([t[1] for t in trees[s]]) for s in sources}
    top = _climb([built[s][-1][0] for s in sources])
    out = []
    for i, source in enumerate(sources):
        for at, (doc_id, leaf, cut) in enumerate(trees[source]):
            steps = _path(built[source], at) + _path(top, i)
            own = cut
            for before, after in steps:
                own = _hash([before, own, after])
            out.append((doc_id, leaf, built[source][-1][0], top[-1][0], _hash([b + a for b, a in steps]), own))
    return sorted(out, key=str)


def _cut(row):
    held = zlib.crc32(str(row["doc_id"]).encode()) % 2 if row["doc_id"] is not None else 1
    return row["text"].replace("\n", "") if row["text"] is not None and held == 0 else row["text"]


def _found(docs):
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    leaves = merkle.merkle_manifest(docs, F.coalesce(cut, F.col("text"))).leaves
    got = leaves.select("doc_id", "digest", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256),
                        merkle.fold(F.col("path"), F.coalesce("changed", "digest")))
    return sorted(map(tuple, got.collect()), key=str)


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, lo long, tree string, size int"


@pytest.mark.parametrize("count", [1, 4, 27, 243, 244, 731])
def test_manifest_of_any_size(spark, count):
    docs = spark.createDataFrame([(i, "s", "en", i, f"t\n{i}", 0, "x", 9) for i in range(count)], MERKLE)
    assert _found(docs) == _manifest([r.asDict() for r in docs.collect()], _cut)


def test_manifest_of_odd_rows(spark):
    items = [(7, None, None, None, None), (8, None, "en", 0, ""), (None, "ä", "en", 3, "a\nb"), (None, "ä", "en", 3, "a\nb"),
             (5, "z", "en", 1, "\n"), (5, "z", "en", 1, "\n"), (5, "z", "en", 1, "other"), (3, "", "", 0, "é" * 99_999),
             (-4, "z", "a:b", -1, "-"), (4, "Z", "-", 1, "4:"), *[(100 + i, "hot", "de", i, f"\n{i}") for i in range(300)]]
    docs = spark.createDataFrame([(*i, 1, "clash", 2) for i in items], MERKLE).repartition(3)
    rows = [r.asDict() for r in docs.collect()]
    assert _found(docs) == _manifest(rows, _cut)
    assert _found(docs.filter("false")) == []
    tampered = {r[0]: r[5] == r[3] for r in _found(docs)}
    assert tampered[100 + next(i for i in range(300) if zlib.crc32(str(100 + i).encode()) % 2 == 0)] is False


def test_nodes_cover_intervals(spark):
    docs = spark.createDataFrame([(i, "a" if i < 400 else "b", "en", 1, str(i), 0, "", 0) for i in range(402)], MERKLE)
    nodes = [r.asDict() for r in merkle.merkle_manifest(docs).nodes.collect()]
    own = {(n["source"], n["level"], n["lo"]): n for n in nodes if not n["is_top"]}
    for (source, level, lo), n in own.items():
        assert lo % 3 ** level == 0 and n["hi"] == min(lo + 3 ** level, 400 if source == "a" else 2)
    levels = _climb([_leaf({"doc_id": i, "source": "a", "lang": "en", "n_chars": 1}, str(i)) for i in range(400)])
    for level, digests in enumerate(levels[1:], 1):
        assert [own["a", level, i * 3 ** level]["digest"] for i in range(len(digests))] == digests
    assert [n["digest"] for n in nodes if n["is_top"]] == [_hash([levels[-1][0], own["b", 1, 0]["digest"]])]


# Whitening -----------------------------------------------------------------------------------

def _plain(vectors, components=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    keep = min(components, int((values > 1e-12 * values[0]).sum())) if values[0] > 0 else 0
    return (n, [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, sums)) for r in x],
            centred @ turn[:, :keep] / np.sqrt(values[:keep]), values[:keep] / max(values.sum(), 1e-300))


def _same_whitening(rows, ids, vectors):
    n, deviations, white, shares = _plain(vectors)
    assert len(rows) == white.size
    got = np.full(white.shape, np.nan)
    at = {v: i for i, v in enumerate(ids)}
    for r in rows:
        assert r.n == n and r.deviation == deviations[at[r.vec_id]]
        assert abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-6
        got[at[r.vec_id], r.component - 1] = r.whitened
    sign = np.sign((got * white).sum(0))
    assert np.abs(got * sign - white).max() < 1e-6


def test_whitening_of_the_table(spark, sf_dir):
    table = _table(sf_dir, spark, "embeddings").select("vec_id", "embedding").collect()
    _same_whitening(QUERIES["op13_embedding_whitening"](spark, sf_dir).collect(),
                    [r.vec_id for r in table], [r.embedding for r in table])


def test_rank_one_updates_keep_the_spectrum():
    rng = np.random.default_rng(1)
    for values in (rng.random(12), np.zeros(12), np.repeat([1.0, 2.0, 2.0 + 1e-15], 4), np.r_[np.zeros(6), 10.0 ** np.arange(6)]):
        vectors = np.linalg.qr(rng.standard_normal((12, 12)))[0]
        for update in (rng.standard_normal(12), vectors[:, 3] * 2, np.zeros(12), 1e-9 * rng.standard_normal(12)):
            found, turn = whitening.rank_one(values, vectors, update)
            wanted = (vectors * values) @ vectors.T + np.outer(update, update)
            size = max(np.abs(wanted).max(), 1e-30)
            assert np.abs((turn * found) @ turn.T - wanted).max() < 1e-11 * size
            assert np.abs(turn.T @ turn - np.eye(12)).max() < 1e-11


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, (rng.standard_normal(5) * [9, 3, 1, 0, 1]).tolist(), 1, 2) for i in range(40)]
    odd = [(50, None, 1, 2), (51, [], 1, 2), (52, [1.0, None, 0.0, 0.0, 0.0], 1, 2), (53, [float("nan")] * 5, 1, 2),
           (54, [1.0, float("inf"), 0.0, 0.0, 0.0], 1, 2), (60, [3.0, 4.0], 1, 2)]
    table = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, component int, n long")
    _same_whitening(whitening.whiten(table.repartition(7)).collect(), range(40), [g[1] for g in good])
    pair = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 5.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert [(r.component, round(r.explained, 9), r.n) for r in whitening.whiten(pair).collect()] == [(1, 1.0, 3)] * 3
    assert whitening.whiten(pair.filter("false")).count() == 0
    assert whitening.whiten(pair.filter("vec_id = 3")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n for r in whitening.whiten(huge).collect()} == {1: 2, 2: 2}


# Quality rules -------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    text = text or ""
    words = _WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
            n < 20 or 100 * len(hit) > 30 * n)


def test_base_statistics(spark, sf_dir):
    docs = _table(sf_dir, spark, "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = QUERIES["op11_quality_rules"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:7] == _base(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def _points(rows):
    out = []
    for n, chars, symbols, dup, repeat, lines in rows:
        c = chars + 250
        out.append([round(v * 4096) for v in (math.log(c / (n + 50)), math.asin(math.sqrt(symbols / c)),
                                              math.asin(math.sqrt(dup / (lines + 10))), math.asin(math.sqrt(repeat / (n + 50))))])
    return np.array(out, float)


def _least_determinant(z):
    """Exact concentration steps from the same starts, with sorted distances."""
    floor = np.diag((np.array(outliers.SPREAD) * 4096) ** 2)
    h = math.ceil(len(z) * outliers.SUPPORT)

    def estimate(x, factor=1.0):
        return x.mean(0), np.cov(x.T, bias=True) * factor + floor

    def far(x, at):
        gap = x - at[0]
        return np.einsum("ij,ij->i", gap @ np.linalg.inv(at[1]), gap)
    best = None
    low, middle, high = np.quantile(z, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    for now in (estimate(z), (middle, np.diag(((high - low) / 1.349) ** 2) + floor)):
        for _ in range(30):
            now = estimate(z[np.argsort(far(z, now), kind="stable")[:h]])
        if best is None or np.linalg.det(now[1]) < np.linalg.det(best[1]):
            best = now
    inner = far(z, best) <= outliers.chi2_quantile(outliers.REWEIGHT) * outliers.consistency(outliers.SUPPORT)
    return far(z, estimate(z[inner], outliers.consistency(outliers.REWEIGHT)))


def test_distances_follow_the_least_determinant(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        bad = i % 8 == 0
        words = ["w" * int(k) for k in rng.integers(2, 14 if bad else 9, rng.integers(60, 200))]
        for at in rng.integers(0, len(words), len(words) // 4 if bad else int(rng.integers(0, 3))):
            words[at] += "***" if bad else "&"
        rows.append((i, " ".join(words), "en", None if i < 330 else "small"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(outliers.judge(docs).collect(), key=lambda r: r.doc_id)
    z = _points([(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in got])
    big = _least_determinant(z[:330])
    found = np.array([r.distance for r in got])
    assert np.abs(found[:330] / big - 1).max() < 0.2
    bad = np.arange(400) % 8 == 0
    kept = np.array([r.kept for r in got])
    assert not kept[bad].any() and kept[~bad].mean() > 0.97


def test_small_groups_share_estimates(spark):
    good = [(i, " ".join(f"word{(i * 7 + k) % 97}" for k in range(80 + i % 9)), "en", f"s{i % 40}") for i in range(200)]
    odd = [(900, None, "en", "s1"), (901, "", None, None), (902, " \n ", "xx", "s1"), (903, "few words", "en", "s2"),
           (904, "a b c d e f g h i\n" * 9, "en", "s3"), (905, "### $$$ " * 40 + " ".join(map(str, range(300))), "fr", None),
           (906, "é" * 200_000, "en", "s1"), (900, good[0][1], "en", "s1"), (None, good[0][1], "en", "s1")]
    docs = spark.createDataFrame([(*r, 1, "x", 0.5) for r in good + odd],
                                 "doc_id long, text string, lang string, source string, w int, key string, distance double")
    got = outliers.judge(docs).collect()
    assert len(got) == len(good) + len(odd)
    kept = {(r.doc_id, r.n_words): r.kept for r in got}
    assert all(kept[i, 80 + i % 9] for i in range(200))
    assert kept[900, 80] and kept[None, 80]
    assert not any(kept[k] for k in ((900, 0), (901, 0), (902, 0), (903, 2), (904, 81), (905, 380), (906, 1)))
    assert outliers.judge(docs.filter("false")).count() == 0
    assert outliers.judge(docs.select("doc_id", "text")).count() == len(got)


def test_no_python_in_the_native_plan(spark, sf_dir):
    plan = QUERIES["op11_quality_rules"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

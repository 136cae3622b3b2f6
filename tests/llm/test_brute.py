"""Operators that SQL does not express, against plain code and held-out figures."""

import html
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from fleetlens.llm import common, ppm, quality, simhash, webpages
from fleetlens.llm.queries import QUERIES

UPPER = {c: c + 32 for c in range(65, 91)}


def _components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in linked:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _check_simhash(rows, texts):
    prints = {i: _fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    linked = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = _components(ids, linked)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in rows} == {
        i: (prints[i], roots[i]) for i in ids}


def test_simhash_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    _check_simhash(QUERIES["op7_simhash_near_dedup"](spark, sf_dir).collect(), texts)


def test_simhash_odd_rows(spark):
    docs = spark.createDataFrame([(5, None, 1), (4, "", 1), (6, "one", 2), (7, "One two", 2), (8, "oNE", 3)],
                                 "doc_id long, text string, fp int")
    found = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert found[4] == found[5] == 4 and found[6] == found[8] == 6
    assert simhash.simhash_groups(docs.filter("false")).count() == 0
    nobody = simhash.simhash_groups(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert {r.component_id for r in nobody.collect()} == {None}


def test_near_pairs_are_all_pairs(spark):
    prints = [0, 7, 0xF, -1, -8, 1 << 63 - 1, -(1 << 63), 0x1_0000_0001, 0x3_0000_0001, 0x8000_0000, 0x8000_0003]
    found = simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    expected = {(a, b) for a in prints for b in prints
                if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    assert {(r.a, r.b) for r in found} == expected


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 40)],
                                   [(1, 9), (9, 4), (3, 2), (2, 8), (5, 5)]])
def test_components(spark, edges):
    found = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for row in found:
        groups[row.label].add(row.node)
    roots = _components({n for e in edges for n in e}, edges)
    expected = defaultdict(set)
    for node, root in roots.items():
        expected[root].add(node)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in expected.values() if len(g) > 1}


def _ppm(texts):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    docs = {i: (t or "").encode().translate(lower).split() for i, t in texts.items()}

    def steps(words):
        line = b"\0" * 4 + b" " + b"".join(w + b" " for w in words)
        return [(line[i - 5:i], line[i] if i < len(line) else 256) for i in range(5, len(line) + 1)]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts, trie = Counter(), defaultdict(Counter)
    for i, words in docs.items():
        if not held[i]:
            counts.update([*words, None])
            for context, symbol in steps(words):
                for j in range(6):
                    trie[context[j:]][symbol] += 1

    def price(context, symbol):
        total, gone = 0.0, set()
        while context not in trie and context:
            context = context[1:]
        while True:
            left = {s: n for s, n in trie[context].items() if s not in gone}
            mass = sum(left.values())
            if symbol in left:
                return total + math.log10((2 * left[symbol] - 1) / (2 * mass))
            if left:
                total += math.log10(len(left) / (2 * mass))
                gone |= set(left)
            if not context:
                return total - math.log10(257 - len(trie[b""]))
            context = context[1:]
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n,
                sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]),
                sum(price(*s) for s in steps(w))) for i, w in docs.items()}


def _check_ppm(rows, texts):
    expected = _ppm(texts)
    assert len(rows) == len(expected)
    for r in rows:
        e = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:4]
        assert r.base_score == pytest.approx(e[4], rel=1e-9) and r.score == pytest.approx(e[5], rel=1e-9)


def test_ppm_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    _check_ppm(QUERIES["op4_lm_scoring"](spark, sf_dir).collect(), texts)


def test_ppm_odd_rows_joined_and_at_hand(spark, monkeypatch):
    texts = {1: "Ab ab\tAB", 2: None, 3: "", 4: "zz \0 é", 5: "q" * 50, 6: "ab é"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n long")
    _check_ppm(ppm.score_documents(docs).collect(), texts)
    monkeypatch.setattr(ppm, "KEPT_STEPS", 3)
    monkeypatch.setattr(ppm, "KEPT_WORDS", 1)
    _check_ppm(ppm.score_documents(docs).collect(), texts)
    assert ppm.score_documents(docs.filter("false")).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    alone = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    _check_ppm(ppm.score_documents(alone).collect(), dict.fromkeys(held, "a b"))


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 7.0), (2, "", 7.0), (None, "a b", 7.0), (4, "x" * 9999, 7.0)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (4, None)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert [f for f in rows[0].asDict()] == ["doc_id", "text", "score"] and len(rows) == 4
    none = quality.classify(docs, labels.filter("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(docs.filter("false"), labels).count() == 0


def test_quality_sees_words(spark):
    """Texts of equal lengths, case and marks; only the vocabulary tells the labels."""
    good, bad = ("river stone maple cloud tiger ocean".split(), "bonus prize money pills cheap deals".split())
    good = [w.ljust(5, "e")[:5] for w in good]
    bad = [w.ljust(5, "e")[:5] for w in bad]

    def text(n):
        words = bad if n % 2 else good
        return " ".join(words[(n * 7 + k * k * (n // 2 % 5 + 1)) % 6] for k in range(12))
    docs = spark.createDataFrame([(n, text(n)) for n in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = quality.classify(docs, labels).filter(quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 30 and all((r.score >= 0.5) == (r.doc_id % 2 == 0) for r in rows)
    counts, n = quality.document_counts(docs)
    assert n == 300 and counts[zlib.crc32(b"river") % 4096] == sum("river" in text(k) for k in range(300))


def test_pages_query(spark, sf_dir):
    """The test pages hold one article each; all else in them is a side part."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    found = {r.page_id: r for r in QUERIES["op6_html_extraction"](spark, sf_dir).collect()}
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        text = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)
        assert found[page.page_id].text == " ".join(html.unescape(text).split())
        assert found[page.page_id].n_chars == len(found[page.page_id].text)


def test_templates_and_odd_pages(spark):
    def page(n, host="a.example"):
        return (n, f"http://{host}/{n}", "<body><div><p>Same top</p></div><div id=x><p>Own text "
                f"{n}</p></div><div><span>Same end</span></div>", "clash")
    copies = [(90 + n, f"http://b.example/{n}", "<div>All one</div><div>copy</div>", "clash") for n in range(9)]
    odd = [(50, None, None, ""), (51, "http://a.example/", "", ""), (52, "nowhere", "a &lt; b<br>c<p>d", ""),
           (53, "http://a.example/z", "<main>In<script>no</script></main>out<form>no</form>", ""),
           (None, "http://A.example/q", "<div>" * 3000 + "deep", "")]
    pages = spark.createDataFrame([*(page(n) for n in range(6)), page(80, "c.example"), *copies, *odd],
                                  "page_id long, url string, html string, found string")
    found = {r.page_id: r.text for r in webpages.extract_text(pages).collect()}
    assert [found[n] for n in range(6)] == [f"Own text {n}" for n in range(6)]
    assert found[80] == "Same top Own text 80 Same end"
    assert found[90] == "All one copy" and found[50] == found[51] == ""
    assert found[52] == "a < b c d" and found[53] == "In" and found[None] == "deep"
    assert webpages.extract_text(pages.filter("false")).count() == 0


def test_templates_inside_the_article(spark):
    def page(n, host="a.example", box="<div><p>Follow us</p><p>on all networks</p></div>"):
        return (n, f"http://{host}/{n}", f"<body><article><h1>Title {n}</h1><h2>Methods</h2><p>Own text {n}</p>"
                f"<table><tr><td>yes<td>{n}</table>{box}<ul><li>Share<li>Print</ul></article>")

    def near_copy(n):
        same = "".join(f"<p>Paragraph {k} of a long story</p>" for k in range(8))
        return (n, f"http://c.example/{n}", f"<article><p>Edit {n}</p>{same}</article>")
    pages = spark.createDataFrame(
        [*(page(n) for n in range(5)), *(page(10 + n, "b.example") for n in range(4)),
         *(near_copy(20 + n) for n in range(6)),
         (30, "http://a.example/30", "<article><div><p>Follow us</p><p>on all networks</p></div></article>")],
        "page_id long, url string, html string")
    found = {r.page_id: r.text for r in webpages.extract_text(pages).collect()}
    for n in range(5):
        assert found[n] == f"Title {n} Methods Own text {n} yes {n}"
    assert found[10] == "Title 10 Methods Own text 10 yes 10 Follow us on all networks Share Print"
    assert found[20] == " ".join(["Edit 20", *(f"Paragraph {k} of a long story" for k in range(8))])
    assert found[30] == "Follow us on all networks"


@pytest.mark.parametrize("page, text", [
    ("<div class='content has-sidebar'><article>Own</article></div>", "Own"),
    ("<div class='layout no-ads'><article>Own</article><p>out</p></div>", "Own"),
    ("<div id='page' class='with-header'><p>Own</p></div>", "Own"),
    ("<form action='/x'><div><article>Own</article><div class='ad'>x</div></div></form>", "Own"),
    ("<form><p>Own text of an old page</p><nav>menu</nav></form>", "Own text of an old page"),
    ("<div class='share-layout'><div class='search'><article>Own</article></div></div>", "Own"),
    ("<header><h1>Site</h1><article>Own</article>", "Own"),
    ("<div class='ad'><article>One</article></div><div class='promo'><article>Two</article></div>", "One Two"),
    ("<article><div class='entry-header'><h1>Title</h1></div><p>Own</p></article>", "Title Own"),
    ("<article><section class='related-work'><p>Others</p></section><p>Own</p></article>", "Others Own"),
    ("<article>Own text<div class='related-posts'>x</div><form>y</form></article>", "Own text"),
    ("<article>Own text of it</article><div class='comments'><article>No</article></div>", "Own text of it"),
    ("<article>One</article><div class='search'><article>Two</article></div>", "One Two"),
    ("<article>Own text</article><div hidden><article>Gone</article></div>", "Own text")])
def test_hints_lose_no_article(page, text):
    assert webpages.main_text(webpages.parse(page), set()) == text


def test_pipeline_stages(spark, sf_dir):
    """Each stage's decisions, recomputed from its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for number, (name, apply) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.stage(apply(spark, docs, sf_dir), f"test-{number}")
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and len(after) == docs.count()
        if number < 4:
            assert docs.columns == columns
        if number == 0:
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
            good = {r.doc_id for r in labels if r.quality == 1} & set(before)
            assert len(good & set(after)) >= 0.95 * len(good)
        if number == 1:
            assert set(after) == set(before)
            assert all(r.n_chars == len(r.text) <= len(before[i].text) for i, r in after.items())
        if number == 2:
            prints = {i: _fingerprint(r.text) for i, r in before.items()}
            linked = [(a, b) for a in prints for b in prints
                      if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
            assert set(after) == set(_components(prints, linked).values())
        if number == 3:
            assert all(after[i] == before[i] for i in after)
    assert set(after) == set(before)


def test_near_dedup_tells_rows_of_one_id_apart(spark):
    a, b, c, d, e = (" ".join(f"{k}{n}" for n in range(30)) for k in "abcde")
    rows = [(1, a), (1, b), (2, c), (5, c), (5, d), (7, e), (7, e), (9, b), (None, "x y z"), (None, "x y z"), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", n) for n, (i, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs.repartition(3), "")
    assert kept.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in kept.collect())
    assert found == Counter([(1, a), (1, b), (2, c), (5, d), (7, e), (None, "x y z"), (None, "x y z")])
    first = {r.n_chars for r in kept.collect() if r.doc_id == 7}
    again = corpus_pipeline.near_dedup(spark, docs.orderBy(F.desc("n_chars")).repartition(2), "")
    assert first == {r.n_chars for r in again.collect() if r.doc_id == 7}


def test_pipeline_runs_on_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (None, "a b\na b", None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for name, table in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id long, quality int")),
                        ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 2


def test_ppm_rare_steps_are_at_hand_while_there_is_room(spark, monkeypatch):
    texts = {2: "z" * 2000, 3: "abc def ghi"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    staged = {}
    monkeypatch.setattr(ppm, "stage", lambda df, name: staged.setdefault(name, common.stage(df, name)))
    monkeypatch.setattr(ppm, "KEPT_STEPS", 50)
    monkeypatch.setattr(ppm, "KEPT_WORDS", 50)
    _check_ppm(ppm.score_documents(docs).collect(), texts)
    assert staged["parts"].filter("is_step is not null").count() == 0
    monkeypatch.setattr(ppm, "_SCORED_AT_ONCE", 1)
    monkeypatch.setattr(ppm, "KEPT_STEPS", 1)
    _check_ppm(ppm.score_documents(docs).collect(), texts)
    counted = spark.createDataFrame([(i, n) for i, n in enumerate([9, 9, 5, 1, 1, 1])], "key long, n long")
    assert [ppm._commonest(counted, most).count() for most in (0, 1, 2, 3, 5, 6, 9)] == [0, 0, 2, 3, 3, 6, 6]
    assert ppm._commonest(counted.filter("false"), 9).count() == 0

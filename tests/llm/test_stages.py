"""Every stage of the pipeline, judged on its own input, against plain versions; and the vote."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import quality, vocab
from fleetlens.llm.queries import ORACLES


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """(input, output) of each stage as lists of rows, and the folders of the inputs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for number, (_, apply) in enumerate(corpus_pipeline.STAGES):
        folder = str(tmp_path_factory.mktemp("stage") / f"{number}")
        docs.coalesce(1).write.parquet(folder)
        before = spark.read.parquet(folder)
        after = apply(spark, before, sf_dir)
        out.append((folder, [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]))
        docs = after
    return out


def _duck(folder, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/*.parquet'")
    con.execute(f"create view benchmark as select * from '{os.path.join(sf_dir, 'benchmark.parquet')}'")
    return con


def _by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_quality_stage_drops_what_the_vote_rejects(spark, sf_dir, stages):
    _, before, after = stages[0]
    docs = spark.read.parquet(stages[0][0])
    scores = {r.doc_id: r.score for r in quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert _by_id(after) == {i: r for i, r in _by_id(before).items() if scores[i] >= quality.THRESHOLD}


def test_line_stage(sf_dir, stages):
    folder, before, after = stages[1]
    wanted = {r[0]: r[1] for r in _duck(folder, sf_dir).sql(
        f"select doc_id, kept_sha256 from ({ORACLES['op2_line_dedup']})").fetchall()}
    assert {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in after} == wanted
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None)
    first = _by_id(before)
    assert all(r[c] == first[r["doc_id"]][c] for r in after for c in ("source", "lang"))


def test_decontamination_stage(sf_dir, stages):
    folder, before, after = stages[3]
    dirty = {r[0] for r in _duck(folder, sf_dir).sql(
        f"select doc_id from ({ORACLES['op5_benchmark_decontamination']}) where contaminated").fetchall()}
    assert _by_id(after) == {i: r for i, r in _by_id(before).items() if i not in dirty}


def test_token_stage(stages):
    _, before, after = stages[4]
    library = Tokenizer.from_file(vocab.BYTE_BPE)
    found = _by_id(after)
    assert len(after) == len(before)
    for row in before:
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        got = found[row["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_vote_by_brute_force(spark, sf_dir):
    """Weights, space, cosines and votes computed anew, with an exact decomposition."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    seen = labels.filter(~quality.held_out(F.col("doc_id"))).collect()
    taught = [(r.doc_id, r.quality) for r in seen if r.doc_id in texts]
    terms = np.stack([quality.term_weights(texts[i]) for i, _ in taught])
    kind = np.array([q for _, q in taught], float)
    holding = Counter(w for raw in texts.values() for w in quality._word_counts(raw))
    weights = np.full(quality.TERMS, 0.5)
    weights[:quality._SHAPES] = 1 + np.log((1 + len(terms)) / (1 + (terms[:, :quality._SHAPES] > 0).sum(0)))
    weights[quality._FORM:] = 1 + np.log((1 + len(texts)) / (1 + np.array([holding[k] for k in range(quality._WORDS)])))

    def weighed(rows):
        out = rows * weights
        words = out[:, quality._FORM:]
        words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-12)
        return out
    space = np.linalg.svd(weighed(terms), full_matrices=False)[2][:quality.DIMENSIONS].T

    def placed(rows):
        latent = weighed(rows) @ space
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    voters = placed(terms)
    model = quality.fit(docs, labels)
    energy = ((weighed(terms) @ model.projection.astype(float)) ** 2).sum() / ((weighed(terms) @ space) ** 2).sum()
    assert energy > 0.995
    ids = sorted(texts)
    products = placed(np.stack([quality.term_weights(texts[i]) for i in ids])) @ voters.T
    top = np.argsort(-products, axis=1)[:, :quality.NEIGHBOURS]
    weight = np.maximum(np.take_along_axis(products, top, 1), 0) ** quality.SHARPNESS
    wanted = (weight * kind[top]).sum(1) / weight.sum(1)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    found = np.array([got[i] for i in ids])
    assert np.mean(np.abs(found - wanted) < 0.1) > 0.95
    assert np.mean((found >= quality.THRESHOLD) == (wanted >= quality.THRESHOLD)) > 0.99

"""BPE round trip and token files against the tokenizers library; the perfect hash alone."""

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import bpe, tokenfile, vocab
from fleetlens.llm.perfect_hash import Index, keys_of, pack_index
from fleetlens.llm.queries import QUERIES

ODD = ["a    b", "<|endoftext|> x<|EndOfText|>", "don't  \n\n x\t y ", "  ", "\x1c\x1d a",
       "Σας ΣΑΣ İstanbul", "é café e ́x \U0001f600 漢字 かな", "", None, "x" * 30000,
       "I'LL 123abc!!! ...\n\n\n", "a \n <|endoftext|>  b\x85 c", "   x²y, ab's 'tis", "a    b"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 4 else None, t, "clash", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, block int")


def _library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_round_trip_equals_library(odd):
    library = _library(vocab.BYTE_BPE)
    coded = bpe.encode(odd, decoded=True).collect()
    assert len(coded) == len(ODD)
    for row in coded:
        text = ODD[row.doc_id if row.doc_id is not None else 4]
        assert row.ids == _ids(library, text)
        assert row.decoded == library.decode(row.ids, skip_special_tokens=False)


def test_decode_spells_ids(odd):
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd)).collect()}
    assert texts[2] == ODD[2] and texts[8] == "" and texts[9] == ODD[9]


def test_op1_query(spark, sf_dir):
    library = _library(vocab.BYTE_BPE)
    found = {r.doc_id: r for r in QUERIES["op1_bpe_round_trip"](spark, sf_dir).collect()}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(documents)
    for doc in documents:
        ids = _ids(library, doc.text)
        row = found[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_tables(spark, odd):
    nothing = odd.filter("false")
    assert bpe.encode(nothing, decoded=True).count() == 0
    files = tokenfile.write_tokens(nothing)
    assert tokenfile.read_tokens(files, nothing).count() == 0


def test_token_files_of_odd_texts(odd):
    library = _library(vocab.WORD_BPE)
    files = tokenfile.write_tokens(odd)
    read = sorted(tokenfile.read_tokens(files, odd).collect(), key=lambda r: r.start)
    order = sorted(range(len(ODD)), key=lambda i: -1 if i == 4 else i)
    start = 0
    for row, number in zip(read, order, strict=True):
        ids = _ids(library, ODD[number]) + [2]
        assert row.payload == np.array(ids, "<u4").tobytes() and row.start == start
        start += len(ids)


def test_repeated_ids_and_unknown_keys(spark):
    docs = spark.createDataFrame([(7, "one two"), (7, "three"), (7, "three")], "doc_id long, text string")
    files = tokenfile.write_tokens(docs)
    assert tokenfile.read_tokens(files, docs).count() == 3
    with pytest.raises(Exception, match="not in the index"):
        tokenfile.read_tokens(files, spark.createDataFrame([(8,)], "doc_id long")).collect()


def test_op9_query(spark, sf_dir):
    library = _library(vocab.WORD_BPE)
    found = {r.doc_id: r for r in QUERIES["op9_token_files"](spark, sf_dir).collect()}
    start = 0
    for doc in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect():
        ids = _ids(library, doc.text) + [2]
        row = found[doc.doc_id]
        assert (row.start, row.n_tokens) == (start, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    ids = np.arange(n) * 3 - 1000
    keys = keys_of(ids, np.zeros(n, int), np.zeros(n, bool))
    index = Index(pack_index(keys, ids % 7 + 1, np.arange(n)))
    shard, row = index.find(keys)
    assert (row == np.arange(n)).all() and (shard == ids % 7 + 1).all()
    assert len(index.entries) == n
    foreign = keys_of(ids + 1, np.zeros(n, int), np.zeros(n, bool))
    assert (index.find(foreign)[0] < 0).mean() > 0.999 if n else True


def test_words_share_texts_and_capital_dotted_i(monkeypatch):
    tokenizer = open(vocab.WORD_BPE, encoding="utf-8").read()
    library = vocab.load(tokenizer)
    words = ["".join(chr(97 + (i * 7 + k * k) % 26) for k in range(2 + i % 9)) + "é" * (i % 3) for i in range(2000)]
    odd = ["İ! aİ?? İ", "Σας! ΣΑΣ. qक़!", "don't!! É.É ÀÉß!!! µª² 1a.b", "", "  ", "a\x1cb　c​!"]
    texts = [" ".join(words), *odd]
    known: dict[str, bytes] = {}
    calls: list[int] = []

    class Counting:
        def encode_batch_fast(self, part, add_special_tokens):
            calls.append(len(part))
            return library.encode_batch_fast(part, add_special_tokens=add_special_tokens)

    vocab._ends(tokenizer)
    monkeypatch.setattr(vocab, "load", lambda text: Counting())
    vocab._encode_into(tokenizer, known, list(dict.fromkeys(words)))
    monkeypatch.undo()
    assert sum(calls) <= 2000 // vocab._IN_A_TEXT + 1
    coded = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [known[w] for w in words] == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(
        words, add_special_tokens=False)]
    assert vocab.payloads(tokenizer, texts) == coded


def test_small_letters_skip_normal_forms_that_do_nothing():
    tokenizer = open(vocab.WORD_BPE, encoding="utf-8").read()
    assert vocab._for_plain(tokenizer).normalizer is None
    texts = ["Été ÇA né. naïve, ÿÿ!", "plain words aa", ""]
    changed = json.loads(tokenizer)
    changed["normalizer"]["normalizers"].append({"type": "Replace", "pattern": {"String": "aa"}, "content": "é"})
    for own in (tokenizer, json.dumps(changed)):
        for kept in vocab._known(own):
            kept.clear()
        assert vocab.payloads(own, texts) == [np.array(e.ids, "<u4").tobytes() for e in vocab.load(own).encode_batch_fast(
            texts, add_special_tokens=False)]


def test_texts_lie_where_they_are_spelled_unless_they_are_no_utf8():
    pieces = pa.array([b"a", "é".encode(), "é".encode()[:1], "é".encode()[1:]], pa.binary())
    for ids, ends, expected in (([0, 1, 2, 3], [0, 2, 2, 4], ["aé", "", "é"]), ([2, 3, 0], [0, 1, 3], ["\ufffd", "\ufffda"]),
                                ([], [0, 0], [""]), ([], [0], [])):
        found = bpe._spelled(pieces, np.array(ids, np.int32), np.array(ends, np.int32))
        assert isinstance(found, pa.Array) and found.to_pylist() == expected


def test_words_of_the_last_texts_stay_when_there_are_too_many(monkeypatch):
    tokenizer = open(vocab.WORD_BPE, encoding="utf-8").read()
    known, cores = vocab._known(tokenizer)
    known.clear(), cores.clear()
    monkeypatch.setattr(vocab, "_KEPT_WORDS", 3)
    for texts in (["one two. Three", "four"], ["two. five!", "six seven"], ["two. SIX"], [""]):
        assert vocab.payloads(tokenizer, texts) == [np.array(e.ids, "<u4").tobytes() for e in vocab.load(tokenizer)
                                                    .encode_batch_fast(texts, add_special_tokens=False)]
        if len(texts) == 2:
            assert set(known) == set(" ".join(texts).split())
    known.clear(), cores.clear()

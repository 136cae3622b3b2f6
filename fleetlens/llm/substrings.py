"""Substring dedup with difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import id_column

WINDOW = 50
PERIOD = 31
#: A perfect difference set modulo 31: every difference of two places is one of its pairs.
COVER = (1, 5, 11, 24, 25, 27)
#: A window of 50 words holds, within its first 31 places, one that is in the cover for both
#: copies, wherever they stand; so many words from there still lie inside the window.
ANCHOR = WINDOW - PERIOD + 1
#: Hashes gathered before equal ones are put together into one row.
_GATHER = 1 << 20

_ANCHOR_PLACE = np.dtype([("doc", "<i8"), ("pos", "<i4")])
_WINDOW_PLACE = np.dtype([("doc", "<i8"), ("sig", "<i4"), ("pos", "<i4")])


def _split(raw: bytes) -> tuple[list[bytes], bytes, np.ndarray, np.ndarray]:
    """The words, the words joined by one space, and where each starts and ends in that."""
    words = raw.split()
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return words, b" ".join(words), np.concatenate(([0], ends[:-1] + 1)), ends


def _hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, places: np.ndarray,
            width: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    spans = zip(starts[places].tolist(), ends[places + width - 1].tolist())
    return np.fromiter((digest(joined[s:e]) for s, e in spans), np.uint64, len(places))


def _gathered(found: list[tuple], kind: np.dtype) -> pa.RecordBatch:
    """One row per hash of the gathered (hashes, doc, [sig,] places): first place, rest packed."""
    hashes = np.concatenate([f[0] for f in found]).view(np.int64)
    places = np.empty(len(hashes), kind)
    at = 0
    for one in found:
        part = places[at:at + len(one[0])]
        at += len(one[0])
        part["doc"], part["pos"] = one[1], one[-1]
        if "sig" in kind.names:
            part["sig"] = one[2]
    order = np.lexsort((places["doc"], hashes))
    hashes, places = hashes[order], places[order]
    first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    last = np.concatenate((first[1:], [len(hashes)]))
    single = last - first == 1
    rest = [None if one else places[a + 1:b].tobytes()
            for one, a, b in zip(single.tolist(), first.tolist(), last.tolist())]
    columns = {"h": pa.array(hashes[first]), "doc": pa.array(places["doc"][first])}
    if "sig" in kind.names:
        columns["sig"] = pa.array(places["sig"][first])
    else:
        columns["top"] = pa.array(places["doc"][last - 1], mask=single)
    return pa.RecordBatch.from_pydict(columns | {"pos": pa.array(places["pos"][first]),
                                                 "rest": pa.array(rest, pa.binary())})


def _flush(rows: Iterator[tuple], kind: np.dtype) -> Iterator[pa.RecordBatch]:
    found, size = [], 0
    for row in rows:
        found.append(row)
        size += len(row[0])
        if size >= _GATHER:
            yield _gathered(found, kind)
            found, size = [], 0
    if found:
        yield _gathered(found, kind)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id"), batch.column("raw")):
                words, joined, starts, ends = _split(raw.as_py())
                if len(words) >= WINDOW:
                    rounds = np.arange(0, len(words), PERIOD)[:, None] + np.array(COVER)
                    places = rounds.ravel()
                    places = places[places <= len(words) - ANCHOR]
                    yield _hashes(joined, starts, ends, places, ANCHOR), doc.as_py(), places
    yield from _flush(rows(), _ANCHOR_PLACE)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for doc, sig, raw, at in zip(*(batch.column(c) for c in ("doc_id", "sig", "raw", "at"))):
                words, joined, starts, ends = _split(raw.as_py())
                count = len(words) - WINDOW + 1
                if count <= 0:
                    continue
                anchors = np.array(at.as_py(), np.int64)
                anchors = anchors[anchors < len(words)]
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, np.maximum(anchors - PERIOD + 1, 0), 1)
                np.add.at(edges, anchors + 1, -1)
                places = np.flatnonzero(np.cumsum(edges)[:count] > 0)
                if len(places):
                    yield (_hashes(joined, starts, ends, places, WINDOW), doc.as_py(), sig.as_py(),
                           places)
    yield from _flush(rows(), _WINDOW_PLACE)


def _shared_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rest = [np.frombuffer(r, _ANCHOR_PLACE) for r in batch.column("rest").to_pylist() if r]
        doc = [batch.column("doc").to_numpy(), *[r["doc"] for r in rest]]
        pos = [batch.column("pos").to_numpy(), *[r["pos"] for r in rest]]
        yield pa.RecordBatch.from_pydict({"doc_id": np.concatenate(doc), "pos": np.concatenate(pos)})


def _later_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        head = np.empty(n, _WINDOW_PLACE)
        for name in ("doc", "sig", "pos"):
            head[name] = batch.column(name).to_numpy()
        low = batch.column("low").to_numpy()
        packed = batch.column("rest").to_pylist()
        rest = [np.frombuffer(r, _WINDOW_PLACE) for r in packed if r]
        counts = [len(r) // _WINDOW_PLACE.itemsize if r else 0 for r in packed]
        places = np.concatenate([head, *rest])
        places = places[places["doc"] > np.concatenate([low, np.repeat(low, counts)])]
        yield pa.RecordBatch.from_pydict({
            "doc_id": np.ascontiguousarray(places["doc"]), "sig": np.ascontiguousarray(places["sig"]),
            "pos": np.ascontiguousarray(places["pos"])})


def _places(sig: pa.Scalar, at: pa.Scalar) -> np.ndarray:
    """Where repeated windows of the text with this hash start."""
    if not at.is_valid:
        return np.array([], np.int64)
    found = at.values
    own = found.field("sig").to_numpy() == sig.as_py()
    return found.field("pos").to_numpy()[own].astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals, removed, kept = [], [], []
        for sig, raw, at in zip(*(batch.column(c) for c in ("sig", "raw", "at"))):
            words = raw.as_py().split()
            totals.append(len(words))
            places = _places(sig, at)
            if len(places):
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, places, 1)
                np.add.at(edges, places + WINDOW, -1)
                keep = np.cumsum(edges)[:-1] == 0
                words = [w for w, k in zip(words, keep.tolist()) if k]
            removed.append(totals[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, text): each row's words without those of repeated passages.

    Words are runs of non-white-space. A word goes if a window of 50 words that covers it
    also starts in a document with a smaller doc_id, as the input stands; ``text`` is what
    stays, joined by one space. NULL and empty texts have no words. Rows with a NULL doc_id stay
    whole and remove nothing elsewhere; rows that repeat an id are one document of several texts.

    Places in the cover (6 of every 31) are hashed with the 20 words that follow; two copies
    of a window always share such an anchor. Only around anchors that stand in two or more
    documents are all windows of 50 words hashed, and each is compared with the smallest
    document that holds it. Equal hashes of a task become one row before the shuffle, so a
    passage that a third of the documents hold is a row per task, not per document. Windows
    are told apart by 64-bit XXH3: a window is taken for another with a chance of one in 10**19
    a pair.
    """
    rows = docs.select(id_column(docs, doc_id),
                       F.coalesce(F.hash(F.col(text).cast("string")), F.lit(0)).alias("sig"),
                       F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    named = rows.filter("doc_id is not null")
    same = Window.partitionBy("h")
    shared = (named.select("doc_id", "raw")
              .mapInArrow(_anchors, "h long, doc long, top long, pos int, rest binary")
              .withColumn("low", F.min("doc").over(same))
              .withColumn("high", F.max(F.coalesce("top", "doc")).over(same))
              .filter("low <> high").select("doc", "pos", "rest")
              .mapInArrow(_shared_places, "doc_id long, pos int")
              .groupBy("doc_id").agg(F.collect_set("pos").alias("at")))
    # Both joins bring the same columns by the same key, so the texts are shuffled once.
    repeats = (named.join(shared, "doc_id").select("doc_id", "sig", "raw", "at")
               .mapInArrow(_windows, "h long, doc long, sig int, pos int, rest binary")
               .withColumn("low", F.min("doc").over(same))
               .filter("low < doc or rest is not null").select("doc", "sig", "pos", "rest", "low")
               .mapInArrow(_later_places, "doc_id long, sig int, pos int")
               .groupBy("doc_id").agg(F.collect_set(F.struct("sig", "pos")).alias("at")))
    parts = named.join(repeats, "doc_id", "left").select("doc_id", "sig", "raw", "at")
    whole = rows.filter("doc_id is null").select(
        "doc_id", "sig", "raw", F.lit(None).cast("array<struct<sig: int, pos: int>>").alias("at"))
    return parts.union(whole).mapInArrow(
        _cut, "doc_id long, n_words long, n_removed long, text string")

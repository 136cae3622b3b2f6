"""Quality classifier: nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that vote, at most: those with the smallest hashes of their ids.
SAMPLE = 8192
#: Neighbours that vote, and the power of the similarity that weights them.
NEIGHBOURS = 25
SHARPNESS = 4
DIMENSIONS = 48
THRESHOLD = 0.3
_SHAPES = 1024
_BINS = 12
_STATISTICS = 8
#: Hashed words stand behind the shapes and statistics.
_FORM = _SHAPES + _STATISTICS * _BINS
_WORDS = 4096
TERMS = _FORM + _WORDS
#: Documents whose products with all voters are computed at a time.
_BLOCK = 256
#: Rounds of the subspace iteration, and directions it carries beside those that are used.
_ROUNDS = 12
_SPARE = 16

_CELL = np.dtype([("at", "<u2"), ("value", "<f4")])

_CLASSES = bytes(
    ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128
    else ord("9") if 48 <= c <= 57 else c for c in range(256))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32
              for c in range(256))
_RUNS = re.compile(rb"x{2,}|X{2,}|9{2,}")
_MARKS = re.compile(rb"([!-/:-@\[-`{-~])\1{2,}")


def _soft_bins(values: list[float]) -> np.ndarray:
    """Each value in [0, 1] spread over the two bins beside it."""
    out = np.zeros((_STATISTICS, _BINS), np.float32)
    place = np.clip(np.array(values), 0, 1) * (_BINS - 1)
    low = np.minimum(place.astype(int), _BINS - 2)
    rows = np.arange(_STATISTICS)
    out[rows, low], out[rows, low + 1] = 1 - (place - low), place - low
    return out.ravel()


def _word_counts(raw: bytes) -> Counter:
    """Counts of the hash bins of a text's words, runs of ASCII letters (without case), digits and
    all characters beyond ASCII."""
    counts: Counter = Counter()
    for word, count in Counter(raw.translate(_FOLD).split()).items():
        counts[zlib.crc32(word) % _WORDS] += count
    return counts


def term_weights(raw: bytes) -> np.ndarray:
    """Terms of a whole text: shapes of its words (case, digits, marks) as the root of their
    share; binned statistics: length, word length, repetition of words, neighbours and
    lines, marks, upper case and digits; and its words, hashed, as the root of their share."""
    out = np.zeros(TERMS, np.float32)
    words = raw.split()
    n = len(words)
    shaped = raw.translate(_CLASSES)
    small = _MARKS.sub(rb"\1\1\1", _RUNS.sub(lambda m: m[0][:1], shaped))
    for shape, count in Counter(small.split()).items():
        out[zlib.crc32(shape) % _SHAPES] += count
    out[:_SHAPES] = np.sqrt(out[:_SHAPES] / max(n, 1))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size = max(sum(map(len, words)), 1)
    upper, digits = shaped.count(b"X"), shaped.count(b"9")
    letters = upper + shaped.count(b"x")
    found = _word_counts(raw)
    if found:
        at = _FORM + np.fromiter(found.keys(), np.int64, len(found))
        out[at] = np.sqrt(np.fromiter(found.values(), np.float32, len(found)) / found.total())
    out[_SHAPES:_FORM] = _soft_bins([
        np.log10(1 + n) / 5, size / max(n, 1) / 20, 1 - len(set(words)) / max(n, 1),
        sum(map(eq, words, words[1:])) / max(n - 1, 1), 1 - len(set(lines)) / max(len(lines), 1),
        (size - letters - digits) / size * 2, upper / max(letters, 1), digits / size * 4])
    return out


@dataclass
class SparseRows:
    """Rows of terms, only what is not zero: the sample is never a whole matrix."""

    ends: np.ndarray
    places: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, packed: list[bytes]) -> SparseRows:
        """Of rows packed by ``pack_terms``."""
        cells = [np.frombuffer(p, _CELL) for p in packed]
        every = np.concatenate(cells) if cells else np.zeros(0, _CELL)
        return cls(np.cumsum([0, *map(len, cells)]), every["at"].copy(), every["value"].copy())

    def __len__(self) -> int:
        return len(self.ends) - 1

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, dense rows), a block at a time."""
        for at in range(0, len(self), _BLOCK):
            ends = self.ends[at:at + _BLOCK + 1]
            out = np.zeros((len(ends) - 1, TERMS), np.float32)
            rows = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            out[rows, self.places[ends[0]:ends[-1]]] = self.values[ends[0]:ends[-1]]
            yield at, out

    def document_counts(self) -> np.ndarray:
        return np.bincount(self.places, minlength=TERMS).astype(float)


def pack_terms(terms: np.ndarray) -> bytes:
    at = np.flatnonzero(terms)
    cells = np.empty(len(at), _CELL)
    cells["at"], cells["value"] = at, terms[at]
    return cells.tobytes()


@dataclass
class Model:
    """Inverse document frequencies, the projection, and the voters' vectors and labels."""

    weights: np.ndarray
    projection: np.ndarray
    voters: np.ndarray
    labels: np.ndarray

    def project(self, terms: np.ndarray) -> np.ndarray:
        latent = weigh(terms, self.weights) @ self.projection
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest voters, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(terms), 0.5)
        near = min(NEIGHBOURS, len(self.labels))
        products = self.project(terms) @ self.voters.T
        top = np.argpartition(products, -near, axis=1)[:, -near:]
        weight = np.maximum(np.take_along_axis(products, top, 1).astype(float), 0) ** SHARPNESS
        total = weight.sum(1)
        share = (weight * self.labels[top]).sum(1) / np.maximum(total, 1e-300)
        return np.where(total > 0, np.clip(share, 0, 1), self.labels.mean())


def weigh(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted terms; those of the words have length 1 together, as the shapes have before."""
    out = terms * weights
    words = out[:, _FORM:]
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-12)
    return out


def _leading(rows: SparseRows, weights: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the weighted rows as columns, by subspace iteration,
    a block of rows at a time; 0 beyond the rank."""
    start = np.random.default_rng(0).standard_normal((TERMS, DIMENSIONS + _SPARE))
    basis = np.linalg.qr(start.astype(np.float32))[0]
    for _ in range(_ROUNDS):
        product = np.zeros_like(basis)
        for _, block in rows.blocks():
            weighed = weigh(block, weights)
            product += weighed.T @ (weighed @ basis)
        basis = np.linalg.qr(product)[0]
    gram = np.zeros((basis.shape[1],) * 2)
    for _, block in rows.blocks():
        image = (weigh(block, weights) @ basis).astype(np.float64)
        gram += image.T @ image
    values, turn = np.linalg.eigh(gram)
    values, turn = values[::-1][:DIMENSIONS], turn[:, ::-1][:, :DIMENSIONS]
    return np.ascontiguousarray(basis @ (turn * (values > 1e-6 * values[0]))).astype(np.float32)


def fit_model(terms: SparseRows, labels: np.ndarray, doc_counts: np.ndarray, n_docs: int) -> Model:
    """Latent-semantic space of the sample: its leading right singular vectors.

    Shapes are weighted by the sample's counts, words by ``doc_counts``, the number of all
    ``n_docs`` documents that hold a word of the bin.
    """
    if not len(labels):
        nothing = np.zeros((0, 0), np.float32)
        return Model(np.ones(TERMS, np.float32), nothing, nothing, labels)
    weights = np.full(TERMS, 0.5, np.float32)
    weights[:_SHAPES] = 1 + np.log((1 + len(terms)) / (1 + terms.document_counts()[:_SHAPES]))
    weights[_FORM:] = 1 + np.log((1 + n_docs) / (1 + doc_counts))
    projection = _leading(terms, weights)
    model = Model(weights, projection, np.zeros((0, DIMENSIONS), np.float32), labels.astype(float))
    model.voters = np.concatenate([model.project(block) for _, block in terms.blocks()])
    return model


def _doc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of documents with a word of each bin; bin -1: of all documents."""
    counts = np.zeros(_WORDS + 1, np.int64)
    for batch in batches:
        for raw in batch.column(0):
            for word in _word_counts(raw.as_py() or b""):
                counts[word] += 1
        counts[-1] += batch.num_rows
    bins = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(np.where(bins == _WORDS, -1, bins).astype(np.int32)),
                           pa.array(counts[bins])], names=["bin", "n"])


def document_counts(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Of all documents: how many hold a word of each bin, and how many there are."""
    parts = docs.select(F.col(text).cast("string").cast("binary").alias("raw")).mapInArrow(
        _doc_counts, "bin int, n long")
    found = {r.bin: r.n for r in parts.groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    return np.array([found.get(k, 0) for k in range(_WORDS)], float), found.get(-1, 0)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [pack_terms(term_weights(raw.as_py())) for raw in batch.column("raw")]
        yield pa.record_batch([batch.column("label"), pa.array(rows, pa.binary())],
                              names=["label", "terms"])


def _scorer(shared: Broadcast) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of the text and the columns to keep."""
        model = shared.value
        for batch in batches:
            raws, scores = batch.column(0).cast(pa.binary()), []
            for at in range(0, batch.num_rows, _BLOCK):
                scores.append(model.score(np.stack([
                    term_weights(raw.as_py() or b"") for raw in raws.slice(at, _BLOCK)])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                names=[*batch.schema.names[1:], "score"])
    return score


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled rows, chosen by the hash of the id.

    Only the text of a row enters, and the document counts of hashed words over all of ``docs``. Ids with labels of both kinds, and NULL labels, teach
    nothing. The sample's bound also bounds what is broadcast and what the driver gathers.
    """
    own = (labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
           .filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
           .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
           .filter("label = other").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "label"))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    chosen = (rows.join(F.broadcast(own), "id")
              .select("id", "label", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
              .mapInArrow(_terms, "label int, terms binary")
              .orderBy(F.xxhash64("terms"), "terms").limit(sample))
    found = chosen.toArrow()
    terms = SparseRows.of(found.column("terms").to_pylist())
    counts, n_docs = document_counts(docs, text) if len(terms) else (np.zeros(_WORDS), 0)
    return fit_model(terms, found.column("label").to_numpy().astype(int), counts, n_docs)


def classify(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with ``score`` behind them.

    ``score`` lies in 0 to 1; higher: good quality likelier. Each whole text becomes a vector in
    the latent space of the labelled sample; its exact cosines with all voters are computed
    in blocks, and the nearest vote, weighted by a power of their cosine. NULL and empty texts
    are scored as texts without words; where no voter is similar the sample's share of label
    1 stands, and without any labels 0.5. A column named ``score`` in ``docs`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id, text))
    stay = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    # Columns travel under numbers, so any name will do.
    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(stay))
    rows = docs.select(F.col(text).cast("string").alias("raw"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(stay)])
    return rows.mapInArrow(_scorer(shared), f"{fields}, score double").toDF(*stay, "score")

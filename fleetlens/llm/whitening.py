"""Embedding whitening by an incremental eigendecomposition."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stage

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64.0, 1_000_000
#: Entries beyond it count as it, so that sums stay whole numbers; far beyond any embedding.
LARGEST = float(1 << 40)
COMPONENTS = 32
#: Spectra that one task merges into one.
FAN_IN = 16
#: Part of the largest eigenvalue up to which an eigenvalue, or a part of an update, counts as zero.
_TINY = 1e-13
#: Halvings of the interval in which a root of the secular equation lies.
_HALVINGS = 52

_STATE = "dims int, turn int, n long, sums binary, values binary, vectors binary"


def _roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - root)) = 0 for rising poles and positive weights.

    One lies behind each pole, before the next; each is held as a pole and the distance to it,
    the nearer of the two, so differences from the poles keep their digits.
    """
    k = len(poles)
    ends = np.append(poles[1:], poles[-1] + weights.sum())
    half = (ends - poles) / 2
    middle = 1 + (weights / (poles - (poles + half)[:, None])).sum(1)
    behind = middle < 0
    behind[-1] = False
    origin = np.where(behind, np.arange(k) + 1, np.arange(k))
    apart = poles[None, :] - poles[origin][:, None]
    low = np.where(behind, -half, 0.0)
    high = np.where(behind, 0.0, half)
    if middle[-1] < 0:
        low[-1], high[-1] = half[-1], 2 * half[-1]
    with np.errstate(divide="ignore"):
        for _ in range(_HALVINGS):
            at = (low + high) / 2
            up = 1 + (weights / (apart - at[:, None])).sum(1) < 0
            low, high = np.where(up, at, low), np.where(up, high, at)
    return origin, (low + high) / 2


def rank_one(values: np.ndarray, vectors: np.ndarray, update: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``vectors diag(values) vectors' + update update'``.

    Deflation: directions without a part in the update stay; of equal eigenvalues all but one are
    turned out of it. The rest follows from the roots of the secular equation. The parts of
    the update are computed anew from the roots, so the vectors stay orthogonal.
    """
    order = np.argsort(values, kind="stable")
    values, vectors = values[order].copy(), vectors[:, order].copy()
    part = vectors.T @ update
    size = max(float(values[-1]), float(update @ update), 1e-300)
    live = np.flatnonzero(np.abs(part) * float(np.linalg.norm(update)) > _TINY * size)
    kept: list[int] = []
    for at in live.tolist():
        if kept and values[at] - values[kept[-1]] <= _TINY * size:
            other = kept[-1]
            length = float(np.hypot(part[other], part[at]))
            cosine, sine = part[at] / length, part[other] / length
            left, right = vectors[:, other].copy(), vectors[:, at].copy()
            vectors[:, other], vectors[:, at] = cosine * left - sine * right, sine * left + cosine * right
            part[other], part[at] = 0.0, length
            kept[-1] = at
        else:
            kept.append(at)
    if not kept:
        return values, vectors
    poles, own = values[kept], part[kept]
    origin, offset = _roots(poles, own * own)
    # gaps[i, j] = root j - pole i
    gaps = (poles[origin] - poles[:, None]) + offset
    gaps = np.where(gaps == 0, np.finfo(float).tiny, gaps)
    logs = np.log(np.abs(gaps))
    apart = poles[None, :] - poles[:, None]
    np.fill_diagonal(apart, 1.0)
    fresh = np.sign(own) * np.exp((logs.sum(1) - np.log(np.abs(apart)).sum(1)) / 2)
    turn = fresh[:, None] / -gaps
    turn /= np.linalg.norm(turn, axis=0)
    vectors[:, kept] = vectors[:, kept] @ turn
    values[kept] = poles[origin] + offset
    return values, vectors


@dataclass
class Spectrum:
    """Number of vectors, their exact sums, and the eigenpairs of their centred scatter."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims, np.int64), np.zeros(dims), np.eye(dims))

    def update(self, rows: list[np.ndarray] | np.ndarray) -> None:
        for row in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, row)

    def join(self, n: int, sums: np.ndarray, scatter: np.ndarray) -> None:
        """Take in ``n`` vectors with these sums and ``scatter`` (its rows' outer products add up to
        their centred scatter): one update a row, and one for the distance of the means."""
        if self.n:
            apart = sums / n - self.sums / self.n
            scatter = np.vstack([scatter, apart * np.sqrt(self.n * n / (self.n + n))])
        self.n, self.sums = self.n + n, self.sums + sums
        self.update(scatter[np.abs(scatter).max(1, initial=0) > 0])

    def add(self, x: np.ndarray) -> None:
        """Take in whole vectors. More vectors than dimensions are first turned onto as many rows
        with the same scatter as there are dimensions."""
        if len(x):
            sums = x.sum(0)
            centred = x - sums / len(x)
            if len(centred) > centred.shape[1]:
                centred = np.linalg.qr(centred, mode="r")
            self.join(len(x), sums, centred)

    def merge(self, other: Spectrum) -> None:
        if other.n:
            self.join(other.n, other.sums, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def pack(self, dims: int, turn: int) -> pa.RecordBatch:
        cells = [pa.array([dims], pa.int32()), pa.array([turn], pa.int32()), pa.array([self.n], pa.int64())]
        cells += [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
                  for a in (self.sums, self.values, self.vectors)]
        return pa.record_batch(cells, names=["dims", "turn", "n", "sums", "values", "vectors"])


def _unpack(row: dict) -> Spectrum:
    dims = row["dims"]
    return Spectrum(row["n"], np.frombuffer(row["sums"], np.int64), np.frombuffer(row["values"], float),
                    np.frombuffer(row["vectors"], float).reshape(dims, dims))


def _vectors(table: DataFrame, vector: str) -> Column:
    """The vectors as they are if their entries are floats or doubles, else as doubles."""
    kind = table.schema[vector].dataType.simpleString()
    return F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")


def usable(vector: Column) -> Column:
    """Whether a vector counts: not NULL, not empty, all entries finite."""
    fine = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def _whole(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per number of dimensions the rows with it and their vectors as whole numbers."""
    column = batch.column("vector")
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    scaled = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    starts = np.cumsum(lengths) - lengths
    out = {}
    for dims in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dims)
        out[dims] = rows, scaled[starts[rows][:, None] + np.arange(dims)]
    return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, Spectrum] = {}
    for batch in batches:
        for dims, (_, x) in _whole(batch).items():
            found.setdefault(dims, Spectrum.empty(dims)).add(x)
    for dims, own in found.items():
        yield own.pack(dims, TaskContext.get().partitionId())


def _merged(table: pa.Table) -> pa.Table:
    parts = sorted(table.to_pylist(), key=lambda r: r["turn"])
    own = _unpack(parts[0])
    for part in parts[1:]:
        own.merge(_unpack(part))
    return pa.Table.from_batches([own.pack(parts[0]["dims"], parts[0]["turn"] // FAN_IN)])


def spectra(rows: DataFrame) -> dict[int, Spectrum]:
    """The spectrum of all vectors of ``rows`` (column ``vector``), per number of dimensions.

    Every task updates a spectrum of its own; spectra meet ``FAN_IN`` at a time until one is
    left. What reaches the driver has the square of the dimensions in numbers.
    """
    parts = stage(rows.mapInArrow(_partial, _STATE), "spectra")
    while True:
        most = parts.agg(F.max("turn")).first()[0]
        parts = stage(parts.groupBy("dims", F.floor(F.col("turn") / FAN_IN).alias("group"))
                      .applyInArrow(lambda _, table: _merged(table), _STATE), "spectra")
        if most is None or most < FAN_IN:
            return {r.dims: _unpack(r.asDict()) for r in parts.collect()}


@dataclass
class Whitener:
    """Fit of the vectors of one number of dimensions: ``turn`` maps what a vector differs from
    the mean by onto the components (falling eigenvalue), ``scale`` is one over the roots of the
    eigenvalues."""

    n: int
    sums: np.ndarray
    turn: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    scale: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - sums in whole numbers, over n: the digits of the mean are not lost."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole) - rest / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.turn * self.scale

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - sums)^2, exact; NULL where 64 bits do not hold it."""
        apart = self.centred(x) * self.n
        if (np.abs(apart).max(initial=0.0) ** 2 * x.shape[1] < float(1 << 62)
                and float(np.abs(x).max(initial=0)) * self.n < float(1 << 62)):
            exact = x * self.n - self.sums
            return pa.array((exact * exact).sum(1), pa.int64())
        sums = [int(s) for s in self.sums]
        total = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
        return pa.array([t if t < 1 << 63 else None for t in total], pa.int64())


def _products(shared: Broadcast, whitened: bool) -> Callable:
    """A task's sums of products: of the turned vectors, or of the whitened ones."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, (_, x) in _whole(batch).items():
                own = shared.value[dims]
                y = own.whiten(x) if whitened else own.centred(x) @ own.turn
                found[dims] = found.get(dims, 0.0) + y.T @ y
        for dims, total in found.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            yield pa.record_batch([pa.array(np.full(total.size, dims), pa.int32()), pa.array(i, pa.int32()),
                                   pa.array(j, pa.int32()), pa.array(total.ravel())], names=["dims", "i", "j", "v"])
    return sums


def _gathered(rows: DataFrame, models: dict[int, Whitener], whitened: bool) -> dict[int, np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast(models)
    added = rows.mapInArrow(_products(shared, whitened), "dims int, i int, j int, v double").groupBy(
        "dims", "i", "j").agg(F.sum("v").alias("v")).collect()
    out = {d: np.zeros((m.turn.shape[1],) * 2) for d, m in models.items()}
    for r in added:
        out[r.dims][r.i, r.j] = r.v / models[r.dims].n
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitener]:
    """Whiteners per number of dimensions, of all vectors of ``rows`` (column ``vector``).

    The incremental spectra are refined by Rayleigh and Ritz: the covariance is gathered anew in
    their own directions, where it is nearly diagonal, and the small matrix that results gives
    the last turn.
    """
    models = {}
    for dims, s in spectra(rows).items():
        turn = np.linalg.qr(s.vectors[:, np.argsort(s.values)[::-1]])[0]
        models[dims] = Whitener(s.n, s.sums, turn, s.values, s.values, s.values)
    for dims, covariance in (_gathered(rows, models, False) if models else {}).items():
        own = models[dims]
        values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
        values, turn = values[::-1], own.turn @ turn[:, ::-1]
        real = int((values > _TINY * max(float(values[0]), 1e-300)).sum())
        keep = min(components, real)
        own.turn, own.eigenvalues = np.ascontiguousarray(turn[:, :keep]), values[:keep]
        own.explained = values[:keep] / values.sum() if keep else values[:0]
        own.scale = 1 / np.sqrt(values[:keep])
    return models


def _whitener(shared: Broadcast) -> Callable:
    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [i for i, name in enumerate(batch.schema.names) if name != "vector"]
            for dims, (rows, x) in _whole(batch).items():
                own = shared.value[dims]
                white = own.whiten(x)
                ends = pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(white.ravel()))
                taken = [batch.column(i).take(pa.array(rows)) for i in rest]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(np.full(len(x), dims), pa.int32()), own.deviations(x), lists],
                    names=[*(batch.schema.names[i] for i in rest), "dims", "deviation", "white"])
    return whiten


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per vector and
    component, components numbered from 1 by falling eigenvalue.

    Vectors that are NULL, empty, or hold NULL or non-finite entries are left out. Entries become
    floor(64 c) + 1000000. Vectors of different lengths are different spaces, each whitened on
    its own. Components without variance (eigenvalue up to 1e-13 of the largest) cannot be
    whitened and have no rows, so one vector alone, or equal vectors, give none. Keys may be
    NULL, repeat, and have any type; other columns are left out. ``deviation`` is NULL where 64
    bits do not hold it; entries beyond 2^40 in size count as 2^40.

    Three scans of the vectors (spectra, refinement, check) and one that whitens; nothing of a
    vector is shuffled, and the models that tasks get have the square of the dimensions.
    """
    spark = table.sparkSession
    column = _vectors(table, vector)
    usable_rows = table.filter(usable(column))
    rows = usable_rows.select(column.alias("vector"))
    models = fit(rows, components)
    errors = {d: float(np.abs(g - np.eye(len(g))).max(initial=0.0))
              for d, g in (_gathered(rows, models, True) if models else {}).items()}
    kind = table.schema[key].dataType.simpleString()
    white = usable_rows.select(F.col(key).alias("key"), column.alias("vector")).mapInArrow(
        _whitener(spark.sparkContext.broadcast(models)),
        f"key {kind}, dims int, deviation long, white array<double>")
    figures = [(d, m.n, errors[d], [float(e) for e in m.explained]) for d, m in models.items()]
    known = spark.createDataFrame(figures, "dims int, n long, identity_error double, shares array<double>")
    return white.join(known, "dims").select(
        F.col("key").alias(key), "n", "deviation", "identity_error", "shares", F.posexplode("white").alias("at", "whitened")).select(
        key, (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.element_at("shares", F.col("at") + 1).alias("explained"), "identity_error")

"""Embedding near-duplicates by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import components, stage

COSINE = 0.98
#: Dimensions of a block, and how many of them cells are cut along (more for larger inputs).
BLOCK = 8
#: Cell width in multiples of a block's radius.
WIDTH = 4
#: Vectors that one cell holds on average before cells are cut along one more dimension.
CELL_ROWS = 256
#: Rows of one cell that are compared in one task; a fuller cell is dealt out in pairs of parts.
PART_ROWS = 2048
_TILE = 512
_SLACK = 1e-9


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation, so no block of dimensions is empty or overfull by layout."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors by a power of two, so that squares neither overflow nor vanish; cosines stay the
    same to the last bit."""
    largest = np.abs(x).max(-1, keepdims=True)
    return np.ldexp(x, -np.frexp(largest)[1])


def blocks(size: int) -> list[tuple[int, int, float]]:
    """(begin, end, squared radius): the whole squared distance, shared by dimensions.

    Unit vectors with a cosine of at least c are at most sqrt(2 - 2 c) apart; were every block
    beyond its share, the sum would be too.
    """
    edges = [*range(0, size, BLOCK), size]
    total = 2 * (1 - COSINE) + _SLACK
    return [(a, b, total * (b - a) / size + _SLACK) for a, b in zip(edges, edges[1:])]


def _cells(dims: int) -> Callable:
    """Each vector under its own cell of every block, and as a guest under the later cells that
    its ball reaches; a pair meets where the later of its two cells is."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [("label", pa.string()), ("size", pa.int32()), ("block", pa.int32()),
                ("cell", pa.list_(pa.int32())), ("guest", pa.bool_()), ("id", pa.int64()),
                ("copies", pa.int64()), ("vector", pa.list_(pa.float64()))]
        for batch in batches:
            out: list[list] = [[] for _ in kind]
            columns = (batch.column(c).to_pylist() for c in ("label", "id", "copies", "vector"))
            for label, vec_id, copies, vector in zip(*columns):
                x = scaled(np.array(vector, float))
                turned = (x / np.linalg.norm(x)) @ rotation_of(len(x))
                for block, (begin, end, budget) in enumerate(blocks(len(x))):
                    radius = math.sqrt(budget)
                    head = turned[begin:min(end, begin + dims)]
                    own = tuple(np.floor(head / (WIDTH * radius)).astype(int).tolist())
                    low = np.floor((head - radius) / (WIDTH * radius)).astype(int).tolist()
                    high = np.floor((head + radius) / (WIDTH * radius)).astype(int).tolist()
                    for cell in product(*(range(a, b + 1) for a, b in zip(low, high))):
                        if cell >= own:
                            row = (label, len(x), block, list(cell), cell != own, vec_id, copies, vector)
                            for column, value in zip(out, row):
                                column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(out, kind)],
                                  names=[name for name, _ in kind])
    rotations: dict[int, np.ndarray] = {}

    def rotation_of(size: int) -> np.ndarray:
        if size not in rotations:
            rotations[size] = rotation(size)
        return rotations[size]
    return spread


def _squares(turned: np.ndarray, other: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Squared distances of rows in a block; the same for a pair in every task, in either order."""
    return ((turned[:, begin:end] - other[:, begin:end]) ** 2).sum(1)


def _links(left: dict, right: dict, block: int, same: bool, turn: np.ndarray) -> tuple:
    """Row numbers of the linked pairs that this block is the first to find."""
    size = left["x"].shape[1]
    every = blocks(size)
    begin, end, budget = every[block]
    found_a, found_b = [], []
    for at in range(0, len(left["id"]), _TILE):
        for to in range(at if same else 0, len(right["id"]), _TILE):
            a, b = left["t"][at:at + _TILE, begin:end], right["t"][to:to + _TILE, begin:end]
            near = (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None] - 2 * a @ b.T <= budget + _SLACK
            near &= ~(left["guest"][at:at + _TILE, None] & right["guest"][None, to:to + _TILE])
            if same and at == to:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = i + at, j + to
            s, t = left["t"][i], right["t"][j]
            good = _squares(s, t, begin, end) <= budget
            for first, last, share in every[:block]:
                good &= _squares(s, t, first, last) > share
            i, j = i[good], j[good]
            cosine = (left["x"][i] * right["x"][j]).sum(1) / (left["norm"][i] * right["norm"][j])
            found_a.append(i[cosine >= COSINE])
            found_b.append(j[cosine >= COSINE])
    nothing = np.array([], int)
    return np.concatenate([nothing, *found_a]), np.concatenate([nothing, *found_b])


def _side(table: pa.Table, turn: np.ndarray) -> dict:
    x = scaled(np.array(table.column("vector").to_pylist(), float))
    norm = np.sqrt((x * x).sum(1))
    return {"id": table.column("id").to_numpy(), "copies": table.column("copies").to_numpy(),
            "guest": table.column("guest").to_numpy(), "x": x, "norm": norm,
            "t": (x / np.linalg.norm(x, axis=1)[:, None]) @ turn}


def _verify(table: pa.Table) -> pa.Table:
    """Per vector: how many rows it links with here, and the smallest id of its local group."""
    size, block = table.column("size")[0].as_py(), table.column("block")[0].as_py()
    turn = rotation(size)
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    part = table.column("part").to_numpy()
    left = _side(table.filter(pa.array(part == low)), turn)
    right = left if low == high else _side(table.filter(pa.array(part == high)), turn)
    i, j = _links(left, right, block, low == high, turn)
    a, b = left["id"][i], right["id"][j]
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    count = np.zeros(len(ids), np.int64)
    p, q = place[:len(a)], place[len(a):]
    np.add.at(count, p, right["copies"][j])
    np.add.at(count, q, left["copies"][i])
    root = np.arange(len(ids))
    while len(p):
        before = root.copy()
        lower = np.minimum(root[p], root[q])
        np.minimum.at(root, p, lower)
        np.minimum.at(root, q, lower)
        root = root[root]
        if (root == before).all():
            break
    return pa.table([pa.array(ids, pa.int64()), pa.array(count), pa.array(ids[root], pa.int64())],
                    names=["id", "links", "root"])


def near_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                 label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``table``.

    Vectors link if their labels are equal and not NULL, their sizes are equal and their cosine
    in double precision is at least 0.98; NULL and zero vectors and those with NULL or
    non-finite parts link with nothing. ``component_id`` is the smallest vec_id over links. Equal
    vectors of a label are one class with its number of copies, and link with each other.
    Labels may have any type with a text form, vectors any numbers; they are compared as doubles.
    Rows with a NULL vec_id link and are counted, but have a NULL component of their own if
    no other is in it.

    Rotated unit vectors are split into blocks of 8 dimensions; a linked pair is within the
    proportional share of the squared distance in one block at least. Each block is joined in
    range by cells along its leading dimensions, a pair is verified exactly by the first block
    that finds it, and links are counted and contracted where they are found, so no pairs
    are written. A cell with many rows is dealt out in pairs of parts.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"),
                        F.col(vector).cast("array<double>").alias("vector"))
    parts = F.transform("vector", lambda v: F.coalesce(
        ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    usable = (F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall(parts, lambda p: p)
              & F.exists("vector", lambda v: v != 0))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn(
        "key", F.when(F.col("usable"), F.transform("vector", lambda v: v + F.lit(0.0))))
    classes = rows.filter("usable").groupBy("label", F.col("key").alias("vector")).agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    largest = max([r[0] for r in classes.groupBy("label").count().select(F.max("count")).collect()
                   if r[0]], default=1)
    dims = min(BLOCK, max(2, math.ceil(math.log(max(largest / CELL_ROWS, 1)) / math.log(3))))
    spread = classes.select("label", "id", "copies", "vector").mapInArrow(
        _cells(dims), "label string, size int, block int, cell array<int>, guest boolean, id long, "
        "copies long, vector array<double>")
    cell = ["label", "size", "block", "cell"]
    full = stage(classes_in_cells(spread, cell), "cells")
    dealt = spread.join(full.withColumnRenamed("rows", "cell_rows"), cell).withColumn(
        "n", F.ceil(F.col("cell_rows") / PART_ROWS).cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    dealt = dealt.select("*", other).withColumn("low", F.least("part", "other")).withColumn(
        "high", F.greatest("part", "other")).drop("other", "n", "cell_rows")
    found = stage(dealt.groupBy(*cell, "low", "high").applyInArrow(
        _verify, "id long, links long, root long"), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    marked = stage(classes.join(labels.withColumnRenamed("node", "id").withColumnRenamed("label", "group"),
                                "id", "left").join(counts, "id", "left").select(
        "label", "vector", "first", F.coalesce("group", "id").alias("group"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "marked")
    roots = marked.groupBy("group").agg(F.min("first").alias("component_id"))
    placed = marked.join(roots, "group").select(
        F.col("label").alias("of"), F.col("vector").alias("key"), "n_links", "component_id")
    alone = rows.filter("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.filter("usable").withColumnRenamed("label", "of").join(placed, ["of", "key"]).select(
        "vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def classes_in_cells(spread: DataFrame, cell: list[str]) -> DataFrame:
    """Rows of each cell that holds a vector of its own and another row; others find no pair."""
    return spread.groupBy(*cell).agg(F.count("*").alias("rows"), F.min("guest").alias("only_guests")).filter(
        "rows > 1 and not only_guests").drop("only_guests")

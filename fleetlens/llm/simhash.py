"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER_ASCII, as_row, components, stage

SHINGLE = 3
SEED = 42
SEGMENT_BITS = 32
#: Two 32-bit segments: 3 differing bits leave one segment with 1 at most.
DISTANCE = 3
#: Shingles counted at a time, so a long text needs no large bit matrix.
_STRIDE = 1 << 15


def _fingerprint(raw: bytes | None) -> int:
    words = raw.translate(LOWER_ASCII).split() if raw else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    spans = zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STRIDE):
        piece = hashes[at:at + _STRIDE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [_fingerprint(raw.as_py()) for raw in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(prints, pa.int64()), *batch.columns[2:]],
                              names=["doc_id", "fp", *batch.schema.names[2:]])


def signature(text: Column) -> Column:
    """A 64-bit hash of the text that tells rows with the same id apart."""
    return F.xxhash64(text.cast("string"))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 signed: bool = False) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each row's whole text as a signed long.

    Words are runs of non-white-space in lower-case (A-Z) text; features are 3-word shingles
    with repeats, hashed by XXH64 with seed 42; a bit is set if over half of them set it. A
    text with fewer words is one shingle; NULL, empty and blank texts have 0. ``signed`` adds
    ``sig``, the row's signature.
    """
    more = [signature(F.col(text)).alias("sig")] if signed else []
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).cast("binary").alias("raw"), *more).mapInArrow(
        _fingerprints, "doc_id long, fp long" + ", sig long" * signed)


def _segment(fp: Column, number: int) -> Column:
    return F.shiftright(fp, SEGMENT_BITS).cast("int") if number else fp.bitwiseAND(
        F.lit(0xFFFFFFFF)).cast("long").bitwiseXOR(F.lit(0x80000000)).__sub__(
        F.lit(0x80000000)).cast("int")


def _ball(key: Column) -> Column:
    """The key and the keys that set one more of its zero bits.

    Of two keys that differ in one bit one has a 0 there, so this half of the ball around
    every key still finds all neighbours.
    """
    flips = [1 << i for i in range(SEGMENT_BITS - 1)] + [-(1 << (SEGMENT_BITS - 1))]
    more = [F.when(key.bitwiseAND(F.lit(f).cast("int")) == 0, key.bitwiseOR(F.lit(f).cast("int")))
            for f in flips]
    return F.array_compact(F.array(key, *more))


def near_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): all pairs a < b of distinct fingerprints ``fp`` that differ in 3 bits or fewer.

    Each fingerprint is stored under both segments and probes the half balls of radius 1
    around both; what a table holds under a probed key is compared in all bits.
    """
    table = F.explode(F.array(*[F.struct(F.lit(n).cast("byte").alias("seg"),
                                         _segment(F.col("fp"), n).alias("key")) for n in (0, 1)]))
    stored = prints.select(F.col("fp").alias("b"), table.alias("s")).select("s.*", "b")
    probes = [prints.select(F.lit(n).cast("byte").alias("seg"),
                            F.explode(_ball(_segment(F.col("fp"), n))).alias("key"),
                            F.col("fp").alias("a")) for n in (0, 1)]
    found = probes[0].union(probes[1]).join(stored, ["seg", "key"]).filter(
        (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   signed: bool = False) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of 3 or fewer differing
    bits. Copies share a fingerprint and enter the join once. Rows with a NULL doc_id keep
    their row and link like others; a component of such rows alone has a NULL component_id.
    Empty input gives no rows. ``signed`` adds ``sig``, the row's signature, and ``label``, which
    is equal for the rows of a component and no others.
    """
    prints = stage(fingerprints(docs, doc_id, text, signed), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(near_pairs(classes.select("fp")))
    marked = stage(classes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left")
                   .select("fp", "first", F.coalesce("label", "fp").alias("label")), "marked")
    roots = marked.groupBy("label").agg(F.min("first").alias("component_id"))
    more = ["label"] if signed else []
    placed = marked.join(roots, "label").select("fp", "component_id", *more)
    return prints.join(placed, "fp").select("doc_id", "fp", "component_id", *["sig"] * signed, *more)


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of links: that with the smallest doc_id.

    Rows are told apart by doc_id and a hash of the text, so rows of other groups that repeat
    the id stay. Of a group's rows with this id those with the smallest hash win, and of copies
    the one with the smallest hash of all columns; of a group of NULL ids alone all stay.
    """
    groups = simhash_groups(docs, doc_id, text, signed=True)
    heads = stage(groups.filter("doc_id = component_id").groupBy("label", F.col("doc_id").alias("id")).agg(
        F.min("sig").alias("of")).select("id", "of"), "heads")
    nobody = stage(groups.filter("component_id is null").select(F.col("sig").alias("of")).distinct(), "nobody")
    rows = docs.select(as_row(docs), F.col(doc_id).cast("long").alias("id"), signature(F.col(text)).alias("of"))
    turn = F.row_number().over(Window.partitionBy("id", "of").orderBy(F.xxhash64("row")))
    kept = rows.filter("id is not null").join(heads, ["id", "of"], "left_semi").withColumn("turn", turn)
    unnamed = rows.filter("id is null").join(nobody, "of", "left_semi")
    return kept.filter("turn = 1").select("row.*").union(unnamed.select("row.*"))

"""What the operators share: staging in the shared folder, whole texts, components."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import ensure_checkpoint_dir

#: ASCII upper case to lower case, for ``bytes.translate``.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    Cuts the lineage, survives lost executors, and gives later joins the true size.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_column(docs: DataFrame, doc_id: str) -> Column:
    """The id as a long named ``doc_id``; the bare column where it is one already, so that equal
    subplans stay equal and their shuffle is reused."""
    column = F.col(doc_id)
    if doc_id == "doc_id" and docs.schema[doc_id].dataType.simpleString() == "bigint":
        return column
    return column.cast("long").alias("doc_id")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and ``sig``, a hash of the text; all other columns go.

    Joins back to documents use (doc_id, sig), NULL-safe: rows that share an id but not
    the text stay apart, and rows equal in both have equal results anyway.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text"),
                       F.coalesce(F.xxhash64(F.col(text).cast("string")), F.lit(0)).alias("sig"))


def as_row(table: DataFrame) -> Column:
    """All columns of ``table`` as one struct, so that none can clash with a helper column;
    ``select("row.*")`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in table.columns]).alias("row")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is (``lower`` is the same for ASCII texts)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): equal labels for nodes that links connect; nodes without links are absent.

    Random contraction: each round every node moves to the smallest of itself and its
    neighbours in a random order (the ids under a fresh XOR mask), and links between
    distinct survivors go on. The node count falls by a constant factor a round, on chains
    too. Minima are pre-aggregated, so a hub is no hot group; links and labels stay on the
    executors, each round's in the shared folder. Order of the labels is arbitrary.
    """
    links = stage(edges.filter(F.col(a) != F.col(b))
                  .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    moves = []
    while not links.isEmpty():
        mask = F.lit(random.Random(len(moves)).getrandbits(64) - (1 << 63)).cast("long")
        both = links.union(links.select("b", "a"))
        move = stage(both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m")).select(
            F.col("a").alias("node"),
            F.least("m", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to")), "moves")
        moves.append(move)
        links = stage(
            links.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
            .join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
            .filter("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = moves[-1].withColumnRenamed("to", "label")
    for move in reversed(moves[:-1]):
        later = labels.select(F.col("node").alias("to"), "label")
        labels = move.join(later, "to", "left").select(
            "node", F.coalesce("label", "to").alias("label"))
    return labels

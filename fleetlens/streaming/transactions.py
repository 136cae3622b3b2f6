"""Transactions out of a stream of log lines.

Each batch is assembled like a stored log, with the open transaction of every file in front. What
is open, and which line numbers a file has sent, are tables with one version per batch: a batch
reads the version before its own and replaces its own, so a batch that is run again gives the
same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators import logs
from fleetlens.session import store
from fleetlens.streaming import versions

# Tables under the folder of a stream.
TRANSACTIONS, LATE, OPEN, SEEN = "transactions", "late", "open", "seen"

_OPEN = """file string, start_line bigint, hash_at bigint, start_pos bigint, map_at bigint,
 start_time timestamp_ntz, n_rows bigint, end_line bigint, end_at bigint, end_pos bigint, end_time timestamp_ntz,
 xid bigint, gtid_at bigint, last_committed bigint, sequence_number bigint"""
_SEEN = "file string, first bigint, last bigint"
_LATE = "file string, line_no bigint, line string"
_TRANSACTIONS = """file string, xid bigint, n_rows bigint, size bigint, secs bigint, start_time timestamp_ntz,
 end_time timestamp_ntz, start_line bigint, end_line bigint, start_pos bigint, end_pos bigint,
 last_committed bigint, sequence_number bigint, is_complete boolean, is_implicit boolean"""


def _line_runs(lines: DataFrame, chunk_lines: int, shares: int) -> DataFrame:
    """(file, first, last) of unbroken line numbers, cut at chunks; only numbers are shuffled."""
    order = Window.partitionBy("file", "chunk").orderBy("line_no")
    numbered = lines.select("file", "line_no", F.floor(F.col("line_no") / chunk_lines).alias("chunk"))
    return logs.dealt_out(numbered, shares, "file", "chunk").withColumn("run", F.col("line_no") - F.dense_rank().over(order)).groupBy(
        "file", "chunk", "run").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last")).select(
        "file", "first", "last")


def _merged_runs(runs: DataFrame) -> DataFrame:
    """Runs that touch or overlap become one; a row per chunk and gap is put in order."""
    before = Window.partitionBy("file").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("first", "last").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    apart = F.coalesce(F.col("first") > F.max("last").over(before) + 1, F.lit(True))
    return runs.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(upto)).groupBy(
        "file", "group").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("file", "first", "last")


def _behind(lines: DataFrame, seen: DataFrame) -> tuple[DataFrame, Column]:
    """``lines`` with ``reached``, the last number of their file so far, and whether they lie
    behind it."""
    reached = seen.groupBy("file").agg(F.max("last").alias("reached"))
    return lines.join(reached, "file", "left"), F.col("line_no") <= F.coalesce("reached", F.lit(-1))


def assemble_batch(batch: DataFrame, batch_id: int, folder: str, mode: str = "strict",
                   chunk_lines: int = logs.ORDER_LINES) -> None:
    """Take in one batch of lines (file, line_no, line) and write its version of all tables.

    Lines may come in any order within the batch. A line that was sent before is passed over. One
    that lies behind the last number its file has reached and was not sent before comes too
    late for its transaction: it goes to the table of late lines, and the stream goes on.
    """
    spark = batch.sparkSession
    lines = batch.select("file", F.col("line_no").cast("bigint").alias("line_no"), "line").persist()
    try:
        shares = logs.shares_of(lines.count())
        seen = store(versions.newest(spark, folder, SEEN, _SEEN, batch_id), "seen")
        waiting = versions.newest(spark, folder, OPEN, _OPEN, batch_id)
        placed, behind = _behind(lines, seen)
        old = placed.filter(behind).select("file", "line_no", "line").alias("l")
        sent = (F.col("l.file") == F.col("s.file")) & F.col("l.line_no").between(F.col("s.first"), F.col("s.last"))
        late = old.join(seen.alias("s"), sent, "left_anti").dropDuplicates(["file", "line_no"])
        versions.write(late, folder, LATE, batch_id)
        marks, behind = _behind(logs.log_marks(lines, mode), seen)
        fresh = marks.filter(~behind).drop("reached")
        parts = logs.cells(fresh, chunk_lines, shares, repeated=True)
        found = store(logs.segments(logs.continued_cells(parts, waiting, shares)), "segments")
        versions.write(logs.closed_segments(found), folder, TRANSACTIONS, batch_id)
        still = found.filter("end_line is null").drop("commit_ord")
        versions.write(still, folder, OPEN, batch_id)
        versions.write(_merged_runs(seen.unionByName(_line_runs(lines, chunk_lines, shares))), folder, SEEN, batch_id)
    finally:
        lines.unpersist()


def stream_transactions(lines: DataFrame, folder: str, checkpoint: str, mode: str = "strict",
                        **trigger) -> StreamingQuery:
    """Start a stream of log lines (file, line_no, line); committed transactions come to
    ``read_transactions(spark, folder)``, late lines to ``read_late_lines``.

    Per file the state is one row of what is open and one row per unbroken run of line numbers. A
    busy file is split by chunks of lines like a stored log. Batches of a file must not step
    back: what a later batch has of earlier numbers is late. Versions before the last two may
    be deleted at any time.
    """
    writer = lines.writeStream.foreachBatch(
        lambda batch, batch_id: assemble_batch(batch, batch_id, folder, mode)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return versions.all_versions(spark, folder, TRANSACTIONS, _TRANSACTIONS).drop("batch")


def read_late_lines(spark: SparkSession, folder: str) -> DataFrame:
    return versions.all_versions(spark, folder, LATE, _LATE).drop("batch")

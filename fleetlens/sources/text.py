"""Text inputs: numbered log lines and configuration files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions import logtext as L
from fleetlens.functions.values import norm_name
from fleetlens.session import shared_folder

#: Line ids that one row of the zone map covers, at most.
ZONE_LINES = 1 << 16


def _zone(line_id: Column) -> Column:
    return F.shiftright(line_id, ZONE_LINES.bit_length() - 1)


@dataclass(frozen=True)
class LandedLog:
    """A log stored once, and the map of its zones.

    ``stored`` is (path, block, line_id, pos, ts, line). Ids rise without gaps through a block of
    a path, and none occurs twice, so row groups hold id ranges and a filter on ``line_id`` reads
    only theirs. ``pos`` and ``ts`` are those of event lines, so events are found without reading
    text. ``zones`` is (file, path, block, zone, first_id, last_id, first_line, last_line, first_pos,
    last_pos, first_ts, last_ts): a zone is the part of a block with equal upper bits of the id.
    Only it knows the log (``file``) of a path.
    """

    stored: DataFrame
    zones: DataFrame

    def number(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with path, block and line_id) with ``file`` and ``line_no`` instead of them."""
        starts = self.zones.select("file", "path", "block", F.col("zone").alias("_zone"), "first_id", "first_line")
        keyed = rows.withColumn("_zone", _zone(F.col("line_id")))
        number = (F.col("line_id") - F.col("first_id") + F.col("first_line")).alias("line_no")
        rest = [c for c in rows.columns if c not in ("path", "block", "line_id")]
        return keyed.join(starts, ["path", "block", "_zone"]).select("file", number, *rest)

    def lines(self) -> DataFrame:
        """(file, line_no, line) of the whole log; the zone map is one row per 65,536 lines, which
        Spark broadcasts where that is small."""
        return self.number(self.stored.select("path", "block", "line_id", "line"))

    def n_lines(self) -> int:
        """How many lines the log has, out of the zone map."""
        return self.zones.agg(F.sum(F.col("last_id") - F.col("first_id") + 1)).first()[0] or 0


def read_landed_log(spark: SparkSession, out: str) -> LandedLog:
    """A log that ``land_log`` stored at ``out``."""
    return LandedLog(spark.read.parquet(f"{out}/lines"), spark.read.parquet(f"{out}/zones"))


def land_log(spark: SparkSession, path: str, out: str,
             name: Callable[[Column], Column] = lambda file: file) -> LandedLog:
    """Store the text files under ``path`` at ``out``, for all later log queries.

    One scan writes every line where it is read, with its path, file block and id; nothing is
    shuffled. The zone map is then made of what is stored, so how files are split into blocks
    later on, or between two passes, does not matter. A line's number is its id minus
    the first of its zone plus the lines of the file's earlier zones; only the zone map is put in order.
    ``name`` turns a path into the name of the log, once per zone; paths of one log are its parts, in
    the order of their names. A compressed file is one block.
    """
    line = F.col("line")
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))
    raw.select("path", "block", "line_id", L.log_position(line).alias("pos"), L.event_ts(line).alias("ts"),
               "line").write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/lines")
    stored = spark.read.parquet(f"{out}/lines")
    zones = stored.groupBy("path", "block", _zone(F.col("line_id")).alias("zone")).agg(
        F.min("line_id").alias("first_id"), F.max("line_id").alias("last_id"),
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn("file", name(F.col("path")))
    upto = Window.partitionBy("file").orderBy("path", "block", "zone").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    own = F.col("last_id") - F.col("first_id") + 1
    placed = zones.withColumn("last_line", F.sum(own).over(upto)).withColumn(
        "first_line", F.col("last_line") - own + 1)
    placed.select("file", "path", "block", "zone", "first_id", "last_id", "first_line", "last_line", "first_pos",
                  "last_pos", "first_ts", "last_ts").write.mode("overwrite").parquet(f"{out}/zones")
    return read_landed_log(spark, out)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as ``(file, line_no, line)``, numbered per file, any file size. The lines are
    stored once in the shared folder (see ``land_log``), so both passes see the same blocks."""
    return land_log(spark, path, shared_folder(spark, "lines")).lines()


def parse_config_lines(lines: DataFrame) -> DataFrame:
    """``name = value`` lines of configuration files; blank lines, comments and section
    headers are dropped, a line without ``=`` has a NULL value, dashes become underscores."""
    text = F.col("line")
    parts = F.split(text, "=", 2)
    value: Column = F.try_element_at(parts, F.lit(2))
    return (lines.filter((F.btrim(text, F.lit(" \t\r")) != "") & ~text.startswith("#")
                         & ~text.startswith("["))
            .withColumn("name", norm_name(F.element_at(parts, 1)))
            .withColumn("value", F.btrim(value, F.lit(" \t\r"))).drop("line"))


def read_config_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, name, value)`` of all configuration files under ``path``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"),
                                         F.col("value").alias("line"))
    return parse_config_lines(lines)

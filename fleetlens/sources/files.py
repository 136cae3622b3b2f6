"""Manifest of files: listed and hashed in tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.session import store

#: Bytes of a file that one task hashes at a time; a larger file is many ranges.
RANGE_BYTES = 64 << 20
_READ = 1 << 20

_LISTED = "file string, size_bytes long, is_folder boolean"


_ADDRESS = re.compile(r"([a-z][a-z0-9+.-]*:)(//[^/]*)?(/.*)?\Z", re.S)


def open_store(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path there; names are taken as they are written."""
    found = _ADDRESS.match(address)
    if not found or found[1] == "file:":
        return fs.LocalFileSystem(), found[3] if found else address
    system, root = fs.FileSystem.from_uri(f"{found[1]}{found[2] or '//'}/")
    return system, root.rstrip("/") + (found[3] or "/")


def _addressed(folder: str, path: str) -> str:
    """The address of a path that was listed in ``folder``."""
    found = _ADDRESS.match(folder)
    if not found:
        return path
    own = open_store(folder)[1]
    root = own[:len(own) - len(found[3] or "/")]
    return found[1] + (found[2] or "") + path[len(root):]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies directly in each folder."""
    for batch in batches:
        for folder in batch.column("file").to_pylist():
            system, path = open_store(folder)
            found = system.get_file_info(fs.FileSelector(path, allow_not_found=False))
            yield pa.record_batch(
                [pa.array([_addressed(folder, f.path) for f in found], pa.string()),
                 pa.array([f.size or 0 for f in found], pa.int64()),
                 pa.array([f.type == fs.FileType.Directory for f in found], pa.bool_())],
                names=["file", "size_bytes", "is_folder"])


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size_bytes) of all files below ``folder``, empty ones too.

    Folders are listed in tasks, a level at a time; every level is stored, and no list passes
    through the driver.
    """
    level = spark.createDataFrame([(folder, 0, True)], _LISTED)
    files = None
    while True:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        listed = store(level.select("file").repartition(parts, "file").mapInArrow(_entries, _LISTED), "listed")
        here = listed.filter("not is_folder").select("file", "size_bytes")
        files = here if files is None else files.unionByName(here)
        level = listed.filter("is_folder")
        if level.isEmpty():
            return files


def _hashed(range_bytes: int) -> Callable:
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                system, path = open_store(name)
                own, left = hashlib.md5(), range_bytes
                with system.open_input_file(path) as file:
                    file.seek(start)
                    while left and (data := file.read(min(left, _READ))):
                        own.update(data)
                        left -= len(data)
                sums.append(own.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())],
                                             names=[*batch.schema.names, "checksum"])
    return ranges


def file_manifest(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, size_bytes, checksum, checksum_of) of every file below ``folder``, of any size.

    A file of up to ``range_bytes`` has the MD5 of its content ("content"). A larger one is hashed
    by ranges of that size, in as many tasks as it takes, and has the MD5 of the ranges' checksums
    in order ("ranges"). Names have the form of ``folder``'s address.
    """
    files = store(list_files(spark, folder), "files")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size_bytes") - 1, F.lit(0)),
                               F.lit(range_bytes).cast("long")))
    ranges = files.select("file", "size_bytes", cut.alias("start")).repartition(parts, "file", "start")
    summed = ranges.mapInArrow(_hashed(range_bytes), "file string, size_bytes long, start long, checksum string")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("start", "checksum"))), lambda r: r["checksum"])
    whole = F.col("size_bytes") <= range_bytes
    return summed.groupBy("file", "size_bytes").agg(ordered.alias("sums")).select(
        "file", "size_bytes",
        F.when(whole, F.col("sums")[0]).otherwise(F.md5(F.array_join("sums", "").cast("binary"))).alias("checksum"),
        F.when(whole, "content").otherwise("ranges").alias("checksum_of"))

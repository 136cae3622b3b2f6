"""Token ids as raw binary shards with a minimal perfect hash index."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import vocab
from fleetlens.llm.common import stage
from fleetlens.llm.perfect_hash import Index, keys_of, pack_index
from fleetlens.session import ensure_checkpoint_dir

END_ID = 2
#: Bytes after which a task begins another shard (a longer document gets one of its own size).
SHARD_BYTES = 32 << 20
#: Keys of one index file.
INDEX_KEYS = 1 << 16
#: Text characters encoded, and payload bytes sent to Spark, at a time.
_AT_ONCE = 4 << 20

_ROWS = "part int, seq int, path string, row int, doc_id long, n_ids long"


@dataclass(frozen=True)
class TokenFiles:
    """What was written: shards in file order, index files by bucket, and the bucket count."""

    shards: DataFrame
    index: DataFrame
    buckets: int


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and the path there."""
    if re.match(r"[a-z][a-z0-9+.-]*:", folder):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return fs.LocalFileSystem(), folder


def _kind(ids: int) -> np.dtype:
    """Two bytes an id where the vocabulary allows, else four."""
    return np.dtype("<u2" if ids <= 1 << 16 else "<u4")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= _AT_ONCE:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _writer(folder: str, tokenizer: Broadcast) -> Callable:
    """Each task writes its range of documents as shards of its own name; only what a finished
    task reports counts, so a repeated or lost attempt leaves an unused file at most."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        kind = _kind(vocab.load(tokenizer.value).get_vocab_size())
        end = np.array([END_ID], kind).tobytes()
        seq, out, name, size, offsets, ids = 0, None, "", 0, [0], []

        def finish() -> pa.RecordBatch:
            out.close()
            with store.open_output_stream(f"{name}.off") as file:
                file.write(np.array([kind.itemsize, *offsets], "<u8").tobytes())
            n = len(ids)
            return pa.record_batch(
                [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()),
                 pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array(ids, pa.int64()),
                 pa.array(np.diff(offsets).astype(np.int64))],
                names=["part", "seq", "path", "row", "doc_id", "n_ids"])

        for doc_ids, texts in _documents(batches):
            for doc_id, payload in zip(doc_ids, vocab.payloads(tokenizer.value, texts)):
                payload = np.frombuffer(payload, "<u4").astype(kind).tobytes()
                if out is not None and size + len(payload) > SHARD_BYTES:
                    yield finish()
                    seq, out = seq + 1, None
                if out is None:
                    name = f"{root}/tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex[:12]}"
                    out, size, offsets, ids = store.open_output_stream(f"{name}.bin"), 0, [0], []
                out.write(payload)
                out.write(end)
                size += len(payload) + len(end)
                offsets.append(size // kind.itemsize)
                ids.append(doc_id)
        if out is not None:
            yield finish()
    return write


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    null = table.column("doc_id").is_null().to_numpy()
    ids = table.column("doc_id").fill_null(0).to_numpy()
    return ids, table.column("copy").to_numpy(), null


def _indexer(folder: str) -> Callable:
    def index(table: pa.Table) -> pa.Table:
        store, root = _open(folder)
        bucket = table.column("bucket")[0].as_py()
        name = f"{root}/index-{bucket:08d}-{uuid.uuid4().hex[:12]}.mph"
        with store.open_output_stream(name) as file:
            file.write(pack_index(keys_of(*_arrays(table)), table.column("shard").to_numpy(),
                                  table.column("row").to_numpy()))
        return pa.table([pa.array([bucket], pa.int32()), pa.array([name])], names=["bucket", "path"])
    return index


def _copies(rows: DataFrame, *order: str) -> DataFrame:
    """With ``copy``: 0, 1, ... among the rows of an id, so keys are distinct."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*(order or ("doc_id",))))
    return rows.withColumn("copy", number - 1)


def _bucket(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int").alias("bucket")


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer: str = vocab.WORD_BPE,
                 shards: int | None = None, doc_id: str = "doc_id",
                 text: str = "text") -> TokenFiles:
    """Encode every whole text, append id 2, and write the ids in ascending doc_id order.

    A shard is ``.bin`` (ids as little-endian unsigned integers of two bytes, of four for
    vocabularies beyond 65,536, and nothing else) and ``.off`` (that width, then where its
    documents begin, in ids, as 64-bit integers). Index files hold a minimal
    perfect hash of (doc_id, copy number) with a 32-bit fingerprint, shard and row per key.
    NULL and empty texts are the end id alone; NULL ids come first; repeated ids are stored
    each, in the order of their texts' hashes. ``shards`` is the number of ranges (default: the
    session's shuffle partitions); a range of over 32 MB becomes several shards.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    count = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                           F.col(text).cast("string").alias("text"))
               .withColumn("sig", F.xxhash64("text"))
               .repartitionByRange(count, "doc_id", "sig").sortWithinPartitions("doc_id", "sig")
               .select("doc_id", "text"))
    rows = stage(ordered.mapInArrow(_writer(folder, vocab.share(spark, tokenizer)), _ROWS), "rows")
    sizes = rows.groupBy("part", "seq", "path").agg(
        F.count("*").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
    files = Window.orderBy("part", "seq")
    table = stage(sizes.select(
        (F.row_number().over(files) - 1).alias("shard"), "path", "n_docs", "n_ids",
        F.coalesce(F.sum("n_ids").over(files.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("first_id")), "shards")
    buckets = max(1, -(-rows.count() // INDEX_KEYS))
    entries = _copies(rows.join(table.select("path", "shard"), "path"), "shard", "row")
    index = stage(entries.select("doc_id", "copy", "shard", "row", _bucket(buckets))
                  .groupBy("bucket").applyInArrow(_indexer(folder), "bucket int, path string"), "index")
    return TokenFiles(table, index, buckets)


def _finder(table: pa.Table) -> pa.Table:
    store, path = _open(table.column("path")[0].as_py())
    with store.open_input_file(path) as file:
        index = Index(file.read())
    shard, row = index.find(keys_of(*_arrays(table)))
    if len(shard) and shard.min() < 0:
        raise KeyError(f"{int((shard < 0).sum())} keys are not in the index")
    return pa.table([table.column("doc_id"), pa.array(shard.astype(np.int32)),
                     pa.array(row.astype(np.int32))], names=["doc_id", "shard", "row"])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (path, row): a shard stays open while its rows last."""
    path, file, offsets, width = None, None, [], 4
    for batch in batches:
        doc_ids, starts, payloads, size, begin = batch.column("doc_id"), [], [], 0, 0
        columns = (batch.column(c).to_pylist() for c in ("path", "row", "first_id"))
        for i, (name, row, first) in enumerate(zip(*columns)):
            if name != path:
                if file is not None:
                    file.close()
                store, place = _open(name)
                with store.open_input_file(f"{place}.off") as table:
                    width, *offsets = np.frombuffer(table.read(), "<u8").tolist()
                path, file = name, store.open_input_file(f"{place}.bin")
            file.seek(width * offsets[row])
            raw = file.read(width * (offsets[row + 1] - offsets[row]))
            payloads.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
            starts.append(first + offsets[row])
            size += len(payloads[-1])
            if size >= _AT_ONCE or i + 1 == batch.num_rows:
                yield pa.record_batch([doc_ids.slice(begin, i + 1 - begin), pa.array(starts, pa.int64()),
                                       pa.array(payloads, pa.binary())],
                                      names=["doc_id", "start", "payload"])
                starts, payloads, size, begin = [], [], 0, i + 1
    if file is not None:
        file.close()


def read_tokens(files: TokenFiles, keys: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, payload) of every row of ``keys``: ids before it in all files, and its ids
    as little-endian unsigned 32-bit integers.

    Keys meet their index file by hash bucket, which gives shard and row in constant time;
    rows then meet by shard and are read at their offsets. The n-th row of an id gets the n-th
    stored copy. A key that is not stored fails the job.
    """
    wanted = _copies(keys.select(F.col(doc_id).cast("long").alias("doc_id"))).select(
        "doc_id", "copy", _bucket(files.buckets))
    found = wanted.join(files.index, "bucket").groupBy("bucket").applyInArrow(
        _finder, "doc_id long, shard int, row int")
    placed = found.join(files.shards.select("shard", "path", "first_id"), "shard")
    return (placed.select("doc_id", "path", "row", "first_id").repartition("path")
            .sortWithinPartitions("path", "row")
            .mapInArrow(_reader, "doc_id long, start long, payload binary"))

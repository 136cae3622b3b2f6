"""BPE encoding and decoding over a table of distinct words."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import vocab

#: Text characters of one block: its words are numbered, sent and joined back together.
BLOCK_CHARS = 32 << 20
#: Distinct words that are encoded in one call.
_WORDS_AT_ONCE = 4096
#: Hash buckets in which words meet; a task holds the distinct words of one bucket at a time.
BUCKETS = 2048

_WORD_ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("seal", pa.string()),
                        ("payload", pa.binary())])
_WORD_DDL = "block long, bucket int, seal string, payload binary"
_DOC_ROWS = pa.schema([("block", pa.int64()), ("is_doc", pa.bool_()), ("doc_id", pa.int64()),
                       ("seal", pa.string()), ("n", pa.int32()), ("numbers", pa.binary())])
_DOC_DDL = "block long, is_doc boolean, doc_id long, seal string, n int, numbers binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
_OUT_DDL = "doc_id long, ids array<int>, decoded string"


class _Numbers(dict):
    """Words numbered in order of appearance, so frequent ones get small numbers."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _pack(numbers: np.ndarray) -> bytes:
    """Byte planes compress far better than whole numbers."""
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(n)


def _pack_parts(parts: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, parts), "<u4", len(parts))
    return zlib.compress(np.array([len(parts)], "<u4").tobytes() + lengths.tobytes() + b"".join(parts), 1)


def _unpack_parts(packed: bytes) -> list[bytes]:
    content = zlib.decompress(packed)
    n = int(np.frombuffer(content, "<u4", 1)[0])
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(content, "<u4", n, 4), dtype=np.int64)).tolist()
    return [content[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _seal(words: dict[str, int]) -> str:
    return f"{len(words)}:{zlib.crc32(chr(0).join(words).encode())}"


def _buckets(spelled: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, spelled), np.uint32, len(spelled)) % BUCKETS


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Numbers, list]]:
    """(block, word numbers, [(doc_id, its words' numbers)]) of each run of rows of a task."""
    block = TaskContext.get().partitionId() << 32
    words, rows, size = _Numbers(), [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            if size and size + len(text) > BLOCK_CHARS:
                yield block, words, rows
                block, words, rows, size = block + 1, _Numbers(), [], 0
            chunks = vocab.CHUNK.findall(text)
            rows.append((doc_id.as_py(), np.fromiter(map(words.__getitem__, chunks), np.uint32,
                                                     len(chunks))))
            size += len(text)
    if rows:
        yield block, words, rows


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, words, _ in _blocks(batches):
        spelled = [w.encode() for w in words]
        found = _buckets(spelled)
        order = np.argsort(found, kind="stable")
        present, starts = np.unique(found[order], return_index=True)
        payloads = [_pack_parts([spelled[i] for i in part.tolist()])
                    for part in np.split(order, starts[1:])] if len(order) else []
        yield pa.record_batch([
            pa.array([block] * len(present), pa.int64()), pa.array(present.astype(np.int32)),
            pa.array([_seal(words)] * len(present), pa.string()), pa.array(payloads, pa.binary())],
            schema=_WORD_ROWS)


def _doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, words, rows in _blocks(batches):
        seal = _seal(words)
        table = zlib.compress(_buckets([w.encode() for w in words]).astype(np.uint16).tobytes(), 1)
        yield pa.record_batch([[block], [False], pa.array([None], pa.int64()), [seal],
                               pa.array([len(words)], pa.int32()), [table]], schema=_DOC_ROWS)
        for at in range(0, len(rows), 1024):
            part = rows[at:at + 1024]
            yield pa.record_batch([
                pa.array([block] * len(part), pa.int64()), pa.array([True] * len(part)),
                pa.array([r[0] for r in part], pa.int64()), pa.array([seal] * len(part)),
                pa.array([len(r[1]) for r in part], pa.int32()),
                pa.array([_pack(r[1]) for r in part], pa.binary())], schema=_DOC_ROWS)


def _encoder(tokenizer: Broadcast) -> Callable:
    """Rows sorted by bucket: each distinct word is encoded once and its ids answer all blocks."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = vocab.load(tokenizer.value)
        bucket, known = None, {}
        for batch in batches:
            answers = []
            for own, payload in zip(batch.column("bucket").to_pylist(), batch.column("payload")):
                if own != bucket:
                    bucket, known = own, {}
                words = _unpack_parts(payload.as_py())
                fresh = [w for w in words if w not in known]
                for at in range(0, len(fresh), _WORDS_AT_ONCE):
                    part = fresh[at:at + _WORDS_AT_ONCE]
                    coded = library.encode_batch_fast([w.decode() for w in part],
                                                      add_special_tokens=False)
                    known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, coded))
                answers.append(_pack_parts([known[w] for w in words]))
            yield pa.record_batch([*batch.columns[:3], pa.array(answers, pa.binary())],
                                  schema=_WORD_ROWS)
    return encode


def _word_ids(answers: pa.Table, buckets: np.ndarray) -> list[bytes]:
    """The ids of every word of a block, by its number."""
    order = np.argsort(buckets, kind="stable").tolist()
    starts = np.searchsorted(buckets[order], np.arange(BUCKETS)).tolist()
    table: list[bytes | None] = [None] * len(buckets)
    for bucket, payload in zip(answers.column("bucket").to_pylist(), answers.column("payload")):
        parts = _unpack_parts(payload.as_py())
        for number, ids in zip(order[starts[bucket]:starts[bucket] + len(parts)], parts):
            table[number] = ids
    if None in table:
        raise ValueError("a block did not get the ids of all its words")
    return table


def _spelled(pieces: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts that runs of ids spell: ids meet the table of pieces by number, and what they
    spell lies one behind the other. Where all of it is UTF-8, that is the result as it lies there."""
    if not len(ids):
        return pa.array([""] * (len(ends) - 1), pa.string())
    joined = pieces.take(pa.array(ids))
    _, offsets, content = joined.buffers()
    starts = np.frombuffer(offsets, np.int32)[joined.offset:joined.offset + len(joined) + 1][ends]
    del joined, offsets
    texts = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), content)
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        raw, bounds = memoryview(content), starts.tolist()
        return pa.array([str(raw[a:b], "utf-8", "replace") for a, b in zip(bounds, bounds[1:])], pa.string())


def _assembler(tokenizer: Broadcast, decoded: bool) -> Callable:
    def assemble(docs: pa.Table, answers: pa.Table) -> pa.Table:
        seals = {*docs.column("seal").to_pylist(), *answers.column("seal").to_pylist()}
        if len(seals) != 1:
            raise ValueError("two reads of the documents differ; write them to files first")
        is_doc = docs.column("is_doc").to_pylist()
        table = zlib.decompress(docs.column("numbers")[is_doc.index(False)].as_py())
        word_ids = _word_ids(answers, np.frombuffer(table, np.uint16))
        rows = docs.filter(docs.column("is_doc"))
        parts, sizes = [], []
        for n, packed in zip(rows.column("n").to_pylist(), rows.column("numbers")):
            own = _unpack(packed.as_py(), n).tolist() if n else []
            parts.append(b"".join(map(word_ids.__getitem__, own)))
            sizes.append(len(parts[-1]) // 4)
        del word_ids
        ends = np.cumsum([0, *sizes]).astype(np.int32)
        flat = np.frombuffer(b"".join(parts), np.int32)
        del parts
        texts = (_spelled(pa.array(vocab.byte_pieces(tokenizer.value), pa.binary()), flat, ends) if decoded
                 else pa.nulls(len(sizes), pa.string()))
        return pa.table([rows.column("doc_id").combine_chunks(),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), texts], schema=_OUT)
    return assemble


def encode(docs: DataFrame, tokenizer: str = vocab.BYTE_BPE, decoded: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): token ids of each row's whole text, and the text they spell.

    Equal to the tokenizers library's encode(text, add_special_tokens=False) and decode(ids,
    skip_special_tokens=False); ``decoded`` is NULL unless asked for, and then needs a
    byte-level vocabulary. NULL and empty texts have no ids and spell "".

    Each task numbers the distinct words (with the white space before them) of a block of
    its rows, and sends them to their hash buckets, packed. In a bucket all blocks' words meet,
    each distinct word of the corpus is encoded once, and its ids go back to every block that
    asked; documents, as packed word numbers, take them by position. Decoding starts from these
    ids, which meet the table of pieces by number. A frequent word is in one
    row a block, so none is hot, and no table of words is sent to all executors. The documents
    are read twice, and both reads must give the same rows in the same order, as files do; a
    seal over each block's words is compared and the job fails if they don't.
    """
    shared = vocab.share(docs.sparkSession, tokenizer)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).cast("string").alias("text"))
    answers = (rows.mapInArrow(_word_rows, _WORD_DDL).repartition("bucket")
               .sortWithinPartitions("bucket").mapInArrow(_encoder(shared), _WORD_DDL))
    numbered = rows.mapInArrow(_doc_rows, _DOC_DDL)
    return numbered.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _assembler(shared, decoded), _OUT_DDL)


def _decoder(tokenizer: Broadcast) -> Callable:
    def decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(vocab.byte_pieces(tokenizer.value), pa.binary())
        for batch in batches:
            runs = [np.array(ids or [], np.int32) for ids in batch.column(1).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            texts = _spelled(pieces, np.concatenate([np.zeros(0, np.int32), *runs]), ends)
            yield pa.record_batch([batch.column(0), texts],
                                  names=["doc_id", "text"])
    return decode_rows


def decode(encoded: DataFrame, tokenizer: str = vocab.BYTE_BPE, doc_id: str = "doc_id",
           ids: str = "ids") -> DataFrame:
    """(doc_id, text): the text that each row's ids spell; NULL and empty lists spell "".

    The id-to-piece table (one row per vocabulary entry, so bounded) is on every executor.
    An id outside the vocabulary fails the job.
    """
    shared = vocab.share(encoded.sparkSession, tokenizer)
    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"),
                          F.col(ids).cast("array<int>").alias("ids")).mapInArrow(
        _decoder(shared), "doc_id long, text string")

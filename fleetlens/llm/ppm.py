"""Language-model scoring by prediction by partial matching over bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import LOWER_ASCII, stage

#: Longest context in bytes. A step is the context (5 bytes) and the symbol in one number.
ORDER = 5
#: Byte values and the end of a document.
ALPHABET = 257
END_SYMBOL = 256
#: So many of the commonest steps and words at most have their prices at hand on every executor
#: (16 bytes a step, 24 a word); all others are joined.
KEPT_STEPS = 1 << 21
KEPT_WORDS = 1 << 18
#: Words whose places a task remembers; full, it starts again, which costs time only.
_MET_WORDS = 200_000
#: Stands for the end of a document in the table of words; no word holds a space.
END = " "
#: Distinct keys gathered in a task before they are handed on, and bytes numbered at a time.
_GATHER = 400_000
_STEPS_AT_ONCE = 1 << 22
#: Bytes and number of the documents that are scored together: what they share is looked up once.
_SCORED_AT_ONCE, _DOCUMENTS_AT_ONCE = 1 << 18, 4096

_SYMBOL_BITS = 9


def held_out(doc_id: Column) -> Column:
    """Rows that the model never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def steps(words: list[bytes]) -> np.ndarray:
    """Every step of a text as context (5 bytes, zero before the start) times 512 plus symbol.

    The text is its words with one space behind each; the end is the last step.
    """
    line = b"\0" * (ORDER - 1) + b" " + b"".join([w + b" " for w in words])
    values = np.frombuffer(line, np.uint8).astype(np.int64)
    count = len(values) - ORDER + 1
    context = np.zeros(count, np.int64)
    for back in range(ORDER):
        context = (context << 8) | values[back:back + count]
    symbol = np.append(values[ORDER:], END_SYMBOL)
    return (context << _SYMBOL_BITS) | symbol


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.record_batch([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for held, raw in zip(batch.column("held").to_pylist(), batch.column("raw")):
            words = raw.as_py().translate(LOWER_ASCII).split()
            if held:
                counts.update(dict.fromkeys(words, 0))
            else:
                counts.update(words)
                counts[END.encode()] += 1
            if len(counts) > _GATHER:
                yield rows()
                counts.clear()
    yield rows()


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([f[0] for f in found])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([f[1] for f in found])[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def _step_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        keys, counts = _merged(found)
        return pa.record_batch([pa.array(keys), pa.array(counts)], names=["step", "n"])

    def number() -> None:
        for held in (False, True):
            if waiting[held]:
                keys, counts = np.unique(np.concatenate(waiting[held]), return_counts=True)
                found.append((keys, np.zeros_like(counts) if held else counts))
                waiting[held].clear()

    found: list = []
    waiting: dict[bool, list] = {False: [], True: []}
    size = 0
    for batch in batches:
        for held, raw in zip(batch.column("held").to_pylist(), batch.column("raw")):
            own = steps(raw.as_py().translate(LOWER_ASCII).split())
            waiting[held].append(own)
            size += len(own)
            if size < _STEPS_AT_ONCE:
                continue
            number()
            size = 0
            if sum(len(f[0]) for f in found) > 4 * _GATHER:
                found = [_merged(found)]
                if len(found[0][0]) > 2 * _GATHER:
                    yield rows()
                    found = []
    number()
    if found:
        yield rows()


def _orders(table: DataFrame, *keep: str) -> DataFrame:
    """Each row once per order, with ``context``: the order and that many last bytes."""
    context = F.expr("transform(sequence(0, %d), j -> shiftleft(cast(j as bigint), 40) | "
                     "(shiftright(step, %d) & (shiftleft(1L, 8 * j) - 1)))" % (ORDER, _SYMBOL_BITS))
    symbol = F.col("step").bitwiseAND(F.lit((1 << _SYMBOL_BITS) - 1))
    return table.select(*keep, symbol.alias("symbol"), F.explode(context).alias("context"))


def trie(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (context, symbol, n) of all orders, and contexts (context, total, kinds, up_total,
    up_kinds).

    A context's ``up_`` figures are those of the next shorter context without the symbols that
    were seen here: what is left to predict from after an escape (symbol exclusion).
    """
    nodes = stage(_orders(seen.filter("n > 0"), "n").groupBy("context", "symbol").agg(
        F.sum("n").alias("n")), "nodes")
    own = nodes.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    order = "shiftright(context, 40)"
    shorter = F.expr(f"""case when {order} > 0 then shiftleft({order} - 1, 40)
        | (context & (shiftleft(1L, cast(8 * ({order} - 1) as int)) - 1)) end""")
    children = nodes.select(F.col("context").alias("child"), shorter.alias("context"), "symbol").filter(
        "context is not null")
    here = (children.join(nodes, ["context", "symbol"]).groupBy("child")
            .agg(F.sum("n").alias("excluded")).withColumnRenamed("child", "context"))
    parents = own.select(F.col("context").alias("parent"), F.col("total").alias("parent_total"),
                         F.col("kinds").alias("parent_kinds"))
    contexts = (own.withColumn("parent", shorter).join(here, "context", "left").join(parents, "parent", "left")
                .select("context", "total", "kinds",
                        (F.col("parent_total") - F.col("excluded")).alias("up_total"),
                        (F.col("parent_kinds") - F.col("kinds")).alias("up_kinds")))
    return nodes, stage(contexts, "contexts")


def prices(seen: DataFrame) -> DataFrame:
    """(step, n, price): log10 probability of each step, by PPM.

    From the longest known context down: a symbol seen there has (2 n - 1) / (2 total), the
    escape kinds / (2 total); after an escape the symbols of the longer context are left
    out. What no context knows shares the rest evenly. Only steps that training never took
    are followed down the orders.
    """
    nodes, contexts = trie(seen)
    longest = F.shiftright("step", _SYMBOL_BITS).bitwiseOR(F.lit(ORDER << 40))
    taken = seen.filter("n > 0").withColumn("context", longest)
    direct = taken.join(contexts.select("context", "total"), "context").select(
        "step", "n", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("price"))
    root = contexts.filter("context = 0").select("kinds").collect()
    unknown = ALPHABET - (root[0].kinds if root else 0)
    levels = (_orders(seen.filter("n = 0"), "step").join(nodes, ["context", "symbol"], "left")
              .join(contexts, "context", "left").groupBy("step").agg(F.collect_list(F.struct(
                  F.shiftright("context", 40).alias("j"), F.col("n").alias("seen"), "total", "kinds",
                  "up_total", "up_kinds")).alias("at")))
    top = F.array_max(F.transform("at", lambda x: F.when(x["total"].isNotNull(), x["j"])))
    best = F.array_max(F.transform("at", lambda x: F.when(x["seen"].isNotNull(), x["j"])))
    levels = (levels.withColumn("top", F.coalesce(top, F.lit(-1)))
              .withColumn("best", F.coalesce(best, F.lit(-1))))
    levels = levels.withColumn("hits", F.coalesce(F.array_max(F.transform(
        "at", lambda x: F.when(x["j"] == F.col("best"), x["seen"]))), F.lit(0)))
    first, last, hits = F.col("top"), F.col("best"), F.col("hits")

    def share(x: Column) -> Column:
        start = (F.when((x["j"] == first) & (last == first), F.log10((2 * hits - 1) / (2 * x["total"])))
                 .when((x["j"] == first) & (last < first), F.log10(x["kinds"] / (2 * x["total"])))
                 .otherwise(0.0))
        below = (F.when((last < first) & (x["j"] >= last + 2) & (x["j"] <= first) & (x["up_total"] > 0),
                        F.log10(x["up_kinds"] / (2 * x["up_total"])))
                 .when((last < first) & (last >= 0) & (x["j"] == last + 1),
                       F.log10((2 * hits - 1) / (2 * x["up_total"])))
                 .otherwise(0.0))
        return start + below

    known = F.aggregate("at", F.lit(0.0), lambda total, x: total + share(x))
    rest = F.when(last < 0, F.lit(float(-np.log10(max(unknown, 1))))).otherwise(0.0)
    return direct.union(levels.select("step", F.lit(0).cast("long"), known + rest))


def _word_key(word: bytes) -> int:
    """Spark's ``xxhash64`` of the word."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) * (h >> 63)


class _Hand:
    """What is at hand on an executor: sorted keys of words and steps with their figures, and the
    places of the words that were met, in a table of bounded size."""

    def __init__(self, words: np.ndarray, figures: np.ndarray, steps: np.ndarray, step_prices: np.ndarray) -> None:
        self.words, self.figures, self.steps, self.step_prices = words, figures, steps, step_prices
        self.met: dict[bytes, int] = {}

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Place of each key in a sorted table, -1 if it is not there."""
        if not len(table):
            return np.full(len(keys), -1)
        spot = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return np.where(table[spot] == keys, spot, -1)

    def places(self, words: list[list[bytes]]) -> np.ndarray:
        """Places of the words of some documents, one behind the other."""
        new = set().union(*words).difference(self.met)
        if len(self.met) + len(new) > _MET_WORDS:
            self.met.clear()
            new = set().union(*words)
        keys = np.fromiter(map(_word_key, new), np.int64, len(new))
        turn = np.argsort(keys)
        found = np.empty(len(new), np.int64)
        found[turn] = self._find(self.words, keys[turn])
        self.met.update(zip(new, found.tolist()))
        return np.fromiter(map(self.met.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))

    def step_places(self, taken: np.ndarray) -> np.ndarray:
        return self._find(self.steps, taken)


_PARTS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("is_step", pa.bool_()), ("key", pa.int64()),
                    ("times", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("base", pa.float64()), ("score", pa.float64())])


def _scorer(kept: Broadcast) -> Callable:
    """One row of sums over what is at hand per document (``is_step`` NULL), and a row per other
    distinct word or step."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand, end = _Hand(*kept.value[0]), kept.value[1]
        row = TaskContext.get().partitionId() << 36
        sums: list[tuple] = []
        others: list[tuple] = []
        waiting = 0

        def rows() -> Iterator[pa.RecordBatch]:
            if sums:
                columns = list(zip(*sums))
                none = pa.nulls(len(sums))
                yield pa.record_batch(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), none.cast(pa.bool_()),
                     none.cast(pa.int64()), none.cast(pa.int64()), pa.array(columns[2], pa.int64()),
                     pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64()),
                     pa.array(columns[5], pa.float64())], schema=_PARTS)
            if others:
                sizes = [len(o[2]) for o in others]
                none = pa.nulls(sum(sizes))
                yield pa.record_batch(
                    [pa.array(np.concatenate([o[0] for o in others]), pa.int64()), none.cast(pa.int64()),
                     pa.array(np.repeat([o[1] for o in others], sizes), pa.bool_()),
                     pa.array(np.concatenate([o[2] for o in others])), pa.array(np.concatenate([o[3] for o in others])),
                     none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.float64()), none.cast(pa.float64())],
                    schema=_PARTS)
            sums.clear()
            others.clear()

        def together(ids: list, words: list[list[bytes]]) -> int:
            """Score some documents; how many keys of them are not at hand."""
            n, away = len(ids), 0
            places = hand.places(words)
            of = np.repeat(np.arange(n), list(map(len, words)))
            there = places >= 0
            known = np.bincount(of[there], minlength=n) + end[0]
            base = np.bincount(of[there], hand.figures[places[there], 1], n) + end[1]
            own = [steps(w) for w in words]
            taken, by = np.concatenate(own), np.repeat(np.arange(n), list(map(len, own)))
            total = np.zeros(n)
            for at in range(0, len(taken), _STEPS_AT_ONCE):
                # Distinct steps in order: fewer of them to look up, and near each other in the table.
                keys, which = np.unique(taken[at:at + _STEPS_AT_ONCE], return_inverse=True)
                docs, spot = by[at:at + _STEPS_AT_ONCE], hand.step_places(keys)
                price = np.zeros(len(keys))
                price[spot >= 0] = hand.step_prices[spot[spot >= 0]]
                total += np.bincount(docs, price[which], n)
                missed = np.flatnonzero((spot < 0)[which])
                pairs, times = np.unique(docs[missed] * len(keys) + which[missed], return_counts=True)
                others.append((row + pairs // len(keys), True, keys[pairs % len(keys)], times))
                away += len(pairs)
            sums.extend(zip(range(row, row + n), ids, [len(w) + 1 for w in words], known.astype(np.int64).tolist(),
                            base.tolist(), total.tolist()))
            if len(missed := np.flatnonzero(~there)):
                every = list(chain.from_iterable(words))
                met = Counter(zip(of[missed].tolist(), map(every.__getitem__, missed.tolist())))
                others.append((np.fromiter((row + d for d, _ in met), np.int64, len(met)), False,
                               np.fromiter((_word_key(w) for _, w in met), np.int64, len(met)),
                               np.fromiter(met.values(), np.int64, len(met))))
                away += len(met)
            return away

        ids: list = []
        words: list[list[bytes]] = []
        size = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id"), batch.column("raw")):
                raw = raw.as_py()
                if ids and (size + len(raw) > _SCORED_AT_ONCE or len(ids) == _DOCUMENTS_AT_ONCE):
                    waiting += together(ids, words)
                    row += len(ids)
                    ids, words, size = [], [], 0
                    if waiting > _GATHER:
                        yield from rows()
                        waiting = 0
                ids.append(doc_id.as_py())
                words.append(raw.translate(LOWER_ASCII).split())
                size += len(raw)
        if ids:
            together(ids, words)
        yield from rows()
    return score


def _commonest(counted: DataFrame, most: int) -> DataFrame:
    """The rows with the largest ``n``, no more than ``most`` of them and without a part of those of
    equal size: sizes are told apart in steps of an eighth."""
    size = F.floor(8 * F.log2("n")).cast("int")
    room, smallest = most, None
    for row in counted.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        room -= row["count"]
        if room < 0:
            break
        smallest = row["size"]
    return counted.filter(F.lit(smallest is not None) & (size >= (smallest or 0)))


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score.

    The text is lower-cased (A-Z) and read as its words with one space behind each, then one
    end. ``score`` is its log10 probability under a byte model pretrained on the rows that
    are not held out: PPM with contexts of up to 5 bytes, PPMD escapes and symbol exclusion.
    ``base_score`` is the add-one unigram score of the words and the end. NULL and empty texts
    are the end alone; NULL ids are learnt from. Without rows to learn from all symbols are
    equally likely.

    Counts are gathered over all rows and pre-aggregated in the tasks. The commonest words
    and steps, in bounded number, are priced on all executors at hand; every other one is
    joined, so the result does not depend on those bounds. Words meet by a 64-bit hash. Texts that
    differ in white space alone have equal scores.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b"")).alias("raw"))
    marked = rows.select(held_out(F.col("doc_id")).alias("held"), "raw")
    words = stage(marked.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")), "counts")
    total, kinds, ends = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0))).first()
    base = float(total + kinds + 1)
    priced = stage(prices(stage(marked.mapInArrow(_step_counts, "step long, n long").groupBy("step").agg(
        F.sum("n").alias("n")), "steps")), "prices")
    known_words = words.filter((F.col("n") > 0) & (F.col("word") != END))
    often = _commonest(known_words, KEPT_WORDS).select(F.xxhash64("word").alias("key"), "n").toArrow()
    order = np.argsort(often.column("key").to_numpy())
    counts = often.column("n").to_numpy()[order]
    figures = np.stack([np.ones(len(counts)), np.log10((counts + 1) / base)], 1)
    taken = _commonest(priced.filter("n > 0"), KEPT_STEPS).select("step", "price").toArrow()
    turn = np.argsort(taken.column("step").to_numpy())
    kept = spark.sparkContext.broadcast((
        (often.column("key").to_numpy()[order], figures, taken.column("step").to_numpy()[turn],
         taken.column("price").to_numpy()[turn]), np.array([ends > 0, np.log10((ends + 1) / base)], float)))
    parts = stage(rows.mapInArrow(_scorer(kept), "row long, doc_id long, is_step boolean, key long, times long, "
                                  "n_tokens long, n_known long, base double, score double"), "parts")
    each = words.select(F.lit(False).alias("is_step"), F.xxhash64("word").alias("key"), (F.col("n") > 0).cast("long").alias("known"),
                        F.log10((F.col("n") + 1) / F.lit(base)).alias("base_each"), F.lit(0.0).alias("score_each"))
    each = each.union(priced.select(F.lit(True), "step", F.lit(0).cast("long"), F.lit(0.0), "price"))
    times = F.col("times")
    found = parts.filter("is_step is not null").join(each, ["is_step", "key"]).select(
        "row", (times * F.col("known")).alias("n_known"), (times * F.col("base_each")).alias("base"),
        (times * F.col("score_each")).alias("score")).groupBy("row").agg(
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    sums = parts.filter("is_step is null").select("row", "doc_id", "n_tokens", "n_known", "base", "score")
    return (sums.unionByName(found, allowMissingColumns=True).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"))
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score"))

"""Line dedup by an exact set-similarity join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import as_row, keyed, stage

#: Hash buckets of word counts: a word's rarity is the count of its bucket, in 1.2-fold steps.
RARITY_BUCKETS = 1 << 18
#: Removed line numbers (8 bytes each) up to which they are sent to all executors; beyond, the
#: same join shuffles the texts.
BROADCAST_NUMBERS = 8_000_000
#: Lines to be verified up to which their places are sent to all executors; beyond, as above.
BROADCAST_PLACES = 2_000_000
#: In the first round a line meets so many of the earliest lines that share one of so many rarest
#: words and are of one size class (powers of e ** 0.2); in the second, lines that are left meet all.
EARLIEST, RAREST = 4, 8
#: Words up to which a line's parity has 64 bits; beyond, 128.
NARROW = 60
#: Smaller sets are similar to no other set.
LEAST = 4


def _plain(text: Column) -> Column:
    """The text with blanks for all white space but line feeds. Blanks alone are split without a
    pattern, in a third of the time."""
    odd = [F.contains(text, F.lit(c)) for c in "\t\v\f\r"]
    return F.when(odd[0] | odd[1] | odd[2] | odd[3], F.translate(text, "\t\v\f\r", "    ")).otherwise(text)


def _hashes(line: Column) -> Column:
    """Hashes of the words of a line."""
    return F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w))


def _rarity(texts: DataFrame) -> DataFrame:
    """One row, the level (1 to 120) of every bucket by the number of its words in all texts, in the
    highest bits of a long; it has a fixed size."""
    words = texts.select(F.explode(F.split(F.replace(F.col("plain"), F.lit("\n"), F.lit(" ")), " ")).alias("word"))
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(F.lit(RARITY_BUCKETS - 1)).alias("id")).count()
    level = F.coalesce(F.least(F.lit(120), F.lit(1) + F.floor(F.log("count") / F.log(F.lit(1.2)))), F.lit(1))
    cells = texts.sparkSession.range(RARITY_BUCKETS).join(counts, "id", "left").select(
        F.struct("id", F.shiftleft(level.cast("long"), 56).alias("level")).alias("cell"))
    return stage(cells.agg(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["level"]).alias("levels")),
                 "rarity")


def _keys(line: Column, levels: Column) -> Column:
    """The distinct words as 63-bit keys, rarest first: level, then 56 bits of the hash."""
    def key(h: Column) -> Column:
        # Never NULL, so that the keys are sorted as plain numbers.
        level = F.coalesce(F.get(levels, h.bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int")), F.lit(0))
        return level.bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))
    return F.sort_array(F.array_distinct(F.transform(_hashes(line), key)))


def _line_sets(texts: DataFrame, levels: DataFrame) -> DataFrame:
    """Every line with words: its place, the class (hash of its set of words), size, parity and prefix (32 bits of
    each key).

    Parities are of words per hash value of seven bits, those of NARROW words and less folded to six.
    """
    split = texts.select("doc_id", "sig", F.posexplode(F.split("plain", "\n")).alias("line_no", "line")).filter(
        F.trim("line") != "")
    # The scalar ends up inside the expression, so the table is in no row.
    keys = split.withColumn("levels", levels.scalar()).select(
        "doc_id", "sig", "line_no", _keys(F.col("line"), F.col("levels")).alias("keys"))
    odd = "aggregate(keys, 0L, (p, k) -> p ^ shiftleft({}, cast(k & 63 as int)))"
    return keys.select(
        "doc_id", "sig", "line_no", F.xxhash64("keys").alias("cls"), F.size("keys").alias("n"),
        F.expr(odd.format("1L")).alias("parity"),
        F.expr(f"case when size(keys) > {NARROW} then {odd.format('shiftright(k, 6) & 1L')} else 0L end").alias("wide"),
        F.expr("transform(slice(keys, 1, size(keys) - (4 * size(keys) + 4) div 5 + 1), "
               "k -> cast((k & 4294967295) - 2147483648 as int))").alias("prefix"))


_N, _POS = ("shiftright({0}.at, 33)", "(shiftright({0}.at, 2) & 2147483647)")
_XN, _YN = _N.format("x"), _N.format("y")
_SHARED = f"((4 * ({_XN} + {_YN}) + 8) div 9)"
# Whether x is open and y's one are compared together, or the test would go before the exchange.
_NEAR = f"""y.no < x.no and 5 * {_YN} >= 4 * {_XN} and 5 * {_XN} >= 4 * {_YN} and (shiftright(x.at, 1) & y.at & 1) = 1
 and least({_XN} - {_POS.format("x")}, {_YN} - {_POS.format("y")}) >= {_SHARED}
 and case when {_XN} > {NARROW} and {_YN} > {NARROW}
     then bit_count(x.parity ^ x.wide ^ y.parity ^ y.wide) + bit_count(x.wide ^ y.wide)
     else bit_count(x.parity ^ y.parity) end <= {_XN} + {_YN} - 2 * {_SHARED}"""


def _met(x: DataFrame, y: DataFrame, *on: str) -> DataFrame:
    """Pairs (x, y) of open lines and earlier lines that share a key and may be similar, per key.

    Sizes, the place of the shared word in both prefixes, and parities (at most one bit of them
    changes with each word that differs) rule out the rest.
    """
    same = " and ".join(f"x.{c} = y.{c}" for c in on)
    return x.alias("x").join(y.alias("y"), F.expr(f"{same} and {_NEAR}")).select(
        F.col("x.no").alias("x"), F.col("y.no").alias("y"))


def _index(sets: DataFrame, prefix: Column, open_: Column) -> DataFrame:
    """A row per class and key of its prefix. ``at`` holds the size, the place of the key, whether the
    line is open, and a one."""
    rows = sets.filter(F.col("n") >= LEAST).select("no", "n", "parity", "wide", open_, F.posexplode(prefix).alias("pos", "key"))
    return rows.select("key", "no", "parity", "wide", F.expr(
        "shiftleft(cast(n as long), 33) | shiftleft(cast(pos as long), 2) | open * 2 | 1").alias("at"))


def _with_all(sets: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct pairs of the lines that are not found yet with all earlier ones they may be similar to.
    Both sides are the same rows in one exchange, which skewed keys are split in."""
    marked = stage(sets.join(found.select(F.col("x").alias("no"), F.lit(True).alias("late")), "no", "left").select(
        "no", "n", "parity", "wide", "prefix", F.col("late").isNull().cast("int").alias("open")), "open")
    index = _index(marked, F.col("prefix"), F.col("open"))
    return _met(index, index, "key").distinct()


def _with_earliest(sets: DataFrame) -> DataFrame:
    """Of the four earliest lines of each of its eight rarest words and of its size class, the earliest
    one that each line may be similar to. These words do for this round: similar lines share most, and
    what it misses the next one finds. Both sides come from one exchange."""
    dealt = _index(sets, F.slice("prefix", 1, RAREST), F.lit(1).alias("open")).withColumn(
        "size", F.floor(F.log(F.shiftright("at", 33)) * 5)).repartition("key", "size")
    order = Window.partitionBy("key", "size").orderBy("no")
    first = dealt.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= EARLIEST).drop("turn")
    return _met(dealt, first, "key", "size").groupBy("x").agg(F.min("y").alias("y"))


def _numbered(classes: DataFrame) -> DataFrame:
    """Classes numbered (``no``) in the order of their first places, without one task that sorts
    them all."""
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return classes.repartitionByRange(parts, "first").sortWithinPartitions("first").withColumn(
        "no", F.monotonically_increasing_id())


def _words_of(asked: DataFrame, texts: DataFrame, levels: DataFrame) -> DataFrame:
    """(no, words) of the asked lines (no, doc_id, sig, line_no), out of the texts."""
    wanted = asked.groupBy(F.col("doc_id").alias("id"), F.col("sig").alias("of")).agg(
        F.collect_list(F.struct("line_no", "no")).alias("asked"))
    wanted = F.broadcast(wanted) if asked.count() <= BROADCAST_PLACES else wanted
    met = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("sig") == F.col("of")))
    # Split once a text: what a generator makes is not copied into the expression below.
    split = met.select("asked", F.explode(F.array(F.split("plain", "\n"))).alias("lines"))
    spelt = split.select(F.explode(F.transform("asked", lambda a: F.struct(
        a["no"].alias("no"), F.get("lines", a["line_no"]).alias("line")))).alias("s"))
    return spelt.withColumn("levels", levels.scalar()).select("s.no", _keys(F.col("s.line"), F.col("levels")).alias("words")).dropDuplicates(["no"])


def preceded_lines(docs: DataFrame, doc_id: str = "doc_id",
                   text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, classes, preceded): every line with words as (doc_id, sig, line_no, cls), the
    classes as (cls, no, first), and the numbers (x) of those with an earlier class that has a
    Jaccard similarity of 4/5 or more.

    A class is a set of words, so copies enter the join once. Of each set's words, rarest
    first, only the prefix that two similar sets must share a word in is joined. Whether any
    earlier line is similar is all that counts, so a line meets the earliest lines of a key
    and size first, and is out if the earliest that may be similar is, verified on all words; it stays in the
    index. A large group of near copies ends in the first round, in pairs that grow with its size. The
    second round compares what is left with all. Words are told apart by 56 bits of their hash and
    the rarity level.
    """
    texts = keyed(docs, doc_id, text).select("doc_id", "sig", _plain(F.col("text")).alias("plain"))
    levels = _rarity(texts)
    lines = stage(_line_sets(texts, levels), "lines")
    told = lines.groupBy("cls").agg(F.min(F.struct("doc_id", "sig", "line_no", "n", "parity", "wide", "prefix")).alias("m"))
    sets = stage(_numbered(told.select("cls", F.struct("m.doc_id", "m.sig", "m.line_no").alias("first"), "m.n", "m.parity",
                                       "m.wide", "m.prefix")), "sets")
    classes = sets.select("cls", "no", "first")
    found = None
    for _ in range(2):
        pairs = stage(_with_earliest(sets) if found is None else _with_all(sets, found), "pairs")
        asked = stage(pairs.select(F.col("x").alias("no")).union(pairs.select("y")).distinct().join(
            classes, "no").select("no", "first.*"), "asked")
        words = stage(_words_of(asked, texts, levels), "words")
        sure = _verified(pairs, words)
        found = stage(sure if found is None else found.union(sure), "sure")
    return lines.select("doc_id", "sig", "line_no", "cls"), classes, found


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The distinct x of pairs (x, y) whose words overlap enough."""
    both = pairs.join(words.toDF("x", "left"), "x").join(words.toDF("y", "right"), "y")
    return both.filter(9 * F.size(F.array_intersect("left", "right"))
                       >= 4 * (F.size("left") + F.size("right"))).select("x").distinct()


def _removed(lines: DataFrame, classes: DataFrame, preceded: DataFrame) -> DataFrame:
    """(id, of, gone): numbers of the lines of each document that an earlier similar line precedes."""
    marked = classes.join(preceded.select(F.col("x").alias("no"), F.lit(True).alias("late")), "no", "left")
    later = lines.join(marked.select("cls", "first", "late"), "cls").filter(
        F.col("late") | (F.struct("doc_id", "sig", "line_no") > F.col("first")))
    gone = stage(later.groupBy(F.col("doc_id").alias("id"), F.col("sig").alias("of")).agg(
        F.array_distinct(F.collect_list("line_no")).alias("gone")), "gone")
    numbers = gone.agg(F.sum(F.size("gone") + 4)).first()[0] or 0
    return F.broadcast(gone) if numbers <= BROADCAST_NUMBERS else gone


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs``, ``text`` without later similar lines, and ``n_lines``, ``n_removed``.

    A line goes if an earlier line of the input - of a smaller (doc_id, hash of the text, line
    number), a NULL id first - has a word set with a Jaccard similarity of 4/5 or more,
    whether that line stays or not. Words are runs of non-white-space as they are written. Lines
    without words stay. The rest is joined by line feeds again; NULL texts stay NULL with no
    lines. Rows equal in id and text share their lines' places and keep the same lines.
    Columns named ``n_lines`` or ``n_removed`` are replaced.
    """
    gone = _removed(*preceded_lines(docs, doc_id, text))
    whole = F.col(text).cast("string")
    rows = docs.select(as_row(docs), F.col(doc_id).cast("long").alias("own"), whole.alias("whole"),
                       F.coalesce(F.xxhash64(whole), F.lit(0)).alias("sig"))
    joined = rows.join(gone, F.col("own").eqNullSafe(F.col("id")) & (F.col("sig") == F.col("of")), "left")
    split = F.split("whole", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(F.array_join(
        F.filter(split, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*[(kept if c == text else F.col("row")[c]).alias(c) for c in keep],
                         F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))

"""Transactions out of decoded log text: assembly, ranking, windows, detail lines.

Input lines are ``(file, line_no, line)``, with ``line_no`` 1-based and dense per file, or a
``LandedLog``, of which windows and detail lines read only the parts they need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import logtext as L
from fleetlens.operators.ordered import bucketed_offset, exclusive_prefix
from fleetlens.session import store
from fleetlens.sources.text import LandedLog

# Lines per ordered chunk; per bucket in which lines meet short spans; and long spans.
CHUNK_LINES = 200_000
SPAN_LINES = 256
#: Lines of a chunk whose marks are counted in order: what Spark's windows hold as rows.
ORDER_LINES = 4_096
RUN_LINES = 8_192
#: Pieces of spans up to which a landed log is read by ranges of line ids alone.
MAX_PIECES = 256
#: And pieces up to which they are broadcast to the lines.
MAX_CARRIED = 65_536


def _chunk(line_no: Column, chunk_lines: int) -> Column:
    return F.floor(line_no / chunk_lines).cast("bigint")


_FLAGS = ("begin", "commit", "change", "hash", "map", "end", "gtid")


def _is(flag: str) -> Column:
    return F.col("mask").bitwiseAND(1 << _FLAGS.index(flag)) != 0


def log_marks(lines: DataFrame | LandedLog, mode: str = "strict") -> DataFrame:
    """Only the lines that decide something, reduced to a flag mask and numbers.

    Row images, most of a log, go no further than the scan, and no text is shuffled.
    ``strict`` ignores marker words inside row images; ``compat`` takes them anywhere.
    """
    if mode not in ("strict", "compat"):
        raise ValueError("mode is 'strict' or 'compat'")
    if isinstance(lines, LandedLog):
        return lines.number(_marked(lines.stored.select("path", "block", "line_id", "line"), mode,
                                    ["path", "block", "line_id"]))
    numbered = lines.select("file", F.col("line_no").cast("bigint").alias("line_no"), "line")
    return _marked(numbered, mode, ["file", "line_no"])


def _mask(line: Column, mode: str) -> Column:
    """Flags of a line. In strict mode the first characters of a line rule out most of them, so a row
    image, the greater part of a log, is not searched for words."""
    def bits(**tests: Column) -> Column:
        return reduce(lambda a, b: a + b, (
            F.when(test, F.lit(1 << _FLAGS.index(flag))).otherwise(F.lit(0)) for flag, test in tests.items()))
    commit, change = L.is_commit(line, mode), L.is_change(line, mode)
    header = F.when(line.contains("end_log_pos"), bits(
        map=line.contains("Table_map"), end=line.contains("Xid"))).otherwise(F.lit(0)) + bits(
        gtid=line.contains("last_committed") & line.contains("sequence_number"))
    if mode == "compat":
        return bits(begin=L.is_begin(line), commit=commit, change=change, hash=line.startswith("#")) + header
    return (F.when(L.is_row_text(line), bits(change=change))
            .when(line.startswith("#"), bits(commit=commit, hash=F.lit(True)) + header)
            .otherwise(bits(begin=L.is_begin(line), commit=commit)))


def _marked(lines: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    line = F.col("line")
    mask = _mask(line, mode)
    marked = lines.filter(mask != 0).select(*keys, "line", mask.alias("mask"))
    return marked.select(
        *keys, "mask",
        F.when(_is("hash"), L.as_bigint(L.last_token(line))).alias("pos"),
        F.when(_is("map") | _is("end"), L.log_ts(line)).alias("ts"),
        F.when(_is("end"), L.end_log_pos(line)).alias("end_pos"),
        F.when(_is("end"), L.as_bigint(L.last_token(line))).alias("xid"),
        F.when(_is("gtid"), L.number_after(line, "last_committed")).alias("last_committed"),
        F.when(_is("gtid"), L.number_after(line, "sequence_number")).alias("sequence_number"))


_MARK = ("line_no", "mask", "pos", "ts", "end_pos", "xid", "last_committed", "sequence_number")


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def shares_of(n_lines: int) -> int:
    """Into how many partitions lines or what is made of them are dealt out: one per
    ``CHUNK_LINES``. A log shrinks so much in an exchange that what Spark takes for one partition by
    its bytes there outgrows a task."""
    return n_lines // CHUNK_LINES + 2


def _shares(lines: DataFrame | LandedLog) -> int | None:
    return shares_of(lines.n_lines()) if isinstance(lines, LandedLog) else None


def dealt_out(df: DataFrame, shares: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in so many partitions, or as many as Spark makes."""
    return df.repartition(*([shares] if shares else []), *keys)


def _shuffled_marks(marks: DataFrame, chunk_lines: int, shares: int | None, repeated: bool) -> DataFrame:
    """Marks dealt out by (file, chunk of lines), each line once.

    A mark travels as one array of numbers, which no rule can narrow to fewer columns. So all that
    is made of the marks starts from the same exchange, and the text is scanned once. The array
    ends with the last number that most of its kind have.
    """
    seconds = F.timestamp_diff("SECOND", _epoch(), F.col("ts"))
    cells = [(seconds if c == "ts" else F.col(c)).cast("bigint") for c in _MARK]
    bare = reduce(lambda a, b: a & b, (F.col(c).isNull() for c in _MARK[3:]))
    mark = (F.when(bare & F.col("pos").isNull(), F.array(*cells[:2])).when(bare, F.array(*cells[:3]))
            .otherwise(F.array(*cells)))
    dealt = dealt_out(marks.select("file", F.coalesce(_chunk(F.col("line_no"), chunk_lines), F.lit(-1)).alias("chunk"),
                                mark.alias("mark")), shares, "file", "chunk")
    if repeated:
        dealt = dealt.withColumn("line_no", F.col("mark")[0]).dropDuplicates(["file", "chunk", "line_no"])
    found = {c: F.get(F.col("mark"), F.lit(i)) for i, c in enumerate(_MARK)}
    found["ts"] = _epoch() + F.make_dt_interval(secs=found["ts"])
    return dealt.select("file", "chunk", *[v.alias(c) for c, v in found.items()])


def assemble_transactions(lines: DataFrame | LandedLog, mode: str = "strict",
                          chunk_lines: int = ORDER_LINES) -> DataFrame:
    """One row per committed transaction of every file; the text is read once.

    Every mark gets two ordinals, commits before it and BEGINs up to it, as a count
    inside its chunk of lines plus the totals of earlier chunks. A *cell* is one pair of
    ordinals; the transaction is the last cell of its commit ordinal, so a rolled-back
    BEGIN falls away. All aggregates keep fixed-width buffers (hash aggregation with
    partials), so a transaction of any length reaches the shuffle as one row per chunk.
    """
    return assemble_marks(log_marks(lines, mode), chunk_lines, _shares(lines))


def assemble_marks(marks: DataFrame, chunk_lines: int = ORDER_LINES, shares: int | None = None) -> DataFrame:
    """``assemble_transactions`` of lines that ``log_marks`` has reduced."""
    return closed_segments(segments(merged_cells(cells(marks, chunk_lines, shares), shares)))


def cells(marks: DataFrame, chunk_lines: int = ORDER_LINES, shares: int | None = None,
          repeated: bool = False) -> DataFrame:
    """Parts of the cells of marks, by chunk: a cell is one (file, commit_ord, begin_ord), what lies
    between two BEGINs or commits. Lines that are ``repeated`` count once.

    Of a commit ordinal only the last cell of a chunk has a row, which holds the last end header and
    GTID of all of them: that is all a segment is made of. What is counted in a chunk stays in its
    partition.
    """
    return _last_parts(_cells(_placed(marks, chunk_lines, shares, repeated)))


def _placed(marks: DataFrame, chunk_lines: int, shares: int | None, repeated: bool) -> DataFrame:
    """Marks with the number of BEGINs up to them and of commits before them."""
    begin, commit = _is("begin").cast("bigint"), _is("commit").cast("bigint")
    seen = (Window.partitionBy("file", "chunk").orderBy("line_no")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dealt = _shuffled_marks(marks, chunk_lines, shares, repeated)
    counted = dealt.select("*", F.sum(begin).over(seen).alias("b"),
                           (F.sum(commit).over(seen) - commit).alias("c"))
    totals = dealt.groupBy("file", "chunk").agg(F.sum(begin).alias("begins"), F.sum(commit).alias("commits"))
    offsets = exclusive_prefix(totals, ["file"], "chunk", ["begins", "commits"])
    return (counted.join(offsets, ["file", "chunk"])
            .withColumn("begin_ord", F.col("b") + F.col("begins"))
            .withColumn("commit_ord", F.col("c") + F.col("commits")))


def _cells(placed: DataFrame) -> DataFrame:
    def at(flag: str) -> Column:
        return F.when(_is(flag), F.col("line_no"))
    return placed.groupBy("file", "chunk", "commit_ord", "begin_ord").agg(
        F.max(at("begin")).alias("start_line"),
        F.max(at("commit")).alias("end_line"),
        F.count_if(_is("change")).alias("n_rows"),
        F.min(at("hash")).alias("hash_at"),
        F.min_by("pos", at("hash")).alias("start_pos"),
        F.min(at("map")).alias("map_at"),
        F.min_by("ts", at("map")).alias("start_time"),
        F.max(at("end")).alias("end_at"),
        F.max_by("end_pos", at("end")).alias("end_pos"),
        F.max_by("ts", at("end")).alias("end_time"),
        F.max_by("xid", at("end")).alias("xid"),
        F.max(at("gtid")).alias("gtid_at"),
        F.max_by("last_committed", at("gtid")).alias("last_committed"),
        F.max_by("sequence_number", at("gtid")).alias("sequence_number"))


_BEGUN = ("start_line", "hash_at", "start_pos", "map_at", "start_time")


def _last_parts(parts: DataFrame) -> DataFrame:
    def last(name: str, by: str) -> Column:
        return F.max_by(name, by).alias(name)
    return parts.groupBy("file", "chunk", "commit_ord").agg(
        *[last(c, "begin_ord") for c in (*_BEGUN, "n_rows")], F.max("end_line").alias("end_line"),
        F.max("end_at").alias("end_at"), last("end_pos", "end_at"), last("end_time", "end_at"), last("xid", "end_at"),
        F.max("gtid_at").alias("gtid_at"), last("last_committed", "gtid_at"), last("sequence_number", "gtid_at"),
        F.max("begin_ord").alias("begin_ord")).drop("chunk")


def merged_cells(parts: DataFrame, shares: int | None = None) -> DataFrame:
    """Cells out of their parts, dealt out so that those of a segment meet: a segment has one part
    in a chunk."""
    def early(name: str, by: str) -> Column:
        return F.min_by(name, by).alias(name)

    def late(name: str, by: str) -> Column:
        return F.max_by(name, by).alias(name)
    return dealt_out(parts, shares, "file", "commit_ord").groupBy("file", "commit_ord", "begin_ord").agg(
        F.max("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.sum("n_rows").alias("n_rows"),
        F.min("hash_at").alias("hash_at"), early("start_pos", "hash_at"),
        F.min("map_at").alias("map_at"), early("start_time", "map_at"), F.max("end_at").alias("end_at"),
        late("end_pos", "end_at"), late("end_time", "end_at"), late("xid", "end_at"), F.max("gtid_at").alias("gtid_at"),
        late("last_committed", "gtid_at"), late("sequence_number", "gtid_at"))


def segments(found: DataFrame) -> DataFrame:
    """Of each commit ordinal: fields of its last BEGIN, last end header, last GTID. The one of a
    file that no commit has ended has no ``end_line``."""
    def last(name: str, by: str) -> Column:
        return F.max_by(name, by).alias(name)
    begun = F.when(F.col("start_line").isNotNull(), F.col("begin_ord"))
    return found.withColumn("_b", begun).groupBy("file", "commit_ord").agg(
        *[last(c, "_b") for c in _BEGUN],
        F.coalesce(F.max_by("n_rows", "_b"), F.sum("n_rows")).alias("n_rows"),
        F.max("end_line").alias("end_line"), F.max("end_at").alias("end_at"),
        last("end_pos", "end_at"), last("end_time", "end_at"), last("xid", "end_at"),
        F.max("gtid_at").alias("gtid_at"), last("last_committed", "gtid_at"), last("sequence_number", "gtid_at"))


def closed_segments(found: DataFrame) -> DataFrame:
    """Transactions out of the segments that a commit has ended."""
    closed = found.filter(F.col("end_line").isNotNull())
    secs = F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time"))
    return closed.select(
        "file", "xid", "n_rows", (F.col("end_pos") - F.col("start_pos")).alias("size"),
        secs.alias("secs"), "start_time", "end_time", "start_line", "end_line",
        "start_pos", "end_pos", "last_committed", "sequence_number",
        F.col("start_line").isNotNull().alias("is_complete"),
        F.coalesce((secs == 0) & (F.col("n_rows") > 0), F.lit(False)).alias("is_implicit"))


def continued_cells(found: DataFrame, open_segments: DataFrame, shares: int | None = None) -> DataFrame:
    """Cells of lines that follow on the open segments, out of their parts: an open segment is what
    stood in the first cell of its file before them."""
    zero = F.lit(0).cast("bigint")
    carried = open_segments.withColumn("commit_ord", zero).withColumn("begin_ord", zero)
    return merged_cells(found.unionByName(carried.select(*found.columns)), shares)


def top_transactions(trx: DataFrame, by: str = "n_rows", n: int = 100) -> DataFrame:
    """The ``n`` largest transactions by ``n_rows``, ``size`` or ``secs``; file order
    breaks ties. Plans as a top-k per task, not as a full sort."""
    if by not in ("n_rows", "size", "secs"):
        raise ValueError("by is 'n_rows', 'size' or 'secs'")
    return trx.orderBy(F.desc_nulls_last(by), "file", "start_line").limit(n)


def transaction_summaries(trx: DataFrame) -> DataFrame:
    """Each transaction with its one-line description."""
    return trx.select("file", "xid", L.describe_transaction().alias("summary"))


def _listed(spans: DataFrame, first: str, last: str, width: int) -> DataFrame:
    """Spans under each bucket of ``width`` lines that they touch."""
    return spans.withColumn("_bucket", F.explode(F.sequence(
        _chunk(F.col(first), width), _chunk(F.col(last), width))))


def _lines_in(lines: DataFrame, spans: DataFrame, first: str, last: str,
              width: int) -> DataFrame:
    """Lines inside line spans that do not overlap, with the span's columns.

    Both sides meet on (file, bucket of ``width`` lines): a span is listed under each bucket
    it touches and the exact bounds are a residual, so a line is compared with the few spans
    of its own bucket. Text is shuffled unless Spark knows the spans to be small; a landed log
    is looked up without that.
    """
    keyed = lines.withColumn("_bucket", _chunk(F.col("line_no"), width))
    return (keyed.join(_listed(spans, first, last, width), ["file", "_bucket"])
            .filter(F.col("line_no").between(F.col(first), F.col(last)))
            .drop("_bucket"))


def _pieces(log: LandedLog, spans: DataFrame, first: str, last: str) -> DataFrame:
    """Spans as ranges of line ids: one row per span and file block, with ``_from``, ``_to`` and
    ``_shift``, by which ids of the block differ from line numbers."""
    width = RUN_LINES * 8
    zones = _listed(log.zones.select("file", "path", "block", "first_id", "first_line", "last_line"),
                    "first_line", "last_line", width)
    met = _listed(spans, first, last, width).join(zones, ["file", "_bucket"]).filter(
        (F.col(first) <= F.col("last_line")) & (F.col(last) >= F.col("first_line")))
    shift = F.col("first_line") - F.col("first_id")
    return dealt_out(met, _shares(log), "file", first).groupBy(*spans.columns, "path", "block").agg(
        F.min(F.greatest(first, "first_line") - shift).alias("_from"),
        F.max(F.least(last, "last_line") - shift).alias("_to"), F.min(shift).alias("_shift"))


def _stored_between(log: LandedLog, ranges: list[tuple[int, int]]) -> DataFrame:
    """Stored lines with ids in one of the ranges: a filter that Parquet's row groups are pruned
    by. Neighbouring ranges become one."""
    merged: list[list[int]] = []
    for low, high in sorted(ranges):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    tests = [F.col("line_id").between(low, high) for low, high in merged]
    return log.stored.filter(reduce(lambda a, b: a | b, tests, F.lit(False)))


def _landed_lines_in(log: LandedLog, spans: DataFrame, first: str, last: str) -> DataFrame:
    """Lines of a landed log inside line spans that do not overlap, with the span's columns.

    The spans are stored first, and meet the zone map, never the text. Up to 256 ranges of line
    ids are then written into the scan, so only their row groups are read and no text is
    shuffled. Up to 65,536 go to the lines, by bucket of ids. More than that and the lines are
    dealt out by bucket, an even share to a partition; no id occurs twice, so that is all of the key.
    """
    pieces = store(_pieces(log, spans, first, last), "pieces")
    few = pieces.select("_from", "_to").limit(MAX_PIECES + 1).collect()
    inside = F.col("line_id").between(F.col("_from"), F.col("_to"))
    number = (F.col("line_id") + F.col("_shift")).alias("line_no")
    keep = [c for c in spans.columns if c not in ("file", first, last)]
    bounds = [c for c in (first, last) if not c.startswith("_")]
    if len(few) <= MAX_PIECES:
        text = _stored_between(log, [(r["_from"], r["_to"]) for r in few]).select("path", "block", "line_id", "line")
        met = text.join(F.broadcast(pieces), ["path", "block"])
    else:
        narrow = pieces.count() > MAX_CARRIED
        width = SPAN_LINES if narrow else RUN_LINES
        text = log.stored.select("line_id", "line", F.shiftright("line_id", width.bit_length() - 1).alias("_bucket"))
        listed = _listed(pieces, "_from", "_to", width)
        met = (text.repartition(_shares(log), "_bucket").join(
                   listed.repartition(_shares(log), "_bucket").hint("shuffle_hash"), "_bucket")
               if narrow else text.join(F.broadcast(listed), "_bucket"))
    return met.filter(inside).select("file", number, "line", *keep, *bounds)


def transaction_lines(lines: DataFrame | LandedLog, trx: DataFrame) -> DataFrame:
    """All log lines of the given transactions, first to last."""
    spans = (trx.filter("start_line is not null")
             .select("file", "xid", "start_line", "end_line"))
    found = (_landed_lines_in(lines, spans, "start_line", "end_line") if isinstance(lines, LandedLog)
             else _lines_in(lines, spans, "start_line", "end_line", SPAN_LINES))
    return found.select("file", "xid", "start_line", "line_no", "line")


def _event_lines(lines: DataFrame) -> DataFrame:
    """(file, line_no, pos, ts) of the lines that begin an event or hold its header."""
    line = F.col("line")
    return lines.select("file", F.col("line_no").cast("bigint").alias("line_no"),
                        L.log_position(line).alias("pos"), L.event_ts(line).alias("ts")).filter(
        "pos is not null or ts is not null")


def _landed_events(log: LandedLog, hit: Column) -> tuple[DataFrame, int]:
    """Event lines of the zones that ``hit`` (of the zone map) cannot rule out, and of those next
    to them, where their first event may begin and their last one ends; and how many lines these
    zones have. No text is read.

    A zone in which no event begins goes with the one before, as its headers do.
    """
    along = Window.partitionBy("file").orderBy("first_line").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    busy = log.zones.filter("first_pos is not null or first_ts is not null").select(
        "file", "first_id", "last_id", hit.alias("hit"),
        F.count("first_pos").over(along).alias("group"))
    order = Window.partitionBy("file").orderBy("group")
    groups = busy.groupBy("file", "group").agg(F.bool_or("hit").alias("hit"))
    near = groups.withColumn("near", F.col("hit") | F.coalesce(F.lag("hit").over(order), F.lit(False))
                             | F.coalesce(F.lead("hit").over(order), F.lit(False))).filter("near")
    wanted = store(busy.join(near.select("file", "group"), ["file", "group"]).select("first_id", "last_id"), "zones")
    few = wanted.limit(MAX_PIECES + 1).collect()
    stored = (_stored_between(log, [(r.first_id, r.last_id) for r in few]) if len(few) <= MAX_PIECES else log.stored)
    n_lines = wanted.agg(F.sum(F.col("last_id") - F.col("first_id") + 1)).first()[0] or 0
    return log.number(stored.filter("pos is not null or ts is not null").select(
        "path", "block", "line_id", "pos", "ts")), n_lines


def log_window(lines: DataFrame | LandedLog, start_ts: str | None = None, stop_ts: str | None = None,
               start_pos: int | None = None, stop_pos: int | None = None,
               chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """Lines of the events in a half-open time or position range.

    An event runs from its ``# at N`` line to the next one. Only these lines and the
    headers after them are shuffled; runs of kept events become line spans, usually a
    handful, that are then looked up in the text. Of a landed log the zone map rules out most
    zones before events are read, and only the row groups of the spans are read as text.
    """
    timed = start_ts is not None and stop_ts is not None
    placed = start_pos is not None and stop_pos is not None
    if not (timed or placed):
        raise ValueError("give both ends of a time range or of a position range")
    low, high = ((F.lit(t).cast("timestamp_ntz") for t in (start_ts, stop_ts)) if timed
                 else (F.lit(start_pos), F.lit(stop_pos)))
    at = "ts" if timed else "pos"
    landed = isinstance(lines, LandedLog)
    if landed:
        hit = F.coalesce((F.col(f"last_{at}") >= low) & (F.col(f"first_{at}") < high), F.lit(False))
        found, n_lines = _landed_events(lines, hit)
        ends = lines.zones.groupBy("file").agg(F.max("last_line").alias("final_line"))
    else:
        found = _event_lines(lines)
        ends = lines.groupBy("file").agg(F.max(F.col("line_no").cast("bigint")).alias("final_line"))
    at_line = F.when(F.col("pos").isNotNull(), F.col("line_no")).otherwise(F.col("line_no") - 1)
    chunked = found.withColumn("at_line", at_line).select(
        "file", "at_line", _chunk(F.col("at_line"), chunk_lines).alias("chunk"), "pos", "ts")
    events = (dealt_out(chunked, shares_of(n_lines) if landed else None, "file", "chunk")
              .groupBy("file", "chunk", "at_line").agg(F.max("pos").alias("pos"), F.max("ts").alias("ts"))
              .filter("pos is not null"))
    inside = (F.col(at) >= low) & (F.col(at) < high)
    events = events.select("file", "at_line", "chunk", F.coalesce(inside, F.lit(False)).alias("keep"))
    turns = (bucketed_offset(events, ["file"], "chunk", ["at_line"], {"keep": "was"})
             .filter("keep != coalesce(was, false)").drop("was"))
    runs = bucketed_offset(turns, ["file"], "chunk", ["at_line"], {"at_line": "stop_line"},
                           lead=True).filter("keep")
    spans = runs.join(ends, "file").select(
        "file", F.col("at_line").alias("_first"),
        F.coalesce(F.col("stop_line") - 1, F.col("final_line")).alias("_last"))
    met = (_landed_lines_in(lines, spans, "_first", "_last") if landed
           else _lines_in(lines, spans, "_first", "_last", RUN_LINES))
    return met.select("file", "line_no", "line")


def group_commit_stats(trx: DataFrame, bucket: str = "hour") -> DataFrame:
    """Commit groups (equal ``last_committed``) per file and time bucket, with the file
    and grand totals as rollup rows (``level`` 0 detail, 1 file, 3 all). A group belongs to
    the bucket of its first start; transactions without ``last_committed`` are in none."""
    first = F.date_trunc(bucket, F.min("start_time")).cast("timestamp_ntz")
    groups = (trx.filter("last_committed is not null").groupBy("file", "last_committed")
              .agg(F.count("*").alias("n"), first.alias("bucket_start")))
    return groups.rollup("file", "bucket_start").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count("*").alias("n_groups"), F.sum("n").alias("n_transactions"),
        F.max("n").alias("largest_group"))

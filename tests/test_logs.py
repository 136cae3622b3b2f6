"""Hand-written decoded logs: assembly, windows, ranking, detail lines, streaming."""

import json
import os
import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetlens.functions import logtext as L
from fleetlens.operators import logs
from fleetlens.plans.pipelines import largest_transactions
from fleetlens.sources import text
from fleetlens.sources.text import land_log, read_numbered_lines
from fleetlens.streaming.transactions import assemble_batch, read_late_lines, read_transactions, stream_transactions
from workload import views


def head(clock, pos, rest):
    return f"#240102 {clock} server id 1  end_log_pos {pos} CRC32 0x0 \t{rest}"


def trx(at, xid, changes, start=" 3:00:00", end=" 3:00:05", lc=1, table_map=True,
        close="COMMIT/*!*/;"):
    body = ["# at %d" % at,
            head(start, at + 65, f"GTID\tlast_committed={lc}\tsequence_number={xid}"),
            "BEGIN", "/*!*/;", "# at %d" % (at + 65)]
    if table_map:
        body.append(head(start, at + 100, "Table_map: `d`.`t` mapped to number 1"))
    for change in changes:
        body += [change, "### SET", "###   @1=7"]
    body.append(head(end, at + 400, f"Xid = {xid}"))
    return [*body, close]


NORMAL = trx(100, 11, ["### INSERT INTO `d`.`t`", "### UPDATE `d`.`t`"])
ROLLED_BACK = trx(500, 12, ["### DELETE FROM `d`.`t`"] * 5, close="ROLLBACK")
LATE = trx(900, 13, ["### UPDATE `d`.`t`"], start="13:59:58", end="14:00:01", lc=2)
NO_MAP = trx(1300, 14, ["### UPDATE `d`.`t`"], table_map=False, lc=2)
ZERO = trx(1700, 15, ["### UPDATE `d`.`t`"], end=" 3:00:00", lc=3)
WORDY = trx(2100, 16, ["### UPDATE `d`.`t`"], lc=3)
WORDY.insert(8, "###   @2='please DELETE or INSERT, end_log_pos 9 Xid = 3'")
TAIL = trx(2500, 17, ["### UPDATE `d`.`t`"] * 9)[:-1]
LOG = NORMAL + ROLLED_BACK + LATE + NO_MAP + ZERO + WORDY + TAIL


def frame(spark, lines, file="f"):
    return spark.createDataFrame([(file, i + 1, x) for i, x in enumerate(lines)],
                                 "file string, line_no bigint, line string")


FIELDS = ("xid", "n_rows", "size", "secs", "last_committed", "is_complete", "is_implicit")
EXPECTED = [(11, 2, 335, 5, 1, True, False), (13, 1, 335, 3, 2, True, False),
            (14, 1, 335, None, 2, True, False), (15, 1, 335, 0, 3, True, True),
            (16, 1, 335, 5, 3, True, False)]


@pytest.mark.parametrize("chunk", [1, 3, 10, 1_000])
def test_golden_log(spark, chunk):
    found = logs.assemble_transactions(frame(spark, LOG), chunk_lines=chunk)
    assert rows(found, *FIELDS) == EXPECTED


def test_lines_and_start_time(spark):
    found = {r["xid"]: r for r in logs.assemble_transactions(frame(spark, LOG)).collect()}
    assert (found[11]["start_line"], found[11]["end_line"]) == (3, len(NORMAL))
    first = len(NORMAL) + len(ROLLED_BACK)
    assert found[13]["start_line"] == first + 3
    assert str(found[13]["start_time"]) == "2024-01-02 13:59:58"
    assert found[14]["start_time"] is None


def test_compat_counts_words_in_data(spark):
    found = {r["xid"]: r["n_rows"] for r in logs.assemble_transactions(
        frame(spark, LOG), mode="compat").collect()}
    assert found[16] == 2 and found[11] == 2


def test_file_that_starts_inside_a_transaction(spark):
    found = logs.assemble_transactions(frame(spark, NORMAL[5:] + LATE))
    assert rows(found, "xid", "n_rows", "size", "is_complete") == [
        (11, 2, None, False), (13, 1, 335, True)]


def test_carriage_returns(spark):
    found = logs.assemble_transactions(frame(spark, [x + "\r" for x in LOG]))
    assert rows(found, *FIELDS) == EXPECTED


def test_files_are_independent(spark):
    both = frame(spark, LOG, "a").unionByName(frame(spark, LATE + NORMAL, "b"))
    found = logs.assemble_transactions(both, chunk_lines=7)
    assert [r[1] for r in rows(found, "file", "xid")] == [11, 13, 14, 15, 16, 11, 13]


def test_top_has_a_total_order(spark):
    found = logs.assemble_transactions(frame(spark, LOG))
    top = [r["xid"] for r in logs.top_transactions(found, "n_rows", 3).collect()]
    assert top == [11, 13, 14]
    by_secs = [r["xid"] for r in logs.top_transactions(found, "secs").collect()]
    assert by_secs == [11, 16, 13, 15, 14]
    with pytest.raises(ValueError):
        logs.top_transactions(found, "xid")


def test_transaction_lines(spark):
    lines = frame(spark, LOG)
    chosen = logs.assemble_transactions(lines).filter("xid = 13")
    got = logs.transaction_lines(lines, chosen).orderBy("line_no").collect()
    assert [r["line"] for r in got] == LATE[2:]


def test_window_by_position_and_time(spark):
    lines = frame(spark, ["/*!50530 SET x */;", *LOG])
    for chunk in (2, 1_000):
        got = logs.log_window(lines, start_pos=900, stop_pos=1300, chunk_lines=chunk)
        assert [r["line"] for r in got.orderBy("line_no").collect()] == LATE
    timed = logs.log_window(lines, start_ts="2024-01-02 13:00:00",
                            stop_ts="2024-01-02 14:00:00")
    assert [r["line"] for r in timed.orderBy("line_no").collect()] == LATE
    tail = logs.log_window(lines, start_pos=2500, stop_pos=9999)
    assert [r["line"] for r in tail.orderBy("line_no").collect()] == TAIL
    with pytest.raises(ValueError):
        logs.log_window(lines, start_ts="2024-01-02 13:00:00")
    with pytest.raises(ValueError):
        logs.log_window(lines)


def test_ranked_window_pipeline(spark):
    top = largest_transactions(frame(spark, LOG), start_ts="2024-01-02 13:00:00",
                               stop_ts="2024-01-02 15:00:00")
    assert rows(top, "xid") == [(13,)]


def test_group_commit_levels(spark):
    found = logs.group_commit_stats(logs.assemble_transactions(frame(spark, LOG)))
    total = found.filter("level = 3").collect()[0]
    # One of the five has no last_committed and so is in no group.
    assert total["n_groups"] == 3
    assert total["n_transactions"] == logs.assemble_transactions(frame(spark, LOG)).filter(
        "last_committed is not null").count()


def test_group_over_an_hour_border_counts_once(spark):
    trx = spark.sql("""select 'f' as file, cast(t as timestamp_ntz) as start_time, 4L as last_committed
        from values ('2024-01-01 01:59:59'), ('2024-01-01 02:00:01') v(t)""")
    found = logs.group_commit_stats(trx)
    assert rows(found, "level", "n_groups", "n_transactions") == [(0, 1, 2), (1, 1, 2), (3, 1, 2)]


def test_summary(spark):
    text = rows(logs.transaction_summaries(
        logs.assemble_transactions(frame(spark, LOG)).filter("xid = 11")), "summary")[0][0]
    assert "2 rows" in text and "2024-01-02 03:00:00" in text


def test_header_times(spark):
    lines = [head(" 3:05:09", 1, "x"), head("3:05:09", 1, "x"), head("23:05:09", 1, "x"),
             "# at 12", "#249999 3:05:09 server id", "text"]
    got = [r[0] for r in frame(spark, lines).orderBy("line_no").select(
        L.log_ts(F.col("line"))).collect()]
    assert [None if t is None else str(t)[11:] for t in got] == [
        "03:05:09", "03:05:09", "23:05:09", None, None, None]


# --- real files ------------------------------------------------------------------------

def _write(folder, name, lines, end="\n"):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        f.write(end.join(lines) + end)
    return path


@pytest.mark.parametrize("block", ["256", "4096", "134217728"])
def test_line_numbers_do_not_depend_on_blocks(spark, tmp_path, block):
    expected = {}
    for name, n in (("a.log", 900), ("b.log", 33), ("c.log", 1)):
        text = [f"{name} {i} {'x' * (i % 50)}" for i in range(n)]
        _write(str(tmp_path), name, text)
        expected.update({t: i + 1 for i, t in enumerate(text)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        got = {r["line"]: r["line_no"]
               for r in read_numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected


def test_log_file_to_transactions(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    _write(str(source), "log.txt", LOG, end="\r\n")
    stored = land_log(spark, str(source), str(tmp_path / "stored"))
    assert stored.lines().count() == len(LOG)
    assert rows(logs.assemble_transactions(stored), *FIELDS) == EXPECTED


def _long_log(transactions=60):
    """A log whose transactions have from none to 40 changed rows, so events and zones overlap."""
    out = ["/*!50530 SET x */;"]
    for i in range(transactions):
        hour = f"{i // 6:2d}"
        out += trx(100 + 1000 * i, i, ["### UPDATE `d`.`t`"] * (i * 7 % 41), start=f"{hour}:00:0{i % 6}",
                   end=f"{hour}:00:0{i % 6 + 1}", lc=i // 3)
    return out


@pytest.mark.parametrize("zone,block,pieces", [(4, "900", 256), (16, "2048", 0), (65536, "134217728", 256)])
def test_landed_windows_equal_plain_ones(spark, tmp_path, monkeypatch, zone, block, pieces):
    monkeypatch.setattr(text, "ZONE_LINES", zone)
    monkeypatch.setattr(logs, "MAX_PIECES", pieces)
    log = _long_log()
    for name in ("a", "b"):
        (tmp_path / "in" / f"file={name}").mkdir(parents=True)
        _write(str(tmp_path / "in" / f"file={name}"), "x.txt", log if name == "a" else log[:400])
    plain = spark.createDataFrame([(f, i, x) for f, part in (("a", log), ("b", log[:400]))
                                   for i, x in enumerate(part, 1)], "file string, line_no long, line string")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        stored = land_log(spark, str(tmp_path / "in"), str(tmp_path / "out"),
                          lambda p: F.regexp_extract(p, "file=([^/]+)", 1))
        # What is read later may be split as it likes.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        assert rows(stored.lines()) == rows(plain)
        found = logs.assemble_transactions(stored, chunk_lines=97)
        assert rows(found) == rows(logs.assemble_transactions(plain))
        assert found.count() == 60 + sum(x == "COMMIT/*!*/;" for x in log[:400])
        for how in ({"start_pos": 5100, "stop_pos": 9101}, {"start_pos": 59100, "stop_pos": 10**9},
                    {"start_pos": 7, "stop_pos": 8}, {"start_ts": "2024-01-02 03:00:01", "stop_ts": "2024-01-02 08:30:00"}):
            assert rows(logs.log_window(stored, **how)) == rows(logs.log_window(plain, **how)), how
        some = found.filter("xid in (5, 6, 17, 40)")
        assert rows(logs.transaction_lines(stored, some)) == rows(logs.transaction_lines(plain, some))
        assert rows(logs.transaction_lines(stored, found)) == rows(logs.transaction_lines(plain, found))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


# --- stream ----------------------------------------------------------------------------

TRX = ("xid", "n_rows", "size", "secs", "start_time", "start_line", "end_line", "last_committed", "sequence_number")


def _feed(spark, tmp_path, batches, mode="strict", file="f"):
    """Run a stream whose batches are these lists of (line_no, line)."""
    source = tmp_path / "in"
    source.mkdir(exist_ok=True)
    for i, part in enumerate(batches):
        path = source / f"{i:03d}.json"
        path.write_text("\n".join(json.dumps({"file": file, "line_no": n, "line": x}) for n, x in part) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(frame(spark, LOG).schema).option("maxFilesPerTrigger", 1).json(str(source))
    stream_transactions(stream, str(tmp_path / "out"), str(tmp_path / "progress"), mode,
                        availableNow=True).awaitTermination()
    return read_transactions(spark, str(tmp_path / "out"))


@pytest.mark.parametrize("mode,cuts", [("strict", ()), ("compat", (4, 9, 20, 21, 50)), ("strict", (4, 9, 20, 21, 50)),
                                       ("strict", tuple(range(1, len(LOG), 30)))])
def test_stream_equals_batch(spark, tmp_path, cuts, mode):
    edges, numbered, batches = [0, *cuts, len(LOG)], list(enumerate(LOG, 1)), []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = numbered[max(a - 2, 0):b]           # two lines are sent twice
        random.Random(i).shuffle(part)
        batches.append(part)
    got = _feed(spark, tmp_path, batches, mode)
    assert rows(got, *TRX) == rows(logs.assemble_transactions(frame(spark, LOG), mode), *TRX)
    assert read_late_lines(spark, str(tmp_path / "out")).count() == 0


def test_late_lines_have_a_table_and_the_stream_goes_on(spark, tmp_path):
    log = _long_log(30)
    numbered = list(enumerate(log, 1))
    third = len(log) // 3
    # The second third comes last, and its first ten lines twice.
    got = _feed(spark, tmp_path, [numbered[:third], numbered[2 * third:], numbered[third:2 * third], numbered[third:third + 10],
                                  [(len(log) + i, x) for i, x in enumerate(trx(90_000, 99, ["### UPDATE `d`.`t`"]), 1)]])
    late = read_late_lines(spark, str(tmp_path / "out"))
    assert rows(late, "line_no", "line") == sorted(numbered[third:2 * third], key=lambda t: str(t[0]))
    rest = spark.createDataFrame([("f", i, x) for i, x in numbered[:third] + numbered[2 * third:]] + [
        ("f", len(log) + i, x) for i, x in enumerate(trx(90_000, 99, ["### UPDATE `d`.`t`"]), 1)],
        "file string, line_no long, line string")
    assert rows(got, *TRX) == rows(logs.assemble_transactions(rest), *TRX)


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    log, folder = _long_log(12), str(tmp_path / "out")
    lines = spark.createDataFrame([(f, i, x) for f in "ab" for i, x in enumerate(log, 1)],
                                  "file string, line_no long, line string")
    cut = len(log) // 2 + 3
    first, second = lines.filter(f"line_no <= {cut}"), lines.filter(f"line_no > {cut} or line_no = 5")
    for batch_id, part in ((0, first), (0, first), (1, second), (1, second)):
        assemble_batch(part, batch_id, folder, chunk_lines=7)
    assert rows(read_transactions(spark, folder), "file", *TRX) == rows(
        logs.assemble_transactions(lines), "file", *TRX)
    assert read_late_lines(spark, folder).count() == 0


def test_commit_marker_inside_a_row_image(spark):
    text = ["# at 100", "#240101 10:00:00 server id 1  end_log_pos 150 CRC32 0x1 \tTable_map: a",
            "BEGIN", "### INSERT INTO `d`.`t`", "###   @1='COMMIT/*!*/;'", "### INSERT INTO `d`.`t`",
            "###   @1='BEGIN'", "#240101 10:00:01 server id 1  end_log_pos 300 CRC32 0x2 \tXid = 7",
            "COMMIT/*!*/;"]
    df = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(text)],
                               "file string, line_no bigint, line string")
    found = logs.assemble_transactions(df).collect()
    assert [(r["n_rows"], r["start_line"], r["end_line"], r["is_complete"]) for r in found] == [(2, 3, 9, True)]
    assert len(logs.assemble_transactions(df, "compat").collect()) == 2


# --- shares of work --------------------------------------------------------------------

def test_a_log_may_come_in_parts(spark, tmp_path):
    """Parts of a log follow each other by name; compressed ones are read whole."""
    log = _long_log(30)
    for part, lines in (("part=000000000001", log[700:]), ("part=000000000000", log[:700])):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.option(
            "compression", "gzip").text(str(tmp_path / "in" / "file=a" / part))
    stored = land_log(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda p: F.regexp_extract(p, "/file=([^/]+)/", 1))
    plain = frame(spark, log, "a")
    assert rows(stored.lines()) == rows(plain) and stored.n_lines() == len(log)
    assert rows(logs.assemble_transactions(stored)) == rows(logs.assemble_transactions(plain))


def test_files_of_the_rendered_log_are_bounded(spark, monkeypatch, tmp_path):
    """No task puts a whole log in order: its text files end after so many lines."""
    monkeypatch.setattr(views, "_landed", {})
    monkeypatch.setattr(views, "PART_LINES", 500)
    monkeypatch.setattr(views, "PIECE_LINES", 64)
    sf_dir = str(tmp_path)
    spark.range(60).selectExpr("id as o_orderkey", "id % 2 as o_custkey").write.parquet(f"{sf_dir}/orders.parquet")
    spark.range(3000).selectExpr("if(id < 1500, 7, id % 60) as l_orderkey", "'N' as l_returnflag", "1.0d as l_quantity").write.parquet(
        f"{sf_dir}/lineitem.parquet")
    log = views.landed_log(spark, sf_dir)
    assert rows(log.lines()) == rows(views.view(spark, sf_dir, "m7_lines"))
    sizes = [r["count"] for r in log.stored.groupBy("path").count().collect()]
    assert max(sizes) <= 500 + 64 and len(sizes) > 6


def test_shares_follow_the_lines(spark, tmp_path, monkeypatch):
    """What is dealt out has partitions by lines, not by bytes."""
    monkeypatch.setattr(logs, "CHUNK_LINES", 50)
    (tmp_path / "in" / "file=a").mkdir(parents=True)
    _write(str(tmp_path / "in" / "file=a"), "x.txt", _long_log())
    stored = land_log(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda p: F.regexp_extract(p, "file=([^/]+)", 1))
    n = stored.n_lines() // 50 + 2
    plan = logs.assemble_transactions(stored, chunk_lines=50)._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(file#\d+, (?:chunk|commit_ord)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)) == {str(n)}
    assert not re.search(r"hashpartitioning\([^\n]*begin_ord", plan)


@pytest.mark.parametrize("carried", [0, 100])
def test_many_spans_equal_few(spark, tmp_path, monkeypatch, carried):
    """Spans that are broadcast, and spans that meet the lines by bucket of ids alone, over two
    logs whose parts have the same file blocks."""
    monkeypatch.setattr(logs, "MAX_PIECES", 0)
    monkeypatch.setattr(logs, "MAX_CARRIED", carried)
    log = _long_log(20)
    for name in "ab":
        (tmp_path / "in" / f"file={name}").mkdir(parents=True)
        _write(str(tmp_path / "in" / f"file={name}"), "1.txt", log[:150])
        _write(str(tmp_path / "in" / f"file={name}"), "2.txt", log[150:])
    stored = land_log(spark, str(tmp_path / "in"), str(tmp_path / "out"), lambda p: F.regexp_extract(p, "file=([^/]+)", 1))
    plain = frame(spark, log, "a").unionByName(frame(spark, log, "b"))
    found = logs.assemble_transactions(plain).filter("xid % 3 <> 1")
    assert rows(logs.transaction_lines(stored, found)) == rows(logs.transaction_lines(plain, found))


def test_last_cells_over_chunks(spark):
    """Rolled-back BEGINs and cells that go on into later chunks, with lines sent twice."""
    log = ROLLED_BACK + ROLLED_BACK + NORMAL + ROLLED_BACK + LATE[:9] + ROLLED_BACK + ZERO
    want = rows(logs.assemble_transactions(frame(spark, log)))
    marks = logs.log_marks(frame(spark, log).unionByName(frame(spark, log)))
    for chunk in (1, 4, 11):
        assert rows(logs.assemble_transactions(frame(spark, log), chunk_lines=chunk)) == want
        parts = logs.cells(marks, chunk, 3, repeated=True)
        assert rows(logs.closed_segments(logs.segments(logs.merged_cells(parts, 3)))) == want


ODD_LINES = ["BEGIN", " BEGIN\t", "BEGIN x", "# BEGIN", "### BEGIN", "COMMIT/*!*/;", "# COMMIT/*!*/;", "### COMMIT/*!*/;",
             "### INSERT INTO `a`.`b`", "### UPDATE `a`", "### DELETE FROM x", "#### INSERT INTO", "## INSERT INTO", "UPDATE x",
             "# at 5", "# at 12345678901234567890", "# at x", "###   @1='end_log_pos 7 Xid = 4'", "", None, "#",
             "#240101  0:00:05 server id 1  end_log_pos 65 CRC32 0x0 \tTable_map: `d`.`t` Xid",
             "#240101 0:00:05 server id 1  end_log_pos 123456789012345678901 Xid = 00000000000000000000007",
             "end_log_pos x end_log_pos  12 Xid = 3", "#x last_committed= last_committed=8\tsequence_number=9x",
             "#x Table_map last_committed=123456789012345678901 last_committed=4 sequence_number=-1 sequence_number=2"]


@pytest.mark.parametrize("mode", ["strict", "compat"])
def test_flags_and_numbers_of_odd_lines(spark, mode):
    def number(found):
        return int(found[1]) if found and len(found[1]) < 20 and int(found[1]) < 2**63 else None

    numbered = [(n, s) for n, s in enumerate(ODD_LINES, 1)]
    marks = logs.log_marks(spark.createDataFrame(numbered, "line_no long, line string").withColumn("file", F.lit("f")), mode)
    got = {r.line_no: (r["mask"], r.end_pos, r.last_committed, r.sequence_number) for r in marks.collect()}
    want = {}
    for n, s in numbered:
        if s is None:
            continue
        strict, image = mode == "strict", s.startswith("###")
        hashed = s.startswith("#") and not (strict and image)
        head = hashed or not strict
        words = ("### UPDATE", "### INSERT INTO", "### DELETE FROM") if strict else ("UPDATE", "INSERT", "DELETE")
        flags = [s.strip(" \t\r\n") == "BEGIN", "COMMIT/*!*/;" in s and not (strict and image),
                 any(s.startswith(w) if strict else w in s for w in words), hashed,
                 head and "end_log_pos" in s and "Table_map" in s, head and "end_log_pos" in s and "Xid" in s,
                 head and "last_committed" in s and "sequence_number" in s]
        if any(flags):
            want[n] = (sum(f << i for i, f in enumerate(flags)),
                       number(re.search(r"end_log_pos\s+(\d+)", s)) if flags[5] else None,
                       number(re.search(r"last_committed=(\d+)", s)) if flags[6] else None,
                       number(re.search(r"sequence_number=(\d+)", s)) if flags[6] else None)
    assert got == want


def test_marks_of_a_chunk_stay_rows_in_a_window(spark):
    assert logs.ORDER_LINES <= int(spark.conf.get("spark.sql.windowExec.buffer.in.memory.threshold"))
    lines = spark.createDataFrame([("f", 1, "BEGIN")], "file string, line_no long, line string")
    assert str(logs.ORDER_LINES) in logs.cells(logs.log_marks(lines))._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("width", [8, 4096])
def test_piece_text_is_the_lines(spark, monkeypatch, width):
    monkeypatch.setattr(views, "PIECE_LINES", width)
    trx = spark.createDataFrame(
        [(7, 1, 1, 0, 0, 17, 0, 3, 0, 0), (9, 1, 30, 12, 9, None, 8, 90, 82, 9), (90001, 1, 8, 8, 0, 4, 90000, 24, 147, 47),
         (90002, 1, 5, 0, 2, 4, 90000, 200000, 216, 63)],
        "xid long, log_no long, n_rows long, n_ins long, n_upd long, size long, last_committed long, secs long, pos long, base long")
    monkeypatch.setattr(views, "_placed", lambda spark, sf_dir: trx)
    pieces = views._line_pieces(spark, "")
    texts = views._timed(pieces).select("first", views._piece_text().alias("text")).orderBy("first").collect()
    lines = views._lines(spark, "").orderBy("line_no").collect()
    assert [line for r in texts for line in r.text.split("\n")] == [r.line or "" for r in lines]
    assert len(lines) == sum(n + 8 for n in (1, 30, 8, 5))

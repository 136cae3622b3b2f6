"""Classification, diagnosis, blockers and actions on small hand-made snapshots."""

import datetime

import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetlens.operators import diagnosis, locks, threads
from fleetlens.schemas import INNODB_TRX, LOCK_WAITS, LOCKS, OPEN_TABLES, PROCESSLIST
from fleetlens.sources import tables as src

MDL = "Waiting for table metadata lock"
NOW = datetime.datetime(2024, 1, 1)


def plist(spark, items):
    """Items: (id, state, info[, user, command, time])."""
    full = []
    for i in items:
        user, command, time = (list(i[3:]) + ["app", "Query", 100][len(i) - 3:])[:3]
        full.append((1, NOW, i[0], user, "h", "d", command, time, i[1], i[2], 0, 0))
    return spark.createDataFrame(full, PROCESSLIST)


def facts(spark, version="8.0.1", ps="ON", mdl="YES", replica="NO"):
    kv = [(1, "version", version), (1, "performance_schema", ps),
          (1, "mdl_instrument", mdl), (1, "is_replica", replica)]
    return diagnosis.server_facts(spark.createDataFrame(
        kv, "instance bigint, name string, value string"))


def open_tables(spark, n=0):
    return spark.createDataFrame([(1, NOW, "d", f"t{i}", 1) for i in range(n)], OPEN_TABLES)


def no_trx(spark):
    return spark.createDataFrame([], INNODB_TRX)


def no_waits(spark, *blocked):
    return spark.createDataFrame([(1, NOW, b) for b in blocked],
                                 "instance bigint, snapshot_ts timestamp_ntz, "
                                 "waiting_thread bigint")


def diagnose(spark, pl, known=None, opened=0, waits=(), trx=None):
    return diagnosis.diagnose_threads(
        pl, known if known is not None else facts(spark), open_tables(spark, opened),
        trx if trx is not None else no_trx(spark), no_waits(spark, *waits))


@pytest.mark.parametrize("info,state,user,kind,strict", [
    ("update t set a=1", None, "app", "dml", "other"),
    ("DELETE from t", "updating", "app", "dml", "dml"),
    ("insert into t values (1)", "update", "app", "dml", "dml"),
    ("insert into t values (1)", None, "app", "other", "other"),
    ("select 1", "Sending data", "app", "select", "select"),
    ("select 1", "login", "app", "login", "login"),
    ("select 1", "sending data", "app", "other", "other"),
    ("truncate table t", "rename", "app", "ddl", "ddl"),
    ("commit", None, "app", "commit", "commit"),
    ("Commit", None, "app", "other", "other"),
    ("show status", None, "unauthenticated user", "unauthenticated", "unauthenticated"),
    (None, "login", "unauthenticated user", "skipped", "skipped"),
    ("", "login", "app", "skipped", "skipped")])
def test_class(spark, info, state, user, kind, strict):
    pl = plist(spark, [(1, state, info, user)])
    assert rows(threads.classify_threads(pl), "class") == [(kind,)]
    assert rows(threads.classify_threads(pl, strict_dml=True), "class") == [(strict,)]


def test_null_statements_can_be_counted(spark):
    pl = plist(spark, [(1, "login", None, "unauthenticated user"), (2, "login", None),
                       (3, None, None)])
    got = threads.classify_threads(pl, count_null_info=True)
    assert rows(got, "id", "class") == [(1, "unauthenticated"), (2, "login"),
                                        (3, "skipped")]


def test_active_filter(spark):
    pl = plist(spark, [(1, None, "x"), (2, None, "x", "system user"),
                       (3, None, "x", "app", "Sleep"), (4, None, "x", "app", "Query", 9),
                       (5, None, "x", None), (6, None, "x", "app", "Query", 10)])
    assert rows(threads.active_threads(pl), "id") == [(1,), (6,)]


def findings(df):
    return rows(df, "id", "finding", "visibility", "trx_problem", "query_problem")


@pytest.mark.parametrize("rule", diagnosis.RULES, ids=lambda r: r[0])
def test_rule(spark, rule):
    state, finding, _, shown, ladder, t, q = rule
    got = diagnose(spark, plist(spark, [(1, state, "select 1")])).collect()
    assert [(r["finding"], r["trx_problem"], r["query_problem"]) for r in got] == [
        (finding, t, q)]
    assert got[0]["detail"] == ("select 1" if shown else None)
    assert got[0]["visibility"] == (None if ladder == "none" else "show_holders")


def test_states_without_finding(spark):
    assert diagnose(spark, plist(spark, [(1, "Waiting for tables", "x"),
                                         (2, None, "x")])).count() == 0


@pytest.mark.parametrize("ps,mdl,plain,flush", [
    ("ON", "YES", "show_holders", "show_holders"),
    ("ON", "NO", "instrument_disabled", "instrument_disabled"),
    ("OFF", "YES", "performance_schema_off", "performance_schema_off"),
    ("OFF", "NO", "instrument_disabled", "instrument_disabled"),
    ("OFF", "TIMED", "performance_schema_off", "instrument_disabled"),
    ("ON", "TIMED", None, "instrument_disabled")])
def test_ladder(spark, ps, mdl, plain, flush):
    got = diagnosis.mdl_visibility(facts(spark, ps=ps, mdl=mdl))
    assert rows(got, "visibility", "flush_visibility") == [(plain, flush)]


def test_global_read_lock(spark):
    pl = plist(spark, [(1, diagnosis.GLOBAL_READ_LOCK, diagnosis.FLUSH_STATEMENT),
                       (2, diagnosis.GLOBAL_READ_LOCK, "update t set a=1"),
                       (3, diagnosis.GLOBAL_READ_LOCK, None)])
    assert findings(diagnose(spark, pl)) == [
        (1, "flush_is_waiting", None, True, True),
        (2, "blocked_by_flush", "show_holders", False, False),
        (3, "blocked_by_flush", "show_holders", False, False)]
    assert findings(diagnose(spark, pl, opened=2))[1] == (
        2, "blocked_by_long_query", None, True, True)


def test_updating(spark):
    pl = plist(spark, [(1, "updating", "update t set a=1"), (2, "updating", "delete x")])
    assert findings(diagnose(spark, pl, waits=(1, 1))) == [
        (1, "dml_blocked", None, True, False), (2, "dml_may_block", None, False, False)]
    old = facts(spark, version="10.4")
    assert {r[1] for r in findings(diagnose(spark, pl, known=old, waits=(1,)))} == {
        "unsupported_version"}


def test_metadata_lock_waiters(spark):
    pl = plist(spark, [
        (1, MDL, "alter table t1 add c int"), (2, "updating", "update t1 set a=1"),
        (3, MDL, "update t9 set a=1"), (4, MDL, "select * from order"),
        (5, "updating", "update t10 set a=1"), (6, MDL, None)])
    mdl = [f for f in findings(diagnose(spark, pl)) if f[0] in (1, 3, 4, 6)]
    assert mdl == [(1, "mdl_blocked", None, True, False),
                   (3, "mdl_blocker_unknown", None, True, True),     # only itself
                   (4, "table_name_unreadable", None, False, False),
                   (6, "table_name_unreadable", None, False, False)]


def brute_blockers(pl, trx, contains):
    """Number of other threads' statements per waiter, pair by pair."""
    import re
    out = {}
    stmts = [(r["id"], r["info"]) for r in pl if r["class"] in threads.LONG_CLASSES]
    stmts += [(r["thread_id"], r["trx_query"]) for r in trx if r["trx_query"]]
    for r in pl:
        if r["state"] != MDL:
            continue
        name = re.search(r"t\d+\w*", r["info"]).group(0)
        out[r["id"]] = sum(
            1 for i, s in stmts if i != r["id"] and
            (name in s if contains else re.search(rf"\b{name}\b", s)))
    return out


@pytest.mark.parametrize("mode", ["exact", "contains"])
def test_blockers_against_brute_force(spark, mode):
    pl = plist(spark, [(i, MDL if i % 3 == 0 else "updating",
                        f"update t{i % 12}{'_abc' if i % 4 == 0 else ''} set a={i}")
                       for i in range(60)])
    trx = spark.createDataFrame(
        [(1, None, 1000 + i, "RUNNING", None, None, None, i % 9,
          None if i % 5 == 0 else f"delete from t{i % 7}", 0, 0, "", 0)
         for i in range(25)], INNODB_TRX)
    classified = threads.classify_threads(pl)
    statements = locks.blocker_statements(classified, trx).drop("snapshot_ts")
    waiters = locks.mdl_waiters(pl).drop("snapshot_ts")
    got = dict(rows(locks.waiter_blockers(waiters, statements, mode), "id", "n_blockers"))
    assert got == brute_blockers(classified.collect(), trx.collect(), mode == "contains")
    total = sum(r[0] for r in rows(
        locks.blockers_by_table(waiters, statements, mode), "n_waiters"))
    assert total == sum(got.values())


def test_contains_is_linear_in_the_text(spark):
    """A megabyte of text in long and short runs, and ten thousand names that begin alike."""
    names = [f"customer_{i:05d}" for i in range(10_000)]
    text = " ".join(f"x{n}y" for n in names[::3]) + " 0x" + "A7" * 400_000 + names[5000] + "B" * 300
    waiters = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "instance long, id long, table_name string")
    statements = spark.createDataFrame([(1, "dml", 7, 20_000, text), (1, "dml", 8, 20_001, "select 1")],
                                       "instance long, kind string, blocker_id long, thread_id long, statement string")
    start = time.perf_counter()
    got = dict(rows(locks.waiter_blockers(waiters, statements, "contains"), "table_name", "n_blockers"))
    assert time.perf_counter() - start < 90
    assert got == {n: int(n in text) for n in names} and sum(got.values()) == 3335


def test_contains_with_odd_names(spark):
    long = "n" * 300
    names = ["a b", "`", "-x-", "é", "t", "t1", long, long + "é", "b", "A B", "x" * 64 + "-" + "y" * 70, "  "]
    texts = ["select * from `a b`", "t10-x-", "tÉé", "p" + long + "éq", "x" * 64 + "-" + "y" * 70, "", "a  b", "x" * 700 + long]
    waiters = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "instance long, id long, table_name string")
    statements = spark.createDataFrame([(1, "dml", i, 100 + i % 3, x) for i, x in enumerate(texts)],
                                       "instance long, kind string, blocker_id long, thread_id long, statement string")
    got = dict(rows(locks.waiter_blockers(waiters, statements, "contains"), "table_name", "n_blockers"))
    assert got == {n: sum(n in x for x in texts) for n in names}


def test_diagnosis_reads_the_process_list_once(spark, sf_dir):
    from workload.queries import QUERIES
    text = QUERIES["q_diagnose_threads"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("FileScan", text)) <= 7
    assert len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single)", text)) < 10
    assert "user:string" not in "".join(re.findall(r"ReadSchema: [^\n]*", text))


def test_rules_can_be_replaced(spark):
    own = spark.createDataFrame([("login", "slow_login", "look", True, "plain", False, True),
                                 ("login", "second", "look", False, "none", True, False)],
                                "state string, finding string, advice string, shows_statement boolean, "
                                "ladder string, trx_problem boolean, query_problem boolean")
    pl = threads.classify_threads(plist(spark, [(1, "login", "x"), (2, "updating", "update t set a=1")]))
    got = diagnosis.diagnose_threads(pl, facts(spark), open_tables(spark), no_trx(spark), no_waits(spark), own)
    assert findings(got) == [(1, "second", None, True, False), (1, "slow_login", "show_holders", False, True),
                             (2, "dml_may_block", None, False, False)]


def test_layouts_of_a_mixed_fleet(spark):
    waits = spark.createDataFrame([(1, "r", "b", "l", None, None, None), (2, None, None, None, "r8", "b8", "l8"),
                                   (3, "x", "y", "z", "x", "y", "z"), (4, "x", "y", "z", None, None, None)],
                                  "instance long, requesting_trx_id string, blocking_trx_id string, requested_lock_id string, "
                                  "requesting_engine_transaction_id string, blocking_engine_transaction_id string, "
                                  "requesting_engine_lock_id string")
    known = spark.createDataFrame([(1, "5.x"), (2, "8.x"), (3, None)], "instance long, version_family string")
    read, unread = locks.dispatch_layouts(waits, known, locks.WAIT_LAYOUTS)
    assert rows(read, "instance", "requesting", "blocking", "lock_id") == [(1, "r", "b", "l"), (2, "r8", "b8", "l8")]
    assert rows(unread, "instance", "n_rows", "finding") == [(3, 1, "unsupported_version"), (4, 1, "unsupported_version")]
    trx = spark.createDataFrame([(1, 7), (3, 8)], "instance long, trx_mysql_thread_id long")
    assert rows(locks.dispatch_layouts(trx, known, locks.TRX_LAYOUTS)[0], "instance", "thread_id", "trx_id") == [(1, 7, None)]


def test_opening_tables(spark):
    many = [(i, "Opening tables", "select 1") for i in range(11)]
    assert {f[1] for f in findings(diagnose(spark, plist(spark, many)))} == {
        "table_cache_pressure"}
    ten = many[:10] + [(50, "altering table", "drop table t")]
    got = [f[1] for f in findings(diagnose(spark, plist(spark, ten))) if f[0] < 50]
    assert got == ["long_ddl_running"] * 10


def long_trx(spark, *thread_ids):
    return spark.createDataFrame(
        [(1, None, 900 + t, "RUNNING", None, None, None, t, "update z", 0, 0, "", 0)
         for t in thread_ids], INNODB_TRX)


def actions(spark, items, replica="NO", trx=()):
    pl = plist(spark, items).drop("snapshot_ts")
    long = long_trx(spark, *trx).drop("snapshot_ts")
    known = facts(spark, replica=replica)
    found = diagnosis.diagnose_threads(pl, known, open_tables(spark), long,
                                       no_waits(spark).drop("snapshot_ts"))
    return rows(diagnosis.action_candidates(
        threads.classify_threads(pl), long, diagnosis.problem_flags(found), known),
        "id", "class")


ITEMS = [(1, "System lock", "commit"), (2, "executing", "select 1"),
         (3, "updating", "update t set a=1"), (4, "altering table", "alter table t x"),
         (5, "login", "show status")]


def test_actions(spark):
    assert actions(spark, ITEMS, trx=(3, 7, 7)) == [
        (2, "select"), (3, "transaction"), (4, "ddl"), (7, "transaction")]
    assert actions(spark, ITEMS, replica="YES", trx=(3, 7)) == [(2, "select")]
    assert actions(spark, ITEMS[1:], trx=(3, 7)) == []          # no flag is up


def test_revalidate(spark):
    candidates = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 4)],
                                       "instance bigint, id bigint")
    fresh = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (1, 3, ""), (2, 4, "x")],
                                  "instance bigint, id bigint, info string")
    assert rows(threads.revalidate(candidates, fresh), "id", "status") == [
        (1, "actionable"), (2, "query_ended"), (3, "query_ended"), (4, "gone")]


def test_verdict(spark):
    pl = spark.createDataFrame(
        [(i, "app", "Query" if i == 1 else "Sleep", 50) for i in (1, 2, 3)],
        "instance bigint, user string, command string, time bigint")
    trx = spark.createDataFrame([(1,), (2,)], "instance bigint")
    assert rows(threads.server_verdict(pl, trx), "instance", "verdict") == [
        (1, "analyse"), (2, "uncommitted_transactions"), (3, "healthy")]


def test_top_threads_and_truncation(spark):
    pl = plist(spark, [(i, "updating", "update t", "app", "Query", t)
                       for i, t in ((1, 20), (2, 30), (3, 30), (4, None))])
    top = threads.top_threads(threads.classify_threads(pl).drop("snapshot_ts"), 2)
    assert [(r["id"], r["rank"], r["truncated"]) for r in top.orderBy("rank").collect()] \
        == [(2, 1, True), (3, 2, True)]


def test_long_transactions_are_strictly_older(spark):
    trx = spark.sql("""select 1L instance, id trx_id, id thread_id, cast(t as timestamp_ntz)
        trx_started from values (1L, '2024-01-01 00:00:00'), (2L, '2024-01-01 00:00:50'),
        (3L, '2024-01-01 00:00:49') v(id, t)""")
    pl = spark.sql("select 1L instance, id, 'u' user, 'h' host, 'd' db, 'i' info "
                   "from range(10)")
    got = locks.long_transactions(trx, pl, "2024-01-01 00:01:00")
    assert rows(got, "trx_id", "age") == [(1, 60), (3, 11)]


def test_lock_waits_without_owner(spark):
    trx = spark.createDataFrame(
        [(1, None, t, "RUNNING", None, None, None, th, "q", 0, 0, "", 0)
         for t, th in ((10, 1), (11, 2))], INNODB_TRX).drop("snapshot_ts")
    waits = spark.createDataFrame([(1, None, 11, 10, 5)], LOCK_WAITS).drop("snapshot_ts")
    held = spark.createDataFrame([(1, None, 5, "X", "RECORD", "t", None)],
                                 LOCKS).drop("snapshot_ts")
    pl = plist(spark, [(1, None, None, "u", "Sleep", 77)]).drop("snapshot_ts")
    got = locks.lock_waits(waits, trx, held, pl, "2024-01-01 00:00:00").collect()[0]
    assert (got["waiting_thread"], got["blocking_thread"]) == (2, 1)
    assert got["blocking_status"] == "Sleep 77" and got["waiting_user"] is None
    assert got["lock_info"] is None          # a NULL index name makes the text NULL


def test_conform(spark):
    df = spark.createDataFrame([("1", "x")], "ID string, extra string")
    with pytest.raises(ValueError, match="user"):
        src.scan_processlist(df)
    wide = plist(spark, [(1, "s", "i")]).withColumn("more", F.lit(1))
    assert src.scan_processlist(wide).columns == PROCESSLIST.fieldNames()

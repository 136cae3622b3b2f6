"""Backup rules, replication trees, sources, sinks and the policy feed."""

import hashlib
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetlens.operators import backup, topology
from fleetlens.operators.ranges import time_range
from fleetlens.schemas import LEDGER
from fleetlens.session import ensure_checkpoint_dir
from fleetlens.sources import tables as src
from fleetlens.sources.files import file_manifest
from fleetlens.streaming import versions
from fleetlens.streaming.health import read_installed_jobs, read_policy_actions, stream_policy_changes, take_policies

BOTH = "Slave_IO_Running: Yes\nSlave_SQL_Running: Yes"


@pytest.mark.parametrize("text,master,broken", [
    ("", True, False), (None, True, False), (BOTH, False, False),
    (BOTH.replace("SQL_Running: Yes", "SQL_Running: No"), True, True),
    ("Last_Error: a: b\n" + BOTH, False, False),
    ("Slave_IO_Running: No\n" + BOTH, False, False),
    ("no colon here", True, False)])
def test_master(spark, text, master, broken):
    df = spark.createDataFrame([(1, text)], "instance_port bigint, status_text string")
    assert rows(backup.is_master(df), "is_master", "replica_broken") == [(master, broken)]


def test_status_rows(spark):
    df = spark.createDataFrame([(1, "k: 1\n e : x: y \nk: 2\nnone")],
                               "p bigint, status_text string")
    assert rows(backup.parse_replica_status(df)) == [(1, "e", "x: y"), (1, "k", "2")]


HOSTS = "instance_port bigint, instance_ip string"


def test_gate_order(spark):
    hosts = spark.createDataFrame(
        [(1, "a", True), (2, "a", False), (3, "a", False), (4, "a", False), (5, "a", False)],
        HOSTS + ", is_master boolean")
    ledger = spark.sql("""select port instance_port, ip instance_ip,
        cast(d as timestamp_ntz) backup_day from values (1L, 'b', '2024-01-02'),
        (2L, 'b', '2024-01-02'), (3L, 'b', '2024-01-01'), (4L, 'b', '2024-01-02'),
        (4L, 'a', '2024-01-02') v(port, ip, d)""")
    running = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], HOSTS)
    got = backup.backup_gate(hosts, ledger, running, "2024-01-02 10:00:00")
    assert [r[1] for r in rows(got, "instance_port", "gate_stage")] == [
        "check_master", "is_backuped", "check_pre_job", "run", "run"]


def test_chain(spark):
    runs = spark.sql("""select 1L instance_port, 'a' instance_ip,
        cast(to_date(t) as timestamp_ntz) backup_day, cast(t as timestamp_ntz) stage_ts,
        id run_id, id * 10 to_lsn, tool backup_tool from values
        ('2024-01-01 01:00:00', 1L, 'xtra'), ('2024-01-01 01:30:00', 2L, 'xtra'),
        ('2024-01-01 09:00:00', 3L, 'xtra'), ('2024-01-01 10:00:00', 4L, 'mysqldump'),
        ('2024-01-02 00:00:00', 5L, 'xtra') v(t, id, tool)""")
    assert rows(backup.backup_chain(runs), "run_id", "base_lsn", "backup_type") == [
        (1, None, "full"), (2, 10, "incremental"), (3, 20, "incremental"),
        (4, None, "full"), (5, None, "full")]


def test_checkpoint_last_line_wins(spark):
    lines = spark.createDataFrame(
        [(1, 1, "to_lsn = 5"), (1, 3, "to_lsn = 2"), (1, 2, "to_lsn = 9"),
         (1, 4, "from_lsn = 77"), (2, 1, "to_lsn = x")], "k bigint, line_no bigint, line string")
    assert rows(backup.last_checkpoint_lsn(lines, ("k",))) == [(1, 2), (2, None)]


def test_expiry_and_default_retention(spark):
    ledger = spark.sql("""select p instance_port, 'a' instance_ip,
        cast('2024-01-01' as timestamp_ntz) backup_day, del isdelete
        from values (1L, 'no'), (2L, 'no'), (3L, 'yes') v(p, del)""")
    policy = spark.createDataFrame([(1, "a", 5)], "backup_port bigint, backup_ip string, "
                                   "backup_retention bigint")
    got = backup.expired_backups(ledger, policy, "2024-01-07 12:00:00")
    assert rows(got, "instance_port", "retention_days") == [(1, 5)]
    assert backup.expired_backups(ledger, policy, "2024-01-06 00:00:00").count() == 0
    later = backup.expired_backups(ledger, policy, "2024-02-05 00:00:00")
    assert rows(later, "instance_port", "retention_days") == [(1, 5), (2, 30)]


# --- topology --------------------------------------------------------------------------

# Two trees of uneven depth in one cluster, listed leaves first.
SHAPE = [("leaf-3", "mid-2"), ("leaf-2", "mid-1"), ("leaf-1", "mid-1"), ("mid-2", "mid-1"),
         ("mid-1", "top-a"), ("solo", "top-b"), ("top-b", None), ("top-a", "")]


def instances(spark, *clusters):
    return spark.createDataFrame([(c, ip, 3306, m) for c, nodes in clusters
                                  for ip, m in nodes],
                                 "cluster string, ip string, port bigint, master_ip string")


def test_golden_tree(spark):
    tree = topology.replication_tree(instances(spark, ("c", SHAPE)))
    printed = [(r["level"], r["ip"]) for r in topology.depth_first(tree).collect()]
    assert printed == [(0, "top-a"), (1, "mid-1"), (2, "leaf-1"), (2, "leaf-2"), (2, "mid-2"),
                       (3, "leaf-3"), (0, "top-b"), (1, "solo")]
    assert topology.tree_anomalies(instances(spark, ("c", SHAPE))).count() == 0


def test_roots_orphans_cycles_and_equal_addresses(spark):
    data = instances(
        spark, ("c1", [*SHAPE, ("r2", ""), ("s2", "r2"), ("lost", "nowhere"),
                       ("below_lost", "lost"), ("x", "z"), ("y", "x"), ("z", "y"),
                       ("below_cycle", "z"), ("self", "self")]),
        ("c2", [("top-a", "solo"), ("solo", None)]))
    tree = topology.replication_tree(data)
    assert {(r["cluster"], r["root"]) for r in tree.collect()} == {
        ("c1", "top-a"), ("c1", "top-b"), ("c1", "r2"), ("c2", "solo")}
    assert rows(topology.tree_anomalies(data), "ip", "anomaly") == [
        ("below_cycle", "cycle"), ("below_lost", "orphan"), ("lost", "orphan"),
        ("self", "cycle"), ("x", "cycle"), ("y", "cycle"), ("z", "cycle")]


def test_repeated_nodes_do_not_multiply(spark):
    data = instances(spark, ("c", [("r", None), ("a", "r"), ("a", "r"), ("b", "a"), ("b", "a"),
                                   ("d", "b"), ("e", "r"), ("e", "a")]))
    tree = topology.replication_tree(data)
    assert rows(tree, "ip", "level") == [("a", 1), ("b", 2), ("d", 3), ("e", 2), ("r", 0)]
    assert rows(topology.tree_anomalies(data), "ip", "anomaly") == [("e", "masters")]


def test_deep_chain_needs_few_rounds(spark):
    chain = [(f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(150)]
    tree = topology.replication_tree(instances(spark, ("c", chain)))
    assert tree.agg(F.max("level"), F.count("*")).collect()[0] == (149, 150)


# --- sources and sinks -----------------------------------------------------------------

def test_ledger_append_and_read(spark, tmp_path):
    path = str(tmp_path / "ledger")
    day = "cast('2024-01-0{}' as timestamp_ntz)"
    for d in (1, 2):
        one = spark.range(5).select(*[
            (F.expr(day.format(d)) if f.name == "backup_day" else
             F.col("id") if f.name == "instance_port" else
             F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER])
        src.append_ledger(one, path)
    got = src.read_ledger(spark, path)
    assert got.columns == LEDGER.fieldNames() and got.count() == 10
    assert src.read_ledger(spark, path, since="2024-01-02").count() == 5


def test_manifest_of_files(spark, tmp_path):
    import hashlib
    (tmp_path / "a").write_bytes(b"hello")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b").write_bytes(b"")
    got = {os.path.basename(r["file"]): (r["size_bytes"], r["checksum"])
           for r in file_manifest(spark, str(tmp_path)).collect()}
    assert got == {"a": (5, hashlib.md5(b"hello").hexdigest()),
                   "b": (0, hashlib.md5(b"").hexdigest())}


def test_jdbc_options():
    got = src.jdbc_options("jdbc:x://h/d", "t", "id", 0, 100, partitions=4)
    assert got["partitionColumn"] == "id" and got["numPartitions"] == "4"
    assert "partitionColumn" not in src.jdbc_options("u", "t")
    with pytest.raises(ValueError):
        src.jdbc_options("u", "t", "id")


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "text"])
def test_report_sink(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a",), ("b",)], "value string")
    src.write_report(df, str(tmp_path / "out"), fmt)
    reader = spark.read.option("header", "true") if fmt == "csv" else spark.read
    assert rows(reader.format(fmt).load(str(tmp_path / "out"))) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        src.write_report(df, str(tmp_path / "out"), "xml")


def test_odd_checkpoint_lines(spark):
    lines = spark.createDataFrame([("k", 1, "to_lsn = 7"), ("k", 2, "no to_lsn here"),
                                   ("m", 1, "to_lsn missing")], "k string, line_no bigint, line string")
    assert rows(backup.last_checkpoint_lsn(lines, ("k",)))[-1] == ("m", None)


def test_two_policies_of_a_host(spark):
    ledger = spark.sql("""select 1L as instance_port, 'a' as instance_ip, t as backup_type,
        timestamp_ntz '2024-01-01 00:00:00' as backup_day, 'no' as isdelete
        from values ('full'), ('incremental') v(t)""")
    policy = spark.createDataFrame([(1, "a", "full", 7, "c1"), (1, "a", "incremental", 2, "c2")],
                                   "backup_port bigint, backup_ip string, backup_type string, "
                                   "backup_retention bigint, backup_cron string")
    got = backup.expired_backups(ledger, policy, "2024-01-20 00:00:00")
    assert rows(got, "backup_type", "retention_days") == [("full", 7), ("incremental", 2)]
    assert backup.policy_sync(policy, policy).count() == 0


def test_manifest_lists_folders_and_hashes_ranges(spark, tmp_path):
    contents = {"top": b"y", "empty": b"", "a/b/c/deep": b"z" * 25, "a/b/x y+%20.bak": bytes(range(256)) * 4,
                "a/exact": b"e" * 10, "b/edge": b"e" * 11}
    for name, data in contents.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    (tmp_path / "in" / "nothing" / "here").mkdir(parents=True)

    def plain(data):
        sums = [hashlib.md5(data[i:i + 10]).hexdigest() for i in range(0, len(data), 10)]
        return (hashlib.md5(data).hexdigest(), "content") if len(data) <= 10 else (
            hashlib.md5("".join(sums).encode()).hexdigest(), "ranges")
    for address in (str(tmp_path / "in"), f"file://{tmp_path}/in"):
        found = file_manifest(spark, address, range_bytes=10).collect()
        assert {r.file.split("/in/")[1]: (r.size_bytes, r.checksum, r.checksum_of) for r in found} == {
            n: (len(d), *plain(d)) for n, d in contents.items()}
        assert all(r.file.startswith(address) for r in found)


def test_policy_sync_of_many_jobs(spark):
    """Without types a host's jobs are a multiset."""
    schema = "backup_port long, backup_ip string, backup_cron string"
    wanted = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "x"), (2, "a", "x"), (3, "a", "n"), (5, "a", None)], schema)
    present = spark.createDataFrame([(1, "a", "y"), (1, "a", "x"), (2, "a", "x"), (2, "a", "z"), (2, "a", "q"), (4, "a", "o"),
                                     (5, "a", None)], schema)
    assert rows(backup.policy_sync(wanted, present), "backup_port", "policy_cron", "installed_cron", "action") == [
        (2, None, "z", "remove"), (2, "x", "q", "change"), (3, "n", None, "add"), (4, None, "o", "remove")]
    assert backup.policy_sync(wanted.withColumn("backup_type", F.lit("full")), wanted).count() == 0


def test_contracts_keep_the_moment(spark):
    v = spark.sql("""select 1L as instance, t as snapshot_ts, 'a' as name, x as value from values
        (timestamp_ntz '2024-01-01 00:00:00', '9'), (timestamp_ntz '2024-01-02 00:00:00', '1') v(t, x)""")
    maps = src.variables_map(src.scan_variables(v)).collect()
    assert {r["variables"]["a"] for r in maps} == {"1", "9"}


def test_variables_map(spark):
    v = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", None)],
                              "instance bigint, name string, value string")
    assert src.variables_map(v).collect()[0]["variables"] == {"a": "x", "b": None}


def test_time_range_is_open(spark):
    df = spark.sql("select cast(t as timestamp_ntz) t from values ('2024-01-01 00:00:00'), "
                   "('2024-01-01 00:00:01'), ('2024-01-01 00:00:02') v(t)")
    assert time_range(df, "t", "2024-01-01 00:00:00", "2024-01-01 00:00:02").count() == 1


def test_checkpoint_dir_is_the_sessions(spark):
    assert ensure_checkpoint_dir(spark).startswith(
        spark.conf.get("spark.checkpoint.dir").replace("file:", "")) or \
        spark.conf.get("spark.checkpoint.dir") in ensure_checkpoint_dir(spark)


JOBS = "backup_port bigint, backup_ip string, backup_cron string"
EVENT = "seq bigint, backup_port bigint, backup_ip string, backup_cron string, removed boolean"


def test_policy_feed(spark, tmp_path):
    installed = spark.createDataFrame([(1, "a", "daily"), (2, "a", "daily"), (3, "a", "x")], JOBS)
    events = [(1, 1, "a", "weekly", False), (2, 1, "a", "daily", False),
              (3, 2, "a", "hourly", False), (4, 3, "a", None, True),
              (5, 4, "a", "daily", False), (6, 9, "a", None, True)]
    spark.createDataFrame(events, EVENT).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(EVENT).parquet(str(tmp_path / "feed"))
    out = str(tmp_path / "out")
    stream_policy_changes(feed, installed, out, str(tmp_path / "progress"), availableNow=True).awaitTermination()
    assert rows(read_policy_actions(spark, out), "backup_port", "action") == [(2, "change"), (3, "remove"), (4, "add")]
    assert rows(read_installed_jobs(spark, out)) == [(1, "a", "daily"), (2, "a", "hourly"), (4, "a", "daily")]


def test_policy_batches_see_what_earlier_ones_changed(spark, tmp_path):
    out = str(tmp_path / "out")
    versions.write(spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (2, "a", "x")], JOBS), out, "installed", -1)
    first = spark.createDataFrame([(1, 1, "a", "y", False), (2, 3, "a", "z", False)], EVENT)
    second = spark.createDataFrame([(3, 1, "a", "y", False), (4, 3, "a", None, True), (5, 2, "a", "x", False)], EVENT)
    for batch, part in ((0, first), (0, first), (1, second), (1, second), (0, first)):
        take_policies(part, batch, out)
    assert rows(read_policy_actions(spark, out), "batch", "backup_port", "policy_cron", "installed_cron", "action") == [
        (0, 1, "y", "x", "change"), (0, 3, "z", None, "add"), (1, 2, None, "x", "remove"), (1, 3, None, "z", "remove")]
    assert rows(read_installed_jobs(spark, out)) == [(1, "a", "y"), (2, "a", "x")]

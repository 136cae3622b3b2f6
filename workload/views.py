"""The driver tables seen as telemetry (FIXTURES.md part B).

Most views are one SELECT that both engines read. ``{name}`` marks an input: a driver
table or another view. A view whose plain SQL would put a whole key in one Spark task is
built by a function below instead; its SQL then serves DuckDB only.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.operators.ordered import bucketed_offset, exclusive_prefix
from fleetlens.session import ensure_checkpoint_dir
from fleetlens.sources.files import open_store
from fleetlens.sources.text import LandedLog, land_log
from workload.oracle_views import ORACLE

LANDED = ("m1_processlist", "m4_waits", "m7_lines")
#: Lines of a text file of the decoded log, and of what a transaction is cut into.
PART_LINES, PIECE_LINES = 1 << 18, 4096
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents")

_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"
_SNAP = "cast(date '2024-01-01' + cast(o_orderkey % 30 as int) as timestamp)"
_STATES = ("updating", "Sending data", "executing", "login", "altering table", "System lock",
           "Waiting for table metadata lock", "Opening tables",
           "Waiting for global read lock", "Creating sort index", "Copying to tmp table",
           "Sending to client", "Waiting for table flush", "statistics", "Rolling back",
           "Waiting for commit lock", "Reading from net", "deleting from reference tables",
           "login")
_STATE_CASE = " ".join(f"when {i} then '{s}'" for i, s in enumerate(_STATES))

SQL = {
    "m1_processlist": f"""
select user_id % 3 as instance, cast(cast(ts as date) as timestamp) as snapshot_ts,
 event_id as id,
 case when event_id % 37 = 0 then 'system user'
      when event_id % 11 = 0 then 'unauthenticated user'
      else 'u' || cast(user_id as string) end as "user",
 '10.0.0.' || cast(user_id as string) as host, 'db' || cast(user_id % 5 as string) as db,
 case when event_id % 13 = 0 then 'Sleep' else 'Query' end as command,
 cast(floor(value) as bigint) as "time",
 case {_K} % 20 {_STATE_CASE} else null end as state,
 case when user_id % 3 = 2 and event_type in ('click', 'purchase') then 'show status'
      when event_type = 'click' then 'update t' || cast(user_id % 7 as string) || ' set a=1'
      when event_type = 'purchase'
        then 'insert into t' || cast(user_id % 7 as string) || ' values (1)'
      when event_type = 'view'
        then 'select * from t' || cast(user_id % 7 as string) || ' a join s.t'
             || cast(user_id % 3 as string) || ' b on a.id=b.id'
      when event_type = 'signup'
        then 'alter table t' || cast(user_id % 7 as string) || ' add c int'
      when {_K} % 8 = 0 then 'flush tables with read lock'
      when {_K} % 3 = 0 then null else 'commit' end as info,
 cast({_K} as bigint) as rows_sent, cast({_K} * 10 as bigint) as rows_examined
from {{events}}""",
    "m1_fresh": """
select instance, id, case when rows_sent < 20 then null when rows_sent < 30 then ''
 else info end as info from {m1_processlist} where "time" < 60 or rows_sent > 50""",
    "m2_trx": f"""
select o_custkey % 3 as instance, {_SNAP} as snapshot_ts, o_orderkey as trx_id,
 case o_orderstatus when 'F' then 'RUNNING' when 'O' then 'LOCK WAIT'
      else 'ROLLING BACK' end as trx_state,
 cast(o_orderdate as timestamp) as trx_started,
 case when o_orderstatus = 'O' then cast(o_orderdate as timestamp) else null end
   as trx_wait_started,
 case when o_orderstatus = 'O' then o_orderkey else null end as requested_lock_id,
 o_custkey as thread_id,
 case when o_orderkey % 9 = 0 then null
      else 'update t' || cast(o_orderkey % 7 as string) || ' set a=1' end as trx_query,
 o_orderkey % 3 as tables_in_use, o_orderkey % 2 as tables_locked,
 'REPEATABLE READ' as isolation_level, o_orderkey % 1000 as rows_modified
from {{orders}}""",
    "m3_threads": """
select c_custkey % 3 as instance,
 case when c_acctbal > -300 then c_custkey else -c_custkey end as id,
 case when c_acctbal > -300 then c_custkey else -c_custkey end + 1000 as thread_id,
 c_name as "user", '10.1.0.' || cast(c_nationkey as string) as host, c_mktsegment as db,
 case when c_custkey % 3 = 0 then 'Sleep' else 'Query' end as command,
 cast(floor(abs(c_acctbal)) as bigint) as "time",
 case when c_nationkey % 4 = 0 then null else 'select ' || c_name end as info
from {customer}""",
    "m4_waits": f"""
select instance, snapshot_ts, requesting, blocking, requesting as lock_id
from (select o_custkey % 3 as instance, {_SNAP} as snapshot_ts, o_orderkey as requesting,
        lag(o_orderkey) over (partition by o_custkey % 3, o_orderkey % 30
                              order by o_orderdate, o_orderkey) as blocking
      from {{orders}}) q where blocking is not null""",
    "m5_locks": f"""
select o_custkey % 3 as instance, {_SNAP} as snapshot_ts, o_orderkey as lock_id,
 case when o_orderpriority < '3' then 'X' else 'S' end as lock_mode,
 'RECORD' as lock_type, 't' || cast(o_orderkey % 7 as string) as lock_table,
 case when o_orderkey % 4 = 0 then null else 'PRIMARY' end as lock_index from {{orders}}""",
    "m6_mdl": """
select p_partkey % 3 as instance, 1000 + p_partkey % 150 as owner_thread_id,
 'TABLE' as object_type, p_brand as object_schema, p_name as object_name,
 'SHARED_READ' as lock_type, 'TRANSACTION' as lock_duration,
 case when p_size % 3 = 0 then 'GRANTED' else 'PENDING' end as lock_status,
 p_partkey as mdl_id from {part}""",
    "m6_observer": """
select instance, min(thread_id) as owner_thread_id from {m3_threads} group by instance""",
    "m7_trx": """
select o_orderkey as xid, o_custkey % 8 as log_no, count(*) as n_rows,
 count(case when l_returnflag = 'A' then 1 end) as n_ins,
 count(case when l_returnflag = 'N' then 1 end) as n_upd,
 cast(sum(cast(l_quantity as bigint)) as bigint) as size,
 o_orderkey - o_orderkey % 8 as last_committed, count(*) * 3 as secs
from {orders} join {lineitem} on l_orderkey = o_orderkey group by o_orderkey, o_custkey""",
    "m7_placed": """
select *, cast(sum(65 + size) over w - 65 - size as bigint) as pos,
 cast(sum(n_rows + 8) over w - n_rows - 8 as bigint) as base
from {m7_trx} window w as (partition by log_no order by xid
                           rows between unbounded preceding and current row)""",
    "m8_columns": """
select side, case when side = 'A' and p_brand = 'Brand#3' then 'only A'
   when side = 'B' and p_brand = 'Brand#7' then 'only B' else p_brand end as table_name,
 case when rn = 1 then p_name else p_name || ' ' || cast(p_partkey as string) end
  as column_name, p_type as "type",
 case when p_size % 2 = 0 then 'YES' else 'NO' end as nullable,
 case when p_size % 7 = 0 then 'PRI' else '' end as column_key,
 case when p_size % 5 = 0 then null else cast(p_size % 4 as string) end as default_value,
 '' as extra
from (select *, case when p_partkey % 2 = 0 then 'A' else 'B' end as side,
        row_number() over (partition by p_partkey % 2, p_brand, p_name
                           order by p_partkey) as rn from {part}) q""",
    "m8_indexes": """
select case when o_orderkey % 8 < 4 then 'A' else 'B' end as side,
 o_orderstatus as table_name,
 'k' || cast(cast(floor(o_orderkey / 8.0) as bigint) as string) as key_name,
 o_orderkey % 4 + 1 as seq_in_index, 'c' || cast(o_orderkey % 4 as string) as column_name,
 case when o_custkey % 10 = 0 then 'YES' else '' end as nullable
from {orders}""",
    "m8_tables": """
select s.side, c_name as table_name,
 'CREATE TABLE x (' || chr(10) || ') ENGINE='
 || case when (c_nationkey + s.k) % 4 = 0 then 'MyISAM' else 'InnoDB' end
 || case when c_nationkey % 3 = 0
         then ' AUTO_INCREMENT=' || cast(c_nationkey + s.k as string) else '' end
 || ' DEFAULT CHARSET=utf8mb4'
 || case when c_nationkey % 5 = s.k then ' COLLATE=utf8mb4_bin' else '' end as create_sql
from {customer}, (select 'A' as side, 0 as k union all select 'B' as side, 1 as k) s""",
    "m9_variables": f"""
select instance, name, value from (
 select user_id as instance, event_type as name,
  case {_K} % 4 when 0 then 'ON' when 1 then 'TRUE' when 2 then 'off' else '16M' end
    as value,
  row_number() over (partition by user_id, event_type order by ts desc, event_id desc)
    as rn from {{events}}) q where rn = 1""",
    "m9_pairs": """
select distinct user_id - user_id % 2 as src, user_id - user_id % 2 + 1 as dest
from {events}""",
    "m9_event_names": """
select distinct event_type as name from {events} where event_type <> 'error'""",
    "m9_history": f"""
select user_id as instance, event_type as name, cast(ts as timestamp) as snapshot_ts,
 event_id, cast({_K} % 4 as string) as value from {{events}}""",
    "m9_file_lines": """
select 'my.cnf' as file, s_suppkey + 1 as line_no,
 case when s_suppkey % 10 = 0 then '# comment' when s_suppkey % 10 = 1 then '[mysqld]'
      when s_suppkey % 10 = 2 then '' when s_suppkey % 10 = 3 then 'skip-flag'
      else replace(s_name, '#', '-') || ' = '
        || case s_nationkey % 4 when 0 then 'on' when 1 then 'TRUE' when 2 then 'OFF'
                else 'a=b' end end as line from {supplier}""",
    "m9_live": """
select replace(s_name, '#', '_') as name,
 case s_nationkey % 3 when 0 then 'ON' when 1 then 'OFF' else 'a=b' end as value
from {supplier}""",
    "m9_dynamic": """
select replace(s_name, '#', '_') as name from {supplier} where s_acctbal > 1000""",
    "m10_ledger": """
select o_orderkey as run_id, o_custkey % 300 as instance_port,
 '10.0.0.' || cast(o_custkey % 7 as string) as instance_ip,
 cast(cast(o_orderdate as date) as timestamp) as backup_day,
 cast(o_orderdate as timestamp) as stage_ts,
 case o_orderpriority when '1-URGENT' then 'create remote dir' when '2-HIGH'
   then 'take backup' when '3-MEDIUM' then 'send backup to remote'
   when '4-NOT SPECIFIED' then 'get md5' else 'final' end as stage,
 case o_orderstatus when 'F' then 'fail' when 'O' then 'success' else 'running' end
   as status,
 case when o_orderkey % 50 = 0 then '0'
      when o_orderkey % 3 = 0 then cast(o_orderkey % 900 as string) || 'K'
      when o_orderkey % 3 = 1 then cast(o_orderkey % 900 as string) || 'M'
      else cast(o_orderkey % 90 as string) || '.5G' end as backup_size,
 o_orderkey * 10 as to_lsn,
 case when o_orderkey % 6 = 0 then 'mysqldump' else 'xtra' end as backup_tool,
 case when o_orderkey % 8 = 0 then 'yes' else 'no' end as isdelete from {orders}""",
    "m10_policy": """
select c_custkey % 300 as backup_port,
 '10.0.0.' || cast(c_custkey % 7 as string) as backup_ip,
 cast(min(30 + c_nationkey) as bigint) as backup_retention,
 min(c_mktsegment) as backup_cron from {customer} where c_acctbal > 500
group by c_custkey % 300, c_custkey % 7""",
    "m10_installed": """
select c_custkey % 300 as backup_port,
 '10.0.0.' || cast(c_custkey % 7 as string) as backup_ip,
 max(case when c_nationkey = 0 then 'OTHER' else c_mktsegment end) as backup_cron
from {customer} where c_acctbal < 8500 group by c_custkey % 300, c_custkey % 7""",
    "m10_instances": """
select distinct c_custkey % 300 as instance_port,
 '10.0.0.' || cast(c_custkey % 7 as string) as instance_ip from {customer}""",
    "m10_running": """
select distinct c_custkey % 300 as instance_port,
 '10.0.0.' || cast(c_custkey % 7 as string) as instance_ip
from {customer} where c_acctbal > 9000""",
    "m11_instances": """
select c_custkey % 5 as cluster, cast(floor(c_custkey / 5.0) as bigint) as idx,
 case when c_custkey < 5 then null
      else cast(floor((floor(c_custkey / 5.0) - 1) / 3.0) as bigint) end as master_idx
from {customer}""",
    "m11_broken": """
select c_custkey % 5 as cluster, cast(floor(c_custkey / 5.0) as bigint) as idx,
 case when c_custkey < 5 then null
      when c_acctbal < -600 then cast(floor(c_custkey / 5.0) as bigint) * 3 + 1
      else cast(floor((floor(c_custkey / 5.0) - 1) / 3.0) as bigint) end as master_idx
from {customer}""",
    "m13_replica": """
select s_suppkey as instance_port, '10.0.0.' || cast(s_suppkey % 7 as string) as instance_ip,
 case s_suppkey % 5 when 0 then ''
  when 1 then 'Slave_IO_Running: Yes' || chr(10) || 'Slave_SQL_Running: Yes'
  when 2 then '*** 1. row ***' || chr(10) || ' Slave_IO_Running: No' || chr(10)
    || ' Slave_SQL_Running: Yes' || chr(10) || ' Last_Error: ' || s_name || ': lost: net'
  when 3 then ' Slave_IO_Running : Yes ' || chr(10) || 'Slave_SQL_Running: Yes'
    || chr(10) || 'Last_Error: code: ' || cast(s_nationkey as string)
  else 'Slave_IO_Running: No' || chr(10) || 'Slave_IO_Running: Yes' || chr(10)
    || 'Slave_SQL_Running: Yes' end as status_text from {supplier}""",
    "m14_open_tables": """
select c_custkey % 3 as instance,
 case when c_mktsegment = 'BUILDING' then 'performance_schema' else c_mktsegment end
   as "database", c_name as "table",
 case when c_custkey % 3 = 2 then 0 else cast(c_nationkey % 4 as bigint) end as in_use
from {customer}""",
    "m15_checkpoints": """
select o_custkey % 300 as instance_port, cast(cast(o_orderdate as date) as timestamp)
 as backup_day, o_orderkey as line_no,
 case when o_orderpriority = '5-LOW' then 'backup_type = full-backuped'
      when o_orderpriority = '1-URGENT'
        then 'to_lsn=' || cast(o_orderkey * 10 as string) || ' '
      else 'to_lsn = ' || cast(o_orderkey * 10 as string) end as line from {orders}""",
}

# DuckDB forms of the views that Spark builds by a function.
SQL["m7_lines"] = """
select 'binlog.00000' || cast(log_no as string) as file, base + k + 1 as line_no,
 case when k = 0 then '# at ' || cast(pos as string)
  when k = 1 then '#240101 ' || lpad(cast(t // 3600 as string), 2, ' ') || ':'
    || lpad(cast(t // 60 % 60 as string), 2, '0') || ':'
    || lpad(cast(t % 60 as string), 2, '0') || ' server id 1  end_log_pos '
    || cast(pos + 65 as string) || ' CRC32 0x0 ' || chr(9) || 'GTID' || chr(9)
    || 'last_committed=' || cast(last_committed as string) || chr(9)
    || 'sequence_number=' || cast(xid as string)
  when k = 2 then 'BEGIN' when k = 3 then '/*!*/;'
  when k = 4 then '# at ' || cast(pos + 65 as string)
  when k = 5 then '#240101 ' || lpad(cast(t // 3600 as string), 2, ' ') || ':'
    || lpad(cast(t // 60 % 60 as string), 2, '0') || ':'
    || lpad(cast(t % 60 as string), 2, '0') || ' server id 1  end_log_pos '
    || cast(pos + 100 as string) || ' CRC32 0x0 ' || chr(9) || 'Table_map: `db`.`orders`'
  when k < 6 + n_ins then '### INSERT INTO `db`.`orders`'
  when k < 6 + n_ins + n_upd then '### UPDATE `db`.`orders`'
  when k < 6 + n_rows then '### DELETE FROM `db`.`orders`'
  when k = 6 + n_rows then '#' || strftime(date '2024-01-01' + cast(e // 86400 as int), '%y%m%d')
    || ' ' || lpad(cast(e % 86400 // 3600 as string), 2, ' ') || ':'
    || lpad(cast(e // 60 % 60 as string), 2, '0') || ':'
    || lpad(cast(e % 60 as string), 2, '0') || ' server id 1  end_log_pos '
    || cast(pos + 65 + size as string) || ' CRC32 0x0 ' || chr(9) || 'Xid = '
    || cast(xid as string)
  else 'COMMIT/*!*/;' end as line
from (select *, xid % 86000 as t, xid % 86000 + secs as e,
        unnest(range(0, n_rows + 8)) as k from {m7_placed}) q"""
SQL["m12_facts"] = " union all ".join(
    f"select s_suppkey as instance, '{name}' as name, {value} as value from {{supplier}}"
    for name, value in (
        ("version", "case when s_suppkey % 5 = 3 then '10.4.1' when s_suppkey % 3 = 0 "
                    "then '5.7.31' else '8.0.22' end"),
        ("performance_schema", "case when s_suppkey % 3 = 2 then 'OFF' else 'ON' end"),
        ("mdl_instrument", "case when s_suppkey % 3 = 1 then 'NO' else 'YES' end"),
        ("global_instrumentation", "case when s_nationkey < 5 then 'NO' else 'YES' end"),
        ("read_only", "case when s_suppkey % 3 = 2 then 'ON' else 'OFF' end"),
        ("is_replica", "case when s_suppkey % 3 = 2 then 'YES' else 'NO' end")))

_REF = re.compile(r"\{(\w+)\}")


_ALL = {**SQL, **ORACLE}


def with_views(sql: str) -> str:
    """DuckDB text: ``sql`` with every ``{view}`` it needs as a common table expression."""
    ctes: dict[str, str] = {}

    def need(text: str) -> None:
        for name in _REF.findall(text):
            if name in _ALL and name not in ctes:
                need(_ALL[name])
                ctes[name] = _REF.sub(r"\1", _ALL[name]).strip()
    need(sql)
    body = _REF.sub(r"\1", sql).strip()
    if not ctes:
        return body
    listed = ",\n".join(f"{name} as (\n{text}\n)" for name, text in ctes.items())
    if body.lower().startswith("with recursive "):
        return f"with recursive {listed},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {listed},\n{body[len('with '):]}"
    return f"with {listed}\n{body}"


def _spark_text(sql: str) -> str:
    return (sql.replace('"', "`").replace(" as timestamp)", " as timestamp_ntz)")
            .replace("timestamp '", "timestamp_ntz '"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    if name in LANDED:
        return landed(spark, sf_dir, name)
    return _render(spark, sf_dir, name)


def _render(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in _BUILT:
        return _BUILT[name](spark, sf_dir)
    text = SQL[name]
    inputs = {n: view(spark, sf_dir, n) for n in set(_REF.findall(text))}
    return spark.sql(_spark_text(text), **inputs)


_landed: dict = {}


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view written once per application to the shared folder, then read back.

    Used for the decoded log, the process list and the lock waits: their readers start
    from stored captures, as in production, and not from the plan that renders them.
    """
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _landed:
        tag = hashlib.md5(sf_dir.encode()).hexdigest()[:12]
        path = f"{ensure_checkpoint_dir(spark)}/landed-{app}-{tag}/{name}"
        _render(spark, sf_dir, name).write.mode("overwrite").parquet(path)
        _landed[key] = path
    return spark.read.parquet(_landed[key])


def _written(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Folder that ``write`` (given the folder) has filled, once per application."""
    app = spark.sparkContext.applicationId
    key = (app, sf_dir, name)
    if key not in _landed:
        tag = hashlib.md5(sf_dir.encode()).hexdigest()[:12]
        path = f"{ensure_checkpoint_dir(spark)}/landed-{app}-{tag}/{name}"
        write(path)
        _landed[key] = path
    return _landed[key]


def text_files(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame, file: str, *order: str) -> str:
    """Folder of text files, with the column ``line`` in order: a folder per value of ``file``, whose
    files follow each other by name."""
    dealt = rows.repartitionByRange(file, *order).sortWithinPartitions(file, *order)
    lined = dealt.select(file, F.col("line").alias("value"))
    return _written(spark, sf_dir, name, lambda path: lined.write.partitionBy(file).mode("overwrite").text(path))


def folder_name(path):
    """The value that the folder of a partitioned file stands for."""
    return F.regexp_extract(path, "/[a-z]+=([^/]+)/[^/]*$", 1)


def _files_of(folder: str):
    def write(batches):
        system, root = open_store(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = f"{root}/{path}"
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(name) as file:
                    file.write(content or b"")
            yield batch.select([0])
    return write


def content_files(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame) -> str:
    """Folder of files, one per row of ``rows`` (path, content), written in tasks."""
    return _written(spark, sf_dir, name, lambda folder: rows.select("path", F.col("content").cast("binary")).mapInArrow(
        _files_of(folder), "path string").write.format("noop").mode("overwrite").save())


def landed_log(spark: SparkSession, sf_dir: str) -> LandedLog:
    """The decoded log, as text files that are then landed as in production."""
    texts = _log_files(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, "m7_log")
    if key not in _landed:
        _landed[key] = land_log(spark, texts, texts.removesuffix("m7_text") + "m7_log",
                                lambda path: F.regexp_extract(path, "/file=([^/]+)/", 1))
    return _landed[key]


def _log_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of compressed text files: the decoded log, a file per ``PART_LINES`` lines of a log.

    Pieces of transactions are dealt out by the part they begin in, put in order, and only then
    turned to text, a value of many lines per piece: no text is shuffled or sorted.
    """
    def write(path: str) -> None:
        pieces = (_line_pieces(spark, sf_dir).withColumn("part", F.expr(f"lpad(string(first div {PART_LINES}), 12, '0')"))
                  .withColumn("file", F.concat(F.lit("binlog.00000"), F.col("log_no"))))
        upto = table(spark, sf_dir, "lineitem").count() + 8 * table(spark, sf_dir, "orders").count()
        placed = pieces.repartition(upto // PART_LINES + 2, "log_no", "part").sortWithinPartitions("file", "part", "first")
        (_timed(placed).select("file", "part", _piece_text().alias("value"))
         .write.partitionBy("file", "part").mode("overwrite").option("compression", "snappy").text(path))
    return _written(spark, sf_dir, "m7_text", write)


def _waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lock waits: each transaction waits for the one before it in its snapshot."""
    trx = view(spark, sf_dir, "m2_trx").select(
        "instance", "snapshot_ts", F.col("trx_started").alias("bucket"),
        F.col("trx_id").alias("requesting"))
    return (bucketed_offset(trx, ["instance", "snapshot_ts"], "bucket", ["requesting"],
                            {"requesting": "blocking"})
            .filter("blocking is not null")
            .select("instance", "snapshot_ts", "requesting", "blocking",
                    F.col("requesting").alias("lock_id")))


def _placed(spark: SparkSession, sf_dir: str, chunk: int = 100_000) -> DataFrame:
    """Transactions with their log position and first line, both running per log."""
    trx = view(spark, sf_dir, "m7_trx").withColumn(
        "chunk", F.floor(F.col("xid") / chunk).cast("bigint"))
    trx = trx.withColumn("w_bytes", F.lit(65) + F.col("size")).withColumn(
        "w_lines", F.col("n_rows") + 8)
    totals = trx.groupBy("log_no", "chunk").agg(F.sum("w_bytes").alias("pos0"),
                                                F.sum("w_lines").alias("base0"))
    before = exclusive_prefix(totals, ["log_no"], "chunk", ["pos0", "base0"])
    here = (Window.partitionBy("log_no", "chunk").orderBy("xid")
            .rowsBetween(Window.unboundedPreceding, -1))
    return (trx.withColumn("pos", F.coalesce(F.sum("w_bytes").over(here), F.lit(0)))
            .withColumn("base", F.coalesce(F.sum("w_lines").over(here), F.lit(0)))
            .join(before, ["log_no", "chunk"])
            .withColumn("pos", F.col("pos") + F.col("pos0"))
            .withColumn("base", F.col("base") + F.col("base0"))
            .drop("chunk", "w_bytes", "w_lines", "pos0", "base0"))


def _line_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions cut into pieces of at most ``PIECE_LINES`` lines, the first of which has the
    number ``first``, so that no transaction, of whatever length, becomes one array."""
    return (_placed(spark, sf_dir)
            .withColumn("n", F.col("n_rows") + 8)
            .withColumn("k0", F.explode(F.expr(f"sequence(0L, (n - 1) div {PIECE_LINES})")))
            .withColumn("first", F.col("base") + F.col("k0") * PIECE_LINES + 1))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded log of ``m7_trx``."""
    return _as_text(_line_pieces(spark, sf_dir))


def _timed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the seconds their transactions begin (``t``) and end at (``e``)."""
    return pieces.withColumns({"t": F.expr("xid % 86000"), "e": F.expr("xid % 86000 + secs")})


def _stamp(at: str, day: str = "'240101'") -> str:
    return (f"'#' || {day} || ' ' || lpad(string({at} % 86400 div 3600), 2, ' ') || ':' || "
            f"lpad(string({at} div 60 % 60), 2, '0') || ':' || "
            f"lpad(string({at} % 60), 2, '0') || ' server id 1  end_log_pos '")


# Lines of a transaction.
_HEAD = (
    "'# at ' || pos",
    _stamp("t") + " || (pos + 65) || ' CRC32 0x0 ' || chr(9) || 'GTID' || chr(9) || 'last_committed=' || last_committed"
    " || chr(9) || 'sequence_number=' || xid",
    "'BEGIN'", "'/*!*/;'", "'# at ' || (pos + 65)",
    _stamp("t") + " || (pos + 100) || ' CRC32 0x0 ' || chr(9) || 'Table_map: `db`.`orders`'")
_ROW_LINES = ("'### INSERT INTO `db`.`orders`'", "'### UPDATE `db`.`orders`'", "'### DELETE FROM `db`.`orders`'")
_XID_LINE = (_stamp("e", "date_format(date_add(date '2024-01-01', int(e div 86400)), 'yyMMdd')")
             + " || (pos + 65 + size) || ' CRC32 0x0 ' || chr(9) || 'Xid = ' || xid")
_COMMIT_LINE = "'COMMIT/*!*/;'"


def _piece_text() -> Column:
    """All lines of a piece as one text; an unknown line is empty, as in a text file."""
    def line(text: str) -> str:
        return f"'\\n' || coalesce({text}, '')"

    low, past = f"(k0 * {PIECE_LINES})", f"least((k0 + 1) * {PIECE_LINES}, n)"
    ends = ("6", "6 + n_ins", "6 + n_ins + n_upd", "6 + n_rows")
    rows = [f"repeat({line(text)}, int(greatest(0, least({past}, {last}) - greatest({low}, {first}))))"
            for text, first, last in zip(_ROW_LINES, ends, ends[1:])]
    return F.substring(F.expr(" || ".join([
        f"case when k0 = 0 then {' || '.join(map(line, _HEAD))} else '' end", *rows,
        f"case when {low} <= 6 + n_rows and 6 + n_rows < {past} then {line(_XID_LINE)} else '' end",
        f"case when {past} = n then {line(_COMMIT_LINE)} else '' end"])), 2, 2**31 - 1)


def _as_text(pieces: DataFrame, *keep: str) -> DataFrame:
    """The lines of pieces of transactions. The text comes out of a generator, so that the
    optimizer cannot paste its long expression into every later use of ``line``."""
    step = PIECE_LINES
    numbered = _timed(pieces.withColumn("k", F.explode(F.expr(
        f"sequence(k0 * {step}, least(k0 * {step} + {step} - 1, n - 1))"))))

    head = " ".join(f"when k = {k} then {text}" for k, text in enumerate(_HEAD))
    line = f"""case {head}
     when k < 6 + n_ins then {_ROW_LINES[0]}
     when k < 6 + n_ins + n_upd then {_ROW_LINES[1]}
     when k < 6 + n_rows then {_ROW_LINES[2]}
     when k = 6 + n_rows then {_XID_LINE}
     else {_COMMIT_LINE} end"""
    return numbered.select(F.concat(F.lit("binlog.00000"), F.col("log_no")).alias("file"),
                           (F.col("base") + F.col("k") + 1).alias("line_no"), *keep,
                           F.explode(F.array(F.expr(line))).alias("line"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as instance",
        """stack(6, 'version', case when s_suppkey % 5 = 3 then '10.4.1'
             when s_suppkey % 3 = 0 then '5.7.31' else '8.0.22' end,
           'performance_schema', case when s_suppkey % 3 = 2 then 'OFF' else 'ON' end,
           'mdl_instrument', case when s_suppkey % 3 = 1 then 'NO' else 'YES' end,
           'global_instrumentation', case when s_nationkey < 5 then 'NO' else 'YES' end,
           'read_only', case when s_suppkey % 3 = 2 then 'ON' else 'OFF' end,
           'is_replica', case when s_suppkey % 3 = 2 then 'YES' else 'NO' end)
           as (name, value)""")


def _create_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = F.explode(F.expr("array(named_struct('side', 'A', 'k', 0), "
                             "named_struct('side', 'B', 'k', 1))"))
    return (table(spark, sf_dir, "customer").withColumn("s", sides).selectExpr(
        "s.side", "c_name as table_name",
        r"""'CREATE TABLE x (' || chr(10) || ') ENGINE='
        || case when (c_nationkey + s.k) % 4 = 0 then 'MyISAM' else 'InnoDB' end
        || case when c_nationkey % 3 = 0 then ' AUTO_INCREMENT=' || (c_nationkey + s.k)
                else '' end || ' DEFAULT CHARSET=utf8mb4'
        || case when c_nationkey % 5 = s.k then ' COLLATE=utf8mb4_bin' else '' end
        as create_sql"""))


_BUILT = {"m4_waits": _waits, "m7_placed": _placed, "m7_lines": _lines,
          "m12_facts": _facts, "m8_tables": _create_statements}

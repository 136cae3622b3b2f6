"""Intermediate results of the SQL checks, written independently of the library."""

AS_OF = "2001-08-01 00:00:00"

_DML = ("'update','updating','deleting from main table','deleting from reference tables',"
        "'User sleep','executing','updating main table','updating reference tables',"
        "'Searching rows for update'")
_SELECT = ("'Sending data','Copying to tmp table','User sleep',"
           "'Copying to tmp table on disk','Creating sort index','executing',"
           "'Sorting for group','Sorting for order','Sorting result','removing tmp table',"
           "'Sending to client'")
_DDL = ("'altering table','copy to tmp table','Creating index',"
        "'committing alter table to storage engine','discard_or_import_tablespace',"
        "'preparing for alter table','rename'")

ORACLE = {
    "o_active": """select * from {m1_processlist} where "time" >= 10
 and "user" <> 'system user' and command <> 'Sleep'""",
    "o_classified": f"""select *, case when coalesce(info, '') = '' then 'skipped'
 when p like 'update%' or p like 'delete%' or (p like 'insert%' and state in ({_DML}))
   then 'dml'
 when p like 'select%' and state in ({_SELECT}) then 'select'
 when (p like 'alter%' or p like 'drop%' or p like 'truncate%') and state in ({_DDL})
   then 'ddl'
 when "user" = 'unauthenticated user' then 'unauthenticated'
 when info = 'commit' then 'commit' when state = 'login' then 'login' else 'other' end
   as class
from (select *, lower(substr(info, 1, 20)) as p from {{o_active}}) q""",
    "o_counts": """select instance, snapshot_ts, count(*) filter (class = 'select') as n_select,
 count(*) filter (class = 'dml') as n_dml, count(*) filter (class = 'ddl') as n_ddl,
 count(*) filter (class = 'commit') as n_commit,
 count(*) filter (class = 'login') as n_login,
 count(*) filter (class = 'unauthenticated') as n_unauthenticated,
 count(*) filter (class = 'other') as n_other,
 count(*) filter (class = 'skipped') as n_skipped
from {o_classified} group by instance, snapshot_ts""",
    "o_long_trx": f"""select t.*, p."user", p.host, p.db, p.info,
 date_sub('second', t.trx_started, timestamp '{AS_OF}') as age
from {{m2_trx}} t join {{m3_threads}} p on p.instance = t.instance and p.id = t.thread_id
where t.trx_started < timestamp '{AS_OF}' - interval 10 second""",
    "o_lock_waits": f"""select w.instance, w.snapshot_ts, r.thread_id as waiting_thread,
 r.trx_query as waiting_query, r.rows_modified as waiting_rows_modified,
 date_sub('second', r.trx_started, timestamp '{AS_OF}') as waiting_age,
 date_sub('second', r.trx_wait_started, timestamp '{AS_OF}') as waiting_wait_secs,
 rp."user" as waiting_user, rp.host as waiting_host, rp.db as waiting_db,
 b.thread_id as blocking_thread, b.trx_query as blocking_query,
 b.rows_modified as blocking_rows_modified,
 date_sub('second', b.trx_started, timestamp '{AS_OF}') as blocking_age,
 date_sub('second', b.trx_wait_started, timestamp '{AS_OF}') as blocking_wait_secs,
 bp."user" as blocking_user, bp.host as blocking_host, bp.db as blocking_db,
 bp.command || case when bp.command = 'Sleep' then ' ' || cast(bp."time" as varchar)
   else '' end as blocking_status,
 lock_mode || ' ' || lock_type || ' ' || lock_table || '(' || lock_index || ')' as lock_info
from {{m4_waits}} w
join {{m2_trx}} b on b.trx_id = w.blocking join {{m2_trx}} r on r.trx_id = w.requesting
join {{m5_locks}} l on l.lock_id = w.lock_id
left join {{m3_threads}} bp on bp.instance = b.instance and bp.id = b.thread_id
left join {{m3_threads}} rp on rp.instance = r.instance and rp.id = r.thread_id""",
    "o_refs": """select instance, snapshot_ts, id, pos, nullif(regexp_extract(ref, '^(s)[.]', 1), '')
   as schema_name, regexp_extract(ref, 't[0-9]+') as table_name,
 nullif(regexp_extract(ref, ' ([ab]) ', 1), '') as alias
from (select instance, snapshot_ts, id, unnest(m) as ref, generate_subscripts(m, 1) as pos
      from (select *, regexp_extract_all(info,
              '(?:from|join|into|update|table) ((?:s[.])?t[0-9]+(?: [ab] )?)', 1) as m
            from {m1_processlist}) a) b""",
    "o_waiters": """select a.instance, a.snapshot_ts, a.id, r.table_name from {o_active} a
left join {o_refs} r on r.id = a.id and r.pos = 1
where a.state = 'Waiting for table metadata lock'""",
    "o_statements": """select instance, snapshot_ts, class as kind, id as blocker_id,
 id as thread_id, info as statement from {o_classified}
 where class in ('select', 'dml', 'ddl')
union all select instance, snapshot_ts, 'transaction', trx_id, thread_id, trx_query
 from {o_long_trx} where trx_query is not null""",
    "o_held": """select distinct s.*, 't' || t.k as table_name from {o_statements} s
 join (select unnest(range(0, 7)) as k) t on regexp_matches(s.statement,
   '(from|join|into|update|table) (s[.])?t' || t.k || '( |$)')""",
    "o_facts": """select instance, max(value) filter (name = 'version') as version,
 max(value) filter (name = 'performance_schema') as performance_schema,
 max(value) filter (name = 'mdl_instrument') as mdl_instrument,
 max(value) filter (name = 'global_instrumentation') as global_instrumentation,
 max(value) filter (name = 'read_only') as read_only,
 max(value) filter (name = 'is_replica') = 'YES' as is_replica,
 case when max(value) filter (name = 'version') like '5.%' then '5.x'
      when max(value) filter (name = 'version') like '8.%' then '8.x' end as version_family
from {m12_facts} group by instance""",
    "o_visibility": """select instance, version_family,
 case when performance_schema = 'ON' and mdl_instrument = 'YES' then 'show_holders'
      when mdl_instrument = 'NO' then 'instrument_disabled'
      when performance_schema <> 'ON' then 'performance_schema_off' end as visibility,
 case when performance_schema = 'ON' and mdl_instrument = 'YES' then 'show_holders'
      when mdl_instrument <> 'YES' then 'instrument_disabled'
      when performance_schema <> 'ON' then 'performance_schema_off' end as flush_visibility
from {o_facts}""",
    "o_waiter_blockers": """select w.instance, w.snapshot_ts, w.id, w.table_name,
 (select count(*) from {o_held} h where h.instance = w.instance
   and h.snapshot_ts = w.snapshot_ts and h.table_name = w.table_name
   and h.thread_id <> w.id) as n_blockers from {o_waiters} w""",
    "o_findings": """
select q.*, (select v.advice from (values
 ('rolling_back', 'a transaction is being rolled back'),
 ('second_phase_delete', 'a multi-table delete is in its second phase; rewrite the statement'),
 ('client_network', 'check name resolution and the network to the client'),
 ('system_lock', 'check I/O, long statements and tables without a primary key'),
 ('big_ddl', 'a large table is being altered'), ('stale_statistics', 'refresh table statistics'),
 ('sort_without_index', 'give the sort an index'), ('commit_lock', 'commits are held by a lock'),
 ('reads_many_rows', 'read fewer rows or enlarge the buffer pool'),
 ('temporary_table', 'rewrite the statement, then consider larger temporary tables'),
 ('result_too_large', 'return fewer rows, then consider larger network buffers'),
 ('table_flush', 'blocked by a table lock or a long statement'),
 ('flush_is_waiting', 'end the long statements and transactions the flush waits for'),
 ('blocked_by_flush', 'find the session that flushed tables with a read lock'),
 ('blocked_by_long_query', 'a long statement holds up the read lock'),
 ('table_name_unreadable', 'no table name in the statement, perhaps a keyword'),
 ('mdl_blocked', 'see the blocking statements of the table'),
 ('mdl_blocker_unknown', 'an uncommitted transaction or long statement holds the table'),
 ('unsupported_version', 'lock waits of this server version cannot be read'),
 ('dml_blocked', 'see the lock-wait report'),
 ('dml_may_block', 'a long change is running and may block others'),
 ('long_ddl_running', 'a large table may be dropped or truncated; see the long DDL'),
 ('table_cache_pressure', 'enlarge the table cache, or use fewer tables and less concurrency'))
 v(finding, advice) where v.finding = q.finding) as advice from (
select a.instance, a.snapshot_ts, a.id, a.state, r.finding,
 case when r.shown then a.info end as detail,
 case r.ladder when 1 then v.visibility when 2 then v.flush_visibility end as visibility,
 r.t as trx_problem, r.q as query_problem
from {o_active} a join (values
 ('Rolling back', 'rolling_back', false, 0, false, false),
 ('deleting from reference tables', 'second_phase_delete', false, 0, false, false),
 ('Receiving from client', 'client_network', false, 0, false, false),
 ('Reading from net', 'client_network', false, 0, false, false),
 ('System lock', 'system_lock', false, 0, true, true),
 ('altering table', 'big_ddl', true, 0, false, false),
 ('statistics', 'stale_statistics', false, 0, false, false),
 ('Creating sort index', 'sort_without_index', true, 0, false, false),
 ('Waiting for commit lock', 'commit_lock', false, 1, false, false),
 ('Sending data', 'reads_many_rows', true, 0, false, false),
 ('Copying to tmp table', 'temporary_table', true, 0, false, false),
 ('Copying to tmp table on disk', 'temporary_table', true, 0, false, false),
 ('Sending to client', 'result_too_large', true, 0, false, false),
 ('Waiting for table flush', 'table_flush', true, 2, false, false))
 r(state, finding, shown, ladder, t, q) on r.state = a.state
left join {o_visibility} v on v.instance = a.instance
union all
select a.instance, a.snapshot_ts, a.id, a.state,
 case when f then 'flush_is_waiting' when n = 0 then 'blocked_by_flush'
      else 'blocked_by_long_query' end, case when not f then a.info end,
 case when not f and n = 0 then v.visibility end, f or n > 0, f or n > 0
from (select *, coalesce(info = 'flush tables with read lock', false) as f,
        (select count(*) from {m14_open_tables} o where o.instance = x.instance
          and o.in_use > 0 and o."database" <> 'performance_schema') as n
      from {o_active} x where state = 'Waiting for global read lock') a
left join {o_visibility} v on v.instance = a.instance
union all
select instance, snapshot_ts, id, 'Waiting for table metadata lock',
 case when table_name is null then 'table_name_unreadable' when n_blockers > 0
   then 'mdl_blocked' else 'mdl_blocker_unknown' end, table_name, null,
 table_name is not null, table_name is not null and n_blockers = 0
from {o_waiter_blockers}
union all
select a.instance, a.snapshot_ts, a.id, a.state,
 case when v.version_family is null then 'unsupported_version' when stuck then 'dml_blocked'
      else 'dml_may_block' end, case when not stuck then a.info end, null,
 v.version_family is not null and stuck, false
from (select *, exists (select 1 from {o_lock_waits} l where l.instance = x.instance
        and l.snapshot_ts = x.snapshot_ts and l.waiting_thread = x.id) as stuck
      from {o_active} x where state = 'updating') a
left join {o_visibility} v on v.instance = a.instance
union all
select a.instance, a.snapshot_ts, a.id, a.state, 'long_ddl_running', null, null, false, false
from {o_active} a join {o_counts} c on c.instance = a.instance
 and c.snapshot_ts = a.snapshot_ts and c.n_ddl > 0 where a.state = 'Opening tables'
union all
select instance, snapshot_ts, id, state, 'table_cache_pressure', null, null, false, false
from (select *, count(*) over (partition by instance, snapshot_ts) as n from {o_active}
      where state = 'Opening tables') a where n > 10) q""",
    "o_flags": """select instance, snapshot_ts, bool_or(trx_problem) as trx_problem,
 bool_or(query_problem) as query_problem from {o_findings} group by instance, snapshot_ts""",
    "o_trx_actions": """select distinct t.instance, t.snapshot_ts, t.thread_id as id
from {o_long_trx} t join {o_flags} f on f.instance = t.instance
 and f.snapshot_ts = t.snapshot_ts and f.trx_problem
join {o_facts} x on x.instance = t.instance and x.is_replica = false""",
    "o_actions": """select instance, snapshot_ts, id, 'transaction' as class,
 'long transaction' as reason from {o_trx_actions}
union all select c.instance, c.snapshot_ts, c.id, c.class, 'long statement'
from {o_classified} c join {o_flags} f on f.instance = c.instance
 and f.snapshot_ts = c.snapshot_ts and f.query_problem
left join {o_facts} x on x.instance = c.instance
where c.class in ('select', 'dml', 'ddl')
 and (c.class = 'select' or coalesce(x.is_replica = false, false))
 and not exists (select 1 from {o_trx_actions} t where t.instance = c.instance
   and t.snapshot_ts = c.snapshot_ts and t.id = c.id)""",
    "o_trx": """select 'binlog.00000' || cast(log_no as varchar) as file, xid, n_rows, size,
 secs, timestamp '2024-01-01 00:00:00' + to_seconds(xid % 86000) as start_time,
 base + 3 as start_line, base + n_rows + 8 as end_line, last_committed,
 xid as sequence_number from {m7_placed}""",
    "o_indexes": """select side, table_name, key_name,
 string_agg(column_name, ', ' order by seq_in_index) as columns,
 string_agg(nullable, ', ' order by seq_in_index) as nulls
from {m8_indexes} group by side, table_name, key_name""",
    "o_options": """select side, table_name,
 regexp_extract(tail, '[ ]ENGINE=([^ ]+)', 1) as engine,
 regexp_extract(tail, '[ ]AUTO_INCREMENT=([^ ]+)', 1) as auto_increment,
 regexp_extract(tail, '[ ]CHARSET=([^ ]+)', 1) as charset,
 regexp_extract(tail, '[ ]COLLATE=([^ ]+)', 1) as collate_name
from (select *, split_part(create_sql, chr(10), 2) as tail from {m8_tables}) q""",
    "o_option_drift": """select * from (
 select a.table_name, o as option, case o when 'engine' then a.engine
   when 'auto_increment' then a.auto_increment when 'charset' then a.charset
   else a.collate_name end as value_a, case o when 'engine' then b.engine
   when 'auto_increment' then b.auto_increment when 'charset' then b.charset
   else b.collate_name end as value_b
 from (select * from {o_options} where side = 'A') a
 join (select * from {o_options} where side = 'B') b on b.table_name = a.table_name,
 (select unnest(['engine', 'auto_increment', 'charset', 'collate']) as o) k) q
where value_a <> value_b""",
    "o_column_pairs": """select coalesce(a.table_name, b.table_name) as table_name,
 coalesce(a.column_name, b.column_name) as column_name, a.side as sa, b.side as sb,
 a."type" as type_a, b."type" as type_b, a.nullable as nullable_a, b.nullable as nullable_b,
 a.column_key as column_key_a, b.column_key as column_key_b,
 a.default_value as default_value_a, b.default_value as default_value_b,
 a.extra as extra_a, b.extra as extra_b
from (select * from {m8_columns} where side = 'A') a
full join (select * from {m8_columns} where side = 'B') b
 on b.table_name = a.table_name and b.column_name = a.column_name""",
    "o_index_pairs": """select coalesce(a.table_name, b.table_name) as table_name,
 coalesce(a.key_name, b.key_name) as key_name, a.side as sa, b.side as sb,
 a.columns as columns_a, b.columns as columns_b, a.nulls as nulls_a, b.nulls as nulls_b
from (select * from {o_indexes} where side = 'A') a
full join (select * from {o_indexes} where side = 'B') b
 on b.table_name = a.table_name and b.key_name = a.key_name""",
    "o_common": """select table_name from {m8_columns} group by table_name
 having count(distinct side) = 2""",
    "o_elsewhere": """select i.* from {m10_instances} i
where exists (select 1 from {m10_ledger} l where l.instance_port = i.instance_port
  and l.backup_day >= timestamp '2001-06-01 00:00:00')
 and not exists (select 1 from {m10_ledger} l where l.instance_port = i.instance_port
  and l.instance_ip = i.instance_ip and l.backup_day >= timestamp '2001-06-01 00:00:00')""",
    "o_status": """select instance_port, instance_ip, trim(substr(row, 1, instr(row, ':') - 1)) as name,
 trim(substr(row, instr(row, ':') + 1)) as value
from (select *, row_number() over (partition by instance_port, instance_ip,
          trim(substr(row, 1, instr(row, ':') - 1)) order by pos desc) as rn
      from (select instance_port, instance_ip,
              unnest(string_split(status_text, chr(10))) as row,
              generate_subscripts(string_split(status_text, chr(10)), 1) as pos
            from {m13_replica}) a where contains(row, ':')) b where rn = 1""",
    "o_master": """select r.instance_port, r.instance_ip, not coalesce(io = 'Yes' and sq = 'Yes', false)
   as is_master, coalesce(n, 0) > 0 and not coalesce(io = 'Yes' and sq = 'Yes', false)
   as replica_broken
from {m13_replica} r left join (select instance_port, instance_ip, count(*) as n,
   max(value) filter (name = 'Slave_IO_Running') as io,
   max(value) filter (name = 'Slave_SQL_Running') as sq
   from {o_status} group by instance_port, instance_ip) s
 on s.instance_port = r.instance_port and s.instance_ip = r.instance_ip""",
}

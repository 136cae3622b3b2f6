"""Column contracts of the telemetry tables, and the check that enforces them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "string": T.StringType(), "time": T.TimestampNTZType(),
          "bool": T.BooleanType()}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in columns.items()])


LOG_LINES = _schema(file="string", line_no="long", line="string")
TRANSACTIONS = _schema(
    file="string", xid="long", n_rows="long", size="long", secs="long", start_time="time",
    end_time="time", start_line="long", end_line="long", start_pos="long", end_pos="long",
    last_committed="long", sequence_number="long", is_complete="bool", is_implicit="bool")
PROCESSLIST = _schema(
    instance="long", snapshot_ts="time", id="long", user="string", host="string",
    db="string", command="string", time="long", state="string", info="string",
    rows_sent="long", rows_examined="long")
INNODB_TRX = _schema(
    instance="long", snapshot_ts="time", trx_id="long", trx_state="string",
    trx_started="time", trx_wait_started="time", requested_lock_id="string",
    thread_id="long", trx_query="string", tables_in_use="long", tables_locked="long",
    isolation_level="string", rows_modified="long")
LOCK_WAITS = _schema(instance="long", snapshot_ts="time", requesting="long",
                     blocking="long", lock_id="string")
LOCKS = _schema(instance="long", snapshot_ts="time", lock_id="string", lock_mode="string",
                lock_type="string", lock_table="string", lock_index="string")
METADATA_LOCKS = _schema(
    instance="long", snapshot_ts="time", owner_thread_id="long", object_type="string", object_schema="string",
    object_name="string", lock_type="string", lock_duration="string", lock_status="string")
THREADS = _schema(instance="long", snapshot_ts="time", id="long", thread_id="long")
OPEN_TABLES = _schema(instance="long", snapshot_ts="time", database="string", table="string",
                      in_use="long")
SERVER_FACTS = _schema(instance="long", snapshot_ts="time", name="string", value="string")
CATALOG_TABLES = _schema(table_name="string", create_sql="string")
CATALOG_COLUMNS = _schema(table_name="string", column_name="string", type="string",
                          nullable="string", column_key="string", default_value="string",
                          extra="string")
CATALOG_INDEXES = _schema(table_name="string", key_name="string", seq_in_index="long",
                          column_name="string", nullable="string")
VARIABLES = _schema(instance="long", snapshot_ts="time", name="string", value="string")
LEDGER = _schema(
    run_id="long", instance_port="long", stage="string", stage_ts="time", status="string",
    message="string", to_lsn="long", instance_ip="string", backup_type="string", backup_begin_time="time",
    backup_end_time="time", backup_day="time", to_hdfs="string", to_hdfs_time="time",
    backup_file_checksum="string", backup_size="string", backup_file_name="string",
    expired="string", isdelete="string", backup_tool="string",
    backup_storage_type="string", backup_storage_ip="string", backup_storage_zone="string")
STORAGE = _schema(storage_type="string", storage_dir="string", storage_param="string",
                  storage_ip="string", storage_zone="string")
POLICY = _schema(backup_cron="string", backup_ip="string", backup_port="long",
                 backup_took="string", backup_type="string", backup_retention="long",
                 storage_id="long")
INSTANCES = _schema(cluster="string", ip="string", port="long", master_ip="string")

# Columns a table may lack: a capture of one server, or of one moment, has no such key.
_OPTIONAL = ("instance", "snapshot_ts")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The contract's columns, in order and cast; names match without case. Columns of the
    contract that are missing raise, columns beyond it are pruned from the scan. A cell that
    does not fit its type becomes NULL; it does not fail the job."""
    have = {c.lower(): c for c in df.columns}
    missing = [f.name for f in schema
               if f.name not in have and f.name not in _OPTIONAL]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df.select(*[F.col(f"`{have[f.name]}`").try_cast(f.dataType).alias(f.name)
                       for f in schema if f.name in have])

"""Table inputs and outputs: snapshots, catalogs, ledger, manifest, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens import schemas as S
from fleetlens.operators.ordered import moment_keys


def scan_processlist(df: DataFrame) -> DataFrame:
    return S.conform(df, S.PROCESSLIST)


def scan_locks(trx: DataFrame, waits: DataFrame, locks: DataFrame, mdl: DataFrame,
               threads: DataFrame) -> dict[str, DataFrame]:
    """The five lock tables of a capture, each held to its contract."""
    return {"trx": S.conform(trx, S.INNODB_TRX), "waits": S.conform(waits, S.LOCK_WAITS),
            "locks": S.conform(locks, S.LOCKS), "mdl": S.conform(mdl, S.METADATA_LOCKS),
            "threads": S.conform(threads, S.THREADS)}


def scan_catalog(tables: DataFrame, columns: DataFrame,
                 indexes: DataFrame) -> dict[str, DataFrame]:
    """A catalog as three tables, one scan each."""
    return {"tables": S.conform(tables, S.CATALOG_TABLES),
            "columns": S.conform(columns, S.CATALOG_COLUMNS),
            "indexes": S.conform(indexes, S.CATALOG_INDEXES)}


def scan_variables(df: DataFrame) -> DataFrame:
    return S.conform(df, S.VARIABLES)


def variables_map(variables: DataFrame) -> DataFrame:
    """One MAP per instance and moment, for callers at the edge; a server has some hundred
    names."""
    entry, keys = F.struct("name", "value"), moment_keys(variables)
    return variables.groupBy(*keys, "name").agg(F.max("value").alias("value")).groupBy(
        *keys).agg(F.map_from_entries(F.collect_list(entry)).alias("variables"))


def scan_policies(df: DataFrame) -> DataFrame:
    return S.conform(df, S.POLICY)


def scan_storage(df: DataFrame) -> DataFrame:
    return S.conform(df, S.STORAGE)


def scan_instances(df: DataFrame) -> DataFrame:
    return S.conform(df, S.INSTANCES)


def read_ledger(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The backup ledger; ``since`` prunes day partitions."""
    ledger = spark.read.schema(S.LEDGER).parquet(path).select(*S.LEDGER.fieldNames())
    return ledger if since is None else ledger.filter(
        F.col("backup_day") >= F.lit(since).cast("timestamp_ntz"))


def append_ledger(df: DataFrame, path: str) -> None:
    """Append rows, one folder per day; columns a row source lacks are NULL. The rebalance gathers a day for few files and lets
    AQE split a day that is too large for one writer."""
    lacking = [f for f in S.LEDGER if f.name not in df.columns]
    whole = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking})
    rows = S.conform(whole, S.LEDGER).hint("rebalance", F.col("backup_day"))
    rows.write.mode("append").partitionBy("backup_day").parquet(path)


def content_manifest(df: DataFrame, id_col: str, content: str, *keep: str) -> DataFrame:
    """Size and checksum of contents that are already a column."""
    data: Column = F.col(content).cast("binary")
    return df.select(id_col, *keep, F.md5(data).alias("checksum"),
                     F.octet_length(data).cast("bigint").alias("size_bytes"))


def jdbc_options(url: str, table: str, partition_column: str | None = None,
                 lower: int | None = None, upper: int | None = None,
                 partitions: int = 8, fetch_size: int = 10_000,
                 extra: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a partitioned read; ``partitions`` is also the number of connections."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **(extra or {})}
    if partition_column is None:
        return options
    if lower is None or upper is None:
        raise ValueError("a partition column needs its bounds")
    return {**options, "partitionColumn": partition_column, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions)}


def jdbc_snapshot(spark: SparkSession, url: str, table: str, **how) -> DataFrame:
    """A server table or query over JDBC; the driver jar comes from the cluster."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **how)).load()


# Columns of the four tabular reports.
REPORTS = {
    "processlist": ("id", "user", "host", "db", "command", "time", "state", "info",
                    "rows_sent", "rows_examined"),
    "mdl_holders": ("id", "user", "host", "db", "command", "time", "owner_thread_id",
                    "object_type", "object_schema", "object_name", "lock_type",
                    "lock_duration", "lock_status"),
    "long_transactions": ("trx_id", "trx_state", "trx_started", "requested_lock_id",
                          "thread_id", "trx_query", "tables_in_use", "tables_locked",
                          "isolation_level", "user", "host", "db", "info"),
    "lock_waits": ("waiting_thread", "waiting_query", "waiting_rows_modified",
                   "waiting_age", "waiting_wait_secs", "waiting_user", "waiting_host",
                   "waiting_db", "blocking_thread", "blocking_query",
                   "blocking_rows_modified", "blocking_age", "blocking_wait_secs",
                   "blocking_user", "blocking_host", "blocking_db"),
}


def report(df: DataFrame, name: str) -> DataFrame:
    """The columns of a report, led by whatever moment keys the data carries."""
    keys = [k for k in ("instance", "snapshot_ts") if k in df.columns]
    return df.select(*keys, *REPORTS[name])


def write_report(df: DataFrame, path: str, fmt: str = "parquet",
                 mode: str = "overwrite") -> None:
    """Write a report as parquet, csv (with header), json, or text (one string column)."""
    if fmt not in ("parquet", "csv", "json", "text"):
        raise ValueError("fmt is parquet, csv, json or text")
    writer = df.write.mode(mode)
    (writer.option("header", "true") if fmt == "csv" else writer).format(fmt).save(path)

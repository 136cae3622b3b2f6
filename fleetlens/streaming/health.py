"""Rolling health of a process-list stream, and a policy change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.operators.backup import policy_sync
from fleetlens.operators.threads import CLASSES, active_threads, classify_threads
from fleetlens.session import store
from fleetlens.streaming import versions


def stream_health(pl: DataFrame, window: str = "1 day", watermark: str = "1 hour",
                  time_col: str = "snapshot_ts", min_time: int = 10) -> DataFrame:
    """Class counts and symptom flags per instance and tumbling window (append mode).

    Rows later than the watermark are dropped and state older than it is freed.
    """
    timed = classify_threads(active_threads(pl, min_time)).withColumn(
        "_at", F.col(time_col).cast("timestamp")).withWatermark("_at", watermark)
    counts = timed.groupBy("instance", F.window("_at", window).alias("_w")).agg(
        *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in CLASSES])
    dml, commits = F.col("n_dml"), F.col("n_commit")
    login, unauth = F.col("n_login"), F.col("n_unauthenticated")
    return counts.select(
        "instance", F.col("_w.start").cast("timestamp_ntz").alias("window_start"),
        *[f"n_{c}" for c in CLASSES],
        ((dml < 5) & (unauth > 5)).alias("unauthenticated_pileup"),
        (((dml > 5) | (commits > 5)) & (login > 5) & (unauth > 5))
        .alias("disk_full_suspected"),
        (commits > 2).alias("slow_commit_io"))


def policy_actions(feed: DataFrame, installed: DataFrame) -> DataFrame:
    """Actions for the hosts named in a piece of the feed; of several events of a host the
    one with the highest ``seq`` counts. ``removed`` events withdraw a policy."""
    keys = ["backup_port", "backup_ip"]
    last = feed.groupBy(*keys).agg(F.max(F.struct("seq", "removed", "backup_cron"))
                                   .alias("e")).select(*keys, "e.removed", "e.backup_cron")
    touched = installed.join(last.select(*keys), keys, "left_semi")
    return policy_sync(last.filter(~F.coalesce("removed", F.lit(False))), touched)


# Tables under the folder of a feed, and their columns.
INSTALLED, ACTIONS = "installed", "actions"
_JOB = "backup_port bigint, backup_ip string, backup_cron string"
_ACTION = "backup_port bigint, backup_ip string, policy_cron string, installed_cron string, action string"


def take_policies(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Compare one piece of the feed with the jobs as the batches before have left them; store its
    actions, and the jobs as its actions leave them."""
    spark = batch.sparkSession
    jobs = store(versions.newest(spark, folder, INSTALLED, _JOB, batch_id), "jobs")
    actions = store(policy_actions(batch, jobs), "actions")
    versions.write(actions, folder, ACTIONS, batch_id)
    keys = ["backup_port", "backup_ip"]
    gone = actions.filter("installed_cron is not null or action <> 'add'").select(
        *keys, F.col("installed_cron").alias("backup_cron"))
    came = actions.filter("action <> 'remove'").select(*keys, F.col("policy_cron").alias("backup_cron"))
    versions.write(jobs.exceptAll(gone).unionByName(came), folder, INSTALLED, batch_id)


def stream_policy_changes(feed: DataFrame, installed: DataFrame, folder: str, checkpoint: str,
                          **trigger) -> StreamingQuery:
    """Start the feed over the jobs that are ``installed`` now (kept if the feed has run before).

    The state is the list of jobs, one version per batch. Each batch reads the version before
    its own and writes its actions and its own version, so later batches see what earlier ones
    have changed, and a batch that is run again replaces itself. Results:
    ``read_policy_actions`` and ``read_installed_jobs``.
    """
    spark = feed.sparkSession
    if versions.newest(spark, folder, INSTALLED, _JOB).isEmpty():
        versions.write(installed.select("backup_port", "backup_ip", "backup_cron"), folder, INSTALLED, -1)
    writer = feed.writeStream.foreachBatch(
        lambda batch, batch_id: take_policies(batch, batch_id, folder)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_policy_actions(spark: SparkSession, folder: str) -> DataFrame:
    return versions.all_versions(spark, folder, ACTIONS, _ACTION)


def read_installed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return versions.newest(spark, folder, INSTALLED, _JOB)

"""Backup ledger, gates, chains, retention and policy coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.logtext import as_bigint
from fleetlens.functions.values import parse_size
from fleetlens.operators.ordered import bucketed_offset

# Stage names the backup driver writes to the ledger.
STAGES = ("create remote dir", "take backup", "send backup to remote", "get file size",
          "get md5", "is_backuped", "check_pre_job", "final")
HOST = ("instance_port", "instance_ip")
DUMP_TOOL = "mysqldump"
DEFAULT_RETENTION_DAYS = 30


def status_entries(text: Column) -> Column:
    """ARRAY<STRUCT<name, value>> of ``key: value`` lines; the first colon splits."""
    rows = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    return F.transform(rows, lambda x: F.struct(
        F.btrim(F.substring_index(x, ":", 1)).alias("name"),
        F.btrim(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value")))


def _last_value(entries: Column, name: str) -> Column:
    return F.try_element_at(F.filter(entries, lambda e: e["name"] == name),
                            F.lit(-1))["value"]


def parse_replica_status(df: DataFrame, text_col: str = "status_text") -> DataFrame:
    """Replica status text to rows (name, value); of a repeated key the last line counts.
    Stays within the row: no shuffle."""
    entries = status_entries(F.col(text_col))
    kept = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
        lambda later: later["name"] == e["name"]))
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.inline(kept))


def is_master(df: DataFrame, text_col: str = "status_text") -> DataFrame:
    """No status, or not both threads running, counts as master; the second case is also
    told apart as ``replica_broken``."""
    entries = status_entries(F.coalesce(F.col(text_col), F.lit("")))
    io, sql = (_last_value(entries, f"Slave_{t}_Running") for t in ("IO", "SQL"))
    running = F.coalesce((io == "Yes") & (sql == "Yes"), F.lit(False))
    return (df.withColumn("is_master", ~running)
            .withColumn("replica_broken", (F.size(entries) > 0) & ~running).drop(text_col))


def backed_up_elsewhere(instances: DataFrame, ledger: DataFrame, as_of: str) -> DataFrame:
    """Instances whose port has ledger rows from ``as_of``'s day on, none by this host."""
    day = F.date_trunc("day", F.lit(as_of).cast("timestamp_ntz")).cast("timestamp_ntz")
    today = ledger.filter(F.col("backup_day") >= day).select(*HOST).distinct()
    return (instances.join(today.select("instance_port").distinct(), "instance_port",
                           "left_semi").join(today, list(HOST), "left_anti"))


def backup_gate(instances: DataFrame, ledger: DataFrame, running: DataFrame,
                as_of: str) -> DataFrame:
    """May a backup start? First failing test wins: master, done elsewhere, still running.
    ``instances`` carries ``is_master``; ``running`` lists hosts with a job in progress."""
    elsewhere = backed_up_elsewhere(instances, ledger, as_of).select(
        *HOST, F.lit(True).alias("_elsewhere")).distinct()
    busy = running.select(*HOST, F.lit(True).alias("_busy")).distinct()
    stage = (F.when(F.col("is_master"), "check_master")
             .when(F.col("_elsewhere"), "is_backuped")
             .when(F.col("_busy"), "check_pre_job").otherwise("run"))
    message = (F.when(F.col("gate_stage") == "check_master",
                      "a master must not run the backup")
               .when(F.col("gate_stage") == "is_backuped",
                     "another host has already taken today's backup")
               .when(F.col("gate_stage") == "check_pre_job",
                     "the previous backup job is still running"))
    return (instances.join(elsewhere, list(HOST), "left").join(busy, list(HOST), "left")
            .withColumn("gate_stage", stage)
            .withColumn("status", F.when(F.col("gate_stage") == "run", "run")
                        .otherwise("fail"))
            .withColumn("message", message).drop("_elsewhere", "_busy"))


def suspicious_backups(ledger: DataFrame) -> DataFrame:
    """Backups whose size is zero."""
    return ledger.withColumn("size_bytes", parse_size(F.col("backup_size"))).filter(
        "size_bytes = 0")


def backup_status(ledger: DataFrame) -> DataFrame:
    """Per host and day the latest stage and status, and the latest status of every stage.

    Aggregated per stage first, so a busy host reaches the second step as a few rows.
    """
    keys = [*HOST, "backup_day"]
    per_stage = ledger.groupBy(*keys, "stage").agg(
        F.max(F.struct("stage_ts", "run_id", "status")).alias("last"),
        F.count("*").alias("n"))
    latest = F.max(F.struct(F.col("last.stage_ts"), F.col("last.run_id"),
                            F.col("stage"), F.col("last.status").alias("status")))
    named = [F.max(F.when(F.col("stage") == s, F.col("last.status")))
             .alias(s.replace(" ", "_")) for s in STAGES]
    return (per_stage.groupBy(*keys).agg(latest.alias("_l"),
                                         F.sum("n").alias("n_records"), *named)
            .withColumn("last_stage", F.col("_l.stage"))
            .withColumn("last_status", F.col("_l.status")).drop("_l"))


def backup_chain(ledger: DataFrame) -> DataFrame:
    """Base position of each run: ``to_lsn`` of the host's previous run of the day, else a
    full backup; the dump tool is always full. Split by hour, carried across hours."""
    keyed = ledger.withColumn("_hour", F.date_trunc("hour", F.col("stage_ts"))
                              .cast("timestamp_ntz"))
    linked = bucketed_offset(keyed, [*HOST, "backup_day"], "_hour", ["stage_ts", "run_id"],
                             {"to_lsn": "previous_lsn"})
    base = F.when(F.col("backup_tool") != DUMP_TOOL, F.col("previous_lsn"))
    return linked.select(*HOST, "backup_day", "run_id", "to_lsn", base.alias("base_lsn"),
                         F.when(base.isNull(), "full").otherwise("incremental")
                         .alias("backup_type"))


def last_checkpoint_lsn(lines: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Value of the last ``to_lsn = N`` line per key; the aggregate keeps two numbers."""
    found = lines.filter(F.col("line").contains("to_lsn"))
    value = as_bigint(F.btrim(F.try_element_at(F.split("line", "="), F.lit(2))))
    return found.groupBy(*keys).agg(F.max_by(value, "line_no").alias("to_lsn"))


def uncovered_instances(instances: DataFrame, policies: DataFrame) -> DataFrame:
    """Instances no policy names."""
    named = policies.select(F.col("backup_port").alias("instance_port"),
                            F.col("backup_ip").alias("instance_ip"))
    return instances.join(named, list(HOST), "left_anti")


def _typed(*frames: DataFrame) -> list[str]:
    return ["backup_type"] if all("backup_type" in f.columns for f in frames) else []


def policy_sync(policies: DataFrame, installed: DataFrame) -> DataFrame:
    """What turns the installed jobs into the policies: add, remove or change.

    The jobs of a host are a multiset of schedules; where both sides carry ``backup_type``, those of
    a host and type. Equal schedules cancel out one by one. Of what is left, in order, a policy
    and a job make a change; policies beyond that are added, jobs beyond that removed.
    """
    keys = ["backup_port", "backup_ip", *_typed(policies, installed)]

    def side(df: DataFrame, name: str) -> DataFrame:
        copy = F.row_number().over(Window.partitionBy(*keys, "backup_cron").orderBy("backup_cron"))
        return df.select(*keys, F.col("backup_cron").alias(name), copy.alias("_copy"), F.lit(True).alias(f"_{name}"))
    wanted, present = side(policies, "policy_cron"), side(installed, "installed_cron")
    same = reduce(lambda x, y: x & y, [F.col(f"w.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]) \
        & F.col("policy_cron").eqNullSafe(F.col("installed_cron")) & (F.col("w._copy") == F.col("p._copy"))

    def rest(df: DataFrame, other: DataFrame, name: str, left: str, right: str) -> DataFrame:
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(name))
        return df.alias(left).join(other.alias(right), same, "left_anti").select(
            *keys, name, f"_{name}", turn.alias("_turn"))
    lacking = rest(wanted, present, "policy_cron", "w", "p")
    extra = rest(present, wanted, "installed_cron", "p", "w")
    action = F.when(F.col("_installed_cron").isNull(), "add").when(
        F.col("_policy_cron").isNull(), "remove").otherwise("change")
    return lacking.join(extra, [*keys, "_turn"], "full").select(
        *keys, "policy_cron", "installed_cron", action.alias("action"))


def expired_backups(ledger: DataFrame, policies: DataFrame, as_of: str,
                    default_days: int = DEFAULT_RETENTION_DAYS) -> DataFrame:
    """Backups past their retention that are not deleted yet. The cutoff of the shortest
    possible retention is no constant, so the day filter sits above the policy join. Where
    both sides carry ``backup_type``, a backup follows the policy of its type; of several
    policies for the same key the longest retention holds."""
    keys = [*HOST, *_typed(ledger, policies)]
    keep = (policies.withColumnsRenamed({"backup_port": "instance_port",
                                         "backup_ip": "instance_ip"})
            .groupBy(*keys).agg(F.max("backup_retention").alias("backup_retention")))
    days = F.coalesce(F.col("backup_retention"), F.lit(default_days)).cast("int")
    return (ledger.filter(F.col("isdelete") != "yes").join(keep, keys, "left")
            .withColumn("retention_days", days.cast("bigint")).drop("backup_retention")
            .filter(F.date_add(F.col("backup_day").cast("date"),
                               F.col("retention_days").cast("int"))
                    < F.lit(as_of).cast("date")))

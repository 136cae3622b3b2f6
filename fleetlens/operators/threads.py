"""Process-list analysis: who is active, what kind of work it is, what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.statements import extract_tables
from fleetlens.operators.ordered import MOMENT, moment_keys

# Statement states that make a thread count as long-running work.
DML_STATES = ("update", "updating", "deleting from main table",
              "deleting from reference tables", "User sleep", "executing",
              "updating main table", "updating reference tables",
              "Searching rows for update")
SELECT_STATES = ("Sending data", "Copying to tmp table", "User sleep",
                 "Copying to tmp table on disk", "Creating sort index", "executing",
                 "Sorting for group", "Sorting for order", "Sorting result",
                 "removing tmp table", "Sending to client")
DDL_STATES = ("altering table", "copy to tmp table", "Creating index",
              "committing alter table to storage engine", "discard_or_import_tablespace",
              "preparing for alter table", "rename")
SYSTEM_USER, SLEEPING, UNAUTHENTICATED = "system user", "Sleep", "unauthenticated user"

LONG_CLASSES = ("select", "dml", "ddl")
CLASSES = (*LONG_CLASSES, "commit", "login", "unauthenticated", "other", "skipped")


def is_active(min_time: int) -> Column:
    return ((F.col("time") >= min_time) & (F.col("user") != SYSTEM_USER)
            & (F.col("command") != SLEEPING))


def active_threads(pl: DataFrame, min_time: int = 10) -> DataFrame:
    """Threads that have run ``min_time`` seconds or more; one filter, pushed to the scan."""
    return pl.filter(is_active(min_time))


def thread_class(strict_dml: bool = False, count_null_info: bool = False) -> Column:
    """Class of a thread, first match wins. By default the state test binds to INSERT only
    and a thread without a statement is ``skipped``."""
    prefix = F.lower(F.substring("info", 1, 20))
    state = F.coalesce(F.col("state"), F.lit(""))

    def starts(*words: str) -> Column:
        found = prefix.startswith(words[0])
        for word in words[1:]:
            found = found | prefix.startswith(word)
        return F.coalesce(found, F.lit(False))
    in_dml = state.isin(*DML_STATES)
    dml = (starts("update", "delete", "insert") & in_dml if strict_dml
           else starts("update", "delete") | (starts("insert") & in_dml))
    chain = (F.when(dml, "dml")
             .when(starts("select") & state.isin(*SELECT_STATES), "select")
             .when(starts("alter", "drop", "truncate") & state.isin(*DDL_STATES), "ddl")
             .when(F.col("user") == UNAUTHENTICATED, "unauthenticated")
             .when(F.col("info") == "commit", "commit")
             .when(state == "login", "login"))
    empty = F.coalesce(F.col("info"), F.lit("")) == ""
    if count_null_info:
        return chain.when(empty, "skipped").otherwise("other")
    return F.when(empty, "skipped").otherwise(chain.otherwise("other"))


def classify_threads(active: DataFrame, strict_dml: bool = False,
                     count_null_info: bool = False) -> DataFrame:
    return active.withColumn("class", thread_class(strict_dml, count_null_info))


def thread_class_counts(classified: DataFrame) -> DataFrame:
    """Threads per class and moment; partial counts keep the shuffle at one row per task
    and moment."""
    return classified.groupBy(*moment_keys(classified)).agg(
        *[F.count_if(F.col("class") == c).alias(f"n_{c}") for c in CLASSES])


def server_symptoms(counts: DataFrame) -> DataFrame:
    """Whole-server symptoms of each moment, one row per symptom."""
    dml, commits = F.col("n_dml"), F.col("n_commit")
    login, unauth = F.col("n_login"), F.col("n_unauthenticated")
    symptoms = F.array_compact(F.array(
        F.when((dml < 5) & (unauth > 5), F.lit("unauthenticated_pileup")),
        F.when(((dml > 5) | (commits > 5)) & (login > 5) & (unauth > 5),
               F.lit("disk_full_suspected")),
        F.when(commits > 2, F.lit("slow_commit_io"))))
    return counts.select(*moment_keys(counts), F.explode(symptoms).alias("symptom"))


def open_table_pressure(active: DataFrame, limit: int = 10) -> DataFrame:
    return active.groupBy(*moment_keys(active)).agg(
        F.count_if(F.col("state") == "Opening tables").alias("n_opening")
    ).withColumn("pressure", F.col("n_opening") > limit)


def open_tables_in_use(tables: DataFrame) -> DataFrame:
    return tables.filter((F.col("in_use") > 0) & (F.col("database") != "performance_schema"))


def server_verdict(pl: DataFrame, long_trx: DataFrame, min_time: int = 10) -> DataFrame:
    """Per moment of ``pl``: healthy, uncommitted transactions only, or worth analysing."""
    keys = moment_keys(pl)
    active = pl.groupBy(*keys).agg(
        F.count_if(F.coalesce(is_active(min_time), F.lit(False))).alias("n_active"))
    shared = moment_keys(pl, long_trx)
    waiting = long_trx.groupBy(*shared).agg(F.count("*").alias("n_long_trx"))
    how = "full" if shared == keys else "left"
    both = active.join(waiting, shared, how).fillna(0, ["n_active", "n_long_trx"])
    return both.withColumn("verdict", F.when(F.col("n_active") > 0, "analyse")
                           .when(F.col("n_long_trx") > 0, "uncommitted_transactions")
                           .otherwise("healthy"))


def exclude_handled(rows: DataFrame, handled: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is not handled yet."""
    return rows.join(handled, [*moment_keys(rows, handled), id_col], "left_anti")


def top_threads(classified: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` longest threads of each moment and long class, with ``truncated`` telling
    that more exist. Ranks are cut to ``n`` per group before the shuffle."""
    keys = [*moment_keys(classified), "class"]
    rows = classified.filter(F.col("class").isin(*LONG_CLASSES))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("time"), "id")
    best = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    sizes = rows.groupBy(*keys).agg((F.count("*") > n).alias("truncated"))
    return best.join(sizes, keys)


def top_long_transactions(long_trx: DataFrame, n: int = 100,
                          order: str = "newest") -> DataFrame:
    """Per moment the ``n`` newest (or oldest) long transactions."""
    by = F.desc("trx_started") if order == "newest" else F.asc("trx_started")
    w = Window.partitionBy(*moment_keys(long_trx)).orderBy(by, "trx_id")
    return long_trx.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def table_usage(query_log: DataFrame, text_col: str = "info") -> DataFrame:
    """How often each table is referenced, per instance when the log names instances."""
    keys = [k for k in MOMENT[:1] if k in query_log.columns]
    refs = query_log.select(*keys, F.explode(extract_tables(F.col(text_col))).alias("r"))
    return refs.groupBy(*keys, F.col("r.schema").alias("schema_name"),
                        F.col("r.table").alias("table_name")).agg(
        F.count("*").alias("n_references"))


def revalidate(candidates: DataFrame, fresh_pl: DataFrame) -> DataFrame:
    """What became of each candidate in a fresh snapshot: gone, query_ended, actionable."""
    keys = [*[k for k in MOMENT[:1] if k in candidates.columns and k in fresh_pl.columns],
            "id"]
    now = fresh_pl.select(*keys, F.lit(True).alias("_seen"), F.col("info").alias("_info"))
    return candidates.join(now, keys, "left").withColumn(
        "status", F.when(F.col("_seen").isNull(), "gone")
        .when(F.coalesce(F.col("_info"), F.lit("")) == "", "query_ended")
        .otherwise("actionable")).drop("_seen", "_info")

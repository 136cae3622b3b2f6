"""From classified threads and server facts to findings, flags and proposed actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.statements import first_table
from fleetlens.operators.locks import (MDL_WAIT, blocker_counts, blocker_statements, mdl_waiters,
                                       version_family)
from fleetlens.operators.ordered import MOMENT, moment_keys
from fleetlens.operators.threads import LONG_CLASSES, classify_threads
from fleetlens.session import store

FACTS = ("version", "performance_schema", "mdl_instrument", "global_instrumentation",
         "read_only", "is_replica")
GLOBAL_READ_LOCK = "Waiting for global read lock"
FLUSH_STATEMENT = "flush tables with read lock"

# state, finding, advice, show the statement, ladder, transaction problem, query problem
RULES = (
    ("Rolling back", "rolling_back", "a transaction is being rolled back",
     False, "none", False, False),
    ("deleting from reference tables", "second_phase_delete",
     "a multi-table delete is in its second phase; rewrite the statement",
     False, "none", False, False),
    ("Receiving from client", "client_network",
     "check name resolution and the network to the client", False, "none", False, False),
    ("Reading from net", "client_network",
     "check name resolution and the network to the client", False, "none", False, False),
    ("System lock", "system_lock",
     "check I/O, long statements and tables without a primary key",
     False, "none", True, True),
    ("altering table", "big_ddl", "a large table is being altered",
     True, "none", False, False),
    ("statistics", "stale_statistics", "refresh table statistics",
     False, "none", False, False),
    ("Creating sort index", "sort_without_index", "give the sort an index",
     True, "none", False, False),
    ("Waiting for commit lock", "commit_lock", "commits are held by a lock",
     False, "plain", False, False),
    ("Sending data", "reads_many_rows", "read fewer rows or enlarge the buffer pool",
     True, "none", False, False),
    ("Copying to tmp table", "temporary_table",
     "rewrite the statement, then consider larger temporary tables",
     True, "none", False, False),
    ("Copying to tmp table on disk", "temporary_table",
     "rewrite the statement, then consider larger temporary tables",
     True, "none", False, False),
    ("Sending to client", "result_too_large",
     "return fewer rows, then consider larger network buffers",
     True, "none", False, False),
    ("Waiting for table flush", "table_flush",
     "blocked by a table lock or a long statement", True, "flush", False, False),
)


def rules_table(spark: SparkSession) -> DataFrame:
    """The state rules as a table of literals, small enough that Spark broadcasts it."""
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(
        ("state", "finding", "advice", "shows_statement", "ladder", "trx_problem",
         "query_problem"), rule)]) for rule in RULES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def server_facts(facts: DataFrame) -> DataFrame:
    """Key/value facts to one row per instance. The pivot list is given, so no extra pass
    over the data looks for it."""
    wide = facts.groupBy("instance").pivot("name", list(FACTS)).agg(F.max("value"))
    return (wide.withColumn("version_family", version_family(F.col("version")))
            .withColumn("is_replica", F.col("is_replica") == "YES"))


def _plain_ladder() -> Column:
    on, named = F.col("performance_schema") == "ON", F.col("mdl_instrument")
    return (F.when(on & (named == "YES"), "show_holders")
            .when(named == "NO", "instrument_disabled")
            .when(F.col("performance_schema") != "ON", "performance_schema_off"))


def _flush_ladder() -> Column:
    on, named = F.col("performance_schema") == "ON", F.col("mdl_instrument")
    return (F.when(on & (named == "YES"), "show_holders")
            .when(named != "YES", "instrument_disabled")
            .when(F.col("performance_schema") != "ON", "performance_schema_off"))


def mdl_visibility(facts: DataFrame) -> DataFrame:
    """Can the holder of a metadata lock be named on this instance? ``facts`` is pivoted."""
    return facts.select("instance", _plain_ladder().alias("visibility"),
                        _flush_ladder().alias("flush_visibility"))


#: Every state that leads to a finding.
STATES = (*(rule[0] for rule in RULES), GLOBAL_READ_LOCK, MDL_WAIT, "updating", "Opening tables")
_RULE = ("state", "finding", "advice", "shows_statement", "ladder", "trx_problem", "query_problem")


def relevant_threads(active: DataFrame) -> DataFrame:
    """The classified threads that a diagnosis looks at: those in a telling state, and the long
    statements; with only the columns it needs."""
    keep = F.col("state").isin(*STATES) | F.col("class").isin(*LONG_CLASSES)
    return classify_threads(active).filter(keep).select(
        *moment_keys(active), "id", "state", "info", "class")


def _moment_facts(threads: DataFrame, open_tables: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per moment: n_ddl, n_opening, n_in_use; and the keys it is found by.

    Threads and open tables are stacked and counted together, so a moment is one row of one
    aggregate. Open tables that name fewer keys than the threads are counted by those.
    """
    keys, shared = moment_keys(threads), moment_keys(threads, open_tables)
    none = F.lit(0)
    counted = threads.select(*keys, (F.col("class") == "ddl").cast("int").alias("n_ddl"), F.coalesce(
        (F.col("state") == "Opening tables").cast("int"), none).alias("n_opening"), none.alias("n_in_use"))
    used = open_tables.select(*shared, none.alias("n_ddl"), none.alias("n_opening"), F.lit(1).alias("n_in_use"))
    sums = [F.sum(c).alias(c) for c in ("n_ddl", "n_opening", "n_in_use")]
    if shared == keys:
        return counted.unionByName(used).groupBy(*keys).agg(*sums), keys
    per_moment = counted.groupBy(*keys).agg(*sums[:2])
    return per_moment.join(used.groupBy(*shared).agg(sums[2]), shared, "left"), keys


def _found(finding: Column | str, advice: Column | str, trx: Column | bool = False, query: Column | bool = False,
           detail: Column | None = None, visibility: Column | None = None) -> Column:
    def column(value) -> Column:
        return value if isinstance(value, Column) else F.lit(value)
    none = F.lit(None).cast("string")
    return F.struct(
        column(finding).alias("finding"), column(advice).alias("advice"),
        (none if detail is None else detail).alias("detail"),
        (none if visibility is None else visibility).alias("visibility"),
        F.coalesce(column(trx), F.lit(False)).alias("trx_problem"),
        F.coalesce(column(query), F.lit(False)).alias("query_problem"))


def _of_rules(rules: Column) -> Column:
    """Findings of the rules (an array) that a thread's state meets."""
    return F.transform(rules, lambda r: _found(
        r["finding"], r["advice"], r["trx_problem"], r["query_problem"],
        F.when(r["shows_statement"], F.col("info")),
        F.when(r["ladder"] == "plain", F.col("plain")).when(r["ladder"] == "flush", F.col("flush"))))


def _of_states() -> list[Column]:
    """Findings that need more than the state, each NULL where it does not apply."""
    info, state, no = F.col("info"), F.col("state"), F.lit(False)
    flushing = F.coalesce(info == FLUSH_STATEMENT, no)
    idle = F.coalesce(F.col("n_in_use"), F.lit(0)) == 0
    read_lock = F.when(state == GLOBAL_READ_LOCK, _found(
        F.when(flushing, "flush_is_waiting").when(idle, "blocked_by_flush")
        .otherwise("blocked_by_long_query"),
        F.when(flushing, "end the long statements and transactions the flush waits for")
        .when(idle, "find the session that flushed tables with a read lock")
        .otherwise("a long statement holds up the read lock"),
        flushing | ~idle, flushing | ~idle, F.when(~flushing, info),
        F.when(~flushing & idle, F.col("plain"))))

    named = F.col("table_name").isNotNull()
    blocked = F.coalesce("n_all", F.lit(0)) - F.coalesce("n_own", F.lit(0)) > 0
    metadata = F.when(state == MDL_WAIT, _found(
        F.when(~named, "table_name_unreadable").when(blocked, "mdl_blocked")
        .otherwise("mdl_blocker_unknown"),
        F.when(~named, "no table name in the statement, perhaps a keyword")
        .when(blocked, "see the blocking statements of the table")
        .otherwise("an uncommitted transaction or long statement holds the table"),
        named, named & ~blocked, F.col("table_name")))

    supported, stuck = F.col("version_family").isNotNull(), F.col("is_blocked").isNotNull()
    dml = F.when(state == "updating", _found(
        F.when(~supported, "unsupported_version").when(stuck, "dml_blocked")
        .otherwise("dml_may_block"),
        F.when(~supported, "lock waits of this server version cannot be read")
        .when(stuck, "see the lock-wait report")
        .otherwise("a long change is running and may block others"),
        supported & stuck, no, F.when(~stuck, info)))

    opening = state == "Opening tables"
    ddl = F.when(opening & (F.col("n_ddl") > 0), _found(
        "long_ddl_running", "a large table may be dropped or truncated; see the long DDL"))
    cache = F.when(opening & (F.col("n_opening") > 10), _found(
        "table_cache_pressure", "enlarge the table cache, or use fewer tables and less concurrency"))
    return [read_lock, metadata, dml, ddl, cache]


def diagnose_threads(active: DataFrame, facts: DataFrame, open_tables: DataFrame,
                     long_trx: DataFrame, waits: DataFrame,
                     rules: DataFrame | None = None, match: str = "exact") -> DataFrame:
    """Findings for the active threads, one row per thread and finding.

    ``facts`` is pivoted, ``open_tables`` the tables in use, ``waits`` the lock-wait report;
    ``rules`` replaces the state rules; ``active`` may be what ``relevant_threads`` makes of it.
    The process list is read once: what it comes to, the blocked threads and the statements per
    table are stored, small as they are. Each thread then meets one row of facts per
    instance, moment, table and thread, and its findings are one array.
    """
    threads = active if "class" in active.columns else store(relevant_threads(active), "threads")
    keys = moment_keys(threads)
    known = facts.select("instance", "version_family", _plain_ladder().alias("plain"),
                         _flush_ladder().alias("flush"))
    moments, moment = _moment_facts(threads, open_tables)
    waiters = mdl_waiters(threads)
    everyone, own = blocker_counts(waiters, blocker_statements(threads, long_trx), match)
    held = moment_keys(threads, own)
    blocked_keys = [*moment_keys(threads, waits), "id"]
    blocked = store(waits.select(*blocked_keys[:-1], F.col("waiting_thread").alias("id")).distinct(), "blocked")
    if rules is None:
        own_rules = F.filter(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(_RULE, rule)]) for rule in RULES]),
                             lambda r: r["state"] == F.col("state"))
        ruled = threads.withColumn("rules", own_rules)
    else:
        listed = rules.groupBy("state").agg(F.collect_list(F.struct(*_RULE)).alias("rules"))
        ruled = threads.join(listed, "state", "left").withColumn(
            "rules", F.coalesce("rules", F.array().cast(listed.schema["rules"].dataType)))
    named = ruled.withColumn("table_name", F.when(F.col("state") == MDL_WAIT, first_table(F.col("info"))))
    told = (named.join(known, "instance", "left").join(moments, moment, "left")
            .join(everyone, [*held, "table_name"], "left").join(own, [*held, "table_name", "id"], "left")
            .join(blocked.withColumn("is_blocked", F.lit(True)), blocked_keys, "left"))
    findings = F.concat(_of_rules(F.col("rules")), F.array_compact(F.array(*_of_states())))
    return told.select(*keys, "id", "state", F.inline(findings))


def problem_flags(findings: DataFrame) -> DataFrame:
    """Per moment: is any finding a transaction problem, is any a query problem."""
    return findings.groupBy(*moment_keys(findings)).agg(
        F.bool_or("trx_problem").alias("trx_problem"),
        F.bool_or("query_problem").alias("query_problem"))


def action_candidates(classified: DataFrame, long_trx: DataFrame, flags: DataFrame,
                      facts: DataFrame) -> DataFrame:
    """Threads an operator may end, once per moment, without any side effect.

    Transactions and changes only where the instance is known not to be a replica; a
    statement whose thread is listed as a transaction is not listed again. Statements and
    transactions are stacked before they meet the flags, so the diagnosis behind the flags
    runs once.
    """
    keys = moment_keys(classified, long_trx)
    gate = flags.join(facts.select("instance", "is_replica"), MOMENT[0], "left").withColumn(
        "primary", F.coalesce(~F.col("is_replica"), F.lit(False))).drop("is_replica")
    statements = classified.filter(F.col("class").isin(*LONG_CLASSES)).select(
        *keys, "id", "class")
    trx = long_trx.select(*keys, F.col("thread_id").alias("id"),
                          F.lit("transaction").alias("class"))
    is_trx = F.col("class") == "transaction"
    allowed = F.when(is_trx, F.col("trx_problem") & F.col("primary")).otherwise(
        F.col("query_problem") & ((F.col("class") == "select") | F.col("primary")))
    chosen = statements.unionByName(trx).join(gate, moment_keys(classified, gate)).filter(
        allowed)
    return (chosen.groupBy(*keys, "id")
            .agg(F.bool_or(is_trx).alias("_trx"),
                 F.max(F.when(~is_trx, F.col("class"))).alias("_class"))
            .select(*keys, "id",
                    F.when(F.col("_trx"), "transaction").otherwise(F.col("_class"))
                    .alias("class"),
                    F.when(F.col("_trx"), "long transaction").otherwise("long statement")
                    .alias("reason")))

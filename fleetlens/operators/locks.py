"""Open transactions, lock waits and metadata locks: who blocks whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.statements import extract_tables, first_table
from fleetlens.operators.ordered import moment_keys
from fleetlens.operators.threads import LONG_CLASSES
from fleetlens.session import store

MDL_WAIT = "Waiting for table metadata lock"


def _at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def seconds_between(start: Column, stop: Column) -> Column:
    return F.timestamp_diff("SECOND", start, stop)


_OWNER = ("user", "host", "db", "command", "time", "info")


def transaction_owners(trx: DataFrame, pl: DataFrame) -> DataFrame:
    """Every transaction with the process that owns it (``has_owner`` tells whether there is one).
    Long transactions and both sides of lock waits come out of this one table."""
    keys = moment_keys(trx, pl)
    owner = pl.select(*keys, F.col("id").alias("thread_id"), *[c for c in _OWNER if c in pl.columns],
                      F.lit(True).alias("_owned"))
    return trx.join(owner, [*keys, "thread_id"], "left").withColumn(
        "has_owner", F.coalesce("_owned", F.lit(False))).drop("_owned")


def long_transactions(trx: DataFrame, pl: DataFrame, as_of: str,
                      min_age: int = 10) -> DataFrame:
    """Transactions open for more than ``min_age`` seconds at ``as_of``, with the process
    that owns them. ``as_of`` is data, never the clock, so reruns agree."""
    return long_owned(transaction_owners(trx, pl), as_of, min_age)


def long_owned(owners: DataFrame, as_of: str, min_age: int = 10) -> DataFrame:
    """``long_transactions`` of ``transaction_owners``."""
    old = F.col("trx_started") < _at(as_of) - F.expr(f"interval {min_age} seconds")
    return (owners.filter(old & F.col("has_owner")).drop("has_owner", "command", "time")
            .withColumn("age", seconds_between(F.col("trx_started"), _at(as_of))))


def mdl_holders(threads: DataFrame, pl: DataFrame, mdl: DataFrame,
                observer: DataFrame | None = None, by_time: bool = False) -> DataFrame:
    """Granted metadata locks with the process that holds each. ``observer`` lists
    (instance, owner_thread_id) of the monitoring sessions to leave out."""
    granted = mdl.filter(F.col("lock_status") == "GRANTED")
    if observer is not None:
        granted = granted.join(observer, [*moment_keys(granted, observer),
                                          "owner_thread_id"], "left_anti")
    keys = moment_keys(threads, pl)
    owners = (threads.select(*moment_keys(threads), F.col("thread_id")
                             .alias("owner_thread_id"), "id")
              .join(pl.select(*moment_keys(pl), "id", "user", "host", "db", "command",
                              "time"), [*keys, "id"]))
    held = granted.join(owners, [*moment_keys(granted, owners), "owner_thread_id"])
    out = held.select(*moment_keys(held), "id", "user", "host", "db", "command", "time",
                      "owner_thread_id", "object_type", "object_schema", "object_name",
                      "lock_type", "lock_duration", "lock_status")
    return out.orderBy(F.desc("time"), "id") if by_time else out


# Lock-wait and lock column names of the two server generations.
WAIT_LAYOUTS = {
    "5.x": {"requesting_trx_id": "requesting", "blocking_trx_id": "blocking",
            "requested_lock_id": "lock_id"},
    "8.x": {"requesting_engine_transaction_id": "requesting",
            "blocking_engine_transaction_id": "blocking",
            "requesting_engine_lock_id": "lock_id"},
}
LOCK_LAYOUTS = {
    "5.x": {"lock_id": "lock_id", "lock_mode": "lock_mode", "lock_type": "lock_type",
            "lock_table": "lock_table", "lock_index": "lock_index"},
    "8.x": {"engine_lock_id": "lock_id", "lock_mode": "lock_mode", "lock_type": "lock_type",
            "object_name": "lock_table", "index_name": "lock_index"},
}


def version_family(version: Column) -> Column:
    """5.x, 8.x, or NULL for a version neither layout fits."""
    return (F.when(version.startswith("5."), "5.x")
            .when(version.startswith("8."), "8.x"))


def _relayout(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*moment_keys(df), *[F.col(a).alias(b) for a, b in names.items()])


def normalize_lock_waits(df: DataFrame, layout: str) -> DataFrame:
    """Lock waits of one server generation in the common layout; combine with unionByName."""
    return _relayout(df, WAIT_LAYOUTS[layout])


def normalize_locks(df: DataFrame, layout: str) -> DataFrame:
    return _relayout(df, LOCK_LAYOUTS[layout])


# Columns of open transactions, the same in both generations.
_TRX_COLUMNS = {"trx_id": "trx_id", "trx_state": "trx_state", "trx_started": "trx_started",
                "trx_wait_started": "trx_wait_started", "trx_requested_lock_id": "requested_lock_id",
                "trx_mysql_thread_id": "thread_id", "trx_query": "trx_query", "trx_tables_in_use": "tables_in_use",
                "trx_tables_locked": "tables_locked", "trx_isolation_level": "isolation_level",
                "trx_rows_modified": "rows_modified"}
TRX_LAYOUTS = {"5.x": _TRX_COLUMNS, "8.x": _TRX_COLUMNS}


def dispatch_layouts(df: DataFrame, facts: DataFrame, layouts: dict[str, dict[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows, findings) of a capture of many servers in one table, which has the columns of all
    generations: each row is read by the layout of its own instance's version.

    ``facts`` is pivoted. Rows of an instance whose version no layout fits, or that no fact
    names, cannot be read: they are counted per moment as findings ``unsupported_version``.
    Columns that a capture lacks are NULL.
    """
    known = df.join(facts.select("instance", "version_family"), "instance", "left")
    family = F.col("version_family")
    names = list(dict.fromkeys(new for layout in layouts.values() for new in layout.values()))

    def value(name: str) -> Column:
        found = F.lit(None)
        for version, layout in layouts.items():
            for old, new in layout.items():
                if new == name and old in df.columns:
                    found = F.when(family == version, F.col(old)).otherwise(found)
        return found.alias(name)
    readable = F.coalesce(family.isin(*layouts), F.lit(False))
    rows = known.filter(readable).select(*moment_keys(df), *[value(n) for n in names])
    findings = known.filter(~readable).groupBy(*moment_keys(df)).agg(F.count("*").alias("n_rows")).withColumn(
        "finding", F.lit("unsupported_version"))
    return rows, findings


def lock_waits(waits: DataFrame, trx: DataFrame, locks: DataFrame, pl: DataFrame,
               as_of: str) -> DataFrame:
    """Every lock wait with both transactions, their processes and the lock.

    The process is joined to its transaction once, and that table serves both roles, so a
    wait row is shuffled for three joins, not five. A transaction that blocks very many
    others makes one large key against one row, which AQE splits.
    """
    return owned_lock_waits(waits, transaction_owners(trx, pl), locks, as_of)


def owned_lock_waits(waits: DataFrame, owners: DataFrame, locks: DataFrame, as_of: str) -> DataFrame:
    """``lock_waits`` of ``transaction_owners``."""
    now = _at(as_of)
    keys = moment_keys(waits, owners)

    def role(prefix: str, key: str, *extra: Column) -> DataFrame:
        return owners.select(
            *keys, F.col("trx_id").alias(key), F.col("thread_id").alias(f"{prefix}_thread"),
            F.col("trx_query").alias(f"{prefix}_query"),
            F.col("rows_modified").alias(f"{prefix}_rows_modified"),
            seconds_between(F.col("trx_started"), now).alias(f"{prefix}_age"),
            seconds_between(F.col("trx_wait_started"), now).alias(f"{prefix}_wait_secs"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in ("user", "host", "db")], *extra)
    status = F.concat(F.col("command"), F.when(
        F.col("command") == "Sleep", F.concat(F.lit(" "), F.col("time"))).otherwise(""))
    lock_info = F.concat("lock_mode", F.lit(" "), "lock_type", F.lit(" "), "lock_table",
                         F.lit("("), "lock_index", F.lit(")"))
    described = locks.select(*moment_keys(waits, locks), "lock_id",
                             lock_info.alias("lock_info"))
    return (waits.join(role("blocking", "blocking", status.alias("blocking_status")),
                       [*keys, "blocking"])
            .join(role("waiting", "requesting"), [*keys, "requesting"])
            .join(described, [*moment_keys(waits, locks), "lock_id"])
            .drop("blocking", "requesting", "lock_id"))


# --- who holds up a metadata-lock wait -------------------------------------------------

def mdl_waiters(active: DataFrame) -> DataFrame:
    """Threads waiting for a metadata lock and the table each names first (or NULL)."""
    return active.filter(F.col("state") == MDL_WAIT).select(
        *moment_keys(active), "id", first_table(F.col("info")).alias("table_name"))


def blocker_statements(classified: DataFrame, long_trx: DataFrame) -> DataFrame:
    """Everything that may hold a table: long statements and long transactions."""
    threads = classified.filter(F.col("class").isin(*LONG_CLASSES)).select(
        *moment_keys(classified), F.col("class").alias("kind"),
        F.col("id").alias("blocker_id"), F.col("id").alias("thread_id"),
        F.col("info").alias("statement"))
    trx = long_trx.select(*moment_keys(long_trx), F.lit("transaction").alias("kind"),
                          F.col("trx_id").alias("blocker_id"), "thread_id",
                          F.col("trx_query").alias("statement"))
    return threads.unionByName(trx).filter("statement is not null")


def _held_tables(waiters: DataFrame, statements: DataFrame, mode: str) -> DataFrame:
    """Statements with each waited-for table they touch, one row per pair of the two."""
    keys = moment_keys(waiters, statements)
    if mode == "exact":
        return statements.select("*", F.explode(F.array_distinct(F.transform(
            extract_tables(F.col("statement")), lambda t: t["table"])))
            .alias("table_name"))
    if mode != "contains":
        raise ValueError("mode is 'exact' or 'contains'")
    return _containing(waiters, statements, keys)


# Characters that runs of a statement are cut at, characters of a name that are looked up, and
# first characters by which names meet positions in a run.
_RUN = r"[\p{L}\p{N}_$]"
_PART, _KEY, _HEAD = 256, 64, 4


def _runs(text: Column) -> Column:
    """Distinct runs of name characters, and of others, in parts that overlap by a key's length;
    one pass of a pattern, linear in the text."""
    def cut(kind: str) -> str:
        return f"(?=({kind}{{1,{_PART + _KEY - 1}}})){kind}{{1,{_PART}}}"
    names = F.regexp_extract_all(text, F.lit(f"(?s){cut(_RUN)}"), 1)
    others = F.regexp_extract_all(text, F.lit(f"(?s){cut(_RUN.replace('[', '[^', 1))}"), 1)
    return F.array_distinct(F.concat(names, others))


def _containing(waiters: DataFrame, statements: DataFrame, keys: list[str]) -> DataFrame:
    """Statements with each waited-for name that stands anywhere in their text.

    An index of the distinct runs of each statement is stored once. Names are looked up in the
    distinct runs of a moment only: a position in a run meets the lengths of the names that
    begin like it, and what it then spells meets the names themselves, so names that begin
    alike cost no more than others. A name of several runs, or of more than 64 characters, is
    looked up by its longest run and then compared with the texts that hold that.
    """
    def longest(name: Column) -> Column:
        runs = F.regexp_extract_all(name, F.lit(f"{_RUN}+|{_RUN.replace('[', '[^', 1)}+"), 0)
        sized = F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run")))
        return F.substring(F.array_max(sized)["run"], 1, _KEY)

    key, run = F.col("_key"), F.col("_run")
    names = waiters.select(*keys, "table_name").filter(F.length("table_name") > 0).distinct().withColumn(
        "_key", longest(F.col("table_name")))
    heads = names.groupBy(*keys, F.substring("_key", 1, _HEAD).alias("_head")).agg(
        F.collect_set(F.length(key)).alias("_lengths"))
    texts = statements.select(*keys, F.md5("statement").alias("_sid"), "statement").distinct()
    index = store(texts.select(*keys, "_sid", F.explode(_runs(F.col("statement"))).alias("_run")), "runs")
    spots = (index.select(*keys, "_run").distinct()
             .select(*keys, "_run", F.explode(F.sequence(F.lit(1), F.length(run))).alias("_at"))
             .select(*keys, "_run", "_at", F.explode(F.array(*map(F.lit, range(1, _HEAD + 1)))).alias("_n"))
             .withColumn("_head", F.expr("substring(_run, _at, _n)")).filter(F.length("_head") == F.col("_n")))
    spelt = (spots.join(heads, [*keys, "_head"])
             .select(*keys, "_run", "_at", F.explode("_lengths").alias("_n"))
             .withColumn("_key", F.expr("substring(_run, _at, _n)")))
    named = spelt.join(names, [*keys, "_key"]).select(
        *keys, "_run", "table_name", (key == F.col("table_name")).alias("_whole")).distinct()
    touched = store(index.join(named, [*keys, "_run"]).select(*keys, "_sid", "table_name", "_whole").distinct(), "held")
    compared = touched.filter("not _whole").join(texts, [*keys, "_sid"]).filter(
        F.col("statement").contains(F.col("table_name")))
    found = touched.filter("_whole").select(*keys, "_sid", "table_name").unionByName(
        compared.select(*keys, "_sid", "table_name"))
    return statements.withColumn("_sid", F.md5("statement")).join(found, [*keys, "_sid"]).drop("_sid")


def blockers_by_table(waiters: DataFrame, statements: DataFrame,
                      mode: str = "exact") -> DataFrame:
    """Each statement that touches a waited-for table, with the number of waiters on it
    (itself not counted). With ``waiter_blockers`` this says all that the list of
    waiter-blocker pairs would, in rows that grow with the inputs, not their product."""
    keys = [*moment_keys(waiters, statements), "table_name"]
    held = _held_tables(waiters, statements, mode)
    queue = waiters.filter("table_name is not null").groupBy(*keys).agg(
        F.count("*").alias("n_waiters"))
    own = waiters.groupBy(*keys, F.col("id").alias("thread_id")).agg(
        F.count("*").alias("_own"))
    return (held.join(queue, keys).join(own, [*keys, "thread_id"], "left")
            .withColumn("n_waiters", F.col("n_waiters") - F.coalesce("_own", F.lit(0)))
            .filter("n_waiters > 0").drop("_own"))


def blocker_counts(waiters: DataFrame, statements: DataFrame,
                   mode: str = "exact") -> tuple[DataFrame, DataFrame]:
    """Per table the number of statements that touch it (``n_all``), and the same per table and
    thread (``n_own``); what a thread itself holds is told from what others hold by the two."""
    keys = [*moment_keys(waiters, statements), "table_name"]
    own = store(_held_tables(waiters, statements, mode).groupBy(
        *keys, F.col("thread_id").alias("id")).agg(F.count("*").alias("n_own")), "held-counts")
    return own.groupBy(*keys).agg(F.sum("n_own").alias("n_all")), own


def waiter_blockers(waiters: DataFrame, statements: DataFrame,
                    mode: str = "exact") -> DataFrame:
    """Each waiter with the number of other threads' statements that touch its table."""
    keys = [*moment_keys(waiters, statements), "table_name"]
    everyone, own = blocker_counts(waiters, statements, mode)
    return (waiters.join(everyone, keys, "left").join(own, [*keys, "id"], "left")
            .withColumn("n_blockers", F.coalesce("n_all", F.lit(0)) - F.coalesce("n_own", F.lit(0)))
            .drop("n_all", "n_own"))

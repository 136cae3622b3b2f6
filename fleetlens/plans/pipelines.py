"""End-to-end jobs: the operators strung together the way an operator asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetlens.operators import backup, diagnosis, logs
from fleetlens.session import store


def largest_transactions(lines: DataFrame, by: str = "n_rows", n: int = 100,
                         start_ts: str | None = None,
                         stop_ts: str | None = None) -> DataFrame:
    """Log lines to ranked transactions, optionally of a time range only."""
    if start_ts is not None or stop_ts is not None:
        lines = logs.log_window(lines, start_ts=start_ts, stop_ts=stop_ts)
    return logs.top_transactions(logs.assemble_transactions(lines), by, n)


def propose_actions(active: DataFrame, facts: DataFrame, open_tables: DataFrame,
                    long_trx: DataFrame, waits: DataFrame) -> DataFrame:
    """Snapshot to the threads worth ending: findings, flags per moment, candidates. The process
    list is read once."""
    relevant = store(diagnosis.relevant_threads(active), "threads")
    findings = diagnosis.diagnose_threads(relevant, facts, open_tables, long_trx, waits)
    return diagnosis.action_candidates(relevant, long_trx, diagnosis.problem_flags(findings), facts)


def backup_compliance(instances: DataFrame, ledger: DataFrame, policies: DataFrame,
                      as_of: str) -> dict[str, DataFrame]:
    """The four lists of a backup review."""
    return {"uncovered": backup.uncovered_instances(instances, policies),
            "zero_size": backup.suspicious_backups(ledger),
            "expired": backup.expired_backups(ledger, policies, as_of),
            "status": backup.backup_status(ledger)}

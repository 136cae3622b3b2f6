"""Time the headline queries. One JSON line on stdout; settings by environment:

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3:
one warm-up, then the median of the others), BENCH_QUERIES (comma list or "all").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from fleetlens.session import build_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = ("q_assemble_transactions", "q_top_transactions_rows", "q_transaction_lines",
            "q_log_window", "q_group_commit_stats", "q_thread_class_counts",
            "q_top_threads", "q_table_usage", "q_lock_waits", "q_mdl_holders",
            "q_waiter_blockers", "q_diagnose_threads", "q_action_candidates",
            "q_schema_diff", "q_config_drift", "q_instance_drift", "q_variable_changes",
            "q_backup_status", "q_backup_chain", "q_expired_backups", "q_content_manifest",
            "q_replication_tree")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = (tuple(QUERIES) if wanted == "all" else
             tuple(wanted.split(",")) if wanted else HEADLINE)
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()

"""Shape of the physical plans: what must not appear, and what must."""

import re

import pytest

import __spark_entry__ as contract
from fleetlens.operators import logs
from workload.queries import Inputs

QUERIES = contract.queries()
BATCH = sorted(n for n in QUERIES if "stream" not in n)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_no_global_window_no_python(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                "ArrowEvalPython", "FlatMapGroupsInPandas"):
        assert bad not in text
    assert "SinglePartition" not in text


def executed(df):
    """The plan as it was run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_log_text_is_read_once_and_not_shuffled(spark, sf_dir):
    df = Inputs(spark, sf_dir).trx
    assert " line#" not in "".join(re.findall(r"Exchange [^\n]*\n[^\n]*", plan(df)))
    text = executed(df)
    text_scans = [x for x in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "line:string" in x]
    assert len(text_scans) == 1 and "ReusedExchange" in text


def test_windows_of_a_landed_log_read_their_row_groups(spark, sf_dir):
    """No text in an exchange, and id ranges in the scan, with automatic broadcasts off."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        i = Inputs(spark, sf_dir)
        few = i.trx.filter("xid < 50")
        found = [plan(QUERIES["q_log_window"](spark, sf_dir)), plan(logs.transaction_lines(i.log, few))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for text in found:
        assert "hashpartitioning" not in text
        pushed = re.findall(r"PushedFilters: \[([^\n]*)\], ReadSchema: struct<[^>]*line:string", text)
        assert len(pushed) == 1 and "GreaterThanOrEqual(line_id" in pushed[0] and "LessThanOrEqual(line_id" in pushed[0]


def test_top_k_plans(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["q_top_transactions_rows"](spark, sf_dir))
    for name in ("q_top_threads", "q_top_long_transactions"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf_dir))


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        text = plan(QUERIES["q_time_range"](spark, sf_dir))
        assert "GreaterThan(ts" in text and "LessThan(ts" in text
        text = plan(QUERIES["q_thread_class_counts"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[([^]]*)\]", text).group(1)
    assert "GreaterThanOrEqual(time,10)" in pushed and "Not(EqualTo(command,Sleep))" in pushed
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert "rows_sent" not in schema and "host" not in schema

"""Every named query against its SQL, and what its physical plan may not contain."""

import re
import sys

import pytest
from conftest import DATA

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import __spark_entry__ as entry_point  # noqa: E402
from workload import catalog, check  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return check.connect(DATA)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_agrees_with_sql(spark, con, name):
    assert check.compare(spark, con, DATA, name) is None


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.count() > 0
    assert set(catalog.ORACLES) == set(catalog.QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


# The banned operators would cross, nest or leave the JVM.
BANNED = re.compile(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas")
WRITES = {"remote_repo_positions", "owned_repo_positions", "week_positions", "language_churn_positions", "commits_oldest_first", "author_positions_unmerged", "bad_logs", "history_append", "stats_json_roundtrip", "commit_log_text", "patch_line_counts", "stream_weekly", "stream_daily", "stream_monthly", "stream_dedup", "stream_rejects", "stream_running_months", "large_patch", "repo_list", "file_positions", "bucketed_by_author", "fetch_document_parts"}


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in WRITES])
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not BANNED.search(plan), BANNED.search(plan)


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 1000)
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_reaches_the_scan(spark):
    plan = plan_of(catalog.QUERIES["window_filter"](spark, DATA))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThanOrEqual(o_orderdate" in plan


def test_only_needed_columns_are_read(spark):
    plan = plan_of(catalog.QUERIES["language_totals"](spark, DATA))
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_discount:double>" in plan
    assert plan.count("Exchange") == 1


def test_lines_are_summed_before_they_are_shuffled(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(catalog.QUERIES["lines_by_month"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    before = plan.split("FileScan")[-2] if "l_orderkey" in plan.split("FileScan")[-2] else plan
    assert "partial_sum" in before

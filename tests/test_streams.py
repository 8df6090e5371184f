"""Refreshed histories: what is stored, rejected and summed, batch by batch, and how ranges are read."""

import re
from pathlib import Path

import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from revtally.operators import filters, refresh
from revtally.streaming import live
from workload import catalog

ROWS = "repo STRING, oid STRING, committed_date STRING, additions BIGINT, deletions BIGINT"


def arriving(spark, tmp_path, data):
    source = str(tmp_path / "in")
    spark.createDataFrame(data, ROWS).write.mode("append").parquet(source)
    return spark.readStream.schema(ROWS).parquet(source)


def commit(oid, date, additions=1):
    return ("r", oid, date, additions, 0)


def files(path):
    return {f.relative_to(path) for f in Path(path).rglob("*.parquet")}


def run(spark, tmp_path, data):
    live.refresh(arriving(spark, tmp_path, data), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    return str(tmp_path / "out")


def test_unreadable_dates_are_rejected_and_reported(spark, tmp_path):
    out = run(spark, tmp_path, [commit("a", "2024-01-05T00:00:00Z"), commit("b", "soon")])
    assert rows(live.stored(spark, out), "oid") == [("a",)]
    assert rows(live.rejects(spark, out), "oid", "committed_date", "batch") == [("b", "soon", 0)]
    assert rows(live.ledger(spark, out), "arrived", "stored", "rejected") == [(2, 1, 1)]
    run(spark, tmp_path, [commit("c", "never"), commit("a", "2024-01-05T00:00:00Z")])
    assert rows(live.rejects(spark, out), "oid", "batch") == [("b", 0), ("c", 1)]
    assert rows(live.ledger(spark, out), "batch", "arrived", "stored", "rejected", "months") == [(0, 2, 1, 1, ["2024-01"]), (1, 2, 0, 1, ["2024-01"])]


def test_nothing_but_rejects_and_nothing_at_all(spark, tmp_path):
    out = run(spark, tmp_path, [commit("b", None), commit("b", None)])
    assert rows(live.stored(spark, out)) == [] and rows(live.days(spark, out)) == [] and live.rejects(spark, out).count() == 2
    out = run(spark, tmp_path, [commit("a", "2024-01-05T00:00:00Z", 3)])
    assert rows(live.months(spark, out), "month", "adds") == [("2024-01", 3)]
    empty = str(tmp_path / "none")
    for table in (live.stored, live.rejects, live.days, live.weeks, live.months, live.ledger):
        assert table(spark, empty).count() == 0


def test_a_replayed_batch_doubles_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([commit("a", "2024-01-05T00:00:00Z"), commit("a", "2024-01-05T00:00:00Z"), commit("b", "soon")], ROWS)

    def state():
        tables = (live.stored(spark, out), live.rejects(spark, out), live.days(spark, out), live.ledger(spark, out))
        return [rows(t, *sorted(t.columns)) for t in tables]

    live.apply_batch(batch, out, "s", 0)
    first = state()
    live.apply_batch(batch, out, "s", 0)  # stands in the ledger
    assert state() == first
    ledger = next(Path(out, "ledger").rglob("batch=0"))
    ledger.rename(tmp_path / "lost")  # the batch failed before its last step
    live.apply_batch(batch, out, "s", 0)
    again = state()
    assert again[:3] == first[:3] and rows(live.ledger(spark, out), "arrived", "stored", "rejected") == [(3, 0, 1)]
    live.apply_batch(batch, out, "another stream", 0)
    assert state()[0] == first[0] and live.rejects(spark, out).count() == 2


def test_a_late_commit_changes_one_partition(spark, tmp_path):
    dates = [f"2024-{m:02d}-{d:02d}T12:00:00Z" for m in (1, 2, 3) for d in (1, 29)]
    out = run(spark, tmp_path, [commit(d, d) for d in dates])
    before = files(f"{out}/days")
    run(spark, tmp_path, [commit("late", "2024-02-01T13:00:00Z", 5)])
    after = files(f"{out}/days")
    assert {f.parts[0] for f in before ^ after} == {"month=2024-02"}
    assert {f for f in before if f.parts[0] != "month=2024-02"} <= after
    assert rows(live.days(spark, out), "month", F.dayofmonth("day_start"), "adds", "commits") == sorted(
        [("2024-01", 1, 1, 1), ("2024-01", 29, 1, 1), ("2024-02", 1, 6, 2), ("2024-02", 29, 1, 1), ("2024-03", 1, 1, 1), ("2024-03", 29, 1, 1)], key=repr
    )
    assert rows(live.months(spark, out), "month", "adds", "commits") == [("2024-01", 2, 2), ("2024-02", 7, 3), ("2024-03", 2, 2)]
    # 29 January to 1 February are one week
    week = live.weeks(spark, out).filter("week_start = '2024-01-29'")
    assert rows(week, "adds", "commits") == [(7, 3)]


def test_sums_of_days_equal_sums_of_commits(spark, tmp_path):
    data = [("r%d" % (i % 3), str(i), f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}T{i % 24:02d}:00:00Z", i, i % 7) for i in range(200)]
    out = run(spark, tmp_path, data)
    stored = live.stored(spark, out)
    for kept, made, key in ((live.days, live.day_buckets, "day_start"), (live.weeks, live.week_buckets, "week_start"), (live.months, live.month_buckets, "month")):
        columns = ("repo", key, "adds", "dels", "commits", "net_mods", "net_adds")
        assert rows(kept(spark, out), *columns) == rows(made(stored), *columns)


# ---- ranges of a stored history ---------------------------------------------------------


def scan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 2000)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["history_refresh", "fetch_entry", "fetch_repo_languages", "multi_window", "multi_window_languages", "multi_window_excluded"])
def test_ranges_prune_months_and_reach_the_files(spark, name):
    plan = scan_of(catalog.QUERIES[name](spark, DATA))
    for bound in (">=", "<="):
        assert re.search(rf"PartitionFilters: \[[^]]*\(month#\d+ {bound} 20", plan)
    assert "GreaterThanOrEqual(committed_at" in plan and "LessThanOrEqual(committed_at" in plan


def test_a_range_of_a_stored_history_equals_that_of_the_text(spark, tmp_path):
    data = [commit(str(m), f"2024-{m:02d}-15T12:00:00+05:00", m) for m in range(1, 13)] + [commit("x", "no date"), commit("edge", "2024-04-01T00:00:00+01:00")]
    plain = spark.createDataFrame(data, ROWS)
    path = str(tmp_path / "history")
    refresh.append_history(spark, path, plain)
    stored = refresh.stored_history(spark, path)
    for since, until in (("2024-03-31", "2024-06-15"), ("2024-04-01", None), (None, "2024-04-01"), ("2025-01-01", None), (None, None)):
        got, want = (filters.history_in_range(h, since, until) for h in (stored, plain.filter("oid != 'x'")))
        assert rows(got, "oid") == rows(want, "oid")
    assert len({f.parts[0] for f in files(path)}) == 12
    assert rows(filters.readable_history(stored), "oid", "committed_at") == rows(filters.readable_history(plain), "oid", "committed_at")


def test_replacing_months_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "month STRING, n INT")
    refresh.save_by_month(frame, path, "n")
    refresh.save_by_month(frame.filter("month = '2024-02'").withColumn("n", F.lit(9)), path, "n", replace=True)
    assert rows(spark.read.parquet(path), "month", "n") == [("2024-01", 1), ("2024-02", 9)]

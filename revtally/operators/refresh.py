"""Incremental history: what to fetch, how new rows meet old ones, and how far it reaches."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtally.functions.timeparts import as_moment, month_label
from revtally.operators.filters import history_in_range, moment_of

_KEY = ("repo", "committed_date", "additions", "deletions")


def dedup_key(history: DataFrame) -> list[str]:
    """What makes two history rows one: date and counters, and the object id where known."""
    return [*_KEY, "oid"] if "oid" in history.columns else list(_KEY)


def dedup_history(history: DataFrame) -> DataFrame:
    return history.dropDuplicates(dedup_key(history))


def refresh_history(existing: DataFrame, new: DataFrame, since=None, until=None) -> DataFrame:
    """Old rows in the range and the new ones, each once; ``existing`` may be a stored history."""
    kept = history_in_range(existing, since, until).select(*new.columns)
    return dedup_history(kept.unionByName(new))


def high_water(marks: DataFrame) -> DataFrame:
    """Latest moment each repository is known up to, from an append-only log of marks."""
    return marks.groupBy("repo").agg(F.max("until").alias("until"))


def plan_refetch(repos: DataFrame, marks: DataFrame, active: DataFrame, since, until) -> DataFrame:
    """``(repo, action, fetch_since)`` of each repository, from marks and recent activity.

    ``fetch``: never loaded, or behind and active since its mark. ``skip``: behind but
    inactive, so only its mark moves. ``keep``: already known up to ``until``.
    """
    known = repos.select("repo").join(high_water(marks).withColumnRenamed("until", "mark"), "repo", "left")
    behind = F.col("mark") < as_moment(until)
    alive = active.select("repo").distinct().withColumn("alive", F.lit(True))
    judged = known.join(alive, "repo", "left")
    fetch = F.col("mark").isNull() | (behind & F.coalesce("alive", F.lit(False)))
    action = F.when(fetch, F.lit("fetch")).when(behind, F.lit("skip")).otherwise(F.lit("keep"))
    return judged.select(
        "repo",
        action.alias("action"),
        F.when(fetch, F.coalesce("mark", as_moment(since))).alias("fetch_since"),
    )


def advance_marks(plan: DataFrame, until) -> DataFrame:
    """Marks to append after a refresh: everything fetched or skipped now reaches ``until``."""
    return plan.filter(F.col("action") != "keep").select("repo", as_moment(until).alias("until"))


def append_marks(path: str, plan: DataFrame, until) -> None:
    """Log the new marks; :func:`high_water` reads the latest of each repository."""
    advance_marks(plan, until).write.mode("append").parquet(path)


def touched_months(history: DataFrame) -> list[str]:
    """The months in which there are commits, as a list: as many as the calendar has."""
    months = history.select(month_label(moment_of(history)).alias("month")).filter("month IS NOT NULL").distinct()
    return sorted(r["month"] for r in months.collect())


def append_history(spark: SparkSession, path: str, new: DataFrame, months: list[str] | None = None) -> DataFrame:
    """Add the rows of ``new`` that the table at ``path`` lacks; returns those with unreadable dates.

    Rows are stored with ``committed_at``, in partitions by month that are sorted by it, so a
    range prunes months and parts of files. The table is only appended to, so a refresh costs
    what is new: the anti join reads the months that occur in ``new`` and no others. Running it
    again after a failure adds nothing twice. ``months`` are those of ``new``, where they are
    known already.
    """
    at = moment_of(new)
    readable = new.filter(at.isNotNull())
    fresh = dedup_history(readable).withColumns({"committed_at": at, "month": month_label(at)})
    try:
        old = spark.read.schema(fresh.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        # the rows as they come, before they are deduplicated
        old = old.filter(F.col("month").isin(touched_months(readable) if months is None else months))
        same = [fresh[c].eqNullSafe(old[c]) for c in (*dedup_key(new), "month")]
        fresh = fresh.join(old, reduce(Column.__and__, same), "left_anti")
    save_by_month(fresh, path, "committed_at")
    return new.filter(at.isNull())


def save_by_month(rows: DataFrame, path: str, order: str, replace: bool = False) -> None:
    """Write rows into partitions by ``month``, sorted within files; a month with many rows is cut
    into several files. With ``replace`` the months that occur are replaced and no others."""
    placed = rows.hint("rebalance", "month").sortWithinPartitions("month", order)
    writer = placed.write.partitionBy("month").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite" if replace else "append").parquet(path)


def stored_history(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`append_history` has written."""
    return spark.read.parquet(path)

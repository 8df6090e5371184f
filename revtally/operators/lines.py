"""Line counters per commit: the smallest rows every aggregate is built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("additions", "deletions", "net_modifications", "net_additions", "files")
OTHER = "Other"


def with_net(df: DataFrame) -> DataFrame:
    """Add ``net_modifications`` and ``net_additions`` of each row's two counters."""
    a, d = F.col("additions"), F.col("deletions")
    return df.withColumns(
        {"net_modifications": F.greatest(a, d), "net_additions": F.greatest(a - d, F.lit(0).cast("bigint"))}
    )


def labelled(language: Column) -> Column:
    return F.coalesce(language, F.lit(OTHER))


def sums(*names: str) -> list[Column]:
    return [F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in names]


def _counted(file_changes: DataFrame) -> tuple[DataFrame, list[Column]]:
    """File changes with their net counters, and how to add them up. Sums that were stored in place
    of file changes (:func:`summed`) have theirs already."""
    if "files" in file_changes.columns:
        return file_changes, sums(*METRICS)
    return with_net(file_changes), [*sums(*METRICS[:4]), F.count(F.lit(1)).alias("files")]


def _rows(file_changes: DataFrame, *keys: str) -> DataFrame:
    counters = METRICS if "files" in file_changes.columns else METRICS[:2]
    named = [labelled(F.col("language")).alias("language") if k == "language" else k for k in keys]
    rows, added = _counted(file_changes.select(*named, *counters))
    return rows.groupBy(*keys).agg(*added)


def summed(file_changes: DataFrame) -> DataFrame:
    """File changes added up by commit and language, with what they carry of their commit: as many
    rows per commit as it has languages, however many files it has."""
    carried = [c for c in ("repo", "ts") if c in file_changes.columns]
    return _rows(file_changes, "commit_id", "language", *carried)


def per_commit(file_changes: DataFrame) -> DataFrame:
    """One row per commit. Partial sums run before the shuffle, so a huge commit arrives small."""
    return _rows(file_changes, "commit_id")


def per_commit_language(file_changes: DataFrame) -> DataFrame:
    """One row per commit and language, at most as many rows per commit as there are languages."""
    return _rows(file_changes, "commit_id", "language")


def per_key(file_changes: DataFrame, keys: list[Column], *more: str) -> DataFrame:
    """Sums by keys that file changes carry themselves, with no regard to commits."""
    counters = METRICS if "files" in file_changes.columns else METRICS[:2]
    rows, added = _counted(file_changes.select(*keys, *[labelled(F.col(c)).alias(c) for c in more], *counters))
    names = [c for c in rows.columns if c not in METRICS]
    return rows.groupBy(*names).agg(*added)

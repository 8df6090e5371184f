"""Filters on commits, file changes and hosted-repository rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtally.functions import identity
from revtally.functions.text import ascii_lower, ascii_lower_str
from revtally.functions.timeparts import as_moment, days_before, month_label
from revtally.operators.lines import labelled

COLUMNS = ("commits", "adds", "dels", "net", "files")
DEFAULT_COLUMNS = ("commits", "adds", "dels", "files")


def in_window(df: DataFrame, since=None, until=None, on: str = "ts") -> DataFrame:
    """``since <= ts <= until``. A day given as ``until`` means its first second."""
    if since is not None:
        df = df.filter(F.col(on) >= as_moment(since))
    if until is not None:
        df = df.filter(F.col(on) <= as_moment(until))
    return df


def last_days(df: DataFrame, days: float, now, on: str = "ts") -> DataFrame:
    return df.filter(F.col(on) >= days_before(as_moment(now), days))


def involving(commits: DataFrame, pattern: str) -> DataFrame:
    return commits.filter(identity.involves(pattern))


def by_committer(commits: DataFrame, pattern: str) -> DataFrame:
    return commits.filter(identity.committed_by(pattern))


def in_repos(commits: DataFrame, names: Iterable[str]) -> DataFrame:
    return commits.filter(F.col("repo").isin(*names))


def only_language(file_changes: DataFrame, language: str) -> DataFrame:
    """Rows of one language; rows without a language go by ``Other``."""
    return file_changes.filter(ascii_lower(labelled(F.col("language"))) == ascii_lower_str(language))


def exclude_languages(file_changes: DataFrame, languages: Sequence[str]) -> DataFrame:
    if not languages:
        return file_changes
    dropped = [ascii_lower_str(name) for name in languages]
    return file_changes.filter(~ascii_lower(labelled(F.col("language"))).isin(*dropped))


def with_defaults(commits: DataFrame) -> DataFrame:
    """Missing names become ``Unknown``; missing e-mails and messages become empty."""

    def filled(who: str) -> Column:
        return F.struct(
            F.coalesce(F.col(f"{who}.name"), F.lit("Unknown")).alias("name"),
            F.coalesce(F.col(f"{who}.email"), F.lit("")).alias("email"),
        )

    return commits.withColumns(
        {
            "author": filled("author"),
            "committer": filled("committer"),
            "message": F.coalesce(F.col("message"), F.lit("")),
        }
    )


def metric_columns(columns: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Chosen report columns: an explicit list wins over exclusions; repeats are dropped."""
    for name in (*columns, *exclude):
        if name not in COLUMNS:
            raise ValueError(f"column must be one of {COLUMNS}, got {name!r}")
    if columns:
        return list(dict.fromkeys(columns))
    return [c for c in DEFAULT_COLUMNS if c not in exclude]


def drop_forks(repos: DataFrame) -> DataFrame:
    return repos.filter(~F.col("is_fork"))


def owned_by(repos: DataFrame, user: str) -> DataFrame:
    return repos.filter(ascii_lower(F.col("owner")) == ascii_lower_str(user))


def committed_at(column: Column) -> Column:
    """RFC 3339 text as a timestamp; NULL when it is anything else."""
    shape = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
    return F.when(column.rlike(shape), F.try_to_timestamp(F.upper(column)))


def moment_of(history: DataFrame) -> Column:
    """When a hosted commit was made: ``committed_at`` where the table has it, else from the text."""
    return F.col("committed_at") if "committed_at" in history.columns else committed_at(F.col("committed_date"))


def history_in_range(history: DataFrame, since=None, until=None) -> DataFrame:
    """History rows in a closed range, compared as moments and not as text.

    A stored history is cut before it is read: by its ``month`` partitions, and by
    ``committed_at`` within the files of the months that are left.
    """
    at, monthly = moment_of(history), "month" in history.columns
    if since is not None:
        since = as_moment(since)
        history = history.filter(at >= since)
        history = history.filter(F.col("month") >= month_label(since)) if monthly else history
    if until is not None:
        until = as_moment(until)
        history = history.filter(at <= until)
        history = history.filter(F.col("month") <= month_label(until)) if monthly else history
    return history


def readable_history(history: DataFrame) -> DataFrame:
    """``history`` with ``committed_at``; rows whose date cannot be read are left out."""
    return history.withColumn("committed_at", moment_of(history)).filter(F.col("committed_at").isNotNull())


def drop_inactive(contributions: DataFrame) -> DataFrame:
    """Leave out repositories with no commits and no lines."""
    empty = (F.col("commits") == 0) & (F.col("adds") == 0) & (F.col("dels") == 0)
    return contributions.filter(~empty)


def busy_weeks(weekly: DataFrame) -> DataFrame:
    return drop_inactive(weekly)


def with_additions(language_rows: DataFrame) -> DataFrame:
    return language_rows.filter(F.col("additions") > 0)

"""The hosted-repository query: list repositories, take their history, split it over languages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtally.functions.text import ascii_lower, ascii_lower_str
from revtally.operators import filters, remote
from revtally.operators.lines import sums

_LINES = ("additions", "deletions", "net_modifications", "net_additions")


@dataclass(frozen=True)
class Fetched:
    """Lazy frames of a hosted-repository query."""

    repos: DataFrame
    weeks: DataFrame
    group: str
    period: str
    excluded: tuple[str, ...] = ()

    def _excluded(self) -> Column:
        return ascii_lower(F.col("language")).isin(*[ascii_lower_str(x) for x in self.excluded])

    def _all_languages(self) -> DataFrame:
        if self.group == "repo":
            return remote.remote_repo_languages(self.weeks)
        return remote.remote_period_languages(self.weeks, self.period)

    def languages(self) -> DataFrame:
        rows = self._all_languages()
        return rows.filter(~self._excluded()) if self.excluded else rows

    def buckets(self) -> DataFrame:
        """Totals by repository when that is the group, by period otherwise.

        Excluded languages are taken off the totals, which stop at zero. Both come from
        weekly sums; they are stacked and added up rather than joined.
        """
        if self.group == "repo":
            totals = remote.remote_by_repo(self.weeks)
        else:
            totals = remote.remote_by_period(self.weeks, self.period)
        if not self.excluded:
            return totals
        gone = self._all_languages().filter(self._excluded()).select("label", *[(-F.col(c)).alias(c) for c in _LINES])
        stacked = totals.unionByName(gone, allowMissingColumns=True).groupBy("label").agg(*sums("commits", *_LINES))
        zero = F.lit(0).cast("bigint")
        return stacked.select("label", "commits", *[F.greatest(F.col(c), zero).alias(c) for c in _LINES])

    def totals(self) -> DataFrame:
        return self.buckets().agg(*sums("commits", *_LINES))

    def active_repos(self) -> DataFrame:
        return remote.active_repos(self.repos)


def fetch(
    chunks: DataFrame,
    history: DataFrame,
    user: str,
    *,
    since=None,
    until=None,
    include_forks: bool = False,
    include_contributed: bool = False,
    private: DataFrame | None = None,
    group: Sequence[str] = ("language",),
    period: str = "month",
    exclude: Sequence[str] = (),
) -> Fetched:
    """Plan a query over contribution windows and commit history.

    Unlike a local query, the first group listed is used whether or not it has more than one
    value. Repositories with neither commits nor lines are left out.
    """
    repos = remote.merge_windows(chunks)
    if not include_forks:
        repos = filters.drop_forks(repos)
    if not include_contributed:
        repos = filters.owned_by(repos, user)
    if private is not None:
        repos = remote.add_private(repos, private, include_forks)
    weekly = remote.weekly_buckets(filters.history_in_range(history, since, until))
    active = remote.repo_line_totals(repos, weekly)
    weeks = active.select("repo", "owner", "name", "languages").join(filters.busy_weeks(weekly), "repo", "left")
    level = group[0] if group else "language"
    return Fetched(active, weeks, level, period, tuple(exclude))

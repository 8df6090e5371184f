"""A history: commits and their file changes, with the filters that narrow each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtally.operators import filters
from revtally.operators.lines import summed
from revtally.session import materialize, scratch_path

#: So many commit ids are broadcast at most: some tens of megabytes.
FEW = 500_000


@dataclass(frozen=True)
class History:
    """Commits and file changes joined on ``commit_id``, which names one commit row.

    File changes may repeat the ``ts`` and ``repo`` of their commit. A window or repository
    filter then applies to both tables and prunes the larger one at its scan, before any
    shuffle. ``narrowed`` says that some commits were filtered out and their lines were not, so
    that file changes on their own no longer describe this history.

    A file change without its commit counts nowhere. ``owned`` promises that there is none, as
    where both tables come from the same records or a foreign key ties them; sums over file
    changes then need no join. Without the promise they are always joined. ``errors`` are those
    of the logs it was read from, ``(path, error, records)``. ``selective`` says that a filter may
    have left few commits; see :meth:`settled`.
    """

    commits: DataFrame
    file_changes: DataFrame
    narrowed: bool = False
    owned: bool = False
    errors: DataFrame | None = None
    selective: bool = False

    def where(self, predicate: Column | str) -> History:
        return replace(self, commits=self.commits.filter(predicate), narrowed=True, selective=True)

    def _narrow(self, column: str, keep: Callable[[DataFrame], DataFrame]) -> History:
        if column not in self.file_changes.columns:
            return replace(self, commits=keep(self.commits), narrowed=True)
        # both tables are cut alike, so lines on their own still describe this history
        return replace(self, commits=keep(self.commits), file_changes=keep(self.file_changes))

    def between(self, since=None, until=None) -> History:
        if since is None and until is None:
            return self
        return self._narrow("ts", lambda df: filters.in_window(df, since, until))

    def last_days(self, days: float, now) -> History:
        return self._narrow("ts", lambda df: filters.last_days(df, days, now))

    def involving(self, pattern: str) -> History:
        return replace(self, commits=filters.involving(self.commits, pattern), narrowed=True, selective=True)

    def by_committer(self, pattern: str) -> History:
        return replace(self, commits=filters.by_committer(self.commits, pattern), narrowed=True, selective=True)

    def in_repos(self, names: Iterable[str]) -> History:
        names = list(names)
        return self._narrow("repo", lambda df: filters.in_repos(df, names))

    def only_language(self, language: str) -> History:
        return replace(self, file_changes=filters.only_language(self.file_changes, language))

    def exclude_languages(self, languages: Sequence[str]) -> History:
        """Drop lines of languages. Commits, buckets and people stay."""
        return replace(self, file_changes=filters.exclude_languages(self.file_changes, languages))

    def union(self, other: History) -> History:
        """Both histories; commit ids have to be distinct between them."""
        return History(
            self.commits.unionByName(other.commits),
            self.file_changes.unionByName(other.file_changes),
            self.narrowed or other.narrowed,
            self.owned and other.owned,
            self.errors.unionByName(other.errors) if self.errors and other.errors else self.errors or other.errors,
        )

    def save_bucketed(self, prefix: str, buckets: int = 512) -> None:
        """Write commits, and lines added up by commit and language, both bucketed and sorted by
        ``commit_id``: joins on it need no shuffle, and a commit with a third of all files is as
        many rows as it has languages. Worth it for a history that is queried often."""
        for suffix, frame in (("commits", self.commits), ("file_changes", summed(self.file_changes))):
            writer = frame.write.mode("overwrite").format("parquet")
            path = scratch_path(frame.sparkSession, f"{prefix}-{suffix}")
            writer.option("path", path).bucketBy(buckets, "commit_id").sortBy("commit_id").saveAsTable(f"{prefix}_{suffix}")

    def settled(self) -> History:
        """For a history narrowed to somebody's commits: leaves out the lines of all others.

        The ids of the commits that are kept are written first, so their number is known. Up to
        ``FEW`` of them are broadcast, and lines of other commits go no further than their scan.
        Beyond, lines are added up per commit before they are shuffled, as without this.
        """
        if not self.selective:
            return self
        kept = materialize(self.commits.select("commit_id"), "kept-commits")
        if kept.count() > FEW:
            return replace(self, selective=False)
        lines = self.file_changes.join(F.broadcast(kept.distinct()), "commit_id", "left_semi")
        return replace(self, file_changes=lines, selective=False)

    @classmethod
    def from_tables(cls, spark: SparkSession, prefix: str, owned: bool = False) -> History:
        return cls(spark.table(f"{prefix}_commits"), spark.table(f"{prefix}_file_changes"), owned=owned)

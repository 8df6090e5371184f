"""The statistics query: window, identity, level choice, aggregation, exclusion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtally.operators import buckets, people
from revtally.operators.filters import metric_columns
from revtally.operators.history import History
from revtally.plans import reports
from revtally.sinks import documents


@dataclass(frozen=True)
class Stats:
    """A planned statistics query. The frames are lazy; only the level choice has run."""

    history: History
    level: str
    levels: tuple[str, ...] = ()
    period: str = "month"
    options: dict = field(default_factory=dict)

    @property
    def key(self) -> dict[str, Column]:
        level = "repo" if self.level == "repo" else "period"
        return buckets.level_keys(level, period=self.period, label="label")

    def buckets(self) -> DataFrame:
        """Totals by repository when that is the level, by period otherwise."""
        return buckets.bucket_totals(self.history, self.key).orderBy("label")

    def languages(self) -> DataFrame:
        return buckets.bucket_languages(self.history, self.key)

    def people(self) -> DataFrame:
        return people.bucket_people(self.history, self.key)

    def person_languages(self) -> DataFrame:
        return people.bucket_person_languages(self.history, self.key)

    def totals(self) -> DataFrame:
        return buckets.totals(self.history).select(F.lit("Total").alias("label"), "*")

    def tree(self) -> DataFrame:
        return buckets.group_tree(self.history, self.levels, self.period)

    def document(self) -> DataFrame:
        """The statistics as JSON: nodes of the tree where there are levels, else buckets and people."""
        if self.levels:
            return documents.tree_document(self.history, self.levels, self.period)
        return documents.to_stats_json(self.history, self.key["label"], few_labels=self.level != "repo")

    def errors(self) -> DataFrame | None:
        """What could not be loaded, if the history knows."""
        return self.history.errors

    def report(self) -> DataFrame:
        """Report rows; ``columns`` and ``exclude_columns`` choose their metrics."""
        chosen = [self.options.get(c, ()) for c in ("columns", "exclude_columns")]
        report = self._report()
        return reports.select_metrics(report, metric_columns(*chosen)) if any(chosen) else report

    def _report(self) -> DataFrame:
        sort = self.options.get("sort")
        if self.levels:
            return reports.tree_report(self.history, self.levels, self.period, sort or "additions")
        if self.level == "language":
            return reports.language_report(self.history, sort or "additions")
        if self.level == "author":
            return reports.author_report(
                self.history,
                self.options.get("dedup", "name"),
                self.options.get("identity"),
                sort or "commits",
                self.options.get("email", "none"),
            )
        return reports.bucket_report(self.history, self.level, self.period, sort or "additions")


def stats(
    h: History,
    *,
    since=None,
    until=None,
    days: float | None = None,
    now=None,
    me: Column | str | None = None,
    group: Sequence[str] = ("repo", "author", "language"),
    groups: Sequence[str] = (),
    period: str = "month",
    author: str | None = None,
    language: str | None = None,
    exclude: Sequence[str] = (),
    **options,
) -> Stats:
    """Plan a query over a history.

    ``group`` lists single-level candidates, of which the first with more than one value is
    used; ``groups`` adds tree levels below it. The choice looks at the commits in the
    window that pass ``me``, before ``author`` and ``language`` apply.
    """
    for levels in (group, groups):
        if len(levels) > 1:
            buckets.check_levels(levels)
    if days is not None:
        if now is None:
            raise ValueError("days needs now")
        h = h.last_days(days, now).between(until=until)
    else:
        h = h.between(since, until)
    if me is not None:
        h = h.where(me)
    kept = buckets.effective_levels(h, group, period)
    level = kept[0] if kept else "language"
    levels = tuple(dict.fromkeys([level, *groups])) if groups else ()
    if len(levels) > 1:
        buckets.check_levels(levels)
    if author is not None:
        h = h.involving(author)
    if language is not None:
        h = h.only_language(language)
    if exclude:
        h = h.exclude_languages(exclude)
    return Stats(h, level, levels, period, options)

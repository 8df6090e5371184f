"""Figures of profile cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtally.functions.display import format_number
from revtally.functions.timeparts import as_moment, days_before, member_since
from revtally.operators import filters, remote
from revtally.operators.filters import readable_history
from revtally.operators.languages import with_color
from revtally.operators.lines import sums
from revtally.operators.ranking import language_order, language_share
from revtally.operators.windows import in_windows

TOP_PER_WINDOW = 3
LANGUAGES_PER_ROW = 3

# Figures of the short and of the full card, in order.
SHORT_CARD = ("commits", "repos", "additions", "deletions", "prs", "issues")
FULL_CARD = (
    "commits",
    "repos",
    "prs",
    "additions",
    "deletions",
    "net_additions",
    "reviews",
    "issues",
    "member_since",
)
_SIGN = {"additions": "+", "deletions": "-", "net_additions": "+"}


def card_row(totals: DataFrame, contributed: DataFrame, summary: DataFrame, user: DataFrame) -> DataFrame:
    """The one-row frame behind a card, from four one-row results.

    The inputs are stacked and folded into one row, which needs no join.
    """
    figures = (
        totals.select("commits", "additions", "deletions", "net_additions")
        .unionByName(contributed.agg(F.count(F.lit(1)).alias("repos")), allowMissingColumns=True)
        .unionByName(
            summary.select(
                F.col("total_prs").alias("prs"),
                F.col("total_reviews").alias("reviews"),
                F.col("total_issues").alias("issues"),
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            user.select(member_since(F.col("created_at")).alias("member_since")), allowMissingColumns=True
        )
    )
    return figures.agg(*[F.max(c).alias(c) for c in FULL_CARD])


def card_figures(row: DataFrame, short: bool = False, style: str = "plain", line_style: str | None = None) -> DataFrame:
    """``(position, figure, value)`` of a card; line counts may have their own number format."""
    names = SHORT_CARD if short else FULL_CARD

    def text(name: str) -> Column:
        if name == "member_since":
            return F.coalesce(F.col(name), F.lit("Unknown"))
        number = F.coalesce(F.col(name), F.lit(0).cast("bigint"))
        if name in _SIGN:
            return F.concat(F.lit(_SIGN[name]), format_number(number, line_style or style))
        return format_number(number, style)

    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("figure"), text(n).alias("value"))
        for i, n in enumerate(names, 1)
    ]
    return row.select(F.inline(F.array(*entries)))


def card_languages(language_rows: DataFrame, rows: int = 2) -> DataFrame:
    """Language bar of a card: three languages per legend row, with share and colour."""
    top = language_share(language_rows, LANGUAGES_PER_ROW * rows)
    return with_color(top).orderBy(*language_order())


def multi_window(
    history: DataFrame,
    repos: DataFrame,
    days: Sequence[float],
    now,
    counts: DataFrame | None = None,
    exclude: Sequence[str] = (),
    include_forks: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Figures and top languages of several look-back windows, from one scan of the history.

    ``counts`` holds what contribution windows report, ``(window_days, owner, name, commits)``: a
    repository with commits there is active even if none of them is in the history. Languages
    in ``exclude`` give no lines. Private and contributed repositories take part when they are
    in ``repos``. A window without any contribution has no row. Commits are bucketed by week
    within each window first, so languages are split on weekly sums as in a single-window query.
    """
    if not include_forks:
        repos = filters.drop_forks(repos)
    now = as_moment(now)
    # the longest window prunes a stored history
    recent = readable_history(filters.history_in_range(history, days_before(now, max(days)), now))
    spread = in_windows(recent, days, now, F.col("committed_at"))
    # The window joins the repository key: weeks cut by a window border stay apart.
    tagged = spread.withColumn("repo", F.struct("window_days", "repo"))
    weekly = remote.weekly_buckets(tagged).select(
        "repo.window_days", F.col("repo.repo").alias("repo"), *[c for c in _WEEK if c != "repo"]
    )
    listed = repos.select(F.concat_ws("/", "owner", "name").alias("repo"), "languages")
    contributed = weekly.join(listed, "repo")
    per_repo = contributed.groupBy("window_days", "repo").agg(*[F.sum(c).alias(c) for c in _FIGURES])
    if counts is not None:
        counted = counts.filter("commits > 0").select("window_days", F.concat_ws("/", "owner", "name").alias("repo"))
        counted = counted.join(listed.select("repo"), "repo", "left_semi")
        both = per_repo.unionByName(counted, allowMissingColumns=True)
        per_repo = both.groupBy("window_days", "repo").agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in _FIGURES])
    figures = per_repo.groupBy("window_days").agg(
        F.count(F.lit(1)).alias("repos"), *[F.sum(c).alias(name) for c, name in _FIGURES.items()]
    )
    split = remote.week_languages(contributed)
    if exclude:
        lines = [n for n in _FIGURES.values() if n != "commits"]
        kept = filters.exclude_languages(split, exclude)
        gone = split.join(kept.select("language").distinct(), "language", "left_anti")
        gone = gone.groupBy("window_days").agg(*[F.sum(n).alias(f"_{n}") for n in lines])
        figures = figures.join(gone, "window_days", "left").select(
            "window_days", "repos", "commits", *[(F.col(n) - F.coalesce(F.col(f"_{n}"), F.lit(0).cast("bigint"))).alias(n) for n in lines]
        )
        split = kept
    return figures, window_languages(split)


_FIGURES = {"commits": "commits", "adds": "additions", "dels": "deletions", "net_adds": "net_additions"}
_WEEK = ("repo", "week_start", "adds", "dels", "commits", "net_mods", "net_adds")


def window_languages(split: DataFrame, k: int = TOP_PER_WINDOW) -> DataFrame:
    """Top languages of each window by additions with their share of all languages.

    Both windows run over one row per window and language.
    """
    per = split.groupBy("window_days", "language").agg(*sums("additions")).filter(F.col("additions") > 0)
    each = Window.partitionBy("window_days")
    share = F.col("additions").cast("double") / F.sum("additions").over(each) * F.lit(100.0)
    rank = F.row_number().over(each.orderBy(*language_order()))
    return per.withColumns({"share": share, "rank": rank}).filter(F.col("rank") <= k)

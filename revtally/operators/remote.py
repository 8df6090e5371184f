"""Hosted-repository history: weekly buckets, language shares, statistics, repository lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtally.functions.identity import repo_key
from revtally.functions.timeparts import period_label, week_start
from revtally.operators.filters import busy_weeks, drop_forks, drop_inactive, readable_history
from revtally.operators.lines import OTHER, sums

_BIG = "bigint"


def _zero() -> Column:
    return F.lit(0).cast(_BIG)


def weekly_buckets(history: DataFrame) -> DataFrame:
    """Commits by repository and Monday week. Net counters are taken per commit."""
    a, d = F.col("additions"), F.col("deletions")
    return (
        readable_history(history)
        .groupBy("repo", week_start(F.col("committed_at")).alias("week_start"))
        .agg(
            F.sum(a).alias("adds"),
            F.sum(d).alias("dels"),
            F.count(F.lit(1)).alias("commits"),
            F.sum(F.greatest(a, d)).alias("net_mods"),
            F.sum(F.greatest(a - d, _zero())).alias("net_adds"),
        )
    )


def _no_languages() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))


# ---- largest remainder --------------------------------------------------------------


def language_shares(languages: Column) -> Column:
    """A language map as ``(language, bytes)`` entries in name order."""
    return F.array_sort(
        F.transform(
            F.map_entries(languages), lambda e: F.struct(e["key"].alias("language"), e["value"].alias("bytes"))
        )
    )


def apportion(total: Column, shares: Column) -> Column:
    """Split ``total`` over ``(language, bytes)`` entries so that the parts add up exactly.

    Largest remainder: whole quotas first, then one more for the greatest fractions, earlier
    entries first. When every share is zero the first entry takes all. The entries of a
    repository sit in its row, so the split needs neither a shuffle nor a window.
    """
    zero_f = F.lit(0.0)
    weight = F.aggregate(shares, zero_f, lambda acc, s: acc + s["bytes"].cast("double"))
    quotas = F.transform(
        shares,
        lambda s, i: F.struct(
            (total.cast("double") * s["bytes"].cast("double") / F.nullif(weight, zero_f)).alias("q"),
            i.alias("i"),
            s["language"].alias("language"),
        ),
    )
    cut = F.transform(
        quotas,
        lambda x: F.struct(
            (F.floor(x["q"]).cast("double") - x["q"]).alias("rest"),
            x["i"].alias("i"),
            x["language"].alias("language"),
            F.floor(x["q"]).cast(_BIG).alias("whole"),
        ),
    )
    left = total - F.aggregate(cut, _zero(), lambda acc, x: acc + x["whole"])
    ranked = F.transform(
        F.array_sort(cut),
        lambda x, rank: F.struct(
            x["i"].alias("i"),
            x["language"].alias("language"),
            (x["whole"] + F.when(rank.cast(_BIG) < left, 1).otherwise(0)).cast(_BIG).alias("part"),
        ),
    )
    proportional = F.transform(
        F.array_sort(ranked), lambda x: F.struct(x["language"].alias("language"), x["part"].alias("part"))
    )
    all_to_first = F.transform(
        shares,
        lambda s, i: F.struct(
            s["language"].alias("language"), F.when(i == 0, total).otherwise(_zero()).cast(_BIG).alias("part")
        ),
    )
    return F.when(weight == 0, all_to_first).otherwise(proportional)


_SPLIT = {"adds": "additions", "dels": "deletions", "net_mods": "net_modifications", "net_adds": "net_additions"}


def week_languages(contributions: DataFrame) -> DataFrame:
    """Busy weeks by language, the four counters split by byte share.

    A repository without language bytes goes to ``Other`` when the week has lines. ``files``
    is 1 on every row. A repository without a week gives no rows. The result keeps the other
    columns of the input.
    """
    keep = [c for c in contributions.columns if c not in (*_SPLIT, "commits", "languages")]
    shares = language_shares(F.coalesce("languages", _no_languages()))
    weighed = contributions.withColumn("_shares", shares).withColumn(
        "_bytes", F.aggregate("_shares", _zero(), lambda acc, s: acc + s["bytes"])
    )
    parts = {f"_{m}": apportion(F.col(m), F.col("_shares")) for m in _SPLIT}
    split = F.transform(
        F.arrays_zip(*parts),
        lambda z: F.struct(
            z["_adds"]["language"].alias("language"),
            *[z[f"_{m}"]["part"].alias(name) for m, name in _SPLIT.items()],
        ),
    )
    other = F.array(
        F.struct(F.lit(OTHER).alias("language"), *[F.col(m).alias(name) for m, name in _SPLIT.items()])
    )
    rows = F.when(F.col("adds").isNotNull() & (F.col("_bytes") > 0), split).when((F.col("adds") > 0) | (F.col("dels") > 0), other)
    return (
        weighed.withColumns(parts)
        .select(*keep, F.inline(rows))
        .withColumn("files", F.lit(1).cast(_BIG))
    )


# ---- contributions ------------------------------------------------------------------


def contributions(repos: DataFrame, weekly: DataFrame) -> DataFrame:
    """Repositories with their busy weeks; one with none keeps a row with no week."""
    return repos.withColumn("repo", F.concat_ws("/", "owner", "name")).join(busy_weeks(weekly), "repo", "left")


def repo_line_totals(repos: DataFrame, weekly: DataFrame) -> DataFrame:
    """Contribution row of each repository: its commit count and the line sums of its weeks."""
    lines = weekly.groupBy("repo").agg(F.sum("adds").alias("adds"), F.sum("dels").alias("dels"))
    joined = repos.withColumn("repo", F.concat_ws("/", "owner", "name")).join(lines, "repo", "left")
    return drop_inactive(
        joined.select(
            "repo",
            "owner",
            "name",
            "languages",
            F.coalesce("commit_count", _zero()).alias("commits"),
            F.coalesce("adds", _zero()).alias("adds"),
            F.coalesce("dels", _zero()).alias("dels"),
        )
    )


def active_repos(contributed: DataFrame) -> DataFrame:
    return contributed.agg(F.count(F.lit(1)).alias("active_repos"))


def _remote_totals(weeks: DataFrame, key: Column) -> DataFrame:
    return weeks.groupBy(key.alias("label")).agg(
        *[
            F.coalesce(F.sum(source), _zero()).alias(name)
            for source, name in (("commits", "commits"), *_SPLIT.items())
        ]
    )


def _remote_languages(weeks: DataFrame, key: Column) -> DataFrame:
    split = week_languages(weeks.withColumn("label", key))
    return split.groupBy("label", "language").agg(*sums(*_SPLIT.values(), "files"))


def remote_by_period(weeks: DataFrame, period: str = "month") -> DataFrame:
    """Totals by the period of each week's Monday."""
    return _remote_totals(busy_weeks(weeks), period_label(F.col("week_start"), period))


def remote_period_languages(weeks: DataFrame, period: str = "month") -> DataFrame:
    return _remote_languages(busy_weeks(weeks), period_label(F.col("week_start"), period))


def remote_by_repo(contributed: DataFrame) -> DataFrame:
    """Totals of every contributed repository, those without a busy week included."""
    return _remote_totals(contributed, F.col("repo"))


def remote_repo_languages(weeks: DataFrame) -> DataFrame:
    return _remote_languages(busy_weeks(weeks), F.col("repo"))


# ---- repository lists ---------------------------------------------------------------


def merge_languages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bytes per language of a group given as ``(…, language, bytes)`` rows, as a map.

    Repeated languages are added up before the map is made, so a group arrives as one row
    per language.
    """
    summed = rows.groupBy(*keys, "language").agg(F.sum("bytes").alias("bytes"))
    return summed.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "bytes")))).alias("languages")
    )


def language_map(edges: Column) -> Column:
    """``edges`` of one repository node as a map; a language listed twice is added up."""
    names = F.array_sort(F.array_distinct(F.transform(edges, lambda e: e["node"]["name"])))
    sizes = F.transform(
        names,
        lambda n: F.aggregate(
            F.filter(edges, lambda e: e["node"]["name"] == n), _zero(), lambda acc, e: acc + e["size"]
        ),
    )
    return F.map_from_arrays(names, sizes)


def merge_windows(chunks: DataFrame) -> DataFrame:
    """Merge the contribution windows of each repository, whatever the case of its name.

    Counts add up; names and fork flag come from the first window, languages from the first
    window that has any.
    """
    at = F.struct("window_start", "owner", "name")
    first = lambda c: F.min_by(c, at).alias(c)
    return chunks.groupBy(repo_key(F.col("owner"), F.col("name")).alias("repo_key")).agg(
        first("owner"),
        first("name"),
        first("is_fork"),
        F.coalesce(
            F.min_by(F.when(F.size("languages") > 0, F.col("languages")), F.when(F.size("languages") > 0, at)),
            _no_languages(),
        ).alias("languages"),
        F.sum("commit_count").alias("commit_count"),
    )


def summary(pages: DataFrame) -> DataFrame:
    """Pull requests, reviews and issues over all windows."""
    return pages.agg(*sums("total_prs", "total_reviews", "total_issues"))


def add_private(repos: DataFrame, private: DataFrame, include_forks: bool = False) -> DataFrame:
    """Append private repositories that are not listed yet, with a commit count of zero."""
    if not include_forks:
        private = drop_forks(private)
    key = repo_key(F.col("owner"), F.col("name"))
    fresh = private.withColumn("repo_key", key).dropDuplicates(["repo_key"])
    listed = repos.select(key.alias("repo_key"))
    fresh = fresh.join(listed, "repo_key", "left_anti").withColumn("commit_count", _zero())
    columns = [c for c in repos.columns if c in fresh.columns]
    return repos.select(*columns).unionByName(fresh.select(*columns))


def inactive_repos(repos: DataFrame, commits: DataFrame) -> DataFrame:
    """Repositories without a commit in ``commits``."""
    return repos.join(commits.select("repo").distinct(), "repo", "left_anti")

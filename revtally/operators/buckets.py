"""Buckets of commits by period, repository, author or a nested tree of those.

Two grains meet here. A commit counts even when none of its files is left, so lines are
first summed per commit and then left-joined to the commits: the join keeps one row per
commit and a plain ``count`` is right.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtally.functions.timeparts import period_label
from revtally.operators.history import History
from revtally.operators.lines import METRICS, per_commit, per_commit_language, per_key, sums

LEVELS = ("repo", "author", "period", "language")
TOTAL = "Total"


def level_key(level: str, period: str = "month") -> Column:
    """The bucket label of a commit at one grouping level."""
    if level == "repo":
        return F.col("repo")
    if level == "author":
        return F.col("author.name")
    if level == "period":
        return period_label(F.col("ts"), period)
    raise ValueError(f"level must be one of {LEVELS[:3]}, got {level!r}")


def check_levels(levels: Sequence[str]) -> None:
    unknown = [x for x in levels if x not in LEVELS]
    if unknown:
        raise ValueError(f"unknown level {unknown[0]!r}")
    if len(set(levels)) < len(levels):
        raise ValueError("a level is given twice")
    if "language" in levels[:-1]:
        raise ValueError("language can only be the last level: one commit spans several languages")


def keyed(h: History, keys: dict[str, Column], *extra: str) -> DataFrame:
    return h.commits.select("commit_id", *[c.alias(k) for k, c in keys.items()], *extra)


def commits_with_lines(h: History, keys: dict[str, Column], *extra: str) -> DataFrame:
    """One row per commit with its line counters, NULL where no file is left.

    Both sides grow with the history, and a size estimate taken from compressed files can be
    far too small. The hint keeps the lines from being broadcast on such an estimate.
    """
    h = h.settled()
    return keyed(h, keys, *extra).join(per_commit(h.file_changes).hint("merge"), "commit_id", "left")


def languages_of_commits(h: History, keys: dict[str, Column], *extra: str) -> DataFrame:
    """One row per commit and language."""
    h = h.settled()
    return keyed(h, keys, *extra).join(per_commit_language(h.file_changes).hint("merge"), "commit_id")


#: The columns of a commit that a level reads.
_READS = {"repo": "repo", "author": "author", "period": "ts"}


def level_keys(*levels: str, period: str = "month", label: str | None = None) -> dict[str, Column]:
    """Keys of some levels, under their own names; one level may be given another."""
    return Keys({label or x: level_key(x, period) for x in levels}, [_READS[x] for x in levels])


class Keys(dict):
    """Bucket keys that know which columns of a commit they read."""

    def __init__(self, keys: dict[str, Column], reads: Sequence[str]):
        super().__init__(keys)
        self.reads = tuple(reads)


def _carried(h: History, keys: dict[str, Column]) -> bool:
    """Whether file changes describe the whole history by themselves and carry what the keys read."""
    if h.narrowed or not h.owned:
        return False
    return not keys or (isinstance(keys, Keys) and set(keys.reads) <= set(h.file_changes.columns))


def bucket_totals(h: History, keys: dict[str, Column]) -> DataFrame:
    """Commits and lines of every bucket."""
    if _carried(h, keys):
        # Nothing ties lines to commits here, so two aggregates are added up without a join.
        own = [c.alias(k) for k, c in keys.items()]
        commits = h.commits.groupBy(*own).agg(F.count(F.lit(1)).alias("commits"))
        lines = per_key(h.file_changes, own)
        return commits.unionByName(lines, allowMissingColumns=True).groupBy(*keys).agg(*sums("commits", *METRICS))
    rows = commits_with_lines(h, keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("commits"), *sums(*METRICS))


def bucket_languages(h: History, keys: dict[str, Column]) -> DataFrame:
    """Lines of every bucket by language; ``files`` counts changed files, not distinct paths."""
    if _carried(h, keys):
        return per_key(h.file_changes, [c.alias(k) for k, c in keys.items()], "language")
    return languages_of_commits(h, keys).groupBy(*keys, "language").agg(*sums(*METRICS))


# ---- both grains in one pass ----------------------------------------------------------


def both_grains(h: History, keys: dict[str, Column], *extra: str) -> DataFrame:
    """Commits and their lines by language in one table, from one scan of each.

    A row is a commit and one of its languages, or a commit without lines and no language.
    ``commits`` is 1 on one row of each commit and 0 on its others, so both the commits and the
    lines of any group are plain sums. The rows come out of the join by commit and sorted, so
    picking the first language of each needs neither a shuffle nor a sort.
    """
    h = h.settled()
    lines = per_commit_language(h.file_changes).hint("merge")
    joined = keyed(h, keys, *extra).join(lines, "commit_id", "left")
    first = F.min("language").over(Window.partitionBy("commit_id"))
    return joined.withColumn("commits", F.col("language").eqNullSafe(first).cast("bigint"))


#: Blocks that commits are dealt into by their id. Fixed: a group is at most so many rows when blocks are added up.
BLOCKS = 2048


def commits_by_block(h: History, commit: Column) -> DataFrame:
    """``(block, commit, lines)``: a row of each commit with ``commit``, made of its columns, and its
    lines by language in an array.

    The rows of a block lie in one partition, so whatever is grouped by ``block`` and more is added
    up there without a shuffle, before it is dealt out by a key that may be hot.
    """
    h = h.settled()
    own = h.commits.select("commit_id", commit.alias("commit"))
    lines = per_commit_language(h.file_changes.filter("commit_id is not null"))
    lines = lines.select("commit_id", F.struct("language", *METRICS).alias("line"))
    both = own.unionByName(lines, allowMissingColumns=True)
    both = both.withColumn("block", F.pmod(F.xxhash64("commit_id"), F.lit(BLOCKS)).cast("int")).repartition("block")
    met = both.withColumn("lines", F.collect_list("line").over(Window.partitionBy("commit_id", "block")))
    return met.filter("commit is not null").select("block", "commit", "lines")


def leaves(h: History, keys: dict[str, Column]) -> DataFrame:
    """Both grains by key and language: few rows, from which every total and subtotal follows.

    Commits stand on some language of their bucket, so they mean something only summed over
    languages. Where file changes carry the keys, two aggregates are stacked without a join.
    """
    if _carried(h, keys):
        own = [c.alias(k) for k, c in keys.items()]
        commits = h.commits.groupBy(*own).agg(F.count(F.lit(1)).alias("commits"))
        rows = commits.unionByName(per_key(h.file_changes, own, "language"), allowMissingColumns=True)
    else:
        rows = both_grains(h, keys)
    return rows.groupBy(*keys, "language").agg(*sums("commits", *METRICS))


def rolled_up(rows: DataFrame, levels: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Leaves, and an empty one, by sets of levels; see :func:`with_subtotals`."""
    nothing = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("language"))
    seeded = rows.unionByName(nothing, allowMissingColumns=True)
    return seeded.groupingSets([list(s) for s in sets], *levels, "language").agg(
        *_node(levels), (F.grouping("language") == 0).alias("by_language"), *sums("commits", *METRICS)
    )


def with_subtotals(rows: DataFrame, levels: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Leaves added up by each of the sets of ``levels`` and ``language``, all in one aggregate.

    ``depth`` is the number of levels a row goes by, ``by_language`` whether it goes by language
    too. The grand total is there even if nothing else is.
    """
    rolled = rolled_up(rows, levels, sets)
    # rows of the seed, and languages of commits that have no lines
    real = F.when(F.col("by_language"), F.col("language").isNotNull()).otherwise((F.col("commits") > 0) | (F.col("depth") == 0))
    return rolled.filter(real)


def add_total(buckets: DataFrame, key: str = "label") -> DataFrame:
    """Bucket rows and one ``Total`` row (``is_total``) from the rows themselves."""
    counters = [c for c in buckets.columns if c != key]
    rolled = buckets.rollup(key).agg(
        F.grouping(key).cast("boolean").alias("is_total"), *[F.sum(c).alias(c) for c in counters]
    )
    label = F.when(F.col("is_total"), F.lit(TOTAL)).otherwise(F.col(key)).alias(key)
    filled = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counters]
    return rolled.select(label, "is_total", *filled)


def by_period(h: History, period: str = "month") -> DataFrame:
    return bucket_totals(h, level_keys("period", period=period, label="label"))


def by_repo(h: History) -> DataFrame:
    return bucket_totals(h, level_keys("repo", label="label"))


def by_author(h: History) -> DataFrame:
    """Buckets of commit authors; co-authors open none."""
    return bucket_totals(h, level_keys("author", label="label"))


def totals(h: History) -> DataFrame:
    """One row over everything, present even when there is no commit."""
    return bucket_totals(h, {})


# ---- choice of levels ---------------------------------------------------------------


def level_choice(h: History, levels: Sequence[str], period: str = "month") -> DataFrame:
    """(position, level, kept): levels with more than one value, always language, else the last.

    Two values differ exactly when the smallest and the greatest do, so one pass with
    min and max answers for every level without any distinct count.
    """
    if len(levels) > 1:
        check_levels(levels)
    aggs = []
    for i, level in enumerate(levels):
        if level == "language" or len(levels) == 1:
            kept = F.lit(True)
        else:
            key = level_key(level, period)
            kept = F.coalesce(F.min(key) != F.max(key), F.lit(False))
        aggs.append(kept.alias(f"k{i}"))
    flags = h.commits.agg(F.count(F.lit(1)).alias("n"), *aggs)
    none_kept = ~F.exists(F.array(*[F.col(f"k{i}") for i in range(len(levels))]), lambda k: k)
    last = len(levels) - 1
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(level).alias("level"),
            (F.col(f"k{i}") | (none_kept if i == last else F.lit(False))).alias("kept"),
        )
        for i, level in enumerate(levels)
    ]
    return flags.select(F.inline(F.array(*entries)))


def effective_levels(h: History, levels: Sequence[str], period: str = "month") -> list[str]:
    """The kept levels in order. Reads one small row per level."""
    if len(levels) <= 1:
        return list(levels)
    rows = level_choice(h, levels, period).filter("kept").orderBy("position").collect()
    return [r["level"] for r in rows]


# ---- tree ---------------------------------------------------------------------------


def tree_levels(levels: Sequence[str]) -> list[str]:
    """Levels that split the tree. A trailing language is the leaf's own breakdown."""
    check_levels(levels)
    if list(levels) == ["language"]:
        return ["period"]
    return [x for x in levels if x != "language"]


def _node(levels: Sequence[str]) -> list[Column]:
    depth = sum((F.lit(1) - F.grouping(x).cast("int") for x in levels), F.lit(0))
    return [depth.alias("depth")]


def with_path(rolled: DataFrame, levels: Sequence[str], rest: Sequence[str]) -> DataFrame:
    path = F.slice(F.array(*levels), F.lit(1), F.col("depth"))
    label = F.when(F.col("depth") == 0, F.lit(TOTAL)).otherwise(F.try_element_at(path, F.col("depth")))
    return rolled.select("depth", path.alias("path"), label.alias("label"), *rest)


def group_tree(h: History, levels: Sequence[str], period: str = "month") -> DataFrame:
    """Every tree node with its path; ``depth`` 0 is the grand total.

    Leaves are aggregated first, so the rollup multiplies leaf rows and not commits.
    """
    levels = tree_levels(levels)
    nodes = bucket_totals(h, level_keys(*levels, period=period))
    counters = ("commits", *METRICS)
    rolled = nodes.rollup(*levels).agg(*_node(levels), *sums(*counters))
    return with_path(rolled, levels, counters)


def tree_languages(h: History, levels: Sequence[str], period: str = "month") -> DataFrame:
    """Language breakdown of every tree node."""
    levels = tree_levels(levels)
    nodes = bucket_languages(h, level_keys(*levels, period=period))
    sets = [[*levels[:n], "language"] for n in range(len(levels), -1, -1)]
    rolled = nodes.groupingSets(sets, *levels, "language").agg(*_node(levels), *sums(*METRICS))
    return with_path(rolled, levels, ("language", *METRICS))


def whole_tree(h: History, levels: Sequence[str], period: str = "month", inner_languages: bool = True) -> DataFrame:
    """Nodes and their languages in one table and one pass: ``by_language`` tells them apart.

    Without ``inner_languages`` only leaves have languages.
    """
    levels = tree_levels(levels)
    prefixes = [list(levels[:n]) for n in range(len(levels), -1, -1)]
    sets = prefixes + [[*p, "language"] for p in (prefixes if inner_languages else prefixes[:1])]
    rolled = with_subtotals(leaves(h, level_keys(*levels, period=period)), levels, sets)
    return with_path(rolled, levels, ("by_language", "language", "commits", *METRICS))

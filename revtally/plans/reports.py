"""Reports as DataFrames. Rows say what they are in ``kind``; nothing is padded or coloured."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revtally.functions import display
from revtally.operators import buckets, people
from revtally.operators.history import History
from revtally.operators.ranking import author_rank, numbered

TOTAL = "Total"
METRICS = ("commits", "adds", "dels", "net", "files")
_SORTS = {"additions": "adds", "commits": "adds", "deletions": "dels", "files": "files"}


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _language_sort(sort: str) -> list[Column]:
    if sort == "name":
        return [F.col("label").asc()]
    return [F.col(_SORTS[sort]).desc(), F.col("label").asc()]


def _metrics(commits: Column, additions: str = "additions", deletions: str = "deletions") -> list[Column]:
    a, d = F.col(additions), F.col(deletions)
    return [
        commits.alias("commits"),
        a.alias("adds"),
        d.alias("dels"),
        display.signed_net(a, d).alias("net"),
        F.col("files"),
    ]


def language_report(h: History, sort: str = "additions") -> DataFrame:
    """Languages with a total row. A language has no commit count of its own: it shows 0."""
    rows = buckets.with_subtotals(buckets.leaves(h, buckets.level_keys()), [], [["language"], []])
    by_language = F.col("by_language")
    out = rows.select(
        F.when(by_language, F.lit("language")).otherwise(F.lit("total")).alias("kind"),
        F.when(by_language, F.col("language")).otherwise(F.lit(TOTAL)).alias("label"),
        *_metrics(F.when(by_language, _zero()).otherwise(F.col("commits"))),
    )
    return out.orderBy(F.col("kind"), *_language_sort(sort))


def author_report(
    h: History,
    dedup: str = "name",
    identity: DataFrame | None = None,
    sort: str = "commits",
    email: str = "none",
) -> DataFrame:
    """Merged people, best first, each followed by its languages when there is more than one.

    E-mails are shown only when ``email`` asks for it: in the label of their person, or with
    ``rows`` each on a row of its own after it, for people with any number of them.
    """
    apart = email == "rows"
    named = not apart and email != "none"
    wanted = "rows" if apart else "list" if named else "none"
    rows = people.people_with_totals(people.merged_activity(h, dedup, identity), wanted)
    kind = F.col("kind")
    # One window per person, as long as the person has languages, puts the person on each row.
    each = Window.partitionBy(kind == "total", "merge_key")
    of_author = F.when(kind == "author", author_rank(sort))
    rows = rows.withColumns(
        {
            "rank_value": F.when(kind != "total", -F.max(of_author).over(each)),
            "name": F.when(kind != "total", F.min("name").over(each)),
            "top_language": F.coalesce(people.best_language().over(each)["language"], F.lit("")),
            "n_languages": F.count("language").over(each),
        }
    )
    shown = F.col("name")
    if named:
        shown = display.author_display(shown, F.array_sort("emails"), email)
    sub = F.coalesce("language", F.concat(F.lit("<"), "email", F.lit(">"))) if apart else F.col("language")
    a, d, f = (F.col(c) + F.col(f"co_authored_{c}") for c in ("additions", "deletions", "commits"))

    def pick(author: Column, language: Column, total: Column, name: str) -> Column:
        return F.when(kind == "author", author).when(kind != "total", language).otherwise(total).alias(name)

    out = rows.filter((kind != "language") | (F.col("n_languages") > 1)).select(
        "rank_value",
        "merge_key",
        "kind",
        "name",
        pick(shown, sub, F.lit(TOTAL), "label"),
        pick(f, _zero(), F.col("commits"), "commits"),
        pick(a, a, F.col("additions"), "adds"),
        pick(d, d, F.col("deletions"), "dels"),
        pick(a - d, a - d, F.col("additions") - F.col("deletions"), "net"),
        pick(F.col("files"), F.col("files"), F.col("authored_files"), "files"),
        pick(F.col("top_language"), F.lit(""), F.lit(""), "top_language"),
    )
    return out.orderBy(
        F.col("rank_value").asc_nulls_last(),
        F.col("name").asc_nulls_last(),
        F.col("merge_key").asc_nulls_last(),
        F.col("kind"),
        F.col("adds").desc(),
        F.col("label"),
    ).drop("rank_value")


def bucket_report(h: History, level: str = "period", period: str = "month", sort: str = "additions") -> DataFrame:
    """Period or repository report: each label with its languages, then the total block."""
    sets = [["bucket", "language"], ["bucket"], ["language"], []]
    leaves = buckets.leaves(h, buckets.level_keys(level, period=period, label="bucket"))
    rows = buckets.with_subtotals(leaves, ["bucket"], sets)
    is_total, by_language = F.col("depth") == 0, F.col("by_language")
    name = F.when(is_total, F.lit(TOTAL)).otherwise(F.col("bucket"))
    out = rows.select(
        is_total.alias("is_total"),
        name.alias("bucket"),
        F.when(by_language, F.lit("language")).otherwise(F.lit("bucket")).alias("kind"),
        F.when(by_language, F.col("language")).otherwise(name).alias("label"),
        *_metrics(F.when(by_language, _zero()).otherwise(F.col("commits"))),
    )
    return out.orderBy("is_total", "bucket", "kind", *_language_sort(sort))


def tree_report(h: History, levels: Sequence[str], period: str = "month", sort: str = "additions") -> DataFrame:
    """Tree nodes in reading order; languages hang on the leaves, the grand total comes last."""
    by_language = F.col("by_language")
    rows = buckets.whole_tree(h, levels, period, inner_languages=False).select(
        "depth",
        "path",
        F.when(by_language, F.lit("language")).otherwise(F.lit("node")).alias("kind"),
        F.when(by_language, F.col("language")).otherwise(F.col("label")).alias("label"),
        *_metrics(F.when(by_language, _zero()).otherwise(F.col("commits"))),
    )
    return rows.orderBy(F.col("depth") == 0, "path", F.col("kind") == "language", *_language_sort(sort))


def repo_report(repos: DataFrame) -> DataFrame:
    """Repository roots in order, numbered from 1."""
    return numbered(repos.select("path"), ["path"]).select("number", "path")


def select_metrics(report: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the identifying columns of a report and the chosen metric columns, in their order."""
    return report.select(*[c for c in report.columns if c not in METRICS], *columns)


def display_columns(columns: Sequence[str], compact: bool = True) -> list[tuple[str, ...]]:
    """Column groups as shown: ``adds`` directly before ``dels`` share one change cell."""
    shown: list[tuple[str, ...]] = []
    for name in columns:
        if compact and name == "dels" and shown and shown[-1] == ("adds",):
            shown[-1] = ("adds", "dels")
        else:
            shown.append((name,))
    return shown


def formatted(report: DataFrame, columns: Sequence[str], compact: bool = True, style: str = "separated") -> DataFrame:
    """A report with its metrics as text cells."""
    cells = []
    for group in display_columns(columns, compact):
        if group == ("adds", "dels"):
            cells.append(display.change_cell(F.col("adds"), F.col("dels"), style).alias("changes"))
        elif group == ("net",):
            cells.append(display.net_text(F.col("adds"), F.col("dels"), style).alias("net"))
        else:
            cells.append(display.format_number(F.col(group[0]), style).alias(group[0]))
    return report.select(*[c for c in report.columns if c not in METRICS], *cells)

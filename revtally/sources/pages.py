"""Exported responses of a repository host, one JSON document per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtally import schemas
from revtally.operators.filters import drop_forks
from revtally.operators.remote import language_map

MISSING = "response has no data"


#: A path to documents, or a frame whose column ``value`` holds their text.
Pages = str | DataFrame


def read_pages(spark: SparkSession, path: Pages, schema: str) -> DataFrame:
    """Documents read with a given schema, so nothing is inferred."""
    if isinstance(path, DataFrame):
        return path.select(F.from_json("value", schema).alias("page")).select("page.*")
    return spark.read.schema(schema).json(path)


def split_responses(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(data, errors)``: pages with errors or without data are reported, not parsed."""
    failed = F.col("errors").isNotNull()
    message = F.array_join(F.transform("errors", lambda e: e["message"]), "; ")
    data = pages.filter(~failed & F.col("data").isNotNull()).drop("errors")
    errors = pages.filter(failed | F.col("data").isNull()).select(
        F.when(failed, message).otherwise(F.lit(MISSING)).alias("error")
    )
    return data, errors


def _repo(node: Column) -> list[Column]:
    return [
        node["owner"]["login"].alias("owner"),
        node["name"].alias("name"),
        node["isFork"].alias("is_fork"),
        language_map(node["languages"]["edges"]).alias("languages"),
    ]


def contributions(data: DataFrame) -> DataFrame:
    """Repositories with their commit count, per window."""
    entries = data.select(
        "window_start",
        F.explode("data.user.contributionsCollection.commitContributionsByRepository").alias("entry"),
    )
    return entries.select(
        "window_start",
        *_repo(F.col("entry.repository")),
        F.col("entry.contributions.totalCount").alias("commit_count"),
    )


def contribution_summary(data: DataFrame) -> DataFrame:
    """Pull requests, reviews and issues, per window; absent counts are zero."""
    found = data.filter(F.col("data.user").isNotNull()).select("data.user.contributionsCollection.*")
    names = {
        "total_prs": "totalPullRequestContributions",
        "total_reviews": "totalPullRequestReviewContributions",
        "total_issues": "totalIssueContributions",
    }
    return found.select(*[F.coalesce(c, F.lit(0).cast("bigint")).alias(n) for n, c in names.items()])


def read_contributions(spark: SparkSession, path: Pages) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(contributions, summary, errors)`` of contribution pages."""
    data, errors = split_responses(read_pages(spark, path, schemas.CONTRIBUTIONS_PAGE))
    return contributions(data), contribution_summary(data), errors


def history_rows(data: DataFrame) -> DataFrame:
    """Commits of history pages. Aliases ``repo0…`` count along the page's ``repos`` list.

    A repository that is null, or has no branch, gives no rows.
    """
    aliased = data.select("repos", F.explode("data").alias("alias", "answer"))
    history = F.col("answer.defaultBranchRef.target.history")
    position = F.expr("try_cast(regexp_extract(alias, '^repo([0-9]+)$', 1) AS INT)")
    return (
        aliased.select(F.get("repos", position).alias("repo"), "alias", history.alias("history"))
        .filter(F.col("history").isNotNull())
        .select("repo", "alias", F.explode("history.nodes").alias("node"))
        .select(
            "repo",
            "alias",
            F.col("node.oid").alias("oid"),
            F.col("node.committedDate").alias("committed_date"),
            F.col("node.additions").alias("additions"),
            F.col("node.deletions").alias("deletions"),
        )
    )


def read_history_pages(spark: SparkSession, path: Pages) -> tuple[DataFrame, DataFrame]:
    data, errors = split_responses(read_pages(spark, path, schemas.HISTORY_PAGE))
    return history_rows(data), errors


_CONNECTIONS = {
    "owned": (schemas.OWNED_PAGE, "data.user.repositories"),
    "contributed": (schemas.CONTRIBUTED_PAGE, "data.user.repositoriesContributedTo"),
    "private": (schemas.PRIVATE_PAGE, "data.viewer.repositories"),
}


def repo_rows(data: DataFrame, kind: str, include_forks: bool = False) -> DataFrame:
    nodes = data.select(F.explode(f"{_CONNECTIONS[kind][1]}.nodes").alias("node"))
    repos = nodes.select(*_repo(F.col("node")))
    return repos if include_forks else drop_forks(repos)


def read_repo_pages(
    spark: SparkSession, path: Pages, kind: str = "owned", include_forks: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``(repos, errors)`` of owned or contributed repository pages."""
    data, errors = split_responses(read_pages(spark, path, _CONNECTIONS[kind][0]))
    return repo_rows(data, kind, include_forks), errors


def read_private_repos(
    spark: SparkSession, path: Pages, user: str, include_forks: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Private repositories of the token holder; pages of another holder than ``user`` do not count."""
    data, errors = split_responses(read_pages(spark, path, schemas.PRIVATE_PAGE))
    mine = data.filter(F.lower("data.viewer.login") == user.lower())
    return repo_rows(mine, "private", include_forks), errors


def read_user(spark: SparkSession, path: Pages) -> tuple[DataFrame, DataFrame]:
    """``(user, errors)`` of a profile page; a page without a user is an error."""
    data, errors = split_responses(read_pages(spark, path, schemas.USER_PAGE))
    found = F.col("data.user").isNotNull()
    user = data.filter(found).select("data.user.*")
    absent = data.filter(~found).select(F.lit("user not found").alias("error"))
    return (
        user.select(
            F.col("id").alias("node_id"),
            "login",
            "name",
            "bio",
            F.col("publicRepositories.totalCount").alias("public_repos"),
            F.col("followers.totalCount").alias("followers"),
            F.col("following.totalCount").alias("following"),
            F.col("avatarUrl").alias("avatar_url"),
            F.col("url").alias("html_url"),
            F.col("createdAt").alias("created_at"),
        ),
        errors.unionByName(absent),
    )

"""One commit, author, repository and folder hold a third of everything; joins shuffle."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from revtally.operators import buckets, paths, people, ranking, remote
from revtally.operators.history import History
from revtally.plans import reports
from revtally.sinks import documents

N = 30_000
HOT = N // 3


@pytest.fixture(scope="module")
def skewed(spark):
    """Commit 0 has a third of the files; author a0 and repository r0 have a third of the commits."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    who = "named_struct('name', concat('a', cast(k AS STRING)), 'email', concat('a', cast(k AS STRING), '@x'))"
    commits = spark.range(N, numPartitions=4).selectExpr("id AS commit_id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 500 + 1 END AS k").selectExpr(
        "commit_id",
        "concat('r', cast(k AS STRING)) AS repo",
        f"{who} AS author",
        f"{who} AS committer",
        f"array({who}) AS co_authors",
        "timestamp_seconds(1704067200 + commit_id) AS ts",
    )
    changes = spark.range(N, numPartitions=4).selectExpr(
        f"CASE WHEN id < {HOT} THEN 0 ELSE id END AS commit_id",
        "concat('f', cast(id AS STRING)) AS path",
        "CASE WHEN id % 2 = 0 THEN 'Rust' ELSE 'Go' END AS language",
        "2L AS additions",
        "1L AS deletions",
    )
    yield History(commits, changes)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_commit_and_repository(skewed):
    got = buckets.by_repo(skewed)
    hot = rows(got.filter("label = 'r0'"), "commits", "files", "additions")
    own = (N - HOT) // 3
    assert hot == [(HOT, HOT + own, 2 * (HOT + own))]
    assert rows(got.agg(F.sum("commits"), F.sum("files"))) == [(N, N)]
    langs = buckets.bucket_languages(skewed, {"label": buckets.level_key("repo")})
    assert rows(langs.agg(F.sum("files"), F.sum("net_additions"))) == [(N, N)]


def test_hot_commit_is_small_when_it_is_shuffled(spark, skewed):
    """What is exchanged for the join is one row per commit and language and map task, not per file."""
    rows_per_commit = people.languages_of_commits(skewed, {}).filter("commit_id = 0")
    assert rows(rows_per_commit, "language", "files") == [("Go", HOT // 2), ("Rust", HOT // 2)]
    plan = rows_per_commit._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "partial_sum" in below


def test_hot_person(skewed):
    got = people.bucket_people(skewed, {}).filter("person = 'a0'")
    own = (N - HOT) // 3
    assert rows(got, "commits", "co_authored_commits", "additions", "co_authored_additions") == [(HOT, HOT, 2 * (HOT + own), 2 * (HOT + own))]
    report = reports.author_report(skewed).filter("kind = 'author'")
    first = report.first()
    assert (first["label"], first["commits"]) == ("a0", 2 * HOT)
    assert report.count() == 501


@pytest.mark.parametrize("few_labels", [True, False])
def test_documents_of_a_hot_person(skewed, few_labels):
    """People's rows are shuffled once, as sums of blocks of commits, and never multiplied by grouping sets."""
    docs = documents.to_stats_json(skewed, buckets.level_key("period", "day"), few_labels)
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "Expand" not in plan
    dealt = plan[plan.index("Exchange hashpartitioning") :]
    assert dealt.index("HashAggregate(keys=[block#") < dealt.index("Exchange hashpartitioning", 1)
    own = (N - HOT) // 3
    docs = {(r["label"], r["person"]): json.loads(r["json"]) for r in docs.filter("section = 'totals' and (person = 'a0' or kind = 'head')").collect()}
    bot, head = docs["Total", "a0"], docs["Total", None]
    assert (bot["commits"], bot["co_authored_commits"], bot["additions"], bot["co_authored_additions"]) == (HOT, HOT, 2 * (HOT + own), 2 * (HOT + own))
    assert sum(x["files_changed"] for x in bot["languages"].values()) == 2 * (HOT + own)
    assert head["total_commits"] == N and sum(x["files_changed"] for x in head["by_language"].values()) == N


def test_hot_email_meets_the_identity_table(spark, skewed):
    identity = spark.range(3000).selectExpr("concat('a', cast(id AS STRING), '@x') AS email", "'dev' AS login")
    merged = people.author_totals(people.merged_activity(skewed, "remote", identity))
    assert rows(merged, "merge_key", "commits", "co_authored_commits") == [("dev", N, N)]
    marked = people.mark_login(skewed.commits, identity, "dev")
    assert marked.filter("is_login").count() == N


def test_hot_folder(spark, skewed):
    """Every repository lies under /srv, and a third of them inside one outer repository."""
    base = f"CASE WHEN id < {HOT} THEN concat('/srv/mono/pkg', cast(id AS STRING)) ELSE concat('/srv/r', cast(id AS STRING)) END"
    inventory = spark.range(N).selectExpr(f"concat({base}, '/.git/HEAD') AS path")
    outer = spark.createDataFrame([("/srv/mono/.git/HEAD",)], "path STRING")
    found = paths.discover_repos(inventory.unionByName(outer))
    assert found.count() == N - HOT + 1
    numbered = ranking.numbered(found, ["path"])
    assert rows(numbered.agg(F.min("number"), F.max("number"), F.count_distinct("number"))) == [(1, N - HOT + 1, N - HOT + 1)]


def test_hot_hosted_repository(spark, skewed):
    history = spark.range(N).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'o/hot' ELSE concat('o/r', cast(id % 50 AS STRING)) END AS repo",
        "date_format(timestamp_seconds(1704067200 + id * 60), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS committed_date",
        "3L AS additions",
        "1L AS deletions",
    )
    weekly = remote.weekly_buckets(history)
    listed = weekly.select("repo").distinct().selectExpr(
        "split_part(repo, '/', 1) AS owner", "split_part(repo, '/', 2) AS name", "false AS is_fork", "map('A', 1L, 'B', 2L, 'C', 4L) AS languages"
    )
    split = remote.remote_repo_languages(remote.contributions(listed, weekly))
    assert rows(split.agg(F.sum("additions"), F.sum("deletions"))) == [(3 * N, N)]
    assert rows(split.filter("label = 'o/hot'").agg(F.sum("additions"))) == [(3 * HOT,)]

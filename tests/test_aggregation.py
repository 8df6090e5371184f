import json
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from revtally import stats
from revtally.operators import buckets, people, ranking
from revtally.plans import reports
from revtally.sinks import documents
from revtally.sources import commit_log

JANUARY = [
    (1, "a", "Alice", [], "2024-01-10 00:00:00"),
    (2, "a", "Bob", [], "2024-01-20 00:00:00"),
    (3, "a", "Alice", [], "2024-02-05 00:00:00"),
]
JANUARY_CHANGES = [(1, "x", "Rust", 10, 2), (1, "y", "Python", 5, 1), (2, "x", "Rust", 20, 5), (3, "y", "Python", 8, 3)]


def month():
    return {"label": buckets.level_key("period", "month")}


def test_month_buckets(build):
    h = build(JANUARY, JANUARY_CHANGES)
    got = rows(buckets.by_period(h), "label", "commits", "additions", "deletions")
    assert got == [("2024-01", 2, 35, 8), ("2024-02", 1, 8, 3)]
    langs = rows(buckets.bucket_languages(h, month()), "label", "language", "additions", "files")
    assert ("2024-01", "Rust", 30, 2) in langs


def test_five_commits(five):
    assert rows(buckets.totals(five), "commits", "additions", "deletions") == [(5, 74, 19)]
    weeks = rows(buckets.by_period(five, "week"), "label", "commits")
    assert weeks == [("2024-W03", 2), ("2024-W04", 1), ("2024-W05", 1), ("2024-W07", 1)]
    who = rows(people.bucket_people(five, {}), "person", "commits", "co_authored_commits", "co_authored_additions")
    assert who == [("Alice", 3, 0, 0), ("Bob", 2, 0, 0), ("Charlie", 0, 1, 12)]


def test_unjoined_totals_equal_bucket_sums(five):
    total = rows(buckets.totals(five))
    summed = buckets.by_period(five, "day").agg(*[F.sum(c) for c in buckets.totals(five).columns])
    assert rows(summed) == total
    assert rows(buckets.totals(five.where("true"))) == total


def test_week_label_takes_iso_year(build):
    h = build([(1, "a", "A", [], "2024-12-31 23:00:00")], [])
    assert rows(buckets.by_period(h, "week"), "label", "commits", "additions") == [("2025-W01", 1, 0)]


def test_person_filter_matches_co_authors(build):
    commits = [(1, "a", "Alice", [], "2024-01-01 00:00:00"), (2, "a", "Bob", ["Alice"], "2024-01-02 00:00:00"),
               (3, "a", "Bob", [], "2024-01-03 00:00:00")]
    h = build(commits, [(1, "x", "Rust", 10, 2), (2, "x", "Rust", 15, 4), (3, "x", "Rust", 9, 9)])
    assert rows(buckets.totals(h.involving("aLICe")), "commits", "additions", "deletions") == [(2, 25, 6)]


def test_language_filter_keeps_commits(build):
    h = build([(1, "a", "A", [], "2024-01-01 00:00:00")], [(1, "x", "Rust", 10, 2), (1, "y", "Python", 5, 1), (1, "z", None, 3, 0)])
    assert rows(buckets.totals(h.only_language("rust")), "commits", "additions", "deletions") == [(1, 10, 2)]
    assert rows(buckets.totals(h.only_language("other")), "additions") == [(3,)]
    assert rows(buckets.totals(h.only_language("Go")), "commits", "additions", "files") == [(1, 0, 0)]
    assert rows(buckets.bucket_languages(h, {}), "language") == [("Other",), ("Python",), ("Rust",)]


def test_co_author_languages(build):
    commits = [(1, "a", "A", ["Bob"], "2024-01-01 00:00:00"), (2, "a", "A", ["Bob"], "2024-02-01 00:00:00")]
    h = build(commits, [(1, "x", "Rust", 10, 2), (2, "x", "Rust", 20, 5)])
    got = people.bucket_person_languages(h, {}).filter("person = 'Bob'")
    want = (30, 7, 2, 30, 23)
    assert rows(got, "additions", "deletions", "files", "net_modifications", "net_additions") == [want]
    co = [f"co_authored_{c}" for c in ("additions", "deletions", "files", "net_modifications", "net_additions")]
    assert rows(got, *co) == [want]


def test_author_listed_as_co_author_counts_twice(build):
    h = build([(1, "a", "A", ["A", "B", "B"], "2024-01-01 00:00:00")], [(1, "x", "Rust", 7, 3)])
    got = rows(people.bucket_people(h, month()), "person", "commits", "co_authored_commits", "additions", "co_authored_additions")
    assert got == [("A", 1, 1, 7, 7), ("B", 0, 2, 0, 14)]
    langs = people.bucket_person_languages(h, {})
    assert rows(langs, "person", "additions", "co_authored_additions", "files") == [("A", 14, 7, 2), ("B", 14, 14, 2)]


def test_by_repo_merges_equal_names_and_never_deduplicates(build):
    commits = [(1, "repo-z", "A", [], "2024-01-01 00:00:00"), (2, "repo-z", "A", [], "2024-01-01 00:00:00"),
               (3, "repo-a", "A", [], "2024-01-01 00:00:00")]
    h = build(commits, [(1, "x", "Rust", 10, 3), (2, "x", "Rust", 5, 2), (3, "x", "Rust", 7, 1)])
    got = [tuple(r) for r in buckets.by_repo(h).orderBy("label").select("label", "commits", "additions", "deletions").collect()]
    assert got == [("repo-a", 1, 7, 1), ("repo-z", 2, 15, 5)]
    assert rows(buckets.add_total(buckets.by_repo(h)).filter("is_total"), "label", "commits", "additions") == [("Total", 3, 22)]


def test_exclusion_keeps_people(build):
    commits = [(1, "a", "Alice", [], "2024-01-01 00:00:00"), (2, "a", "Bob", [], "2024-01-01 00:00:00")]
    h = build(commits, [(1, "x", "Rust", 10, 2), (1, "y", "Python", 5, 1), (2, "x", "Rust", 20, 5)]).exclude_languages(["rUsT"])
    assert rows(buckets.totals(h), "commits", "additions", "deletions") == [(2, 5, 1)]
    assert rows(people.bucket_people(h, {}), "person", "commits", "additions", "deletions") == [("Alice", 1, 5, 1), ("Bob", 1, 0, 0)]


def test_until_day_holds_only_its_first_second(build):
    commits = [(i, "a", "A", [], t) for i, t in enumerate(["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:01"])]
    h = build(commits, [])
    assert rows(buckets.totals(h.between("2024-01-01", "2024-01-02")), "commits") == [(2,)]
    assert rows(buckets.totals(h.last_days(0.5, "2024-01-02")), "commits") == [(2,)]
    assert rows(buckets.totals(h.last_days(1.0, "2024-01-02")), "commits") == [(3,)]


def test_windows_narrow_dated_file_changes_too(build):
    h = build([(i, "a", "A", [], f"2024-01-0{i} 00:00:00") for i in (1, 2, 3)], [(i, "x", "Rust", i, 0) for i in (1, 2, 3)])
    dated = h.file_changes.join(h.commits.select("commit_id", "ts", "repo"), "commit_id")
    both = type(h)(h.commits, dated).between("2024-01-02", "2024-01-02")
    assert rows(both.file_changes, "additions") == [(2,)]
    assert rows(buckets.totals(both), "commits", "additions") == [(1, 2)]
    assert rows(both.in_repos(["b"]).file_changes) == []


def test_union_of_histories(build):
    one = build([(1, "a", "A", [], "2024-01-01 00:00:00")], [(1, "x", "Rust", 1, 0)])
    two = build([(2, "b", "B", [], "2024-01-01 00:00:00")], [(2, "x", "Rust", 2, 0)])
    assert rows(buckets.totals(one.union(two)), "commits", "additions") == [(2, 3)]


def test_empty_history(build):
    h = build([], [])
    assert rows(buckets.totals(h), "commits", "additions") == [(0, 0)]
    assert rows(buckets.by_period(h)) == []
    assert buckets.effective_levels(h, ["repo", "author"]) == ["author"]


# ---- levels and trees ---------------------------------------------------------------


def test_level_choice(five):
    assert buckets.effective_levels(five, ["repo", "author", "language"]) == ["author", "language"]
    assert buckets.effective_levels(five, ["repo"]) == ["repo"]
    alone = five.where("commit_id = 1")
    assert buckets.effective_levels(alone, ["repo", "author", "period"]) == ["period"]
    assert buckets.effective_levels(alone, ["repo", "author", "language"]) == ["language"]


def test_level_lists_are_checked():
    with pytest.raises(ValueError):
        buckets.check_levels(["repo", "repo"])
    with pytest.raises(ValueError):
        buckets.check_levels(["language", "repo"])
    assert buckets.tree_levels(["repo", "language"]) == ["repo"]
    assert buckets.tree_levels(["language"]) == ["period"]


def test_tree_parents_are_sums_of_children(five):
    tree = buckets.group_tree(five, ["author", "period", "repo"]).cache()
    got = {tuple(r["path"]): r for r in tree.collect()}
    assert got[()]["label"] == "Total" and got[()]["commits"] == 5
    assert got[("Alice",)]["commits"] == 3
    for path, node in got.items():
        children = [r for p, r in got.items() if len(p) == len(path) + 1 and p[: len(path)] == path]
        for counter in ("commits", "additions", "deletions", "files"):
            if children:
                assert node[counter] == sum(c[counter] for c in children)


def test_tree_languages_at_every_depth(five):
    got = buckets.tree_languages(five, ["author", "language"])
    assert (0, "Total", "Rust", 24) in rows(got, "depth", "label", "language", "additions")
    assert (1, "Bob", "CSS", 20) in rows(got, "depth", "label", "language", "additions")


# ---- reports ------------------------------------------------------------------------


def test_language_report(five):
    got = [tuple(r) for r in reports.language_report(five).select("label", "commits", "adds", "dels", "files").collect()]
    assert got[:3] == [("Rust", 0, 24, 5, 3), ("CSS", 0, 20, 0, 1), ("JavaScript", 0, 12, 12, 2)]
    assert got[-1] == ("Total", 5, 74, 19, 10)
    by_name = [r["label"] for r in reports.language_report(five, "name").collect()]
    assert by_name == ["CSS", "JavaScript", "Markdown", "Python", "Rust", "Total"]


def test_author_report(five):
    got = [tuple(r) for r in reports.author_report(five, email="full").select("kind", "label", "commits", "adds", "files", "top_language").collect()]
    assert got == [
        ("author", "Alice <alice@test.com>", 3, 29, 5, "JavaScript"),
        ("language", "JavaScript", 0, 12, 2, ""),
        ("language", "Rust", 0, 11, 1, ""),
        ("language", "Markdown", 0, 6, 2, ""),
        ("author", "Bob <bob@test.com>", 2, 45, 5, "CSS"),
        ("language", "CSS", 0, 20, 1, ""),
        ("language", "Rust", 0, 13, 2, ""),
        ("language", "Python", 0, 12, 2, ""),
        ("author", "Charlie <charlie@test.com>", 1, 12, 1, "JavaScript"),
        ("total", "Total", 5, 74, 10, ""),
    ]


def test_remote_dedup_merges_names(spark, five):
    identity = spark.createDataFrame([("alice@test.com", "dev"), ("bob@test.com", "dev")], "email STRING, login STRING")
    merged = people.author_totals(people.merged_activity(five, "remote", identity))
    assert rows(merged, "merge_key", "name", "commits", "n_languages") == [("Charlie", "Charlie", 0, 1), ("dev", "Alice", 5, 5)]
    report = reports.author_report(five, "remote", identity.unionByName(identity), email="full")
    assert rows(report.filter("kind = 'author'"), "label", "commits") == [
        ("Alice <alice@test.com>, <bob@test.com>", 5), ("Charlie <charlie@test.com>", 1),
    ]


def test_author_without_lines_has_no_top_language(build):
    h = build([(1, "a", "A", [], "2024-01-01 00:00:00")], [])
    got = reports.author_report(h).filter("kind = 'author'")
    assert rows(got, "label", "commits", "adds", "top_language") == [("A", 1, 0, "")]


def test_bucket_and_tree_reports(five):
    got = [(r["bucket"], r["kind"], r["label"], r["adds"]) for r in reports.bucket_report(five).collect()]
    assert got[0] == ("2024-01", "bucket", "2024-01", 41)
    assert got[1] == ("2024-01", "language", "Rust", 16)
    assert got[-6] == ("Total", "bucket", "Total", 74)
    tree = [(r["depth"], r["kind"], r["label"]) for r in reports.tree_report(five, ["author", "period"]).collect()]
    assert tree[:3] == [(1, "node", "Alice"), (2, "node", "2024-01"), (2, "language", "JavaScript")]
    assert tree[-1] == (0, "node", "Total")


def test_stats_picks_first_level_with_two_values(five):
    plan = stats(five)
    assert plan.level == "author"
    assert plan.report().filter("kind = 'author'").count() == 3
    assert rows(plan.buckets(), "label") == [("2024-01",), ("2024-02",)]
    assert stats(five, group=["language"]).report().count() == 6
    tree = stats(five, group=["repo", "author"], groups=["period"])
    assert tree.levels == ("author", "period")
    assert rows(tree.tree().filter("depth = 0"), "commits") == [(5,)]
    with pytest.raises(ValueError):
        stats(five, groups=["language", "repo"])


def test_stats_level_choice_ignores_author_filter(five):
    assert stats(five, author="alice").level == "author"
    assert stats(five, me="author.name = 'Alice'").level == "language"


def test_top_language_and_share(five):
    top = ranking.top_language(buckets.bucket_languages(five, month()), ["label"])
    assert rows(top) == [("2024-01", "Rust"), ("2024-02", "CSS")]
    share = ranking.language_share(buckets.bucket_languages(five, {}), 2).collect()
    assert [(r["language"], round(r["share"], 4)) for r in share] == [("Rust", 32.4324), ("CSS", 27.027)]


def test_numbering_crosses_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).select(F.format_string("p%06d", 999 - F.col("id")).alias("path"))
    got = ranking.numbered(df, ["path"]).orderBy("path").collect()
    assert [r["number"] for r in got] == list(range(1, 1001))


def test_bucketed_tables_join_without_shuffle(spark, five):
    five.save_bucketed("tallied", 4)
    h = type(five).from_tables(spark, "tallied")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = buckets.commits_with_lines(h, {"label": buckets.level_key("repo")})
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert rows(buckets.totals(h), "commits", "additions") == [(5, 74)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE tallied_commits")
        spark.sql("DROP TABLE tallied_file_changes")


def test_dated_file_changes_need_no_join(five):
    dated = five.file_changes.join(five.commits.select("commit_id", "ts", "repo"), "commit_id")
    both = type(five)(five.commits, dated, owned=True)
    for h in (both, both.between("2024-01-16", "2024-01-31"), both.in_repos(["demo"])):
        plain = type(five)(h.commits, five.file_changes, narrowed=True)
        for found in (buckets.by_period, buckets.by_repo):
            assert rows(found(h)) == rows(found(plain))
        by_month = {"label": buckets.level_key("period")}
        assert rows(buckets.bucket_languages(h, by_month)) == rows(buckets.bucket_languages(plain, by_month))
    plan = buckets.by_period(type(five)(five.commits.limit(5), dated.limit(99), owned=True))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the one that made the dated rows
    assert rows(buckets.by_author(both)) == rows(buckets.by_author(five))


# ---- one pass, and lines without a commit -----------------------------------------------


def test_lines_without_a_commit_count_nowhere(build):
    h = build([(1, "a", "Alice", [], "2024-01-01 00:00:00"), (2, "a", "Bob", [], "2024-01-02 00:00:00")], [(1, "f", "Rust", 5, 0), (9, "g", "Go", 100, 1)])
    dated = type(h)(h.commits, h.file_changes.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "repo": F.lit("a")}))
    for history in (h, dated):
        assert rows(buckets.totals(history), "commits", "additions", "files") == [(2, 5, 1)]
        assert rows(buckets.by_repo(history), "commits", "additions", "files") == [(2, 5, 1)]
        assert rows(buckets.by_period(history), "label", "additions") == [("2024-01", 5)]
        assert rows(buckets.bucket_languages(history, {}), "language") == [("Rust",)]
        assert rows(reports.language_report(history), "kind", "label", "commits", "adds") == [("language", "Rust", 0, 5), ("total", "Total", 2, 5)]
    assert rows(buckets.totals(type(h)(h.commits, h.file_changes.filter("commit_id = 1"), owned=True)), "additions") == [(5,)]


def report_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_reports_of_nothing_have_a_total(build):
    h = build([], [])
    columns = ("kind", "label", "commits", "adds", "dels", "net", "files")
    zero = (0, 0, 0, 0, 0)
    assert report_of(reports.bucket_report(h), *columns) == [("bucket", "Total", *zero)]
    assert report_of(reports.tree_report(h, ["repo", "period"]), *columns) == [("node", "Total", *zero)]
    assert report_of(reports.language_report(h), *columns) == [("total", "Total", *zero)]
    assert report_of(reports.author_report(h), *columns) == [("total", "Total", *zero)]
    assert rows(documents.tree_document(h, ["repo"]), "depth") == [(0,)]
    assert documents.to_stats_json(h, buckets.level_key("period")).count() == 0


def test_reports_with_missing_names_and_commits_without_lines(build):
    h = build(
        [(1, None, "Alice", ["Bob"], "2024-01-01 00:00:00"), (2, "r", "Alice", [], "2024-02-01 00:00:00"), (3, "r", "Bob", ["Bob"], "2024-02-01 00:00:00")],
        [(1, "a", "Rust", 3, 1), (1, "b", "Rust", 4, 0), (1, "c", "Go", 2, 2), (3, "d", None, 1, 0)],
    )
    got = report_of(reports.bucket_report(h, "repo"), "is_total", "bucket", "kind", "label", "commits", "adds", "files")
    assert got == [
        (False, None, "bucket", None, 1, 9, 3), (False, None, "language", "Rust", 0, 7, 2), (False, None, "language", "Go", 0, 2, 1),
        (False, "r", "bucket", "r", 2, 1, 1), (False, "r", "language", "Other", 0, 1, 1),
        (True, "Total", "bucket", "Total", 3, 10, 4),
        (True, "Total", "language", "Rust", 0, 7, 2), (True, "Total", "language", "Go", 0, 2, 1), (True, "Total", "language", "Other", 0, 1, 1),
    ]
    got = report_of(reports.author_report(h), "kind", "label", "commits", "adds", "files", "top_language")
    assert got == [
        ("author", "Bob", 3, 11, 5, "Rust"), ("language", "Rust", 0, 7, 2, ""), ("language", "Go", 0, 2, 1, ""), ("language", "Other", 0, 2, 2, ""),
        ("author", "Alice", 2, 9, 3, "Rust"), ("language", "Rust", 0, 7, 2, ""), ("language", "Go", 0, 2, 1, ""),
        ("total", "Total", 3, 10, 4, ""),
    ]
    tree = report_of(reports.tree_report(h, ["repo", "author"]), "depth", "kind", "label", "commits", "adds")
    assert (2, "node", "Alice", 1, 0) in tree and (0, "node", "Total", 3, 10) == tree[-1] and (2, "language", "Rust", 0, 7) in tree
    docs = {tuple(r["path"]): json.loads(r["json"]) for r in documents.tree_document(h, ["repo", "author"]).collect()}
    assert docs["r", "Alice"]["total_commits"] == 1 and docs["r", "Alice"]["by_language"] == {}
    assert docs[()]["by_language"]["Rust"]["additions"] == 7 and docs[()]["total_commits"] == 3 and docs["r",]["total_additions"] == 1
    docs = documents.to_stats_json(h, buckets.level_key("period")).collect()
    heads = {r["label"]: json.loads(r["json"]) for r in docs if r["kind"] == "head"}
    assert {k: (v["total_commits"], v["total_additions"], sorted(v["by_language"])) for k, v in heads.items()} == {
        "2024-01": (1, 9, ["Go", "Rust"]), "2024-02": (2, 1, ["Other"]), "Total": (3, 10, ["Go", "Other", "Rust"]),
    }
    bob = next(json.loads(r["json"]) for r in docs if r["section"] == "totals" and r["person"] == "Bob")
    assert (bob["commits"], bob["co_authored_commits"], bob["additions"], bob["co_authored_additions"]) == (1, 2, 1, 10)
    assert bob["languages"]["Other"]["additions"] == 2 and bob["co_authored_languages"]["Rust"]["files_changed"] == 2


@pytest.mark.parametrize(
    "make",
    [
        lambda h: reports.bucket_report(h),
        lambda h: reports.tree_report(h, ["repo", "period"]),
        lambda h: reports.author_report(h),
        lambda h: documents.tree_document(h, ["repo", "period"]),
        lambda h: documents.to_stats_json(h, buckets.level_key("period")),
    ],
)
def test_each_table_is_scanned_once(spark, make):
    from conftest import DATA
    from workload import tables

    plan = make(tables.history(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and len(re.findall(r"Relation \[.*o_orderkey", plan)) == 1 and len(re.findall(r"Relation \[.*l_orderkey", plan)) == 1


def test_one_row_of_each_commit_carries_it_without_another_shuffle(spark, five):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        both = buckets.both_grains(five, {})
        assert rows(both.groupBy("commit_id").agg(F.sum("commits"), F.count("language"))) == [(1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 1, 3), (5, 1, 2)]
        plan = both._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in above and "Sort [" not in above


def test_entry_gives_documents_and_errors(five, spark, tmp_path):
    flat = stats(five, group=["period"]).document()
    assert rows(flat.filter("kind = 'head'"), "label") == [("2024-01",), ("2024-02",), ("Total",)]
    tree = stats(five, group=["author"], groups=["period"]).document()
    assert rows(tree.filter("depth = 1"), F.array_join("path", ">")) == [("Alice",), ("Bob",)]
    assert stats(five).errors() is None
    loaded = commit_log.read_history(spark, [str(tmp_path / "missing.log")])
    assert rows(stats(loaded).errors(), "error", "records") == [("PATH_NOT_FOUND", 0)]


@pytest.mark.parametrize("dedup", people.DEDUP_MODES)
def test_emails_of_merged_people_need_no_lines(spark, five, dedup):
    identity = spark.createDataFrame([("alice@test.com", "Dev"), ("bob@test.com", None), ("charlie@test.com", "Dev")], "email STRING, login STRING")
    found = people.people_emails(five, dedup, identity)
    assert rows(found) == rows(people.merged_emails(people.merged_activity(five, dedup, identity)))
    assert "additions" not in found._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]


def test_emails_query_scans_no_lines(spark):
    from workload import catalog

    plan = catalog.QUERIES["author_emails"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_orderkey" not in plan


def test_merged_people_are_dealt_out_in_small_parts(spark, five):
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    try:
        for key in keys:
            spark.conf.unset(key)
        people.merged_activity(five)
        assert [spark.conf.get(k) for k in keys] == ["16m", "256"]
        spark.conf.set(keys[0], "8m")
        people.merged_activity(five)
        assert spark.conf.get(keys[0]) == "8m"
    finally:
        for key in keys:
            spark.conf.unset(key)

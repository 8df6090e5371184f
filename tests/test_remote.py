import random
from fractions import Fraction

from conftest import rows
from pyspark.sql import functions as F

from revtally import schemas
from revtally.operators import cards, filters, refresh, remote
from revtally.plans.fetch import fetch

HISTORY = "repo STRING, committed_date STRING, additions BIGINT, deletions BIGINT"
REPOS = "owner STRING, name STRING, is_fork BOOLEAN, languages MAP<STRING, BIGINT>"


def weeks(spark, data):
    return remote.weekly_buckets(spark.createDataFrame(data, HISTORY))


def test_monday_weeks(spark):
    got = weeks(
        spark,
        [
            ("r", "2025-01-08T10:00:00Z", 10, 2),
            ("r", "2025-01-12T23:59:59+00:00", 5, 1),
            ("r", "2025-01-13T01:30:00+02:00", 0, 0),
            ("r", "2025-01-13T00:00:00.5Z", 7, 3),
            ("r", "not a date", 99, 99),
            ("r", "2025-01-08", 99, 99),
        ],
    )
    monday = F.date_format("week_start", "yyyy-MM-dd")
    assert rows(got, monday, "adds", "dels", "commits") == [("2025-01-06", 15, 3, 3), ("2025-01-13", 7, 3, 1)]


def test_net_is_taken_per_commit(spark):
    got = weeks(spark, [("r", "2025-01-08T10:00:00Z", 10, 2), ("r", "2025-01-08T11:00:00Z", 1, 5)])
    assert rows(got, "net_mods", "net_adds") == [(15, 8)]


def hamilton(total, shares):
    """Largest remainder in plain Python, on the same doubles."""
    if not shares:
        return []
    weight = float(sum(shares))
    if weight == 0:
        return [total] + [0] * (len(shares) - 1)
    quotas = [float(total) * s / weight for s in shares]
    parts = [int(q) for q in quotas]
    order = sorted(range(len(shares)), key=lambda i: (-(quotas[i] - int(quotas[i])), i))
    for i in order[: total - sum(parts)]:
        parts[i] += 1
    return parts


def test_apportion_against_brute_force(spark):
    random.seed(3)
    cases = [(35, [70, 30]), (7, [1, 1, 1]), (5, [0, 0]), (9, []), (0, [3, 4])]
    cases += [(random.randrange(5000), [random.randrange(100) for _ in range(random.randrange(1, 9))]) for _ in range(300)]
    data = [(i, t, [(f"l{j:02d}", s) for j, s in enumerate(shares)]) for i, (t, shares) in enumerate(cases)]
    df = spark.createDataFrame(data, "i INT, total BIGINT, shares ARRAY<STRUCT<language: STRING, bytes: BIGINT>>")
    got = df.select("i", remote.apportion(F.col("total"), F.col("shares")).alias("p")).collect()
    for r in got:
        total, shares = cases[r["i"]]
        parts = [p["part"] for p in r["p"]]
        assert parts == hamilton(total, shares)
        if shares:
            assert sum(parts) == total
            assert all(abs(p - Fraction(total * s, sum(shares) or 1)) < 1 or sum(shares) == 0 for p, s in zip(parts, shares))
    assert [p["part"] for p in next(r["p"] for r in got if r["i"] == 0)] == [25, 10]


def test_repo_statistics(spark):
    repos = spark.createDataFrame(
        [("o", "a", False, {"Rust": 70, "TypeScript": 30}), ("o", "b", False, {}), ("o", "c", False, None), ("o", "d", False, {"Go": 0})], REPOS
    )
    weekly = weeks(
        spark,
        [
            ("o/a", "2025-01-06T00:00:00Z", 20, 6),
            ("o/a", "2025-01-13T00:00:00Z", 15, 5),
            ("o/b", "2025-01-06T00:00:00Z", 4, 1),
            ("o/d", "2025-01-06T00:00:00Z", 0, 0),
        ],
    )
    contributed = remote.contributions(repos, weekly)
    langs = rows(remote.remote_repo_languages(contributed), "label", "language", "additions", "deletions", "net_modifications", "net_additions", "files")
    assert langs == [
        ("o/a", "Rust", 25, 8, 25, 17, 2),
        ("o/a", "TypeScript", 10, 3, 10, 7, 2),
        ("o/b", "Other", 4, 1, 4, 3, 1),
    ]
    totals = rows(remote.remote_by_repo(contributed), "label", "commits", "additions")
    assert totals == [("o/a", 2, 35), ("o/b", 1, 4), ("o/c", 0, 0), ("o/d", 1, 0)]
    assert remote.week_languages(contributed).filter("week_start IS NULL").count() == 0
    idle = remote.contributions(spark.createDataFrame([("o", "idle", False, {"Rust": 7})], REPOS), weekly)
    assert idle.count() == 1 and remote.week_languages(idle).count() == 0
    # A Saturday belongs to the month of its Monday.
    late = remote.contributions(repos, weeks(spark, [("o/a", "2025-02-01T00:00:00Z", 3, 0)]))
    assert rows(remote.remote_by_period(late), "label", "commits") == [("2025-01", 1)]


def test_windows_merge(spark):
    chunks = spark.createDataFrame(
        [
            ("2024-01-01", "Own", "Repo", False, {}, 4),
            ("2025-01-01", "own", "repo", True, {"Go": 9}, 7),
            ("2026-01-01", "own", "repo", True, {"C": 1}, 1),
            ("2024-01-01", "own", "solo", True, None, 2),
        ],
        "window_start STRING, owner STRING, name STRING, is_fork BOOLEAN, languages MAP<STRING, BIGINT>, commit_count BIGINT",
    ).withColumn("window_start", F.col("window_start").cast("timestamp"))
    merged = remote.merge_windows(chunks)
    got = {r["repo_key"]: (r["owner"], r["is_fork"], r["languages"], r["commit_count"]) for r in merged.collect()}
    assert got == {"own/repo": ("Own", False, {"Go": 9}, 12), "own/solo": ("own", True, {}, 2)}
    assert rows(filters.owned_by(filters.drop_forks(merged), "OWN"), "name") == [("Repo",)]


def test_private_repositories_are_added_once(spark):
    listed = spark.createDataFrame([("Own", "A", False, {"Go": 1}, 5)], REPOS + ", commit_count BIGINT")
    private = spark.createDataFrame([("own", "a", False, {}), ("own", "b", False, {"C": 2}), ("own", "f", True, {})], REPOS)
    assert rows(remote.add_private(listed, private), "owner", "name", "commit_count") == [("Own", "A", 5), ("own", "b", 0)]
    assert rows(remote.add_private(listed, private, True), "name") == [("A",), ("b",), ("f",)]


def test_inactive_contributions_are_dropped(spark):
    repos = spark.createDataFrame([("o", "a", False, {}, 0), ("o", "b", False, {}, 3), ("o", "c", False, {}, 0)], REPOS + ", commit_count BIGINT")
    weekly = weeks(spark, [("o/a", "2025-01-06T00:00:00Z", 1, 0)])
    kept = remote.repo_line_totals(repos, weekly)
    assert rows(kept, "repo", "commits", "adds") == [("o/a", 0, 1), ("o/b", 3, 0)]
    assert rows(remote.active_repos(kept)) == [(2,)]


def test_multi_window(spark):
    history = spark.createDataFrame(
        [("o/a", "2025-01-30T00:00:00Z", 10, 1), ("o/a", "2025-01-10T00:00:00Z", 5, 9), ("x/y", "2025-01-30T00:00:00Z", 9, 9)], HISTORY
    )
    repos = spark.createDataFrame([("o", "a", False, {"Rust": 1, "Go": 1})], REPOS)
    figures, langs = cards.multi_window(history, repos, [0.5, 7, 30], "2025-02-01")
    assert rows(figures, "window_days", "repos", "commits", "additions", "net_additions") == [(30, 1, 2, 15, 9), (7, 1, 1, 10, 9)]
    assert rows(langs.filter("window_days = 30"), "language", "additions", "rank") == [("Go", 8, 1), ("Rust", 7, 2)]


def test_card_figures(spark):
    row = cards.card_row(
        spark.createDataFrame([(1500, 2500000, 7, 2000)], "commits BIGINT, additions BIGINT, deletions BIGINT, net_additions BIGINT"),
        spark.createDataFrame([("a",), ("b",)], "repo STRING"),
        spark.createDataFrame([(3, 4, 5)], "total_prs BIGINT, total_reviews BIGINT, total_issues BIGINT"),
        spark.createDataFrame([("2019-05-01T00:00:00Z",)], "created_at STRING"),
    )
    full = [(r["figure"], r["value"]) for r in cards.card_figures(row, style="separated", line_style="short").orderBy("position").collect()]
    assert full == [
        ("commits", "1,500"), ("repos", "2"), ("prs", "3"), ("additions", "+2.5M"), ("deletions", "-7"),
        ("net_additions", "+2.0k"), ("reviews", "4"), ("issues", "5"), ("member_since", "2019"),
    ]
    short = [r["figure"] for r in cards.card_figures(row, short=True).orderBy("position").collect()]
    assert short == ["commits", "repos", "additions", "deletions", "prs", "issues"]


def test_card_languages_by_additions(spark):
    data = [("Rust", 500), ("Go", 10), ("TypeScript", 999), ("Python", 300), ("Java", 200), ("Empty", 0)]
    df = spark.createDataFrame(data, "language STRING, additions BIGINT")
    got = cards.card_languages(df, rows=1).collect()
    assert [r["language"] for r in got] == ["TypeScript", "Rust", "Python"]
    assert abs(got[0]["share"] - 999 / 2009 * 100) < 1e-9


def test_fetch_keeps_the_first_group_and_excludes_languages(spark):
    chunks = spark.createDataFrame(
        [
            ("2024-01-01", "Me", "a", False, {"Rust": 7, "Go": 3}, 2),
            ("2024-01-01", "me", "idle", False, {"C": 1}, 0),
            ("2024-01-01", "me", "fork", True, {"C": 1}, 4),
            ("2024-01-01", "you", "b", False, {"C": 1}, 4),
        ],
        "window_start STRING, owner STRING, name STRING, is_fork BOOLEAN, languages MAP<STRING, BIGINT>, commit_count BIGINT",
    )
    history = spark.createDataFrame([("Me/a", "2025-01-06T00:00:00Z", 10, 0), ("Me/a", "2025-06-06T00:00:00Z", 10, 0), ("you/b", "2025-01-06T00:00:00Z", 5, 0)], HISTORY)
    private = spark.createDataFrame([("me", "p", False, {"Zig": 1})], REPOS)
    plan = fetch(chunks, history, "ME", until="2025-02-01", exclude=["rust"], private=private)
    assert plan.group == "language"
    assert rows(plan.repos, "repo", "commits", "adds") == [("Me/a", 2, 10)]
    assert rows(plan.languages(), "label", "language", "additions") == [("2025-01", "Go", 3)]
    assert rows(plan.totals(), "commits", "additions") == [(1, 3)]
    both = fetch(chunks, history, "me", include_contributed=True, include_forks=True, group=["repo"])
    assert rows(both.buckets(), "label", "commits", "additions") == [("Me/a", 2, 20), ("me/fork", 0, 0), ("you/b", 1, 5)]
    assert rows(both.active_repos()) == [(3,)]


# ---- refresh ------------------------------------------------------------------------


def test_refresh_keeps_range_and_deduplicates(spark):
    old = spark.createDataFrame(
        [("r", "2025-01-01T00:00:00Z", 1, 1), ("r", "2025-01-05T00:00:00Z", 2, 2), ("r", "2025-01-05T00:00:00Z", 2, 2)], HISTORY
    )
    new = spark.createDataFrame([("r", "2025-01-05T00:00:00Z", 2, 2), ("r", "2025-01-09T00:00:00Z", 3, 3)], HISTORY)
    got = refresh.refresh_history(old, new, "2025-01-02", "2025-01-06")
    assert rows(got, "committed_date", "additions") == [("2025-01-05T00:00:00Z", 2), ("2025-01-09T00:00:00Z", 3)]


def test_equal_commits_with_object_ids_stay_apart(spark):
    data = [("r", "a", "2025-01-05T00:00:00Z", 2, 2), ("r", "b", "2025-01-05T00:00:00Z", 2, 2)]
    assert refresh.dedup_history(spark.createDataFrame(data, schemas.HISTORY)).count() == 2


def test_append_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "history")
    first = spark.createDataFrame([("r", "2025-01-05T00:00:00Z", 2, 2), ("r", "bad", 0, 0)], HISTORY)
    second = first.unionByName(spark.createDataFrame([("r", "2025-02-05T00:00:00Z", 3, 3)], HISTORY))
    for batch in (first, second, second):
        refresh.append_history(spark, path, batch)
    assert rows(spark.read.parquet(path), "committed_date", "month") == [("2025-01-05T00:00:00Z", "2025-01"), ("2025-02-05T00:00:00Z", "2025-02")]


def test_refetch_plan(spark, tmp_path):
    repos = spark.createDataFrame([(x,) for x in ("new", "busy", "idle", "done")], "repo STRING")
    marks = spark.createDataFrame(
        [("busy", "2025-01-01"), ("busy", "2025-01-03"), ("idle", "2025-01-02"), ("done", "2025-02-01")], "repo STRING, until STRING"
    ).withColumn("until", F.col("until").cast("timestamp"))
    active = spark.createDataFrame([("busy",), ("done",)], "repo STRING")
    plan = refresh.plan_refetch(repos, marks, active, "2024-06-01", "2025-01-10")
    since = F.date_format("fetch_since", "yyyy-MM-dd")
    assert rows(plan, "repo", "action", since) == [
        ("busy", "fetch", "2025-01-03"), ("done", "keep", None), ("idle", "skip", None), ("new", "fetch", "2024-06-01"),
    ]
    assert rows(refresh.advance_marks(plan, "2025-01-10"), "repo") == [("busy",), ("idle",), ("new",)]
    path = str(tmp_path / "marks")
    marks.write.parquet(path)
    refresh.append_marks(path, plan, "2025-01-10")
    again = refresh.plan_refetch(repos, spark.read.parquet(path), active, "2024-06-01", "2025-01-10")
    assert rows(again, "action") == [("keep",)] * 4

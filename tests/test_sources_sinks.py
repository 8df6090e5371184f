import json
from collections import Counter

import pytest
from conftest import CHANGES, COMMITS, rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from revtally.functions.identity import involves, me_email, me_login, me_name
from revtally.operators import buckets, people, remote
from revtally.operators.history import History
from revtally.sinks import documents
from revtally.sources import commit_log, pages, stats_json
from revtally.streaming import live

OID = "0123456789abcdef0123456789abcdef0123456%d"


def record(n, author, seconds, message, body):
    mail = author.lower() + "@test.com"
    return "\x1e" + "\x1f".join([OID % n, author, mail, author, mail, str(seconds), message]) + "\x1d\n\n" + body


LOG = (
    record(1, "Alice", 1705312800, "Initial commit\n", "11\t0\tsrc/main.rs\n5\t0\tREADME.md\n\n")
    + record(2, "Bob", 1705413600, "Add\n\nCo-authored-by: Charlie <c@test.com>\n", "5\t1\tsrc/main.rs\n-\t-\tlogo.png\n0\t0\tx y.xyz\n")
    + record(3, "", 1705413601, "", "")
)


@pytest.fixture()
def log(tmp_path):
    path = tmp_path / "my repo+1.log"
    path.write_bytes(LOG.encode())
    return str(path)


def test_commit_log(spark, log):
    commits = commit_log.read_commit_log(spark, log)
    got = commits.orderBy("ts").collect()
    assert [(r["repo"], r["oid"][-1], r["author"]["name"], str(r["ts"]), r["message_subject"]) for r in got] == [
        ("my repo+1", "1", "Alice", "2024-01-15 10:00:00", "Initial commit"),
        ("my repo+1", "2", "Bob", "2024-01-16 14:00:00", "Add"),
        ("my repo+1", "3", "Unknown", "2024-01-16 14:00:01", ""),
    ]
    assert [tuple(p) for p in got[1]["co_authors"]] == [("Charlie", "c@test.com")]
    changes = commit_log.read_numstat(commit_log.read_records(spark, log))
    assert rows(changes, "path", "language", "additions", "deletions") == [
        ("README.md", "Markdown", 5, 0), ("src/main.rs", "Rust", 11, 0), ("src/main.rs", "Rust", 5, 1), ("x y.xyz", None, 0, 0),
    ]
    h = History(commits, changes)
    assert rows(buckets.totals(h), "commits", "additions", "files") == [(3, 21, 4)]
    assert rows(buckets.by_repo(h), "label", "commits") == [("my repo+1", 3)]


def test_empty_log(spark, tmp_path):
    (tmp_path / "empty.log").write_text("")
    assert commit_log.read_commit_log(spark, str(tmp_path / "empty.log")).count() == 0


def test_bad_logs_are_reported_and_left_out(spark, log, tmp_path):
    bad = tmp_path / "bad.log"
    bad.write_bytes((record(1, "Eve", 1705312800, "m", "1\t1\ta.py\n") + "\x1ejunk").encode())
    gone = str(tmp_path / "gone.log")
    commits, changes, errors = commit_log.read_many(spark, [log, str(bad), gone])
    assert commits.count() == 4 and changes.count() == 5
    commits, changes, _ = commit_log.read_many(spark, [log, str(bad), gone], whole_logs=True)
    assert commits.count() == 3 and changes.count() == 4
    found = {r["path"].split("/")[-1]: r["error"] for r in errors.collect()}
    assert set(found) == {"bad.log", "gone.log"} and found["bad.log"] == "incomplete record"


PATCH = """diff --git a/src/main.rs b/src/main.rs
index 111..222 100644
--- a/src/main.rs
+++ b/src/main.rs
@@ -1,3 +1,4 @@
 fn main() {
-    old();
+    new();
+++ counter;
--- counter;
 }
@@ -9 +10 @@
+tail
\\ No newline at end of file
diff --git a/logo.png b/logo.png
index 1..2 100644
Binary files a/logo.png and b/logo.png differ
diff --git a/gone.py b/gone.py
deleted file mode 100644
index 333..000
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/run.sh b/run.sh
old mode 100644
new mode 100755
"""


def test_patch_lines(spark, tmp_path):
    path = tmp_path / "p.log"
    path.write_bytes((record(1, "Alice", 1705312800, "diff --git a/x b/x\n", PATCH)).encode())
    got = commit_log.count_patch_lines(commit_log.read_records(spark, str(path)))
    assert rows(got, "path", "language", "additions", "deletions") == [
        ("gone.py", "Python", 0, 2), ("run.sh", "Shell", 0, 0), ("src/main.rs", "Rust", 3, 2),
    ]


def test_patch_and_counts_with_odd_characters(spark, tmp_path):
    for mark in ("\r", "\u0085", "\u2028"):
        patch = f"diff --git a/x.py b/x.py\nindex 1..2\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n+a{mark}+b{mark}-c\n"
        path = tmp_path / "odd.log"
        path.write_bytes(record(1, "Alice", 1705312800, "m", patch).encode())
        got = commit_log.count_patch_lines(commit_log.read_records(spark, str(path)))
        assert rows(got, "path", "additions", "deletions") == [("x.py", 1, 0)]
    quoted = 'diff --git "a/a\\"b\\\\n%+\\303\\251.py" "b/a\\"b\\\\n%+\\303\\251.py"\nindex 1..2\n'
    sides = '--- "a/a\\"b\\\\n%+\\303\\251.py"\n+++ "b/a\\"b\\\\n%+\\303\\251.py"\n@@ -1 +1 @@\n+a\n'
    path.write_bytes(record(1, "Alice", 1705312800, "m", quoted + sides).encode())
    got = commit_log.count_patch_lines(commit_log.read_records(spark, str(path)))
    assert rows(got, "path", "language", "additions") == [('a"b\\n%+é.py', "Python", 1)]
    path.write_bytes(record(1, "Alice", 1705312800, "m", '1\t2\t"a\\tb.py"\n3\t4\tc\u2028d.py\n').encode())
    got = commit_log.read_numstat(commit_log.read_records(spark, str(path)))
    assert rows(got, "path", "language", "additions") == [("a\tb.py", "Python", 1), ("c\u2028d.py", "Python", 3)]


# ---- pages --------------------------------------------------------------------------


def lines(tmp_path, *docs):
    path = tmp_path / "pages.json"
    path.write_text("\n".join(json.dumps(d) for d in docs))
    return str(path)


def repo(owner, name, fork=False, **languages):
    edges = [{"size": s, "node": {"name": n.rstrip("_")}} for n, s in languages.items()]
    return {"name": name, "isFork": fork, "owner": {"login": owner}, "languages": {"edges": edges}}


def connection(*nodes):
    return {"pageInfo": {"hasNextPage": False, "endCursor": None}, "nodes": list(nodes)}


def test_repo_pages(spark, tmp_path):
    page = {"data": {"user": {"repositories": connection(repo("o", "a", Rust=120, TypeScript=80), repo("o", "f", True))}}}
    twice = {"data": {"user": {"repositories": connection(repo("o", "b", Go=10, Go_=20))}}}
    path = lines(tmp_path, page, twice, {"errors": [{"message": "x"}, {"message": "y"}]}, {})
    repos, errors = pages.read_repo_pages(spark, path)
    assert {r["name"]: r["languages"] for r in repos.collect()} == {"a": {"Rust": 120, "TypeScript": 80}, "b": {"Go": 30}}
    assert rows(errors) == [("response has no data",), ("x; y",)]
    assert pages.read_repo_pages(spark, path, include_forks=True)[0].count() == 3


def test_contributed_and_private_pages(spark, tmp_path):
    path = lines(tmp_path, {"data": {"user": {"repositoriesContributedTo": connection(repo("o", "a"))}}})
    assert rows(pages.read_repo_pages(spark, path, "contributed")[0], "owner", "name") == [("o", "a")]
    path = lines(tmp_path, {"data": {"viewer": {"login": "Me", "repositories": connection(repo("me", "p"))}}})
    assert pages.read_private_repos(spark, path, "mE")[0].count() == 1
    assert pages.read_private_repos(spark, path, "you")[0].count() == 0


def test_contribution_pages(spark, tmp_path):
    def page(window, prs, counts):
        entries = [{"repository": repo("o", n), "contributions": {"totalCount": c}} for n, c in counts.items()]
        body = {"commitContributionsByRepository": entries, "totalPullRequestContributions": prs, "totalPullRequestReviewContributions": 7}
        return {"window_start": window, "data": {"user": {"contributionsCollection": body}}}

    path = lines(tmp_path, page("2024-01-01T00:00:00Z", 4, {"a": 11}), page("2025-01-01T00:00:00Z", 5, {"a": 1, "b": 4}))
    found, summary, errors = pages.read_contributions(spark, path)
    assert rows(remote.merge_windows(found), "repo_key", "commit_count") == [("o/a", 12), ("o/b", 4)]
    assert rows(remote.summary(summary)) == [(9, 14, 0)]
    assert errors.count() == 0


def test_history_pages(spark, tmp_path):
    def answer(*nodes):
        return {"defaultBranchRef": {"target": {"history": {"totalCount": len(nodes), "nodes": list(nodes)}}}}

    def node(date, a):
        return {"additions": a, "deletions": 1, "committedDate": date}

    data = {"repo0": answer(node("d1", 3), node("d2", 4)), "repo1": answer(node("d3", 5)), "repo2": None, "repo3": {"defaultBranchRef": None}}
    path = lines(tmp_path, {"repos": ["o/a", "o/b", "o/c", "o/d"], "data": data})
    got, errors = pages.read_history_pages(spark, path)
    assert rows(got, "repo", "committed_date", "additions") == [("o/a", "d1", 3), ("o/a", "d2", 4), ("o/b", "d3", 5)]
    assert errors.count() == 0


def test_user_page(spark, tmp_path):
    user = {"id": "n", "login": "me", "publicRepositories": {"totalCount": 3}, "followers": {"totalCount": 1},
            "following": {"totalCount": 2}, "avatarUrl": "a", "url": "u", "createdAt": "2019-01-01T00:00:00Z"}
    got, errors = pages.read_user(spark, lines(tmp_path, {"data": {"user": user}}, {"data": {"user": None}}))
    assert rows(got, "login", "name", "public_repos", "created_at") == [("me", None, 3, "2019-01-01T00:00:00Z")]
    assert rows(errors) == [("user not found",)]


# ---- documents ----------------------------------------------------------------------


def test_stats_document_has_a_head_and_its_people(five):
    docs = documents.to_stats_json(five, buckets.level_key("period")).collect()
    found = {(r["section"], r["label"], r["person"]): json.loads(r["json"]) for r in docs}
    assert len(docs) == 3 + 8 and all((r["kind"] == "head") == (r["person"] is None) for r in docs)
    total = found["totals", "Total", None]
    assert total["total_commits"] == 5 and total["total_additions"] == 74
    assert total["by_language"]["Rust"] == {"additions": 24, "deletions": 5, "files_changed": 3, "net_modifications": 24, "net_additions": 19}
    charlie = found["periods", "2024-01", "Charlie"]
    assert charlie["commits"] == 0 and charlie["co_authored_commits"] == 1
    assert charlie["languages"] == charlie["co_authored_languages"]
    assert found["periods", "2024-02", "Alice"]["co_authored_languages"] == {}


@pytest.mark.parametrize("few_labels", [True, False])
def test_stats_document_against_plain_sums(spark, few_labels):
    who = lambda name: (name, "e")
    commits = [
        (1, "r", who("A"), None, [who("B"), who("A"), who("B")], "2024-01-01", None), (2, "r", who(None), None, None, "2024-01-02", None),
        (None, "r", who("B"), None, [], "2024-02-01", None), (4, "r", who("B"), None, [who(None)], None, None),
        (5, "r", who("A"), None, [], "2024-02-03", None), (5, "r", who("C"), None, [who("A")], "2024-02-03", None), (6, "r", who("C"), None, [], "2024-02-04", None),
    ]
    changes = [
        (1, "a", "Go", 3, 5), (1, "b", "Go", 4, None), (1, "c", None, None, 2), (2, "d", "Go", None, None), (None, "e", "Go", 7, 7),
        (4, "f", "C", 1, 0), (4, "g", "Go", 0, 9), (5, "h", "Other", 6, 1), (5, "i", None, 1, 6), (9, "j", "Go", 8, 8),
    ]
    frame = spark.createDataFrame(commits, COMMITS)
    h = History(frame.withColumn("ts", F.col("ts").cast("timestamp")), spark.createDataFrame(changes, CHANGES))
    names = ("additions", "deletions", "files_changed", "net_modifications", "net_additions")
    expected = {}
    for commit, _, author, _, others, ts, _ in commits:
        roles = [(author[0], False), *((x[0], True) for x in others or [])]
        for label in (ts and ts[:7], "Total"):
            for person, co in [("everybody", False), *roles]:
                doc = expected.setdefault((label, person), {True: Counter(), False: Counter(), "languages": {}, "co": {}})
                doc[co]["commits"] += 1
                for _, _, language, a, d in (x for x in changes if commit is not None and x[0] == commit):
                    given = [x for x in (a, d) if x is not None]
                    values = (a or 0, d or 0, 1, max(given, default=0), max(a - d, 0) if len(given) == 2 else 0)
                    for lines in (doc["languages"], *([doc["co"]] if co else [])):
                        lines.setdefault(language or "Other", Counter()).update(dict(zip(names, values)))
                    doc[co].update(dict(zip(names, values)))
    docs = documents.to_stats_json(h, buckets.level_key("period"), few_labels).collect()
    assert len(docs) == len(expected) == len({(r["label"], r["kind"], r["person"]) for r in docs})
    plain = lambda lines: {k: {n: v[n] for n in names} for k, v in lines.items()}
    for r in docs:
        found, want = json.loads(r["json"]), expected[r["label"], "everybody" if r["kind"] == "head" else r["person"]]
        assert r["section"] == ("totals" if r["label"] == "Total" else "periods")
        if r["kind"] == "head":
            assert found.pop("by_language") == plain(want["languages"])
            assert found == {k: v for k, v in {"period_label": r["label"], **{f"total_{n}": want[False][n] for n in ("commits", *names) if n != "files_changed"}}.items() if v is not None}
        else:
            assert (found.pop("languages"), found.pop("co_authored_languages")) == (plain(want["languages"]), plain(want["co"]))
            counted = {p + n: want[co][n] for n in ("commits", *names) if n != "files_changed" for p, co in (("", False), ("co_authored_", True))}
            assert found == {k: v for k, v in {"period_label": r["label"], "author": r["person"], **counted}.items() if v is not None}


def test_scan_document(spark):
    repos = spark.createDataFrame([("/b",), ("/a",)], "path STRING")
    docs = [(r["kind"], r["path"], json.loads(r["json"])) for r in documents.to_scan_json(repos).collect()]
    assert sorted(docs, key=str) == [("head", None, {"count": 2}), ("repository", "/a", {"path": "/a"}), ("repository", "/b", {"path": "/b"})]
    assert [json.loads(r["json"]) for r in documents.to_scan_json(repos.limit(0)).collect()] == [{"count": 0}]


def test_fetch_document_round_trip(spark, tmp_path):
    one = lambda **kw: spark.createDataFrame([kw])
    totals = spark.createDataFrame([("2025-01", 2, 10, 4, 11, 7), ("2025-02", 1, 5, 1, 5, 4)],
        "label STRING, commits BIGINT, additions BIGINT, deletions BIGINT, net_modifications BIGINT, net_additions BIGINT")
    langs = spark.createDataFrame([("2025-01", "Rust", 10, 4, 11, 7, 2), ("2025-02", "Go", 5, 1, 5, 4, 1)],
        "label STRING, language STRING, additions BIGINT, deletions BIGINT, net_modifications BIGINT, net_additions BIGINT, files BIGINT")
    sections = documents.to_fetch_json(
        one(username="me", days=30, active_repos=2), one(login="me"), totals, langs, one(total_prs=1, total_reviews=2, total_issues=3)
    )
    document = documents.fetch_document(sections)
    doc = json.loads(document.collect()[0]["value"])
    assert [p["period_label"] for p in doc["periods"]] == ["2025-01", "2025-02"]
    assert doc["totals"]["total_commits"] == 3 and doc["totals"]["by_language"]["Go"]["files_changed"] == 1
    path = str(tmp_path / "doc")
    documents.write_report(document, path, "text")
    loaded = stats_json.read_stats_json(spark, path)
    assert rows(loaded, "username", "days", "commits", "total_issues") == [("me", 30, 3, 3)]
    stripped = stats_json.without_languages(loaded, ["rUST", "nope"])
    assert rows(stripped, "additions", "deletions") == [(5, 1)]
    assert rows(stats_json.document_languages(stripped), "language", "files") == [("Go", 1)]


def test_loaded_document_defaults(spark, tmp_path):
    path = lines(tmp_path, {"user": {"login": "me"}, "totals": {}})
    assert rows(stats_json.read_stats_json(spark, path), "username", "days", "active_repos", "commits", "total_prs") == [("me", 365, 0, 0, 0)]
    with pytest.raises(PySparkException):
        stats_json.read_stats_json(spark, lines(tmp_path, {"user": {"login": "me"}})).collect()


def test_tree_document(five):
    docs = documents.to_tree_json(buckets.group_tree(five, ["author"]), buckets.tree_languages(five, ["author"]))
    found = {tuple(r["path"]): json.loads(r["json"]) for r in docs.collect()}
    assert found["Bob",]["by_language"]["CSS"]["additions"] == 20
    assert found[()]["total_commits"] == 5


# ---- streams ------------------------------------------------------------------------

ARRIVING = "repo STRING, oid STRING, committed_date STRING, committed_at TIMESTAMP, additions BIGINT, deletions BIGINT"


def feed(spark, tmp_path, data):
    source = str(tmp_path / "in")
    frame = spark.createDataFrame([(r, o, t, a, d) for r, o, t, a, d in data], "repo STRING, oid STRING, committed_date STRING, additions BIGINT, deletions BIGINT")
    frame.withColumn("committed_at", F.col("committed_date").cast("timestamp")).select(*[c.split()[0] for c in ARRIVING.split(", ")]).write.mode("append").parquet(source)
    return spark.readStream.schema(ARRIVING).parquet(source)


def test_stream_keeps_each_commit_once_over_restarts(spark, tmp_path):
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    first = [("r", "a", "2024-01-01T10:00:00Z", 1, 0), ("r", "a", "2024-01-01T10:00:00Z", 1, 0), ("r", "c", "2024-03-02T10:00:00Z", 3, 0)]
    second = [("r", "a", "2024-01-01T10:00:00Z", 1, 0), ("r", "b", "2024-01-02T10:00:00Z", 2, 0), ("r", "late", "2022-12-30T10:00:00Z", 4, 1)]
    for batch in (first, second):
        live.refresh(feed(spark, tmp_path, batch), out, progress).awaitTermination()
    stored = live.stored(spark, out)
    assert rows(stored, "oid", "month") == [("a", "2024-01"), ("b", "2024-01"), ("c", "2024-03"), ("late", "2022-12")]
    assert rows(live.month_buckets(stored), "month", "adds", "commits") == [("2022-12", 4, 1), ("2024-01", 3, 2), ("2024-03", 3, 1)]


def test_stream_buckets_equal_batch(spark, tmp_path):
    data = [("r", str(i), f"2024-01-{1 + i:02d}T12:00:00Z", i, 1) for i in range(20)] + [("r", "z", "2024-03-01T00:00:00Z", 0, 0)]
    out = str(tmp_path / "out")
    live.refresh(feed(spark, tmp_path, data), out, str(tmp_path / "progress")).awaitTermination()
    batch = spark.read.schema(ARRIVING).parquet(str(tmp_path / "in"))
    for unit, fn, column in (("week", live.week_buckets, "week_start"), ("day", live.day_buckets, "day_start")):
        want = batch.groupBy(F.date_trunc(unit, "committed_at").alias(column)).agg(
            F.sum("additions").alias("adds"), F.count(F.lit(1)).alias("commits"), F.sum(F.greatest(F.col("additions") - F.col("deletions"), F.lit(0))).alias("n")
        )
        assert rows(fn(live.stored(spark, out)), column, "adds", "commits", "net_adds") == rows(want)


def test_stream_months(spark, tmp_path):
    arriving = feed(spark, tmp_path, [("r", "a", "2024-01-31T23:00:00Z", 1, 0), ("r", "b", "2024-02-01T00:00:00Z", 2, 0)])
    q = live.month_totals(arriving).writeStream.outputMode("update").format("memory").queryName("months").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("months"), "repo", "month", "adds", "commits") == [("r", "2024-01", 1, 1), ("r", "2024-02", 2, 1)]


def test_people_of_a_login(spark, build):
    h = build([(1, "a", "Hugo", ["Charlie"], "2024-01-01 00:00:00"), (2, "a", "Eve", [], "2024-01-01 00:00:00")], [])
    identity = spark.createDataFrame([("charlie@test.com", "Dev"), ("x@test.com", "dev")], "email STRING, login STRING")
    marked = people.mark_login(h.commits, identity, "dEV")
    assert rows(marked, "commit_id", "is_login") == [(1, True), (2, False)]
    nobody = h.commits.withColumn("author", F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("email")))
    marked = people.mark_login(nobody, identity, "dEV")
    assert rows(marked.filter("NOT is_login"), "commit_id") == [(2,)]
    for test in (me_name("hugo"), me_email("hugo"), involves("hugo"), me_login("dev", ["hugo@test.com"])):
        assert rows(nobody.filter(~test), "commit_id") == [(1,), (2,)]
    joined = people.identity_join(people.distinct_people(h.commits), identity)
    assert rows(joined, "name", "login") == [("Charlie", "Dev"), ("Eve", None), ("Hugo", None)]
    assert people.distinct_emails(h.commits).count() == 3

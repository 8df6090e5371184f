"""What must not depend on fitting into a row, a task or a broadcast."""

import json
import random
from pathlib import Path

import pytest
from conftest import rows

from revtally import stats
from revtally.operators import buckets, history, lines
from revtally.operators.history import History
from revtally.sinks import documents
from revtally.sources import commit_log, stats_json

# ---- records cut over many tasks ----------------------------------------------------------

OID = "0123456789abcdef0123456789abcdef%08d"


def head(n, message, oid=None, seconds=None):
    fields = [oid or OID % n, "Ann", "ann@x", "Ann", "ann@x", str(1705312800 + n * 86400) if seconds is None else seconds]
    return "\x1e" + "\x1f".join([*fields, message]) + "\x1d\n\n"


def patch(rng, n):
    parts = []
    for k in range(rng.randint(0, 4)):
        name = rng.choice([f"src/f{n}_{k}.py", f"a b/{n} {k}.rs", f"x{n}{k}.xyz"])
        parts.append(f"diff --git a/{name} b/{name}\nindex 1..2 100644\n")
        kind = rng.randint(0, 5)
        if kind == 0:
            parts.append(f"Binary files a/{name} and b/{name} differ\n")
            continue
        if kind == 1:
            continue  # a mode change
        parts.append(f"--- a/{name}\n" if kind != 2 else "--- /dev/null\n")
        parts.append(f"+++ b/{name}\n" if kind != 3 else "+++ /dev/null\n")
        for _ in range(rng.randint(1, 3)):
            parts.append("@@ -1,2 +1,2 @@ def f\n")
            content = ["+new", "-old", " same", "--- gone", "+++ come", "\\ No newline at end of file", "+@@ not a hunk", " diff --git a/x b/x", "-", "+", "+5\t5\tx"]
            parts += [rng.choice(content) + "\n" for _ in range(rng.randint(0, 30))]
    return "".join(parts)


MESSAGES = [
    "one line\n",
    "diff --git a/m b/m\nindex 1..2\n--- a/m\n+++ b/m\n@@ -1 +1 @@\n+in a message\n",
    "subject\n\n@@ -1 +1 @@\n+not counted\n-nor this\n3\t4\tnor/this.py\nCo-authored-by: Bob <b@x>\n",
    "",
]


def write_logs(tmp_path, body):
    rng = random.Random(4)
    for name in ("one", "two"):
        text = "".join(head(n, MESSAGES[n % 4]) + body(rng, n) for n in range(25))
        bad = head(90, "bad id\n", oid="zz") + body(rng, 90) + head(91, "bad time\n", seconds="noon") + body(rng, 91)
        # the last record has no end of its message
        (tmp_path / f"{name}.log").write_text(text + bad + head(26, "fine\n") + body(rng, 26) + "\x1e" + OID % 92 + "\x1fcut short\n@@ -1 +1 @@\n+x\n")
    return [str(tmp_path / "one.log"), str(tmp_path / "two.log")]


@pytest.fixture(params=["120", "1000", "128m"])
def split_size(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


COMMITS = ("commit_id", "repo", "oid", "author.name", "ts", "message", "message_subject", "co_authors")
CHANGES = ("commit_id", "repo", "ts", "path", "language", "additions", "deletions")


def numstat(rng, n):
    return "".join(rng.choice([f"{k}\t{n}\tsrc/{k}.py\n", "-\t-\tlogo.png\n", f'{k}\t0\t"q\\"{k}.rs"\n']) for k in range(rng.randint(0, 6))) + "\n"


@pytest.mark.parametrize("patches", [True, False])
def test_records_cut_over_tasks_count_the_same(spark, tmp_path, split_size, patches):
    paths = write_logs(tmp_path, patch if patches else numstat)
    commits, changes, errors = commit_log.read_many(spark, paths, patches)
    read = commit_log.read_large_logs(spark, paths, patches)
    assert rows(read.file_changes, *CHANGES) == rows(changes, *CHANGES)
    assert rows(read.commits, *COMMITS) == rows(commits, *COMMITS)
    assert rows(read.errors, "path", "error", "records") == rows(errors, "path", "error", "records")
    assert read.commits.count() == 52 and read.file_changes.count() > 40


@pytest.mark.parametrize("patches, row_bytes", [(True, 400), (True, 4000), (False, 60)])
def test_logs_with_long_records_are_read_by_lines(spark, tmp_path, patches, row_bytes):
    paths = write_logs(tmp_path, patch if patches else numstat)
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "a b%20+ü.log").write_text(head(1, "x\n") + "1\t2\ta.py\n")
    paths += [str(tmp_path / "empty.log"), str(tmp_path / "a b%20+ü.log")]
    commits, changes, errors = commit_log.read_many(spark, paths, patches)
    read = commit_log.read_large_logs(spark, paths, patches, row_bytes)
    assert rows(read.file_changes, *CHANGES) == rows(changes, *CHANGES)
    assert rows(read.commits, *COMMITS) == rows(commits, *COMMITS)
    assert rows(read.errors, "path", "error", "records") == rows(errors, "path", "error", "records")


def test_only_logs_with_long_records_are_read_by_lines(spark, tmp_path):
    texts = {"short": head(1, "s\n") + head(2, "t\n"), "long": head(1, "s\n") + "x" * 5000 + "\n" + head(2, "t\n"), "ended": head(1, "s\n") + "\n\x1e", "empty": "", "all": "y" * 5000}
    for name, text in texts.items():
        (tmp_path / f"{name}.log").write_text(text)
    paths = [str(tmp_path / f"{name}.log") for name in texts]
    found = commit_log.logs_with_long_records(spark, paths, 4000)
    assert sorted(Path(f).name for f in found) == ["all.log", "long.log"]
    assert commit_log.logs_with_long_records(spark, paths) == []


def test_small_records_are_not_shuffled_line_by_line(spark, tmp_path):
    paths = write_logs(tmp_path, patch)
    plan = commit_log.read_large_logs(spark, paths).file_changes._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_one_patch_in_many_blocks(spark, tmp_path):
    body = "diff --git a/big.py b/big.py\nindex 1..2\n--- a/big.py\n+++ b/big.py\n@@ -1 +1 @@\n" + "+added line\n-- gone\n" * 20_000
    (tmp_path / "big.log").write_text(head(1, "big\n") + body + head(2, "small\n") + "diff --git a/s.py b/s.py\nindex 1..2\n--- a/s.py\n+++ b/s.py\n@@ -1 +1 @@\n+x\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = commit_log.read_large_logs(spark, str(tmp_path / "big.log"))
        blocks = commit_log.read_lines(spark, str(tmp_path / "big.log")).select("block").distinct().count()
        assert blocks > 20 and rows(read.file_changes, "path", "additions", "deletions") == [("big.py", 20_000, 20_000), ("s.py", 1, 0)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# ---- one document from many tasks ------------------------------------------------------------


def sections(spark, n):
    head = [("metadata", None, '{"username":"me","days":30,"active_repos":2}'), ("user", None, '{"login":"me"}'), ("totals", None, '{"total_commits":3}')]
    listed = [("periods", f"r{k:05d}", f'{{"period_label":"r{k:05d}","total_commits":{k}}}') for k in range(n)]
    return spark.createDataFrame([*head, *listed], "section STRING, label STRING, json STRING").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 500])
def test_parts_make_one_document(spark, tmp_path, n):
    path = str(tmp_path / "doc")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    documents.write_fetch_document(sections(spark, n), path)
    parts = sorted(Path(path).glob("part-*"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    document = json.loads("".join(p.read_text() for p in parts))
    assert [p["period_label"] for p in document["periods"]] == [f"r{k:05d}" for k in range(n)]
    assert document["summary"] is None and document["totals"]["total_commits"] == 3
    assert n < 500 or sum(p.stat().st_size > 0 for p in parts) > 1
    whole, listed = stats_json.read_document_parts(spark, path)
    assert rows(whole, "username", "days", "commits") == [("me", 30, 3)]
    assert rows(listed, "period_label") == [(f"r{k:05d}",) for k in range(n)]


def test_parts_equal_the_document_in_one_row(spark, tmp_path):
    some = sections(spark, 7)
    path = str(tmp_path / "doc")
    documents.write_fetch_document(some, path)
    parts = "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))
    assert json.loads(parts) == json.loads(documents.fetch_document(some).first()["value"])


# ---- few commits out of many, and lines added up when they are written ------------------------


def test_lines_of_other_commits_stay_at_their_scan(spark, five, monkeypatch):
    mine = five.where("author.name = 'Bob'").exclude_languages(["CSS"])
    few = [rows(f(mine)) for f in (buckets.totals, buckets.by_period, lambda h: buckets.bucket_languages(h, {}))]
    settled = mine.settled()
    assert rows(settled.file_changes, "commit_id") == [(2,), (2,), (4,), (4,)] and not settled.selective
    plan = buckets.totals(mine)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [commit_id" in plan and "LeftSemi" in plan
    monkeypatch.setattr(history, "FEW", 1)
    assert mine.settled().file_changes is mine.file_changes
    assert [rows(f(mine)) for f in (buckets.totals, buckets.by_period, lambda h: buckets.bucket_languages(h, {}))] == few
    assert few[0] == [(2, 25, 5, 25, 20, 4)]


def test_bucketed_lines_are_sums(spark, build):
    commits = [(k, "r", f"p{k % 3}", [], f"2024-01-{1 + k % 28:02d} 00:00:00") for k in range(1, 60)]
    changes = [(1 if k < 400 else k % 60, f"f{k}", ["Rust", "Go", None][k % 3], k % 5, k % 4) for k in range(1200)]
    plain = build(commits, changes)
    plain.save_bucketed("summed", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        h = History.from_tables(spark, "summed")
        assert h.file_changes.filter("commit_id = 1").count() == 3
        for found in (buckets.totals, buckets.by_author, buckets.by_period, lambda x: buckets.bucket_languages(x, {}), lambda x: buckets.bucket_languages(x, buckets.level_keys("author"))):
            assert rows(found(h)) == rows(found(plain))
        fewer = h.exclude_languages(["go"])
        assert rows(buckets.bucket_languages(fewer, {})) == rows(buckets.bucket_languages(plain.exclude_languages(["go"]), {}))
        plan = buckets.by_author(h)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[plan.index("SortMergeJoin") :]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE summed_commits")
        spark.sql("DROP TABLE summed_file_changes")


def test_sums_of_sums(spark, five):
    once = lines.summed(five.file_changes)
    assert rows(lines.summed(once)) == rows(once)
    assert rows(lines.per_commit(once)) == rows(lines.per_commit(five.file_changes))


def test_report_columns(five):
    report = stats(five, groups=["period"], group=["period"], columns=["net", "adds"]).report()
    assert report.columns == ["depth", "path", "kind", "label", "net", "adds"]
    assert stats(five, group=["language"], exclude_columns=["files"]).report().columns == ["kind", "label", "commits", "adds", "dels"]


# ---- logs are searched once for each thing -----------------------------------------------------


def test_patches_are_searched_once_for_a_path(spark, tmp_path):
    """What a path is made of is a column of its own, not repeated wherever the path is used."""
    paths = write_logs(tmp_path, patch)
    plan = commit_log.count_patch_lines(commit_log.read_records(spark, paths))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\+\+\+ ") == 1 and "regexp_count" not in plan


def test_flaws_of_odd_records(spark, tmp_path):
    """The shape of most records is a short cut only; others are judged as before."""
    fields = ["Ann", "a@x", "Ann", "a@x"]
    odd = {"+7": "kept", " 7 ": "kept", "7.5": "bad commit time", "9" * 18: "kept", "9" * 19: "bad commit time", "": "bad commit time"}
    texts = ["\x1e" + "\x1f".join([OID % n, *fields, t, "m\x1fn\n"]) + "\x1d\n\n1\t2\ta.py\n" for n, t in enumerate(odd)]
    cut = ["\x1e" + "\x1f".join([OID % 50, *fields, "7"]) + "\x1d\n", "\x1e" + "\x1f".join([OID % 51, *fields, "7", "no end"]), "\x1e\n  \n", "\x1e \n"]
    (tmp_path / "odd.log").write_text("".join(texts + cut))
    records = commit_log.read_records(spark, str(tmp_path / "odd.log"))
    assert sorted((r["error"], r["records"]) for r in commit_log.load_errors(records).collect()) == [("bad commit time", 3), ("incomplete record", 3)]
    assert rows(commit_log.commits_of(records), "message") == [("m\x1fn\n",)] * 3
    assert rows(commit_log.read_numstat(records), "path", "additions", "deletions") == [("a.py", 1, 2)] * 3


def test_lines_of_a_log_by_month_need_no_join(spark):
    from workload import catalog

    plan = catalog.QUERIES["commit_log_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(commit_id" not in plan

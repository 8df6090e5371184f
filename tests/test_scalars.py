import random

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from revtally.functions import display, identity, sql, text, timeparts
from revtally.operators import filters, paths
from revtally.operators.languages import with_color, with_language
from revtally.plans.reports import display_columns


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "x STRING")
    return df.select(fn(F.col("x")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize(
    "message, people",
    [
        ("Fix\n\nCo-authored-by: Bob <b@x.com>", [("Bob", "b@x.com")]),
        ("Fix\n\nCo-authored-by: Bob <b@x.com>\nCO-AUTHORED-BY:   Eve B. < e@x.com >", [("Bob", "b@x.com"), ("Eve B.", "e@x.com")]),
        ("Fix\n\nco-authored-by: Ann <a@x>", [("Ann", "a@x")]),
        ("Fix Co-authored-by: Bob <b@x.com>", []),
        ("nothing", []),
        ("x\rCo-authored-by: Bob <b@x>", []),
    ],
)
def test_trailers(spark, message, people):
    assert [tuple(p) for p in one(spark, message, text.co_authors)] == people


@pytest.mark.parametrize("message, line", [("a\nb", "a"), ("a\r\nb", "a"), ("", ""), ("only", "only"), ("\nx", "")])
def test_subject(spark, message, line):
    assert one(spark, message, text.subject) == line


@pytest.mark.parametrize(
    "url, parts",
    [
        ("https://github.com/own/rep.git", ("github", "own", "rep")),
        ("http://gitlab.com/own/rep/", ("gitlab", "own", "rep")),
        ("git@github.com:own/rep", ("github", "own", "rep")),
        ("git@gitlab.com:own/rep.git", ("gitlab", "own", "rep")),
        ("https://example.com/own/rep", None),
        ("https://github.com/own", None),
        ("https://github.com/a/b/c", None),
        ("https://github.com//b", None),
        ("https://github.com/a/.git", None),
    ],
)
def test_remote_urls(spark, url, parts):
    got = one(spark, url, text.remote_url_parts)
    assert (tuple(got) if got else None) == parts


def test_language_of_path(spark):
    known = {
        "src/main.rs": "Rust", "lib.py": "Python", "app.js": "JavaScript", "style.css": "CSS", "README.md": "Markdown",
        "Makefile": "Makefile", "src/lib/utils.rs": "Rust", "a/B.PY": "Python", "unknown.xyz": None, "plain": None,
        ".rs": None, "x.": None, "a.b/c": None, "CMakeLists.txt": "CMake",
        "a.f90": "FORTRAN Modern", "build.gradle": "Gradle", "a.sv": "SystemVerilog", "a.thrift": "Thrift", "a.vb": "Visual Basic",
        "a.lisp": "Common Lisp", "a.mdx": "MDX", "a.astro": "Astro", "a.m4": "M4", "a.adoc": "AsciiDoc", "a.pug": "Pug", "a.hbs": "Handlebars",
    }
    df = spark.createDataFrame([(p, 1) for p in known], "path STRING, n INT")
    assert dict(map(tuple, with_language(df).select("path", "language").collect())) == known


def test_language_dimension_can_be_replaced(spark):
    dim = spark.createDataFrame([("ext", "rs", "Oxide")], "kind STRING, key STRING, language STRING")
    df = spark.createDataFrame([("a.rs",), ("a.py",)], "path STRING")
    assert rows(with_language(df, dim), "path", "language") == [("a.py", None), ("a.rs", "Oxide")]


def test_colors(spark):
    df = spark.createDataFrame([("rust",), ("C++",), ("Odd",)], "language STRING")
    assert rows(with_color(df)) == [("C++", "#f34b7d"), ("Odd", "#858585"), ("rust", "#dea584")]


def test_short_numbers_round_like_the_exact_value(spark):
    random.seed(7)
    values = [0, 7, 999, 1000, 1050, 1150, 1250, 1350, 1500, 2500000, 999949, 999950, 1234567, 1050000, 1250000]
    values += [random.randrange(1000, 10**6) // 50 * 50 for _ in range(400)]
    values += [random.randrange(10**6, 10**12) // 50000 * 50000 for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "n BIGINT")

    def short(n):
        if n >= 1_000_000:
            return f"{n / 1_000_000.0:.1f}M"
        return f"{n / 1_000.0:.1f}k" if n >= 1000 else str(n)

    for r in df.select("n", display.format_number(F.col("n"), "short").alias("s")).collect():
        assert r["s"] == short(r["n"]), r
    got = df.limit(13).select(display.format_number(F.col("n"), "separated")).collect()
    assert got[12][0] == "1,234,567"


def test_percent_rounds_like_the_exact_value(spark):
    random.seed(8)
    values = [0.0, 0.05, 12.25, 12.35, 99.95, 100.0, 33.333333] + [random.randrange(1, 2000) / 20 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    for r in df.select("x", display.percent_text(F.col("x")).alias("s")).collect():
        assert r["s"] == f"{r['x']:.1f}", r


def test_change_cells(spark):
    df = spark.createDataFrame([(1500, 20), (3, 9)], "a BIGINT, d BIGINT")
    a, d = F.col("a"), F.col("d")
    got = rows(df.select(display.change_cell(a, d, "separated"), display.net_text(a, d, "short"), text.change_text(F.lit("p"), a, d)))
    assert got == [("+1,500 -20", "+1.5k", "p (+1500/-20)"), ("+3 -9", "-6", "p (+3/-9)")]
    assert display_columns(["commits", "adds", "dels"]) == [("commits",), ("adds", "dels")]
    assert display_columns(["adds", "files", "dels"]) == [("adds",), ("files",), ("dels",)]
    assert display_columns(["dels", "adds"]) == [("dels",), ("adds",)]
    assert display_columns(["adds", "dels"], compact=False) == [("adds",), ("dels",)]


def test_metric_columns():
    assert filters.metric_columns() == ["commits", "adds", "dels", "files"]
    assert filters.metric_columns(exclude=["adds"]) == ["commits", "dels", "files"]
    assert filters.metric_columns(["net", "adds", "net"], ["adds"]) == ["net", "adds"]
    with pytest.raises(ValueError):
        filters.metric_columns(["speed"])


def test_people_text(spark):
    cases = {
        "Bob <b@x>": ("Bob", "b@x"), "A <b> <c@x>": ("A <b>", "c@x"), "Bob": ("Bob", None), "Bob <b@x": ("Bob <b@x", None),
    }
    for value, want in cases.items():
        assert tuple(one(spark, value, text.split_person)) == want
    full = "Bob <12+bob@users.noreply.github.com>"
    assert one(spark, full, display.author_text) == "Bob"
    assert one(spark, full, lambda c: display.author_text(c, "simple")) == "Bob <...+bob@[github email]>"
    assert one(spark, full, lambda c: display.author_text(c, "full")) == full
    lab = "Eve <eve@users.noreply.gitlab.com>"
    assert one(spark, lab, lambda c: display.author_text(c, "simple")) == "Eve <eve@users.[gitlab email]>"
    assert one(spark, "Eve <e@x>", lambda c: display.author_text(c, "simple")) == "Eve <e@x>"


def test_author_with_several_emails(spark):
    df = spark.createDataFrame([("Bob", ["1+b@users.noreply.github.com", "b@x"]), ("Eve", [])], "name STRING, emails ARRAY<STRING>")
    shown = {m: rows(df.select(display.author_display(F.col("name"), F.col("emails"), m))) for m in ("none", "simple", "full")}
    assert shown["none"] == [("Bob",), ("Eve",)]
    assert shown["simple"] == [("Bob <...+b@[github email]>, <b@x>",), ("Eve",)]
    assert shown["full"] == [("Bob <1+b@users.noreply.github.com>, <b@x>",), ("Eve",)]


@pytest.mark.parametrize(
    "email, strict, loose",
    [
        ("18+Bob@users.noreply.github.com", "bob", "Bob"),
        ("bob@users.noreply.github.com", "bob", "bob"),
        ("bob@Users.NoReply.GitHub.com", "bob", None),
        ("bob@noreply.github.com", None, "bob"),
        ("bob@x.com", None, None),
    ],
)
def test_noreply_login(spark, email, strict, loose):
    assert one(spark, email, identity.noreply_login) == strict
    assert one(spark, email, identity.noreply_login_loose) == loose


def test_days(spark):
    assert str(one(spark, "2024-02-29", timeparts.parse_day)) == "2024-02-29 00:00:00"
    with pytest.raises(ValueError):
        timeparts.parse_day("29.02.2024")
    with pytest.raises(PySparkException):
        one(spark, "soon", timeparts.parse_day)
    assert one(spark, "2019-05-01T10:00:00Z", timeparts.member_since) == "2019"
    monday = one(spark, "2025-02-01 12:00:00", lambda c: timeparts.week_start(c.cast("timestamp")))
    assert str(monday) == "2025-01-27 00:00:00"
    with pytest.raises(ValueError):
        timeparts.period_label(F.col("x"), "year")


def test_lookback_windows(spark):
    cases = [("2020-01-01", "2022-06-01", 3), ("2021-01-01", "2022-01-01", 1), ("2022-01-01", "2022-01-01", 1), ("2023-01-01", "2022-01-01", 1)]
    df = spark.createDataFrame(cases, "s STRING, e STRING, n INT")
    spans = timeparts.lookback_windows(F.col("s").cast("timestamp"), F.col("e").cast("timestamp"))
    for r in df.select("e", "n", spans.alias("w")).collect():
        assert len(r["w"]) == r["n"]
        assert str(r["w"][-1]["window_end"])[:10] == r["e"]
        for a, b in zip(r["w"], r["w"][1:]):
            assert a["window_end"] == b["window_start"]
    late = df.filter("s >= e").select(F.inline(spans)).collect()
    assert all((r["window_end"] - r["window_start"]).total_seconds() == 60 for r in late)


def test_identity_predicates(spark, build):
    h = build([(1, "a", "Hugo", ["Charlie"], "2024-01-01 00:00:00"), (2, "a", "Eve", [], "2024-01-01 00:00:00")], [])

    def hits(predicate):
        return [r[0] for r in rows(h.commits.filter(predicate), "commit_id")]

    assert hits(identity.me_name("HUG")) == [1]
    assert hits(identity.me_name("charlie")) == [1]
    assert hits(identity.me_email("EVE@test")) == [2]
    assert hits(identity.me_email("charlie@")) == [1]
    assert hits(identity.me_login("who", ["eve@test.com"])) == [2]
    # & binds tighter than |
    assert hits(identity.me_name("eve") | identity.me_name("hugo") & identity.me_email("nobody")) == [2]
    assert hits((identity.me_name("eve") | identity.me_name("hugo")) & identity.me_email("nobody")) == []
    assert hits(identity.committed_by("hugo@")) == [1]


def test_sql_functions(spark, build):
    names = sql.register(spark)
    assert "me_name" in names
    h = build([(1, "a", "Hugo", ["Charlie"], "2024-12-31 00:00:00")], [])
    got = h.commits.selectExpr(
        "me_name('CHAR', author, co_authors) AS a", "me_email('zzz', author, co_authors) AS b", "iso_week(ts) AS w",
        "noreply_login('1+Bob@users.noreply.github.com') AS l", "net_additions(3, 9) AS n", "net_modifications(3, 9) AS m",
        "me_login('x', array('charlie@test.com'), author, co_authors) AS k", "involves('HUGO@', author, co_authors) AS i",
        "repo_key('A', 'B') AS r", "day_label(ts) AS d", "month_label(ts) AS mo",
    )
    assert rows(got) == [(True, False, "2025-W01", "bob", 0, 9, True, True, "a/b", "2024-12-31", "2024-12")]


def test_repository_roots(spark):
    found = ["/w/b/.git/HEAD", "/w/a/.git/HEAD", "/w/a/sub/.git/HEAD", "/w/a/sub/deep/x/.git/HEAD", "/w/c/readme", "/w/ab/.git/HEAD"]
    df = spark.createDataFrame([(p,) for p in found], "path STRING")
    got = [r["path"] for r in paths.discover_repos(df).collect()]
    assert got == ["/w/a", "/w/ab", "/w/b"]
    linked = df.withColumn("is_symlink", F.col("path").startswith("/w/b"))
    assert [r["path"] for r in paths.discover_repos(linked).collect()] == ["/w/a", "/w/ab"]

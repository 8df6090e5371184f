"""Named queries over the given tables, each with SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revtally.functions import display, identity, sql, text, timeparts
from revtally.operators import buckets, cards, filters, languages, paths, people, ranking, refresh, remote
from revtally.plans import reports
from revtally.plans.fetch import fetch
from revtally.plans.stats import stats
from revtally.session import scratch_path, use_utc
from revtally.sinks import documents
from revtally.sources import commit_log, pages, stats_json
from revtally.streaming import live
from workload import oracle as o
from workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def day(ts: str | Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def by_month() -> dict[str, Column]:
    return buckets.level_keys("period", label="label")


# ---- buckets ------------------------------------------------------------------------


@query("language_totals", f"{o.with_(o.CHANGES)} SELECT language, {o.LINES}, count(*) AS files FROM f GROUP BY 1")
def language_totals(spark, sf):
    return buckets.bucket_languages(t.history(spark, sf), {})


@query("lines_by_day", o.bucket_sql("strftime(ts, '%Y-%m-%d')"))
def lines_by_day(spark, sf):
    return buckets.by_period(t.history(spark, sf), "day")


@query("lines_by_iso_week", o.bucket_sql("printf('%d-W%02d', isoyear(ts), week(ts))"))
def lines_by_iso_week(spark, sf):
    return buckets.by_period(t.history(spark, sf), "week")


@query("lines_by_month", o.bucket_sql("month"))
def lines_by_month(spark, sf):
    return buckets.by_period(t.history(spark, sf), "month")


@query("by_repo", o.bucket_sql("repo"))
def by_repo(spark, sf):
    return buckets.by_repo(t.history(spark, sf))


@query("by_author_bucket", o.bucket_sql(o.name("k")))
def by_author_bucket(spark, sf):
    return buckets.by_author(t.history(spark, sf))


@query(
    "month_language",
    f"{o.with_(o.COMMITS, o.CHANGES)} SELECT month AS label, language, {o.LINES}, count(*) AS files "
    "FROM c JOIN f USING (commit_id) GROUP BY 1, 2",
)
def month_language(spark, sf):
    return buckets.bucket_languages(t.history(spark, sf), by_month())


@query("totals", o.totals_sql())
def totals(spark, sf):
    return buckets.totals(t.history(spark, sf))


@query(
    "totals_with_buckets",
    o.bucket_sql("repo").replace(" AS label,", " AS label, false AS is_total,").replace("GROUP BY 1", "GROUP BY repo")
    + f" UNION ALL SELECT 'Total', true, count(*), {o.LINES}, {o.sums(files='files')} FROM c LEFT JOIN fc USING (commit_id)",
)
def totals_with_buckets(spark, sf):
    return buckets.add_total(buckets.by_repo(t.history(spark, sf)))


_TREE = f"""{o.with_(o.COMMITS, o.CHANGES, o.PER_COMMIT)},
node AS (SELECT @one, @two, grouping(@one) + grouping(@two) AS g, count(*) AS commits, {o.LINES},
         {o.sums(files='files')} FROM (SELECT *, {o.name('k')} AS author FROM c) c
         LEFT JOIN fc USING (commit_id) GROUP BY ROLLUP (@one, @two))
SELECT CAST(2 - g AS INTEGER) AS depth,
       CASE g WHEN 2 THEN '' WHEN 1 THEN @one ELSE @one || '>' || @two END AS path,
       CASE g WHEN 2 THEN 'Total' WHEN 1 THEN @one ELSE @two END AS label,
       commits, additions, deletions, net_modifications, net_additions, files FROM node"""


def _tree_sql(one: str, two: str) -> str:
    return _TREE.replace("@one", one).replace("@two", two)


def _flat(tree: DataFrame) -> DataFrame:
    return tree.withColumn("path", F.array_join("path", ">"))


@query("tree_repo_month", _tree_sql("repo", "month"))
def tree_repo_month(spark, sf):
    return _flat(buckets.group_tree(t.history(spark, sf), ["repo", "period"]))


@query("tree_repo_author", _tree_sql("repo", "author"))
def tree_repo_author(spark, sf):
    return _flat(buckets.group_tree(t.history(spark, sf), ["repo", "author", "language"]))


@query(
    "tree_languages",
    f"""{o.with_(o.COMMITS, o.CHANGES)},
node AS (SELECT repo, month, language, grouping(repo) + grouping(month) AS g, {o.LINES}, count(*) AS files
  FROM c JOIN f USING (commit_id)
  GROUP BY GROUPING SETS ((repo, month, language), (repo, language), (language)))
SELECT CAST(2 - g AS INTEGER) AS depth,
       CASE g WHEN 2 THEN '' WHEN 1 THEN repo ELSE repo || '>' || month END AS path,
       CASE g WHEN 2 THEN 'Total' WHEN 1 THEN repo ELSE month END AS label,
       language, additions, deletions, net_modifications, net_additions, files FROM node""",
)
def tree_languages(spark, sf):
    return _flat(buckets.tree_languages(t.history(spark, sf), ["repo", "period"]))


@query(
    "effective_levels",
    f"""{o.with_(o.COMMITS)}
SELECT CAST(0 AS INTEGER) AS position, 'repo' AS level, count(DISTINCT repo) > 1 AS kept FROM c
UNION ALL SELECT 1, 'author', count(DISTINCT k) > 1 FROM c
UNION ALL SELECT 2, 'period', count(DISTINCT month) > 1 FROM c
UNION ALL SELECT 3, 'language', true""",
)
def effective_levels(spark, sf):
    return buckets.level_choice(t.history(spark, sf), ["repo", "author", "period", "language"])


# ---- people -------------------------------------------------------------------------

_ROLE_SUMS = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN {test} THEN {c} END), 0) AS BIGINT) AS {prefix}{alias}"
    for alias, c in (("additions", "a"), ("deletions", "d"), ("net_modifications", "nm"), ("net_additions", "na"))
    for prefix, test in (("", "NOT co"), ("co_authored_", "co"))
)


def _people_sql(keys: str) -> str:
    return f"""{o.with_(o.COMMITS, o.ROLES, o.CHANGES, o.PER_COMMIT)}
SELECT {keys} {o.name('p')} AS person, count(*) FILTER (WHERE NOT co) AS commits,
       count(*) FILTER (WHERE co) AS co_authored_commits, {_ROLE_SUMS}
FROM who LEFT JOIN fc USING (commit_id) GROUP BY ALL"""


@query("person_totals", _people_sql(""))
def person_totals(spark, sf):
    return people.bucket_people(t.history(spark, sf), {})


@query("month_people", _people_sql("month AS label,"))
def month_people(spark, sf):
    return people.bucket_people(t.history(spark, sf), by_month())


_CO_SUMS = ", ".join(
    f"CAST(coalesce(sum(CASE WHEN co THEN {c} END), 0) AS BIGINT) AS co_authored_{alias}"
    for alias, c in (
        ("additions", "a"),
        ("deletions", "d"),
        ("net_modifications", "nm"),
        ("net_additions", "na"),
        ("files", "1"),
    )
)


def _person_language_sql(keys: str) -> str:
    return f"""{o.with_(o.COMMITS, o.ROLES, o.CHANGES)}
SELECT {keys} {o.name('p')} AS person, language, {o.LINES}, count(*) AS files, {_CO_SUMS}
FROM who JOIN f USING (commit_id) GROUP BY ALL"""


@query("person_language", _person_language_sql(""))
def person_language(spark, sf):
    return people.bucket_person_languages(t.history(spark, sf), {})


@query("month_person_language", _person_language_sql("month AS label,"))
def month_person_language(spark, sf):
    return people.bucket_person_languages(t.history(spark, sf), by_month())


def _merged_sql(key: str) -> str:
    """Merged people with their languages; ``key`` names the group of customer p."""
    login = f"CASE WHEN {o.KNOWN} THEN {o.LOGIN} ELSE {o.name('p')} END"
    group = login if key == "remote" else o.name("p")
    return f"""{o.with_(o.COMMITS, o.ROLES, o.CHANGES, o.PER_COMMIT)},
g AS (SELECT *, {group} AS merge_key FROM who),
heads AS (SELECT merge_key, min({o.name('p')}) AS name, count(*) FILTER (WHERE NOT co) AS commits,
    count(*) FILTER (WHERE co) AS co_commits, CAST(coalesce(sum(a), 0) AS BIGINT) AS adds,
    CAST(coalesce(sum(d), 0) AS BIGINT) AS dels, CAST(coalesce(sum(files), 0) AS BIGINT) AS files
  FROM g LEFT JOIN fc USING (commit_id) GROUP BY 1),
langs AS (SELECT merge_key, language, CAST(sum(a) AS BIGINT) AS adds, CAST(sum(d) AS BIGINT) AS dels, count(*) AS files
  FROM g JOIN f USING (commit_id) GROUP BY 1, 2),
best AS (SELECT merge_key, language AS top, count(*) OVER (PARTITION BY merge_key) AS n,
    row_number() OVER (PARTITION BY merge_key ORDER BY adds DESC, language) AS rn FROM langs)"""


@query(
    "author_totals",
    _merged_sql("remote")
    + """ SELECT h.merge_key, name, commits, co_commits, adds, dels, files,
       coalesce(top, '') AS top_language, coalesce(n, 0) AS n_languages
FROM heads h LEFT JOIN best b ON b.merge_key = h.merge_key AND rn = 1""",
)
def author_totals(spark, sf):
    merged = people.merged_activity(t.history(spark, sf), "remote", t.identity(spark, sf))
    return people.author_totals(merged).select(
        "merge_key",
        "name",
        "commits",
        F.col("co_authored_commits").alias("co_commits"),
        (F.col("additions") + F.col("co_authored_additions")).alias("adds"),
        (F.col("deletions") + F.col("co_authored_deletions")).alias("dels"),
        "files",
        "top_language",
        "n_languages",
    )


@query(
    "author_emails",
    f"""{o.with_(o.COMMITS, o.ROLES)} SELECT DISTINCT CASE WHEN {o.KNOWN} THEN {o.LOGIN} ELSE {o.name('p')} END AS merge_key,
  {o.email('p')} AS email FROM who""",
)
def author_emails(spark, sf):
    return people.people_emails(t.history(spark, sf), "remote", t.identity(spark, sf))


@query(
    "author_report_emails",
    f"""{o.with_(o.COMMITS, o.ROLES)}, g AS (SELECT CASE WHEN {o.KNOWN} THEN {o.LOGIN} ELSE {o.name('p')} END AS merge_key, * FROM who)
SELECT merge_key, min({o.name('p')}) || ' ' || string_agg(DISTINCT '<' || {o.email('p')} || '>', ', ' ORDER BY '<' || {o.email('p')} || '>') AS label, count(*) AS commits
FROM g GROUP BY 1""",
)
def author_report_emails(spark, sf):
    report = reports.author_report(t.history(spark, sf), "remote", t.identity(spark, sf), email="full")
    return report.filter("kind = 'author'").select("merge_key", "label", "commits")


@query(
    "author_email_rows",
    f"""{o.with_(o.COMMITS, o.ROLES)}, g AS (SELECT CASE WHEN {o.KNOWN} THEN {o.LOGIN} ELSE {o.name('p')} END AS merge_key, * FROM who)
SELECT DISTINCT merge_key, '<' || {o.email('p')} || '>' AS label FROM g""",
)
def author_email_rows(spark, sf):
    """Each address on a row of its own after its person."""
    report = reports.author_report(t.history(spark, sf), "remote", t.identity(spark, sf), email="rows")
    return report.filter("kind = 'email'").select("merge_key", "label")


@query(
    "author_report",
    _merged_sql("name")
    + """ SELECT h.merge_key, 'author' AS kind, name, name AS label, commits + co_commits AS commits, adds, dels,
       adds - dels AS net, files, coalesce(top, '') AS top_language
FROM heads h LEFT JOIN best b ON b.merge_key = h.merge_key AND rn = 1
UNION ALL SELECT l.merge_key, 'language', h.name, l.language, 0, l.adds, l.dels, l.adds - l.dels, l.files, ''
FROM langs l JOIN heads h ON h.merge_key = l.merge_key
WHERE l.merge_key IN (SELECT merge_key FROM best WHERE n > 1)
UNION ALL SELECT NULL, 'total', NULL, 'Total', (SELECT count(*) FROM c), CAST(sum(a) AS BIGINT), CAST(sum(d) AS BIGINT),
       CAST(sum(a) - sum(d) AS BIGINT), count(*), '' FROM f""",
)
def author_report(spark, sf):
    return reports.author_report(t.history(spark, sf), "name")


@query(
    "author_display",
    f"""{o.with_(o.COMMITS, o.ROLES)}, pp AS (SELECT DISTINCT p FROM who)
SELECT {o.name('p')} AS name, {o.name('p')} || ' <' || CASE p % 4
  WHEN 1 THEN '...+customer' || lpad(CAST(p AS VARCHAR), 9, '0') || '@[github email]'
  WHEN 2 THEN 'customer' || lpad(CAST(p AS VARCHAR), 9, '0') || '@[github email]'
  ELSE {o.email('p')} END || '>' AS shown FROM pp""",
)
def author_display(spark, sf):
    found = people.distinct_people(t.commits(spark, sf))
    line = text.person_text(F.struct("name", "email"))
    person = text.split_person(line)
    shown = display.author_display(person["name"], F.array(person["email"]), "simple")
    return found.select(person["name"].alias("name"), shown.alias("shown"))


# ---- filters ------------------------------------------------------------------------


@query("window_filter", o.bucket_sql("month", "ts >= TIMESTAMP '1996-03-01' AND ts <= TIMESTAMP '1997-02-15'"))
def window_filter(spark, sf):
    return buckets.by_period(t.history(spark, sf).between("1996-03-01", "1997-02-15"))


@query("last_days", o.bucket_sql("repo", "ts >= TIMESTAMP '2001-08-01' - INTERVAL 7819200 SECOND"))
def last_days(spark, sf):
    return buckets.by_repo(t.history(spark, sf).last_days(90.5, "2001-08-01"))


_INVOLVED = f"commit_id IN (SELECT commit_id FROM who WHERE contains(lower({o.name('p')}), '%s'))"


def _who(sql_text: str) -> str:
    return sql_text.replace(o.COMMITS, o.COMMITS + "," + o.ROLES)


@query(
    "involves_person",
    _who(
        o.bucket_sql(
            "repo",
            f"commit_id IN (SELECT commit_id FROM who WHERE contains(lower({o.name('p')}), 'r000000012') "
            f"OR contains(lower({o.email('p')}), 'r000000012'))",
        )
    ),
)
def involves_person(spark, sf):
    return buckets.by_repo(t.history(spark, sf).involving("R000000012"))


@query("only_language", o.bucket_sql("month", lines_where="language = 'Other'"))
def only_language(spark, sf):
    return buckets.by_period(t.history(spark, sf).only_language("oTHER"))


@query("exclude_languages", o.bucket_sql("month", lines_where="language NOT IN ('Rust', 'CSS')"))
def exclude_languages(spark, sf):
    return buckets.by_period(t.history(spark, sf).exclude_languages(["rUsT", "css"]))


@query(
    "exclude_languages_tree",
    _tree_sql("repo", "month").replace("FROM f GROUP BY commit_id", "FROM f WHERE language NOT IN ('Other', 'Go') GROUP BY commit_id"),
)
def exclude_languages_tree(spark, sf):
    h = t.history(spark, sf).exclude_languages(["other", "GO"])
    return _flat(buckets.group_tree(h, ["repo", "period"]))


@query("me_name", _who(o.totals_sql(_INVOLVED % "#00000001")))
def me_name(spark, sf):
    return buckets.totals(t.history(spark, sf).where(identity.me_name("#00000001")))


@query("me_email", _who(o.totals_sql(f"commit_id IN (SELECT commit_id FROM who WHERE contains(lower({o.email('p')}), '@mail.'))")))
def me_email(spark, sf):
    return buckets.totals(t.history(spark, sf).where(identity.me_email("@mail.")))


_IS_DEV = (
    f"commit_id IN (SELECT commit_id FROM who WHERE ({o.KNOWN} AND {o.LOGIN} = 'Dev000000012') "
    f"OR lower({o.email('p')}) LIKE '%dev000000012@users.noreply.github.com')"
)
_IS_70 = "commit_id IN (SELECT commit_id FROM who WHERE p = 70)"


@query("me_login", _who(o.totals_sql(_IS_DEV)))
def me_login(spark, sf):
    h = t.history(spark, sf)
    marked = people.mark_login(h.commits, t.identity(spark, sf), "DEV000000012")
    return buckets.totals(type(h)(marked, h.file_changes).where("is_login"))


@query("me_login_joined", _who(o.totals_sql(_IS_DEV)))
def me_login_joined(spark, sf):
    """As ``me_login``, with the flag negated twice: it is never NULL."""
    h = t.history(spark, sf)
    marked = people.mark_login(h.commits, t.identity(spark, sf), "DEV000000012")
    return buckets.totals(type(h)(marked, h.file_changes).where("NOT (NOT is_login)"))


@query(
    "me_combined",
    _who(
        o.totals_sql(
            f"({_IS_70}) OR ({_INVOLVED % '00011'} AND commit_id IN (SELECT commit_id FROM who "
            f"WHERE contains(lower({o.email('p')}), 'corp.example')))"
        )
    ),
)
def me_combined(spark, sf):
    login = identity.me_noreply("Customer000000070")
    return buckets.totals(
        t.history(spark, sf).where(login | identity.me_name("00011") & identity.me_email("corp.example"))
    )


@query(
    "sql_functions",
    _who(o.bucket_sql("printf('%d-W%02d', isoyear(ts), week(ts))", f"({_IS_70}) OR {_INVOLVED % '00011'}")).replace(
        f"{o.LINES}, {o.sums(files='files')}", "CAST(coalesce(sum(nm), 0) AS BIGINT) AS net_modifications"
    ),
)
def sql_functions(spark, sf):
    sql.register(spark)
    h = t.history(spark, sf)
    mine = "me_noreply('customer000000070', author, co_authors) OR me_name('00011', author, co_authors)"
    lines = h.file_changes.selectExpr("commit_id", "net_modifications(additions, deletions) AS nm")
    lines = lines.groupBy("commit_id").agg(F.sum("nm").alias("nm"))
    kept = h.commits.filter(mine).selectExpr("commit_id", "iso_week(ts) AS label")
    return (
        kept.join(lines, "commit_id", "left")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("commits"), F.coalesce(F.sum("nm"), F.lit(0)).cast("bigint").alias("net_modifications"))
    )


@query("committer_filter", o.bucket_sql("month", "status = 'F'"))
def committer_filter(spark, sf):
    return buckets.by_period(t.history(spark, sf).by_committer("merge BOT"))


@query("repo_filter", o.bucket_sql("month", "repo IN ('NATION_3', 'NATION_11')"))
def repo_filter(spark, sf):
    return buckets.by_period(t.history(spark, sf).in_repos(["NATION_3", "NATION_11"]))


@query(
    "defaults",
    """SELECT CASE WHEN o_custkey % 10 = 0 THEN 'Unknown' ELSE 'given' END AS name,
  CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE 1 END AS has_email,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'm' END AS message, count(*) AS commits FROM orders GROUP BY ALL""",
)
def defaults(spark, sf):
    orders = t.table(spark, sf, "orders")
    name = F.when(F.col("o_custkey") % 10 != 0, F.lit("given"))
    email = F.when(F.col("o_custkey") % 7 != 0, F.lit("a@b"))
    who = F.struct(name.alias("name"), email.alias("email"))
    rows = orders.select(
        who.alias("author"), who.alias("committer"), F.when(F.col("o_orderkey") % 5 != 0, F.lit("m")).alias("message")
    )
    filled = filters.with_defaults(rows)
    return filled.groupBy(
        F.col("author.name").alias("name"), (F.col("committer.email") != "").cast("int").alias("has_email"), "message"
    ).agg(F.count(F.lit(1)).alias("commits"))


# ---- scalars ------------------------------------------------------------------------

_MESSAGE_PEOPLE = f"{o.with_(o.COMMITS, o.ROLES)} SELECT {o.name('p')} AS name, {o.email('p')} AS email, count(*) AS commits FROM who WHERE co GROUP BY 1, 2"


@query("coauthors_from_message", _MESSAGE_PEOPLE)
def coauthors_from_message(spark, sf):
    found = t.commits(spark, sf).select(F.explode(text.co_authors(F.col("message"))).alias("p"))
    return found.groupBy(F.col("p.name").alias("name"), F.col("p.email").alias("email")).agg(
        F.count(F.lit(1)).alias("commits")
    )


@query(
    "message_subject",
    "SELECT o_orderkey AS commit_id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS message_subject FROM orders",
)
def message_subject(spark, sf):
    return t.commits(spark, sf).select("commit_id", "message_subject")


_EXT_LANGUAGE = """CASE ext WHEN 'Makefile' THEN 'Makefile' WHEN 'rs' THEN 'Rust' WHEN 'py' THEN 'Python'
  WHEN 'js' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript' WHEN 'css' THEN 'CSS' WHEN 'md' THEN 'Markdown'
  WHEN 'go' THEN 'Go' END"""


@query("path_language", f"{o.with_(o.PATHS)} SELECT {_EXT_LANGUAGE} AS language, count(*) AS files FROM paths GROUP BY 1")
def path_language(spark, sf):
    typed = languages.with_language(t.file_changes(spark, sf))
    return typed.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


_URLS = ("https://github.com/o{k}/r{k}.git", "git@gitlab.com:o{k}/r{k}", "http://gitlab.com/o{k}/r{k}/",
         "https://example.org/o{k}/r{k}", "https://github.com/o{k}", "git@github.com:o{k}/r{k}.git/")


@query(
    "remote_url_parts",
    """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' WHEN 2 THEN 'gitlab' WHEN 5 THEN 'github' END AS platform,
  CASE WHEN s_suppkey % 6 IN (0, 1, 2, 5) THEN 'o' || s_suppkey END AS owner,
  CASE WHEN s_suppkey % 6 IN (0, 1, 2, 5) THEN 'r' || s_suppkey END AS repo FROM supplier""",
)
def remote_url_parts(spark, sf):
    key = F.col("s_suppkey")
    forms = F.array(*[F.replace(F.lit(u), F.lit("{k}"), key.cast("string")) for u in _URLS])
    parts = text.remote_url_parts(F.get(forms, (key % 6).cast("int")))
    return t.table(spark, sf, "supplier").select("s_suppkey", parts.alias("p")).select("s_suppkey", "p.*")


@query(
    "noreply_login",
    f"""{o.with_(o.COMMITS, o.ROLES)}, pp AS (SELECT DISTINCT p FROM who)
SELECT {o.email('p')} AS email,
  CASE WHEN p % 4 IN (1, 2) THEN 'customer' || lpad(CAST(p AS VARCHAR), 9, '0') END AS strict,
  CASE WHEN p % 4 IN (1, 2) THEN 'customer' || lpad(CAST(p AS VARCHAR), 9, '0') END AS loose FROM pp""",
)
def noreply_login(spark, sf):
    email = F.col("email")
    return people.distinct_emails(t.commits(spark, sf)).select(
        "email",
        identity.noreply_login(email).alias("strict"),
        identity.noreply_login_loose(email).alias("loose"),
    )


@query(
    "number_formats",
    """SELECT o_orderkey, CAST(n AS VARCHAR) AS plain, format('{:,}', n) AS separated,
  CASE WHEN n >= 1000000 THEN printf('%.1fM', CAST(n AS DOUBLE) / 1000000::DOUBLE)
       WHEN n >= 1000 THEN printf('%.1fk', CAST(n AS DOUBLE) / 1000::DOUBLE) ELSE CAST(n AS VARCHAR) END AS short
FROM (SELECT o_orderkey, o_orderkey * o_orderkey + o_orderkey * 50 AS n FROM orders)""",
)
def number_formats(spark, sf):
    key = F.col("o_orderkey")
    n = key * key + key * 50
    return t.table(spark, sf, "orders").select(
        key, *[display.format_number(n, s).alias(s) for s in ("plain", "separated", "short")]
    )


@query(
    "display_cells",
    f"""{o.with_(o.CHANGES)}, s AS (SELECT commit_id, CAST(sum(a) AS BIGINT) AS a, CAST(sum(d) AS BIGINT) AS d FROM f GROUP BY 1)
SELECT commit_id, '+' || a || ' -' || d AS changes, CASE WHEN a >= d THEN '+' || (a - d) ELSE '-' || (d - a) END AS net,
  'src/x (+' || a || '/-' || d || ')' AS shown, printf('%.1f', CAST(a AS DOUBLE) / CAST(a + d AS DOUBLE) * 100::DOUBLE) AS pct FROM s""",
)
def display_cells(spark, sf):
    a, d = F.col("a"), F.col("d")
    sums = t.file_changes(spark, sf).groupBy("commit_id").agg(F.sum("additions").alias("a"), F.sum("deletions").alias("d"))
    share = a.cast("double") / (a + d).cast("double") * F.lit(100.0)
    return sums.select(
        "commit_id",
        display.change_cell(a, d).alias("changes"),
        display.net_text(a, d).alias("net"),
        text.change_text(F.lit("src/x"), a, d).alias("shown"),
        display.percent_text(share).alias("pct"),
    )


@query(
    "lookback_windows",
    """WITH b AS (SELECT c_custkey, TIMESTAMP '1996-01-01' + to_days(CAST(c_custkey % 3000 AS INTEGER)) AS s, TIMESTAMP '2001-08-01' AS e FROM customer),
n AS (SELECT c_custkey, s, e, unnest(range(0, 20)) AS i FROM b)
SELECT c_custkey, strftime(s + to_days(CAST(365 * i AS INTEGER)), '%Y-%m-%d %H:%M') AS window_start,
  strftime(least(s + to_days(CAST(365 * (i + 1) AS INTEGER)), e), '%Y-%m-%d %H:%M') AS window_end
FROM n WHERE s < e AND s + to_days(CAST(365 * i AS INTEGER)) < e
UNION ALL SELECT c_custkey, '2001-07-31 23:59', '2001-08-01 00:00' FROM b WHERE s >= e""",
)
def lookback_windows(spark, sf):
    start = F.timestamp_add("DAY", (F.col("c_custkey") % 3000).cast("int"), F.lit("1996-01-01").cast("timestamp"))
    end = timeparts.window_end(timeparts.parse_day("2001-08-01"), timeparts.parse_day("2026-01-01"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return (
        t.table(spark, sf, "customer")
        .select("c_custkey", F.inline(timeparts.lookback_windows(start, end)))
        .select("c_custkey", shown("window_start"), shown("window_end"))
    )


@query(
    "parsed_days",
    "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, "
    "strftime(o_orderdate, '%Y') AS since, count(*) AS commits FROM orders GROUP BY ALL",
)
def parsed_days(spark, sf):
    label = timeparts.day_label(F.col("o_orderdate"))
    parsed = timeparts.parse_day(label)
    return (
        t.table(spark, sf, "orders")
        .select(
            day(parsed).alias("day"),
            day(timeparts.week_start(parsed)).alias("monday"),
            timeparts.member_since(label).alias("since"),
        )
        .groupBy("day", "monday", "since")
        .agg(F.count(F.lit(1)).alias("commits"))
    )


# ---- joins and lists ----------------------------------------------------------------


@query(
    "identity_join",
    f"""{o.with_(o.COMMITS, o.ROLES)}, pp AS (SELECT DISTINCT p FROM who)
SELECT {o.email('p')} AS email, {o.name('p')} AS name,
  CASE WHEN {o.KNOWN} THEN {o.LOGIN}
       WHEN p % 4 IN (1, 2) THEN 'customer' || lpad(CAST(p AS VARCHAR), 9, '0') END AS login FROM pp""",
)
def identity_join(spark, sf):
    found = people.distinct_people(t.commits(spark, sf))
    return people.identity_join(found, t.identity(spark, sf)).select("email", "name", "login")


@query("distinct_emails", f"{o.with_(o.COMMITS, o.ROLES)} SELECT DISTINCT {o.email('p')} AS email FROM who")
def distinct_emails(spark, sf):
    return people.distinct_emails(t.commits(spark, sf))


@query(
    "inactive_repos",
    """SELECT c_name AS repo FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-07-01')""",
)
def inactive_repos(spark, sf):
    """Here every customer owns a repository."""
    listed = t.table(spark, sf, "customer").select(F.col("c_name").alias("repo"))
    commits = t.commits(spark, sf).withColumn("repo", F.col("author.name"))
    return remote.inactive_repos(listed, filters.in_window(commits, "1996-01-01", "1996-07-01"))


@query(
    "private_repo_merge",
    """SELECT 'acme/' || lower(s_name) AS repo_key, CASE WHEN s_acctbal >= 3000 THEN CAST(3 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS commit_count
FROM supplier WHERE s_acctbal >= 3000 OR (s_acctbal < 5000 AND s_nationkey <> 3)""",
)
def private_repo_merge(spark, sf):
    every = t.supplier_repos(spark, sf)
    listed = every.filter("balance >= 3000").drop("balance").withColumn("commit_count", F.lit(3).cast("bigint"))
    private = every.filter("balance < 5000").drop("balance").withColumn("name", F.upper("name"))
    merged = remote.add_private(listed, private)
    return merged.select(identity.repo_key(F.col("owner"), F.col("name")).alias("repo_key"), "commit_count")


@query(
    "owned_repos",
    """SELECT DISTINCT 'ACME/' || p_brand AS repo FROM part
WHERE CAST(substr(p_brand, 7) AS INTEGER) % 5 <> 0 AND CAST(substr(p_brand, 7) AS INTEGER) % 2 = 0""",
)
def owned_repos(spark, sf):
    number = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    rows = t.repos(spark, sf).withColumn("owner", F.when(number % 2 == 0, F.lit("ACME")).otherwise(F.lit("other")))
    mine = filters.owned_by(filters.drop_forks(rows), "Acme").orderBy(*ranking.repo_order())
    return mine.select(F.concat_ws("/", "owner", "name").alias("repo"))


@query("nested_repo_roots", "SELECT '/srv/n' || s_nationkey || '/s' || s_suppkey AS path FROM supplier")
def nested_repo_roots(spark, sf):
    return paths.discover_repos(t.inventory(spark, sf))


@query(
    "repo_list",
    """SELECT row_number() OVER (ORDER BY path) AS number, path
FROM (SELECT '/srv/n' || s_nationkey || '/s' || s_suppkey AS path FROM supplier)""",
)
def repo_list(spark, sf):
    return reports.repo_report(paths.discover_repos(t.inventory(spark, sf)))


# ---- hosted repositories ------------------------------------------------------------


def _shown_map(column: str) -> Column:
    entries = F.transform(remote.language_shares(F.col(column)), lambda e: F.concat_ws("=", e["language"], e["bytes"].cast("string")))
    return F.array_join(entries, ",").alias(column)


_CHUNKS = """
chunk AS (
  SELECT year(o_orderdate) AS y, 'acme' AS owner, CASE WHEN o_orderkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS name,
         count(*) AS n FROM orders JOIN nation ON n_nationkey = o_custkey % 25 GROUP BY ALL)"""


def _chunks(spark, sf) -> DataFrame:
    """Contribution windows by year; those before 1997 carry no languages."""
    orders = t.table(spark, sf, "orders").withColumn("n_nationkey", (F.col("o_custkey") % 25).cast("int"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name"))
    counted = (
        orders.join(t.table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey")
        .groupBy(F.date_trunc("year", "o_orderdate").alias("window_start"), F.lit("acme").alias("owner"), name.alias("name"))
        .agg(F.count(F.lit(1)).alias("commit_count"))
    )
    known = F.create_map(F.lit("Rust"), F.col("commit_count"), F.lit("Go"), F.year("window_start").cast("bigint"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return counted.withColumns(
        {"is_fork": F.lit(False), "languages": F.when(F.year("window_start") >= 1997, known).otherwise(none)}
    )


@query(
    "merge_windows",
    f"""{o.with_(_CHUNKS)},
first AS (SELECT lower(name) AS key, name, row_number() OVER (PARTITION BY lower(name) ORDER BY y, name) AS rn FROM chunk),
lang AS (SELECT lower(name) AS key, n, y, row_number() OVER (PARTITION BY lower(name) ORDER BY y, name) AS rn FROM chunk WHERE y >= 1997),
s AS (SELECT lower(name) AS key, CAST(sum(n) AS BIGINT) AS commit_count FROM chunk GROUP BY 1)
SELECT 'acme/' || s.key AS repo_key, 'acme' AS owner, f.name, false AS is_fork,
       coalesce('Go=' || l.y || ',Rust=' || l.n, '') AS languages, s.commit_count
FROM s JOIN first f ON f.key = s.key AND f.rn = 1 LEFT JOIN lang l ON l.key = s.key AND l.rn = 1""",
)
def merge_windows(spark, sf):
    merged = remote.merge_windows(_chunks(spark, sf))
    return merged.select("repo_key", "owner", "name", "is_fork", _shown_map("languages"), "commit_count")


@query(
    "summary_sums",
    "SELECT CAST(sum(o_custkey) AS BIGINT) AS total_prs, CAST(sum(o_orderkey % 7) AS BIGINT) AS total_reviews, "
    "count(*) AS total_issues FROM orders",
)
def summary_sums(spark, sf):
    pages = t.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("total_prs"),
        (F.col("o_orderkey") % 7).alias("total_reviews"),
        F.lit(1).cast("bigint").alias("total_issues"),
    )
    return remote.summary(pages)


@query(
    "language_bytes",
    """SELECT 'acme' AS owner, p_brand AS name,
  string_agg(p_type || '=' || bytes, ',' ORDER BY p_type) AS languages
FROM (SELECT p_brand, p_type, CAST(sum(CASE WHEN p_brand = 'Brand#7' THEN 0 ELSE p_size END) AS BIGINT) AS bytes FROM part GROUP BY ALL)
GROUP BY ALL""",
)
def language_bytes(spark, sf):
    return t.repos(spark, sf).select("owner", "name", _shown_map("languages"))


_WEEKLY = "strftime(week, '%Y-%m-%d') AS week_start"


@query(
    "weekly_buckets",
    f"{o.with_(o.HISTORY, o.WEEKS)} SELECT repo, {_WEEKLY}, adds, dels, commits, net_mods, net_adds FROM w",
)
def weekly_buckets(spark, sf):
    return remote.weekly_buckets(t.hosted_history(spark, sf)).withColumn("week_start", day("week_start"))


def _contributed(spark, sf) -> DataFrame:
    """Listed repositories with their weeks, the join that every remote statistic starts from."""
    weekly = remote.weekly_buckets(t.hosted_history(spark, sf))
    return remote.contributions(t.repos(spark, sf), weekly)


@query(
    "apportion_languages",
    f"{o.with_(o.HISTORY, o.WEEKS, o.REPO_LANGUAGES, o.apportioned('w', 'repo, week'))} "
    f"SELECT repo, {_WEEKLY}, language, CAST(adds AS BIGINT) AS additions, CAST(dels AS BIGINT) AS deletions, "
    "CAST(net_mods AS BIGINT) AS net_modifications, CAST(net_adds AS BIGINT) AS net_additions FROM split",
)
def apportion_languages(spark, sf):
    return remote.week_languages(_contributed(spark, sf)).select(
        "repo", day("week_start").alias("week_start"), "language",
        "additions", "deletions", "net_modifications", "net_additions",
    )


_REMOTE_SUMS = o.sums(additions="adds", deletions="dels", net_modifications="net_mods", net_additions="net_adds")
_LISTED = "w WHERE repo IN (SELECT 'acme/' || p_brand FROM part)"


@query(
    "remote_by_period",
    f"{o.with_(o.HISTORY, o.WEEKS)} SELECT strftime(week, '%Y-%m') AS label, {o.sums(commits='commits')}, {_REMOTE_SUMS} FROM {_LISTED} GROUP BY 1",
)
def remote_by_period(spark, sf):
    return remote.remote_by_period(_contributed(spark, sf))


@query(
    "remote_period_languages",
    f"{o.with_(o.HISTORY, o.WEEKS, o.REPO_LANGUAGES, o.apportioned('w', 'repo, week'))} "
    f"SELECT printf('%d-W%02d', isoyear(week), week(week)) AS label, language, {_REMOTE_SUMS}, count(*) AS files FROM split GROUP BY 1, 2",
)
def remote_period_languages(spark, sf):
    return remote.remote_period_languages(_contributed(spark, sf), "week")


@query(
    "remote_by_repo",
    f"{o.with_(o.HISTORY, o.WEEKS)}, r AS (SELECT DISTINCT 'acme/' || p_brand AS repo FROM part) "
    f"SELECT repo AS label, {o.sums(commits='commits')}, {_REMOTE_SUMS} FROM r LEFT JOIN w USING (repo) GROUP BY 1",
)
def remote_by_repo(spark, sf):
    return remote.remote_by_repo(_contributed(spark, sf)).orderBy(*ranking.remote_repo_order())


@query(
    "remote_repo_languages",
    f"{o.with_(o.HISTORY, o.WEEKS, o.REPO_LANGUAGES, o.apportioned('w', 'repo, week'))} "
    f"SELECT repo AS label, language, {_REMOTE_SUMS}, count(*) AS files FROM split GROUP BY 1, 2",
)
def remote_repo_languages(spark, sf):
    return remote.remote_repo_languages(_contributed(spark, sf))


@query(
    "repo_contributions",
    f"""{o.with_(o.HISTORY, o.WEEKS)}, r AS (SELECT DISTINCT 'acme/' || p_brand AS repo, CAST(0 AS BIGINT) AS n FROM part
  UNION ALL SELECT 'acme/' || s_name, CASE WHEN s_acctbal < 1000 THEN 2 ELSE 0 END FROM supplier)
SELECT repo, n AS commits, {o.sums(adds='adds', dels='dels')} FROM r LEFT JOIN w USING (repo)
GROUP BY repo, n HAVING n > 0 OR coalesce(sum(adds), 0) > 0 OR coalesce(sum(dels), 0) > 0""",
)
def repo_contributions(spark, sf):
    """Brands have history; suppliers have none, and a commit count only for some."""
    brands = t.repos(spark, sf).withColumn("commit_count", F.lit(0).cast("bigint"))
    few = F.when(F.col("balance") < 1000, 2).otherwise(0).cast("bigint")
    others = t.supplier_repos(spark, sf).withColumn("commit_count", few).drop("balance")
    weekly = remote.weekly_buckets(t.hosted_history(spark, sf))
    return remote.repo_line_totals(brands.unionByName(others), weekly).select("repo", "commits", "adds", "dels")


def _merged_chunks(spark, sf) -> DataFrame:
    """Contribution windows of the brands, in two halves that have to be merged."""
    half = t.repos(spark, sf).withColumns({"commit_count": F.lit(1).cast("bigint"), "window_start": F.lit("2023-01-01").cast("timestamp")})
    later = half.withColumns({"name": F.upper("name"), "window_start": F.lit("2024-01-01").cast("timestamp")})
    return half.unionByName(later)


_FETCH_RANGE = "moment >= TIMESTAMP '2024-01-04' AND moment <= TIMESTAMP '2024-01-27'"
_FETCHED = f"""{o.with_(o.HISTORY, o.WEEKS.replace('WHERE moment IS NOT NULL', f"WHERE {_FETCH_RANGE} AND CAST(substr(repo, 12) AS INTEGER) % 5 <> 0"), o.REPO_LANGUAGES, o.apportioned('w', 'repo, week'))}"""


@query(
    "fetch_entry",
    f"""{_FETCHED}, t AS (SELECT strftime(week, '%Y-%m-%d') AS label, {o.sums(commits='commits')} FROM w GROUP BY 1)
SELECT t.label, t.commits, {_REMOTE_SUMS} FROM t LEFT JOIN split s ON strftime(s.week, '%Y-%m-%d') = t.label AND language NOT IN ('PROMO', 'Other') GROUP BY 1, 2""",
)
def fetch_entry(spark, sf):
    plan = fetch(
        _merged_chunks(spark, sf), t.stored_history(spark, sf), "ACME",
        since="2024-01-04", until="2024-01-27", group=["period", "repo"], period="day", exclude=["promo", "OTHER"],
    )
    return plan.buckets()


@query(
    "fetch_repo_languages",
    f"{_FETCHED} SELECT repo AS label, language, {_REMOTE_SUMS}, count(*) AS files FROM split GROUP BY 1, 2",
)
def fetch_repo_languages(spark, sf):
    plan = fetch(
        _merged_chunks(spark, sf), t.stored_history(spark, sf), "acme", since="2024-01-04", until="2024-01-27", group=["repo"]
    )
    return plan.languages()


# ---- refresh ------------------------------------------------------------------------

# A second load overlaps the first by five days.
_OLD, _NEW = "moment <= TIMESTAMP '2024-01-20'", "moment >= TIMESTAMP '2024-01-15'"
_RANGE = "moment >= TIMESTAMP '2024-01-05' AND moment <= TIMESTAMP '2024-01-25'"


def _old(history: DataFrame) -> DataFrame:
    return filters.history_in_range(history, until="2024-01-20")


def _new(history: DataFrame) -> DataFrame:
    return filters.history_in_range(history, since="2024-01-15")


@query(
    "history_refresh",
    f"{o.with_(o.HISTORY)} SELECT repo, oid, committed_date, a AS additions, d AS deletions FROM h "
    f"WHERE ({_OLD} AND {_RANGE}) OR {_NEW}",
)
def history_refresh(spark, sf):
    history = t.stored_history(spark, sf)
    plain = ("repo", "oid", "committed_date", "additions", "deletions")
    return refresh.refresh_history(_old(history), _new(history).select(*plain), "2024-01-05", "2024-01-25")


@query("dedup_history", f"{o.with_(o.HISTORY)} SELECT DISTINCT repo, committed_date, a AS additions, d AS deletions FROM h")
def dedup_history(spark, sf):
    history = t.hosted_history(spark, sf).drop("oid")
    return refresh.dedup_history(history.unionByName(history))


@query(
    "history_append",
    f"{o.with_(o.HISTORY)} SELECT repo, strftime(moment, '%Y-%m') AS month, count(*) AS commits, "
    f"{o.sums(additions='a', deletions='d')} FROM h WHERE moment IS NOT NULL AND ({_OLD} OR {_NEW}) GROUP BY ALL",
)
def history_append(spark, sf):
    history, path = t.hosted_history(spark, sf), scratch_path(spark, "history")
    refresh.append_history(spark, path, _old(history))
    refresh.append_history(spark, path, _new(history))
    return (
        spark.read.parquet(path)
        .groupBy("repo", "month")
        .agg(F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    )


_UNTIL = "2024-01-30 22:00:00"


@query(
    "refetch_plan",
    f"""{o.with_(o.HISTORY)}, r AS (SELECT DISTINCT 'acme/' || p_brand AS repo FROM part UNION ALL SELECT 'acme/' || s_name FROM supplier),
m AS (SELECT repo, max(moment) AS mark FROM h WHERE a > 40 AND moment IS NOT NULL GROUP BY 1),
g AS (SELECT DISTINCT repo FROM h WHERE moment >= TIMESTAMP '2024-01-30 20:00:00' AND moment <= TIMESTAMP '{_UNTIL}'),
j AS (SELECT r.repo, mark, g.repo IS NOT NULL AS alive FROM r LEFT JOIN m USING (repo) LEFT JOIN g ON g.repo = r.repo)
SELECT repo, CASE WHEN mark IS NULL OR (mark < TIMESTAMP '{_UNTIL}' AND alive) THEN 'fetch'
  WHEN mark < TIMESTAMP '{_UNTIL}' THEN 'skip' ELSE 'keep' END AS action,
  strftime(CASE WHEN mark IS NULL THEN TIMESTAMP '2023-01-01' WHEN mark < TIMESTAMP '{_UNTIL}' AND alive THEN mark END, '%Y-%m-%d %H:%M:%S') AS fetch_since FROM j""",
)
def refetch_plan(spark, sf):
    """Marks are the last big commits; the gap is the time since 20:00."""
    history = filters.readable_history(t.hosted_history(spark, sf))
    marks = history.filter("additions > 40").select("repo", F.col("committed_at").alias("until"))
    until = F.lit(_UNTIL).cast("timestamp")
    gap = filters.in_window(history, F.lit("2024-01-30 20:00:00").cast("timestamp"), until, on="committed_at")
    named = F.concat_ws("/", "owner", "name").alias("repo")
    repos = t.repos(spark, sf).select(named).unionByName(t.supplier_repos(spark, sf).select(named))
    plan = refresh.plan_refetch(repos, marks, gap, "2023-01-01", until)
    return plan.withColumn("fetch_since", F.date_format("fetch_since", "yyyy-MM-dd HH:mm:ss"))


# ---- rankings, cards, reports -------------------------------------------------------


@query(
    "top_language",
    f"""{o.with_(o.COMMITS, o.CHANGES)}, s AS (SELECT repo, language, sum(a) AS a FROM c JOIN f USING (commit_id) GROUP BY ALL)
SELECT repo AS label, language AS top_language FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY a DESC, language) AS rn FROM s) WHERE rn = 1""",
)
def top_language(spark, sf):
    rows = buckets.bucket_languages(t.history(spark, sf), {"label": buckets.level_key("repo")})
    return ranking.top_language(rows, ["label"])


_SHARE = f"""{o.with_(o.CHANGES)}, s AS (SELECT language, CAST(sum(a) AS BIGINT) AS additions FROM f GROUP BY 1 HAVING sum(a) > 0)"""
_PCT = "CAST(additions AS DOUBLE) / CAST(sum(additions) OVER () AS DOUBLE) * 100::DOUBLE AS share"


@query("language_share", f"{_SHARE} SELECT language, additions, {_PCT} FROM s")
def language_share(spark, sf):
    return ranking.language_share(buckets.bucket_languages(t.history(spark, sf), {}))


@query(
    "card_languages",
    f"""{_SHARE} SELECT language, additions, printf('%.1f', share) AS pct, CASE language WHEN 'Rust' THEN '#dea584' WHEN 'Python' THEN '#3572A5'
  WHEN 'JavaScript' THEN '#f1e05a' WHEN 'TypeScript' THEN '#3178c6' WHEN 'CSS' THEN '#563d7c' WHEN 'Markdown' THEN '#083fa1'
  WHEN 'Go' THEN '#00ADD8' ELSE '#858585' END AS color
FROM (SELECT language, additions, {_PCT} FROM s) ORDER BY additions DESC, language LIMIT 6""",
)
def card_languages(spark, sf):
    bar = cards.card_languages(buckets.bucket_languages(t.history(spark, sf), {}), rows=2)
    return bar.select("language", "additions", display.percent_text(F.col("share")).alias("pct"), "color")


def _card_row(spark, sf) -> DataFrame:
    orders = t.table(spark, sf, "orders")
    summary = remote.summary(
        orders.select(
            (F.col("o_orderkey") % 3).alias("total_prs"),
            (F.col("o_orderkey") % 5).alias("total_reviews"),
            (F.col("o_orderkey") % 2).alias("total_issues"),
        )
    )
    user = orders.agg(F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("created_at"))
    period = remote.remote_by_period(_contributed(spark, sf))
    total = period.agg(*[F.sum(c).alias(c) for c in period.columns if c != "label"])
    return cards.card_row(total, t.repos(spark, sf), summary, user)


_CARD = f"""{o.with_(o.HISTORY, o.WEEKS)}, t AS (SELECT {o.sums(commits='commits')}, {_REMOTE_SUMS} FROM {_LISTED}),
s AS (SELECT CAST(sum(o_orderkey % 3) AS BIGINT) AS prs, CAST(sum(o_orderkey % 5) AS BIGINT) AS reviews,
      CAST(sum(o_orderkey % 2) AS BIGINT) AS issues, strftime(min(o_orderdate), '%Y') AS since FROM orders),
r AS (SELECT count(DISTINCT p_brand) AS repos FROM part)"""


@query(
    "card_figures",
    f"""{_CARD} SELECT CAST(1 AS INTEGER) AS position, 'commits' AS figure, CAST(commits AS VARCHAR) AS value FROM t
UNION ALL SELECT 2, 'repos', CAST(repos AS VARCHAR) FROM r UNION ALL SELECT 3, 'prs', CAST(prs AS VARCHAR) FROM s
UNION ALL SELECT 4, 'additions', '+' || format('{{:,}}', additions) FROM t
UNION ALL SELECT 5, 'deletions', '-' || format('{{:,}}', deletions) FROM t
UNION ALL SELECT 6, 'net_additions', '+' || format('{{:,}}', net_additions) FROM t
UNION ALL SELECT 7, 'reviews', CAST(reviews AS VARCHAR) FROM s UNION ALL SELECT 8, 'issues', CAST(issues AS VARCHAR) FROM s
UNION ALL SELECT 9, 'member_since', since FROM s""",
)
def card_figures(spark, sf):
    return cards.card_figures(_card_row(spark, sf), line_style="separated")


_NOW = "2024-01-30"
_WINDOWED = f"""{o.with_(o.HISTORY, o.REPO_LANGUAGES)},
d AS (SELECT CAST(unnest([7, 14, 1]) AS BIGINT) AS window_days),
wd AS (SELECT window_days, repo, date_trunc('week', moment) AS week, CAST(sum(a) AS BIGINT) AS adds, CAST(sum(d) AS BIGINT) AS dels,
       count(*) AS commits, CAST(sum(greatest(a - d, 0)) AS BIGINT) AS net_adds
  FROM h JOIN d ON moment >= TIMESTAMP '{_NOW}' - to_days(CAST(window_days AS INTEGER)) AND moment <= TIMESTAMP '{_NOW}'
  WHERE repo IN (SELECT repo FROM rl) GROUP BY ALL)"""


_COUNTED = f"""{_WINDOWED},
cw AS (SELECT DISTINCT window_days, repo FROM d, rl WHERE CAST(regexp_extract(repo, '([0-9]+)$', 1) AS INTEGER) % 2 = 0),
active AS (SELECT window_days, count(*) AS repos FROM (SELECT window_days, repo FROM wd UNION SELECT window_days, repo FROM cw) GROUP BY 1),
wsum AS (SELECT window_days, {o.sums(commits='commits', additions='adds', deletions='dels', net_additions='net_adds')} FROM wd GROUP BY 1)"""


def _multi(spark, sf, *exclude: str) -> tuple[DataFrame, DataFrame]:
    """Contribution windows report commits of the repositories with an even number."""
    repos, days = t.repos(spark, sf), [7, 14, 1]
    even = F.regexp_extract("name", "([0-9]+)$", 1).cast("int") % 2 == 0
    windows = F.explode(F.array(*[F.lit(d).cast("bigint") for d in days])).alias("window_days")
    counts = repos.select(windows, "owner", "name", F.when(even, F.lit(3)).otherwise(F.lit(0)).alias("commits"))
    return cards.multi_window(t.stored_history(spark, sf), repos, days, _NOW, counts, exclude)


@query(
    "multi_window",
    f"""{_COUNTED} SELECT window_days, repos, coalesce(commits, 0) AS commits, coalesce(additions, 0) AS additions,
  coalesce(deletions, 0) AS deletions, coalesce(net_additions, 0) AS net_additions FROM active LEFT JOIN wsum USING (window_days)""",
)
def multi_window(spark, sf):
    return _multi(spark, sf)[0]


_EXCLUDED = ("PROMO", "Other")


@query(
    "multi_window_excluded",
    f"""{_COUNTED}, {o.apportioned('wd', 'window_days, repo, week', ('adds', 'dels', 'net_adds'))},
gone AS (SELECT window_days, CAST(sum(adds) AS BIGINT) AS a, CAST(sum(dels) AS BIGINT) AS x, CAST(sum(net_adds) AS BIGINT) AS n
  FROM split WHERE lower(language) IN ({", ".join(f"'{e.lower()}'" for e in _EXCLUDED)}) GROUP BY 1)
SELECT window_days, repos, coalesce(commits, 0) AS commits, coalesce(additions, 0) - coalesce(a, 0) AS additions,
  coalesce(deletions, 0) - coalesce(x, 0) AS deletions, coalesce(net_additions, 0) - coalesce(n, 0) AS net_additions
FROM active LEFT JOIN wsum USING (window_days) LEFT JOIN gone USING (window_days)""",
)
def multi_window_excluded(spark, sf):
    return _multi(spark, sf, *_EXCLUDED)[0]


@query(
    "multi_window_languages",
    f"""{_WINDOWED}, {o.apportioned('wd', 'window_days, repo, week', ('adds', 'dels'))},
s AS (SELECT window_days, language, CAST(sum(adds) AS BIGINT) AS additions FROM split GROUP BY 1, 2 HAVING sum(adds) > 0),
x AS (SELECT *, CAST(additions AS DOUBLE) / CAST(sum(additions) OVER (PARTITION BY window_days) AS DOUBLE) * 100::DOUBLE AS share,
  CAST(row_number() OVER (PARTITION BY window_days ORDER BY additions DESC, language) AS INTEGER) AS rank FROM s)
SELECT window_days, language, additions, printf('%.1f', share) AS pct, rank FROM x WHERE rank <= 3""",
)
def multi_window_languages(spark, sf):
    rows = _multi(spark, sf)[1]
    return rows.select("window_days", "language", "additions", display.percent_text(F.col("share")).alias("pct"), "rank")


_REPORT_LINES = "CAST(sum(a) AS BIGINT) AS adds, CAST(sum(d) AS BIGINT) AS dels, CAST(sum(a) - sum(d) AS BIGINT) AS net, count(*) AS files"


@query(
    "language_report",
    f"""{o.with_(o.CHANGES)} SELECT 'language' AS kind, language AS label, CAST(0 AS BIGINT) AS commits, {_REPORT_LINES} FROM f GROUP BY 2
UNION ALL SELECT 'total', 'Total', (SELECT count(*) FROM orders), {_REPORT_LINES} FROM f""",
)
def language_report(spark, sf):
    return reports.language_report(t.history(spark, sf))


@query(
    "bucket_report",
    f"""{o.with_(o.COMMITS, o.CHANGES, o.PER_COMMIT)}, cl AS (SELECT month, language, a, d FROM c JOIN f USING (commit_id)),
b AS (SELECT month, count(*) AS n, coalesce(sum(a), 0) AS a, coalesce(sum(d), 0) AS d, coalesce(sum(files), 0) AS fl FROM c LEFT JOIN fc USING (commit_id) GROUP BY 1)
SELECT false AS is_total, month AS bucket, 'bucket' AS kind, month AS label, n AS commits, CAST(a AS BIGINT) AS adds, CAST(d AS BIGINT) AS dels, CAST(a - d AS BIGINT) AS net, CAST(fl AS BIGINT) AS files FROM b
UNION ALL SELECT false, month, 'language', language, 0, {_REPORT_LINES} FROM cl GROUP BY month, language
UNION ALL SELECT true, 'Total', 'bucket', 'Total', CAST(sum(n) AS BIGINT), CAST(sum(a) AS BIGINT), CAST(sum(d) AS BIGINT), CAST(sum(a) - sum(d) AS BIGINT), CAST(sum(fl) AS BIGINT) FROM b
UNION ALL SELECT true, 'Total', 'language', language, 0, {_REPORT_LINES} FROM cl GROUP BY language""",
)
def bucket_report(spark, sf):
    return reports.bucket_report(t.history(spark, sf))


@query(
    "tree_report",
    _tree_sql("repo", "month").replace("SELECT CAST(2 - g", "SELECT * FROM (SELECT CAST(2 - g", 1).replace(
        "commits, additions, deletions, net_modifications, net_additions, files FROM node",
        "'node' AS kind, commits, additions AS adds, deletions AS dels, additions - deletions AS net, files FROM node)",
    )
    + f""" UNION ALL BY NAME SELECT CAST(2 AS INTEGER) AS depth, repo || '>' || month AS path, language AS label, 'language' AS kind,
  CAST(0 AS BIGINT) AS commits, {_REPORT_LINES} FROM c JOIN f USING (commit_id) GROUP BY repo, month, language""",
)
def tree_report(spark, sf):
    return _flat(reports.tree_report(t.history(spark, sf), ["repo", "period"]))


@query(
    "stats_entry",
    _who(o.bucket_sql("repo", "ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '2000-01-01' AND "
                      + f"({_INVOLVED % '00001'}) AND commit_id IN (SELECT commit_id FROM who WHERE contains(lower({o.email('p')}), 'corp'))",
                      "language <> 'CSS'")),
)
def stats_entry(spark, sf):
    plan = stats(
        t.history(spark, sf),
        since="1996-01-01",
        until="2000-01-01",
        me=identity.me_name("00001"),
        author="CORP",
        exclude=["css"],
    )
    return plan.buckets()


@query(
    "formatted_report",
    f"""{o.with_(o.CHANGES)}, r AS (SELECT 'language' AS kind, language AS label, {_REPORT_LINES} FROM f GROUP BY 2
UNION ALL SELECT 'total', 'Total', {_REPORT_LINES} FROM f)
SELECT kind, label, CASE WHEN net >= 0 THEN '+' ELSE '-' END || format('{{:,}}', abs(net)) AS net,
  '+' || format('{{:,}}', adds) || ' -' || format('{{:,}}', dels) AS changes, format('{{:,}}', files) AS files FROM r""",
)
def formatted_report(spark, sf):
    columns = filters.metric_columns(["net", "adds", "dels", "files", "net"])
    return reports.formatted(reports.language_report(t.history(spark, sf)), columns)


# ---- documents ----------------------------------------------------------------------

_HEAD_JSON = "STRUCT<total_commits: BIGINT, total_additions: BIGINT, by_language: MAP<STRING, STRUCT<additions: BIGINT>>>"
_PERSON_JSON = (
    "STRUCT<author: STRING, commits: BIGINT, co_authored_additions: BIGINT, "
    "co_authored_languages: MAP<STRING, STRUCT<deletions: BIGINT>>>"
)


@query(
    "stats_document",
    f"""{o.with_(o.COMMITS, o.ROLES, o.CHANGES, o.PER_COMMIT)},
p AS (SELECT month, {o.name('p')} AS person, count(*) FILTER (WHERE NOT co) AS commits,
  CAST(coalesce(sum(CASE WHEN co THEN a END), 0) AS BIGINT) AS co_adds, CAST(coalesce(sum(CASE WHEN co THEN d END), 0) AS BIGINT) AS co_dels
  FROM who LEFT JOIN fc USING (commit_id) GROUP BY 1, 2)
SELECT 'periods' AS section, month AS label, person, commits, co_adds, co_dels FROM p
UNION ALL SELECT 'totals', 'Total', person, CAST(sum(commits) AS BIGINT), CAST(sum(co_adds) AS BIGINT), CAST(sum(co_dels) AS BIGINT) FROM p GROUP BY person""",
)
def stats_document(spark, sf):
    """People read back out of their documents."""
    docs = documents.to_stats_json(t.history(spark, sf), by_month()["label"], few_labels=True).filter("kind = 'person'")
    rows = docs.select("section", "label", F.from_json("json", _PERSON_JSON).alias("s"))
    dels = F.aggregate(F.map_values("s.co_authored_languages"), F.lit(0).cast("bigint"), lambda acc, x: acc + x["deletions"])
    return rows.select(
        "section", "label", F.col("s.author").alias("person"), "s.commits", F.col("s.co_authored_additions").alias("co_adds"), dels.alias("co_dels")
    )


@query(
    "stats_document_heads",
    o.bucket_sql("month").replace("SELECT month AS label", "SELECT 'periods' AS section, month AS label").replace("GROUP BY 1", "GROUP BY month")
    .replace(f"{o.LINES}, {o.sums(files='files')}", "CAST(coalesce(sum(a), 0) AS BIGINT) AS additions, CAST(coalesce(sum(a), 0) AS BIGINT) AS by_language")
    + " UNION ALL SELECT 'totals', 'Total', count(*), CAST(sum(a) AS BIGINT), CAST(sum(a) AS BIGINT) FROM c LEFT JOIN fc USING (commit_id)",
)
def stats_document_heads(spark, sf):
    docs = documents.to_stats_json(t.history(spark, sf), by_month()["label"], few_labels=True).filter("kind = 'head'")
    parsed = docs.select("section", "label", F.from_json("json", _HEAD_JSON).alias("doc"))
    langs = F.aggregate(F.map_values("doc.by_language"), F.lit(0).cast("bigint"), lambda acc, x: acc + x["additions"])
    return parsed.select(
        "section",
        "label",
        F.col("doc.total_commits").alias("commits"),
        F.col("doc.total_additions").alias("additions"),
        langs.alias("by_language"),
    )


@query(
    "scan_document",
    "SELECT '/srv/n' || s_nationkey || '/s' || s_suppkey AS path, (SELECT count(*) FROM supplier) AS count FROM supplier",
)
def scan_document(spark, sf):
    docs = documents.to_scan_json(paths.discover_repos(t.inventory(spark, sf)))
    parsed = docs.select("kind", F.from_json("json", "STRUCT<path: STRING, count: BIGINT>").alias("d"))
    count = parsed.filter("kind = 'head'").select("d.count")
    return parsed.filter("kind = 'repository'").select("d.path", count.scalar().alias("count"))


@query(
    "tree_document",
    _tree_sql("repo", "month").replace("SELECT CAST(2 - g", "SELECT depth, path, label, commits, net_additions, additions AS by_language FROM (SELECT CAST(2 - g", 1) + ")",
)
def tree_document(spark, sf):
    docs = documents.tree_document(t.history(spark, sf), ["repo", "period"])
    schema = "STRUCT<label: STRING, total_commits: BIGINT, total_net_additions: BIGINT, by_language: MAP<STRING, STRUCT<additions: BIGINT>>>"
    parsed = docs.select("depth", F.array_join("path", ">").alias("path"), F.from_json("json", schema).alias("d"))
    none = F.array().cast("array<struct<additions:bigint>>")
    langs = F.aggregate(F.coalesce(F.map_values("d.by_language"), none), F.lit(0).cast("bigint"), lambda acc, x: acc + x["additions"])
    return parsed.select(
        "depth",
        "path",
        "d.label",
        F.col("d.total_commits").alias("commits"),
        F.col("d.total_net_additions").alias("net_additions"),
        langs.alias("by_language"),
    )


def _fetch_sections(spark, sf) -> DataFrame:
    contributed = _contributed(spark, sf)
    customers = t.table(spark, sf, "customer")
    metadata = t.repos(spark, sf).agg(
        F.lit("acme").alias("username"), F.lit(30).cast("bigint").alias("days"), F.count(F.lit(1)).alias("active_repos")
    )
    user = customers.agg(F.lit("acme").alias("login"), F.count(F.lit(1)).alias("followers"))
    summary = customers.agg(
        F.sum("c_custkey").alias("total_prs"), F.count(F.lit(1)).alias("total_reviews"), F.lit(4).cast("bigint").alias("total_issues")
    )
    return documents.to_fetch_json(
        metadata, user, remote.remote_by_period(contributed), remote.remote_period_languages(contributed), summary
    )


@query(
    "stats_json_roundtrip",
    f"""{o.with_(o.HISTORY, o.WEEKS, o.REPO_LANGUAGES, o.apportioned('w', 'repo, week'))},
t AS (SELECT {o.sums(commits='commits')}, {_REMOTE_SUMS} FROM {_LISTED}),
x AS (SELECT {o.sums(additions='adds')} FROM split WHERE language IN ('PROMO', 'Other'))
SELECT 'acme' AS username, CAST(30 AS BIGINT) AS days, (SELECT count(DISTINCT p_brand) FROM part) AS active_repos,
  (SELECT count(*) FROM customer) AS total_reviews, commits, greatest(t.additions - x.additions, 0) AS additions,
  (SELECT count(DISTINCT language) FROM split WHERE language NOT IN ('PROMO', 'Other')) AS languages FROM t, x""",
)
def stats_json_roundtrip(spark, sf):
    """A fetch document written, loaded again and stripped of two languages."""
    path = scratch_path(spark, "fetch")
    documents.write_report(documents.fetch_document(_fetch_sections(spark, sf)), path, "text")
    loaded = stats_json.without_languages(stats_json.read_stats_json(spark, path), ["promo", "OTHER"])
    return loaded.select(
        "username", "days", "active_repos", "total_reviews", "commits", "additions",
        F.size("by_language").cast("bigint").alias("languages"),
    )


@query(
    "fetch_document_parts",
    f"""{o.with_(o.HISTORY, o.WEEKS, o.REPO_LANGUAGES, o.apportioned('w', 'repo, week'))},
t AS (SELECT repo, {o.sums(commits='commits', additions='adds')} FROM {_LISTED} GROUP BY repo),
x AS (SELECT repo, count(DISTINCT language) AS languages, {o.sums(listed='adds')} FROM split GROUP BY repo)
SELECT repo AS label, t.commits, t.additions, x.languages, x.listed, CAST((SELECT sum(commits) FROM t) AS BIGINT) AS all_commits
FROM t JOIN x USING (repo)""",
)
def fetch_document_parts(spark, sf):
    """A document by repository, written by many tasks and read again."""
    contributed = _contributed(spark, sf).filter("week_start IS NOT NULL")
    some = t.table(spark, sf, "customer").agg(F.lit("acme").alias("login"), F.count(F.lit(1)).alias("followers"))
    sections = documents.to_fetch_json(some, some, remote.remote_by_repo(contributed), remote.remote_repo_languages(contributed), some)
    path = scratch_path(spark, "fetch-parts")
    documents.write_fetch_document(sections, path)
    whole, listed = stats_json.read_document_parts(spark, path)
    schema = "STRUCT<total_commits: BIGINT, total_additions: BIGINT, by_language: MAP<STRING, STRUCT<additions: BIGINT>>>"
    rows = listed.select("period_label", F.from_json("json", schema).alias("d"))
    return rows.select(
        F.col("period_label").alias("label"),
        F.col("d.total_commits").alias("commits"),
        F.col("d.total_additions").alias("additions"),
        F.size("d.by_language").cast("bigint").alias("languages"),
        F.aggregate(F.map_values("d.by_language"), F.lit(0).cast("bigint"), lambda acc, x: acc + x["additions"]).alias("listed"),
        whole.select("commits").scalar().alias("all_commits"),
    )


# ---- exported logs ------------------------------------------------------------------


def _export(spark, sf, body: Column) -> str:
    """Orders written as an exported log, one record per order, with ``body`` after the message."""
    commits = t.commits(spark, sf)
    fields = ("oid", "author.name", "author.email", "committer.name", "committer.email")
    seconds = F.unix_timestamp("ts").cast("string")
    head = F.concat_ws("\x1f", *fields, seconds, "message")
    key = F.col("commit_id")
    record = F.concat(F.lit("\x1e"), head, F.lit("\x1d\n\n"), body)
    path = scratch_path(spark, "log")
    rows = commits.withColumns({"n": key % 9, "m": key % 4}).select(record.alias("value"))
    rows.write.option("lineSep", "\n").text(path)
    return path


_LOG_SQL = f"""{o.with_(o.COMMITS)}, x AS (SELECT month, commit_id % 9 AS n, commit_id % 4 AS m, kind FROM c)
SELECT month AS label, count(*) AS commits, CAST(sum(n + 4) AS BIGINT) AS additions, CAST(sum(m) AS BIGINT) AS deletions,
  CAST(sum(CASE kind WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END) AS BIGINT) AS helpers FROM x GROUP BY 1"""


def _log_months(commits: DataFrame, changes: DataFrame) -> DataFrame:
    # lines and commits are of the same records, and lines carry the time of theirs
    history = t.History(commits, changes, owned=True)
    lines = buckets.by_period(history).select("label", "commits", "additions", "deletions")
    helped = commits.groupBy(timeparts.month_label(F.col("ts")).alias("label")).agg(
        F.sum(F.size("co_authors")).alias("helpers")
    )
    return lines.join(helped, "label")


@query("commit_log_text", _LOG_SQL)
def commit_log_text(spark, sf):
    lines = F.concat(
        F.col("n").cast("string"), F.lit("\t"), F.col("m").cast("string"), F.lit("\tsrc/main.rs\n"),
        F.lit("-\t-\tlogo.png\n3\t0\tdocs/a\u2028b.md\n" + '1\t0\t"a\\"b.py"\n'),
    )
    commits, changes, errors = commit_log.read_many(spark, [_export(spark, sf, lines)])
    return _log_months(commits, changes)


def _patch() -> Column:
    plus = F.repeat(F.lit("+line\n"), F.col("n").cast("int"))
    minus = F.repeat(F.lit("--- line\n"), F.col("m").cast("int"))
    return F.concat(
        F.lit("diff --git a/src/main.rs b/src/main.rs\nindex 1..2 100644\n--- a/src/main.rs\n+++ b/src/main.rs\n@@ -1,2 +1,2 @@\n same\n"),
        plus, minus,
        F.lit("diff --git a/logo.png b/logo.png\nindex 1..2 100644\nBinary files a/logo.png and b/logo.png differ\n"),
        F.lit("diff --git a/new.py b/new.py\nnew file mode 100644\nindex 0..2\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,3 @@\n+a\n+++ b\n+c\n"),
        F.lit('diff --git "a/a\\"b.py" "b/a\\"b.py"\nindex 1..2\n--- "a/a\\"b.py"\n+++ "b/a\\"b.py"\n@@ -1 +1 @@\n+a\u2028+b\r-c\n'),
    )


@query("patch_line_counts", _LOG_SQL)
def patch_line_counts(spark, sf):
    records = commit_log.read_records(spark, _export(spark, sf, _patch()))
    return _log_months(commit_log.commits_of(records), commit_log.count_patch_lines(records))


@query("large_patch", _LOG_SQL)
def large_patch(spark, sf):
    """The same patches read line by line, so that no record has to fit into a row."""
    history = commit_log.read_large_logs(spark, _export(spark, sf, _patch()))
    return _log_months(history.commits, history.file_changes)


# ---- orders made visible ------------------------------------------------------------


def _position_sql(of: str, order: str, *columns: str) -> str:
    """Rows of another query's SQL with their place in an order."""
    return f"SELECT {', '.join(columns)}, row_number() OVER (ORDER BY {order}) AS number FROM ({ORACLES[of]})"


@query("remote_repo_positions", _position_sql("remote_by_repo", "additions DESC, label", "label", "additions"))
def remote_repo_positions(spark, sf):
    rows = remote.remote_by_repo(_contributed(spark, sf)).select("label", "additions")
    return ranking.numbered(rows, ranking.remote_repo_order())


@query("owned_repo_positions", _position_sql("owned_repos", "lower(repo)", "repo"))
def owned_repo_positions(spark, sf):
    number = F.regexp_extract("name", "([0-9]+)$", 1).cast("int")
    rows = t.repos(spark, sf).withColumn("owner", F.when(number % 2 == 0, F.lit("ACME")).otherwise(F.lit("other")))
    mine = filters.owned_by(filters.drop_forks(rows), "Acme").select("owner", "name")
    placed = ranking.numbered(mine, ranking.repo_order())
    return placed.select(F.concat_ws("/", "owner", "name").alias("repo"), "number")


@query("week_positions", _position_sql("weekly_buckets", "repo, week_start", "repo", "week_start", "adds"))
def week_positions(spark, sf):
    rows = remote.weekly_buckets(t.hosted_history(spark, sf)).select("repo", "week_start", "adds")
    return ranking.numbered(rows, ranking.weeks_in_order()).withColumn("week_start", day("week_start"))


@query("language_churn_positions", _position_sql("language_totals", "additions + deletions DESC, language", "language"))
def language_churn_positions(spark, sf):
    rows = buckets.bucket_languages(t.history(spark, sf), {})
    return ranking.numbered(rows, ranking.churn_order()).select("language", "number")


@query("commits_oldest_first", "SELECT o_orderkey AS commit_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def commits_oldest_first(spark, sf):
    return ranking.numbered(t.commits(spark, sf).select("commit_id", "ts"), ranking.oldest_first()).drop("ts")


@query(
    "author_positions_unmerged",
    _merged_sql("none") + " SELECT merge_key, adds, row_number() OVER (ORDER BY adds DESC, merge_key) AS number FROM heads",
)
def author_positions_unmerged(spark, sf):
    """People as recorded, by lines added in any role."""
    totals = people.author_totals(people.merged_activity(t.history(spark, sf), "none"))
    placed = ranking.numbered(totals, ranking.author_order("additions", "merge_key"))
    return placed.select("merge_key", (F.col("additions") + F.col("co_authored_additions")).alias("adds"), "number")


@query(
    "file_positions",
    f"""SELECT l_orderkey AS commit_id, path, row_number() OVER (ORDER BY l_orderkey, path) AS number FROM (
  SELECT l_orderkey, 'src/m' || (l_partkey % 97) || CASE WHEN l_partkey % 50 = 0 THEN '/Makefile' ELSE '/part' || l_partkey || '.' || {o.EXT} END AS path FROM lineitem)""",
)
def file_positions(spark, sf):
    rows = t.file_changes(spark, sf).select("commit_id", "path")
    return ranking.numbered(rows, ranking.files_in_order())


@query("bucketed_by_author", o.bucket_sql(o.name("k")))
def bucketed_by_author(spark, sf):
    """Over tables that lie bucketed by commit, with lines added up when they were written."""
    prefix = f"tally_{uuid.uuid4().hex}"
    t.history(spark, sf).save_bucketed(prefix, 16)
    return buckets.by_author(t.History.from_tables(spark, prefix, owned=True))


@query("active_repos", "SELECT count(DISTINCT p_brand) AS active_repos FROM part")
def active_repos(spark, sf):
    return remote.active_repos(_contributed(spark, sf).select("repo").distinct())


# ---- response pages -----------------------------------------------------------------


def _key() -> Column:
    return F.col("s_suppkey")


def _node() -> Column:
    return F.struct(
        F.col("s_name").alias("name"),
        (F.col("s_nationkey") == 3).alias("isFork"),
        F.struct(F.lit("acme").alias("login")).alias("owner"),
        F.struct(
            F.array(
                F.struct(_key().alias("size"), F.struct(F.lit("Go").alias("name")).alias("node")),
                F.struct((_key() + 1).alias("size"), F.struct(F.lit("Go").alias("name")).alias("node")),
                F.struct(F.lit(5).alias("size"), F.struct(F.lit("C").alias("name")).alias("node")),
            ).alias("edges")
        ).alias("languages"),
    )


def _inside(value: Column, *names: str) -> Column:
    """The value as a nested field, the outermost name first."""
    for name in reversed(names):
        value = F.struct(value.alias(name))
    return value


def _connection(*names: str) -> Column:
    return _inside(F.array(_node()), *names, "nodes")


def _pages(spark, sf, **fields: Column) -> DataFrame:
    """A response per supplier, as text."""
    suppliers = t.table(spark, sf, "supplier")
    return suppliers.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))


_PAGE_REPOS = (
    "SELECT 'acme' AS owner, s_name AS name, s_nationkey = 3 AS is_fork, CAST(2 * s_suppkey + 1 AS BIGINT) AS go, CAST(5 AS BIGINT) AS c FROM supplier"
)


def _listed(repos: DataFrame) -> DataFrame:
    return repos.select("owner", "name", "is_fork", F.col("languages")["Go"].alias("go"), F.col("languages")["C"].alias("c"))


def _contribution_pages(spark, sf) -> DataFrame:
    """Each repository in two windows."""
    entry = F.struct(_node().alias("repository"), _inside(_key(), "totalCount").alias("contributions"))
    body = F.struct(
        F.col("s_nationkey").alias("totalPullRequestContributions"),
        _key().alias("totalPullRequestReviewContributions"),
        F.array(entry).alias("commitContributionsByRepository"),
    )
    windows = [
        _pages(spark, sf, window_start=F.lit(f"{year}-01-01T00:00:00Z"), data=_inside(body, "user", "contributionsCollection"))
        for year in (2023, 2024)
    ]
    return windows[0].union(windows[1])


@query("pages_contributions", "SELECT lower('acme/' || s_name) AS repo_key, CAST(2 * s_suppkey AS BIGINT) AS commit_count FROM supplier")
def pages_contributions(spark, sf):
    found, _, _ = pages.read_contributions(spark, _contribution_pages(spark, sf))
    return remote.merge_windows(found).select("repo_key", "commit_count")


@query(
    "pages_contribution_summary",
    "SELECT CAST(2 * sum(s_nationkey) AS BIGINT) AS total_prs, CAST(2 * sum(s_suppkey) AS BIGINT) AS total_reviews, CAST(0 AS BIGINT) AS total_issues FROM supplier",
)
def pages_contribution_summary(spark, sf):
    return remote.summary(pages.read_contributions(spark, _contribution_pages(spark, sf))[1])


@query(
    "pages_history",
    """SELECT 'acme/' || s_name AS repo, CAST(s_suppkey + i AS VARCHAR) AS oid, '2024-01-0' || (i + 1) || 'T00:00:00Z' AS committed_date,
  CAST(s_suppkey AS BIGINT) AS additions, CAST(s_nationkey AS BIGINT) AS deletions FROM supplier, range(2) r(i)""",
)
def pages_history(spark, sf):
    """Answers are aliased along the list of repositories; one has no branch."""
    nodes = F.array(
        *[
            F.struct(
                (_key() + i).cast("string").alias("oid"),
                _key().alias("additions"),
                F.col("s_nationkey").alias("deletions"),
                F.lit(f"2024-01-0{i + 1}T00:00:00Z").alias("committedDate"),
            )
            for i in (0, 1)
        ]
    )
    answer = _inside(nodes, "defaultBranchRef", "target", "history", "nodes")
    listed = F.array(F.lit("acme/none"), F.concat(F.lit("acme/"), "s_name"))
    answers = F.create_map(F.lit("repo1"), answer, F.lit("repo0"), F.lit(None))
    rows, _ = pages.read_history_pages(spark, _pages(spark, sf, repos=listed, data=answers))
    return rows.drop("alias")


@query("pages_owned", f"{_PAGE_REPOS} WHERE s_nationkey <> 3")
def pages_owned(spark, sf):
    return _listed(pages.read_repo_pages(spark, _pages(spark, sf, data=_connection("user", "repositories")))[0])


@query("pages_contributed", _PAGE_REPOS)
def pages_contributed(spark, sf):
    found = _pages(spark, sf, data=_connection("user", "repositoriesContributedTo"))
    return _listed(pages.read_repo_pages(spark, found, "contributed", include_forks=True)[0])


@query("pages_private", f"{_PAGE_REPOS} WHERE s_nationkey <> 3 AND s_suppkey % 2 = 0")
def pages_private(spark, sf):
    """Half of the pages belong to another token holder."""
    holder = F.when(_key() % 2 == 0, F.lit("Me")).otherwise(F.lit("You"))
    viewer = F.struct(holder.alias("login"), _inside(F.array(_node()), "nodes").alias("repositories"))
    return _listed(pages.read_private_repos(spark, _pages(spark, sf, data=_inside(viewer, "viewer")), "mE")[0])


def _user() -> Column:
    return F.when(
        _key() % 5 != 0,
        F.struct(_key().cast("string").alias("id"), F.col("s_name").alias("login"), _inside(_key(), "totalCount").alias("publicRepositories")),
    )


@query(
    "pages_user",
    "SELECT CAST(s_suppkey AS VARCHAR) AS node_id, s_name AS login, CAST(s_suppkey AS BIGINT) AS public_repos FROM supplier WHERE s_suppkey % 5 <> 0",
)
def pages_user(spark, sf):
    found, _ = pages.read_user(spark, _pages(spark, sf, data=_inside(_user(), "user")))
    return found.select("node_id", "login", "public_repos")


@query(
    "pages_errors",
    """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'x' || s_suppkey || '; y' WHEN s_suppkey % 3 = 1 THEN 'response has no data' ELSE 'user not found' END AS error,
  count(*) AS pages FROM supplier WHERE s_suppkey % 3 <> 2 OR s_suppkey % 5 = 0 GROUP BY 1""",
)
def pages_errors(spark, sf):
    """A third of the pages fails, a third has no data; some users do not exist."""
    listed = F.array(F.struct(F.concat(F.lit("x"), _key().cast("string")).alias("message")), F.struct(F.lit("y").alias("message")))
    data = F.when(_key() % 3 != 1, _inside(_user(), "user"))
    _, errors = pages.read_user(spark, _pages(spark, sf, errors=F.when(_key() % 3 == 0, listed), data=data))
    return errors.groupBy("error").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "bad_logs",
    """SELECT CASE o_orderkey % 4 WHEN 1 THEN 'bad object id' WHEN 2 THEN 'incomplete record' ELSE 'bad commit time' END AS error,
  count(*) AS records FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY 1""",
)
def bad_logs(spark, sf):
    """Three of four records are flawed, each in its way; the others stay."""
    key = F.col("commit_id")
    commits = t.commits(spark, sf)
    oid = F.when(key % 4 == 1, F.lit("zz")).otherwise(F.col("oid"))
    seconds = F.when(key % 4 == 3, F.lit("noon")).otherwise(F.unix_timestamp("ts").cast("string"))
    fields = F.concat_ws("\x1f", oid, "author.name", "author.email", "committer.name", "committer.email", seconds)
    message = F.when(key % 4 == 2, F.lit("")).otherwise(F.concat(F.lit("\x1f"), "message", F.lit("\x1d\n")))
    path = scratch_path(spark, "bad-log")
    commits.select(F.concat(F.lit("\x1e"), fields, message).alias("value")).write.text(path)
    _, _, errors = commit_log.read_many(spark, [path])
    return errors.groupBy("error").agg(F.sum("records").alias("records"))


# ---- streams ------------------------------------------------------------------------


def _events_stream(spark, sf) -> DataFrame:
    return spark.readStream.schema(t.SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)


def _arriving(spark, sf) -> DataFrame:
    return _events_stream(spark, sf).select(
        F.concat(F.lit("acme/Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("repo"),
        F.col("event_id").cast("string").alias("oid"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("committed_date"),
        F.col("ts").alias("committed_at"),
        F.floor("value").cast("bigint").alias("additions"),
        F.get_json_object("props", "$.k").cast("bigint").alias("deletions"),
    )


def _refreshed(spark, stream: DataFrame) -> str:
    path = scratch_path(spark, "stream")
    live.refresh(stream, path, scratch_path(spark, "progress")).awaitTermination()
    return path


def _stream_sql(name: str, label: str) -> str:
    return f"""WITH e AS (SELECT 'acme/Brand#' || (user_id % 25 + 1) AS repo, ts, CAST(floor(value) AS BIGINT) AS a,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS d FROM events)
SELECT repo, {label} AS {name}, CAST(sum(a) AS BIGINT) AS adds, CAST(sum(d) AS BIGINT) AS dels,
  count(*) AS commits, CAST(sum(greatest(a, d)) AS BIGINT) AS net_mods, CAST(sum(greatest(a - d, 0)) AS BIGINT) AS net_adds
FROM e GROUP BY 1, 2"""


@query("stream_weekly", _stream_sql("week_start", "strftime(date_trunc('week', ts), '%Y-%m-%d')"))
def stream_weekly(spark, sf):
    """Weeks of all that has arrived."""
    weeks = live.weeks(spark, _refreshed(spark, _arriving(spark, sf)))
    return weeks.withColumn("week_start", day("week_start"))


@query("stream_daily", _stream_sql("day_start", "strftime(ts, '%Y-%m-%d')"))
def stream_daily(spark, sf):
    """Days of all that has arrived."""
    days = live.days(spark, _refreshed(spark, _arriving(spark, sf))).drop("month")
    return days.withColumn("day_start", day("day_start"))


@query("stream_monthly", _stream_sql("month", "strftime(ts, '%Y-%m')"))
def stream_monthly(spark, sf):
    """Months of all that has arrived."""
    return live.months(spark, _refreshed(spark, _arriving(spark, sf)))


@query("stream_running_months", f"SELECT repo, month, adds, dels, commits FROM ({ORACLES['stream_monthly']})")
def stream_running_months(spark, sf):
    """Running totals, whose result replaces what the batch before has left."""
    path = scratch_path(spark, "months")
    running = live.month_totals(_arriving(spark, sf)).writeStream.outputMode("complete")
    put = running.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    put.option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query(
    "stream_dedup",
    """SELECT 'acme/Brand#' || (user_id % 25 + 1) AS repo, count(*) AS commits, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS additions
FROM events GROUP BY 1""",
)
def stream_dedup(spark, sf):
    """Every commit arrives twice and is kept once."""
    rows = live.stored(spark, _refreshed(spark, _arriving(spark, sf).unionByName(_arriving(spark, sf))))
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.sum("additions").alias("additions"))


@query(
    "stream_rejects",
    f"""{o.with_(o.HISTORY)} SELECT repo, committed_date, CAST(sum(a) AS BIGINT) AS additions, count(*) AS commits,
  (SELECT count(*) FROM h WHERE moment IS NOT NULL) AS stored FROM h WHERE moment IS NULL GROUP BY ALL""",
)
def stream_rejects(spark, sf):
    """What could not be stored, beside the number of rows that were."""
    path = _refreshed(spark, t.hosted(_events_stream(spark, sf)))
    rejected = live.rejects(spark, path).groupBy("repo", "committed_date").agg(
        F.sum("additions").alias("additions"), F.count(F.lit(1)).alias("commits")
    )
    return rejected.withColumn("stored", live.ledger(spark, path).agg(F.sum("stored")).scalar())

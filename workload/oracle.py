"""SQL that describes the mapped tables, to compose the comparison queries from."""

from __future__ import annotations

from workload.tables import EXTENSIONS, LANGUAGES


def name(k: str) -> str:
    return f"'Customer#' || lpad(CAST({k} AS VARCHAR), 9, '0')"


def email(k: str) -> str:
    low = f"'customer' || lpad(CAST({k} AS VARCHAR), 9, '0')"
    return (
        f"CASE {k} % 4 WHEN 0 THEN {low} || '@corp.example' "
        f"WHEN 1 THEN CAST({k} AS VARCHAR) || '+' || {low} || '@users.noreply.github.com' "
        f"WHEN 2 THEN {low} || '@users.noreply.github.com' "
        f"ELSE {name(k).replace('Customer#', 'Customer')} || '@Mail.example' END"
    )


_LANGUAGE = "CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LANGUAGES) if x) + " END"
EXT = "CASE l_partkey % 8 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(EXTENSIONS)) + " END"

# Commits c(commit_id, repo, k, kind, ts); k is the author's customer key.
COMMITS = """
c AS (
  SELECT o_orderkey AS commit_id, n_name AS repo, o_custkey AS k, o_orderkey % 6 AS kind, o_orderdate AS ts,
         o_orderpriority AS priority, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m') AS month
  FROM orders JOIN nation ON n_nationkey = o_custkey % 25)"""

# Everybody of a commit: who(commit_id, p, co).
ROLES = """
who AS (
  SELECT commit_id, repo, month, k AS p, false AS co FROM c
  UNION ALL SELECT commit_id, repo, month, k + 1, true FROM c WHERE kind IN (1, 2)
  UNION ALL SELECT commit_id, repo, month, k + 2, true FROM c WHERE kind = 2
  UNION ALL SELECT commit_id, repo, month, k, true FROM c WHERE kind = 3
  UNION ALL SELECT commit_id, repo, month, k + 3, true FROM c WHERE kind = 4
  UNION ALL SELECT commit_id, repo, month, k + 3, true FROM c WHERE kind = 4)"""

# File changes f(commit_id, language, a, d, nm, na) with the label of rows without a language.
CHANGES = f"""
f AS (
  SELECT commit_id, language, a, d, greatest(a, d) AS nm, greatest(a - d, 0) AS na
  FROM (SELECT l_orderkey AS commit_id, coalesce({_LANGUAGE}, 'Other') AS language,
               CAST(l_quantity AS BIGINT) AS a, CAST(round(l_discount * 100) * 4 AS BIGINT) AS d FROM lineitem))"""

PATHS = f"""
paths AS (
  SELECT l_orderkey AS commit_id,
         CASE WHEN l_partkey % 50 = 0 THEN 'Makefile' ELSE {EXT} END AS ext FROM lineitem)"""

# Hosted history h(repo, oid, moment, a, d); unreadable dates are NULL.
HISTORY = """
h AS (
  SELECT 'acme/Brand#' || (user_id % 25 + 1) AS repo, CAST(event_id AS VARCHAR) AS oid,
         CASE WHEN event_id % 40 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS committed_date,
         CASE WHEN event_id % 40 <> 0 THEN date_trunc('second', ts) END AS moment,
         CAST(floor(value) AS BIGINT) AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) AS d
  FROM events)"""

WEEKS = """
w AS (
  SELECT repo, date_trunc('week', moment) AS week, CAST(sum(a) AS BIGINT) AS adds, CAST(sum(d) AS BIGINT) AS dels,
         count(*) AS commits, CAST(sum(greatest(a, d)) AS BIGINT) AS net_mods,
         CAST(sum(greatest(a - d, 0)) AS BIGINT) AS net_adds
  FROM h WHERE moment IS NOT NULL GROUP BY ALL)"""

# Language bytes of repositories: rl(repo, language, bytes).
REPO_LANGUAGES = """
rl AS (
  SELECT 'acme/' || p_brand AS repo, p_type AS language,
         CAST(sum(CASE WHEN p_brand = 'Brand#7' THEN 0 ELSE p_size END) AS BIGINT) AS bytes
  FROM part GROUP BY ALL)"""

# Customers with a login, and the login of customer p.
KNOWN = "p IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('MACHINERY', 'FURNITURE'))"
LOGIN = "'Dev' || lpad(CAST(p // 2 AS VARCHAR), 9, '0')"

METRICS = {"adds": "additions", "dels": "deletions", "net_mods": "net_modifications", "net_adds": "net_additions"}


def apportioned(source: str, keys: str, metrics: tuple[str, ...] = tuple(METRICS)) -> str:
    """Split the metrics of ``source`` over rl by largest remainder; rows without bytes go to Other."""
    quotas = ", ".join(f"CAST({m} AS DOUBLE) * CAST(bytes AS DOUBLE) / CAST(total AS DOUBLE) AS q_{m}" for m in metrics)
    parts = ", ".join(
        f"CAST(floor(q_{m}) AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY {keys} "
        f"ORDER BY q_{m} - floor(q_{m}) DESC, language) <= {m} - sum(CAST(floor(q_{m}) AS BIGINT)) "
        f"OVER (PARTITION BY {keys}) THEN 1 ELSE 0 END AS {m}"
        for m in metrics
    )
    plain = ", ".join(metrics)
    return f"""
rt AS (SELECT repo, sum(bytes) AS total FROM rl GROUP BY repo),
quota AS (SELECT {keys}, language, {plain}, {quotas}
  FROM {source} JOIN rt USING (repo) JOIN rl USING (repo) WHERE total > 0),
split AS (
  SELECT {keys}, language, {parts} FROM quota
  UNION ALL SELECT {keys}, 'Other', {plain} FROM {source} JOIN rt USING (repo)
  WHERE total = 0 AND (adds > 0 OR dels > 0))"""


def sums(**columns: str) -> str:
    return ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {alias}" for alias, c in columns.items())


LINES = sums(additions="a", deletions="d", net_modifications="nm", net_additions="na")
PER_COMMIT = """
fc AS (SELECT commit_id, sum(a) AS a, sum(d) AS d, sum(nm) AS nm, sum(na) AS na, count(*) AS files
  FROM f GROUP BY commit_id)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def bucket_sql(label: str, where: str = "true", lines_where: str = "true") -> str:
    """Totals per label over commits; lines are filtered on their own."""
    changes = PER_COMMIT.replace("FROM f", f"FROM f WHERE {lines_where}")
    return (
        f"{with_(COMMITS, CHANGES, changes)} SELECT {label} AS label, count(*) AS commits, {LINES}, "
        f"{sums(files='files')} FROM c LEFT JOIN fc USING (commit_id) WHERE {where} GROUP BY 1"
    )


def totals_sql(where: str = "true", lines_where: str = "true") -> str:
    changes = PER_COMMIT.replace("FROM f", f"FROM f WHERE {lines_where}")
    return (
        f"{with_(COMMITS, CHANGES, changes)} SELECT count(*) AS commits, {LINES}, "
        f"{sums(files='files')} FROM c LEFT JOIN fc USING (commit_id) WHERE {where}"
    )

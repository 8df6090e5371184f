"""Table shapes. Counters are BIGINT, times are TIMESTAMP read in UTC."""

from __future__ import annotations

PERSON = "STRUCT<name: STRING, email: STRING>"

COMMITS = f"""
    commit_id STRING, repo STRING, oid STRING,
    author {PERSON}, committer {PERSON}, co_authors ARRAY<{PERSON}>,
    ts TIMESTAMP, message STRING, message_subject STRING
"""

# ``repo`` and ``ts`` repeat the commit's and may be absent.
FILE_CHANGES = """
    commit_id STRING, repo STRING, ts TIMESTAMP, path STRING, language STRING,
    additions BIGINT, deletions BIGINT
"""

IDENTITY = "email STRING, login STRING"

REPOS = "owner STRING, name STRING, is_fork BOOLEAN, languages MAP<STRING, BIGINT>"

HISTORY = "repo STRING, oid STRING, committed_date STRING, additions BIGINT, deletions BIGINT"

WEEKLY = """
    repo STRING, week_start TIMESTAMP, adds BIGINT, dels BIGINT, commits BIGINT,
    net_mods BIGINT, net_adds BIGINT
"""

# Shapes of exported hosted-repository responses, one JSON document per line.
_REPO_NODE = """STRUCT<
    name: STRING, isFork: BOOLEAN, owner: STRUCT<login: STRING>,
    languages: STRUCT<edges: ARRAY<STRUCT<size: BIGINT, node: STRUCT<name: STRING>>>>>"""
_PAGE_INFO = "STRUCT<hasNextPage: BOOLEAN, endCursor: STRING>"
_CONNECTION = f"STRUCT<pageInfo: {_PAGE_INFO}, nodes: ARRAY<{_REPO_NODE}>>"
_COUNT = "STRUCT<totalCount: BIGINT>"
_ERRORS = "errors ARRAY<STRUCT<message: STRING>>"

USER_PAGE = f"""{_ERRORS}, data STRUCT<user: STRUCT<
    id: STRING, login: STRING, name: STRING, bio: STRING, publicRepositories: {_COUNT},
    followers: {_COUNT}, following: {_COUNT}, avatarUrl: STRING, url: STRING, createdAt: STRING>>"""

OWNED_PAGE = f"{_ERRORS}, data STRUCT<user: STRUCT<repositories: {_CONNECTION}>>"
CONTRIBUTED_PAGE = f"{_ERRORS}, data STRUCT<user: STRUCT<repositoriesContributedTo: {_CONNECTION}>>"
PRIVATE_PAGE = f"{_ERRORS}, data STRUCT<viewer: STRUCT<login: STRING, repositories: {_CONNECTION}>>"

CONTRIBUTIONS_PAGE = f"""{_ERRORS}, window_start TIMESTAMP, data STRUCT<user: STRUCT<
    contributionsCollection: STRUCT<
        totalPullRequestContributions: BIGINT,
        totalPullRequestReviewContributions: BIGINT,
        totalIssueContributions: BIGINT,
        commitContributionsByRepository: ARRAY<STRUCT<
            repository: {_REPO_NODE}, contributions: {_COUNT}>>>>>"""

HISTORY_PAGE = f"""{_ERRORS}, repos ARRAY<STRING>, data MAP<STRING, STRUCT<
    defaultBranchRef: STRUCT<target: STRUCT<history: STRUCT<
        totalCount: BIGINT, pageInfo: {_PAGE_INFO},
        nodes: ARRAY<STRUCT<oid: STRING, additions: BIGINT, deletions: BIGINT, committedDate: STRING>>>>>>>"""

# The exported statistics document that can be loaded again.
_LANG_STATS = """STRUCT<additions: BIGINT, deletions: BIGINT, files_changed: BIGINT,
    net_modifications: BIGINT, net_additions: BIGINT>"""
STATS_DOCUMENT = f"""
    metadata STRUCT<username: STRING, days: BIGINT, active_repos: BIGINT>,
    user STRUCT<login: STRING, name: STRING, bio: STRING, public_repos: BIGINT, followers: BIGINT,
        following: BIGINT, avatar_url: STRING, html_url: STRING, created_at: STRING>,
    summary STRUCT<total_prs: BIGINT, total_reviews: BIGINT, total_issues: BIGINT>,
    totals STRUCT<total_commits: BIGINT, total_additions: BIGINT, total_deletions: BIGINT,
        total_net_modifications: BIGINT, total_net_additions: BIGINT,
        by_language: MAP<STRING, {_LANG_STATS}>>"""

"""The Column functions as SQL functions, for use in ``spark.sql`` and ``df.filter`` text.

Each is a ``RETURN`` expression that Catalyst inlines; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_PERSON = "STRUCT<name: STRING, email: STRING>"
_PEOPLE = f"author {_PERSON}, co_authors ARRAY<{_PERSON}>"

DEFINITIONS = {
    "me_name": (
        f"(p STRING, {_PEOPLE}) RETURNS BOOLEAN",
        "coalesce(contains(lower(author.name), lower(p)), false) OR "
        "coalesce(exists(co_authors, x -> coalesce(contains(lower(x.name), lower(p)), false)), false)",
    ),
    "me_email": (
        f"(p STRING, {_PEOPLE}) RETURNS BOOLEAN",
        "coalesce(contains(lower(author.email), lower(p)), false) OR "
        "coalesce(exists(co_authors, x -> coalesce(contains(lower(x.email), lower(p)), false)), false)",
    ),
    "noreply_login": (
        "(email STRING) RETURNS STRING",
        "CASE WHEN endswith(lower(email), '@users.noreply.github.com') THEN "
        "regexp_replace(split_part(lower(email), '@', 1), '^[^+]*[+]', '') END",
    ),
    "me_noreply": (
        f"(p STRING, {_PEOPLE}) RETURNS BOOLEAN",
        "coalesce(noreply_login(author.email) = lower(p), false) OR "
        "coalesce(exists(co_authors, x -> coalesce(regexp_replace(split_part(CASE WHEN endswith(lower(x.email), "
        "'@users.noreply.github.com') THEN lower(x.email) END, '@', 1), '^[^+]*[+]', '') = lower(p), false)), false)",
    ),
    "me_login": (
        f"(p STRING, known ARRAY<STRING>, {_PEOPLE}) RETURNS BOOLEAN",
        "me_noreply(p, author, co_authors) OR coalesce(array_contains(known, author.email), false) OR "
        "coalesce(exists(co_authors, x -> coalesce(array_contains(known, x.email), false)), false)",
    ),
    "involves": (
        f"(p STRING, {_PEOPLE}) RETURNS BOOLEAN",
        "me_name(p, author, co_authors) OR me_email(p, author, co_authors)",
    ),
    "repo_key": ("(owner STRING, name STRING) RETURNS STRING", "lower(concat_ws('/', owner, name))"),
    "day_label": ("(t TIMESTAMP) RETURNS STRING", "date_format(t, 'yyyy-MM-dd')"),
    "month_label": ("(t TIMESTAMP) RETURNS STRING", "date_format(t, 'yyyy-MM')"),
    "iso_week": (
        "(t TIMESTAMP) RETURNS STRING",
        "concat(extract(YEAROFWEEK FROM t), '-W', lpad(extract(WEEK FROM t), 2, '0'))",
    ),
    "net_modifications": ("(a BIGINT, d BIGINT) RETURNS BIGINT", "greatest(a, d)"),
    "net_additions": ("(a BIGINT, d BIGINT) RETURNS BIGINT", "greatest(a - d, 0L)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session and return their names."""
    for name, (signature, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")
    return list(DEFINITIONS)

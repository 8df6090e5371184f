"""Exported statistics documents loaded again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revtally import schemas

_COUNTERS = ("commits", "additions", "deletions", "net_modifications", "net_additions")


def read_stats_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Documents with their defaults filled in: 365 days, no repositories, zero counters.

    Every document needs ``user`` and ``totals``; one without them is an error.
    """
    return _filled(spark.read.schema(schemas.STATS_DOCUMENT).option("multiLine", multi_line).json(path))


def read_document_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A document written in parts: as :func:`read_stats_json` gives it, and its list of periods or
    repositories as ``(period_label, json)``. Lines are read where they lie, in no order."""
    lines = spark.read.text(path)
    opens = F.startswith("value", F.lit("{")) & F.endswith("value", F.lit('"periods":['))
    whole = lines.filter(opens).select(F.from_json(F.concat("value", F.lit("]}")), schemas.STATS_DOCUMENT).alias("d"))
    listed = lines.filter(~opens & (F.col("value") != "]}")).select(F.regexp_replace("value", "^,", "").alias("json"))
    return _filled(whole.select("d.*")), listed.select(F.get_json_object("json", "$.period_label").alias("period_label"), "json")


def _filled(docs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    for part in ("user", "totals"):
        lacking = F.raise_error(F.lit(f"document has no {part}"))
        docs = docs.withColumn(
            part, F.when(F.col(part).isNotNull(), F.col(part)).otherwise(lacking.cast(docs.schema[part].dataType))
        )
    return docs.select(
        F.coalesce("metadata.username", "user.login").alias("username"),
        F.coalesce("metadata.days", F.lit(365).cast("bigint")).alias("days"),
        F.coalesce("metadata.active_repos", zero).alias("active_repos"),
        "user",
        *[F.coalesce(f"summary.{c}", zero).alias(c) for c in ("total_prs", "total_reviews", "total_issues")],
        *[F.coalesce(f"totals.total_{c}", zero).alias(c) for c in _COUNTERS],
        "totals.by_language",
    )


def document_languages(docs: DataFrame) -> DataFrame:
    """Language rows of loaded documents."""
    rows = docs.select("username", F.explode("by_language").alias("language", "s"))
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "username",
        "language",
        *[F.coalesce(F.col("s")[c], zero).alias(c) for c in _COUNTERS[1:]],
        F.coalesce(F.col("s.files_changed"), zero).alias("files"),
    )


def without_languages(docs: DataFrame, excluded: list[str]) -> DataFrame:
    """Take languages off loaded totals; counters stop at zero."""
    names = [x.lower() for x in excluded]
    out = F.map_filter("by_language", lambda k, v: F.lower(k).isin(names))
    zero = F.lit(0).cast("bigint")

    def removed(counter: str):
        return F.aggregate(F.map_values(out), zero, lambda acc, s: acc + F.coalesce(s[counter], zero))

    kept = F.map_filter("by_language", lambda k, v: ~F.lower(k).isin(names))
    less = {
        c: F.greatest(F.col(c) - F.coalesce(removed(c), zero), zero) for c in _COUNTERS[1:]
    }
    return docs.withColumns({**less, "by_language": kept})

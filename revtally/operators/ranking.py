"""Orders, top-k, shares and global numbering. Ties are always broken by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtally.operators.filters import with_additions
from revtally.session import ensure_checkpoint_dir

_LANGUAGE_SORTS = {
    "additions": "additions",
    "commits": "additions",
    "deletions": "deletions",
    "files": "files",
}


def language_order(sort: str = "additions", name: str = "language") -> list[Column]:
    if sort == "name":
        return [F.col(name).asc()]
    if sort not in _LANGUAGE_SORTS:
        raise ValueError(f"cannot sort languages by {sort!r}")
    return [F.col(_LANGUAGE_SORTS[sort]).desc(), F.col(name).asc()]


def author_rank(sort: str = "commits") -> Column:
    """What authors are ordered by, greatest first; ``files`` and ``name`` leave it to the name."""
    if sort in ("files", "name"):
        return F.lit(0).cast("bigint")
    if sort not in ("commits", "additions", "deletions"):
        raise ValueError(f"cannot sort authors by {sort!r}")
    return F.col(sort) + F.col(f"co_authored_{sort}")


def author_order(sort: str = "commits", name: str = "name") -> list[Column]:
    """Authored and co-authored counters together, then the name."""
    return [author_rank(sort).desc(), F.col(name).asc()]


def repo_order() -> list[Column]:
    return [F.lower("owner").asc(), F.lower("name").asc()]


def remote_repo_order() -> list[Column]:
    return [F.col("additions").desc(), F.col("label").asc()]


def churn_order() -> list[Column]:
    """Languages by additions and deletions together."""
    return [(F.col("additions") + F.col("deletions")).desc(), F.col("language").asc()]


def oldest_first() -> list[Column]:
    return [F.col("ts").asc(), F.col("commit_id").asc()]


def top_language(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Language with most additions per group; a group without any language gets ``—``."""
    best = F.min(
        F.when(F.col("language").isNotNull(), F.struct((-F.col("additions")).alias("a"), F.col("language")))
    )
    return rows.groupBy(*keys).agg(F.coalesce(best["language"], F.lit("—")).alias("top_language"))


def language_share(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Percent of additions per language, over all languages, and only then the first ``k``."""
    adding = with_additions(rows).groupBy("language").agg(F.sum("additions").alias("additions"))
    whole = adding.agg(F.sum("additions").alias("whole")).scalar()
    share = adding.withColumn("share", F.col("additions").cast("double") / whole * F.lit(100.0))
    if k is None:
        return share
    return share.orderBy(*language_order()).limit(k)


def weeks_in_order() -> list[Column]:
    return [F.col("repo").asc(), F.col("week_start").asc()]


def files_in_order() -> list[Column]:
    return [F.col("commit_id").asc(), F.col("path").asc()]


def numbered(df: DataFrame, order: Sequence[Column | str], into: str = "number") -> DataFrame:
    """Rows numbered from 1 in ``order`` without pulling them into one task.

    The sorted rows are checkpointed with their (partition, offset) id. Counting rows per
    partition gives each partition's first number; that table has one row per partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rid = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumn("_rid", rid).checkpoint()
    part = F.shiftright("_rid", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    first, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], first))
        first += row["n"]
    if not offsets:
        return placed.drop("_rid").withColumn(into, F.lit(None).cast("bigint"))
    starts = spark.createDataFrame(offsets, "_part BIGINT, _first BIGINT")
    within = F.col("_rid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")  # one row per partition
        .withColumn(into, F.col("_first") + within + 1)
        .drop("_rid", "_part", "_first")
    )

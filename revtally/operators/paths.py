"""Repository roots in a path inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEAD = r"(?s)^(.*)/\.git/HEAD$"


def ancestors(path: Column) -> Column:
    """Every folder above ``path``: ``/a/b/c`` has ``/a/b`` and ``/a``."""
    parts = F.split(path, "/")
    lengths = F.when(F.size(parts) > 2, F.sequence(F.lit(2), F.size(parts) - 1))
    above = F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.coalesce(above, F.array().cast("array<string>"))


def outermost(roots: DataFrame) -> DataFrame:
    """Drop roots that lie under another root.

    The prefix test becomes an equality on exploded ancestors. Folders that are no root at
    all, like a shared top folder above every path, are sorted out on distinct values
    first; only roots that do contain others meet the exploded rows.
    """
    exploded = roots.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    folders = exploded.select("above").distinct()
    outer = roots.select(F.col("path").alias("above")).join(folders, "above", "left_semi")
    nested = exploded.join(outer, "above", "left_semi").select("path").distinct()
    return roots.join(nested, "path", "left_anti")


def discover_repos(inventory: DataFrame) -> DataFrame:
    """Outermost repository roots of an inventory of file paths, in path order."""
    marked = inventory.filter(F.col("path").rlike(_HEAD))
    if "is_symlink" in inventory.columns:
        marked = marked.filter(~F.coalesce("is_symlink", F.lit(False)))
    roots = marked.select(F.regexp_extract("path", _HEAD, 1).alias("path")).distinct()
    return outermost(roots).orderBy("path")

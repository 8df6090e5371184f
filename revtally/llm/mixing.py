"""Mixing sources to target weights.

Every document gets a hash-random key. Each source is cut into ranges of that key and sorted
within them, word counts are summed up over ranges and then inside them, and the order is cut
where the source's budget is reached; whole epochs come before the cut. DataFrame operations only.

Defined results: a null or empty text has size 0 and is never counted; a null source is a source
of its own, last in order; a source of size 0 has target 0; repeated rows are rows of their own;
an empty table gives an empty result. Other columns are carried along unless their name is one
of those added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import running, saved, set_aside, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """One row per source: source, source_no, source_size, target.

    A source's target is the smaller of weight times a common level and `max_epochs` times its
    size, the level being such that the targets sum up to `share` of all words. Sources are sorted
    by the level at which they reach their limit; the level is right at the first source that
    doesn't reach it.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    by_limit = Window.orderBy("_full", "source_no")
    ahead = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    limited = (
        sources.withColumn("source_no", F.row_number().over(named) - 1)
        .withColumn("_weight", weight.cast("double"))
        .withColumn("_limit", F.col("source_size").cast("double") * max_epochs)
        .withColumn("_full", F.col("_limit") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(everything).cast("double") * share)
    )
    level = (F.col("_budget") - F.coalesce(F.sum("_limit").over(ahead), F.lit(0.0))) / F.sum("_weight").over(behind)
    reached = limited.withColumn("_level", level).withColumn("_open", F.col("_full") >= F.col("_level"))
    final = F.min_by("_level", F.when(F.col("_open"), F.col("_full"))).over(everything)
    return reached.withColumn("_final", final).select(
        "source",
        "source_no",
        "source_size",
        F.least(F.col("_limit"), F.coalesce(F.col("_weight") * F.col("_final"), F.col("_limit"))).alias("target"),
    )


def mix(sized: DataFrame, id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """`sized` (id, source, size, more) with source_size, target, epochs (times the mix takes the
    row) and taken (words the mix takes).

    The row at the cut is taken if that brings its source nearer to the budget.
    """
    added = ("source_no", "source_size", "target", "epochs", "taken")
    plain = sized.drop(*added)
    plan = saved(targets(plain, weights, max_epochs, share), "mix-targets")
    joined = plain.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ordered = running(joined, "source_no", [id_col, "size"], F.col("size"), "_before")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    extra = (F.col("size") > 0) & (F.col("_before") * 2 + F.col("size") <= rest * 2)
    return (
        ordered.withColumn("_whole", whole)
        .withColumn("epochs", F.when(F.col("size") > 0, F.col("_whole") + extra.cast("long")).otherwise(F.lit(0)).cast("long"))
        .withColumn("taken", F.col("epochs") * F.col("size"))
        .drop("_whole", "_before", "source_no")
    )


def sized(documents: DataFrame) -> DataFrame:
    """documents with `size`, the number of words of the text."""
    return documents.withColumn("size", word_count(F.col("text")))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of documents as often as the mix takes it, same columns."""
    rows, restored = set_aside(documents, ("doc_id", "text", "source"))
    plan = mix(sized(rows), **options)
    return restored(plan.filter(F.col("epochs") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))))

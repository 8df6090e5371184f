"""History as a stream: deduplicated refresh, rejected rows, and sums by day kept up to date.

Nothing depends on the order in which commits arrive: a commit that comes a year late is stored and
counted like any other, so there is no watermark and no state. A micro-batch is compared with the
stored months that it touches; then the day sums of these months are made anew from the stored
history and replace their partitions, and no others. Weeks and months are sums of days.

A refreshed folder holds ``history`` and ``days``, both partitioned by month, ``rejects`` with the
rows whose date cannot be read, partitioned by batch, and ``ledger``, one row per finished batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revtally import schemas
from revtally.functions.timeparts import month_label
from revtally.operators.refresh import append_history, save_by_month, touched_months

_TIME = "committed_at"
_COUNTERS = ("adds", "dels", "commits", "net_mods", "net_adds")
_LEDGER = "arrived BIGINT, stored BIGINT, rejected BIGINT, months ARRAY<STRING>"
#: What tells a batch from all others: the query keeps its id over restarts, and numbers its batches.
_BATCH = "stream STRING, batch BIGINT"


def refresh(arriving: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add each arriving commit to the history below ``path`` once, all available input at once.

    The checkpoint is the mark of a restarted query. A micro-batch that is run again after a
    failure doubles nothing: rows that are stored already are not added, rejects and day sums
    replace their partitions, and a batch that stands in the ledger is skipped.
    """

    def add(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        apply_batch(batch, path, stream, number)

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_batch(batch: DataFrame, path: str, stream: str, number: int) -> None:
    """Take in one micro-batch: history, rejects, day sums, and the ledger last."""
    spark = batch.sparkSession
    if ledger(spark, path).filter((F.col("stream") == stream) & (F.col("batch") == number)).count():
        return
    batch = batch.persist()
    try:
        months = touched_months(batch)
        before = _rows(spark, path, months)
        unreadable = append_history(spark, f"{path}/history", batch, months)
        _replace_batch(unreadable, f"{path}/rejects", stream, number)
        rebuild_days(spark, path, months)
        figures = (batch.count(), _rows(spark, path, months) - before, unreadable.count(), months)
        _replace_batch(spark.createDataFrame([figures], _LEDGER), f"{path}/ledger", stream, number)
    finally:
        batch.unpersist()


def _rows(spark: SparkSession, path: str, months: list[str]) -> int:
    """Stored rows of some months, from the footers of their files."""
    return stored(spark, path).filter(F.col("month").isin(months)).count()


def _replace_batch(rows: DataFrame, path: str, stream: str, number: int) -> None:
    tagged = rows.withColumns({"stream": F.lit(stream), "batch": F.lit(number).cast("bigint")})
    writer = tagged.write.partitionBy("stream", "batch").option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(path)


def _table(spark: SparkSession, path: str, otherwise: str) -> DataFrame:
    """A table that may not have a row yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], otherwise)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The history that :func:`refresh` has written."""
    return _table(spark, f"{path}/history", f"{schemas.HISTORY}, committed_at TIMESTAMP, month STRING")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rows that could not be stored, as they came, with the batch that brought them."""
    return _table(spark, f"{path}/rejects", f"{schemas.HISTORY}, {_BATCH}")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows arrived, stored and rejected, and the months touched, of every finished batch."""
    read = spark.read.schema(f"{_LEDGER}, {_BATCH}")
    try:
        return read.parquet(f"{path}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{_LEDGER}, {_BATCH}")


# ---- buckets ------------------------------------------------------------------------


def rebuild_days(spark: SparkSession, path: str, months: list[str]) -> None:
    """Make the day sums of some months anew from the stored history."""
    if not months:
        return
    history = stored(spark, path).filter(F.col("month").isin(months))
    days = _buckets(history, day_start=F.date_trunc("day", _TIME), month=F.col("month"))
    save_by_month(days, f"{path}/days", "day_start", replace=True)


def days(spark: SparkSession, path: str) -> DataFrame:
    """Day sums of the refreshed history, as of its last batch."""
    counters = ", ".join(f"{c} BIGINT" for c in _COUNTERS)
    return _table(spark, f"{path}/days", f"repo STRING, day_start TIMESTAMP, {counters}, month STRING")


def weeks(spark: SparkSession, path: str) -> DataFrame:
    """Monday weeks, from day sums."""
    return _rolled(days(spark, path), week_start=F.date_trunc("week", "day_start"))


def months(spark: SparkSession, path: str) -> DataFrame:
    """Months, from day sums."""
    return _rolled(days(spark, path), month=F.col("month"))


def _rolled(sums: DataFrame, **span: Column) -> DataFrame:
    return sums.groupBy("repo", *[c.alias(name) for name, c in span.items()]).agg(*[F.sum(c).alias(c) for c in _COUNTERS])


def _buckets(history: DataFrame, **span: Column) -> DataFrame:
    a, d = F.col("additions"), F.col("deletions")
    return history.groupBy("repo", *[c.alias(name) for name, c in span.items()]).agg(
        F.sum(a).alias("adds"),
        F.sum(d).alias("dels"),
        F.count(F.lit(1)).alias("commits"),
        F.sum(F.greatest(a, d)).alias("net_mods"),
        F.sum(F.greatest(a - d, F.lit(0).cast("bigint"))).alias("net_adds"),
    )


def week_buckets(history: DataFrame) -> DataFrame:
    """Monday weeks of commits."""
    return _buckets(history, week_start=F.date_trunc("week", _TIME))


def day_buckets(history: DataFrame) -> DataFrame:
    return _buckets(history, day_start=F.date_trunc("day", _TIME))


def month_buckets(history: DataFrame) -> DataFrame:
    return _buckets(history, month=month_label(F.col(_TIME)))


def month_totals(arriving: DataFrame) -> DataFrame:
    """Running month totals for update mode; the state is a row per repository and month."""
    return arriving.groupBy("repo", month_label(F.col(_TIME)).alias("month")).agg(
        F.sum("additions").alias("adds"), F.sum("deletions").alias("dels"), F.count(F.lit(1)).alias("commits")
    )

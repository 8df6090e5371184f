"""Helpers shared by the operators: saved tables, distributed numbering and running totals."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space is \x20 and \x09-\x0D; everything else makes up words.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one bucket of a distributed order.
BUCKET_ROWS = 2_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests), a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-llm-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in package.rglob("*.py"):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)


_COLLECTING: list[list[str]] = []


@contextmanager
def collecting() -> Iterator[list[str]]:
    """Gathers the paths of the tables that are written meanwhile, to be removed once unused."""
    made: list[str] = []
    _COLLECTING.append(made)
    try:
        yield made
    finally:
        _COLLECTING.remove(made)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _COLLECTING:
        made.append(path)
    return path


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables by whatever file system holds them, and forgets their paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written below the shared folder and read back: cuts lineage, gives sizes to the planner."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files behind; else they stay until the driver
    happens to collect its garbage. A frame that is run again makes its shuffles anew."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def set_aside(df: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with all but the used columns under names that nothing else has, and a function that
    brings back the columns of df, by their names and in their order."""
    names = {c: c if c in used else f"_aside_{k}" for k, c in enumerate(df.columns)}
    renamed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 1) drawn from the hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))


def running(df: DataFrame, group: str, key: list[str], value: Column, out: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows before this one in its group, in the order of
    a hash of `key`, then `key`.

    The hash cuts every group into ranges of about `rows` rows. Sums of ranges are added up over
    a small table, the rest within a range, so a group may hold any share of the rows. `group`
    must not be null.
    """
    u = unit_hash(F.lit(out), *[F.col(k) for k in key])
    parts = saved(df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_parts")), "parts")
    ranged = df.join(parts, group).withColumn("_u", u).withColumn("_range", F.floor(F.col("_u") * F.col("_parts")))
    sums = ranged.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(sums.select(group, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")), "offsets")
    inner = Window.partitionBy(group, "_range").orderBy("_u", *key).rowsBetween(Window.unboundedPreceding, -1)
    # the offset joins after the window: a range is never split, a group may be
    windowed = ranged.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return (
        windowed.join(offsets, [group, "_range"])
        .withColumn(out, F.col("_offset") + F.col("_inner"))
        .drop("_parts", "_u", "_range", "_offset", "_inner")
    )

"""Session set-up shared by jobs and tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "revtally", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Recording the Python call site of every Column call makes large plans slow to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Period labels are cut in the session time zone, so it has to be UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


# A task takes some 25 times as much memory as it reads of a shuffle, for sorts and
# hash maps, so 16 MB make about 400 MB. Up to 256 such parts, one does not grow with the data.
_PARTS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "256",
}


def small_parts(spark: SparkSession) -> SparkSession:
    """Lets adaptive execution deal wide aggregates out into parts of a fixed size, not a fixed
    number of parts. What the session already sets stays."""
    for key, value in _PARTS.items():
        if spark.conf.get(key, None) in (None, "67108864b", "64MB"):
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder: the one the session names, else a scratch one in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once and read it back, for a result that several branches of a plan use.

    The branches would prune it differently and so not share its shuffles. The written table
    survives lost executors and is read column by column.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

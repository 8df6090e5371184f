"""Several look-back windows in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revtally.functions.timeparts import as_moment, days_before


def in_windows(df: DataFrame, days: Sequence[float], now, on: Column) -> DataFrame:
    """Repeat each row once per window it falls in, with ``window_days``.

    The windows are a literal array, so this is a per-row generate: one scan and no join.
    """
    now = as_moment(now)
    windows = F.array(
        *[
            F.struct(F.lit(d).cast("double").alias("days"), days_before(now, d).alias("start"))
            for d in days
        ]
    )
    df = df.filter((on >= days_before(now, max(days))) & (on <= now))
    hit = F.filter(windows, lambda w: (on >= w["start"]) & (on <= now))
    return df.withColumn("window_days", F.explode(F.transform(hit, lambda w: F.ceil(w["days"]).cast("bigint"))))

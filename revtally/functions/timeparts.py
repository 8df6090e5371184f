"""Period labels and time windows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("day", "week", "month")


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def week_label(ts: Column) -> Column:
    """ISO week with its ISO year: the last days of December may belong to week 1."""
    year = F.extract(F.lit("YEAROFWEEK"), ts).cast("string")
    week = F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0")
    return F.concat(year, F.lit("-W"), week)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def period_label(ts: Column, period: str = "month") -> Column:
    try:
        label = {"day": day_label, "week": week_label, "month": month_label}[period]
    except KeyError:
        raise ValueError(f"period must be one of {PERIODS}, got {period!r}") from None
    return label(ts)


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the week of ``ts``."""
    return F.date_trunc("week", ts)


def parse_day(day: str | Column) -> Column:
    """Midnight UTC of a ``YYYY-MM-DD`` day; a malformed day is an error."""
    if isinstance(day, str):
        moment = datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=timezone.utc)
        return F.lit(moment.strftime("%Y-%m-%d 00:00:00+00:00")).cast("timestamp")
    parsed = F.try_to_timestamp(day, F.lit("yyyy-M-d"))
    malformed = F.raise_error(F.concat(F.lit("invalid date: "), day))
    return F.when(day.isNull() | parsed.isNotNull(), parsed).otherwise(malformed.cast("timestamp"))


def as_moment(value: str | datetime | Column) -> Column:
    """A point in time given as a day, a datetime or a Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=timezone.utc)
        return F.lit(value.astimezone(timezone.utc).isoformat()).cast("timestamp")
    return parse_day(value)


def days_before(now: Column, days: float) -> Column:
    """``days`` may be fractional; the look-back is cut to whole seconds."""
    return now - F.make_dt_interval(secs=F.lit(int(days * 86400)))


def lookback_windows(start: Column, end: Column) -> Column:
    """Consecutive windows of at most 365 days; an empty range is the last minute before ``end``."""
    step = F.expr("INTERVAL 365 DAYS")
    starts = F.filter(F.sequence(start, end, step), lambda s: s < end)
    spans = F.transform(
        starts, lambda s: F.struct(s.alias("window_start"), F.least(s + step, end).alias("window_end"))
    )
    minute = F.array(
        F.struct((end - F.expr("INTERVAL 1 MINUTE")).alias("window_start"), end.alias("window_end"))
    )
    return F.when(start < end, spans).otherwise(minute)


def window_end(until: Column, now: Column) -> Column:
    """Windows never reach past ``now``; without ``until`` they end there."""
    return F.least(F.coalesce(until, now), now)


def member_since(created_at: Column) -> Column:
    return F.split_part(created_at, F.lit("-"), F.lit(1))

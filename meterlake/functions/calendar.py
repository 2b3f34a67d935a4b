"""Business days, buckets and windows. Instants are epoch seconds; a business day begins at a boundary hour, local wall clock."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86_400


def local_time(seconds: Column, tz: str) -> Column:
    """Wall-clock time without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.timestamp_seconds(seconds).cast("timestamp_ntz")) if tz != "UTC" else F.timestamp_seconds(seconds).cast("timestamp_ntz")


def business_date(seconds: Column, tz: str = "UTC", boundary: int = 0) -> Column:
    """Local date of the wall clock set back by the boundary hours (so that dates and their bounds agree on days of 23 or 25 hours)."""
    return (local_time(seconds, tz) - F.expr(f"INTERVAL {boundary} HOURS")).cast("date")


def business_day_bounds(day: date, tz: str = "UTC", boundary: int = 0) -> tuple[int, int]:
    """Epoch seconds at which a business day begins and ends.

    Of a wall-clock time that comes twice the earlier counts; of one that is skipped, the first valid minute after it.
    """
    return _boundary(day, tz, boundary), _boundary(day + timedelta(days=1), tz, boundary)


def _boundary(day: date, tz: str, boundary: int) -> int:
    zone = ZoneInfo(tz)
    for minute in range(24 * 60):
        wall = datetime(day.year, day.month, day.day, tzinfo=zone) + timedelta(hours=boundary, minutes=minute)
        instant = wall.replace(fold=0)
        if datetime.fromtimestamp(instant.timestamp(), zone).replace(tzinfo=None) == wall.replace(tzinfo=None):
            return int(instant.timestamp())
    raise ValueError(f"no time on {day} in {tz}")


def bucket_start(seconds: Column, step: int, tz: str = "UTC") -> Column:
    """Start of the hour or day (local, so that buckets and dates agree)."""
    if step == HOUR:
        return seconds - F.pmod(seconds, F.lit(HOUR))
    wall = local_time(seconds, tz).cast("date").cast("timestamp_ntz")
    return F.unix_timestamp(F.convert_timezone(F.lit(tz), F.lit("UTC"), wall).cast("timestamp")) if tz != "UTC" else seconds - F.pmod(seconds, F.lit(DAY))


def bucket_label(start: Column, step: int, tz: str = "UTC") -> Column:
    return F.date_format(local_time(start, tz), "MM-dd HH:00" if step == HOUR else "MM-dd")


def window_start(window: str, as_of: int, tz: str = "UTC", boundary: int = 0) -> int:
    """Where a named window begins: business today or month, or so many hours or days back; 24 hours for other names."""
    rolling = {"5h": 5 * HOUR, "24h": DAY, "1d": DAY, "7d": 7 * DAY, "30d": 30 * DAY}
    today = (datetime.fromtimestamp(as_of, ZoneInfo(tz)).replace(tzinfo=None) - timedelta(hours=boundary)).date()
    if window == "today":
        return _boundary(today, tz, boundary)
    if window == "current_month":
        return _boundary(today.replace(day=1), tz, boundary)
    return as_of - rolling.get(window, DAY)


def preset_range(preset: str, as_of: int, tz: str = "UTC") -> tuple[int, int]:
    """Ranges as a calendar offers them: whole local days for 7d and 30d, the other windows as they are."""
    today = datetime.fromtimestamp(as_of, ZoneInfo(tz)).date()
    back = {"7d": 6, "30d": 29}
    return (_boundary(today - timedelta(days=back[preset]), tz, 0) if preset in back else window_start(preset, as_of, tz)), as_of


def date_spine(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row for each date (day)."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))


def bucket_spine(spark: SparkSession, start: int, end: int, step: int, tz: str = "UTC") -> DataFrame:
    """One row (bucket_start) for each bucket that the range [start, end) touches."""
    times = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("long"), F.lit(max(start, end - 1)).cast("long"), F.lit(HOUR).cast("long"))).alias("t"))
    ends = spark.range(1).select(F.lit(max(start, end - 1)).cast("long").alias("t"))
    return times.unionByName(ends).select(bucket_start(F.col("t"), step, tz).alias("bucket_start")).distinct()


def month_days(year: int, month: int) -> tuple[date, date]:
    first = date(year, month, 1)
    return first, (first.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)


def epoch(*args: int) -> int:
    return int(datetime(*args, tzinfo=UTC).timestamp())

"""Time values, time buckets and calendar parts.

All arithmetic runs on epoch seconds, so results are UTC whatever the session time zone is, and
grouping keys are 8-byte integers; text labels are made once per group, after aggregation.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

Instant = "datetime | str"

DAY_SECONDS = 86_400
_WIDTH = {"hour": 3_600, "6h": 21_600, "day": DAY_SECONDS}


def utc(value) -> datetime:
    """Accept a datetime or ISO text; values without an offset are UTC."""
    moment = datetime.fromisoformat(value) if isinstance(value, str) else value
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def epoch_micros(value) -> int:
    delta = utc(value) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * DAY_SECONDS + delta.seconds) * 1_000_000 + delta.microseconds


def instant(value) -> Column:
    """Timestamp literal that does not depend on the session time zone."""
    return F.timestamp_micros(F.lit(epoch_micros(value)))


def month_key(ts: Column) -> Column:
    """``yyyy-MM`` text used as the physical partition value."""
    return F.substring(_day_of(F.unix_seconds(ts)).cast("string"), 1, 7)


def _floor_to(seconds: Column, width: int) -> Column:
    return seconds - F.pmod(seconds, F.lit(width))


def _day_of(seconds: Column) -> Column:
    return F.date_from_unix_date((_floor_to(seconds, DAY_SECONDS) / DAY_SECONDS).cast("int"))


def day_of_week(ts: Column) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    days = _floor_to(F.unix_seconds(ts), DAY_SECONDS) / DAY_SECONDS
    return F.pmod(days.cast("int") + 4, F.lit(7))


def hour_of_day(ts: Column) -> Column:
    return (F.pmod(F.unix_seconds(ts), F.lit(DAY_SECONDS)) / 3_600).cast("int")


def bucket_key(ts: Column, unit: str) -> Column:
    seconds = F.unix_seconds(ts)
    if unit in _WIDTH:
        return _floor_to(seconds, _WIDTH[unit])
    day = _day_of(seconds)
    if unit == "month":
        part = F.month(day)
    elif unit == "week":
        # Week of year with Monday as first day; days before the first Monday are week 0.
        part = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7)
    else:
        raise ValueError(f"unknown bucket unit: {unit}")
    return (F.year(day) * 100 + part).cast("long")


def bucket_label(key: Column, unit: str) -> Column:
    if unit in _WIDTH:
        hour = (F.pmod(key, F.lit(DAY_SECONDS)) / 3_600).cast("int").cast("string")
        return F.concat(_day_of(key).cast("string"), F.lit("T"), F.lpad(hour, 2, "0"), F.lit(":00:00Z"))
    joiner = "-" if unit == "month" else "-W"
    text = key.cast("string")
    return F.concat(F.substring(text, 1, 4), F.lit(joiner), F.substring(text, 5, 2))


def traffic_unit(hours: float) -> str:
    """Bucket width for traffic over the last ``hours``; 0 means all time."""
    if 0 < hours <= 24:
        return "hour"
    if 0 < hours <= 168:
        return "6h"
    return "day" if 0 < hours <= 720 else "month"


def status_unit(hours: float) -> str:
    """Status-class timelines skip the 6-hour step."""
    unit = traffic_unit(hours)
    return "day" if unit == "6h" else unit


def client_unit(hours: float) -> str:
    """Single-client timelines use weeks where traffic timelines use months."""
    unit = traffic_unit(hours)
    return "week" if unit == "month" else unit


def period_unit(hours: float) -> str:
    """Bucket width for an absolute period; unlike the rolling rule, length <= 24 h is always hourly."""
    return "hour" if hours <= 24 else traffic_unit(hours)

"""Calendar and clock functions on zone-less timestamps (session zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_PARTS = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "day_of_week": F.weekday,  # Monday is 0
    "week_of_year": F.weekofyear,  # ISO week beside the plain calendar year
    "hour": F.hour,
    "minute": F.minute,
}


def with_calendar_parts(
    df: DataFrame, ts: str = "timestamp", parts: tuple[str, ...] = tuple(_PARTS)
) -> DataFrame:
    return df.withColumns({p: _PARTS[p](ts) for p in parts})


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def epoch_hour(ts: Column) -> Column:
    return F.floor(epoch_seconds(ts) / 3600)


def hour_start(hour_no: Column) -> Column:
    """The timestamp at which an epoch hour begins."""
    return F.timestamp_seconds(hour_no * 3600).cast("timestamp_ntz")


def add_hours(ts: Column, hours: Column | int) -> Column:
    hours = F.lit(hours) if isinstance(hours, int) else hours
    return ts + F.make_dt_interval(hours=hours)


def seconds_between(start: Column, end: Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / 1e6


def timestamp_of(year: Column, month: Column, day: Column, hour: Column) -> Column:
    return F.make_timestamp_ntz(year, month, day, hour, F.lit(0), F.lit(0))


def weather_hour(text: Column) -> Column:
    """Hour out of ``"0300 UTC"``."""
    return F.substring(text, 1, 2).cast("int")


def weather_date(text: Column) -> Column:
    """Date out of ``"2024/01/31"``."""
    return F.to_date(text, "yyyy/MM/dd")


def minutes_text(minutes: Column) -> Column:
    """``"H hours and M minutes"``, cut to whole minutes; a missing value counts as 0."""
    whole = F.coalesce(minutes, F.lit(0.0)).cast("int")
    return F.format_string(
        "%d hours and %d minutes", F.floor(whole / 60).cast("int"), whole % 60
    )


def text_minutes(text: Column) -> Column:
    """Minutes back out of the text; ``"M minutes"`` alone is read too."""
    hours = F.regexp_extract(text, r"(\d+) hours", 1)
    minutes = F.regexp_extract(text, r"(\d+) minutes", 1)
    return _int_or_zero(hours) * 60 + _int_or_zero(minutes)


def _int_or_zero(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).cast("int"), F.lit(0))

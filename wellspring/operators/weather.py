"""Hourly weather: raw files to a keyed table, union, overlay, join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import add_hours, weather_date, weather_hour, with_calendar_parts
from ..schemas import (
    WEATHER_DATE_TEXT,
    WEATHER_HOUR_TEXT,
    WEATHER_KEPT,
    WEATHER_KEYS,
    WEATHER_NAMES,
)


def preprocess_weather(raw: DataFrame, utc_offset_hours: int = 0) -> DataFrame:
    """Drop the unnamed last column, parse date and hour, rename, keep nine columns.

    Weather hours are UTC and reading hours local; ``utc_offset_hours`` moves the former.
    """
    named = raw.drop(raw.columns[-1]).withColumnsRenamed(WEATHER_NAMES)
    date, hour = weather_date(F.col(WEATHER_DATE_TEXT)), weather_hour(F.col(WEATHER_HOUR_TEXT))
    if utc_offset_hours == 0:
        keyed = with_calendar_parts(
            named.withColumns({"date": date, "hour": hour}), "date", ("day", "month", "year")
        )
    else:
        local = add_hours(date.cast("timestamp_ntz"), hour + utc_offset_hours)
        keyed = with_calendar_parts(named.withColumn("date", local), "date", tuple(WEATHER_KEYS))
    return keyed.select(*WEATHER_KEYS, *WEATHER_KEPT)


def weather_union(first: DataFrame, second: DataFrame, utc_offset_hours: int = 0) -> DataFrame:
    return preprocess_weather(first, utc_offset_hours).unionByName(
        preprocess_weather(second, utc_offset_hours)
    )


def duplicate_hours(weather: DataFrame) -> DataFrame:
    """Hours that occur more than once; the overlay accepts none."""
    return weather.groupBy(*WEATHER_KEYS).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def attach_weather(rows: DataFrame, weather: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """Left join on the hour; known overlay values replace the joined ones.

    The hourly tables are merged first, so the rows are joined once. No broadcast hint: Spark
    broadcasts the weather when its size allows it and otherwise shuffles, where AQE can split a
    busy hour because no second join needs the same partitioning.
    """
    if overlay is not None:
        weather = _merged(weather, overlay)
    return rows.join(weather, WEATHER_KEYS, "left")


def _merged(weather: DataFrame, overlay: DataFrame) -> DataFrame:
    measures = [c for c in overlay.columns if c not in WEATHER_KEYS and c in weather.columns]
    renamed = overlay.select(*WEATHER_KEYS, *[F.col(c).alias(f"{c}_new") for c in measures])
    newer: dict[str, Column] = {c: F.coalesce(F.col(f"{c}_new"), F.col(c)) for c in measures}
    return (
        weather.join(renamed, WEATHER_KEYS, "full_outer")
        .withColumns(newer)
        .drop(*[f"{c}_new" for c in measures])
    )

"""Readings and weather as views over the ``events`` table.

The engine works on any readings table with the bronze columns. These views give the
registered queries such a table: the stations, levels and pump codes come from the
events, and the weather of an hour comes from the events of that hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.calendar import epoch_hour, hour_start
from ..schemas import READING_NAMES, WEATHER_DATE_TEXT, WEATHER_HOUR_TEXT, WEATHER_NAMES

_SOURCE = {engine: source for source, engine in {**READING_NAMES, **WEATHER_NAMES}.items()}
# The second weather file and the complementary one begin here.
SECOND_FILE_FROM = "2024-01-16"
OVERLAY_FROM = "2024-01-21"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bronze_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per reading under the bronze column names, pumps coded 10 / 90."""
    k = F.get_json_object("props", "$.k")
    on = lambda *kinds: F.when(F.col("event_type").isin(*kinds), 90).otherwise(10)
    dropout = (k == "0") | ((F.dayofmonth("ts") * 24 + F.hour("ts")) % 37 == 0)
    return events(spark, sf_dir).select(
        F.floor(F.col("user_id") / 15).cast("int").alias("station_id"),
        "event_id",
        F.col("ts").alias(_SOURCE["timestamp"]),
        F.when(F.col("event_id") % 11 == 0, 0.0)
        .otherwise(F.col("value"))
        .alias(_SOURCE["input_flow_rate"]),
        F.when(dropout, 0.0)
        .otherwise(40.0 + k.cast("double") / 10.0)
        .alias(_SOURCE["reservoir_level_percentage"]),
        ((F.col("event_id") % 7) * 1.5).alias(_SOURCE["pressure"]),
        on("click", "purchase").alias(_SOURCE["pump_1"]),
        on("purchase", "view").alias(_SOURCE["pump_2"]),
    )


def _hour_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hour that has events."""
    s = F.col("s")
    return (
        events(spark, sf_dir)
        .groupBy(epoch_hour(F.col("ts")).alias("hour_no"))
        .agg(F.sum("event_id").alias("s"))
        .select(
            hour_start(F.col("hour_no")).alias("h"),
            "s",
            F.when(s % 13 != 0, 15.0 + (s * 7 % 200) / 10.0).alias("air_temp_c"),
            F.when(s % 17 != 0, (s * 3 % 25) / 10.0).alias("total_precip_mm"),
            F.when(s % 19 != 0, 40.0 + s * 11 % 60).alias("relative_humidity_percentage"),
        )
    )


def _as_file(hours: DataFrame) -> DataFrame:
    """Raw layout: date and hour as text, the measures, an empty last column."""
    return hours.select(
        F.date_format("h", "yyyy/MM/dd").alias(WEATHER_DATE_TEXT),
        F.format_string("%02d00 UTC", F.hour("h")).alias(WEATHER_HOUR_TEXT),
        F.col("total_precip_mm").alias(_SOURCE["total_precip_mm"]),
        F.col("air_temp_c").alias(_SOURCE["air_temp_c"]),
        (F.col("air_temp_c") + 1.0).alias(_SOURCE["max_temp_last_hour_c"]),
        (F.col("air_temp_c") - 1.0).alias(_SOURCE["min_temp_last_hour_c"]),
        F.col("relative_humidity_percentage").alias(_SOURCE["relative_humidity_percentage"]),
        F.lit(None).cast("double").alias("Unnamed"),
    )


def weather_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two consecutive raw weather files."""
    hours = _hour_weather(spark, sf_dir)
    split = F.lit(SECOND_FILE_FROM).cast("timestamp_ntz")
    return _as_file(hours.filter(F.col("h") < split)), _as_file(hours.filter(F.col("h") >= split))


def weather_overlay_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complementary raw file: later hours, other values, some of them missing."""
    hours = _hour_weather(spark, sf_dir).filter(
        F.col("h") >= F.lit(OVERLAY_FROM).cast("timestamp_ntz")
    )
    shifted = {
        c: F.when(F.col("s") % 5 != 0, F.col(c) + 0.5)
        for c in ("air_temp_c", "total_precip_mm", "relative_humidity_percentage")
    }
    return _as_file(hours.withColumns(shifted))

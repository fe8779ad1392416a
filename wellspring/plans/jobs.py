"""Batch jobs: each reads tables of one layer and writes tables of the next.

bronze readings and weather -> silver -> training set -> models -> gold answers. Paths are
those of the cluster's shared storage. Tables are replaced in one step: whoever reads while a job
runs, or after one has died, sees the version before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import (
    answers,
    depletion,
    features,
    forecast,
    hourly,
    models,
    repair,
    schedule,
    segments,
    states,
    weather,
)
from ..operators.slices import Slices
from ..schemas import SILVER, STATION, TS
from ..sources.tables import (
    in_parts,
    read_table,
    replace_parts,
    touched_parts,
    use_utc,
    write_parts,
    write_version,
)


def silver_job(
    spark: SparkSession,
    readings: str,
    weather_files: tuple[str, str],
    overlay_file: str | None,
    out: str,
    utc_offset_hours: int = 0,
    segments_file: str | None = None,
) -> None:
    """Bronze to silver, stored by year and month; repair segments are a table too."""
    use_utc(spark)
    bronze = read_table(spark, readings)
    table = _silver_of(spark, bronze, weather_files, overlay_file, utc_offset_hours, segments_file)
    write_version(table, out, partition_by=("year", "month"))


def _silver_of(
    spark: SparkSession,
    bronze: DataFrame,
    weather_files: tuple[str, str],
    overlay_file: str | None,
    utc_offset_hours: int = 0,
    segments_file: str | None = None,
) -> DataFrame:
    base = weather.weather_union(*[read_table(spark, f) for f in weather_files], utc_offset_hours)
    base, overlay = _unique_hours(base), None
    if overlay_file is not None:
        overlay = weather.preprocess_weather(read_table(spark, overlay_file), utc_offset_hours)
        overlay = _unique_hours(overlay)
    slices = Slices.fit(repair.set_up(bronze))
    if segments_file is None:
        return hourly.silver(bronze, base, overlay, slices)
    plan = read_table(spark, segments_file, segments.SEGMENTS)
    if not segments.broken_segments(plan).isEmpty():
        raise ValueError("repair segments that the walk cannot apply")
    repaired = repair.fix_readings(bronze, plan, slices)
    joined = hourly.combined_readings(repaired, base, overlay, slices)
    return hourly.silver_from_hours(hourly.hourly_agg(joined))


def silver_parts_job(
    spark: SparkSession,
    readings: str,
    weather_files: tuple[str, str],
    overlay_file: str | None,
    out: str,
    parts: int = 256,
    new_readings: str | None = None,
    **options,
) -> None:
    """Silver in parts by station; with ``new_readings`` only what they change is made anew.

    ``readings`` has the new ones too. A reading moves the profiles and the fills of its whole
    station, in all years, and of no other: so the parts of the stations that have new readings
    are rebuilt from these stations' readings, and no other file is read for it or written.
    """
    bronze = read_table(use_utc(spark), readings)
    if new_readings is None:
        write_parts(_silver_of(spark, bronze, weather_files, overlay_file, **options), out, STATION, parts)
        return
    touched = touched_parts(read_table(spark, new_readings), out)
    changed = _silver_of(spark, in_parts(bronze, out, touched), weather_files, overlay_file, **options)
    replace_parts(changed, out, touched)


def _unique_hours(table: DataFrame) -> DataFrame:
    """The hourly aggregation needs one weather row per hour; say so before a long job."""
    if not weather.duplicate_hours(table).isEmpty():
        raise ValueError("weather has several rows for one hour")
    return table


def _silver(spark: SparkSession, path: str) -> DataFrame:
    return read_table(use_utc(spark), path, SILVER)


def training_job(spark: SparkSession, silver: str, out: str) -> None:
    write_version(features.training_set(_silver(spark, silver)), out)


def models_job(
    spark: SparkSession, training: str, boundary: str, folder: str, horizons=features.HORIZONS, **params
) -> DataFrame:
    """Fit and save one model per variant and horizon; errors after the boundary."""
    before, after = models.time_split(read_table(use_utc(spark), training), boundary)
    fitted = models.train_all(before, horizons, **params)
    models.save_models(spark, fitted, folder)
    return models.error_report(fitted, after)


def evaluation_job(spark: SparkSession, training: str, boundary: str, folder: str, out: str) -> None:
    _, after = models.time_split(read_table(use_utc(spark), training), boundary)
    write_version(models.evaluation_rows(models.load_models(spark, folder), after), out)


def states_job(spark: SparkSession, silver: str, training: str, folder: str, out: str) -> None:
    """Forecasts, depletion and states for every silver hour; all models score in one pass."""
    table = _silver(spark, silver)
    changes = models.predicted_changes(models.load_models(spark, folder), read_table(spark, training))
    paths = forecast.with_paths(table.join(changes, [STATION, TS], "left"))
    write_version(states.states(depletion.with_depletion(paths)), out)


def forecast_job(
    spark: SparkSession, training: str, folder: str, requests: str, out: str, unmatched: str
) -> None:
    """Forecasts of trained models for a table of requests; those without one are reported.

    ``training`` holds the features and the flow of the hours; only requested hours are scored.
    """
    asked = read_table(use_utc(spark), requests)
    anchors = forecast.anchors_of(asked).distinct()
    rows = read_table(spark, training)
    rows = rows.join(
        anchors, (rows[STATION] == anchors[STATION]) & (rows[TS] == anchors["anchor"]), "left_semi"
    )
    changes = models.predicted_changes(models.load_models(spark, folder), rows, (STATION, TS, forecast.FLOW))
    write_version(forecast.forecast_rows(forecast.with_paths(changes)), out)
    write_version(forecast.unmatched_anchors(anchors, read_table(spark, out)), unmatched)


def search_job(
    spark: SparkSession, training: str, variant: str, horizon: int, out: str, **search
) -> None:
    """The search over time folds: each grid point with its mean error, best first."""
    rows = read_table(use_utc(spark), training)
    write_version(models.grid_search(rows, variant, horizon, **search), out)


def answers_job(spark: SparkSession, silver: str, folder: str) -> None:
    table = _silver(spark, silver)
    usage = answers.pump_peak_usage(table)
    gold = {
        "hour_profile": answers.hour_profile(table),
        "pump_peak_usage": usage,
        "pump_peak_share": answers.pump_peak_share(usage),
        "weather_corr": answers.weather_corr(table),
    }
    for name, df in gold.items():
        write_version(df, f"{folder}/{name}")


def schedules_job(spark: SparkSession, states_path: str, requests: DataFrame, out: str, **search) -> None:
    """Best schedules for requests by (station, year, month, day, hour)."""
    searchable = states.search_states(read_table(use_utc(spark), states_path))
    anchors = forecast.anchors_of(requests)
    keys = anchors.select(
        STATION,
        F.col("anchor"),
        F.hour("anchor").alias("hour"),
        F.weekday("anchor").alias("day_of_week"),
        F.weekofyear("anchor").alias("week_of_year"),
    )
    found = states.state_lookup(keys, searchable).withColumn(TS, F.col("anchor"))
    write_version(schedule.best_random_schedule(found, **search), out)

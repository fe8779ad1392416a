"""Operational answers from the silver table, per station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import minutes_text, text_minutes
from ..functions.numeric import null_if_nan
from ..schemas import PUMP_SECONDS, STATION, TS, WEATHER

PEAK_FROM, PEAK_TO = 18, 21
PEAK_MINUTES, OFFPEAK_MINUTES = 4 * 60, 20 * 60


def hour_profile(silver: DataFrame, with_imputed: bool = True) -> DataFrame:
    """Mean outflow by hour of day on weekdays and at weekends."""
    rows = silver if with_imputed else silver.filter(~F.col("inputed_row"))
    flow = F.col("output_flow_rate_mean")
    weekday = F.col("day_of_week") < 5
    return rows.groupBy(STATION, "hour").agg(
        F.avg(F.when(weekday, flow)).alias("avg_weekday_output_flow"),
        F.avg(F.when(~weekday, flow)).alias("avg_weekend_output_flow"),
    )


def pump_minutes(silver: DataFrame) -> DataFrame:
    """Mean minutes a day each pump runs in and outside peak hours, imputed hours left out.

    A day counts for a mean only if it has an hour of that kind.
    """
    peak = F.col("hour").between(PEAK_FROM, PEAK_TO)
    daily = (
        silver.filter(~F.col("inputed_row"))
        .groupBy(STATION, F.to_date(TS).alias("date"))
        .agg(
            *[
                F.sum(F.when(kind, F.col(c))).alias(f"{c}_{name}")
                for c in PUMP_SECONDS
                for name, kind in (("peak", peak), ("offpeak", ~peak))
            ],
            F.count_if(peak).alias("peak_hours"),
            F.count_if(~peak).alias("offpeak_hours"),
        )
    )
    minutes = lambda c, name: F.avg(
        F.when(F.col(f"{name}_hours") > 0, F.coalesce(F.col(f"{c}_{name}"), F.lit(0.0)))
    ) / 60
    means = daily.groupBy(STATION).agg(
        *[minutes(c, n).alias(f"{c}_{n}") for c in PUMP_SECONDS for n in ("peak", "offpeak")]
    )
    return means.selectExpr(
        STATION,
        "stack(2, 'pump_1', pump_1_duration_sum_peak, pump_1_duration_sum_offpeak,"
        " 'pump_2', pump_2_duration_sum_peak, pump_2_duration_sum_offpeak)"
        " as (pump, peak_minutes, offpeak_minutes)",
    )


def pump_peak_usage(silver: DataFrame) -> DataFrame:
    """``pump_minutes`` as text."""
    return pump_minutes(silver).select(
        STATION,
        "pump",
        minutes_text(F.col("peak_minutes")).alias("average_time_used_peak_hours"),
        minutes_text(F.col("offpeak_minutes")).alias("average_time_used_offpeak_hours"),
    )


def pump_peak_share(usage: DataFrame) -> DataFrame:
    """Minutes read back from the text, their share of peak and other hours, as percent."""
    percent = lambda c: F.format_string("%.2f%%", c * 100)
    peak = text_minutes(F.col("average_time_used_peak_hours"))
    offpeak = text_minutes(F.col("average_time_used_offpeak_hours"))
    return usage.select(
        STATION,
        "pump",
        peak.alias("peak_minutes"),
        offpeak.alias("offpeak_minutes"),
        (peak / PEAK_MINUTES).alias("proportion_peak_hours"),
        (offpeak / OFFPEAK_MINUTES).alias("proportion_offpeak_hours"),
        percent(peak / PEAK_MINUTES).alias("peak_label"),
        percent(offpeak / OFFPEAK_MINUTES).alias("offpeak_label"),
    )


def weather_corr(silver: DataFrame, by: tuple[str, ...] = (STATION,)) -> DataFrame:
    """Correlation of outflow with each weather column over the complete pairs."""
    flow = null_if_nan(F.col("output_flow_rate_mean"))
    corr: list[Column] = [
        F.corr(flow, null_if_nan(F.col(c))).alias(f"corr_{c}") for c in WEATHER
    ]
    return silver.groupBy(*by).agg(*corr)

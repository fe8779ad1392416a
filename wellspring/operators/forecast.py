"""24-hour outflow paths from predicted hourly changes.

An anchor is a station-hour to forecast from. Its predicted changes sit in two arrays of
24, ``change_no_weather`` and ``change_weather``, so a whole path is built inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import add_hours, timestamp_of
from ..schemas import STATION, TS
from .features import with_hour_halo

HOURS = 24
HISTORY_HOURS = 72
FLOW = "output_flow_rate_mean"


def anchors_of(requests: DataFrame) -> DataFrame:
    """Requests by (station, year, month, day, hour) as anchors."""
    parts = [F.col(c) for c in ("year", "month", "day", "hour")]
    return requests.select(STATION, timestamp_of(*parts).alias("anchor"))


def near_anchors(hours: DataFrame, anchors: DataFrame, before: int, after: int = 0) -> DataFrame:
    """The days of ``hours`` with an hour from ``before`` hours before an anchor to ``after`` behind.

    What a request needs, taken before any window. The months that occur are listed first: a
    filter on them prunes the partitions of a table stored by year and month; there are twelve a
    year, however many requests. The rest is a semi-join. Frames that reach no further are
    complete for the anchors themselves, and only for them.
    """
    day = lambda offset: F.date_trunc("day", add_hours(F.col("anchor"), offset))
    days = F.sequence(day(-before), day(after), F.expr("interval 1 day"))
    wanted = anchors.select(STATION, F.explode(days).alias("d"))
    wanted = wanted.select(STATION, F.year("d").alias("year"), F.month("d").alias("month"), F.dayofmonth("d").alias("day"))
    wanted = wanted.distinct()
    month = F.col("year") * 12 + F.col("month")
    months = [r[0] for r in wanted.select(month).distinct().collect()]
    return hours.where(month.isin(months)).join(wanted, [STATION, "year", "month", "day"], "left_semi")


def unmatched_anchors(anchors: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Anchors without a forecast: too near an end of the series, or in a hole."""
    return anchors.join(forecasts.select(STATION, "anchor").distinct(), [STATION, "anchor"], "left_anti")


def with_paths(hours: DataFrame, coupled: bool = True, base: str = FLOW) -> DataFrame:
    """Add ``flow_no_weather`` and ``flow_weather``, 24 hourly flows after each row.

    The first is a running sum of changes on the row's own flow. ``coupled``: each weather
    step starts from the no-weather flow of the hour before; else from its own path. A row
    has both paths or none.
    """
    start = F.col(base)
    steps = F.sequence(F.lit(1), F.lit(HOURS))
    known = (
        start.isNotNull()
        & F.col("change_no_weather").isNotNull()
        & F.col("change_weather").isNotNull()
    )
    running = lambda change: F.transform(
        steps, lambda h: F.aggregate(F.slice(change, F.lit(1), h), start, lambda a, x: a + x)
    )
    plain = hours.withColumn("flow_no_weather", F.when(known, running("change_no_weather")))
    if coupled:
        before = lambda h: F.coalesce(F.get("flow_no_weather", h - 2), start)
        weather = F.transform(steps, lambda h: before(h) + F.element_at("change_weather", h))
    else:
        weather = running("change_weather")
    return plain.withColumn("flow_weather", F.when(known, weather))


def forecast_rows(paths: DataFrame) -> DataFrame:
    """One row per anchor and forecast hour."""
    both = F.arrays_zip("flow_no_weather", "flow_weather")
    return (
        paths.filter(F.col("flow_no_weather").isNotNull())
        .select(STATION, F.col(TS).alias("anchor"), F.posexplode(both).alias("k", "flow"))
        .select(
            STATION,
            "anchor",
            add_hours(F.col("anchor"), F.col("k") + 1).alias(TS),
            F.col("flow.flow_no_weather").alias(f"{FLOW}_no_weather"),
            F.col("flow.flow_weather").alias(f"{FLOW}_weather"),
            F.lit(True).alias("forecasted"),
        )
    )


def history(silver: DataFrame, anchors: DataFrame, hours: int = HISTORY_HOURS) -> DataFrame:
    """The ``hours`` hours up to and including each anchor; the flow under both names.

    Each hour gathers its own last hours as an array, in blocks with a halo; only the arrays of
    anchors are kept, and they become rows last.
    """
    w = Window.partitionBy(STATION, "block").orderBy(TS).rowsBetween(1 - hours, 0)
    gathered = (
        with_hour_halo(silver.select(STATION, TS, FLOW), before=hours - 1, after=0)
        .withColumn("last", F.collect_list(F.struct(F.col(TS), F.col(FLOW).alias("flow"))).over(w))
        .filter("own")
        .select(STATION, F.col(TS).alias("anchor"), "last")
    )
    return (
        gathered.join(anchors.select(STATION, "anchor"), [STATION, "anchor"], "left_semi")
        .select(STATION, "anchor", F.inline("last"))
        .select(
            STATION,
            "anchor",
            TS,
            F.col("flow").alias(f"{FLOW}_no_weather"),
            F.col("flow").alias(f"{FLOW}_weather"),
            F.lit(False).alias("forecasted"),
        )
    )


def forecast_24h(silver: DataFrame, paths: DataFrame, hours: int = HISTORY_HOURS) -> DataFrame:
    """``hours`` hours of history and 24 forecast hours for every row with a path."""
    rows = forecast_rows(paths)
    known = paths.filter(F.col("flow_no_weather").isNotNull())
    return history(silver, known.select(STATION, F.col(TS).alias("anchor")), hours).unionByName(rows)


def forecasts_for(requests: DataFrame, paths: DataFrame) -> DataFrame:
    """Forecast rows of the requested anchors only (requests by station, year, month, day, hour)."""
    wanted = anchors_of(requests).distinct()
    asked = paths.join(
        wanted, (paths[STATION] == wanted[STATION]) & (paths[TS] == wanted["anchor"]), "left_semi"
    )
    return forecast_rows(asked)


def last_rows(rows: DataFrame, n: int, by: tuple[str, ...] = (STATION, "anchor")) -> DataFrame:
    """The last ``n`` rows per group in time."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(TS)))
    return rows.withColumn("from_end", rank).filter(F.col("from_end") <= n).drop("from_end")


def first_rows(rows: DataFrame, n: int, by: tuple[str, ...] = (STATION, "anchor")) -> DataFrame:
    """The first ``n`` rows per group in time."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(TS))
    return rows.withColumn("from_start", rank).filter(F.col("from_start") <= n).drop("from_start")


def real_and_forecast(rows: DataFrame, real: int = 5) -> DataFrame:
    """The last ``real`` real rows and all forecast rows per anchor, for display."""
    in_part = Window.partitionBy(STATION, "anchor", "forecasted").orderBy(F.desc(TS))
    return (
        rows.withColumn("from_end", F.row_number().over(in_part))
        .filter(F.col("forecasted") | (F.col("from_end") <= real))
        .drop("from_end")
    )


def lag_changes(change: str, lag: int) -> Column:
    """Array of the ``change`` values ``lag`` hours before each of the next 24 hours."""
    w = Window.partitionBy(STATION, "block").orderBy(TS)
    return F.array(*[F.lag(change, lag - h).over(w) for h in range(1, HOURS + 1)])

"""The dense hourly table: aggregation, grid, and filling of empty hours.

From here on a station has one row per hour of its life: at most 8,784 rows a year however
many readings it sends. Windows over ``station_id`` alone are therefore safe at this level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.arrays import scan
from ..functions.calendar import (
    epoch_hour,
    epoch_micros,
    hour_start,
    seconds_between,
    with_calendar_parts,
)
from ..functions.numeric import round2
from ..schemas import (
    COMBINED_COLUMNS,
    DATE_PARTS,
    EVENT,
    FLOW_CHANGE,
    MEASURES,
    PUMP_FLAGS,
    PUMP_SECONDS,
    SILVER_COLUMNS,
    STATION,
    TS,
    WEATHER,
    WEATHER_KEYS,
)
from .fills import moving_average_fill
from .repair import plausible, repaired_series
from .slices import Slices
from .weather import attach_weather

_CHANGE_OF = {
    "input_flow_rate_diff": "input_flow_rate",
    "output_flow_rate_diff": "output_flow_rate",
    "reservoir_level_change": "reservoir_level_percentage",
    "pressure_change": "pressure",
}
# How far back the recursive fills read.
_LOOK_BACK = 11
_FOLD_DAYS = 90


# --- readings with weather --------------------------------------------------------------


def combined_readings(
    repaired: DataFrame,
    weather: DataFrame,
    overlay: DataFrame | None = None,
    slices: Slices = Slices(),
) -> DataFrame:
    """Repaired readings with filled weather and the seconds each pump state lasted."""
    joined = attach_weather(repaired, weather, overlay)
    filled = moving_average_fill(joined, WEATHER, slices)
    seconds = seconds_between(F.lag(TS).over(slices.window()), F.col(TS))
    return (
        slices.with_halo(filled, before=1)
        .withColumn("time_diff", seconds)
        .filter(~F.col("is_halo"))
        .withColumns({f"{p}_duration": F.col(p) * F.col("time_diff") for p in ("pump_1", "pump_2")})
        .select(*COMBINED_COLUMNS)
    )


# --- aggregation to hours ---------------------------------------------------------------


def hourly_agg(combined: DataFrame) -> DataFrame:
    """First, last and mean of the measures, seconds per hour; first/last known values."""
    place = F.struct(TS, EVENT)
    known = lambda c: F.when(F.col(c).isNotNull(), place)
    aggs = []
    for m in MEASURES:
        aggs += [
            F.min_by(m, known(m)).alias(f"{m}_first"),
            F.max_by(m, known(m)).alias(f"{m}_last"),
            F.avg(m).alias(f"{m}_mean"),
        ]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    aggs += [
        total("time_diff").alias("duration_seconds_sum"),
        total("pump_1_duration").alias("pump_1_duration_sum"),
        total("pump_2_duration").alias("pump_2_duration_sum"),
        *[F.min_by(c, known(c)).alias(c) for c in WEATHER],
    ]
    return (
        combined.groupBy(STATION, epoch_hour(F.col(TS)).alias("hour_no"))
        .agg(*aggs)
        .withColumn(TS, hour_start(F.col("hour_no")))
        .drop("hour_no")
    )


def hourly_from_bronze(
    bronze: DataFrame,
    weather: DataFrame,
    overlay: DataFrame | None = None,
    slices: Slices = Slices(),
    max_output: float = 150.0,
    max_input: float = 85.0,
) -> DataFrame:
    """``hourly_agg`` of the combined readings, without building the combined readings.

    The readings are shuffled once, for the repair windows; the hours are aggregated on that
    same partitioning. What looks across hours is then done on hourly rows: the seconds up to
    an hour's first reading, the station mean for missing pressure, and the weather. Needs
    weather with one row per hour.
    """
    series = (
        repaired_series(bronze, slices)
        .withColumns(
            {
                "hour_no": epoch_hour(F.col(TS)),
                "kept": plausible(max_output, max_input),
                "pressure": round2(F.col("trailing_pressure")),
            }
        )
    )
    cell = [*slices.keys, "hour_no"]
    before = (
        Window.partitionBy(*cell)
        .orderBy(TS, EVENT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    kept = F.col("kept")
    previous = F.last(F.when(kept, F.col(TS)), True).over(before)
    edge = F.when(kept, F.struct(TS, EVENT, *MEASURES, "pump_1", "pump_2"))
    only_kept = lambda c: F.when(kept, c)
    parts = (
        series.withColumn("seconds", only_kept(seconds_between(previous, F.col(TS))))
        .groupBy(*cell)
        .agg(
            F.min(edge).alias("head"),
            F.max(edge).alias("tail"),
            F.count_if(kept).alias("n"),
            *[F.sum(only_kept(F.col(m))).alias(f"{m}_sum") for m in MEASURES],
            F.count_if(kept & F.col("pressure").isNull()).alias("no_pressure"),
            F.sum("seconds").alias("seconds"),
            *[F.sum(F.col(p) * F.col("seconds")).alias(f"{p}_s") for p in ("pump_1", "pump_2")],
            F.sum("trailing_pressure").alias("all_pressure"),
            F.count("trailing_pressure").alias("all_pressure_n"),
        )
    )
    return _finish_hours(parts, weather, overlay, slices)


def _finish_hours(
    parts: DataFrame, weather: DataFrame, overlay: DataFrame | None, slices: Slices
) -> DataFrame:
    station = Window.partitionBy(STATION)
    in_time = station.orderBy("hour_no", "head")
    station_pressure = F.try_divide(
        F.sum("all_pressure").over(station), F.sum("all_pressure_n").over(station)
    )
    # Seconds between the last reading before a part and its first reading.
    gap = F.coalesce(
        seconds_between(F.lag(F.col(f"tail.{TS}")).over(in_time), F.col(f"head.{TS}")), F.lit(0.0)
    )
    seconds = {"seconds": F.coalesce(F.col("seconds"), F.lit(0.0)) + F.col("gap")}
    for p in ("pump_1", "pump_2"):
        seconds[f"{p}_s"] = F.coalesce(F.col(f"{p}_s"), F.lit(0.0)) + F.coalesce(
            F.col(f"head.{p}") * F.col("gap"), F.lit(0.0)
        )
    hours = (
        parts.withColumn("station_pressure", round2(station_pressure))
        .filter(F.col("n") > 0)
        .withColumn("gap", gap)
        .withColumns(seconds)
    )
    if not slices.whole:  # slices shorter than an hour leave several parts of one hour
        adds = ["n", *[f"{m}_sum" for m in MEASURES], "no_pressure", "seconds", "pump_1_s", "pump_2_s"]
        hours = hours.groupBy(STATION, "hour_no").agg(
            F.min("head").alias("head"),
            F.max("tail").alias("tail"),
            F.max("station_pressure").alias("station_pressure"),
            *[F.sum(c).alias(c) for c in adds],
        )
    stats = {}
    for m in MEASURES:
        spare = F.col("station_pressure") if m == "pressure" else F.lit(None)
        stats[f"{m}_first"] = F.coalesce(F.col(f"head.{m}"), spare)
        stats[f"{m}_last"] = F.coalesce(F.col(f"tail.{m}"), spare)
        stats[f"{m}_mean"] = F.col(f"{m}_sum") / F.col("n")
    stats["pressure_mean"] = (
        F.coalesce(F.col("pressure_sum"), F.lit(0.0))
        + F.coalesce(F.col("no_pressure") * F.col("station_pressure"), F.lit(0.0))
    ) / F.when(F.col("station_pressure").isNotNull(), F.col("n"))
    timed = with_calendar_parts(
        hours.withColumn(TS, hour_start(F.col("hour_no"))), TS, ("year", "month", "day", "hour")
    )
    slim = [c for c in weather.columns if c in (*WEATHER_KEYS, *WEATHER)]
    overlay = None if overlay is None else overlay.select(*slim)
    with_weather = _fill_hour_weather(attach_weather(timed, weather.select(*slim), overlay))
    return with_weather.select(
        STATION,
        TS,
        *[c.alias(n) for n, c in stats.items()],
        F.col("seconds").alias("duration_seconds_sum"),
        F.col("pump_1_s").alias("pump_1_duration_sum"),
        F.col("pump_2_s").alias("pump_2_duration_sum"),
        *WEATHER,
    )


def _fill_hour_weather(hours: DataFrame, window: int = 10) -> DataFrame:
    """``moving_average_fill`` for the first reading of every hour.

    All readings of an hour share its weather, so the trailing rows are the counts and
    values of earlier hours: hour ``j`` back gives as many of its ``n`` readings as are
    still wanted.
    """
    order = ("day", "month", "hour", "year")
    w = Window.partitionBy(STATION).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    later = (
        Window.partitionBy(STATION)
        .orderBy(*[F.desc(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    hour = F.struct(F.col("n").cast("long").alias("n"), *WEATHER)
    recent = F.reverse(F.collect_list(hour).over(w.rowsBetween(1 - window, -1)))

    def trailing_mean(c: str) -> Column:
        start = F.struct(
            F.lit(window - 1).cast("long").alias("left"),
            F.lit(0.0).alias("total"),
            F.lit(0).cast("long").alias("known"),
        )

        def add(acc: Column, x: Column) -> Column:
            taken = F.least(acc["left"], x["n"])
            known = F.when(x[c].isNotNull(), taken).otherwise(0)
            return F.struct(
                (acc["left"] - taken).alias("left"),
                (acc["total"] + F.coalesce(x[c], F.lit(0.0)) * known).alias("total"),
                (acc["known"] + known).alias("known"),
            )

        return F.aggregate("recent", start, add, lambda acc: F.try_divide(acc["total"], acc["known"]))

    filled = {
        f"filled_{c}": F.coalesce(
            F.col(c), trailing_mean(c), F.last(c, True).over(past), F.last(c, True).over(later)
        )
        for c in WEATHER
    }
    return (
        hours.withColumn("recent", recent)
        .withColumns(filled)
        .withColumns({c: F.col(f"filled_{c}") for c in WEATHER})
        .drop("recent", *filled)
    )


# --- grid -------------------------------------------------------------------------------


def hour_range(start: Column, end: Column) -> Column:
    """Array of the hours from ``start`` to ``end``, both included."""
    return F.sequence(start, end, F.expr("interval 1 hour"))


def hourly_grid(hours: DataFrame) -> DataFrame:
    """Every hour between a station's first and last; empty hours have null measures.

    Each present hour brings along the empty hours up to the next present one, so no join
    with a calendar is needed. Pump seconds are scaled to a full hour; an hour without
    measured seconds has none. ``inputed_row`` marks rows with anything missing.
    """
    after = F.lead(TS).over(Window.partitionBy(STATION).orderBy(TS))
    until = F.coalesce(after - F.expr("interval 1 hour"), F.col(TS))
    values = [c for c in hours.columns if c not in (STATION, TS)]
    present = F.col("grid_hour") == F.col(TS)
    spread = hours.withColumn("until", until)
    dense = spread.withColumn(
        "grid_hour", F.explode(hour_range(F.col(TS), F.col("until")))
    ).select(
        STATION,
        F.col("grid_hour").alias(TS),
        *[F.when(present, F.col(c)).alias(c) for c in values if not c.endswith("duration_sum")],
        *[
            F.when(present, F.col(c)).otherwise(0.0).alias(c)
            for c in values
            if c.endswith("duration_sum")
        ],
    )
    seconds = F.coalesce(F.col("duration_seconds_sum"), F.lit(0.0))
    dense = dense.withColumns(
        {
            **{new: F.col(f"{m}_last") - F.col(f"{m}_first") for new, m in _CHANGE_OF.items()},
            **{f"pump_{i}_active": F.col(f"pump_{i}_duration_sum") > 0 for i in (1, 2)},
            **{
                f"pump_{i}_duration_sum": F.try_divide(F.col(f"pump_{i}_duration_sum"), seconds)
                * 3600
                for i in (1, 2)
            },
            "duration_seconds_sum": seconds,
        }
    )
    missing = [F.col(c).isNull() for c in dense.columns]
    any_missing = missing[0]
    for m in missing[1:]:
        any_missing = any_missing | m
    return dense.withColumn("inputed_row", any_missing)


# --- empty hours ------------------------------------------------------------------------


def fill_empty_hours(grid: DataFrame) -> DataFrame:
    """Measures, pump seconds and pump flags of the hours marked ``inputed_row``.

    A run of empty hours starts from the last value of the last full hour and keeps it; only
    the hour just before the next full one ends on that one's first value. Empty hours
    before the first full one stay null. Weather and ``pressure_change`` are left to
    ``fill_recursive``.
    """
    w = Window.partitionBy(STATION).orderBy(TS)
    empty = F.col("inputed_row")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.last(F.when(~empty, F.col(c)), True).over(so_far)
    next_first = lambda m: F.lead(F.when(~empty, F.col(f"{m}_first"))).over(w)
    filled = {}
    for m in MEASURES:
        first = carried(f"{m}_last")
        filled[f"{m}_first"] = first
        filled[f"{m}_last"] = F.when(first.isNotNull(), F.coalesce(next_first(m), first))
    filled |= {c: carried(c) for c in (*PUMP_SECONDS, *PUMP_FLAGS)}
    out = grid.withColumns({f"new_{c}": e for c, e in filled.items()})
    pick = lambda c, value: F.when(empty, value).otherwise(F.col(c)).alias(c)
    first, last = (lambda m: F.col(f"new_{m}_first")), (lambda m: F.col(f"new_{m}_last"))
    columns = {c: pick(c, F.col(f"new_{c}")) for c in filled}
    columns |= {f"{m}_mean": pick(f"{m}_mean", (first(m) + last(m)) / 2) for m in MEASURES}
    columns |= {
        change: pick(change, F.lit(None) if change == "pressure_change" else last(m) - first(m))
        for change, m in _CHANGE_OF.items()
    }
    columns |= {c: pick(c, F.lit(None)) for c in WEATHER}
    return out.select(*[columns.get(c, F.col(c)) for c in grid.columns])


#: Earlier hours whose weather is read.
_WEATHER_BACK = 4


def _filled_values() -> str:
    """SQL over ``rows``, the hours of a stretch in order: weather and pressure change of each.

    The state holds the last hours' values, filled or not, the latest last.
    """

    def weather(k: int) -> str:
        known = f"filter(slice(acc.s.w{k}, 1, {_WEATHER_BACK - 1}), v -> v is not null)"
        # Rounded as numpy does: scaled, to even, scaled back.
        return f"""if(x.inputed_row, if(x.grid_idx >= {_WEATHER_BACK}, transform(array({known}), m ->
          rint(try_divide(aggregate(m, 0D, (a, v) -> a + v), size(m)) * 100) / 100)[0], null), x.{WEATHER[k]})"""

    recent = f"slice(acc.s.p, 1, {_LOOK_BACK - 1})"
    steps = f"""filter(zip_with(slice({recent}, 2, {_LOOK_BACK - 2}), slice({recent}, 1, {_LOOK_BACK - 2}), (b, a) -> b - a),
      v -> v is not null)"""
    change = f"""if(x.inputed_row, if(x.grid_idx >= {_LOOK_BACK}, transform(array({steps}), m ->
      try_divide(aggregate(m, 0D, (a, v) -> a + v), size(m)))[0], null), x.pressure_change)"""
    push = lambda ring, value, size: f"slice(concat(acc.s.{ring}, array({value})), 2, {size})"
    nulls = lambda size: f"array_repeat(cast(null as double), {size})"
    rings = [(f"w{k}", weather(k), _WEATHER_BACK) for k in range(len(WEATHER))] + [("p", change, _LOOK_BACK)]
    start = ", ".join(f"'{ring}', {nulls(size)}" for ring, _, size in rings)
    step = ", ".join(f"'{ring}', {push(ring, value, size)}" for ring, value, size in rings)
    last = ", ".join(f"n.{ring}[{size - 1}] as {ring}" for ring, _, size in rings)
    kind = "struct<" + ", ".join(f"{ring}:double" for ring, *_ in rings) + ">"
    return scan("rows", f"named_struct({start})", f"named_struct({step})", f"array(struct({last}))", kind)


def fill_recursive(grid: DataFrame) -> DataFrame:
    """Weather and ``pressure_change`` of empty hours, from rows that may be filled too.

    Weather is the mean of hours i-4..i-2, rounded; ``pressure_change`` the mean step over
    hours i-11..i-2. Two empty hours depend on each other only if chained by gaps of at most
    11 hours, so the series is cut where such a chain begins, at most once per 90 days, and
    the stretches are folded in parallel, as arrays of hours. A stretch holds the 11 hours before its first
    empty hour.
    """
    w = Window.partitionBy(STATION).orderBy(TS)
    empty = F.col("inputed_row")
    recent_empty = F.max(F.when(empty, 1).otherwise(0)).over(w.rowsBetween(-_LOOK_BACK, -1))
    begins = F.when(empty & (F.coalesce(recent_empty, F.lit(0)) == 0), F.col(TS))
    chain = F.max(begins).over(w.rowsBetween(Window.unboundedPreceding, _LOOK_BACK))
    origin = F.min(TS).over(Window.partitionBy(STATION))
    days = F.lit(86_400 * _FOLD_DAYS * 1_000_000)
    staged = (
        grid.withColumns(
            {
                "grid_idx": (
                    (epoch_micros(F.col(TS)) - epoch_micros(origin)) / 3_600_000_000
                ).cast("long"),
            }
        )
        .withColumn("chain_start", chain)
        .withColumn("stretch", F.floor(epoch_micros(F.col("chain_start")) / days))
        .drop("chain_start")
    )
    hour = F.struct(TS, *[c for c in (*grid.columns, "grid_idx") if c not in (TS, STATION)])
    stretches = staged.groupBy(STATION, "stretch").agg(F.array_sort(F.collect_list(hour)).alias("rows"))
    filled = stretches.withColumn("filled", F.expr(_filled_values())).select(
        STATION, F.explode(F.arrays_zip("rows", "filled")).alias("z")
    )
    new = {c: f"z.filled.w{k}" for k, c in enumerate(WEATHER)} | {"pressure_change": "z.filled.p"}
    return filled.select(*[F.col(c) if c == STATION else F.col(new.get(c, f"z.rows.{c}")).alias(c) for c in grid.columns])


def finish_silver(filled: DataFrame) -> DataFrame:
    """Change of the mean outflow, first hour dropped, calendar parts, column order."""
    w = Window.partitionBy(STATION).orderBy(TS)
    flow = F.col("output_flow_rate_mean")
    return (
        with_calendar_parts(
            filled.withColumns(
                {FLOW_CHANGE: flow - F.lag(flow).over(w), "hour_rank": F.row_number().over(w)}
            ),
            TS,
            tuple(DATE_PARTS),
        )
        .filter(F.col("hour_rank") > 1)
        .select(*SILVER_COLUMNS)
    )


def silver_from_hours(hours: DataFrame) -> DataFrame:
    """Hourly aggregates to the silver table."""
    return finish_silver(fill_recursive(fill_empty_hours(hourly_grid(hours))))


def silver(
    bronze: DataFrame,
    weather: DataFrame,
    overlay: DataFrame | None = None,
    slices: Slices = Slices(),
) -> DataFrame:
    """Bronze readings and weather to the silver table, 32 columns and the station."""
    return silver_from_hours(hourly_from_bronze(bronze, weather, overlay, slices))

"""Repair of raw readings: pump states, inflow, level drop-outs, pressure, water balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import seconds_between, with_calendar_parts
from ..functions.numeric import null_if_zero, round2, strict_least
from ..schemas import EVENT, READING_NAMES, STATION, TS
from .slices import Slices

TANK_LITERS = 1_000_000
PRESSURE_WINDOW = 10
LONGEST_FILLED_ISLAND = 3

# Pump states for which a typical inflow is known: (pump_1, pump_2).
_STATES = {"pump_1_avg": (1, 0), "pump_2_avg": (0, 1), "both_pumps_avg": (1, 1)}
_CELL = [STATION, "day", "hour"]


def set_up(readings: DataFrame) -> DataFrame:
    """Engine column names; pump codes 10 / 90 become 0 / 1, other codes stay."""
    return readings.withColumnsRenamed(READING_NAMES).replace(
        {10: 0, 90: 1}, subset=["pump_1", "pump_2"]
    )


# --- pump states and inflow ------------------------------------------------------------


def _in_state(state: tuple[int, int]) -> Column:
    return (F.col("pump_1") == state[0]) & (F.col("pump_2") == state[1])


def pump_profile(readings: DataFrame) -> DataFrame:
    """Mean positive inflow per pump state by (station, day of month, hour).

    Where a cell has no such reading, the station's mean of that state stands in. One
    aggregate serves the three states; the station means add up its sums, so the readings
    are read once and a busy station is reduced before the shuffle.
    """
    flow = F.col("input_flow_rate")
    sums, means = [], []
    station = Window.partitionBy(STATION)  # at most 31 * 24 cells
    for name, state in _STATES.items():
        used = F.when(_in_state(state) & (flow > 0), flow)
        sums += [F.sum(used).alias(f"{name}_sum"), F.count(used).alias(f"{name}_n")]
        cell = F.try_divide(F.col(f"{name}_sum"), F.col(f"{name}_n"))
        overall = F.try_divide(
            F.sum(f"{name}_sum").over(station), F.sum(f"{name}_n").over(station)
        )
        means.append(F.coalesce(cell, overall).alias(name))
    return readings.groupBy(*_CELL).agg(*sums).select(*_CELL, *means)


def _with_profile(readings: DataFrame, slices: Slices) -> DataFrame:
    """Each reading with its cell's means. All months share a cell, so the cells of a busy
    station are large: its readings are dealt to as many parts as it has slices, and its cells
    are repeated for each part."""
    profile = pump_profile(readings)
    if slices.whole:
        return readings.join(profile, _CELL, "left")
    parts = slices.widths.select(STATION, "parts")
    many = F.coalesce("parts", F.lit(1))
    salted = readings.join(parts, STATION, "left").withColumn(
        "salt", F.pmod(F.xxhash64(TS, EVENT), many).cast("int")
    )
    repeated = profile.join(parts, STATION, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), many - 1))
    )
    return salted.drop("parts").join(repeated.drop("parts"), [*_CELL, "salt"], "left").drop("salt")


def fix_pumps_off(readings: DataFrame, slices: Slices = Slices()) -> DataFrame:
    """Both pumps off but water comes in: take the pump state with the nearest inflow."""
    flow = F.col("input_flow_rate")
    odd = _in_state((0, 0)) & (flow > 0)
    off = {name: F.abs(flow - F.col(name)) for name in _STATES}
    nearest = strict_least(*off.values())
    both = nearest == off["both_pumps_avg"]
    # A missing profile leaves `nearest` null: no comparison holds and both pumps stay off.
    state_of = lambda name: F.when((nearest == off[name]) | both, 1).otherwise(0)
    return (
        _with_profile(readings, slices)
        .withColumns(
            {
                "pump_1": F.when(odd, state_of("pump_1_avg")).otherwise(F.col("pump_1")),
                "pump_2": F.when(odd, state_of("pump_2_avg")).otherwise(F.col("pump_2")),
                "inputed_pump_status": odd_flag(odd),
            }
        )
        .drop(*_STATES)
    )


def fix_flow_zero(readings: DataFrame, slices: Slices = Slices()) -> DataFrame:
    """A pump runs but no water comes in: take the typical inflow of that pump state."""
    odd = ((F.col("pump_1") == 1) | (F.col("pump_2") == 1)) & (F.col("input_flow_rate") == 0)
    flow = F.col("input_flow_rate")
    typical = flow
    for name, state in _STATES.items():
        typical = F.when(_in_state(state), round2(F.col(name))).otherwise(typical)
    return (
        _with_profile(readings, slices)
        .withColumns(
            {
                "input_flow_rate": F.when(odd, typical).otherwise(flow),
                "inputed_input_flow_rate": odd_flag(odd),
            }
        )
        .drop(*_STATES)
    )


def odd_flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


# --- level drop-outs -------------------------------------------------------------------


def zero_islands(readings: DataFrame, slices: Slices = Slices()) -> DataFrame:
    """Maximal runs of zero level: first and last timestamp and length.

    The number of readings with a level before a zero reading names its island, so an
    island may span any number of slices.
    """
    zero = F.col("reservoir_level_percentage").eqNullSafe(0.0)
    level_seen = F.when(zero, 0).otherwise(1)
    marked = slices.carried(slices.assign(readings), sums={"seen_before": level_seen})
    in_slice = F.sum(level_seen).over(slices.window().rowsBetween(Window.unboundedPreceding, 0))
    return (
        marked.withColumn("island", F.col("seen_before") + in_slice)
        .filter(zero)
        .groupBy(STATION, "island")
        .agg(
            F.min(TS).alias("island_start"),
            F.max(TS).alias("island_end"),
            F.count("*").alias("island_length"),
        )
    )


def _filled_level(slices: Slices) -> tuple[Column, Column]:
    """Level with short zero islands filled, and the flag of a filled reading.

    An island of at most three readings is seen by looking three readings back and ahead.
    """
    w = slices.window()
    level = F.col("reservoir_level_percentage")
    reach = range(1, LONGEST_FILLED_ISLAND + 1)
    back = [F.lag(level, k).over(w) for k in reach]
    ahead = [F.lead(level, k).over(w) for k in reach]
    is_level = lambda c: ~c.eqNullSafe(0.0)
    distance = lambda cs: F.coalesce(*[F.when(is_level(c), k) for k, c in zip(reach, cs)])
    value = lambda cs: _first_match(cs, is_level)
    left, right = value(back), value(ahead)
    from_left, to_right = distance(back), distance(ahead)
    length = from_left + to_right - 1
    fill = (level == 0) & (length <= LONGEST_FILLED_ISLAND) & (left > 0) & (right > 0)
    step = (right - left) / (length + 1)
    filled = F.when(length == 1, (left + right) / 2).otherwise(round2(left + step * from_left))
    return F.when(fill, filled).otherwise(level), odd_flag(fill)


def _first_match(cols: list[Column], test) -> Column:
    """First column that passes the test, even when its value is null."""
    found = F.when(test(cols[0]), cols[0])
    for c in cols[1:]:
        found = found.when(test(c), c)
    return found


def fill_short_islands(readings: DataFrame, slices: Slices = Slices()) -> DataFrame:
    """Islands of 1 to 3 zero levels between two positive levels are filled in.

    One reading takes the mean of its neighbours, two or three take equal steps. Longer
    islands and those at the ends of the series stay. Every island is treated.
    """
    reach = LONGEST_FILLED_ISLAND
    level, flag = _filled_level(slices)
    return (
        slices.with_halo(readings, before=reach, after=reach)
        .withColumns({"filled_level": level, "inputed_reservoir_level": flag})
        .filter(~F.col("is_halo"))
        .withColumn("reservoir_level_percentage", F.col("filled_level"))
        .drop("filled_level", "is_halo", "slice")
    )


# --- pressure --------------------------------------------------------------------------


def _trailing_pressure(slices: Slices) -> Column:
    """Pressure, or the mean of the known ones among the last ten readings."""
    known = null_if_zero(F.col("pressure"))
    frame = slices.window().rowsBetween(1 - PRESSURE_WINDOW, 0)
    return F.coalesce(known, F.avg(known).over(frame))


def _with_pressure_filled(readings: DataFrame, slices: Slices) -> DataFrame:
    """Finish ``trailing_pressure`` (no halo rows left) with the station mean."""
    trailing = F.col("trailing_pressure")
    totals = {"pressure_sum": trailing, "pressure_n": odd_flag(trailing.isNotNull())}
    mean = F.try_divide(F.col("pressure_sum"), F.col("pressure_n"))
    return (
        slices.carried(readings, totals=totals)
        .withColumn("pressure", round2(F.coalesce(trailing, mean)))
        .drop("trailing_pressure", *totals)
    )


def fill_pressure(readings: DataFrame, slices: Slices = Slices()) -> DataFrame:
    """Zero pressure is missing: trailing mean of ten, else the station mean; 2 decimals."""
    trailing = (
        slices.with_halo(readings, before=PRESSURE_WINDOW - 1)
        .withColumn("trailing_pressure", _trailing_pressure(slices))
        .filter(~F.col("is_halo"))
        .drop("is_halo")
    )
    return _with_pressure_filled(trailing, slices).drop("slice")


# --- water balance ---------------------------------------------------------------------


def _with_balance(readings: DataFrame, slices: Slices) -> DataFrame:
    """Water that came in, stayed and left since the previous reading."""
    w = slices.window()
    liters = lambda level: level * TANK_LITERS / 100
    level = F.col("reservoir_level_percentage")
    seconds = F.col("time_passed_seconds")
    stayed = F.col("effective_liters_entered")
    return (
        readings.withColumns(
            {
                "reservoir_level_liters": liters(level),
                "time_passed_seconds": seconds_between(F.lag(TS).over(w), F.col(TS)),
                "effective_liters_entered": liters(level) - F.lag(liters(level)).over(w),
            }
        )
        .withColumn("total_liters_entered", F.col("input_flow_rate") * seconds)
        .withColumn("total_liters_out", F.col("total_liters_entered") - stayed)
        .withColumn("output_flow_rate", F.try_divide(F.col("total_liters_out"), seconds))
        # Only after the outflow is known does a falling level count as nothing gained.
        .withColumn("effective_liters_entered", F.when(stayed < 0, 0.0).otherwise(stayed))
    )


def plausible(max_output: float, max_input: float) -> Column:
    """Readings to keep. The first one of a station has no balance and fails."""
    return F.coalesce(
        (F.col("total_liters_entered") >= F.col("effective_liters_entered"))
        & (F.col("output_flow_rate") <= max_output)
        & (F.col("input_flow_rate") <= max_input),
        F.lit(False),
    )


def mass_balance(
    readings: DataFrame,
    slices: Slices = Slices(),
    max_output: float = 150.0,
    max_input: float = 85.0,
) -> DataFrame:
    """Outflow from level and inflow; implausible readings are dropped."""
    return (
        _with_balance(slices.with_halo(readings, before=1), slices)
        .filter(~F.col("is_halo") & plausible(max_output, max_input))
        .drop("is_halo", "slice")
    )


# --- the whole chain -------------------------------------------------------------------


def repaired_series(bronze: DataFrame, slices: Slices = Slices()) -> DataFrame:
    """Pump, level, pressure and balance columns of every reading, nothing dropped yet.

    All frames share one key and one order: one shuffle of the readings, one sort. Halo
    rows come straight from the raw readings, because the frames read only raw level,
    pressure and time.
    """
    readings = with_calendar_parts(set_up(bronze))
    raw = readings.select(STATION, TS, EVENT, "reservoir_level_percentage", "pressure")
    pumps = fix_flow_zero(fix_pumps_off(readings, slices), slices)
    level, flag = _filled_level(slices)
    filled = (
        slices.with_halo(
            pumps, before=PRESSURE_WINDOW - 1, after=LONGEST_FILLED_ISLAND, source=raw
        )
        .withColumns(
            {
                "filled_level": level,
                "inputed_reservoir_level": flag,
                "trailing_pressure": _trailing_pressure(slices),
            }
        )
        .withColumn("reservoir_level_percentage", F.col("filled_level"))
        .drop("filled_level")
    )
    return _with_balance(filled, slices).filter(~F.col("is_halo")).drop("is_halo")


def fix_readings(
    bronze: DataFrame,
    segments: DataFrame | None = None,
    slices: Slices = Slices(),
    max_output: float = 150.0,
    max_input: float = 85.0,
    seed: int = 42,
) -> DataFrame:
    """The repair chain: pumps, inflow, level, repair segments, pressure, balance."""
    if segments is not None:
        from .segments import walk_segments

        readings = with_calendar_parts(set_up(bronze))
        pumps = fix_flow_zero(fix_pumps_off(readings, slices), slices)
        filled = fill_short_islands(pumps, slices)
        walked = walk_segments(filled, segments, slices, seed=seed)
        return mass_balance(fill_pressure(walked, slices), slices, max_output, max_input)
    series = _with_pressure_filled(repaired_series(bronze, slices), slices)
    return series.filter(plausible(max_output, max_input)).drop("slice")

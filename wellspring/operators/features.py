"""Training set: lags, rolling features and lead targets on the dense hourly table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.calendar import epoch_hour
from ..schemas import FLOW_CHANGE, HOUR_CHANGES, MEASURE_STATS, PUMP_SECONDS, STATION, TS, WEATHER

# Hours back of the lags, and lengths of the rolling windows.
LAGS = (1, 2, 3, 6, 12, 24, 26, 48, 72)
ROLLS = (2, 3, 6, 12, 24, 36, 48, 72)
HORIZONS = tuple(range(1, 25))
DATE_FEATURES = ["hour", "day_of_week", "week_of_year", "year"]

# Feature names of the weather columns, and the columns whose lag names are
# spelled with "agot".
WEATHER_FEATURE = {
    "air_temp_c": "temperature",
    "total_precip_mm": "precipitation",
    "relative_humidity_percentage": "humidity",
}
_AGOT = {"input_flow_rate_last", "pump_1_duration_sum", "pump_2_duration_sum"}

_LAGGED = [*MEASURE_STATS, *PUMP_SECONDS, *WEATHER]
_ROLLED_CHANGE = [*HOUR_CHANGES, FLOW_CHANGE]

# A block of hours is a window partition; 96 halo hours per 180 days are two percent.
BLOCK_HOURS = 24 * 180


def _lag_name(column: str, k: int) -> str:
    word = "agot" if column in _AGOT else "ago"
    return f"{k}_hours_{word}_{WEATHER_FEATURE.get(column, column)}"


def _roll_name(column: str, k: int) -> str:
    return f"{k}_hours_rolling_{WEATHER_FEATURE.get(column, column)}"


def rolling_weather_names() -> list[str]:
    return [_roll_name(c, k) for k in ROLLS for c in WEATHER]


def feature_names(with_weather: bool = True) -> list[str]:
    """222 features with weather, 171 without."""
    use = lambda columns: [c for c in columns if with_weather or c not in WEATHER]
    return [
        *DATE_FEATURES,
        *[_lag_name(c, k) for k in LAGS for c in use(_LAGGED)],
        *[_roll_name(c, k) for k in ROLLS for c in use([*_ROLLED_CHANGE, *WEATHER])],
        "inputed_row",
    ]


def target_name(horizon: int) -> str:
    return f"target_{horizon}"


def with_hour_halo(
    hours: DataFrame, before: int, after: int, block_hours: int = BLOCK_HOURS
) -> DataFrame:
    """Copy every hour into all blocks whose frames read it; ``own`` marks its home block.

    On the dense grid a row is an hour, so the blocks follow from the timestamp alone. A
    single station's long series is thereby spread over several tasks.
    """
    hour = epoch_hour(F.col(TS))
    block = lambda h: F.floor(h / block_hours)
    return hours.withColumn(
        "block", F.explode(F.sequence(block(hour - after), block(hour + before)))
    ).withColumn("own", F.col("block") == block(hour))


def _block_window() -> WindowSpec:
    return Window.partitionBy(STATION, "block").orderBy(TS)


def _lags(w: WindowSpec) -> dict[str, Column]:
    return {_lag_name(c, k): F.lag(c, k).over(w) for k in LAGS for c in _LAGGED}


# Weather is added up in whole billionths: sums of integers don't depend on their order.
UNITS = 1_000_000_000


def _running(w: WindowSpec) -> dict[str, Column]:
    """Known values and, for weather, their sum from the block's first hour on."""
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    counts = {f"known_{c}": F.count(c).over(so_far) for c in [*_ROLLED_CHANGE, *WEATHER]}
    units = lambda c: F.floor(F.col(c) * UNITS + 0.5).cast("long")
    return counts | {f"units_{c}": F.sum(units(c)).over(so_far) for c in WEATHER}


def _rolls(w: WindowSpec) -> dict[str, Column]:
    """Null unless the window is full and free of nulls. Reads the columns of ``_running``."""
    out = {}
    within = lambda c, k: F.col(c) - F.coalesce(F.lag(c, k).over(w), F.lit(0))
    for k in ROLLS:
        full = lambda c: within(f"known_{c}", k) == k
        for c in _ROLLED_CHANGE:
            out[_roll_name(c, k)] = F.when(full(c), F.col(c) - F.lag(c, k - 1).over(w))
        for c in WEATHER:
            mean = within(f"units_{c}", k).cast("double") / float(k * UNITS)
            out[_roll_name(c, k)] = F.when(full(c), mean)
    return out


def _leads(w: WindowSpec) -> dict[str, Column]:
    return {target_name(h): F.lead(FLOW_CHANGE, h).over(w) for h in HORIZONS}


def _extended(silver: DataFrame, before: int, after: int, columns, block_hours: int) -> DataFrame:
    w = _block_window()
    running = _running(w) if before >= max(ROLLS) else {}
    halo = with_hour_halo(silver, before, after, block_hours).withColumns(running)
    # One select for all columns: hundreds of withColumn calls are slow to analyse.
    return (
        halo.select("*", *[c.alias(n) for n, c in columns(w).items()])
        .filter("own")
        .drop("own", "block", *running)
    )


def lag_features(silver: DataFrame, block_hours: int = BLOCK_HOURS) -> DataFrame:
    return _extended(silver, max(LAGS), 0, _lags, block_hours)


def rolling_features(silver: DataFrame, block_hours: int = BLOCK_HOURS) -> DataFrame:
    return _extended(silver, max(ROLLS), 0, _rolls, block_hours)


def targets(silver: DataFrame, block_hours: int = BLOCK_HOURS) -> DataFrame:
    return _extended(silver, 0, max(HORIZONS), _leads, block_hours)


def training_set(
    silver: DataFrame, block_hours: int = BLOCK_HOURS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """247 columns and the station; rows with any null, in silver columns too, are dropped.

    ``keep`` names further silver columns to carry along.
    """
    everything = lambda w: {**_lags(w), **_rolls(w), **_leads(w)}
    wide = _extended(silver, max(*LAGS, *ROLLS), max(HORIZONS), everything, block_hours)
    targets_ = [target_name(h) for h in HORIZONS]
    # One opaque predicate: from hundreds of separate not-null conditions the optimizer would
    # try to infer more.
    missing = F.array(*[F.col(c).isNull() for c in wide.columns])
    return wide.filter(~F.array_contains(missing, True)).select(STATION, TS, *keep, *feature_names(), *targets_)

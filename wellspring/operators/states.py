"""States for the pump schedule search: silver columns, forecasts and time to depletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import PUMP_FLAGS, PUMP_SECONDS, STATE_COLUMNS, STATION, TS
from .forecast import HOURS

NO_FORECAST = 0.0
NO_DEPLETION = 5
SKIPPED_HOURS = 72
LOOKUP_KEYS = ["hour", "day_of_week", "week_of_year"]


def forecast_column(h: int) -> str:
    return f"forecast_output_flow_rate_{h}h"


def states(depleted: DataFrame) -> DataFrame:
    """One state per station-hour. Without a forecast the flows are 0, without an answer
    the time to depletion is 5."""
    flows = [
        F.coalesce(F.get("flow_no_weather", F.lit(h - 1)), F.lit(NO_FORECAST)).alias(
            forecast_column(h)
        )
        for h in range(1, HOURS + 1)
    ]
    depletion = F.coalesce("time_elapsed", F.lit(NO_DEPLETION)).alias("time_to_depletion")
    return depleted.select(STATION, *STATE_COLUMNS, *flows, depletion)


def search_states(all_states: DataFrame) -> DataFrame:
    """Pump flag instead of the pump columns; the first 72 hours of a station are skipped."""
    rank = F.row_number().over(Window.partitionBy(STATION).orderBy(TS))
    active: Column = F.col(PUMP_FLAGS[0]) | F.col(PUMP_FLAGS[1])
    return (
        all_states.withColumns({"pump_active": active.cast("int"), "hour_rank": rank})
        .filter(F.col("hour_rank") > SKIPPED_HOURS)
        .drop("hour_rank", *PUMP_FLAGS, *PUMP_SECONDS)
    )


def state_lookup(requests: DataFrame, searchable: DataFrame) -> DataFrame:
    """For each request the first state with its hour, weekday and ISO week.

    ``requests`` has the station, the three keys and any further columns.
    """
    keys = [STATION, *LOOKUP_KEYS]
    others = [c for c in searchable.columns if c not in keys]
    first = searchable.groupBy(*keys).agg(F.min_by(F.struct(*others), TS).alias("state"))
    renamed = [
        F.col(f"state.{c}").alias("state_timestamp" if c == TS else c) for c in others
    ]
    return requests.join(first, keys).select(*requests.columns, *renamed)

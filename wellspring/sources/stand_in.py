"""Predicted changes without a model: what the flow did one and two days before.

The forecast operators take any two arrays of 24 changes per hour. These come from the table
itself, so a forecast can be checked against SQL, which no trained model allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.features import BLOCK_HOURS, with_hour_halo
from ..operators.forecast import lag_changes
from ..schemas import FLOW_CHANGE


def with_seasonal_changes(silver: DataFrame, block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Add ``change_no_weather`` (24 hours before) and ``change_weather`` (48 hours before)."""
    complete = lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), F.col(c))
    return (
        with_hour_halo(silver, before=48, after=0, block_hours=block_hours)
        .withColumns(
            {
                "change_no_weather": lag_changes(FLOW_CHANGE, 24),
                "change_weather": lag_changes(FLOW_CHANGE, 48),
            }
        )
        .filter("own")
        .drop("own", "block")
        .withColumns({c: complete(c) for c in ("change_no_weather", "change_weather")})
    )

"""Filling missing values along an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .slices import CALENDAR_ORDER, Slices


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the number of nulls per column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def moving_average_fill(
    df: DataFrame,
    columns: list[str],
    slices: Slices = Slices(),
    window: int = 10,
    order: tuple[str, ...] = CALENDAR_ORDER,
) -> DataFrame:
    """Mean of the known values among the last ``window`` rows, else the last known value
    before, else the first known value after.

    A row without a trailing mean has ``window`` empty rows behind it. The last trailing
    mean before it was taken where the last known value stood alone in the window, so
    filling forward from the means gives that value itself. The fill therefore never reads
    filled rows.
    """
    own = ~F.col("is_halo")
    edge = lambda prefix: {f"{prefix}_{c}": F.when(own, F.col(c)) for c in columns}
    with_edges = slices.carried(
        slices.with_halo(df, before=window - 1, order=order),
        last=edge("before"),
        first=edge("after"),
        order=order,
    )
    w = slices.window(order)
    backwards = Window.partitionBy(*slices.keys).orderBy(*[F.desc(c) for c in order])
    unbounded = Window.unboundedPreceding

    def filled(c: str) -> Column:
        return F.coalesce(
            F.col(c),
            F.avg(c).over(w.rowsBetween(1 - window, 0)),
            F.last(c, True).over(w.rowsBetween(unbounded, 0)),
            F.col(f"before_{c}"),
            F.last(F.when(own, F.col(c)), True).over(backwards.rowsBetween(unbounded, 0)),
            F.col(f"after_{c}"),
        )

    return (
        with_edges.withColumns({f"filled_{c}": filled(c) for c in columns})
        .filter(own)
        .withColumns({c: F.col(f"filled_{c}") for c in columns})
        .drop("is_halo", "slice", *[f"{p}_{c}" for p in ("filled", "before", "after") for c in columns])
    )

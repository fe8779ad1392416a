"""Splitting the series of very busy stations.

Most operators look at neighbouring readings of one station, so they run as windows over
``station_id``. One station may hold a large part of all readings; its series must not land
in one task. ``Slices.fit`` counts the readings and finds such stations. Their series are cut
into time slices of about ``max_rows`` readings, and windows run over ``(station_id, slice)``.
What a slice needs from its neighbours comes in two ways, both exact:

* ``with_halo`` copies the few rows before and after a slice into it (bounded frames);
* ``carried`` brings sums, last and first known values over all earlier or later slices
  (unbounded frames). It works on one summary row per slice.

Without busy stations both are no-ops and the plan is a plain window over ``station_id``. Readings
of one station with one and the same timestamp stay together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.calendar import epoch_hour, epoch_micros, epoch_seconds
from ..schemas import EVENT, STATION, TS
from ..sources.tables import stored

TIME_ORDER = (TS, EVENT)
# The order in which missing weather is filled: by day, month, hour, then year.
CALENDAR_ORDER = ("day", "month", "hour", "year", TS, EVENT)
_MICROS_PER_HOUR = 3_600_000_000


@dataclass(frozen=True)
class Slices:
    """Slice widths in microseconds, a row for each busy station: ``station_id, slice_width,
    parts`` (about how many slices). None: no station is busy."""

    widths: DataFrame | None = None

    @classmethod
    def fit(cls, readings: DataFrame, max_rows: int = 5_000_000) -> Slices:
        """Find the stations with more than ``max_rows`` readings.

        The widths are a small table in the shared folder, joined by station like any other.
        Only whether it is empty comes to the driver.
        """
        per_station = (
            readings.groupBy(STATION, epoch_hour(F.col(TS)).alias("hour_no"))
            .agg(F.count("*").alias("n"))
            .groupBy(STATION)
            .agg(F.sum("n").alias("n"), F.max("n").alias("peak"))
        )
        busy = per_station.filter(F.col("n") > max_rows).select(
            STATION,
            _width_for(F.col("peak"), max_rows).alias("slice_width"),
            F.ceil(F.col("n") / max_rows).cast("int").alias("parts"),
        )
        widths = stored(busy)
        return cls() if widths.isEmpty() else cls(widths)

    @property
    def whole(self) -> bool:
        return self.widths is None

    @property
    def keys(self) -> list[str]:
        return [STATION] if self.whole else [STATION, "slice"]

    def window(self, order: tuple[str, ...] = TIME_ORDER) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*order)

    def assign(self, df: DataFrame, order: tuple[str, ...] = TIME_ORDER) -> DataFrame:
        """Add the slice number; it never falls along ``order``. Null for quiet stations."""
        if self.whole:
            return df
        if order == TIME_ORDER:
            number = F.floor(epoch_micros(F.col(TS)) / F.col("slice_width"))
        else:
            hour_cell = (
                (F.col("day").cast("long") * 100 + F.col("month")) * 100 + F.col("hour")
            ) * 10_000 + F.col("year")
            in_hour = epoch_micros(F.col(TS)) - F.floor(epoch_seconds(F.col(TS)) / 3600) * (
                _MICROS_PER_HOUR
            )
            parts = F.greatest(F.lit(1), F.ceil(F.lit(_MICROS_PER_HOUR) / F.col("slice_width")))
            number = hour_cell * parts + F.floor(in_hour * parts / _MICROS_PER_HOUR)
        return (
            df.join(self.widths.drop("parts"), STATION, "left")
            .withColumn("slice", number)
            .drop("slice_width")
        )

    def with_halo(
        self,
        df: DataFrame,
        before: int,
        after: int = 0,
        source: DataFrame | None = None,
        order: tuple[str, ...] = TIME_ORDER,
    ) -> DataFrame:
        """Add ``is_halo`` and, per slice, copies of the rows just before and after it.

        ``source`` may be a cheaper DataFrame with the same rows and only the columns that
        the frames read; other columns of the copies are null.
        """
        sliced = self.assign(df, order).withColumn("is_halo", F.lit(False))
        if self.whole:
            return sliced
        rows = self.assign(df if source is None else source, order).filter(
            F.col("slice").isNotNull()
        )
        for size, ahead in ((before, False), (after, True)):
            if size:
                copies = _neighbours(rows, size, ahead, order).withColumn("is_halo", F.lit(True))
                sliced = sliced.unionByName(copies, allowMissingColumns=True)
        return sliced

    def carried(
        self,
        df: DataFrame,
        sums: dict[str, Column] | None = None,
        last: dict[str, Column] | None = None,
        first: dict[str, Column] | None = None,
        totals: dict[str, Column] | None = None,
        order: tuple[str, ...] = TIME_ORDER,
    ) -> DataFrame:
        """Add values taken over the other slices of the station.

        ``sums`` add up all earlier slices, ``last`` is the last known value before the
        slice, ``first`` the first known one after it, ``totals`` add up the whole station.
        """
        sums, last, first, totals = sums or {}, last or {}, first or {}, totals or {}
        whole_slice = Window.partitionBy(*self.keys)
        totalled = df.withColumns({n: F.sum(c).over(whole_slice) for n, c in totals.items()})
        if self.whole:
            empty = {n: F.lit(0) for n in sums}
            empty |= {n: F.lit(None).cast(_type_of(df, c)) for n, c in {**last, **first}.items()}
            return totalled.withColumns(empty)

        place = F.struct(*order)
        per_slice = [F.sum(c).alias(n) for n, c in {**sums, **totals}.items()]
        per_slice += [F.max_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in last.items()]
        per_slice += [F.min_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in first.items()]
        summary = df.filter(F.col("slice").isNotNull()).groupBy(*self.keys).agg(*per_slice)

        by_slice = Window.partitionBy(STATION).orderBy("slice")
        earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
        # The first later value, read backwards: a growing frame costs one pass.
        later = (
            Window.partitionBy(STATION)
            .orderBy(F.desc("slice"))
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        everything = Window.partitionBy(STATION)
        context = summary.select(
            *self.keys,
            *[F.sum(n).over(earlier).alias(f"{n}_ctx") for n in sums],
            *[F.last(n, True).over(earlier).alias(f"{n}_ctx") for n in last],
            *[F.last(n, True).over(later).alias(f"{n}_ctx") for n in first],
            *[F.sum(n).over(everything).alias(f"{n}_ctx") for n in totals],
        )
        joined = totalled.join(context, self.keys, "left")
        added = {n: F.coalesce(F.col(f"{n}_ctx"), F.lit(0)) for n in sums}
        added |= {n: F.col(f"{n}_ctx") for n in {**last, **first}}
        added |= {n: F.coalesce(F.col(f"{n}_ctx"), F.col(n)) for n in totals}
        return joined.withColumns(added).drop(*[f"{n}_ctx" for n in added])


def _width_for(peak_per_hour: Column, max_rows: int) -> Column:
    """Microseconds in which the busiest hour's rate gives about ``max_rows`` readings."""
    hours = F.floor(F.lit(max_rows) / peak_per_hour)
    parts = F.floor(peak_per_hour / F.lit(max_rows)) + 1
    long_ = F.least(hours, F.lit(24 * 365)) * _MICROS_PER_HOUR
    short = F.greatest(F.floor(F.lit(_MICROS_PER_HOUR) / parts), F.lit(1))
    return F.when(hours >= 1, long_).otherwise(short).cast("long")


def _type_of(df: DataFrame, column: Column):
    return df.select(column.alias("c")).schema["c"].dataType


def _neighbours(
    rows: DataFrame, size: int, ahead: bool, order: tuple[str, ...]
) -> DataFrame:
    """The last ``size`` rows before every slice, or the first ``size`` after it."""
    edge_order = [F.col(c) if ahead else F.desc(c) for c in order]
    rank = F.row_number().over(Window.partitionBy(STATION, "slice").orderBy(*edge_order))
    others = [c for c in rows.columns if c not in (STATION, "slice", *order)]
    edges = (
        rows.withColumn("edge_rank", rank)
        .filter(F.col("edge_rank") <= size)
        .groupBy(STATION, "slice")
        .agg(F.sort_array(F.collect_list(F.struct(*order, *others))).alias("edge"))
    )
    frame = Window.partitionBy(STATION).orderBy("slice")
    frame = frame.rowsBetween(1, size) if ahead else frame.rowsBetween(-size, -1)
    # Every slice holds at least one row, so `size` slices are enough, and at most
    # size * size rows are looked at.
    near = F.flatten(F.collect_list("edge").over(frame))
    start = F.lit(1) if ahead else F.greatest(F.size("near") - size + 1, F.lit(1))
    return (
        edges.select(STATION, "slice", near.alias("near"))
        .select(STATION, "slice", F.slice("near", start, F.lit(size)).alias("near"))
        .selectExpr(STATION, "slice", "inline(near)")
    )

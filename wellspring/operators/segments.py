"""Hand-written repair segments: the level walks up or down, or holds, over a row range.

A segment is ``(station_id, start_row, end_row, low, high, direction, seq)`` with direction
-1, +1 or 0 (hold) and optional ``set_flow``, ``set_pump_1``, ``set_pump_2``. Row numbers
count the station's readings from 0. Where segments overlap, the highest ``seq`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.numeric import uniform
from ..schemas import STATION
from .slices import Slices

SEGMENTS = T.StructType(
    [
        T.StructField(STATION, T.IntegerType()),
        T.StructField("start_row", T.LongType()),
        T.StructField("end_row", T.LongType()),
        T.StructField("direction", T.IntegerType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("set_flow", T.DoubleType()),
        T.StructField("set_pump_1", T.IntegerType()),
        T.StructField("set_pump_2", T.IntegerType()),
    ]
)
_BLOCK = 10_000
# About the length of a segment: a reading then meets few segments besides its own.
_COVER_BLOCK = 128


def row_index(readings: DataFrame, slices: Slices = Slices()) -> DataFrame:
    """Add ``row_idx``, the position of a reading in its station's series, from 0."""
    counted = slices.carried(slices.assign(readings), sums={"rows_before": F.lit(1)})
    in_slice = F.row_number().over(slices.window()) - 1
    return counted.withColumn("row_idx", (F.col("rows_before") + in_slice).cast("long")).drop(
        "rows_before", "slice"
    )


def broken_segments(segments: DataFrame) -> DataFrame:
    """Pairs of segments that the walk cannot apply.

    A later segment must run to or past the end of the one it overrides, and a segment that
    follows another directly must come after it in ``seq``.
    """
    named = lambda prefix: segments.select(
        STATION, *[F.col(c).alias(f"{prefix}_{c}") for c in ("start_row", "end_row", "seq")]
    )
    earlier, later = named("earlier"), named("later")
    inside = earlier.withColumn(
        "block", F.explode(F.sequence(_block("earlier_start_row"), _block("earlier_end_row")))
    ).join(later.withColumn("block", _block("later_end_row")), [STATION, "block"])
    ends_early = inside.filter(
        (F.col("later_seq") > F.col("earlier_seq"))
        & (F.col("later_end_row") >= F.col("earlier_start_row"))
        & (F.col("later_end_row") < F.col("earlier_end_row"))
    ).drop("block")
    follows = later.withColumn("earlier_end_row", F.col("later_start_row") - 1)
    out_of_turn = earlier.join(follows, [STATION, "earlier_end_row"]).filter(
        F.col("later_seq") < F.col("earlier_seq")
    )
    return ends_early.unionByName(out_of_turn)


def _block(row: str, size: int | None = None) -> Column:
    return F.floor(F.col(row) / (size or _BLOCK))


def cover(readings: DataFrame, segments: DataFrame) -> DataFrame:
    """Range join: each reading with the last segment over its row, or nulls.

    Segments are cut into blocks of rows, so the join is an equi-join on (station, block).
    """
    cut = segments.withColumn(
        "block",
        F.explode(F.sequence(_block("start_row", _COVER_BLOCK), _block("end_row", _COVER_BLOCK))),
    )
    details = [c for c in segments.columns if c != STATION]
    indexed = readings.withColumn("block", _block("row_idx", _COVER_BLOCK))
    inside = F.col("row_idx").between(F.col("start_row"), F.col("end_row"))
    matches = (
        indexed.select(STATION, "block", "row_idx")
        .join(cut, [STATION, "block"])
        .filter(inside)
        .groupBy(STATION, "row_idx")
        .agg(F.max_by(F.struct(*details), "seq").alias("segment"))
    )
    return indexed.drop("block").join(matches, [STATION, "row_idx"], "left")


def hashed_step(seed: int) -> Column:
    """Step size: uniform in the segment's range, fixed by station and row."""
    low, high = F.col("segment.low"), F.col("segment.high")
    return low + (high - low) * uniform(seed, F.col(STATION), F.col("row_idx"))


def walk_segments(
    readings: DataFrame,
    segments: DataFrame,
    slices: Slices = Slices(),
    seed: int = 42,
    step: Column | None = None,
) -> DataFrame:
    """Rewrite the level inside the segments as a walk from the reading before them.

    Neighbouring covered rows form one chain. The level in a chain is the level before it
    times the running product of ``1 + direction * step``. Chains are found in row blocks
    and the blocks are chained by their first rows and products, so no chain, however long,
    is handled as a whole.
    """
    step = hashed_step(seed) if step is None else step
    covered = F.col("segment").isNotNull()
    factor = F.when(covered, 1 + F.col("segment.direction") * step)
    rows = cover(row_index(readings, slices), segments).withColumns(
        {
            "factor": factor,
            "block": _block("row_idx"),
            # Level just before a chain is what the chain starts from.
            "start_level": F.when(~covered, F.col("reservoir_level_percentage")),
        }
    )
    w = Window.partitionBy(STATION, "block").orderBy("row_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # Covered rows since the last uncovered one in this block belong to one run.
    runs = rows.withColumns(
        {
            "run": F.sum(F.when(covered, 0).otherwise(1)).over(so_far),
            "base_in_block": F.last("start_level", True).over(so_far),
        }
    )
    in_run = Window.partitionBy(STATION, "block", "run").orderBy("row_idx")
    running = F.product("factor").over(in_run.rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("running", running)

    # Per block: the last uncovered level and the product of the factors after it.
    per_block = runs.groupBy(STATION, "block").agg(
        F.max_by("base_in_block", "row_idx").alias("base"),
        F.max_by("running", "row_idx").alias("tail"),
        F.max("run").alias("uncovered"),
        F.max_by(covered, "row_idx").alias("open"),
    )
    blocks = Window.partitionBy(STATION).orderBy("block")
    upto = blocks.rowsBetween(Window.unboundedPreceding, 0)
    tail = F.when(F.col("open"), F.col("tail")).otherwise(F.lit(1.0))
    chained = (
        per_block.withColumn("span", F.sum(F.when(F.col("uncovered") > 0, 1).otherwise(0)).over(upto))
        .withColumn("tail", tail)
        .withColumn("base", F.last("base", True).over(upto))
    )
    in_span = Window.partitionBy(STATION, "span").orderBy("block")
    carried = F.col("base") * F.product("tail").over(
        in_span.rowsBetween(Window.unboundedPreceding, 0)
    )
    entering = chained.withColumn("level_out", carried).select(
        STATION,
        "block",
        F.lag("level_out").over(blocks).alias("level_in"),
    )
    base = F.coalesce(F.col("base_in_block"), F.col("level_in"))
    value = lambda name, column: F.coalesce(F.col(f"segment.{name}"), F.col(column))
    flag = lambda name, column: F.when(
        F.col(f"segment.{name}").isNotNull(), 1
    ).otherwise(F.col(column))
    out = runs.join(entering, [STATION, "block"], "left").withColumns(
        {
            "reservoir_level_percentage": F.when(covered, base * F.col("running")).otherwise(
                F.col("reservoir_level_percentage")
            ),
            "input_flow_rate": value("set_flow", "input_flow_rate"),
            "pump_1": value("set_pump_1", "pump_1"),
            "pump_2": value("set_pump_2", "pump_2"),
            **_flags(readings, covered, flag),
        }
    )
    return out.drop(
        "segment", "factor", "block", "start_level", "run", "base_in_block", "running", "level_in"
    )


def _flags(readings: DataFrame, covered: Column, flag) -> dict[str, Column]:
    """Repair flags, for the flag columns the readings have.

    A hold copies a level without marking it.
    """
    walked = covered & (F.col("segment.direction") != 0)
    wanted = {
        "inputed_reservoir_level": F.when(walked, 1).otherwise(F.col("inputed_reservoir_level")),
        "inputed_input_flow_rate": flag("set_flow", "inputed_input_flow_rate"),
        "inputed_pump_status": flag("set_pump_1", "inputed_pump_status"),
    }
    return {name: c for name, c in wanted.items() if name in readings.columns}

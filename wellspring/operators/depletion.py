"""Power cut: how the reservoir runs empty with no inflow.

From an anchor the level falls by the forecast flow, in blocks of 24 hours. Each block uses
the forecast made at its own start, so blocks chain at 24-hour steps until one ends with
either level below zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.calendar import add_hours, epoch_hour
from ..schemas import STATION, TS
from ..sources.shipping import ship
from .forecast import FLOW, HISTORY_HOURS, HOURS
from .hourly import hour_range

LEVEL = "reservoir_level_percentage_last"
# Percent of the reservoir per L/s over one hour: 3600 s of flow in 1,000,000 L.
PERCENT_PER_FLOW = 3600 / 1_000_000 * 100
SHOWN_ROWS = 24

_LAST = [
    "last_flow_no_weather",
    "last_flow_weather",
    "last_level_no_weather",
    "last_level_weather",
]
_ADDED = [
    T.StructField("time_elapsed", T.IntegerType()),
    T.StructField("empty_after", T.IntegerType()),
    *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in _LAST],
]
#: Hours of anchors that are looked at one by one at a time.
TAIL_HOURS = 1 << 20


class _FirstAbove:
    """For positions and bars: the first entry from the position on that is above the bar.

    Maxima of stretches of 1, 2, 4, ... entries are skipped from long to short, for all at once.
    """

    def __init__(self, numbers: np.ndarray):
        self.maxima = [numbers]
        while 2 ** len(self.maxima) <= len(numbers):
            last, half = self.maxima[-1], 2 ** (len(self.maxima) - 1)
            self.maxima.append(np.maximum(last[:-half], last[half:]))

    def __call__(self, start: np.ndarray, bar: np.ndarray) -> np.ndarray:
        at, n = start.copy(), len(self.maxima[0])
        for power in range(len(self.maxima) - 1, -1, -1):
            maxima = self.maxima[power]
            fits = at + 2**power <= n
            skip = fits & (maxima[np.where(fits, at, 0)] <= bar)
            at += skip * 2**power
        return at


def _outcomes(hour: np.ndarray, level: np.ndarray, flows: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Outcomes of the anchors of one chain: its blocks in time, 24 flows each, both variants.

    A level at an hour is the anchor's level less the chain's falls since; so with ``bar`` as the
    anchor's level plus the falls before it, "below zero" is "running falls above the bar".
    """
    n = len(hour)
    block = np.arange(n)
    breaks = np.flatnonzero(np.diff(hour) != HOURS) + 1
    chain_end = np.append(breaks, n)[np.searchsorted(breaks, block, "right")]
    falls = [np.append(0.0, np.cumsum(f.ravel() * PERCENT_PER_FLOW)) for f in flows]
    search = [_FirstAbove(f) for f in falls]
    start = block * HOURS
    bars = [level + f[start] for f in falls]
    ends = [_FirstAbove(f[::HOURS])(block + 1, bar) for f, bar in zip(falls, bars, strict=True)]
    end = np.minimum(*ends)
    crossing = search[0](start + 1, bars[0])
    answered = np.flatnonzero((end <= chain_end) & (crossing <= end * HOURS))
    start, last, crossing = start[answered], end[answered] * HOURS, crossing[answered]
    bars = [bar[answered] for bar in bars]
    # Up to here one of the two levels is above zero in every hour; later hours are looked at.
    empty = [s(start + 1, np.nextafter(bar, -np.inf)) for s, bar in zip(search, bars, strict=True)]
    sure = np.minimum(np.maximum(*empty), last + 1)
    elapsed = sure - start - 1
    tail = last + 1 - sure
    cuts = np.searchsorted(np.cumsum(tail), np.arange(TAIL_HOURS, tail.sum() + TAIL_HOURS, TAIL_HOURS)) + 1
    for some in np.split(np.arange(len(tail)), cuts):
        who = np.repeat(some, tail[some])
        at = sure[who] + np.arange(len(who)) - np.repeat(np.cumsum(tail[some]) - tail[some], tail[some])
        above = (falls[0][at] < bars[0][who]) | (falls[1][at] < bars[1][who])
        elapsed += np.bincount(who, above, minlength=len(tail)).astype(elapsed.dtype)
    after = crossing - start
    shown = np.minimum(after, SHOWN_ROWS)
    hours = np.repeat(crossing - shown, shown) + np.arange(shown.sum()) - np.repeat(np.cumsum(shown) - shown, shown)
    flow = [f.ravel()[hours] for f in flows]
    levels = [np.repeat(bar, shown) - f[hours + 1] for f, bar in zip(falls, bars, strict=True)]
    return {
        "hour_no": hour[answered],
        "time_elapsed": elapsed,
        "empty_after": after,
        "shown": shown,
        **dict(zip(_LAST, (*flow, *levels), strict=True)),
    }


def _chain(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("hour_no")
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy().reshape(-1, HOURS)
    found = _outcomes(rows.column("hour_no").to_numpy(), rows.column("level").to_numpy(), (flat("falls_1"), flat("falls_2")))
    offsets = pa.array(np.append(0, np.cumsum(found["shown"])).astype(np.int32))
    return pa.table(
        {
            STATION: pa.array([key[0].as_py()] * len(found["hour_no"]), rows.schema.field(STATION).type),
            "hour_no": pa.array(found["hour_no"], pa.int64()),
            "time_elapsed": pa.array(found["time_elapsed"], pa.int32()),
            "empty_after": pa.array(found["empty_after"], pa.int32()),
            **{c: pa.ListArray.from_arrays(offsets, pa.array(found[c])) for c in _LAST},
        }
    )


def with_depletion(paths: DataFrame) -> DataFrame:
    """Add the outcome of the power cut to every row of ``with_paths``.

    ``time_elapsed`` counts the hours with either level above zero, ``empty_after`` is the
    hour of the first no-weather level below zero; both null where there is no answer: the
    forecasts end first, or only the weather level falls below zero.

    Blocks that follow each other begin at the same hour of the day, so a station has 24 chains
    of blocks, one row a day each. A chain is one group; running sums of its falls and a search
    for the first one above a bar answer all anchors of the chain at once, in steps that grow
    with the logarithm of its length. One shuffle, however long the series or a power cut.
    """
    ship(paths.sparkSession)
    rows = paths.withColumn("hour_no", epoch_hour(F.col(TS)).cast("long"))
    known = rows.filter(
        F.col("flow_no_weather").isNotNull() & F.col("flow_weather").isNotNull() & F.col(LEVEL).isNotNull()
    ).select(
        STATION,
        "hour_no",
        F.col(LEVEL).alias("level"),
        F.col("flow_no_weather").alias("falls_1"),
        F.col("flow_weather").alias("falls_2"),
    )
    shape = T.StructType([paths.schema[STATION], T.StructField("hour_no", T.LongType()), *_ADDED])
    answered = known.groupBy(STATION, F.pmod("hour_no", F.lit(HOURS)).alias("residue")).applyInArrow(_chain, shape)
    return rows.join(answered, [STATION, "hour_no"], "left").select(*paths.columns, *[f.name for f in _ADDED])


def time_to_empty(depleted: DataFrame) -> DataFrame:
    return depleted.filter(F.col("empty_after").isNotNull()).select(
        STATION, F.col(TS).alias("anchor"), "time_elapsed", "empty_after"
    )


def depletion_rows(silver: DataFrame, depleted: DataFrame) -> DataFrame:
    """The 24 hours up to the first level below zero; real hours fill up a shorter run."""
    answered = depleted.filter(F.col("empty_after").isNotNull())
    anchor = F.col(TS).alias("anchor")
    zipped = F.arrays_zip(*_LAST)
    simulated = answered.select(
        STATION,
        anchor,
        (F.col("empty_after") - F.size("last_flow_no_weather")).alias("skipped"),
        F.posexplode(zipped).alias("k", "v"),
    ).select(
        STATION,
        "anchor",
        add_hours(F.col("anchor"), F.col("skipped") + F.col("k") + 1).alias(TS),
        F.col("v.last_flow_no_weather").alias(f"{FLOW}_no_weather"),
        F.col("v.last_flow_weather").alias(f"{FLOW}_weather"),
        F.col("v.last_level_no_weather").alias(f"{LEVEL}_no_weather"),
        F.col("v.last_level_weather").alias(f"{LEVEL}_weather"),
        F.lit(True).alias("forecasted"),
    )
    wanted = (
        answered.filter(F.col("empty_after") < SHOWN_ROWS)
        .select(STATION, anchor, F.least(F.lit(HISTORY_HOURS), SHOWN_ROWS - F.col("empty_after")).alias("real"))
        .select(
            STATION,
            "anchor",
            F.explode(
                hour_range(add_hours(F.col("anchor"), 1 - F.col("real")), F.col("anchor"))
            ).alias(TS),
        )
    )
    real = wanted.join(silver.select(STATION, TS, FLOW, LEVEL), [STATION, TS]).select(
        STATION,
        "anchor",
        TS,
        *[F.col(c).alias(f"{c}_{v}") for c in (FLOW, LEVEL) for v in ("no_weather", "weather")],
        F.lit(False).alias("forecasted"),
    )
    return simulated.unionByName(real)

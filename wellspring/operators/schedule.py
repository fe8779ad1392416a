"""Pump schedules for the next 24 hours: rewards, best of given and of random candidates.

A schedule is an integer, bit ``h`` is the pump in hour ``h``. A state's candidates are an
array in the state's row, so scoring them needs no join and no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.calendar import epoch_hour
from ..schemas import STATION, TS
from ..sources.shipping import ship
from .forecast import HOURS
from .states import forecast_column

CAPACITY = 1_000_000.0  # liters
LOW, GOOD, HIGH = 0.2 * CAPACITY, 0.8 * CAPACITY, 0.95 * CAPACITY
SECONDS_PER_HOUR = 3600
#: Schedules that are drawn from one hash of 128 bits.
PER_DIGEST = 5


@dataclass(frozen=True)
class RewardRule:
    """``pumped``: which flow the pump status multiplies. ``graded``: the reward inside the
    band rises to 80 % and falls to 0 at 95 %. ``day_bonus``: +10 for hours 6 to 17.
    ``exact_depletion``: penalties for exactly 2, 1 and 0 hours to depletion."""

    pumped: str = "outflow"
    outflow_per_hour: float = SECONDS_PER_HOUR
    graded: bool = False
    day_bonus: bool = False
    exact_depletion: bool = False


REWARDS = {
    "flat": RewardRule(),
    "raw_outflow": RewardRule(outflow_per_hour=1.0),
    "graded_inflow": RewardRule("inflow", graded=True, day_bonus=True, exact_depletion=True),
    "graded": RewardRule(graded=True),
}


def schedule_bits(schedule: Column) -> Column:
    """The schedule as an array of 24 zeros and ones."""
    return F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), lambda h: _bit(schedule, h))


def _bit(schedule: Column, h: Column) -> Column:
    return F.call_function("shiftright", schedule, h).bitwiseAND(F.lit(1))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _band_reward(level: Column, rule: RewardRule) -> Column:
    outside = (level < LOW) | (level > HIGH)
    if not rule.graded:
        return F.when(outside, -50.0).otherwise(50.0)
    rising = level / GOOD * 50
    falling = (HIGH - level) / (0.15 * CAPACITY) * 50
    return F.when(outside, -50.0).when(level <= GOOD, rising).otherwise(falling)


def _pump_reward(hour: Column, rule: RewardRule) -> Column:
    """Reward for pumping in this hour of the day."""
    reward = F.when(hour.between(18, 21), -20.0).when(hour.between(0, 5), 20.0)
    if rule.day_bonus:
        reward = reward.when(hour.between(6, 17), 10.0)
    return reward.otherwise(0.0)


def _depletion_reward(hours_left: Column, rule: RewardRule) -> Column:
    if rule.exact_depletion:
        reward = F.when(hours_left == 2, -20.0).when(hours_left == 1, -50.0)
        reward = reward.when(hours_left == 0, -100.0)
    else:
        reward = F.when(hours_left < 2, -20.0)
    reward = reward.when(hours_left > 10, 100.0).when(hours_left > 6, 50.0)
    return reward.when(hours_left > 4, 20.0).otherwise(0.0)


def with_reward_inputs(states: DataFrame, reward: str = "flat") -> DataFrame:
    """Add what every candidate of a state shares, under ``search``.

    Start level, hourly inflow, the 24 outflows, the 24 pump rewards and the reward of the
    time to depletion.
    """
    rule = REWARDS[reward]
    hours = range(HOURS)
    flows = [F.col(forecast_column(h + 1)) * rule.outflow_per_hour for h in hours]
    pump = [_pump_reward(F.pmod(F.col("hour") + h, F.lit(HOURS)), rule) for h in hours]
    return states.withColumn(
        "search",
        F.struct(
            (F.col("reservoir_level_percentage_mean") * CAPACITY * 0.01).alias("level"),
            (F.col("input_flow_rate_mean") * SECONDS_PER_HOUR).alias("inflow"),
            F.array(*flows).alias("outflow"),
            F.array(*pump).alias("pump"),
            (_depletion_reward(F.col("time_to_depletion"), rule) * HOURS).alias("depletion"),
        ),
    )


def reward_of(schedule: Column, reward: str = "flat") -> Column:
    """Reward of a schedule in a row that has ``search``."""
    rule = REWARDS[reward]
    s = F.col("search")

    def hour(acc: Column, h: Column) -> Column:
        on = _bit(schedule, h)
        inflow, outflow = s["inflow"], F.get(s["outflow"], h)
        if rule.pumped == "outflow":
            outflow = outflow * on
        else:
            inflow = inflow * on
        return _let(
            acc["level"] + inflow - outflow,
            lambda level: F.struct(
                level.alias("level"),
                (
                    acc["reward"] + _band_reward(level, rule) + on * F.get(s["pump"], h)
                ).alias("reward"),
            ),
        )

    start = F.struct(s["level"].alias("level"), F.lit(0.0).alias("reward"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(HOURS - 1)), start, hour)
    return total["reward"] + s["depletion"]


def schedule_rewards(states: DataFrame, candidates: list[int], reward: str = "flat") -> DataFrame:
    """Every state with every schedule of a short given list: candidate number and reward."""
    listed = F.array(*[F.lit(c) for c in candidates])
    return (
        with_reward_inputs(states, reward)
        .select(STATION, TS, "search", F.posexplode(listed).alias("candidate_id", "schedule"))
        .withColumn("reward", reward_of(F.col("schedule"), reward))
        .drop("search")
    )


def best_schedule(states: DataFrame, candidates: list[int], reward: str = "flat") -> DataFrame:
    """The best of a short given list per state; among equals the first listed."""
    kind = states.select(F.array(*[F.lit(c) for c in candidates]).alias("c")).schema["c"].dataType.elementType
    listed = np.array([candidates], np.int64)
    return _best_of(states, reward, kind, lambda stations, hours: np.repeat(listed, len(stations), axis=0))


def _best_of(states: DataFrame, reward: str, kind: T.DataType, schedules: Callable[[list, list], np.ndarray]) -> DataFrame:
    """The best of each state's ``schedules`` (states by candidates, from stations and hours); among equals the first.

    A state is scored where it is, no row is shuffled. A batch of states is an array by candidates,
    taken through the 24 hours at once.
    """
    ship(states.sparkSession)
    rule = REWARDS[reward]
    inputs = with_reward_inputs(states, reward).select(STATION, TS, epoch_hour(F.col(TS)).alias("hour_no"), "search.*")
    shape = T.StructType(
        [
            *[inputs.schema[c] for c in (STATION, TS)],
            T.StructField("candidate_id", T.IntegerType()),
            T.StructField("schedule", kind),
            T.StructField("reward", T.DoubleType()),
        ]
    )

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            arrays = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, HOURS)
            unknown = lambda c: batch.column(c).is_null().to_numpy(zero_copy_only=False)
            tried = schedules(batch.column(STATION).to_pylist(), batch.column("hour_no").to_pylist())
            missing = batch.column("outflow").flatten().is_null().to_numpy(zero_copy_only=False).reshape(-1, HOURS)
            missing = (unknown("level") | unknown("inflow"))[:, None] | np.logical_or.accumulate(missing, axis=1)
            total = _rewards_of(tried, rule, numbers("level"), numbers("inflow"), arrays("outflow"), arrays("pump"), missing)
            total = total + numbers("depletion")[:, None]
            first = np.where(np.isnan(total), -np.inf, total).argmax(axis=1)
            rows = np.arange(len(first))
            found = pa.array(total[rows, first], from_pandas=True)
            taken = pa.array(tried[rows, first]).cast(pa.int32() if kind == T.IntegerType() else pa.int64())
            columns = [batch.column(STATION), batch.column(TS), pa.array(first, pa.int32()), taken, found]
            yield pa.record_batch(columns, shape.names)

    return inputs.mapInArrow(best, shape)


def drawn_schedules(seed: int, stations: list, hours: list, candidates: int) -> np.ndarray:
    """``candidates`` schedules for each state: 24 bits each, five of them from an md5 of seed, state and number."""
    digests = -(-candidates // PER_DIGEST)
    texts = (f"{seed}-{s}-{h}-{i}".encode() for s, h in zip(stations, hours, strict=True) for i in range(digests))
    drawn = np.frombuffer(b"".join(hashlib.md5(t).digest() for t in texts), np.uint8).reshape(len(stations), digests, 16)
    bits = drawn[:, :, : 3 * PER_DIGEST].reshape(len(stations), -1, 3)[:, :candidates].astype(np.int64)
    return bits[:, :, 0] << 16 | bits[:, :, 1] << 8 | bits[:, :, 2]


def _rewards_of(
    schedules: np.ndarray, rule: RewardRule, level: np.ndarray, inflow: np.ndarray, outflow: np.ndarray, pump: np.ndarray, missing: np.ndarray
) -> np.ndarray:
    """Rewards of states by schedules, hour by hour for all of them; ``reward_of`` without depletion.

    ``missing``: states by hours whose level is null. As in Spark, NaN is above any number.
    """
    level, total = np.repeat(level[:, None], schedules.shape[1], axis=1), np.zeros(schedules.shape)
    for h in range(HOURS):
        on = (schedules >> h) & 1
        out = outflow[:, h, None]
        level = level + inflow[:, None] - out * on if rule.pumped == "outflow" else level + inflow[:, None] * on - out
        inside = 50.0
        if rule.graded:
            inside = np.where(level <= GOOD, level / GOOD * 50, (HIGH - level) / (0.15 * CAPACITY) * 50)
        outside = ((level < LOW) | ~(level <= HIGH)) & ~missing[:, h, None]
        total = total + np.where(outside, -50.0, inside) + on * pump[:, h, None]
    return total


def best_random_schedule(
    states: DataFrame, candidates: int = 100, reward: str = "flat", seed: int = 42
) -> DataFrame:
    """The best of ``candidates`` random schedules of each state; among equals the first drawn."""
    drawn = lambda stations, hours: drawn_schedules(seed, stations, hours, candidates)
    return _best_of(states, reward, T.LongType(), drawn)

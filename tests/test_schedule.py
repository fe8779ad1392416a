import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wellspring.operators import schedule, states


@pytest.fixture(scope="module")
def some_states(spark):
    rng = np.random.default_rng(5)
    n = 40
    table = pd.DataFrame(
        {
            "station_id": np.arange(n, dtype="int32") % 3,
            "timestamp": pd.date_range("2024-01-01", periods=n, freq="h"),
            "hour": (np.arange(n) % 24).astype("int32"),
            "reservoir_level_percentage_mean": rng.uniform(10, 99, n),
            "input_flow_rate_mean": rng.uniform(0, 40, n),
            "time_to_depletion": rng.integers(0, 13, n).astype("int32"),
        }
    )
    for h in range(1, 25):
        table[states.forecast_column(h)] = rng.uniform(0, 60, n)
    return spark.createDataFrame(table).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def by_hand(bits, s, kind):
    """Hour by hour, for one schedule and one state."""
    level, total, cap = s["reservoir_level_percentage_mean"] * 10_000, 0.0, 1_000_000
    for h, on in enumerate(bits):
        out = s[states.forecast_column(h + 1)] * (1 if kind == "raw_outflow" else 3600)
        inflow = s["input_flow_rate_mean"] * 3600
        level += inflow * on - out if kind == "graded_inflow" else inflow - out * on
        if level < 0.2 * cap or level > 0.95 * cap:
            total -= 50
        elif not kind.startswith("graded"):
            total += 50
        else:
            total += level / (0.8 * cap) * 50 if level <= 0.8 * cap else (0.95 * cap - level) / (0.15 * cap) * 50
        hour = (s["hour"] + h) % 24
        if on:
            total += -20 if 18 <= hour <= 21 else 20 if hour <= 5 else 0
            total += 10 if kind == "graded_inflow" and 6 <= hour <= 17 else 0
        left = s["time_to_depletion"]
        low = {2: -20, 1: -50, 0: -100} if kind == "graded_inflow" else {1: -20, 0: -20}
        total += low.get(left, 100 if left > 10 else 50 if left > 6 else 20 if left > 4 else 0)
    return total


@pytest.mark.parametrize("kind", schedule.REWARDS)
def test_rewards(some_states, kind):
    candidates = [0, 16777215, 5592405, 12345]
    got = schedule.schedule_rewards(some_states, candidates, kind).toPandas()
    table = {(r.station_id, r.timestamp): r._asdict() for r in some_states.toPandas().itertuples()}
    bits = np.array([[(c >> h) & 1 for h in range(24)] for c in candidates], dtype=bool)
    assert len(got) == 160
    for r in got.itertuples():
        assert np.isclose(r.reward, by_hand(bits[r.candidate_id], table[r.station_id, r.timestamp], kind))


def test_best_schedule_takes_the_first_of_equals(some_states):
    best = schedule.best_schedule(some_states, [7, 7, 7]).toPandas()
    assert set(best["candidate_id"]) == {0}


def test_best_random_schedule(some_states):
    best = schedule.best_random_schedule(some_states, 30).collect()
    again = schedule.best_random_schedule(some_states.repartition(7), 30).collect()
    assert sorted(best) == sorted(again) and len({r.schedule for r in best}) > 20
    table = {(r.station_id, r.timestamp): r._asdict() for r in some_states.toPandas().itertuples()}
    for r in best:
        hand = by_hand([(r.schedule >> h) & 1 for h in range(24)], table[r.station_id, r.timestamp], "flat")
        assert np.isclose(r.reward, hand) and 0 <= r.schedule < 1 << 24
    few = {(r.station_id, r.timestamp): r.reward for r in schedule.best_random_schedule(some_states, 5).collect()}
    assert all(r.reward >= few[r.station_id, r.timestamp] for r in best)


@pytest.mark.parametrize("kind", schedule.REWARDS)
def test_best_schedule_is_scored_in_batches(spark, some_states, kind):
    """The best by ``reward_of``, nulls and NaN included, without an interpreted step per hour and candidate."""
    candidates = [0, 16777215, 5592405, 12345]
    i, level, flow = F.col("i"), "reservoir_level_percentage_mean", "input_flow_rate_mean"
    odd = some_states.withColumn("i", F.hour("timestamp")).withColumns(
        {
            level: F.when(i == 3, F.lit(float("nan"))).when(i != 4, F.col(level)),
            flow: F.when(i != 5, F.col(flow)),
            states.forecast_column(7): F.when(i != 6, F.col(states.forecast_column(7))),
        }
    )
    best = schedule.best_schedule(odd, candidates, kind)
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan
    assert best.schema["schedule"].dataType.simpleString() == "int"
    rewards = {}
    for r in schedule.schedule_rewards(odd, candidates, kind).collect():
        rewards.setdefault((r.station_id, r.timestamp), {})[r.candidate_id] = r.reward
    for r in best.collect():
        own = rewards[r.station_id, r.timestamp]
        first = min(own, key=lambda c: (own[c] is not None and -own[c], c))
        assert (r.candidate_id, r.schedule) == (first, candidates[first])
        assert r.reward == own[first] or np.isclose(r.reward, own[first])

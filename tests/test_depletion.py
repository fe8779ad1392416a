"""The power cut against a plain walk from every anchor."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import depletion
from wellspring.operators.depletion import LEVEL, PERCENT_PER_FLOW

START = dt.datetime(2024, 1, 1)
SCHEMA = f"station_id int, timestamp timestamp_ntz, {LEVEL} double, flow_no_weather array<double>, flow_weather array<double>, n string"


def walked(rows, station, hour):
    """time_elapsed, empty_after and the last rows of one anchor, or None."""
    levels = [rows[station, hour][0]] * 2
    elapsed, after, path, at = 0, None, [], hour
    while (station, at) in rows and rows[station, at][0] is not None and None not in rows[station, at][1:]:
        for k in range(24):
            flows = [f[k] for f in rows[station, at][1:]]
            levels = [level - f * PERCENT_PER_FLOW for level, f in zip(levels, flows)]
            elapsed += max(levels) > 0
            path.append((*flows, *levels))
            if after is None and levels[0] < 0:
                after = len(path)
        if min(levels) < 0:
            return None if after is None else (elapsed, after, path[max(0, after - 24) : after])
        at += 24
    return None


@pytest.mark.parametrize("kind", ["falling", "both ways", "still"])
def test_outcomes(spark, monkeypatch, kind):
    monkeypatch.setattr(depletion, "TAIL_HOURS", 100)
    rnd = random.Random(6)
    rows = {}
    for station in range(3):
        for hour in range(1500):
            if rnd.random() < 0.003:
                continue  # a chain breaks
            draw = {
                "falling": lambda: rnd.random() * 8,
                "both ways": lambda: rnd.gauss(0.4, 6),
                "still": lambda: rnd.choice([0.0] * 30 + [25.0, -25.0]),
            }[kind]
            flows = [[draw() for _ in range(24)] for _ in range(2)]
            level = rnd.choice([0.0, rnd.random() * 100, rnd.random() * 5])
            rows[station, hour] = (level if rnd.random() > 0.01 else None, *flows)
    rows[1, 700] = (50.0, None, None)
    made = [(s, START + dt.timedelta(hours=h), *v, "x") for (s, h), v in rows.items()]
    frame = spark.createDataFrame(made, SCHEMA).withColumn("level", F.lit("clash")).repartition(3)
    answers = 0
    for r in depletion.with_depletion(frame).collect():
        hour = round((r.timestamp - START).total_seconds() / 3600)
        known = rows[r.station_id, hour][0] is not None and None not in rows[r.station_id, hour][1:]
        want = walked(rows, r.station_id, hour) if known else None
        if want is None:
            assert r.time_elapsed is None and r.empty_after is None and r.last_flow_weather is None
        else:
            answers += 1
            assert (r.time_elapsed, r.empty_after) == want[:2]
            got = np.column_stack([r.last_flow_no_weather, r.last_flow_weather, r.last_level_no_weather, r.last_level_weather])
            assert np.allclose(got, np.array(want[2]), atol=1e-9)
    assert answers > 300


def test_no_rows(spark):
    assert depletion.with_depletion(spark.createDataFrame([], SCHEMA)).count() == 0


def test_first_above():
    rnd = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 100):
        numbers = rnd.integers(0, 50, n).astype(float)
        start, bar = rnd.integers(0, n + 1, 300), rnd.integers(-1, 51, 300).astype(float)
        want = [next((i for i in range(s, n) if numbers[i] > b), n) for s, b in zip(start, bar)]
        assert depletion._FirstAbove(numbers)(start, bar).tolist() == want

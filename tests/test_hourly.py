"""The fills of empty hours against loops that go hour by hour."""

import datetime as dt

import numpy as np
import pytest

from wellspring.operators import hourly
from wellspring.schemas import MEASURES, WEATHER

START = dt.datetime(2024, 3, 1)


def hours_table(spark, present, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in present:
        stats = [float(round(v, 2)) for v in rng.uniform(1, 90, 12)]
        weather = [float(round(v, 1)) for v in rng.uniform(1, 90, 3)]
        rows.append((7, START + dt.timedelta(hours=int(i)), *stats, 3600.0, 1800.0, 900.0, *weather))
    stats = [f"{m}_{s} double" for m in MEASURES for s in ("first", "last", "mean")]
    sums = ["duration_seconds_sum double", "pump_1_duration_sum double", "pump_2_duration_sum double"]
    schema = ", ".join(["station_id int", "timestamp timestamp_ntz", *stats, *sums, *[f"{c} double" for c in WEATHER]])
    return spark.createDataFrame(rows, schema)


GAPS = {
    "single": [0, 1, 3, 4],
    "runs": [0, 1, 2, 4, 5, 8, 9, 10, 14, 30, 31, 45],
    "near": [i for i in range(60) if i not in (20, 21, 30, 31, 32, 55)],
    "early": [0, 2, 5, 6, 7, 8, 9, 12, 14, 15, 16, 20],
    "random": sorted({0, 199} | set(np.random.default_rng(1).choice(200, 140, replace=False).tolist())),
}


@pytest.mark.parametrize("name", GAPS)
def test_fills_follow_the_hours(spark, name):
    grid = hourly.hourly_grid(hours_table(spark, GAPS[name]))
    filled = hourly.fill_recursive(hourly.fill_empty_hours(grid))
    before = grid.toPandas().sort_values("timestamp", ignore_index=True)
    after = filled.toPandas().sort_values("timestamp", ignore_index=True)
    n = GAPS[name][-1] + 1
    assert len(after) == n and after["inputed_row"].tolist() == [i not in GAPS[name] for i in range(n)]
    for m in MEASURES:
        first, last = before[f"{m}_first"].to_list(), before[f"{m}_last"].to_list()
        for i in range(n):
            if i not in GAPS[name]:
                continue
            j = i + 1
            while j < n and j not in GAPS[name]:
                first[j] = last[j - 1]
                last[j] = before[f"{m}_first"][j + 1] if j + 1 in GAPS[name] else first[j]
                j += 1
        assert np.allclose(after[f"{m}_first"], first) and np.allclose(after[f"{m}_last"], last)
    for c in WEATHER:
        values = before[c].to_list()
        for i in range(n):
            if i not in GAPS[name]:
                recent = [v for v in values[i - 4 : i - 1] if not np.isnan(v)] if i >= 4 else []
                values[i] = np.round(np.mean(recent), 2) if recent else np.nan
        assert np.allclose(after[c].astype(float), values, equal_nan=True)
    change = before["pressure_change"].to_list()
    for i in range(n):
        if i not in GAPS[name]:
            steps = np.diff(change[i - 11 : i - 1]) if i >= 11 else np.array([])
            steps = steps[~np.isnan(steps)]
            change[i] = steps.mean() if len(steps) else np.nan
    assert np.allclose(after["pressure_change"].astype(float), change, equal_nan=True)


def test_first_hour_is_dropped_and_change_is_kept(spark):
    silver = hourly.silver_from_hours(hours_table(spark, [0, 1, 2])).toPandas()
    assert len(silver) == 2 and silver["change_from_last_hour_output_flow_rate_mean"].notna().all()
    assert silver.shape[1] == 33

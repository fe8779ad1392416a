import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import segments
from wellspring.operators.slices import Slices


def plan(spark, rows):
    return spark.createDataFrame([(1, *r, None, None, None) for r in rows], segments.SEGMENTS)


def walked(df):
    return [r["reservoir_level_percentage"] for r in df.orderBy("event_id").collect()]


@pytest.mark.parametrize("block", [7, 10_000])
def test_walk_follows_the_segments_in_turn(spark, series, monkeypatch, block):
    monkeypatch.setattr(segments, "_BLOCK", block)
    levels = [float(v) for v in np.random.default_rng(0).uniform(40, 60, 60)]
    rows = [
        (3, 9, -1, 0.01, 0.02, 0),  # overlapped by the next one
        (8, 30, 1, 0.01, 0.02, 1),
        (31, 33, 0, 0.0, 0.0, 2),  # holds, directly after
        (40, 58, -1, 0.01, 0.02, 3),
    ]
    expected = list(levels)
    for start, end, direction, low, high, _ in rows:
        for i in range(start, end + 1):
            expected[i] = expected[i - 1] * (1 + direction * (low + (high - low) * (i % 10) / 10))
    step = F.col("segment.low") + (F.col("segment.high") - F.col("segment.low")) * (
        F.col("row_idx") % 10 / 10
    )
    got = walked(segments.walk_segments(series(levels), plan(spark, rows), step=step))
    assert np.allclose(got, expected)


def test_hashed_walk_is_bounded_and_stable(spark, series):
    readings, rows = series([50.0] * 40), [(10, 30, -1, 0.005, 0.008, 0)]
    first = walked(segments.walk_segments(readings, plan(spark, rows)))
    again = walked(segments.walk_segments(readings.repartition(5), plan(spark, rows)))
    assert first == again
    falls = 1 - np.array(first[10:31]) / np.array(first[9:30])
    assert ((falls > 0.00499) & (falls < 0.00801)).all() and first[31] == 50.0
    other = walked(segments.walk_segments(readings, plan(spark, rows), seed=7))
    assert other != first


def test_broken_plans_are_found(spark):
    good = [(3, 9, -1, 0.0, 0.1, 0), (8, 30, 1, 0.0, 0.1, 1)]
    early_end = [(3, 20, -1, 0.0, 0.1, 0), (8, 10, 1, 0.0, 0.1, 1)]
    reversed_ = [(3, 9, -1, 0.0, 0.1, 1), (10, 12, 1, 0.0, 0.1, 0)]
    count = lambda rows: segments.broken_segments(plan(spark, rows)).count()
    assert [count(good), count(early_end), count(reversed_)] == [0, 1, 1]

import pytest
from pyspark.sql import functions as F

from wellspring.functions.calendar import with_calendar_parts
from wellspring.operators import repair


def column(df, name):
    return [r[name] for r in df.orderBy("event_id").collect()]


@pytest.mark.parametrize(
    "levels, expected",
    [
        ([0.0, 50.0, 60.0], [0.0, 50.0, 60.0]),  # island at the start
        ([50.0, 60.0, 0.0], [50.0, 60.0, 0.0]),  # island at the end
        ([50.0, 0.0, 60.005], [50.0, 55.0025, 60.005]),  # one: mean, not rounded
        ([50.0, 0.0, 0.0, 51.0], [50.0, 50.33, 50.67, 51.0]),
        ([50.0, 0.0, 0.0, 0.0, 52.0], [50.0, 50.5, 51.0, 51.5, 52.0]),
        ([50.0, 0.0, 0.0, 0.0, 0.0, 52.0], [50.0, 0.0, 0.0, 0.0, 0.0, 52.0]),
        ([50.0, 0.0, None, 0.0, 52.0], [50.0, 0.0, None, 0.0, 52.0]),  # null neighbour
        ([50.0, 0.0, 60.0, 0.0, 70.0], [50.0, 55.0, 60.0, 65.0, 70.0]),  # two islands
    ],
)
def test_short_islands(series, levels, expected):
    filled = repair.fill_short_islands(series(levels))
    assert column(filled, "reservoir_level_percentage") == expected
    flags = [int(a != b) for a, b in zip(levels, expected)]
    assert column(filled, "inputed_reservoir_level") == flags


def test_pump_codes(series):
    coded = series([1.0] * 3, pump_1=[10, 90, 5], pump_2=[90, 10, 90])
    fixed = repair.set_up(coded)
    assert column(fixed, "pump_1") == [0, 1, 5] and column(fixed, "pump_2") == [1, 0, 1]


def test_profile_ties(series):
    # Profiles: pump 1 -> 10, pump 2 -> 20. Flow 15 is as far from both: both pumps on.
    odd = with_calendar_parts(
        series(
            [1.0] * 5,
            input_flow_rate=[10.0, 20.0, 40.0, 15.0, 11.0],
            pump_1=[1, 0, 1, 0, 0],
            pump_2=[0, 1, 1, 0, 0],
        )
    )
    fixed = repair.fix_pumps_off(odd)
    assert column(fixed, "pump_1") == [1, 0, 1, 1, 1]
    assert column(fixed, "pump_2") == [0, 1, 1, 1, 0]
    assert column(fixed, "inputed_pump_status") == [0, 0, 0, 1, 1]


def test_missing_profile_keeps_pumps_off_but_flags(series):
    odd = with_calendar_parts(
        series([1.0] * 2, input_flow_rate=[10.0, 15.0], pump_1=[1, 0], pump_2=[0, 0])
    )
    fixed = repair.fix_pumps_off(odd)
    assert column(fixed, "pump_1") == [1, 0] and column(fixed, "inputed_pump_status") == [0, 1]


def test_flow_from_profile(series):
    odd = with_calendar_parts(
        series([1.0] * 3, input_flow_rate=[10.111, 10.2, 0.0], pump_1=[1, 1, 1])
    )
    assert column(repair.fix_flow_zero(odd), "input_flow_rate")[2] == 10.16


def test_equal_timestamps_have_no_balance(series):
    same = series([50.0, 50.0, 49.0]).withColumn(
        "timestamp", F.lit("2024-01-01").cast("timestamp_ntz")
    )
    assert repair.mass_balance(same).count() == 0


def test_pressure(series):
    pressures = [0.0, 4.0, 0.0, 6.0] + [0.0] * 11
    filled = column(repair.fill_pressure(series([1.0] * 15, pressure=pressures)), "pressure")
    # Row 0 has nothing behind it: the mean of the trailing fill. Rows 13, 14 are too far
    # from any known value as well.
    trailing = [4.0, 4.0, 6.0] + [5.0] * 7 + [6.0, 6.0]
    station = round(sum(trailing) / len(trailing), 2)
    assert filled[0] == filled[13] == filled[14] == station
    assert filled[1:5] == [4.0, 4.0, 6.0, 5.0]

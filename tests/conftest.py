import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def series(spark):
    """Readings of one station from levels (and other columns), one reading a minute."""
    import datetime as dt

    def make(levels, station=1, **columns):
        start = dt.datetime(2024, 1, 1)
        names = ["input_flow_rate", "pressure", "pump_1", "pump_2"]
        defaults = {"input_flow_rate": 10.0, "pressure": 5.0, "pump_1": 1, "pump_2": 0}
        rows = []
        for i, level in enumerate(levels):
            values = [columns[n][i] if n in columns else defaults[n] for n in names]
            rows.append((station, i, start + dt.timedelta(minutes=i), level, *values))
        return spark.createDataFrame(
            rows,
            "station_id int, event_id long, timestamp timestamp_ntz, "
            "reservoir_level_percentage double, input_flow_rate double, pressure double, "
            "pump_1 int, pump_2 int",
        )

    return make

"""Cutting a busy station's series must not change any result."""

import pytest
from compare import differences
from pyspark.sql import functions as F

from wellspring.functions.calendar import with_calendar_parts
from wellspring.operators import fills, hourly, repair, segments, weather
from wellspring.operators.slices import Slices
from wellspring.plans import catalog
from wellspring.sources import events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def readings(spark):
    """One station with 1,000 readings, and a copy with a third of them."""
    one = with_calendar_parts(repair.set_up(events.bronze_readings(spark, SF)))
    quiet = one.filter(F.col("event_id") < 300).withColumn("station_id", F.lit(99))
    return one.unionByName(quiet)


@pytest.fixture(scope="module", params=[400, 15, 1])
def cut(readings, request):
    """Slices of days, of hours, and of less than an hour; the copy stays whole at first."""
    return Slices.fit(readings, max_rows=request.param)


def keyed(df):
    return df.drop("slice").toPandas()


def same(whole, sliced):
    assert differences(keyed(whole), keyed(sliced), tolerance=1e-7) == []


def test_fit_takes_busy_stations_only(readings):
    assert Slices.fit(readings).whole
    assert [r["station_id"] for r in Slices.fit(readings, max_rows=400).widths.collect()] == [0]
    assert Slices.fit(readings, max_rows=100).widths.count() == 2


def test_islands(readings, cut):
    same(repair.zero_islands(readings).drop("island"), repair.zero_islands(readings, cut).drop("island"))
    same(repair.fill_short_islands(readings), repair.fill_short_islands(readings, cut))


def test_profile_joins(readings, cut):
    """Salted cells give the same rows, and no cell of a busy station stays in one part."""
    fixed = lambda s: repair.fix_flow_zero(repair.fix_pumps_off(readings, s), s)
    same(fixed(Slices()), fixed(cut))


def test_a_busy_cell_is_split(spark):
    """Nine of ten readings in one cell: no reduce task gets more than about a slice."""
    one = with_calendar_parts(repair.set_up(events.bronze_readings(spark, SF)))
    hot = one.crossJoin(spark.range(30)).withColumn(
        "event_id", F.col("event_id") * 100 + F.col("id")
    ).withColumns({"day": F.when(F.col("id") < 27, 3).otherwise(F.col("day")), "hour": F.lit(5)}).drop("id")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        cut = Slices.fit(hot, max_rows=3000)
        joined = repair._with_profile(hot, cut)
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == hot.count() and max(sizes) < 3 * 3000
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)


def test_pressure_and_balance(readings, cut):
    same(repair.fill_pressure(readings), repair.fill_pressure(readings, cut))
    same(repair.mass_balance(readings), repair.mass_balance(readings, cut))


def test_row_index(readings, cut):
    same(segments.row_index(readings), segments.row_index(readings, cut))


def test_weather_fill(readings, cut, spark):
    joined = weather.attach_weather(readings, *catalog.weather_tables(spark, SF))
    sparse = joined.withColumn(
        "air_temp_c", F.when(F.dayofmonth("timestamp").isin(5, 6, 20), F.col("air_temp_c"))
    )
    columns = ["air_temp_c", "total_precip_mm"]
    same(fills.moving_average_fill(sparse, columns), fills.moving_average_fill(sparse, columns, cut))


def test_hours_in_one_pass(spark, cut):
    bronze = events.bronze_readings(spark, SF)
    tables = catalog.weather_tables(spark, SF)
    step_by_step = hourly.hourly_agg(
        hourly.combined_readings(repair.fix_readings(bronze), *tables)
    )
    same(step_by_step, hourly.hourly_from_bronze(bronze, *tables, cut))

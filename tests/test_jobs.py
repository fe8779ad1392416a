import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from wellspring.operators import forecast
from wellspring.plans import catalog, jobs
from wellspring.schemas import SILVER
from wellspring.sources import events
from wellspring.sources.tables import clean_parts, read_parts, read_table, write_table

SF = "/root/testdata/sf0.001"


def test_bronze_to_gold(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    write_table(events.bronze_readings(spark, SF), at("readings"))
    for name, df in zip(("w1", "w2"), events.weather_files(spark, SF)):
        write_table(df, at(name))
    write_table(events.weather_overlay_file(spark, SF), at("overlay"))
    jobs.silver_job(spark, at("readings"), (at("w1"), at("w2")), at("overlay"), at("silver"))
    silver = read_table(spark, at("silver"), SILVER)
    assert silver.count() == catalog.silver_table(spark, SF).count()
    jobs.training_job(spark, at("silver"), at("training"))
    assert len(read_table(spark, at("training")).columns) == 248
    jobs.answers_job(spark, at("silver"), at("gold"))
    assert read_table(spark, at("gold") + "/pump_peak_usage").count() == 2
    write_table(catalog.QUERIES["states_table"](spark, SF), at("states"))
    requests = spark.createDataFrame(
        [(0, 2024, 1, 15, 13), (0, 2030, 1, 15, 13)], "station_id int, year int, month int, day int, hour int"
    )
    jobs.schedules_job(spark, at("states"), requests, at("best"), candidates=6)
    best = read_table(spark, at("best")).collect()
    # 2030-01-15 is a Tuesday in week 3, 2024-01-15 a Monday in week 3.
    assert sorted(r["timestamp"] for r in best)[0] == dt.datetime(2024, 1, 15, 13)


def test_anchors_without_forecast(spark):
    silver = catalog.silver_table(spark, SF)
    rows = catalog.QUERIES["forecast_path"](spark, SF)
    anchors = silver.select("station_id", F.col("timestamp").alias("anchor"))
    missing = forecast.unmatched_anchors(anchors, rows)
    assert missing.count() == silver.count() - rows.count() // 24
    assert forecast.last_rows(rows, 5).count() == rows.count() // 24 * 5


def test_new_readings_rebuild_the_parts_of_their_stations(spark, tmp_path):
    at, sf = (lambda name: str(tmp_path / name)), "/root/testdata/sf0.01"
    bronze = events.bronze_readings(spark, sf)
    late = (F.col("station_id").isin(2, 7)) & (F.dayofmonth("DATA/HORA") >= 25)
    write_table(bronze.where(~late), at("readings"))
    write_table(bronze.where(late), at("new"))
    for name, df in zip(("w1", "w2"), events.weather_files(spark, sf)):
        write_table(df, at(name))
    inputs = (at("w1"), at("w2")), None
    jobs.silver_parts_job(spark, at("readings"), *inputs, at("silver"), parts=16)
    rows = lambda path: sorted(map(tuple, read_parts(spark, path, SILVER).collect()))
    before, files = rows(at("silver")), {f: f.stat().st_mtime_ns for f in Path(at("silver")).rglob("*.parquet")}
    write_table(bronze, at("all"))
    jobs.silver_parts_job(spark, at("all"), *inputs, at("silver"), parts=16, new_readings=at("new"))
    jobs.silver_parts_job(spark, at("all"), *inputs, at("whole"), parts=16)
    assert rows(at("silver")) == rows(at("whole")) != before
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())
    clean_parts(spark, at("silver"))
    assert rows(at("silver")) == rows(at("whole"))
    kept = [f for f in files if f.exists()]
    stations = {r[0] for r in spark.read.parquet(*map(str, kept)).select("station_id").distinct().collect()}
    assert 2 not in stations and 7 not in stations and len(stations) >= 6


def test_requests_read_the_days_they_need(spark, tmp_path):
    start = dt.datetime(2023, 1, 1)
    hours = spark.range(2 * 400 * 24).select(
        (F.col("id") % 2).cast("int").alias("station_id"),
        (F.lit(start) + F.make_dt_interval(F.lit(0), (F.col("id") / 2).cast("int"))).cast("timestamp_ntz").alias("timestamp"),
    )
    parts = {c: getattr(F, f)("timestamp") for c, f in (("year", "year"), ("month", "month"), ("day", "dayofmonth"))}
    write_table(hours.withColumns(parts), at := str(tmp_path / "hours"), ("year", "month"))
    anchors = [(0, dt.datetime(2023, 5, 2, 3)), (1, dt.datetime(2024, 1, 1, 0)), (1, dt.datetime(2030, 1, 1, 0))]
    near = forecast.near_anchors(
        spark.read.parquet(at), spark.createDataFrame(anchors, "station_id int, anchor timestamp_ntz"), before=48, after=1
    )
    got = {(r.station_id, r.timestamp.date()) for r in near.collect()}
    day = dt.date
    assert got == {(0, day(2023, 4, 30)), (0, day(2023, 5, 1)), (0, day(2023, 5, 2)), (1, day(2023, 12, 30)), (1, day(2023, 12, 31)), (1, day(2024, 1, 1))}
    assert near.count() == 6 * 24
    scan = near._jdf.queryExecution().optimizedPlan().toString()
    explained = near._sc._jvm.PythonSQLUtils.explainString(near._jdf.queryExecution(), "formatted")
    filters = next(line for line in explained.splitlines() if line.startswith("PartitionFilters"))
    assert "year" in filters and "month" in filters and "Filter" in scan

"""Layers in buckets: the same rows, and plans without a shuffle above the scan."""

from wellspring.operators import depletion, features, forecast
from wellspring.plans import catalog
from wellspring.sources import tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_over_silver_need_no_shuffle(spark):
    silver = catalog.silver_table(spark, SF)
    assert "Exchange" in plan(features.training_set(spark.createDataFrame(silver.collect(), silver.schema)))
    for df in (
        features.training_set(silver),
        features.lag_features(silver),
        catalog.paths(spark, SF),
        catalog.searchable(spark, SF),
    ):
        assert "Exchange" not in plan(df)
    # Blocks go on to their chains, by station and hour of the day: one shuffle for windows, none for states.
    assert plan(depletion.with_depletion(catalog.paths(spark, SF))).count("Exchange") <= 2
    pruned = silver.where("year = 2024 and month = 2").select("timestamp")
    assert "month" in plan(pruned).split("PartitionFilters: [")[1].split("]")[0]


def test_another_session_declares_the_buckets(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(500).selectExpr("cast(id % 7 as int) as station_id", "id as timestamp", "cast(id % 3 as int) as month")
    tables.write_buckets(rows, path, "station_id", "timestamp", ("month",), 4)
    spark.sql(f"DROP TABLE {tables._table_name(path + '/' + tables.current_version(spark, path)[0])}")
    declared = tables.read_buckets(spark, path)
    assert sorted(map(tuple, declared.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert "Exchange" not in plan(declared.groupBy("station_id").count())


def test_partitions_grow_with_the_input(spark, tmp_path, monkeypatch):
    """A task's share stays the same: buckets and shuffle partitions follow the input's bytes."""
    size, name = 1 << 16, "spark.sql.shuffle.partitions"
    path = f"{tmp_path}/events.parquet"
    spark.range(20_000).write.parquet(path)
    before = {c: spark.conf.get(c) for c in (name, "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        tables.spread(spark, path)
        assert spark.conf.get(name) == before[name]  # a small input changes nothing
        monkeypatch.setattr(tables, "BUCKET_BYTES", 1 << 10)
        tables.spread(spark, path)
        assert int(spark.conf.get(name)) > 40
        assert tables.bucket_count(spark, size) == 64
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def test_outcomes_join_hours_where_they_lie(spark):
    """Hours of a station's bucket are not shuffled to meet their outcomes, nor to be stored."""
    way = catalog.paths(spark, SF)
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    outcomes = lambda: depletion.with_depletion(catalog.paths(spark, SF)).hint("merge")
    with tables.joins_in_place(spark):
        assert spark.conf.get(name) == "false"
        in_place = outcomes()
        shuffles = [line for line in plan(in_place).splitlines() if "Exchange" in line]
        assert len(shuffles) == 1  # of the outcomes alone
        rows = sorted(map(str, in_place.collect()))
    assert spark.conf.get(name) == before
    assert rows == sorted(map(str, outcomes().collect()))
    stored = catalog.depleted(spark, SF)
    assert set(way.columns) - set(stored.columns) == {"change_no_weather", "change_weather", "flow_weather"}

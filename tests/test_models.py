import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.operators import boosting, depletion, features, forecast, models
from wellspring.plans import catalog
from wellspring.sources import tables

SF = "/root/testdata/sf0.001"
QUICK = {"rounds": 3, "depth": 2}
KEEP = ("output_flow_rate_mean", "reservoir_level_percentage_last")


@pytest.fixture(scope="module")
def training(spark):
    return features.training_set(catalog.silver_table(spark, SF), keep=KEEP).persist()


@pytest.fixture(scope="module")
def fitted(training):
    return models.train_all(models.time_split(training, catalog.TEST_FROM)[0], **QUICK)


def test_feature_names():
    assert len(features.feature_names()) == 222 and len(features.feature_names(False)) == 171
    assert len(models.positions("weather")) == 222 and len(models.positions("no_weather")) == 171
    assert len(models.specs()) == 48 and {(s.rounds, s.depth, s.rate) for s in models.specs()} == {(100, 6, 0.3)}


def test_blocks_do_not_change_features(spark):
    silver = catalog.silver_table(spark, SF)
    few = ["72_hours_ago_temperature", "48_hours_rolling_humidity", "target_24"]
    table = lambda b: sorted(map(tuple, features.training_set(silver, b).select("timestamp", *few).collect()))
    assert table(100) == table(features.BLOCK_HOURS)


def test_models_reload_and_report(spark, training, fitted, tmp_path):
    train, test = models.time_split(training, catalog.TEST_FROM)
    per_round = models.error_per_round(fitted, train).collect()
    assert len(per_round) == 48 * QUICK["rounds"]
    mae = {(r.variant, r.horizon, r["round"]): r.mae for r in per_round}
    assert all(mae[v, h, 3] < mae[v, h, 1] for v in models.VARIANTS for h in features.HORIZONS)
    models.save_models(spark, fitted, str(tmp_path))
    again = models.load_models(spark, str(tmp_path))
    rows = lambda m: sorted(map(tuple, models.evaluation_rows(m, test).collect()))
    assert rows(fitted) == rows(again)
    report = {(r.variant, r.horizon): r for r in models.error_report(fitted, test).collect()}
    assert len(report) == 48
    for name, target, column in (("weather_7", "target_7", "mae"), ("weather_7", "target_1", "mae_target_1")):
        got = models.predict(fitted, test, (target,)).agg(F.avg(F.abs(F.col(target) - F.col(name)))).first()[0]
        assert report["weather", 7][column] == pytest.approx(got, abs=0.006)


def test_search_ranks_every_point(training):
    """Errors read off a longer fit are those of a fit of its own."""
    grid = {"rounds": [1, 2], "depth": [1, 3], "rate": [0.1, 0.5]}
    ranked = models.grid_search(training, "no_weather", 1, grid, folds=2).collect()
    assert len(ranked) == 8 and [r.place for r in ranked] == list(range(1, 9))
    assert [r.mae for r in ranked] == sorted(r.mae for r in ranked)
    rows = models.time_folds(training, 2).withColumnRenamed("fold_block", "fold")
    borders = boosting.bin_borders(rows, models.FEATURES)
    table = models.binned_rows(rows, borders, ("fold",))
    maes = []
    for fold in (1, 2):
        spec = boosting.Spec("one", models.positions("no_weather"), 0, 3, 0.5, 1)
        forest = boosting.fit(table.where(F.col("fold") < fold), [spec], models.FEATURES, borders)
        maes.append(boosting.errors_by_round(table.where(F.col("fold") == fold), forest).first().mae)
    got = next(r.mae for r in ranked if (r.rounds, r.depth, r.rate) == (1, 3, 0.5))
    assert got == pytest.approx(np.mean(maes))


def test_trained_forecast_runs_into_depletion(training, fitted):
    _, test = models.time_split(training, catalog.TEST_FROM)
    paths = forecast.with_paths(test.join(models.predicted_changes(fitted, test), ["station_id", "timestamp"]))
    assert forecast.forecast_rows(paths).count() == 24 * test.count()
    assert depletion.time_to_empty(depletion.with_depletion(paths)).count() > 0


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path):
    path = f"{tmp_path}/table"
    rows = lambda: sorted(r.id for r in tables.read_version(spark, path)[0].collect())
    with pytest.raises(FileNotFoundError):
        rows()
    tables.write_version(spark.range(3), path, "a")
    broken = spark.range(9).select(F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.write_version(broken, path, "b")
    assert rows() == [0, 1, 2] and tables.current_version(spark, path)[1] == "a"
    tables.write_version(spark.range(5), path, "c")
    assert rows() == [0, 1, 2, 3, 4]


def test_two_writers_leave_one_whole_version(spark, tmp_path):
    path = f"{tmp_path}/table"
    writers = [threading.Thread(target=tables.write_version, args=(spark.range(n, n + 50), path, str(n))) for n in (0, 100)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    table, label = tables.read_version(spark, path)
    assert sorted(r.id for r in table.collect()) == list(range(int(label), int(label) + 50))


def test_layers_are_named_by_files_and_code(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.range(10).write.parquet(path)
    source = lambda: spark.read.parquet(path)
    built = []

    def layer(n):
        def build():
            built.append(n)
            return spark.range(n)

        return tables.stored_once("layer_test", source(), build).count()

    assert layer(3) == 3 and layer(4) == 3 and built == [3]
    spark.range(20).write.mode("overwrite").parquet(path)
    assert layer(5) == 5 and built == [3, 5]
    plan = source().select(F.col("_metadata.file_path"))._jdf.queryExecution().optimizedPlan().toString()
    assert "id#" not in plan.split("Relation")[0]

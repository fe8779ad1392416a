"""The registered queries: each one runs an operator over the whole ``events`` table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.calendar import with_calendar_parts
from ..functions.numeric import tidy
from ..operators import (
    answers,
    boosting,
    depletion,
    features,
    fills,
    forecast,
    hourly,
    metrics,
    models,
    repair,
    schedule,
    segments,
    states,
    weather,
)
from ..operators.slices import Slices
from ..schemas import EVENT, FLOW_CHANGE, STATION, TS, WEATHER
from ..sources import events
from ..sources.stand_in import with_seasonal_changes
from ..sources.tables import current_version, joins_in_place, layer_path, spread, stored_once, use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

READING_KEY = [STATION, EVENT, TS]
# Eight schedules to score: off, on, alternating, halves, nights, and mixed ones.
CANDIDATES = [0, 16777215, 5592405, 4095, 16773120, 63, 12345678, 9876543]
TEST_FROM = "2024-01-21 00:00:00"
# Means of whole numbers, alike to the last bit in any engine: rounding could only part them.
EXACT = set(features.rolling_weather_names())


def query(build: Query) -> Query:
    """Register ``build``; doubles come out rounded so that engines can be compared."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(spread(use_utc(spark), f"{sf_dir}/events.parquet"), sf_dir))

    QUERIES[build.__name__] = run
    return run


def rounded(df: DataFrame) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    doubles -= EXACT
    return df.select(*[tidy(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])


# --- inputs shared by the queries -------------------------------------------------------


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.bronze_readings(spark, sf_dir)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_calendar_parts(repair.set_up(bronze(spark, sf_dir)))


def slices(spark: SparkSession, sf_dir: str, max_rows: int = 5_000_000) -> Slices:
    """Busy stations of this table."""
    return Slices.fit(repair.set_up(bronze(spark, sf_dir)), max_rows)


def weather_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = weather.weather_union(*events.weather_files(spark, sf_dir))
    return base, weather.preprocess_weather(events.weather_overlay_file(spark, sf_dir))


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = slices(spark, sf_dir)
    repaired = repair.fix_readings(bronze(spark, sf_dir), slices=cut)
    return hourly.combined_readings(repaired, *weather_tables(spark, sf_dir), cut)


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.hourly_from_bronze(
        bronze(spark, sf_dir), *weather_tables(spark, sf_dir), slices(spark, sf_dir)
    )


def _layer(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """A stored layer in buckets by station: windows over it and what states join need no shuffle."""
    return stored_once(name, events.events(spark, sf_dir), build, partition_by, (STATION, TS))


def silver_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver layer as a stored table.

    What comes after silver reads it as a table, as the jobs do. The ``silver`` query itself
    always runs from the readings.
    """
    build = lambda: hourly.silver_from_hours(hours(spark, sf_dir))
    return _layer(spark, sf_dir, "silver", build, ("year", "month"))


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    build = lambda: features.training_set(silver_table(spark, sf_dir))
    return _layer(spark, sf_dir, "training", build)


def trained_folder(spark: SparkSession, sf_dir: str) -> str:
    """Where the 48 models of this table are: fitted with full settings when first asked for."""
    folder = layer_path("models", events.events(spark, sf_dir))
    if current_version(spark, f"{folder}/borders") is None:
        before, _ = models.time_split(training_table(spark, sf_dir), TEST_FROM)
        models.save_models(spark, models.train_all(before), folder)
    return folder


def trained(spark: SparkSession, sf_dir: str) -> boosting.Forest:
    return models.load_models(spark, trained_folder(spark, sf_dir))


def test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.time_split(training_table(spark, sf_dir), TEST_FROM)[1]


def model_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver hours with the flow paths that the models predict, where all features are known."""
    changes = models.predicted_changes(trained(spark, sf_dir), training_table(spark, sf_dir))
    return forecast.with_paths(silver_table(spark, sf_dir).join(changes, [STATION, TS], "left"))


def model_depleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir, "model_depleted", model_paths(spark, sf_dir))


def paths(spark: SparkSession, sf_dir: str, coupled: bool = True) -> DataFrame:
    return forecast.with_paths(with_seasonal_changes(silver_table(spark, sf_dir)), coupled)


def depleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the power cut as a stored table; ``time_to_empty`` always runs them anew."""
    return _outcomes(spark, sf_dir, "depleted", paths(spark, sf_dir))


def _outcomes(spark: SparkSession, sf_dir: str, name: str, flows: DataFrame) -> DataFrame:
    """``with_depletion`` as a layer, without the arrays that only lead to it; hours stay in their stations' buckets."""
    build = lambda: depletion.with_depletion(flows).drop("change_no_weather", "change_weather", "flow_weather")
    with joins_in_place(spark):
        return _layer(spark, sf_dir, name, build)


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.search_states(states.states(depleted(spark, sf_dir)))


# --- readings ---------------------------------------------------------------------------


@query
def recode_calendar(spark, sf_dir):
    return readings(spark, sf_dir)


@query
def pump_profile(spark, sf_dir):
    return repair.pump_profile(readings(spark, sf_dir))


@query
def fix_pumps_off(spark, sf_dir):
    cut = slices(spark, sf_dir)
    return repair.fix_pumps_off(readings(spark, sf_dir), cut).select(
        *READING_KEY, "pump_1", "pump_2", "inputed_pump_status"
    )


@query
def fix_flow_zero(spark, sf_dir):
    cut = slices(spark, sf_dir)
    return repair.fix_flow_zero(repair.fix_pumps_off(readings(spark, sf_dir), cut), cut).select(
        *READING_KEY, "input_flow_rate", "inputed_input_flow_rate"
    )


@query
def zero_islands(spark, sf_dir):
    return repair.zero_islands(readings(spark, sf_dir), slices(spark, sf_dir)).drop("island")


@query
def fill_short_islands(spark, sf_dir):
    filled = repair.fill_short_islands(readings(spark, sf_dir), slices(spark, sf_dir))
    return filled.select(*READING_KEY, "reservoir_level_percentage", "inputed_reservoir_level")


@query
def fill_short_islands_sliced(spark, sf_dir):
    """As above, with every station cut into slices of a few hundred readings."""
    filled = repair.fill_short_islands(readings(spark, sf_dir), slices(spark, sf_dir, 300))
    return filled.select(*READING_KEY, "reservoir_level_percentage", "inputed_reservoir_level")


@query
def fill_pressure(spark, sf_dir):
    filled = repair.fill_pressure(readings(spark, sf_dir), slices(spark, sf_dir))
    return filled.select(*READING_KEY, "pressure")


@query
def mass_balance(spark, sf_dir):
    return repair.mass_balance(readings(spark, sf_dir), slices(spark, sf_dir)).select(
        *READING_KEY,
        "reservoir_level_liters",
        "time_passed_seconds",
        "total_liters_entered",
        "effective_liters_entered",
        "total_liters_out",
        "output_flow_rate",
    )


REPAIRED = [
    *READING_KEY,
    "input_flow_rate",
    "reservoir_level_percentage",
    "pressure",
    "pump_1",
    "pump_2",
    "output_flow_rate",
]


@query
def fix_readings(spark, sf_dir):
    repaired = repair.fix_readings(bronze(spark, sf_dir), slices=slices(spark, sf_dir))
    return repaired.select(*REPAIRED)


def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments for every station, three per hundred readings: a fall, a rise that takes
    over the end of the fall, and a hold."""
    counts = readings(spark, sf_dir).groupBy(STATION).agg(F.count("*").alias("n"))
    j = F.col("j")
    walk = lambda start, end, direction, low, high, seq, flow=None, pumps=(None, None): F.struct(
        (j * 100 + start).alias("start_row"),
        (j * 100 + end).alias("end_row"),
        F.lit(direction).alias("direction"),
        F.lit(low).alias("low"),
        F.lit(high).alias("high"),
        (j * 3 + seq).cast("int").alias("seq"),
        F.lit(flow).cast("double").alias("set_flow"),
        F.lit(pumps[0]).cast("int").alias("set_pump_1"),
        F.lit(pumps[1]).cast("int").alias("set_pump_2"),
    )
    three = F.array(
        walk(10, 29, -1, 0.005, 0.008, 0),
        walk(25, 39, 1, 0.003, 0.006, 1, 61.03),
        walk(40, 42, 0, 0.0, 0.0, 2, pumps=(1, 0)),
    )
    per_hundred = counts.withColumn("j", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / 100))))
    return per_hundred.select(STATION, F.inline(three))


@query
def fix_readings_with_segments(spark, sf_dir):
    plan, cut = repair_plan(spark, sf_dir), slices(spark, sf_dir)
    return repair.fix_readings(bronze(spark, sf_dir), plan, cut).select(*REPAIRED)


def _walked(spark: SparkSession, sf_dir: str, step: Column | None) -> DataFrame:
    filled = repair.fill_short_islands(readings(spark, sf_dir), slices(spark, sf_dir))
    return segments.walk_segments(
        filled, repair_plan(spark, sf_dir), slices(spark, sf_dir), step=step
    ).select(*READING_KEY, "row_idx", "reservoir_level_percentage", "input_flow_rate", "inputed_reservoir_level")


@query
def segment_walk(spark, sf_dir):
    low, high = F.col("segment.low"), F.col("segment.high")
    return _walked(spark, sf_dir, low + (high - low) * ((F.col("row_idx") * 37 % 100) / 100.0))


@query
def segment_walk_hashed(spark, sf_dir):
    return _walked(spark, sf_dir, None)


# --- weather ----------------------------------------------------------------------------


@query
def weather_clean(spark, sf_dir):
    files = [*events.weather_files(spark, sf_dir), events.weather_overlay_file(spark, sf_dir)]
    first, *others = [
        weather.preprocess_weather(f).withColumn("file", F.lit(i)) for i, f in enumerate(files)
    ]
    return functools.reduce(DataFrame.unionByName, others, first)


@query
def weather_union(spark, sf_dir):
    return weather_tables(spark, sf_dir)[0]


@query
def weather_local_hours(spark, sf_dir):
    """Weather hours moved from UTC to the readings' local time, three hours behind."""
    return weather.weather_union(*events.weather_files(spark, sf_dir), utc_offset_hours=-3)


@query
def weather_duplicate_hours(spark, sf_dir):
    """Hours that the weather files and the complementary one both have."""
    base, overlay = weather_tables(spark, sf_dir)
    return weather.duplicate_hours(base.unionByName(overlay))


@query
def weather_overlay(spark, sf_dir):
    joined = weather.attach_weather(readings(spark, sf_dir), *weather_tables(spark, sf_dir))
    return joined.select(*READING_KEY, *WEATHER)


@query
def null_profile(spark, sf_dir):
    joined = weather.attach_weather(readings(spark, sf_dir), *weather_tables(spark, sf_dir))
    return fills.null_profile(joined, ["input_flow_rate", "pressure", *WEATHER])


@query
def moving_average_fill(spark, sf_dir):
    joined = weather.attach_weather(readings(spark, sf_dir), *weather_tables(spark, sf_dir))
    filled = fills.moving_average_fill(joined, WEATHER, slices(spark, sf_dir))
    return filled.select(*READING_KEY, *WEATHER)


@query
def combined_readings(spark, sf_dir):
    return combined(spark, sf_dir)


# --- hourly -----------------------------------------------------------------------------


@query
def hourly_agg(spark, sf_dir):
    return hourly.hourly_agg(combined(spark, sf_dir))


@query
def hourly_one_pass(spark, sf_dir):
    return hours(spark, sf_dir)


@query
def hourly_grid(spark, sf_dir):
    return hourly.hourly_grid(hours(spark, sf_dir))


@query
def hourly_fill(spark, sf_dir):
    return hourly.fill_empty_hours(hourly.hourly_grid(hours(spark, sf_dir)))


@query
def silver(spark, sf_dir):
    return hourly.silver_from_hours(hours(spark, sf_dir))


@query
def silver_sliced(spark, sf_dir):
    """As ``silver``, with every station cut into slices of a few hundred readings."""
    tables = weather_tables(spark, sf_dir)
    cut = slices(spark, sf_dir, 300)
    return hourly.silver_from_hours(hourly.hourly_from_bronze(bronze(spark, sf_dir), *tables, cut))


# --- answers ----------------------------------------------------------------------------


@query
def hour_profile(spark, sf_dir):
    return answers.hour_profile(silver_table(spark, sf_dir))


@query
def hour_profile_real(spark, sf_dir):
    return answers.hour_profile(silver_table(spark, sf_dir), with_imputed=False)


@query
def pump_peak_usage(spark, sf_dir):
    return answers.pump_peak_usage(silver_table(spark, sf_dir))


@query
def pump_peak_share(spark, sf_dir):
    return answers.pump_peak_share(answers.pump_peak_usage(silver_table(spark, sf_dir)))


@query
def weather_corr(spark, sf_dir):
    return answers.weather_corr(silver_table(spark, sf_dir))


# --- features and models ----------------------------------------------------------------


def _only(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(STATION, TS, *names)


@query
def lag_features(spark, sf_dir):
    names = [n for n in features.feature_names() if "_hours_ago" in n]
    return _only(features.lag_features(silver_table(spark, sf_dir)), names)


@query
def rolling_features(spark, sf_dir):
    names = [n for n in features.feature_names() if "_rolling_" in n]
    return _only(features.rolling_features(silver_table(spark, sf_dir)), names)


@query
def targets(spark, sf_dir):
    names = [features.target_name(h) for h in features.HORIZONS]
    return _only(features.targets(silver_table(spark, sf_dir)), names)


@query
def training_set(spark, sf_dir):
    return features.training_set(silver_table(spark, sf_dir))


def _naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow change 24 hours before as the prediction of this hour's."""
    hours_ = features.with_hour_halo(silver_table(spark, sf_dir), before=24, after=0)
    predicted = F.element_at(forecast.lag_changes(FLOW_CHANGE, 25), 1)
    return hours_.withColumn("predicted", predicted).filter("own")


@query
def regression_metrics(spark, sf_dir):
    return metrics.regression_metrics(_naive(spark, sf_dir), FLOW_CHANGE, "predicted", (STATION,))


@query
def raw_errors(spark, sf_dir):
    return metrics.raw_errors(_naive(spark, sf_dir), FLOW_CHANGE, "predicted", (STATION,))


@query
def time_folds(spark, sf_dir):
    return metrics.time_folds(silver_table(spark, sf_dir)).select(STATION, TS, "fold_block")


@query
def evaluation_targets(spark, sf_dir):
    """What the evaluation table holds besides predictions: real hours of the test period."""
    _, after = models.time_split(training_table(spark, sf_dir), TEST_FROM)
    return models.evaluation_keys(after)


@query
def time_split(spark, sf_dir):
    before, after = models.time_split(training_table(spark, sf_dir), TEST_FROM)
    counts = F.count("*").alias("hours"), F.min(TS).alias("first"), F.max(TS).alias("last")
    parts = [df.groupBy(STATION).agg(*counts).withColumn("part", F.lit(p)) for p, df in (("train", before), ("test", after))]
    return parts[0].unionByName(parts[1])


def _root(spark: SparkSession, sf_dir: str, variants: tuple[str, ...]) -> tuple[DataFrame, list[boosting.Spec]]:
    before, _ = models.time_split(training_table(spark, sf_dir), TEST_FROM)
    borders = boosting.bin_borders(before, models.FEATURES)
    specs = models.specs(variants=variants)
    sums, _ = boosting.root_sums(models.binned_rows(before, borders), specs, models.FEATURES, models.target_rows(before))
    return sums, specs


def _named(specs: list[boosting.Spec]) -> tuple[Column, Column, Column]:
    """Variant, horizon and feature of the columns ``model`` and ``feature``."""
    pick = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), F.col(at) + 1)
    variants, horizons = zip(*[s.name.rsplit("_", 1) for s in specs])
    return (
        pick(variants, "model").alias("variant"),
        pick(map(int, horizons), "model").alias("horizon"),
        pick(models.FEATURES, "feature").alias("feature"),
    )


@query
def binned_sums(spark, sf_dir):
    """What the first tree of every horizon is grown from: rows and gradients up to each bin."""
    sums, specs = _root(spark, sf_dir, ("weather",))
    _, horizon, feature = _named(specs)
    each = F.posexplode(F.slice(F.arrays_zip("n", "g"), 1, boosting.BINS - 1)).alias("bar", "sums")
    rows = sums.select("model", "feature", each).select(horizon, feature, "bar", "sums.*")
    return rows.withColumnsRenamed({"n": "left_rows", "g": "left_gradient"})


@query
def root_splits(spark, sf_dir):
    """The first split of all 48 models."""
    sums, specs = _root(spark, sf_dir, tuple(models.VARIANTS))
    found = boosting.best_of(sums).withColumn("feature", -F.col("split.feature"))
    return found.select(
        *_named(specs),
        (-F.col("split.bar")).alias("bar"),
        F.col("split.n").alias("left_rows"),
        F.col("split.g").alias("left_gradient"),
        F.col("whole").alias("gradient"),
    )


@query
def model_forest(spark, sf_dir):
    """The fitted models as a table: 100 rounds, depth 6, 24 horizons, with and without weather."""
    return models.forest_table(spark, trained_folder(spark, sf_dir)).drop("features")


@query
def model_errors(spark, sf_dir):
    return models.error_report(trained(spark, sf_dir), test_rows(spark, sf_dir))


@query
def model_errors_by_round(spark, sf_dir):
    """Mean absolute error after each round, on the rows trained on and on those after."""
    forest = trained(spark, sf_dir)
    parts = models.time_split(training_table(spark, sf_dir), TEST_FROM)
    named = [models.error_per_round(forest, p).withColumn("part", F.lit(n)) for n, p in zip(("train", "test"), parts)]
    return named[0].unionByName(named[1])


@query
def model_evaluation(spark, sf_dir):
    return models.evaluation_rows(trained(spark, sf_dir), test_rows(spark, sf_dir))


@query
def model_forecast_path(spark, sf_dir):
    return forecast.forecast_rows(model_paths(spark, sf_dir))


@query
def model_time_to_empty(spark, sf_dir):
    return depletion.time_to_empty(model_depleted(spark, sf_dir))


@query
def model_states(spark, sf_dir):
    return states.states(model_depleted(spark, sf_dir))


# --- forecast, depletion, states --------------------------------------------------------


@query
def history_72h(spark, sf_dir):
    table = silver_table(spark, sf_dir)
    return forecast.history(table, table.select(STATION, F.col(TS).alias("anchor"))).drop(
        "forecasted"
    )


@query
def forecast_path(spark, sf_dir):
    return forecast.forecast_rows(paths(spark, sf_dir))


@query
def forecast_path_own(spark, sf_dir):
    return forecast.forecast_rows(paths(spark, sf_dir, coupled=False))


@query
def real_vs_forecast_split(spark, sf_dir):
    rows = forecast.forecast_24h(silver_table(spark, sf_dir), paths(spark, sf_dir), hours=5)
    return forecast.real_and_forecast(rows)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by year, month, day and hour: every hour of every station, and long after."""
    asked = silver_table(spark, sf_dir).select(STATION, "year", "month", "day", "hour")
    return asked.unionByName(asked.withColumn("year", F.col("year") + 6))


def requested_paths(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """Paths of the requested anchors, from the hours that they need and no others."""
    table = silver_table(spark, sf_dir)
    needed = forecast.near_anchors(table, forecast.anchors_of(asked), before=48)
    return forecast.with_paths(with_seasonal_changes(needed.select(*table.columns)))


@query
def forecast_requests(spark, sf_dir):
    asked = requests(spark, sf_dir)
    return forecast.forecasts_for(asked, requested_paths(spark, sf_dir, asked))


@query
def unmatched_requests(spark, sf_dir):
    asked = requests(spark, sf_dir)
    found = forecast.forecasts_for(asked, requested_paths(spark, sf_dir, asked))
    return forecast.unmatched_anchors(forecast.anchors_of(asked), found)


@query
def first_forecast_rows(spark, sf_dir):
    return forecast.first_rows(forecast.forecast_rows(paths(spark, sf_dir)), 5)


@query
def depletion_path(spark, sf_dir):
    return depletion.depletion_rows(silver_table(spark, sf_dir), depleted(spark, sf_dir))


@query
def time_to_empty(spark, sf_dir):
    return depletion.time_to_empty(depletion.with_depletion(paths(spark, sf_dir)))


@query
def states_table(spark, sf_dir):
    return states.states(depleted(spark, sf_dir))


@query
def state_lookup(spark, sf_dir):
    requests = silver_table(spark, sf_dir).select(STATION, TS, *states.LOOKUP_KEYS)
    return states.state_lookup(requests, searchable(spark, sf_dir)).select(
        STATION,
        TS,
        "state_timestamp",
        "reservoir_level_percentage_mean",
        "pump_active",
        "time_to_depletion",
        "forecast_output_flow_rate_1h",
    )


# --- schedules --------------------------------------------------------------------------


def _rewards(reward: str) -> None:
    def run(spark, sf_dir):
        return schedule.schedule_rewards(searchable(spark, sf_dir), CANDIDATES, reward)

    run.__name__ = f"schedule_reward_{reward}"
    query(run)


for _reward in schedule.REWARDS:
    _rewards(_reward)


@query
def best_schedule(spark, sf_dir):
    return schedule.best_schedule(searchable(spark, sf_dir), CANDIDATES)


@query
def best_random_schedule(spark, sf_dir):
    return schedule.best_random_schedule(searchable(spark, sf_dir))

"""Train the four forecasters and run them 24 hours ahead, for all sites at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltfleet.functions import flows, physics
from voltfleet.functions.timeparts import cyclic, is_stale
from voltfleet.operators import aggregates, align, ensembles, ordered, series
from voltfleet.session import materialise, path_exists, ship_package
from voltfleet.sources import tables

HORIZON = 24
MIN_ROWS = 10
#: Rows that one task of a fit passes over.
FIT_ROWS = 100_000
_CLOCK = ("hour_sin", "hour_cos", "day_sin", "day_cos", "is_weekend")


@dataclass(frozen=True)
class Target:
    actual: str
    inputs: tuple[str, ...]


# Model inputs per target.
TARGETS: dict[str, Target] = {
    "demand": Target(
        "demand_power_kw",
        (*_CLOCK, "demand_power_kw_lag_1h", "demand_power_kw_lag_2h", "demand_power_kw_roll_4h"),
    ),
    "solar": Target(
        "solar_power_kw", ("hour_sin", "hour_cos", "temperature_c", "irradiance_wm2", "solar_attenuation")
    ),
    "wind": Target("wind_power_kw", ("wind_speed_ms", "wind_speed_cubed")),
    "price": Target(
        "buy_price_inr", (*_CLOCK, "buy_price_inr_lag_1h", "buy_price_inr_lag_2h", "buy_price_inr_roll_4h")
    ),
}


#: Two inputs per target, for forecasters that are lines.
LINES: dict[str, Target] = {
    "demand": Target("demand_power_kw", ("demand_power_kw_lag_1h", "demand_power_kw_lag_2h")),
    "solar": Target("solar_power_kw", ("irradiance_wm2", "solar_attenuation")),
    "wind": Target("wind_power_kw", ("wind_speed_ms", "wind_speed_cubed")),
    "price": Target("buy_price_inr", ("buy_price_inr_lag_1h", "buy_price_inr_lag_2h")),
}


def estimator(target: str, boosting_rounds: int = 100, trees: int = 50) -> Estimator:
    names = {"labelCol": TARGETS[target].actual, "featuresCol": f"{target}_x", "predictionCol": f"{target}_hat"}
    if target == "solar":
        return RandomForestRegressor(numTrees=trees, seed=42, **names)
    if target == "wind":
        return LinearRegression(solver="normal", **names)
    return GBTRegressor(maxIter=boosting_rounds, seed=42, **names)


def assembler(target: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(TARGETS[target].inputs), outputCol=f"{target}_x")


def fit(train: DataFrame, target: str, boosting_rounds: int = 100, trees: int = 50) -> PipelineModel:
    pipeline = Pipeline(stages=[assembler(target), estimator(target, boosting_rounds, trees)])
    spec = TARGETS[target]
    return pipeline.fit(train.select(spec.actual, *spec.inputs))


def packed(train: DataFrame, targets: Iterable[str], fit_rows: int = FIT_ROWS) -> DataFrame:
    """The columns that ``targets`` learn from, in as few partitions as the rows need.

    Boosting runs a job for each level of each of its rounds, and all of them have as many tasks as this has partitions. Rows
    go to partitions by their values and lie there in order, so a fit is the same however ``train`` was laid out.
    """
    columns = list(dict.fromkeys(c for t in targets for c in (TARGETS[t].actual, *TARGETS[t].inputs)))
    slim = train.select(*columns)
    return slim.repartition(max(1, math.ceil(train.count() / fit_rows)), *columns).sortWithinPartitions(*columns)


def fit_all(train: DataFrame, targets: Iterable[str] = TARGETS, boosting_rounds=100, trees=50) -> dict[str, Model]:
    """One model per target, over all sites, side by side. The rows are kept at hand while the models pass over them."""
    targets = tuple(targets)
    rows = packed(train, targets).persist()
    try:
        with ThreadPoolExecutor(max(1, len(targets))) as pool:
            fits = {t: pool.submit(inheritable_thread_target(train.sparkSession)(fit), rows, t, boosting_rounds, trees) for t in targets}
            return {t: f.result() for t, f in fits.items()}
    finally:
        rows.unpersist()


def fit_lines(train: DataFrame) -> dict[str, Model]:
    """One linear model of two inputs per target: closed forms that train in one pass each."""
    models = {}
    for target, spec in LINES.items():
        names = {"labelCol": spec.actual, "featuresCol": f"{target}_x", "predictionCol": f"{target}_hat"}
        stages = [VectorAssembler(inputCols=list(spec.inputs), outputCol=f"{target}_x"), LinearRegression(solver="normal", **names)]
        models[target] = Pipeline(stages=stages).fit(train.select(spec.actual, *spec.inputs))
    return models


def split_sites(frame: DataFrame, keys=("site_id",), order=("time",), max_rows: int | None = None) -> DataFrame:
    """Chronological 80/20 split per site; sites with fewer than ten rows are left out."""
    return ordered.chrono_split(series.lay_out(frame, keys, order, max_rows), minimum=MIN_ROWS).rows()


def train_all(
    frame: DataFrame, keys=("site_id",), order=("time",), targets=tuple(TARGETS), boosting_rounds=100, trees=50
) -> tuple[dict[str, Model], DataFrame]:
    """Fit one model per target over all sites; returns the models and the metrics per site and target."""
    parts = split_sites(frame, keys, order)
    models = fit_all(parts.filter("part in ('train', 'both')"), targets, boosting_rounds, trees)
    sizes = parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("dataset_size"),
        F.count_if(F.col("part") != "test").alias("train_samples"),
    )
    return models, evaluate(parts.filter("part in ('test', 'both')"), models, keys).join(sizes, list(keys))


def score(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    for target, model in models.items():
        rows = model.transform(rows).drop(f"{target}_x")
    return rows


def evaluate(test: DataFrame, models: dict[str, Model], keys=("site_id",)) -> DataFrame:
    """MAE, RMSE and R2 per site and target, all targets in one pass over the scored rows."""
    sun, speed = F.col("irradiance_wm2"), F.col("wind_speed_ms")
    pairs = F.array(
        *[
            F.struct(
                F.lit(t).alias("target"),
                F.col(TARGETS[t].actual).alias("actual"),
                flows.scoring_clamp(t, F.col(f"{t}_hat"), sun, speed).alias("predicted"),
            )
            for t in models
        ]
    )
    long = score(test, models).select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    return aggregates.regression_metrics(long, [*keys, "target"], "actual", "predicted")


def save_models(models: dict[str, Model], root: str) -> None:
    for target, model in models.items():
        model.write().overwrite().save(f"{root}/{target}")


def load_models(root: str, targets=tuple(TARGETS)) -> dict[str, Model]:
    """The saved models; targets that were never saved are left out."""
    spark = SparkSession.active()
    return {t: PipelineModel.load(f"{root}/{t}") for t in targets if path_exists(spark, f"{root}/{t}")}


_VERSION, _COMPLETE = "version=", "_complete"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def publish_models(models: dict[str, Model], root: str, version: datetime) -> None:
    """Save a set of models as a version of its own. Readers see it once the last model is written, and never a part of it."""
    spark = SparkSession.active()
    folder = f"{root}/{_VERSION}{version:%Y%m%dT%H%M%S%f}"
    mark, files = _file_system(spark, f"{folder}/{_COMPLETE}")
    files.delete(mark, False)  # a version that is written again is no version until it is whole
    save_models(models, folder)
    files.create(mark, True).close()


def current_models(root: str, targets=tuple(TARGETS)) -> dict[str, Model]:
    """The newest complete version; none when there is none."""
    spark = SparkSession.active()
    where, files = _file_system(spark, root)
    if not files.exists(where):
        return {}
    folders = [x.getPath().toString() for x in files.listStatus(where) if x.getPath().getName().startswith(_VERSION)]
    done = [f for f in folders if path_exists(spark, f"{f}/{_COMPLETE}")]
    return load_models(max(done), targets) if done else {}


def horizon(latest_times: DataFrame, time: str = "time", hours: int = HORIZON) -> DataFrame:
    """One row per coming hour after ``time``, numbered from 1."""
    ahead = F.sequence(
        F.col(time) + F.expr("INTERVAL 1 HOUR"), F.col(time) + F.expr(f"INTERVAL {hours} HOURS"), F.expr("INTERVAL 1 HOUR")
    )
    kept = [c for c in latest_times.columns if c != time]
    exploded = latest_times.select(*kept, F.posexplode(ahead).alias("_i", time))
    return exploded.select(*kept, (F.col("_i") + 1).alias("step"), time)


def latest_state(frame: DataFrame, keys=("site_id",)) -> DataFrame:
    """What the recursion starts from: the last row of each site."""
    wanted = frame.select(
        *keys,
        "time",
        F.col("demand_power_kw").alias("demand_1"),
        F.col("demand_power_kw_lag_1h").alias("demand_2"),
        F.col("buy_price_inr").alias("price_1"),
        F.col("buy_price_inr_lag_1h").alias("price_2"),
    )
    return aggregates.latest(wanted, keys, ["time"])


def _roll(name: str, step: int, consistent: bool) -> Column:
    """Stand-in for the four-hour mean: of two lags, or of as many as four known values."""
    if not consistent:
        return (F.col(f"{name}_1") + F.col(f"{name}_2")) / 2.0
    known = [F.col(f"{name}_1"), F.col(f"{name}_2")] + [F.col(f"{name}_h{h}") for h in (step - 3, step - 4) if h > 0]
    return sum(known[1:], known[0]) / float(len(known))


def recursive_forecast(
    state: DataFrame, models: dict[str, Model], keys=("site_id",), hours=HORIZON, consistent_roll: bool = False
) -> DataFrame:
    """Demand and price hour by hour, each feeding the next; one wide row per site, then one row per hour."""
    rows = state
    for h in range(1, hours + 1):
        at = F.col("time") + F.expr(f"INTERVAL {h} HOURS")
        rows = rows.withColumns(cyclic(at))
        for name, column in (("demand", "demand_power_kw"), ("price", "buy_price_inr")):
            rows = rows.withColumns(
                {
                    f"{column}_lag_1h": F.col(f"{name}_1"),
                    f"{column}_lag_2h": F.col(f"{name}_2"),
                    f"{column}_roll_4h": _roll(name, h, consistent_roll),
                }
            )
            rows = models[name].transform(rows).drop(f"{name}_x")
            floor = {"demand": flows.S.MIN_DEMAND_KW, "price": flows.S.MIN_PRICE}[name]
            rows = rows.withColumn(f"{name}_h{h}", flows.not_below(F.col(f"{name}_hat"), floor)).drop(f"{name}_hat")
            rows = rows.withColumns({f"{name}_2": F.col(f"{name}_1"), f"{name}_1": F.col(f"{name}_h{h}")})
    steps = F.array(
        *[F.struct(F.col(f"demand_h{h}").alias("demand"), F.col(f"price_h{h}").alias("price")) for h in range(1, hours + 1)]
    )
    exploded = rows.select(*keys, "time", F.posexplode(steps).alias("_i", "s"))
    later = F.timestamp_seconds(F.unix_timestamp("time") + (F.col("_i") + 1) * 3600)
    return exploded.select(*keys, later.alias("time"), "s.demand", "s.price")


def _run_batches(batches: Iterator[pd.DataFrame], keys: list[str], walkers: dict, hours: int, consistent_roll: bool):
    floors = {"demand": flows.S.MIN_DEMAND_KW, "price": flows.S.MIN_PRICE}
    columns = {"demand": "demand_power_kw", "price": "buy_price_inr"}
    for batch in batches:
        if not len(batch):
            continue
        clock = np.stack(batch["clock"].to_list()).reshape(len(batch), hours, len(_CLOCK))
        out = batch[[*keys, "at"]].copy()
        for name, walk in walkers.items():
            last, before = batch[f"{name}_1"].to_numpy(float), batch[f"{name}_2"].to_numpy(float)
            made: list[np.ndarray] = []
            for h in range(hours):
                known = [last, before] + ([made[i] for i in (h - 3, h - 4) if i >= 0] if consistent_roll else [])
                row = {c: clock[:, h, j] for j, c in enumerate(_CLOCK)}
                row |= {
                    f"{columns[name]}_lag_1h": last,
                    f"{columns[name]}_lag_2h": before,
                    f"{columns[name]}_roll_4h": sum(known[1:], known[0]) / float(len(known)),
                }
                made.append(np.maximum(walk(np.column_stack([row[c] for c in walk.inputs])), floors[name]))
                last, before = made[-1], last
            out[name] = list(np.column_stack(made))
        yield out


def vector_forecast(
    state: DataFrame, models: dict[str, Model], keys=("site_id",), hours=HORIZON, consistent_roll: bool = False
) -> DataFrame:
    """What ``recursive_forecast`` gives, in one pass: the models are numpy arrays, and all hours of a batch of sites run in
    one task. The plan stays the same however many hours and trees there are."""
    ship_package(state.sparkSession)
    walkers = {name: ensembles.compiled(models[name]) for name in ("demand", "price")}
    stamp = F.unix_timestamp("time")

    def clock(h: Column) -> Column:
        parts = cyclic(F.timestamp_seconds(stamp + h * 3600))
        return F.array(*[parts[c].cast("double") for c in _CLOCK])

    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(hours)), clock)).alias("clock")
    starts = [F.col(f"{n}_{k}").cast("double").alias(f"{n}_{k}") for n in walkers for k in (1, 2)]
    slim = state.select(*keys, stamp.alias("at"), *starts, spans)
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[slim.schema[c] for c in (*keys, "at")], *[T.StructField(n, numbers) for n in walkers]])
    made = slim.mapInPandas(lambda b: _run_batches(b, list(keys), walkers, hours, consistent_roll), schema)
    exploded = made.select(*keys, "at", F.posexplode(F.arrays_zip("demand", "price")).alias("_i", "s"))
    later = F.timestamp_seconds(F.col("at") + (F.col("_i") + 1) * 3600)
    return exploded.select(*keys, later.alias("time"), "s.demand", "s.price")


def forecast(
    frame: DataFrame, weather: DataFrame, models: dict[str, Model], keys=("site_id",), consistent_roll: bool = False
) -> DataFrame:
    """24 hours of demand, solar, wind and price per site. ``weather`` holds the coming hours per site.

    An hour that ``weather`` lacks takes the nearest one of its site; a site without any takes the typical day.
    """
    state = latest_state(frame, keys)
    chained = vector_forecast(state, models, keys, consistent_roll=consistent_roll)
    clock = {n: e for n, e in cyclic(F.col("time")).items() if n in ("hour_sin", "hour_cos")}
    hours = align.with_weather(chained, weather, keys)
    feed = {c: F.col(c) for c in weather.columns if c not in (*keys, "time")}
    known = F.coalesce(*[c.cast("double") for c in feed.values()]).isNotNull()
    typical = physics.gap_filled_weather(F.col("time"), known, **feed)
    hours = hours.withColumns({c: F.coalesce(feed[c], typical[c].cast("double"), F.lit(0.0)) for c in feed})
    hours = hours.withColumns(clock).withColumns(
        {
            "wind_speed_cubed": physics.cubed(F.col("wind_speed_ms")),
            "solar_attenuation": physics.attenuated(F.col("irradiance_wm2"), F.col("cloud_cover")),
        }
    )
    hours = score(hours, {t: models[t] for t in ("solar", "wind")})
    c = F.col
    clamped = flows.horizon_clamps(
        c("demand"), c("solar_hat"), c("wind_hat"), c("price"), c("time"), c("irradiance_wm2"), c("wind_speed_ms")
    )
    return hours.select(*keys, "time", *[F.round(e, 3).alias(n) for n, e in clamped.items()])


def prediction_rows(wide: DataFrame, created_at: Column, keys=("site_id",)) -> DataFrame:
    """The forecast as ``predictions`` rows of one run."""
    pairs = F.array(
        *[F.struct(F.lit(t).alias("target_type"), F.col(t).alias("predicted_value")) for t in TARGETS]
    )
    long = wide.select(*keys, "time", F.explode(pairs).alias("p"))
    return long.select(*keys, "time", "p.*", created_at.alias("created_at"))


def latest_run(predictions: DataFrame, keys=("site_id",)) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.max("created_at").alias("created_at"))


def latest_forecast(predictions: DataFrame, keys=("site_id",)) -> DataFrame:
    """The newest run of each site, one row per hour."""
    runs = latest_run(predictions, keys)
    newest = predictions.join(runs, [*keys, "created_at"], "left_semi")
    return aggregates.pivot_targets(newest, [*keys, "created_at", "time"])


def stale_sites(sites: DataFrame, predictions: DataFrame, as_of: Column, limit: int = 3600) -> DataFrame:
    """Sites that need a new forecast: none yet, or the newest is too old."""
    runs = sites.join(latest_run(predictions), ["site_id"], "left")
    return runs.filter(is_stale(F.col("created_at"), as_of, limit))


def refresh(
    frame: DataFrame,
    weather: DataFrame,
    sites: DataFrame,
    root: str,
    model_root: str,
    as_of: datetime,
    limit: int = 3600,
    train: Callable[[DataFrame], dict[str, Model]] = fit_all,
) -> DataFrame:
    """The newest forecast of every site, after a new run for those without one and those whose last is older than ``limit``.

    Fresh sites keep their run. If any site is stale, the models are fitted anew over all sites and published as the version of
    ``as_of``; only the stale sites run. A stale site without history keeps what it has. Called again with the same ``as_of``,
    it adds nothing.
    """
    spark = frame.sparkSession
    now = F.lit(as_of.isoformat(" ")).cast("timestamp")
    known = sites.join(frame.select("site_id"), "site_id", "left_semi")
    # Written once: the table it is read from changes below.
    stale = materialise(stale_sites(known, tables.read(spark, root, "predictions").drop("date"), now, limit).select("site_id"))
    if not stale.isEmpty():
        publish_models(train(frame), model_root, as_of)
        run = forecast(frame.join(stale, "site_id", "left_semi"), weather, current_models(model_root))
        tables.append_run(prediction_rows(run, now), root)
    return latest_forecast(tables.read(spark, root, "predictions").drop("date"))

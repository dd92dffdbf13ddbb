"""Walk-forward validation: every cutoff is part of the slice key, so all folds
are fitted and scored in one job and nothing after a cutoff reaches its fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators.forecast import window_sums
from tidemark.operators.models import STAGED, Model
from tidemark.operators.promo import Event

FOLD = ("cutoff", *cfg.SLICE)


def training_folds(series: DataFrame, cutoffs: Sequence[str],
                   horizons: Sequence[int] = cfg.HORIZONS,
                   test_end: str | None = None) -> DataFrame:
    """Each series once per cutoff, cut before it, carrying the actual revenue after it.

    The actuals are sums over the same window partition, so they need no join.
    ``test_end`` (exclusive) replaces the end of every test window. A window that
    runs past the last day of its series has no actual: it is not scored.
    """
    cuts = F.array(*(F.lit(c).cast("date") for c in cutoffs))
    folds = series.withColumn("cutoff", F.explode(cuts))
    w = Window.partitionBy(*FOLD)
    actuals = {}
    for h in horizons:
        end = F.date_add("cutoff", h) if test_end is None else F.lit(test_end).cast("date")
        tested = (F.col("ds") >= F.col("cutoff")) & (F.col("ds") < end)
        complete = F.max("ds").over(w) >= F.date_sub(end, 1)
        actuals[f"actual_{h}"] = F.when(complete, F.sum(F.when(tested, F.col("revenue"))).over(w)).cast("double")
    return folds.withColumns(actuals).where(F.col("ds") < F.col("cutoff"))


def _actual(horizons: Sequence[int]) -> Column:
    picked = None
    for h in horizons:
        hit = F.col("window_days") == h
        picked = F.when(hit, F.col(f"actual_{h}")) if picked is None else picked.when(
            hit, F.col(f"actual_{h}"))
    return picked


def walk_forward(series: DataFrame, events: Sequence[Event], cutoffs: Sequence[str],
                 horizons: Sequence[int] = cfg.HORIZONS,
                 settings: cfg.ModelSettings = cfg.ModelSettings(),
                 test_end: str | None = None, model: Model = STAGED) -> DataFrame:
    """Predicted range against the actual sum for every cutoff, slice and window.

    Predictions assume the mean spend of the training days and use no floor.
    """
    folds = training_folds(series, cutoffs, horizons, test_end)
    models = model.fit(folds, events, FOLD, settings, horizons,
                       carry=[f"actual_{h}" for h in horizons])
    daily = model.predict(models, events, FOLD, settings, max(horizons))
    windows = window_sums(daily, FOLD, floor=False)
    actual, predicted = F.col("actual"), F.col("revenue_point")
    return windows.withColumn("actual", _actual(horizons)).where(actual.isNotNull()).select(
        *FOLD, "window_days", "actual", predicted.alias("predicted"),
        "revenue_lower", "revenue_upper",
        (F.try_divide(F.abs(predicted - actual), actual) * 100.0).alias("ape_pct"),
        actual.between(F.col("revenue_lower"), F.col("revenue_upper")).alias("covered"))


def backtest(series: DataFrame, events: Sequence[Event], cutoff: str,
             horizon: int = max(cfg.HORIZONS),
             settings: cfg.ModelSettings = cfg.ModelSettings(),
             test_end: str | None = None, model: Model = STAGED) -> DataFrame:
    """One cutoff, one window."""
    return walk_forward(series, events, [cutoff], [horizon], settings, test_end, model)


def coverage_summary(folds: DataFrame, target: float = cfg.ModelSettings.interval_width) -> DataFrame:
    """Share of covered actuals and mean absolute percentage error per window."""
    return folds.groupBy("window_days").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg(F.col("covered").cast("int")).alias("coverage"),
        F.avg("ape_pct").alias("mean_ape_pct"),
    ).withColumn("target", F.lit(float(target)))

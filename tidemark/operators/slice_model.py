"""Staged additive model of every slice, fitted in SQL, one wide row per slice.

Target y = log1p(revenue), regressor x = log1p(spend). Linear trend, weekday
effect, month effect (shrunken) and event effect (shrunken) are removed from
both in turn; the spend elasticity is the slope of the remaining y on the
remaining x. The stages of x are at the same time the model of spend.

All stages are window aggregates whose partition keys contain the slice keys,
and the final grouping is by the slice keys, so the fit of all slices needs a
single exchange of the daily series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.functions.rolling import with_rolling_sums
from tidemark.operators.promo import Event, with_event

TARGETS = ("y", "x")
NO_SPREAD = 1e-9


def staged_residuals(series: DataFrame, events: Sequence[Event],
                     keys: Sequence[str] = cfg.SLICE,
                     shrinkage: float = cfg.ModelSettings.shrinkage) -> DataFrame:
    """Add the stage values and the final residuals ``y_res`` and ``x_res`` to each day."""
    per_slice = Window.partitionBy(*keys)
    d = with_event(series, events).withColumns({
        "y": S.to_log("revenue"),
        "x": S.to_log("spend"),
        "dow": F.dayofweek("ds"),
        "moy": F.month("ds"),
        "first_ds": F.min("ds").over(per_slice),
        "last_ds": F.max("ds").over(per_slice),
    })
    d = d.withColumn("t", F.datediff("ds", "first_ds").cast("double"))

    trend = {}
    for v in TARGETS:
        slope = F.coalesce(F.regr_slope(v, "t").over(per_slice), F.lit(0.0))
        trend[f"{v}_slope"] = slope
        trend[f"{v}_base"] = F.avg(v).over(per_slice) - slope * F.avg("t").over(per_slice)
    d = d.withColumns(trend)
    d = d.withColumns({f"{v}_res": F.col(v) - (F.col(f"{v}_base") + F.col(f"{v}_slope") * F.col("t"))
                       for v in TARGETS})

    stages = (("dow", 0.0), ("moy", shrinkage), ("event", shrinkage))
    for stage, kappa in stages:
        w = Window.partitionBy(*keys, stage)
        effects = {}
        for v in TARGETS:
            mean = F.sum(f"{v}_res").over(w) / (F.count(F.lit(1)).over(w) + F.lit(kappa))
            applies = F.col(stage).isNotNull()
            effects[f"{v}_{stage}"] = F.when(applies, mean).otherwise(F.lit(0.0))
        # one row per stage value speaks for all of them when the effects are gathered
        effects[f"{stage}_speaker"] = applies & (F.col("ds") == F.min("ds").over(w))
        d = d.withColumns(effects)
        d = d.withColumns({f"{v}_res": F.col(f"{v}_res") - F.col(f"{v}_{stage}") for v in TARGETS})
    return d


def _effect_map(stage: str) -> Column:
    """{stage value: (y effect, x effect)}; at most one entry per weekday, month or event label."""
    entry = F.struct(F.col(stage).alias("key"),
                     F.struct(F.col(f"y_{stage}").alias("y"), F.col(f"x_{stage}").alias("x")).alias("value"))
    return F.map_from_entries(F.collect_list(F.when(F.col(f"{stage}_speaker"), entry)))


def floor_and_cv(days: int) -> tuple[Column, Column]:
    """Aggregates over rolling ``days``-day sums: the revenue floor and the ROAS
    coefficient of variation (fallback when fewer than two values exist)."""
    sums = F.col(f"revenue_{days}d").cast("double")
    average = F.sum("revenue").cast("double") / F.count(F.lit(1))
    low = F.percentile(sums, F.lit(cfg.FLOOR_PERCENTILE))
    floor = F.greatest(low, average * days * F.lit(cfg.FLOOR_AVERAGE_SHARE))
    ratio = S.roas_daily(f"revenue_{days}d", f"spend_{days}d")
    spread = F.stddev_samp(ratio) / F.greatest(F.avg(ratio), F.lit(1e-6))
    cv = F.when(F.count(ratio) > 1, spread).otherwise(F.lit(cfg.FALLBACK_ROAS_CV))
    return floor, cv


def trailing_aggregates(days: int = cfg.TRAILING_DAYS) -> list[Column]:
    """Aggregates over the last ``days`` rows of a gap-free series (needs ``last_ds``)."""
    recent = F.datediff("last_ds", "ds") < days
    return [
        F.sum(F.when(recent, F.col("revenue"))).cast("double").alias("trailing_revenue"),
        F.sum(F.when(recent, F.col("spend"))).cast("double").alias("trailing_spend"),
        F.min(F.when(recent, F.col("ds"))).alias("trailing_start"),
    ]


def eligible(settings: cfg.ModelSettings = cfg.ModelSettings()) -> Column:
    """The account is always forecast; other slices need enough days and revenue days."""
    enough = ((F.col("n_days") >= settings.min_calendar_days)
              & (F.col("nonzero_days") >= settings.min_nonzero_days))
    return (F.col("level") == "aggregate") | enough


def fit_staged(series: DataFrame, events: Sequence[Event],
               keys: Sequence[str] = cfg.SLICE,
               settings: cfg.ModelSettings = cfg.ModelSettings(),
               horizons: Sequence[int] = cfg.HORIZONS,
               carry: Sequence[str] = ()) -> DataFrame:
    """One row per slice: coefficients, residual spreads, floors, averages and trailing sums.

    ``carry`` names columns that are constant per slice and kept as they are.
    """
    rolled = with_rolling_sums(series, ("revenue", "spend"), horizons, keys)
    days = staged_residuals(rolled, events, keys, settings.shrinkage)

    guards = [floor_and_cv(h) for h in horizons]
    fitted = days.groupBy(*keys).agg(
        F.first("channel").alias("channel"),
        *(F.first(c).alias(c) for c in carry),
        F.first("first_ds").alias("first_ds"),
        F.first("last_ds").alias("last_ds"),
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(F.col("revenue") > 0).alias("nonzero_days"),
        F.sum("revenue").cast("double").alias("total_revenue"),
        F.sum("spend").cast("double").alias("total_spend"),
        *(F.first(f"{v}_{c}").alias(f"{v}_{c}") for v in TARGETS for c in ("base", "slope")),
        _effect_map("dow").alias("dow_effect"),
        _effect_map("moy").alias("moy_effect"),
        _effect_map("event").alias("event_effect"),
        F.stddev_samp("x_res").alias("x_sigma"),
        F.regr_slope("y_res", "x_res").alias("raw_beta"),
        F.var_samp("y_res").alias("y_var"),
        F.covar_samp("y_res", "x_res").alias("yx_cov"),
        F.array(*(g[0] for g in guards)).alias("floors"),
        F.array(*(g[1] for g in guards)).alias("roas_cvs"),
        F.bit_xor(S.day_print("ds", "revenue", "spend")).alias("fingerprint"),
        *trailing_aggregates(),
    )
    beta = F.when(F.col("x_sigma") > NO_SPREAD, F.col("raw_beta")).otherwise(F.lit(0.0))
    if settings.cap_elasticity is not None:
        beta = F.least(beta, F.lit(float(settings.cap_elasticity)))
    b = F.col("beta")
    unexplained = (F.col("y_var") - 2.0 * b * F.col("yx_cov")
                   + b * b * F.col("x_sigma") * F.col("x_sigma"))
    return fitted.withColumn("beta", beta).withColumns({
        "y_sigma": F.sqrt(F.greatest(unexplained, F.lit(0.0))),
        "stages_sigma": F.sqrt("y_var"),  # without the spend regressor
        "average_revenue": F.col("total_revenue") / F.col("n_days"),
        "average_spend": F.col("total_spend") / F.col("n_days"),
        "eligible": eligible(settings),
        "horizons": F.array(*(F.lit(int(h)) for h in horizons)),
    }).drop("raw_beta", "y_var", "yx_cov")


def model_coefficients(models: DataFrame, keys: Sequence[str] = cfg.SLICE) -> DataFrame:
    """Long view: (slice, target, term, coef) with one row per fitted coefficient."""
    def term(target: str, name: Column, value: Column) -> Column:
        return F.struct(F.lit(target).alias("target"), name.alias("term"), value.alias("coef"))

    def entry(stage: str, target: str, v: str):
        return lambda e: term(
            target, F.concat(F.lit(f"{stage}:"), e["key"].cast("string")), e["value"][v])

    plain = [term(t, F.lit(n), F.col(c)) for t, n, c in (
        ("revenue", "base", "y_base"), ("revenue", "slope", "y_slope"),
        ("revenue", "log_spend", "beta"), ("revenue", "sigma", "y_sigma"),
        ("spend", "base", "x_base"), ("spend", "slope", "x_slope"), ("spend", "sigma", "x_sigma"),
    )]
    terms = F.array(*plain)
    for stage in ("dow", "moy", "event"):
        for target, v in (("revenue", "y"), ("spend", "x")):
            terms = F.concat(terms, F.transform(F.map_entries(f"{stage}_effect"), entry(stage, target, v)))
    return models.select(*keys, F.inline(terms))

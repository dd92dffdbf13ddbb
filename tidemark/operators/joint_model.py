"""Joint penalised fit of trend, seasonality, events and log spend.

The design row of every day and the products of its entries are column expressions, and
their sums are an aggregate: a slice of any length becomes one row with K x K sums. Python
only solves these normal equations; prediction is a dot product in the JVM again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.operators.forecast import band_factor, future_days
from tidemark.operators.promo import Event, indicator_names, with_event
from tidemark.operators.slice_model import fit_staged

YEAR_DAYS, WEEK_DAYS = 365.25, 7.0
BASE_SCALE = 5.0
#: The solver stops when no coefficient moves by more than this share, or after so many steps of either kind.
STEP_SIZE = 1e-10
MOST_STEPS = 200
#: Laplace priors count as smooth nearer to zero than this.
SMOOTH = 1e-4


@dataclass(frozen=True)
class Design:
    """Size of the design. The largest published form is 25 changepoints, yearly order 10.

    Without ``priors`` the fit is least squares (of all solutions the shortest, where terms coincide).
    """

    changepoints: int = 8
    yearly_order: int = 4
    weekly_order: int = 3
    changepoint_range: float = 0.8
    priors: bool = True

    def terms(self, events: Sequence[Event], settings: cfg.ModelSettings):
        """(name, prior scale, kind) of every term, in design order."""
        wide = settings.seasonality_scale
        out = [("base", BASE_SCALE, "normal"), ("slope", BASE_SCALE, "normal")]
        out += [(f"bend{j}", settings.changepoint_scale, "laplace")
                for j in range(1, self.changepoints + 1)]
        for label, order in (("year", self.yearly_order), ("week", self.weekly_order)):
            out += [(f"{label}_{wave}{k}", wide, "normal")
                    for k in range(1, order + 1) for wave in ("sin", "cos")]
        out += [(f"event:{name}", wide, "normal") for name in indicator_names(events)]
        return out + [("log_spend", wide, "normal")]


def least_squares() -> Design:
    """Level, slope and log spend without priors: the smallest design, with a closed solution."""
    return Design(changepoints=0, yearly_order=0, weekly_order=0, priors=False)


def design_row(design: Design, events: Sequence[Event], u: Column, log_spend: Column) -> Column:
    """array<double> of one day: ``u`` is time scaled to 0..1 over the training days."""
    day = F.datediff("ds", F.lit("1970-01-01").cast("date")).cast("double")
    cells = [F.lit(1.0), u]
    for j in range(1, design.changepoints + 1):
        at = design.changepoint_range * j / design.changepoints
        cells.append(F.greatest(u - at, F.lit(0.0)))
    for period, order in ((YEAR_DAYS, design.yearly_order), (WEEK_DAYS, design.weekly_order)):
        for k in range(1, order + 1):
            angle = day * (2.0 * math.pi * k / period)
            cells += [F.sin(angle), F.cos(angle)]
    active = F.split(F.coalesce("event", F.lit("")), r"\|")
    cells += [F.array_contains(active, name).cast("double") for name in indicator_names(events)]
    return F.array(*cells, log_spend)


def design_matrix(series: DataFrame, events: Sequence[Event], design: Design = Design(),
                  keys: Sequence[str] = cfg.SLICE) -> DataFrame:
    """One row per day: scaled targets ``y`` and ``z`` (log revenue, log spend) and ``row``."""
    w = Window.partitionBy(*keys)
    d = with_event(series, events).withColumns({
        "log_revenue": S.to_log("revenue"), "log_spend": S.to_log("spend")})
    d = d.withColumns({
        "first_ds": F.min("ds").over(w), "last_ds": F.max("ds").over(w),
        "y_scale": F.max("log_revenue").over(w), "z_scale": F.max("log_spend").over(w),
        "spend_mean": F.avg("log_spend").over(w), "spend_sd": F.stddev_samp("log_spend").over(w),
    })
    one_if_zero = {c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(1.0))
                   for c in ("y_scale", "z_scale", "spend_sd")}
    d = d.withColumns(one_if_zero)
    span = F.greatest(F.datediff("last_ds", "first_ds"), F.lit(1)).cast("double")
    u = F.datediff("ds", "first_ds") / span
    standard = (F.col("log_spend") - F.col("spend_mean")) / F.col("spend_sd")
    return d.select(
        *keys, "ds", "first_ds", "last_ds", span.alias("span"), "y_scale", "z_scale",
        "spend_mean", "spend_sd",
        (F.col("log_revenue") / F.col("y_scale")).alias("y"),
        (F.col("log_spend") / F.col("z_scale")).alias("z"),
        design_row(design, events, u, standard).alias("row"))


def normal_sums(matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per slice with ``n`` and ``sums``: the upper triangle, row by row, of the sums of
    products of all design entries and the two targets."""
    w = F.concat("row", F.array("y", "z"))
    products = F.flatten(F.transform("w", lambda a, i: F.transform(F.slice("w", i + 1, F.size("w")), lambda b: a * b)))
    sums = Summarizer.sum(array_to_vector(F.col("products")))
    return matrix.withColumn("w", w).withColumn("products", products).groupBy(*keys).agg(
        *(F.first(c).alias(c) for c in _KEPT), F.count(F.lit(1)).alias("n"), vector_to_array(sums).alias("sums"))


def posterior_mode(scale: np.ndarray, laplace: np.ndarray, priors: bool = True):
    """A solver for given priors: (gram, moment, energy, n) to (coefficients, residual spread, steps, optimality).

    Normal and Laplace priors, by reweighted ridge steps on the normal equations; where these
    creep because a coefficient with a Laplace prior is near zero, by Newton steps that take the
    pull of the others as constant, as long as the gradient shrinks. ``optimality`` is its largest
    entry that is left, as a share of the largest moment. The solver is a closure, so it travels to
    the workers by value.
    """
    def weights(theta):
        if not priors:
            return np.zeros(len(scale))
        return np.where(laplace, 1.0 / (scale * np.maximum(np.abs(theta), SMOOTH)), 1.0 / scale**2)

    def spread(theta, gram, moment, energy, n):
        return max((energy - 2 * theta @ moment + theta @ gram @ theta) / n, 1e-12)

    def gradient(theta, noise, gram, moment):
        return np.abs(gram @ theta - moment + noise * weights(theta) * theta).max() / max(np.abs(moment).max(), 1e-300)

    def solve(gram, moment, energy, n):
        theta, noise, weight, steps = np.zeros(len(moment)), max(energy / n, 1e-12), 1.0 / scale**2 * priors, 0
        while steps < MOST_STEPS:
            system = gram + np.diag(noise * weight)
            new = np.linalg.solve(system, moment) if priors else np.linalg.lstsq(system, moment, rcond=1e-12)[0]
            moved, theta = np.abs(new - theta).max(), new
            noise, weight, steps = spread(theta, gram, moment, energy, n), weights(theta), steps + 1
            if moved <= STEP_SIZE * (1.0 + np.abs(theta).max()):
                break
        left = gradient(theta, noise, gram, moment)
        while left > STEP_SIZE and steps < 2 * MOST_STEPS:
            away = laplace & (np.abs(theta) > SMOOTH)
            new = np.linalg.solve(gram + np.diag(np.where(away, 0.0, noise * weights(theta))),
                                  moment - np.where(away, noise * np.sign(theta) / scale, 0.0))
            share = 1.0
            while share > 1e-6:  # halve a step that overshoots
                tried = theta + share * (new - theta)
                spent = spread(tried, gram, moment, energy, n)
                rest = gradient(tried, spent, gram, moment)
                if rest < left:
                    break
                share /= 2
            else:
                break
            theta, noise, left, steps = tried, spent, rest, steps + 1
        return theta, noise**0.5, steps, left

    return solve


_KEPT = ("first_ds", "last_ds", "span", "y_scale", "z_scale", "spend_mean", "spend_sd")


def fit_joint(series: DataFrame, events: Sequence[Event], design: Design = Design(),
              keys: Sequence[str] = cfg.SLICE,
              settings: cfg.ModelSettings = cfg.ModelSettings()) -> DataFrame:
    """One row per slice with the coefficients of revenue and of spend, and how far from the optimum they are."""
    terms = design.terms(events, settings)
    scale = np.array([t[1] for t in terms])
    laplace = np.array([t[2] == "laplace" for t in terms])
    revenue_solver = posterior_mode(scale, laplace, design.priors)
    spend_solver = posterior_mode(scale[:-1], laplace[:-1], design.priors)
    k = len(terms)
    above = np.triu_indices(k + 2)

    def fit(batches):
        for slices in batches:
            out = []
            for sums, n in zip(slices["sums"], slices["n"], strict=True):
                full = np.zeros((k + 2, k + 2))
                full[above] = full.T[above] = sums
                coef, noise, steps, left = revenue_solver(full[:k, :k], full[:k, k], full[k, k], n)
                spend_coef, spend_noise, spend_steps, spend_left = spend_solver(
                    full[: k - 1, : k - 1], full[: k - 1, k + 1], full[k + 1, k + 1], n)
                out.append((coef, noise, spend_coef, spend_noise, max(steps, spend_steps), max(left, spend_left)))
            made = dict(zip(("coef", "sigma", "spend_coef", "spend_sigma", "steps", "optimality"),
                            (list(c) for c in zip(*out, strict=True)), strict=True))
            yield slices.drop(columns="sums").assign(**made)

    sums = normal_sums(design_matrix(series, events, design, keys), keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema if f.name != "sums")
    schema += ", coef array<double>, sigma double, spend_coef array<double>, spend_sigma double, steps int, optimality double"
    return sums.mapInPandas(fit, schema)


def joint_coefficients(fitted: DataFrame, events: Sequence[Event], design: Design = Design(),
                       keys: Sequence[str] = cfg.SLICE,
                       settings: cfg.ModelSettings = cfg.ModelSettings(), more: Sequence[str] = ()) -> DataFrame:
    """Long view: (slice, target, term, coef), with ``more`` columns of the fit."""
    names = F.array(*(F.lit(t[0]) for t in design.terms(events, settings)))

    def side(target: str, coef: str) -> Column:
        return F.transform(F.arrays_zip(names.alias("term"), F.col(coef).alias("coef")),
                           lambda e: F.struct(F.lit(target).alias("target"), e["term"].alias("term"),
                                              e["coef"].alias("coef")))

    long = fitted.select(*keys, *more, F.inline(F.concat(side("revenue", "coef"), side("spend", "spend_coef"))))
    return long.where(F.col("coef").isNotNull())


_JOINT = ("span", "y_scale", "z_scale", "spend_mean", "spend_sd", "coef", "sigma", "spend_coef", "spend_sigma", "steps", "optimality")


def fit_with_guards(series: DataFrame, events: Sequence[Event], keys: Sequence[str] = cfg.SLICE,
                    settings: cfg.ModelSettings = cfg.ModelSettings(), horizons: Sequence[int] = cfg.HORIZONS,
                    carry: Sequence[str] = (), design: Design = Design()) -> DataFrame:
    """The joint fit beside eligibility, averages and guards: one row per slice, as wide as ``fit_staged`` and more.

    Both halves group the same clustered series.
    """
    joint = fit_joint(series.drop(*carry), events, design, keys, settings).select(*keys, *_JOINT)
    return fit_staged(series, events, keys, settings, horizons, carry).join(joint, list(keys))


def predict_joint(models: DataFrame, events: Sequence[Event],
                  keys: Sequence[str] = cfg.SLICE,
                  settings: cfg.ModelSettings = cfg.ModelSettings(),
                  horizon: int | None = None, budget: str | None = None, everyone: bool = False,
                  design: Design = Design()) -> DataFrame:
    """Daily predictions in the shape of ``forecast.predict_daily``, from ``fit_with_guards``.

    ``budget`` names a column with the assumed daily spend. The slope scales and ``bend_rate``
    describe the simulated future trend changes for sampled intervals.
    """
    future = future_days(models, horizon, everyone)
    assumed = F.col("average_spend") if budget is None else F.coalesce(F.col(budget), F.col("average_spend"))
    u = F.datediff("ds", "first_ds") / F.col("span")
    standard = (S.to_log(assumed) - F.col("spend_mean")) / F.col("spend_sd")
    future = with_event(future, events).withColumn("row", design_row(design, events, u, standard))

    def dot(coef: str) -> Column:
        k = F.size(coef)
        products = F.zip_with(coef, F.slice("row", F.lit(1), k), lambda a, b: a * b)
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    def mean_bend(coef: str) -> Column:
        bends = F.slice(coef, 3, design.changepoints) if design.changepoints else F.array(F.lit(0.0))
        return F.aggregate(bends, F.lit(0.0), lambda acc, v: acc + F.abs(v)) / max(design.changepoints, 1)

    z = F.lit(band_factor(settings.interval_width))
    out = future.withColumns({
        "revenue_yhat": dot("coef") * F.col("y_scale"),
        "spend_yhat": dot("spend_coef") * F.col("z_scale"),
        "y_sigma": F.col("sigma") * F.col("y_scale"),
        "x_sigma": F.col("spend_sigma") * F.col("z_scale"),
        "revenue_slope_scale": mean_bend("coef") * F.col("y_scale") / F.col("span"),
        "spend_slope_scale": mean_bend("spend_coef") * F.col("z_scale") / F.col("span"),
        "bend_rate": F.lit(float(design.changepoints)) / F.col("span"),
    })
    for m, s in (("revenue", "y_sigma"), ("spend", "x_sigma")):
        out = out.withColumns({f"{m}_yhat_lower": F.col(f"{m}_yhat") - z * F.col(s),
                               f"{m}_yhat_upper": F.col(f"{m}_yhat") + z * F.col(s)})
    return out.drop("row", "event", "first_ds", "t", *_JOINT)

"""Model fits and range forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators import forecast as FC
from tidemark.operators import joint_model as J
from tidemark.operators.models import joint
from tidemark.operators.slice_model import model_coefficients, staged_residuals
from tidemark.plans import sqlblocks as Q
from tidemark.plans.catalog.registry import (
    EVENTS, TOP_LEVELS, models_of, query, rounded, series_of)
from tidemark.session import shared_folder
from tidemark.sources import model_store

MONEY = tuple(f"{m}_{b}" for m in ("revenue", "spend") for b in ("lower", "point", "upper"))
RATIO = tuple(f"roas_{b}" for b in ("lower", "point", "upper"))


def cells_sql(columns=(*MONEY, *RATIO), keys="level, entity", where="TRUE") -> str:
    shown = ", ".join(f"round({c}, {6 if c in RATIO else 2}) AS {c}" for c in columns)
    return f"SELECT {keys}, window_days, {shown} FROM forecasts WHERE {where}"


def shown(forecasts, columns=(*MONEY, *RATIO), keys=cfg.SLICE):
    out = forecasts.select(*keys, "window_days", *columns)
    out = rounded(out, 2, *(c for c in columns if c in MONEY))
    return rounded(out, 6, *(c for c in columns if c in RATIO))


@query("design_matrix", sql=Q.query(Q.series(), Q.fit(EVENTS), select="""
SELECT level, entity, ds, round(y, 8) AS y, round(x, 8) AS x, CAST(t AS INTEGER) AS t, CAST(dow AS INTEGER) AS dow,
       CAST(moy AS INTEGER) AS moy, event, round(y4, 6) + 0 AS y_res, round(x4, 6) + 0 AS x_res FROM r4"""))
def design_matrix(spark, folder):
    """Regressors of the staged model and what each day's stages leave unexplained."""
    days = staged_residuals(series_of(spark, folder), EVENTS)
    return days.select(
        "level", "entity", "ds", F.round("y", 8).alias("y"), F.round("x", 8).alias("x"),
        F.col("t").cast("int").alias("t"), "dow", "moy", "event",
        F.round("y_res", 6).alias("y_res"), F.round("x_res", 6).alias("x_res"))


@query("joint_design_rows", sql=Q.query(Q.series(), Q.event_table(EVENTS), """b AS (
  SELECT level, entity, min(ds) AS lo, max(ds) AS hi, avg(ln(1 + CAST(spend AS DOUBLE))) AS m,
         CASE WHEN stddev_samp(ln(1 + CAST(spend AS DOUBLE))) > 0 THEN stddev_samp(ln(1 + CAST(spend AS DOUBLE))) ELSE 1 END AS s FROM series GROUP BY ALL)""", select="""
SELECT level, entity, ds, round(date_diff('day', lo, ds) / CAST(greatest(date_diff('day', lo, hi), 1) AS DOUBLE), 8) AS slope,
       round(greatest(date_diff('day', lo, ds) / CAST(greatest(date_diff('day', lo, hi), 1) AS DOUBLE) - 0.4, 0), 8) AS bend4,
       round(sin(2 * pi() * date_diff('day', DATE '1970-01-01', ds) / 365.25), 6) + 0 AS year_sin1,
       round(cos(2 * pi() * 3 * date_diff('day', DATE '1970-01-01', ds) / 7), 6) + 0 AS week_cos3,
       round((ln(1 + CAST(spend AS DOUBLE)) - m) / s, 6) + 0 AS log_spend,
       CASE WHEN event LIKE '%black_friday+0%' THEN 1 ELSE 0 END AS black_friday
FROM series JOIN b USING (level, entity) LEFT JOIN promo USING (ds)"""))
def joint_design_rows(spark, folder):
    """A few named columns of the full design row."""
    design = J.Design()
    names = [t[0] for t in design.terms(EVENTS, cfg.ModelSettings())]
    rows = J.design_matrix(series_of(spark, folder), EVENTS, design)

    def term(name: str, digits: int):
        return F.round(F.col("row")[names.index(name)], digits)

    return rows.select(
        "level", "entity", "ds", term("slope", 8).alias("slope"), term("bend4", 8).alias("bend4"),
        term("year_sin1", 6).alias("year_sin1"), term("week_cos3", 6).alias("week_cos3"),
        term("log_spend", 6).alias("log_spend"),
        term("event:black_friday+0", 0).cast("int").alias("black_friday"))


_COEF = """
SELECT level, entity, 'revenue' AS target, 'base' AS term, y_base AS coef FROM trend
UNION ALL SELECT level, entity, 'revenue', 'slope', y_slope FROM trend
UNION ALL SELECT level, entity, 'spend', 'base', x_base FROM trend
UNION ALL SELECT level, entity, 'spend', 'slope', x_slope FROM trend
UNION ALL SELECT level, entity, 'revenue', 'log_spend', beta FROM coef
UNION ALL SELECT level, entity, 'revenue', 'sigma', y_sigma FROM coef
UNION ALL SELECT level, entity, 'spend', 'sigma', x_sigma FROM coef
""" + "".join(
    f"UNION ALL SELECT level, entity, '{target}', '{stage}:' || {stage}, {v}_{stage} FROM {table}\n"
    for stage, table in (("dow", "dows"), ("moy", "moys"), ("event", "evs"))
    for target, v in (("revenue", "y"), ("spend", "x")))


@query("fit_staged", sql=Q.query(Q.series(), Q.slices(), Q.fit(EVENTS), select=
    f"SELECT level, entity, target, term, round(coef, 9) + 0 AS coef FROM ({_COEF})"))
def fit_staged_coefficients(spark, folder):
    return rounded(model_coefficients(models_of(spark, folder)), 9, "coef")


_LEAST = " UNION ALL ".join(f"SELECT level, entity, '{target}' AS target, '{term}' AS term, {c} AS coef FROM least" for target, term, c in (
    ("revenue", "base", "base"), ("revenue", "slope", "slope"), ("revenue", "log_spend", "log_spend"),
    ("spend", "base", "z_base"), ("spend", "slope", "z_slope")))


@query("fit_joint", sql=Q.query(Q.series(), Q.least_squares(), select=
    f"SELECT level, entity, target, term, round(coef, 7) + 0 AS coef, TRUE AS optimal FROM ({_LEAST})"))
def fit_joint(spark, folder):
    """The joint fit with its smallest design, level, slope and log spend by least squares."""
    design = J.least_squares()
    fitted = J.fit_joint(series_of(spark, folder), (), design)
    long = J.joint_coefficients(fitted, (), design, more=("optimality",))
    return rounded(long, 7, "coef").select(*cfg.SLICE, "target", "term", "coef", (F.col("optimality") < 1e-6).alias("optimal"))


@query("fit_joint_full")
def fit_joint_full(spark, folder):
    """All terms with their priors; ``optimality`` is the share of the gradient that is left."""
    fitted = J.fit_joint(series_of(spark, folder), EVENTS)
    return J.joint_coefficients(fitted, EVENTS, more=("steps", "optimality"))


# Every slice has a fit of all terms that is at its optimum.
@query("fit_joint_optimality", sql=Q.query(Q.series(), select=f"""
SELECT level, entity, count(*) AS n, {len(J.Design().terms(EVENTS, cfg.ModelSettings()))} AS terms, TRUE AS optimal
FROM series GROUP BY level, entity"""))
def fit_joint_optimality(spark, folder):
    fitted = J.fit_joint(series_of(spark, folder), EVENTS)
    return fitted.select(*cfg.SLICE, "n", F.size("coef").alias("terms"),
                         (F.col("optimality") < 1e-6).alias("optimal"))


LEAST = joint(J.least_squares())
LEAST_FORECASTS = ",\n".join([Q.series(), Q.rolling(), Q.guards(), Q.slices(), Q.least_squares(), Q.least_future(), Q.windows()])


@query("forecast_joint", sql=Q.query(LEAST_FORECASTS, select=cells_sql()))
def forecast_joint(spark, folder):
    """Window forecasts of the jointly fitted smallest design, in one plan with the guards."""
    return shown(FC.forecast(LEAST.fit(series_of(spark, folder), ()), (), predict=LEAST.predict))


@query("forecast_joint_full")
def forecast_joint_full(spark, folder):
    """Window forecasts of the joint model with all terms."""
    full = joint()
    return shown(FC.forecast(full.fit(series_of(spark, folder), EVENTS), EVENTS, predict=full.predict))


@query("predict_daily", sql=Q.query(Q.series(), Q.slices(), Q.fit(EVENTS), Q.future(), select="""
SELECT level, entity, CAST(h AS INTEGER) AS h, ds, round(revenue_yhat, 6) AS revenue_yhat,
       round(spend_yhat, 6) AS spend_yhat FROM predicted"""))
def predict_daily(spark, folder):
    daily = FC.predict_daily(models_of(spark, folder), EVENTS)
    return rounded(daily.select("level", "entity", "h", "ds", "revenue_yhat", "spend_yhat"),
                   6, "revenue_yhat", "spend_yhat")


@query("interval_analytic", sql=Q.query(Q.series(), Q.slices(), Q.fit(EVENTS), Q.future(width=0.95), select="""
SELECT level, entity, ds, round(revenue_yhat - y_half, 6) AS revenue_yhat_lower,
       round(revenue_yhat + y_half, 6) AS revenue_yhat_upper, round(spend_yhat - x_half, 6) AS spend_yhat_lower,
       round(spend_yhat + x_half, 6) AS spend_yhat_upper FROM predicted"""))
def interval_analytic(spark, folder):
    daily = FC.predict_daily(models_of(spark, folder), EVENTS,
                             settings=cfg.ModelSettings(interval_width=0.95))
    bounds = [f"{m}_yhat_{b}" for m in ("revenue", "spend") for b in ("lower", "upper")]
    return rounded(daily.select("level", "entity", "ds", *bounds), 6, *bounds)


@query("interval_monte_carlo", sql=Q.query(Q.forecasts(EVENTS, interval="sum"), select=cells_sql()))
def interval_monte_carlo(spark, folder):
    """Windows of all slices with sampled bounds, days moving together."""
    return shown(FC.forecast(models_of(spark, folder), EVENTS, interval="sum"))


# Draws as many as for a campaign's forecast, and as many trend changes as the largest joint design has.
PATHS = cfg.ModelSettings(uncertainty_samples=200, trend_changes=25.0)


@query("interval_monte_carlo_path", sql=Q.query(Q.forecasts(EVENTS, settings=PATHS, interval="path"), select=cells_sql()))
def interval_monte_carlo_path(spark, folder):
    """Windows of all slices with bounds of whole paths, with simulated trend changes."""
    return shown(FC.forecast(models_of(spark, folder, settings=PATHS), EVENTS, settings=PATHS, interval="path"))


@query("interval_monte_carlo_joint")
def interval_monte_carlo_joint(spark, folder):
    """Bounds of whole paths with the trend changes that the joint model has found."""
    full = joint()
    models = full.fit(series_of(spark, folder), EVENTS)
    return shown(FC.forecast(models, EVENTS, settings=PATHS, interval="path", predict=full.predict))


WITHOUT_SPEND = cfg.ModelSettings(use_spend_regressor=False)


@query("forecast_without_spend", sql=Q.query(Q.forecasts(EVENTS, settings=WITHOUT_SPEND), select=cells_sql()))
def forecast_without_spend(spark, folder):
    """All levels, revenue predicted by its own trend, seasons and events only."""
    return shown(FC.forecast(models_of(spark, folder), EVENTS, settings=WITHOUT_SPEND))


@query("window_forecast", sql=Q.query(Q.forecasts(EVENTS), select=cells_sql(MONEY)))
def window_forecast(spark, folder):
    return shown(FC.window_sums(FC.predict_daily(models_of(spark, folder), EVENTS)), MONEY)


@query("roas_interval", sql=Q.query(Q.forecasts(EVENTS), select=cells_sql(RATIO)))
def roas_interval(spark, folder):
    return shown(FC.forecast(models_of(spark, folder), EVENTS), RATIO)


def _level(key: str, level: str):
    @query(key, sql=Q.query(Q.forecasts(EVENTS, (level,)), select=cells_sql()))
    def run(spark, folder):
        return shown(FC.forecast(models_of(spark, folder, (level,)), EVENTS))
    return run


_level("forecast_aggregate", "aggregate")
_level("forecast_channel", "channel")
_level("forecast_campaign_type", "campaign_type")
_level("forecast_campaign", "campaign")


@query("forecast_slices", sql=Q.query(Q.forecasts(EVENTS, min_nonzero=700), select=cells_sql()))
def forecast_slices(spark, folder):
    """All levels in one job, with a gate of 700 revenue days."""
    settings = cfg.ModelSettings(min_nonzero_days=700)
    return shown(FC.forecast(models_of(spark, folder, settings=settings), EVENTS, settings=settings))


@query("series_fingerprint", sql=Q.query(Q.series(), select="""
SELECT level, entity, bit_xor(CAST('0x' || substr(md5(strftime(ds, '%Y-%m-%d') || '|' || CAST(revenue AS VARCHAR) || '|'
         || CAST(spend AS VARCHAR)), 1, 13) AS BIGINT)) AS fingerprint FROM series GROUP BY level, entity"""))
def series_fingerprint(spark, folder):
    """Content hash of every slice."""
    return model_store.fingerprints(series_of(spark, folder))


@query("refit_changed", sql=Q.query(Q.series(), Q.slices(), Q.fit(EVENTS), select="""
SELECT level, entity, n_days, last_ds AS trained_through, round(beta, 6) AS beta, round(y_sigma, 6) AS y_sigma
FROM slices JOIN coef USING (level, entity)"""))
def refit_changed(spark, folder):
    """Only the account and the channels are stored; the refit has to add the other slices, and the store is
    brought up to date in place."""
    path = shared_folder(spark, "models")
    model_store.save_models(models_of(spark, folder, TOP_LEVELS), path, EVENTS)
    model_store.update_models(series_of(spark, folder), path, EVENTS)
    table = model_store.load_models(spark, path)
    return rounded(table.select("level", "entity", "n_days", "trained_through", "beta", "y_sigma"),
                   6, "beta", "y_sigma")


@query("train_models", sql=Q.query(Q.series(TOP_LEVELS), Q.slices(), Q.fit(EVENTS), select=
    f"SELECT level, entity, target, term, round(coef, 9) + 0 AS coef FROM ({_COEF}) JOIN slices USING (level, entity) "
    "WHERE eligible"))
def train_models(spark, folder):
    path = shared_folder(spark, "models")
    model_store.save_models(model_store.train_models(series_of(spark, folder, TOP_LEVELS), EVENTS), path, EVENTS)
    return rounded(model_coefficients(model_store.load_models(spark, path)), 9, "coef")


PREDICTIONS_SQL = """
SELECT window_days, level, entity, round_even(revenue_lower, 2) AS revenue_lower,
       round_even(revenue_point, 2) AS revenue_point, round_even(revenue_upper, 2) AS revenue_upper,
       round_even(spend_point, 2) AS spend_point, round_even(roas_lower, 4) AS roas_lower,
       round_even(roas_point, 4) AS roas_point, round_even(roas_upper, 4) AS roas_upper FROM forecasts
UNION ALL
SELECT 0, 'trailing_30d', 'all', round_even(trailing_revenue, 2), round_even(trailing_revenue, 2),
       round_even(trailing_revenue, 2), round_even(trailing_spend, 2), round_even(trailing_revenue / trailing_spend, 4),
       round_even(trailing_revenue / trailing_spend, 4), round_even(trailing_revenue / trailing_spend, 4)
FROM recent_days WHERE level = 'aggregate'"""


@query("predictions", sql=Q.query(Q.forecasts(EVENTS), select=PREDICTIONS_SQL))
def predictions(spark, folder):
    models = models_of(spark, folder)
    return FC.prediction_table(models, FC.forecast(models, EVENTS))


@query("predictions_joint", sql=Q.query(LEAST_FORECASTS, select=PREDICTIONS_SQL))
def predictions_joint(spark, folder):
    """The scored table of all levels by the joint model's smallest design."""
    models = LEAST.fit(series_of(spark, folder), ())
    return FC.prediction_table(models, FC.forecast(models, (), predict=LEAST.predict))


@query("refit_joint", sql=Q.query(Q.series(), Q.least_squares(), select="""
SELECT level, entity, count(*) AS n_days, any_value(round(base, 6)) AS base, any_value(round(log_spend, 6)) AS log_spend
FROM series JOIN least USING (level, entity) GROUP BY level, entity"""))
def refit_joint(spark, folder):
    """A store with staged fits of the account and the channels becomes one of joint fits of all slices."""
    path = shared_folder(spark, "models")
    model_store.save_models(models_of(spark, folder, TOP_LEVELS), path, EVENTS)
    series = series_of(spark, folder)
    table = model_store.refit_changed(series, model_store.load_models(spark, path), (), model=LEAST)
    return rounded(table.where("refitted").select(
        "level", "entity", "n_days", F.col("coef")[0].alias("base"), F.col("coef")[2].alias("log_spend")), 6, "base", "log_spend")

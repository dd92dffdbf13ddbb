"""Budget simulation and comparisons with the baseline."""

from __future__ import annotations

from tidemark import config as cfg
from tidemark.operators import budget as B
from tidemark.operators import forecast as FC
from tidemark.plans import sqlblocks as Q
from tidemark.plans.catalog.forecasts import LEAST, cells_sql, shown
from tidemark.plans.catalog.registry import (
    BUDGET_VALUES, BUDGETS, EVENTS, TOP_LEVELS, models_of, query, rounded, series_of)

CHANNEL = ("channel",)
SIM = Q.forecasts(EVENTS, CHANNEL, budget_values=BUDGET_VALUES)
# A gate that no channel passes, so that every channel takes the fallback.
NO_CHANNEL = cfg.ModelSettings(min_calendar_days=5_000)
FALLBACK = f"""budgets(entity, budget) AS (VALUES {BUDGET_VALUES}),
fallback AS (
  SELECT level, entity, window_days, budget * window_days AS spend_point,
         budget * window_days * (total_revenue / greatest(total_spend, 1)) AS revenue_point
  FROM slices JOIN budgets USING (entity) CROSS JOIN (VALUES (30), (60), (90)) AS w(window_days)
  WHERE NOT eligible)"""
FALLBACK_SELECT = """
SELECT level, entity, window_days, round(revenue_point * CAST(0.6 AS DOUBLE), 2) AS revenue_lower,
       round(revenue_point, 2) AS revenue_point, round(revenue_point * CAST(1.4 AS DOUBLE), 2) AS revenue_upper,
       spend_point FROM fallback"""


@query("simulate_channels", sql=Q.query(SIM, select=cells_sql()))
def simulate_channels(spark, folder):
    return shown(B.simulate_channels(models_of(spark, folder, CHANNEL), EVENTS, BUDGETS))


@query("simulate_channels_joint", sql=Q.query(
    f"budgets(entity, budget) AS (VALUES {BUDGET_VALUES})", Q.series(CHANNEL), Q.rolling(), Q.guards(), Q.slices(), Q.least_squares(),
    Q.least_future(budget="LEFT JOIN budgets USING (entity)", spend="coalesce(budget, average_spend)"),
    Q.windows(budget="LEFT JOIN budgets USING (entity)", planned="budget * window_days"), select=cells_sql()))
def simulate_channels_joint(spark, folder):
    """Budgets on channels that the joint model's smallest design was fitted to."""
    models = LEAST.fit(series_of(spark, folder, CHANNEL), ())
    return shown(B.simulate_channels(models, (), BUDGETS, model=LEAST))


def _fallback(spark, folder):
    models = models_of(spark, folder, CHANNEL, NO_CHANNEL)
    return rounded(B.simulate_fallback(models, BUDGETS), 2, "revenue_lower", "revenue_point", "revenue_upper")


@query("simulate_fallback", sql=Q.query(Q.series(CHANNEL), Q.slices(min_days=5_000), FALLBACK,
                                        select=FALLBACK_SELECT))
def simulate_fallback(spark, folder):
    return _fallback(spark, folder)


@query("budget_fallback_channels", sql=Q.query(Q.series(CHANNEL), Q.slices(min_days=5_000), FALLBACK, select="""
SELECT DISTINCT entity, CAST(spend_point / window_days AS DOUBLE) AS budget FROM fallback"""))
def budget_fallback_channels(spark, folder):
    rows = B.with_budget(models_of(spark, folder, CHANNEL, NO_CHANNEL), BUDGETS)
    return rows.where("NOT eligible AND budget IS NOT NULL").select("entity", "budget")


@query("portfolio_projection", sql=Q.query(SIM, select="""
SELECT window_days, round(sum(revenue_lower), 2) AS revenue_lower, round(sum(revenue_point), 2) AS revenue_point,
       round(sum(revenue_upper), 2) AS revenue_upper, round(sum(spend_point), 2) AS spend,
       round(sum(revenue_lower) / greatest(sum(spend_point), 1), 6) AS roas_lower,
       round(sum(revenue_point) / greatest(sum(spend_point), 1), 6) AS roas_point,
       round(sum(revenue_upper) / greatest(sum(spend_point), 1), 6) AS roas_upper
FROM forecasts GROUP BY window_days"""))
def portfolio_projection(spark, folder):
    sums = B.portfolio(models_of(spark, folder, CHANNEL), EVENTS, BUDGETS)
    sums = rounded(sums, 2, "revenue_lower", "revenue_point", "revenue_upper", "spend")
    return rounded(sums, 6, "roas_lower", "roas_point", "roas_upper")


GRID = (5_000.0, 10_000.0, 20_000.0, 40_000.0, 80_000.0)


@query("marginal_roas_curve", sql=Q.query(
    "grid(daily_budget) AS (VALUES " + ", ".join(f"(CAST({b} AS DOUBLE))" for b in GRID) + ")",
    Q.series(CHANNEL), Q.rolling(), Q.guards(), Q.slices(), Q.fit(EVENTS),
    Q.future("level, entity", budget="CROSS JOIN grid", spend="daily_budget").replace(
        "SELECT level, entity, h,", "SELECT level, entity, daily_budget, h,"),
    Q.windows("level, entity", horizons=(30,)).replace(
        "SELECT level, entity, window_days, sum", "SELECT level, entity, daily_budget, window_days, sum").replace(
        "GROUP BY level, entity, window_days", "GROUP BY level, entity, daily_budget, window_days"),
    select="""
SELECT entity, daily_budget, round(revenue_point, 2) AS revenue_point, round(revenue_lower, 2) AS revenue_lower,
       round(revenue_upper, 2) AS revenue_upper, round(revenue_point / greatest(daily_budget * 30, 1), 6) AS roas_point
FROM forecasts WHERE entity = 'N'"""))
def marginal_roas_curve(spark, folder):
    curve = B.marginal_curve(models_of(spark, folder, CHANNEL), EVENTS, "N", GRID)
    return rounded(rounded(curve, 2, "revenue_point", "revenue_lower", "revenue_upper"), 6, "roas_point")


@query("budget_pace", sql=Q.query(Q.series(("aggregate",)), Q.slices(), select=f"""
SELECT CAST({sum(BUDGETS.values())} AS DOUBLE) AS daily_budget, CAST({sum(BUDGETS.values()) * 30} AS DOUBLE) AS monthly_budget,
       round(trailing_spend / 30, 6) AS trailing_daily_spend,
       round(({sum(BUDGETS.values())} / (trailing_spend / 30) - 1) * 100, 6) AS change_pct FROM recent_days"""))
def budget_pace(spark, folder):
    return rounded(B.budget_pace(models_of(spark, folder, ("aggregate",)), BUDGETS),
                   6, "trailing_daily_spend", "change_pct")


@query("uplift_vs_baseline", sql=Q.query(Q.forecasts(
    EVENTS, TOP_LEVELS, budget_values=BUDGET_VALUES), select="""
SELECT window_days, round(simulated, 2) AS simulated, round(baseline, 2) AS baseline,
       round((simulated / baseline - 1) * 100, 6) AS uplift_pct
FROM (SELECT window_days, sum(revenue_point) FILTER (WHERE level = 'channel') AS simulated,
             sum(revenue_point) FILTER (WHERE level = 'aggregate') AS baseline
      FROM forecasts GROUP BY window_days)"""))
def uplift_vs_baseline(spark, folder):
    sides = B.uplift(models_of(spark, folder, TOP_LEVELS), EVENTS, BUDGETS)
    return rounded(rounded(sides, 2, "simulated", "baseline"), 6, "uplift_pct")


@query("forecast_vs_trailing", sql=Q.query(Q.forecasts(EVENTS), select="""
SELECT level, entity, window_days, round(revenue_point, 2) AS revenue_point, trailing_revenue,
       round((revenue_point / nullif(trailing_revenue, 0) - 1) * 100, 6) AS change_pct,
       (revenue_point / nullif(trailing_revenue, 0) - 1) * 100 < -10 AS looks_low
FROM forecasts JOIN recent_days USING (level, entity) WHERE window_days = 30"""))
def forecast_vs_trailing(spark, folder):
    compared = FC.forecast_vs_trailing(FC.forecast(models_of(spark, folder), EVENTS))
    return rounded(rounded(compared, 2, "revenue_point"), 6, "change_pct")

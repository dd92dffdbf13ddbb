"""Budget simulation on fitted channels: the model is fitted once, and only the
spend regressor changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.operators.forecast import forecast
from tidemark.operators.models import STAGED, Model
from tidemark.operators.promo import Event, small_table


def with_budget(models: DataFrame, budgets: Mapping[str, float]) -> DataFrame:
    """Add each channel's daily ``budget``; NULL where none was given."""
    table = small_table(models.sparkSession, [(k, float(v)) for k, v in budgets.items()],
                        "entity string, budget double")
    return models.where(F.col("level") == "channel").join(table, "entity", "left")


def simulate_channels(models: DataFrame, events: Sequence[Event], budgets: Mapping[str, float],
                      settings: cfg.ModelSettings = cfg.ModelSettings(), interval: str = "analytic",
                      model: Model = STAGED) -> DataFrame:
    """Channel forecasts with future spend set to the budget."""
    return forecast(with_budget(models, budgets), events, settings=settings, budget="budget", interval=interval, predict=model.predict)


def _by_ratio() -> dict[str, Column]:
    """Spend and revenue of a window from the budget and the historical ROAS, with a fixed band."""
    low, high = cfg.FALLBACK_BAND
    spend = F.col("budget") * F.col("window_days")
    revenue = spend * S.roas_floor1("total_revenue", "total_spend")
    return {"revenue_lower": revenue * low, "revenue_point": revenue, "revenue_upper": revenue * high, "spend_point": spend}


def simulated(budgeted: DataFrame, events: Sequence[Event], settings: cfg.ModelSettings = cfg.ModelSettings(),
              interval: str = "analytic", keys: Sequence[str] = cfg.SLICE, model: Model = STAGED) -> DataFrame:
    """Windows of slices with a ``budget``: by their model, or, where they have no forecast but a budget, by ratio.

    Both are branches of one projection, so that models are fitted in one pass. ``by_model`` tells which.
    """
    windows = forecast(budgeted, events, keys, settings, budget="budget", interval=interval, everyone=True, predict=model.predict)
    model = F.col("eligible")
    return windows.where(model | F.col("budget").isNotNull()).withColumns(
        {c: F.when(model, F.col(c)).otherwise(v) for c, v in _by_ratio().items()}).withColumn("by_model", model)


def simulate_fallback(models: DataFrame, budgets: Mapping[str, float]) -> DataFrame:
    """Budgeted channels without a forecast: historical ROAS times budget, with a fixed band."""
    return (
        with_budget(models, budgets)
        .where(~F.col("eligible") & F.col("budget").isNotNull())
        .withColumn("window_days", F.explode("horizons"))
        .select("level", "entity", "window_days", *(v.alias(c) for c, v in _by_ratio().items()))
    )


def portfolio(models: DataFrame, events: Sequence[Event], budgets: Mapping[str, float],
              settings: cfg.ModelSettings = cfg.ModelSettings(), interval: str = "analytic",
              model: Model = STAGED) -> DataFrame:
    """Sum of simulated and fallback channels per window."""
    bounds = ("revenue_lower", "revenue_point", "revenue_upper")
    sums = simulated(with_budget(models, budgets), events, settings, interval, model=model).groupBy("window_days").agg(
        *(F.sum(c).alias(c) for c in bounds), F.sum("spend_point").alias("spend"))
    return sums.withColumns({
        f"roas_{b}": S.roas_floor1(f"revenue_{b}", "spend") for b in ("lower", "point", "upper")})


def marginal_curve(models: DataFrame, events: Sequence[Event], channel: str,
                   budgets: Sequence[float], window_days: int = 30,
                   settings: cfg.ModelSettings = cfg.ModelSettings(), interval: str = "analytic",
                   model: Model = STAGED) -> DataFrame:
    """Projected revenue and ROAS of one channel for a list of daily budgets.

    The window has to be one that the models were fitted for; another one stops the query.
    """
    grid = F.explode(F.array(*(F.lit(float(b)) for b in budgets)))
    unknown = F.raise_error(F.lit(f"no window of {window_days} days was fitted")).cast("array<int>")
    fitted_for = F.when(F.array_contains("horizons", window_days), F.col("horizons")).otherwise(unknown)
    priced = models.where((F.col("level") == "channel") & (F.col("entity") == channel)).withColumns(
        {"daily_budget": grid, "horizons": fitted_for})
    keys = (*cfg.SLICE, "daily_budget")
    windows = forecast(priced, events, keys, settings, budget="daily_budget", interval=interval, predict=model.predict)
    spend = F.col("daily_budget") * F.lit(window_days)
    return windows.where(F.col("window_days") == window_days).select(
        "entity", "daily_budget", "revenue_point", "revenue_lower", "revenue_upper",
        S.roas_floor1(F.col("revenue_point"), spend).alias("roas_point"))


def budget_pace(models: DataFrame, budgets: Mapping[str, float]) -> DataFrame:
    """Total daily and monthly budget against the account's trailing daily spend."""
    total = float(sum(budgets.values()))
    daily = F.col("trailing_spend") / cfg.TRAILING_DAYS
    change = (F.try_divide(F.lit(total), daily) - 1.0) * 100.0
    return models.where(F.col("level") == "aggregate").select(
        F.lit(total).alias("daily_budget"), F.lit(total * 30).alias("monthly_budget"),
        daily.alias("trailing_daily_spend"), F.coalesce(change, F.lit(0.0)).alias("change_pct"))


def uplift(models: DataFrame, events: Sequence[Event], budgets: Mapping[str, float],
           settings: cfg.ModelSettings = cfg.ModelSettings(), model: Model = STAGED) -> DataFrame:
    """Simulated portfolio revenue against the account's baseline forecast, per window.

    Account and channels come from the same fitted table: channels carry the
    budget, the account carries none, and one grouping puts them side by side.
    """
    table = small_table(models.sparkSession, [(k, float(v)) for k, v in budgets.items()],
                        "entity string, budget double")
    both = models.where(F.col("level").isin("aggregate", "channel")).join(table, "entity", "left")
    budgeted = both.withColumn(
        "budget", F.when(F.col("level") == "channel", F.col("budget")))
    sides = simulated(budgeted, events, settings, model=model).groupBy("window_days").agg(
        F.sum(F.when(F.col("level") == "channel", F.col("revenue_point"))).alias("simulated"),
        F.sum(F.when(F.col("level") == "aggregate", F.col("revenue_point"))).alias("baseline"))
    change = (F.try_divide(F.col("simulated"), F.col("baseline")) - 1.0) * 100.0
    return sides.withColumn("uplift_pct", F.coalesce(change, F.lit(0.0)))

"""Range forecasts of revenue, spend and ROAS from fitted slices.

A fitted slice is one row, so predicting is a projection over the exploded
future days; no join with the history is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.operators import sampling
from tidemark.operators.promo import Event, with_event

CELLS = tuple(f"{m}_{b}" for m in ("revenue", "spend", "roas") for b in ("lower", "point", "upper"))
_SLICE_COLUMNS = ("channel", "eligible", "last_ds", "average_spend", "floors", "roas_cvs", "horizons",
                  "trailing_revenue", "trailing_spend", "total_revenue", "total_spend")


def band_factor(interval_width: float) -> float:
    """Normal quantile that leaves ``interval_width`` between minus and plus itself."""
    return NormalDist().inv_cdf((1.0 + interval_width) / 2.0)


def last_day(horizon: int | None) -> Column:
    """The given horizon, or the longest window that a slice was fitted for."""
    return F.lit(horizon) if horizon is not None else F.array_max("horizons").cast("int")


def future_days(models: DataFrame, horizon: int | None = None, everyone: bool = False) -> DataFrame:
    """Eligible slices (or ``everyone``) times the days 1..horizon after their last training day."""
    return (
        (models if everyone else models.where("eligible"))
        .withColumn("h", F.explode(F.sequence(F.lit(1), last_day(horizon))))
        .withColumn("ds", F.date_add("last_ds", F.col("h")))
        .withColumn("t", F.datediff("ds", "first_ds").cast("double"))
    )


def predict_daily(models: DataFrame, events: Sequence[Event],
                  keys: Sequence[str] = cfg.SLICE,
                  settings: cfg.ModelSettings = cfg.ModelSettings(),
                  horizon: int | None = None, budget: str | None = None, everyone: bool = False) -> DataFrame:
    """Daily log-scale predictions with bands for revenue and spend.

    ``budget`` names a column with the assumed daily spend; where it is NULL (or
    not given) the slice's historical average spend drives revenue. Without the spend
    regressor revenue follows its own stages only, with the spread they leave.
    ``trend_changes`` adds what sampled intervals need to simulate changes of slope.
    """
    future = with_event(future_days(models, horizon, everyone), events)
    if not settings.use_spend_regressor:
        future = future.withColumns({"beta": F.lit(0.0), "y_sigma": F.col("stages_sigma")})
    trend = {}
    if settings.trend_changes:
        trend = {"bend_rate": F.lit(float(settings.trend_changes)) / F.col("n_days"),
                 "revenue_slope_scale": F.abs("y_slope"), "spend_slope_scale": F.abs("x_slope")}

    def stages(v: str) -> Column:
        value = F.col(f"{v}_base") + F.col(f"{v}_slope") * F.col("t")
        for stage, key in (("dow", F.dayofweek("ds")), ("moy", F.month("ds")), ("event", F.col("event"))):
            value = value + F.coalesce(F.col(f"{stage}_effect")[key][v], F.lit(0.0))
        return value

    assumed = F.col("average_spend") if budget is None else F.coalesce(F.col(budget), F.col("average_spend"))
    z = F.lit(band_factor(settings.interval_width))
    kept = [c for c in dict.fromkeys((*keys, *_SLICE_COLUMNS, *([budget] if budget else [])))]
    extra = [c for c in models.columns if c.startswith("actual_")]
    staged = future.select(
        *kept, *(c for c in extra if c not in kept), "h", "ds", "beta", "y_sigma", "x_sigma",
        *(v.alias(k) for k, v in trend.items()),
        stages("y").alias("y_stages"), stages("x").alias("x_stages"), S.to_log(assumed).alias("x_future"),
    )
    return staged.withColumns({
        "revenue_yhat": F.col("y_stages") + F.col("beta") * (F.col("x_future") - F.col("x_stages")),
        "spend_yhat": F.col("x_stages"),
        "revenue_half": z * F.coalesce("y_sigma", F.lit(0.0)),
        "spend_half": z * F.coalesce("x_sigma", F.lit(0.0)),
    }).withColumns({
        "revenue_yhat_lower": F.col("revenue_yhat") - F.col("revenue_half"),
        "revenue_yhat_upper": F.col("revenue_yhat") + F.col("revenue_half"),
        "spend_yhat_lower": F.col("spend_yhat") - F.col("spend_half"),
        "spend_yhat_upper": F.col("spend_yhat") + F.col("spend_half"),
    }).drop("y_stages", "x_stages", "x_future", "revenue_half", "spend_half")


def in_windows(daily: DataFrame) -> DataFrame:
    """Repeat each future day for every window it belongs to (``window_days``, ``slot``)."""
    spans = F.expr("filter(transform(horizons, (d, i) -> struct(d as window_days, i as slot)), "
                   "w -> h <= w.window_days)")
    return daily.withColumn("span", F.explode(spans)).select("*", "span.window_days", "span.slot").drop("span")


def window_sums(daily: DataFrame, keys: Sequence[str] = cfg.SLICE, floor: bool = True,
                budget: str | None = None) -> DataFrame:
    """Back-transformed daily values summed per window, with floor and ordering guards.

    The daily bounds are summed as they are, so a window's bounds assume days
    that move together. The revenue lower bound is raised to the floor even when
    that exceeds the point; only ``upper >= max(point, lower)`` is enforced.
    """
    bounds = {f"{m}_{b}": F.sum(S.from_log(F.col(f"{m}_yhat_{b}"))) for m in sampling.METRICS for b in ("lower", "upper")}
    return _guarded(_summed(daily, keys, budget, bounds), floor, budget)


def path_sums(daily: DataFrame, settings: cfg.ModelSettings, keys: Sequence[str] = cfg.SLICE, floor: bool = True,
              budget: str | None = None) -> DataFrame:
    """As ``window_sums``, with bounds that are quantiles of the draws' own sums: each draw is one path
    through the window, so days move independently but for simulated changes of trend.

    ``daily`` has draws; a window gathers at most its own days of one slice.
    """
    n = settings.uncertainty_samples
    values = F.struct("h", *(F.transform(f"{m}_draws", S.from_log).alias(f"{m}_values") for m in sampling.METRICS))
    summed = _summed(daily.withColumn("path_day", values), keys, budget, {"path_days": F.array_sort(F.collect_list("path_day"))})
    summed = summed.withColumns({f"{m}_paths": F.array_sort(sampling.path_sum(F.col("path_days"), m, n)) for m in sampling.METRICS})
    bounds = {f"{m}_{b}": sampling.quantile(F.col(f"{m}_paths"), share, n)
              for m in sampling.METRICS for b, share in sampling.tails(settings).items()}
    return _guarded(summed.withColumns(bounds).drop("path_days", *(f"{m}_paths" for m in sampling.METRICS)), floor, budget)


def _summed(daily: DataFrame, keys: Sequence[str], budget: str | None, more: dict[str, Column]) -> DataFrame:
    """One row per slice and window: point sums of both metrics, and what ``more`` names."""
    sums = {f"{m}_point": F.sum(S.from_log(F.col(f"{m}_yhat"))) for m in sampling.METRICS} | more
    arrays = {"revenue_floor": "floors", "roas_cv": "roas_cvs"}
    spread = in_windows(daily).withColumns({c: F.col(a)[F.col("slot")] for c, a in arrays.items()})
    # only fixed-width values are carried through the grouping, which keeps it hash-based
    extra = [c for c in daily.columns if c.startswith("actual_") or c in _SLICE_COLUMNS]
    extra = [c for c in dict.fromkeys((*extra, *arrays, *([budget] if budget else [])))
             if c not in (*keys, *arrays.values(), "horizons", "channel")]
    return spread.groupBy(*keys, "channel", "window_days", "slot").agg(
        *(F.first(c).alias(c) for c in extra), *(s.alias(n) for n, s in sums.items()))


def _guarded(windows: DataFrame, floor: bool, budget: str | None) -> DataFrame:
    if floor:
        windows = windows.withColumn("revenue_lower", F.greatest("revenue_lower", "revenue_floor"))
    windows = windows.withColumns({
        f"{m}_upper": F.greatest(f"{m}_upper", f"{m}_point", f"{m}_lower") for m in sampling.METRICS})
    if budget is not None:
        planned = F.col(budget) * F.col("window_days")
        windows = windows.withColumns({
            f"spend_{b}": F.coalesce(planned, F.col(f"spend_{b}")) for b in ("lower", "point", "upper")})
    return windows


def with_roas(windows: DataFrame) -> DataFrame:
    """ROAS point with a band of plus/minus its historical coefficient of variation."""
    point = S.roas_floor1("revenue_point", "spend_point")
    cv = F.col("roas_cv")
    return windows.withColumn("roas_point", point).withColumns({
        "roas_lower": F.greatest(F.col("roas_point") - F.col("roas_point") * cv,
                                 F.lit(cfg.ROAS_LOWER_BOUND)),
        "roas_upper": F.col("roas_point") + F.col("roas_point") * cv,
    })


def ranges(daily: DataFrame, settings: cfg.ModelSettings = cfg.ModelSettings(), keys: Sequence[str] = cfg.SLICE,
           budget: str | None = None, floor: bool = True, interval: str = "analytic",
           days: int = max(cfg.HORIZONS)) -> DataFrame:
    """Windows of daily predictions with their bounds.

    ``interval``: 'analytic' takes the bands as predicted; 'sum' takes quantiles of simulated draws
    for every day and adds them; 'path' adds each draw over the window and takes quantiles of the
    sums. ``days`` is the last future day that sampled intervals draw for.
    """
    if interval == "path":
        return with_roas(path_sums(sampling.with_draws(daily, keys, settings, days), settings, keys, floor, budget))
    if interval == "sum":
        daily = sampling.with_daily_bounds(daily, keys, settings, days)
    elif interval != "analytic":
        raise ValueError(f"interval must be 'analytic', 'sum' or 'path', not {interval!r}")
    return with_roas(window_sums(daily, keys, floor, budget))


def forecast(models: DataFrame, events: Sequence[Event],
             keys: Sequence[str] = cfg.SLICE,
             settings: cfg.ModelSettings = cfg.ModelSettings(),
             budget: str | None = None, floor: bool = True, interval: str = "analytic",
             days: int = max(cfg.HORIZONS), everyone: bool = False,
             predict: Callable[..., DataFrame] = predict_daily) -> DataFrame:
    """Window forecasts of every eligible slice (or of ``everyone``): lower, point, upper of three metrics."""
    daily = predict(models, events, keys, settings, budget=budget, everyone=everyone)
    return ranges(daily, settings, keys, budget, floor, interval, days)


def forecast_cells(forecasts: DataFrame, keys: Sequence[str] = cfg.SLICE) -> DataFrame:
    return forecasts.select(*keys, "window_days", *CELLS)


def trailing_row(models: DataFrame) -> DataFrame:
    """The account's trailing actuals in the shape of a prediction row."""
    roas = S.roas_zero("trailing_revenue", "trailing_spend")
    cells = {"revenue": F.col("trailing_revenue"), "roas": roas}
    return models.where(F.col("level") == "aggregate").select(
        F.lit(0).alias("window_days"),
        F.lit(f"trailing_{cfg.TRAILING_DAYS}d").alias("level"),
        F.lit("all").alias("entity"),
        *(cells["revenue"].alias(f"revenue_{b}") for b in ("lower", "point", "upper")),
        F.col("trailing_spend").alias("spend_point"),
        *(cells["roas"].alias(f"roas_{b}") for b in ("lower", "point", "upper")),
    )


# Columns of the prediction file.
PREDICTION_COLUMNS = ("window_days", "level", "entity", "revenue_lower", "revenue_point",
                      "revenue_upper", "spend_point", "roas_lower", "roas_point", "roas_upper")


def prediction_table(models: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Scored table: every window of every slice, plus the trailing row, rounded for output."""
    rows = forecasts.select(*PREDICTION_COLUMNS).unionByName(trailing_row(models))
    rounded = {c: S.round_money(F.col(c)) for c in PREDICTION_COLUMNS[3:7]}
    rounded |= {c: S.round_ratio(F.col(c)) for c in PREDICTION_COLUMNS[7:]}
    return rows.withColumns(rounded).select(*PREDICTION_COLUMNS)


# -- comparisons used by reports ---------------------------------------------------

def forecast_vs_trailing(forecasts: DataFrame) -> DataFrame:
    """Shortest-window forecast against the trailing actuals, flagged when it falls over 10 %."""
    change = (F.try_divide(F.col("revenue_point"), F.col("trailing_revenue")) - 1.0) * 100.0
    return forecasts.where(F.col("slot") == 0).select(
        "level", "entity", "window_days", "revenue_point", "trailing_revenue",
        change.alias("change_pct"), (change < -10).alias("looks_low"))


def revenue_share(forecasts: DataFrame) -> DataFrame:
    """Channels' shares of the shortest-window revenue among the displayed channels."""
    shown = displayed(forecasts.where(F.col("level") == "channel"))
    whole = F.sum("revenue_point").over(Window.partitionBy("level"))
    return shown.select("entity", "revenue_point", (F.col("revenue_point") / whole).alias("share"))


def displayed(forecasts: DataFrame) -> DataFrame:
    """Shortest windows whose point is large enough to be shown."""
    return forecasts.where((F.col("slot") == 0) & (F.col("revenue_point") > cfg.DISPLAY_MIN_POINT))


def not_displayed(forecasts: DataFrame) -> DataFrame:
    return forecasts.where((F.col("slot") == 0) & ~(F.col("revenue_point") > cfg.DISPLAY_MIN_POINT))


def campaign_type_ranking(forecasts: DataFrame) -> DataFrame:
    """Campaign types by shortest-window revenue, largest first."""
    return (
        forecasts.where((F.col("level") == "campaign_type") & (F.col("slot") == 0))
        .orderBy(F.col("revenue_point").desc(), "entity")
        .select("entity", "revenue_lower", "revenue_point", "revenue_upper",
                "roas_lower", "roas_point", "roas_upper")
    )


def skipped_slices(models: DataFrame) -> DataFrame:
    """Slices that were seen but are not eligible for a forecast."""
    return models.where(~F.col("eligible")).select("level", "entity", "n_days", "nonzero_days")

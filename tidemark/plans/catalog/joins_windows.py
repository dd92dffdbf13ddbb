"""Joins that the daily series and the forecasts rest on, and the rolling windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions.rolling import full_window_mean, in_lookback, rolling_zscore, sum_by_date, with_rolling_sums
from tidemark.functions import scalars as S
from tidemark.operators import anomalies as A
from tidemark.operators import budget as B
from tidemark.operators import forecast as FC
from tidemark.operators import summary as M
from tidemark.operators.promo import promo_calendar, with_event
from tidemark.operators.series import daily_totals, densify, sparse_series, with_first_gap_days
from tidemark.plans import sqlblocks as Q
from tidemark.plans.catalog.registry import (
    BUDGET_VALUES, BUDGETS, EVENTS, LOOKBACK, TOP_LEVELS, doubles, models_of, query, rounded, series_of)
from tidemark.sources.star_schema import ad_facts


@query("calendar_densify", sql=Q.query(Q.series(min_nonzero=0), select="""
SELECT level, entity, ds, CAST(revenue AS DOUBLE) AS revenue, CAST(spend AS DOUBLE) AS spend FROM series"""))
def calendar_densify(spark, folder):
    dense = densify(daily_totals(ad_facts(spark, folder)))
    return doubles(dense.select("level", "entity", "ds", "revenue", "spend"), "revenue", "spend")


@query("holiday_join", sql=Q.query(Q.series(), Q.event_table(EVENTS), select="""
SELECT level, entity, ds, event, CAST(revenue AS DOUBLE) AS revenue FROM series JOIN promo USING (ds)"""))
def holiday_join(spark, folder):
    days = with_event(series_of(spark, folder), EVENTS).where("event IS NOT NULL")
    return doubles(days.select("level", "entity", "ds", "event", "revenue"), "revenue")


_EVENT_VALUES = ", ".join(f"('{n}', DATE '{d}', {lo}, {hi})" for n, d, lo, hi in EVENTS)


@query("promo_calendar", sql=Q.query(Q.series(("aggregate",)),
    f"events_given(event, day, lo, hi) AS (VALUES {_EVENT_VALUES})", select="""
SELECT event, CAST(date_diff('day', day, ds) AS INTEGER) AS day_offset, count(*) AS n_days,
       CAST(sum(revenue) AS DOUBLE) AS revenue
FROM series JOIN events_given ON date_diff('day', day, ds) BETWEEN lo AND hi GROUP BY ALL"""))
def promo_calendar_days(spark, folder):
    days = series_of(spark, folder, ("aggregate",)).join(promo_calendar(spark, EVENTS), "ds")
    return days.groupBy("event", "day_offset").agg(
        F.count(F.lit(1)).alias("n_days"), F.sum("revenue").cast("double").alias("revenue"))


@query("metric_zip", sql=Q.query(Q.forecasts(EVENTS), select="""
SELECT r.level, r.entity, r.window_days, round(r.revenue_point, 2) AS revenue_point,
       round(s.spend_point, 2) AS spend_point, round(o.roas_point, 6) AS roas_point
FROM forecasts r JOIN forecasts s USING (level, entity, window_days)
JOIN forecasts o USING (level, entity, window_days)"""))
def metric_zip(spark, folder):
    """The three metrics of a window travel in one wide row, so pairing them needs no join."""
    cells = FC.forecast_cells(FC.forecast(models_of(spark, folder), EVENTS))
    cells = cells.select("level", "entity", "window_days", "revenue_point", "spend_point", "roas_point")
    return rounded(rounded(cells, 2, "revenue_point", "spend_point"), 6, "roas_point")


SOME_BUDGETS = {"A": BUDGETS["A"], "N": BUDGETS["N"]}


@query("budget_lookup", sql=Q.query(Q.series(TOP_LEVELS), Q.slices(),
    f"budgets(entity, budget) AS (VALUES ('A', CAST({BUDGETS['A']} AS DOUBLE)), ('N', CAST({BUDGETS['N']} AS DOUBLE)))",
    select="""
SELECT entity, budget, round(average_spend, 6) AS average_spend
FROM slices LEFT JOIN budgets USING (entity) WHERE level = 'channel'"""))
def budget_lookup(spark, folder):
    rows = B.with_budget(models_of(spark, folder, ("channel",)), SOME_BUDGETS)
    return rounded(rows.select("entity", "budget", "average_spend"), 6, "average_spend")


@query("future_frame", sql=Q.query(Q.series(), Q.slices(), select="""
SELECT level, entity, CAST(h AS INTEGER) AS h, CAST(last_ds + CAST(h AS INTEGER) AS DATE) AS ds,
       round(ln(1 + average_spend), 8) AS log_spend
FROM slices CROSS JOIN range(1, 91) AS days(h) WHERE eligible"""))
def future_frame(spark, folder):
    future = FC.future_days(models_of(spark, folder))
    return future.select("level", "entity", "h", "ds", F.round(S.to_log("average_spend"), 8).alias("log_spend"))


@query("horizon_expand", sql=Q.query(Q.series(), Q.slices(), select="""
SELECT level, entity, window_days, count(*) AS n, max(h) AS last_h
FROM slices CROSS JOIN range(1, 91) AS days(h) JOIN (VALUES (30), (60), (90)) AS w(window_days) ON h <= window_days
WHERE eligible GROUP BY ALL"""))
def horizon_expand(spark, folder):
    days = FC.in_windows(FC.future_days(models_of(spark, folder)))
    return days.groupBy("level", "entity", "window_days").agg(
        F.count(F.lit(1)).alias("n"), F.max("h").cast("long").alias("last_h"))


# -- rolling windows -------------------------------------------------------------

@query("rolling_zscore", sql=Q.query(Q.series(), Q.scored(), select="""
SELECT level, entity, ds, round(revenue_z, 6) + 0 AS z FROM scored"""))
def rolling_z(spark, folder):
    z = rolling_zscore(F.col("revenue").cast("double"))
    return series_of(spark, folder).select("level", "entity", "ds", F.round(z, 6).alias("z"))


_SUMS = [f"{c}_{h}d" for h in cfg.HORIZONS for c in ("revenue", "spend")]


@query("rolling_sum_horizons", sql=Q.query(Q.series(), Q.rolling(), select="SELECT level, entity, ds, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in _SUMS) + " FROM rolling"))
def rolling_sum_horizons(spark, folder):
    rolled = with_rolling_sums(series_of(spark, folder), ("revenue", "spend"), cfg.HORIZONS)
    return doubles(rolled.select("level", "entity", "ds", *_SUMS), *_SUMS)


@query("rolling_7d", sql=Q.query(Q.series(), Q.scored(), select="""
SELECT level, entity, ds, CAST(rev7 AS DOUBLE) AS revenue_7d, CAST(spend7 AS DOUBLE) AS spend_7d FROM scored"""))
def rolling_7d(spark, folder):
    rolled = with_rolling_sums(series_of(spark, folder), ("revenue", "spend"), (7,), min_rows={7: 4})
    return doubles(rolled.select("level", "entity", "ds", "revenue_7d", "spend_7d"), "revenue_7d", "spend_7d")


@query("wow_change", sql=Q.query(Q.series(), Q.scored(), select="""
SELECT level, entity, ds, round(revenue_wow, 6) + 0 AS revenue_wow, round(spend_wow, 6) + 0 AS spend_wow FROM scored"""))
def wow_change(spark, folder):
    days = A.scored(series_of(spark, folder))
    return rounded(days.select("level", "entity", "ds", "revenue_wow", "spend_wow"), 6, "revenue_wow", "spend_wow")


@query("rolling_roas", sql=Q.query(Q.series(), Q.rolling(), select="""
SELECT level, entity, ds, """ + ", ".join(
    f"round(CAST(revenue_{h}d AS DOUBLE) / nullif(CAST(spend_{h}d AS DOUBLE), 0), 6) AS roas_{h}d"
    for h in cfg.HORIZONS) + " FROM rolling"))
def rolling_roas(spark, folder):
    rolled = with_rolling_sums(series_of(spark, folder), ("revenue", "spend"), cfg.HORIZONS)
    return rolled.select("level", "entity", "ds", *(
        F.round(S.roas_daily(f"revenue_{h}d", f"spend_{h}d"), 6).alias(f"roas_{h}d") for h in cfg.HORIZONS))


@query("lookback_filter", sql=Q.query(Q.series(), Q.scored(lookback=90), select="""
SELECT level, entity, ds, CAST(revenue AS DOUBLE) AS revenue FROM scored WHERE recent"""))
def lookback_filter(spark, folder):
    days = series_of(spark, folder).withColumn("recent", in_lookback(90)).where("recent")
    return doubles(days.select("level", "entity", "ds", "revenue"), "revenue")


@query("trailing_actuals", sql=Q.query(Q.series(), Q.slices(), select="""
SELECT level, entity, trailing_revenue, trailing_spend,
       round(CASE WHEN trailing_spend > 0 THEN trailing_revenue / trailing_spend ELSE 0 END, 6) AS trailing_roas,
       trailing_start, trailing_end FROM recent_days"""))
def trailing_actuals(spark, folder):
    return rounded(M.trailing_actuals(series_of(spark, folder)), 6, "trailing_roas")


@query("head_after_date", sql=Q.query(Q.series(), Q.slices(), select="""
SELECT level, entity, CAST(last_ds + CAST(h AS INTEGER) AS DATE) AS ds
FROM slices CROSS JOIN range(1, 31) AS days(h) WHERE eligible"""))
def head_after_date(spark, folder):
    future = FC.future_days(models_of(spark, folder))
    return future.where(F.datediff("ds", "last_ds").between(1, 30)).select("level", "entity", "ds")


@query("full_window_mean14", sql=Q.query(Q.series(), Q.scored(), select="""
SELECT level, entity, ds, round(mean14, 6) AS mean14 FROM scored"""))
def full_window_mean14(spark, folder):
    mean = full_window_mean(F.col("revenue").cast("double"))
    return series_of(spark, folder).select("level", "entity", "ds", F.round(mean, 6).alias("mean14"))


# -- the same on series without rows for days without facts ------------------------

@query("sparse_series", sql=Q.query(Q.series(), select="""
SELECT t.level, t.entity, t.ds, CAST(t.revenue AS DOUBLE) AS revenue, CAST(t.spend AS DOUBLE) AS spend,
       coalesce(date_diff('day', t.ds, lead(t.ds) OVER (PARTITION BY t.level, t.entity ORDER BY t.ds)) - 1, 0) AS gap
FROM totals t JOIN series s ON s.level = t.level AND s.entity = t.entity AND s.ds = t.ds"""))
def sparse(spark, folder):
    return doubles(sparse_series(ad_facts(spark, folder)).select("level", "entity", "ds", "revenue", "spend", "gap"), "revenue", "spend")


@query("sparse_statistics", sql=Q.query(Q.series(), Q.rolling(), Q.scored(), select="""
SELECT t.level, t.entity, t.ds, round(revenue_z, 6) + 0 AS revenue_z, round(roas_z, 6) + 0 AS roas_z, round(mean14, 6) + 0 AS mean14,
       round(revenue_wow, 6) + 0 AS revenue_wow, round(spend_wow, 6) + 0 AS spend_wow, """ + ", ".join(
    f"CAST(r.{c} AS DOUBLE) AS {c}" for c in _SUMS) + """
FROM totals t JOIN scored s ON s.level = t.level AND s.entity = t.entity AND s.ds = t.ds
JOIN rolling r ON r.level = t.level AND r.entity = t.entity AND r.ds = t.ds"""))
def sparse_statistics(spark, folder):
    """All rolling statistics on the days that have facts, from frames of days."""
    days = A.scored(sparse_series(ad_facts(spark, folder)), by_date=True)
    days = days.withColumns({f"{c}_{h}d": sum_by_date(c, h) for h in cfg.HORIZONS for c in ("revenue", "spend")})
    shown = ("revenue_z", "roas_z", "mean14", "revenue_wow", "spend_wow")
    return doubles(rounded(days.select("level", "entity", "ds", *shown, *_SUMS), 6, *shown), *_SUMS)


@query("sparse_anomalies", sql=Q.query(Q.series(), Q.scored(), Q.anomalies(), select="""
SELECT DISTINCT ds, type, scope, round(magnitude, 6) AS magnitude, severity, description FROM anomalies"""))
def sparse_anomalies(spark, folder):
    """All anomalies, with only the first days of every gap filled."""
    days = with_first_gap_days(sparse_series(ad_facts(spark, folder)))
    found = A.detect(days, LOOKBACK, by_date=True)
    return rounded(found.select("ds", "type", "scope", "magnitude", "severity", "description"), 6, "magnitude")

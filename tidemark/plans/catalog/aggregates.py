"""Aggregations, summaries, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators import summary as M
from tidemark.operators.slice_model import fit_staged
from tidemark.operators import forecast as FC
from tidemark.plans import sqlblocks as Q
from tidemark.plans.catalog.registry import (
    EVENTS, TOP_LEVELS, doubles, models_of, query, rounded, series_of)
from tidemark.sources.star_schema import ad_facts


def _daily(key: str, level: str):
    @query(key, sql=Q.query(Q.series((level,)), select="""
SELECT entity, ds, CAST(revenue AS DOUBLE) AS revenue, CAST(spend AS DOUBLE) AS spend,
       round(CAST(revenue AS DOUBLE) / nullif(CAST(spend AS DOUBLE), 0), 6) AS roas FROM series"""))
    def run(spark, folder):
        series = series_of(spark, folder, (level,), with_roas=True).select(
            "entity", "ds", "revenue", "spend", "roas")
        return rounded(doubles(series, "revenue", "spend"), 6, "roas")
    return run


_daily("daily_aggregate", "aggregate")
_daily("daily_by_channel", "channel")
_daily("daily_by_campaign_type", "campaign_type")
_daily("daily_by_campaign", "campaign")


@query("daily_features", sql=Q.query(Q.series(), select="""
SELECT level, entity, channel, ds, CAST(revenue AS DOUBLE) AS revenue, CAST(spend AS DOUBLE) AS spend,
       round(CAST(revenue AS DOUBLE) / nullif(CAST(spend AS DOUBLE), 0), 6) AS roas FROM series"""))
def daily_features(spark, folder):
    series = series_of(spark, folder, with_roas=True)
    return rounded(doubles(series, "revenue", "spend"), 6, "roas")


SUMMARY = """types AS (
  SELECT channel, campaign_name, campaign_type,
         row_number() OVER (PARTITION BY channel, campaign_name ORDER BY count(*) DESC, campaign_type) AS rn
  FROM ads GROUP BY channel, campaign_name, campaign_type),
per_day AS (SELECT channel, campaign_name, ds, sum(revenue) AS r FROM ads GROUP BY ALL),
nonzero AS (SELECT channel, campaign_name, count(*) FILTER (WHERE r > 0) AS nonzero_revenue_days
            FROM per_day GROUP BY ALL),
summary AS (
  SELECT channel, campaign_name, any_value(t.campaign_type) AS campaign_type,
         CAST(sum(revenue) AS DOUBLE) AS total_revenue, CAST(sum(spend) AS DOUBLE) AS total_spend,
         round(CAST(sum(revenue) AS DOUBLE) / CAST(sum(spend) AS DOUBLE), 6) AS roas,
         count(DISTINCT ds) AS active_days, any_value(nonzero_revenue_days) AS nonzero_revenue_days
  FROM ads JOIN (SELECT * FROM types WHERE rn = 1) t USING (channel, campaign_name)
  JOIN nonzero USING (channel, campaign_name) GROUP BY channel, campaign_name)"""


def _summary(spark, folder):
    return M.campaign_summary(ad_facts(spark, folder))


def _shown(summary):
    return rounded(doubles(summary, "total_revenue", "total_spend"), 6, "roas")


@query("campaign_summary", sql=Q.query(Q.ADS, SUMMARY, select="SELECT * FROM summary"))
def campaign_summary(spark, folder):
    return _shown(_summary(spark, folder))


@query("top_campaigns", sql=Q.query(Q.ADS, SUMMARY, select="""
SELECT * FROM summary ORDER BY total_revenue DESC, channel, campaign_name LIMIT 20"""))
def top_campaigns(spark, folder):
    return _shown(M.top_campaigns(_summary(spark, folder)))


@query("blended_roas", sql=Q.query(Q.ADS, select="""
SELECT CAST(GROUPING(channel) * 2 + GROUPING(campaign_type) AS BIGINT) AS grouping, channel, campaign_type,
       CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(spend) AS DOUBLE) AS spend,
       round(CAST(sum(revenue) AS DOUBLE) / greatest(CAST(sum(spend) AS DOUBLE), 1), 6) AS roas
FROM ads GROUP BY ROLLUP (channel, campaign_type)"""))
def blended_roas(spark, folder):
    return rounded(doubles(M.blended_roas(ad_facts(spark, folder)), "revenue", "spend"), 6, "roas")


@query("slice_eligibility", sql=Q.query(Q.series(), Q.slices(min_nonzero=700), select="""
SELECT level, entity, n_days, nonzero_days, eligible FROM slices"""))
def slice_eligibility(spark, folder):
    """A gate of 700 revenue days, so that both outcomes occur."""
    return M.slice_eligibility(series_of(spark, folder), cfg.ModelSettings(min_nonzero_days=700))


@query("historical_averages", sql=Q.query(Q.series(), Q.slices(), select="""
SELECT level, entity, round(average_revenue, 6) AS average_revenue, round(average_spend, 6) AS average_spend
FROM slices"""))
def historical_averages(spark, folder):
    return rounded(M.historical_averages(series_of(spark, folder)), 6, "average_revenue", "average_spend")


@query("revenue_floor", sql=Q.query(Q.series(), Q.rolling(), Q.guards(), select="""
SELECT level, entity, window_days, round(revenue_floor, 6) AS revenue_floor FROM guards"""))
def revenue_floor(spark, folder):
    return rounded(M.window_guards(series_of(spark, folder)).drop("roas_cv"), 6, "revenue_floor")


@query("roas_cv", sql=Q.query(Q.series(), Q.rolling(), Q.guards(), select="""
SELECT level, entity, window_days, round(roas_cv, 8) AS roas_cv FROM guards"""))
def roas_cv(spark, folder):
    return rounded(M.window_guards(series_of(spark, folder)).drop("revenue_floor"), 8, "roas_cv")


@query("monthly_revenue", sql=Q.query(Q.series(), select="""
SELECT level, entity, strftime(ds, '%Y-%m') AS month, CAST(sum(revenue) AS DOUBLE) AS revenue,
       month(any_value(ds)) IN (11, 12) AS holiday_season FROM series GROUP BY level, entity, strftime(ds, '%Y-%m')"""))
def monthly_revenue(spark, folder):
    return doubles(M.monthly_revenue(series_of(spark, folder)), "revenue")


@query("revenue_share", sql=Q.query(Q.forecasts(EVENTS, TOP_LEVELS), select="""
SELECT entity, round(revenue_point, 2) AS revenue_point,
       round(revenue_point / sum(revenue_point) OVER (), 8) AS share
FROM forecasts WHERE level = 'channel' AND window_days = 30 AND revenue_point > 100"""))
def revenue_share(spark, folder):
    models = models_of(spark, folder, ("channel",))
    return rounded(rounded(FC.revenue_share(FC.forecast(models, EVENTS)), 2, "revenue_point"), 8, "share")


@query("data_profile", sql=Q.query(Q.ADS, select="""
SELECT channel, count(*) AS n_rows, min(ds) AS first_ds, max(ds) AS last_ds, count(DISTINCT ds) AS n_dates,
       round(CAST(count(*) FILTER (WHERE revenue = 0) AS DOUBLE) / count(*), 8) AS zero_revenue_share,
       count(*) FILTER (WHERE ds IS NULL) AS null_ds,
       count(*) FILTER (WHERE campaign_type IS NULL) AS null_campaign_type,
       count(*) FILTER (WHERE campaign_name IS NULL) AS null_campaign_name,
       count(*) FILTER (WHERE revenue IS NULL) AS null_revenue,
       count(*) FILTER (WHERE spend IS NULL) AS null_spend
FROM ads GROUP BY channel"""))
def data_profile(spark, folder):
    return rounded(M.data_profile(ad_facts(spark, folder)), 8, "zero_revenue_share")


@query("weekly_revenue", sql=Q.query(Q.series(), """weeks AS (
  SELECT level, entity, CAST(date_trunc('week', ds) AS DATE) AS week, sum(revenue) AS revenue
  FROM series GROUP BY ALL),
lagged AS (SELECT *, lag(revenue) OVER (PARTITION BY level, entity ORDER BY week) AS before FROM weeks)""",
    select="""
SELECT level, entity, week, CAST(revenue AS DOUBLE) AS revenue,
       round(CASE WHEN before = 0 AND revenue > 0 THEN CAST('inf' AS DOUBLE)
            ELSE CAST(revenue AS DOUBLE) / nullif(CAST(before AS DOUBLE), 0) - 1 END, 6) + 0 AS change
FROM lagged"""))
def weekly_revenue(spark, folder):
    return rounded(doubles(M.weekly_revenue(series_of(spark, folder)), "revenue"), 6, "change")


@query("campaign_type_ranking", sql=Q.query(Q.forecasts(EVENTS, ("campaign_type",)), select="""
SELECT entity, round(revenue_lower, 2) AS revenue_lower, round(revenue_point, 2) AS revenue_point,
       round(revenue_upper, 2) AS revenue_upper, round(roas_lower, 6) AS roas_lower,
       round(roas_point, 6) AS roas_point, round(roas_upper, 6) AS roas_upper
FROM forecasts WHERE window_days = 30 ORDER BY revenue_point DESC, entity"""))
def campaign_type_ranking(spark, folder):
    ranked = FC.campaign_type_ranking(FC.forecast(models_of(spark, folder, ("campaign_type",)), EVENTS))
    ranked = rounded(ranked, 2, "revenue_lower", "revenue_point", "revenue_upper")
    return rounded(ranked, 6, "roas_lower", "roas_point", "roas_upper")


@query("union_levels", sql=Q.query(Q.forecasts(EVENTS), select="""
SELECT level, window_days, count(*) AS n FROM forecasts GROUP BY ALL
UNION ALL SELECT 'trailing_30d', 0, 1"""))
def union_levels(spark, folder):
    models = models_of(spark, folder)
    table = FC.prediction_table(models, FC.forecast(models, EVENTS))
    return table.groupBy("level", "window_days").agg(F.count(F.lit(1)).alias("n"))


@query("shared_campaign_names", sql=Q.query(Q.ADS, select="""
SELECT campaign_name FROM ads WHERE channel = 'A' INTERSECT SELECT campaign_name FROM ads WHERE channel = 'R'"""))
def shared_campaign_names(spark, folder):
    return M.shared_campaign_names(ad_facts(spark, folder), "A", "R")


@query("skipped_entities", sql=Q.query(Q.series(), Q.slices(min_nonzero=700), select="""
SELECT level, entity, n_days, nonzero_days FROM slices WHERE NOT eligible"""))
def skipped_entities(spark, folder):
    """With a gate of 700 revenue days, so that some slices are skipped."""
    settings = cfg.ModelSettings(min_nonzero_days=700)
    return FC.skipped_slices(fit_staged(series_of(spark, folder), EVENTS, settings=settings))

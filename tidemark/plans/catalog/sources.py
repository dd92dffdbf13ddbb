"""Sources and sinks. The platform files are exported from the supplied tables."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators.forecast import forecast, prediction_table
from tidemark.operators.series import daily_series
from tidemark.plans import sqlblocks as Q
from tidemark.plans.catalog.registry import (
    EVENTS, doubles, models_of, query, series_of)
from tidemark.session import shared_folder
from tidemark.sources import feature_store, model_store, platform_csv
from tidemark.sources.star_schema import ad_facts

CHANNEL_OF = {"bing": "A", "meta": "N", "google": "R"}
OTHER_NAMES = {"meta": "facebook_2001.csv"}


def exported(spark, folder: str, *channels: str, facts=None, names=None) -> str:
    """The supplied facts as platform sources (all three by default) in a fresh shared folder."""
    target = shared_folder(spark, "platforms")
    wanted = {c: CHANNEL_OF[c] for c in channels or CHANNEL_OF}
    platform_csv.export_platform_layout(facts if facts is not None else ad_facts(spark, folder), target, wanted, names)
    return target


def damaged(spark, folder: str):
    """The facts with cells that no reader can use: dates on the 31st, small revenues, no spend on Sundays."""
    facts = ad_facts(spark, folder)
    return facts.select(
        "channel", "campaign_type", "campaign_name",
        F.when(F.dayofmonth("ds") == 31, F.date_format("ds", "'day' D 'of' yyyy")).otherwise(F.col("ds").cast("string")).alias("ds"),
        F.when(F.col("revenue") < 2000, F.lit("n.n.")).otherwise(F.col("revenue").cast("string")).alias("revenue"),
        F.when(F.dayofweek("ds") != 1, F.col("spend")).alias("spend"))


@query("source_discovery", sql=Q.query(Q.ADS, select="""
SELECT position, p.channel, source_name, matched_by, (SELECT count(*) FROM ads WHERE ads.channel = p.code) AS n_rows
FROM (VALUES (0, 'bing', 'A', 'bing_campaign_stats.csv', 'exact'), (1, 'meta', 'N', 'facebook_2001.csv', 'pattern'),
             (2, 'google', 'R', 'google_ads_campaign_stats.csv', 'exact')) AS p(position, channel, code, source_name, matched_by)"""))
def source_discovery(spark, folder):
    """The source chosen for every platform and its rows of data."""
    target = exported(spark, folder, names=OTHER_NAMES)
    rows = platform_csv.resolve_columns(spark, target).where("canonical = 'date'").select("channel", "n_rows")
    return platform_csv.discover_sources(spark, target).join(rows, "channel", "left")


_CELLS = """cells AS (
  SELECT CASE channel WHEN 'A' THEN 'bing' WHEN 'N' THEN 'meta' ELSE 'google' END AS channel, count(*) AS n_rows,
         count(*) FILTER (WHERE day(ds) = 31) AS bad_dates, count(*) FILTER (WHERE revenue < 2000) AS bad_revenues,
         count(*) FILTER (WHERE dayofweek(ds) = 0) AS no_spend FROM ads GROUP BY ALL)"""


@query("resolve_columns", sql=Q.query(Q.ADS, _CELLS, """names(channel, canonical, header_name) AS (VALUES
  ('bing', 'date', 'TimePeriod'), ('bing', 'revenue', 'Revenue'), ('bing', 'spend', 'Spend'), ('bing', 'name', 'CampaignName'),
  ('bing', 'type', 'CampaignType'), ('meta', 'date', 'date_start'), ('meta', 'revenue', 'conversion'), ('meta', 'spend', 'spend'),
  ('meta', 'name', 'campaign_name'), ('meta', 'type', NULL), ('google', 'date', 'segments_date'),
  ('google', 'revenue', 'metrics_conversions_value'), ('google', 'spend', 'metrics_cost_micros'),
  ('google', 'name', 'campaign_name'), ('google', 'type', 'campaign_advertising_channel_type'))""", select="""
SELECT channel, canonical, header_name, n_rows, CASE canonical WHEN 'spend' THEN no_spend ELSE 0 END AS n_blank,
       CASE canonical WHEN 'date' THEN bad_dates WHEN 'revenue' THEN bad_revenues ELSE 0 END AS n_unreadable
FROM names JOIN cells USING (channel)"""))
def resolve_columns(spark, folder):
    """Header names of the canonical columns, and how many of their cells cannot be used."""
    return platform_csv.resolve_columns(spark, exported(spark, folder, facts=damaged(spark, folder)))


@query("validate_sources", sql=Q.query(Q.ADS, _CELLS, select="""
SELECT channel, TRUE AS found, n_rows, code, subject, n FROM cells, LATERAL (
  SELECT 'bad_cells' AS code, 'date' AS subject, bad_dates AS n UNION ALL SELECT 'bad_cells', 'revenue', bad_revenues
  UNION ALL SELECT 'blank_cells', 'spend', no_spend UNION ALL SELECT 'other_name', 'facebook_2001.csv', NULL WHERE channel = 'meta')
WHERE n IS NULL OR n > 0"""))
def validate_sources(spark, folder):
    """What is wrong with every source, one row for each finding."""
    target = exported(spark, folder, facts=damaged(spark, folder), names=OTHER_NAMES)
    report = platform_csv.validate(spark, target)
    return report.select("channel", "found", "n_rows", F.inline("findings")).select(
        "channel", "found", "n_rows", "code", "subject", F.col("count").alias("n"))


def _two_layouts(spark, folder: str) -> str:
    """One platform in part files of two header orders and spellings; one of them has line breaks inside quotes."""
    target = exported(spark, folder, "bing", facts=ad_facts(spark, folder).where("dayofmonth(ds) % 2 = 0"))
    odd = ad_facts(spark, folder).where(f"channel = '{CHANNEL_OF['bing']}' and dayofmonth(ds) % 2 = 1").select(
        F.col("spend").alias("Cost"), F.format_string('%s\n"%s", next', "campaign_name", "campaign_type").alias("Campaign"),
        F.col("campaign_type").alias("Type"), F.col("ds").alias("Date"), F.col("revenue").alias("sales"))
    odd.write.mode("append").options(header=True, quote='"', escape='"').csv(f"{target}/{cfg.PLATFORMS[0].file_name}")
    return target


@query("read_mixed_layouts", sql=Q.query(Q.ADS, select="""
SELECT 'bing' AS channel, campaign_type, CASE WHEN day(ds) % 2 = 0 THEN campaign_name
         ELSE campaign_name || chr(10) || '"' || campaign_type || '", next' END AS campaign_name, ds,
       count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(spend) AS DOUBLE) AS spend
FROM ads WHERE channel = 'A' GROUP BY ALL"""))
def read_mixed_layouts(spark, folder):
    """Part files of two layouts read back as one platform."""
    target = _two_layouts(spark, folder)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the other platforms are absent
        return per_day(platform_csv.load_all(spark, target))


@query("read_ads_csv", sql=Q.query(Q.ADS, select="""
SELECT CAST(ds AS VARCHAR) AS day_text, count(*) AS n, count(DISTINCT campaign_name) AS n_names
FROM ads WHERE channel = 'A' GROUP BY ds"""))
def read_ads_csv(spark, folder):
    path = f"{exported(spark, folder, 'bing')}/{cfg.PLATFORMS[0].file_name}"
    data, header = platform_csv.read_ads_csv(spark, path)
    return data.groupBy(F.col(header.position("TimePeriod")).alias("day_text")).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct(header.position("CampaignName")).alias("n_names"))


def _platform_sql(channel: str, name: str, kind: str) -> str:
    return Q.query(Q.ADS, select=f"""
SELECT '{channel}' AS channel, {kind} AS campaign_type, {name} AS campaign_name, ds,
       count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(spend) AS DOUBLE) AS spend
FROM ads WHERE channel = '{CHANNEL_OF[channel]}'
GROUP BY {kind}, {name}, ds""")


META_NAME = "campaign_type || '_' || campaign_name"
PLATFORM_SQL = {
    "bing": _platform_sql("bing", "campaign_name", "campaign_type"),
    "meta": _platform_sql("meta", META_NAME, "split_part(campaign_type || '_', '_', 1)"),
    "google": _platform_sql("google", "campaign_name", "campaign_type"),
}


def per_day(facts):
    return doubles(facts.groupBy("channel", "campaign_type", "campaign_name", "ds").agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend")),
        "revenue", "spend")


@query("normalize_bing", sql=PLATFORM_SQL["bing"])
def normalize_bing(spark, folder):
    return per_day(platform_csv.load_platform(spark, exported(spark, folder, "bing"), "bing"))


@query("normalize_meta", sql=PLATFORM_SQL["meta"])
def normalize_meta(spark, folder):
    return per_day(platform_csv.load_platform(spark, exported(spark, folder, "meta"), "meta"))


@query("normalize_google", sql=PLATFORM_SQL["google"])
def normalize_google(spark, folder):
    return per_day(platform_csv.load_platform(spark, exported(spark, folder, "google"), "google"))


@query("union_raw", sql="SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(PLATFORM_SQL.values()) + ")")
def union_raw(spark, folder):
    return per_day(platform_csv.load_all(spark, exported(spark, folder)))


FROM, TO = "1996-03-01", "1999-08-31"


@query("date_range_filter", sql=Q.query(
    Q.series(("aggregate",), where=f"ds BETWEEN DATE '{FROM}' AND DATE '{TO}'"),
    select="SELECT ds, CAST(revenue AS DOUBLE) AS revenue, CAST(spend AS DOUBLE) AS spend FROM series"))
def date_range_filter(spark, folder):
    series = daily_series(ad_facts(spark, folder, FROM, TO), ("aggregate",), start=FROM, end=TO)
    return doubles(series.select("ds", "revenue", "spend"), "revenue", "spend")


def _stored_features(spark, folder):
    path = shared_folder(spark, "features")
    feature_store.save_features(series_of(spark, folder), path)
    return path


_COUNTS = """SELECT level, count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS revenue,
       CAST(sum(spend) AS DOUBLE) AS spend, min(ds) AS first_ds, max(ds) AS last_ds
FROM series GROUP BY level"""


@query("features_sink", sql=Q.query(Q.series(), select=_COUNTS))
def features_sink(spark, folder):
    stored = feature_store.load_features(spark, _stored_features(spark, folder))
    return doubles(stored.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"),
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds")), "revenue", "spend")


@query("features_source", sql=Q.query(Q.series(("channel",)), select="""
SELECT level, entity, ds, CAST(revenue AS DOUBLE) AS revenue, CAST(spend AS DOUBLE) AS spend FROM series"""))
def features_source(spark, folder):
    stored = feature_store.load_features(spark, _stored_features(spark, folder), ("channel",))
    return doubles(stored.select("level", "entity", "ds", "revenue", "spend"), "revenue", "spend")


@query("predictions_sink", sql=Q.query(Q.forecasts(EVENTS), select="""
SELECT window_days, level, entity, round_even(revenue_lower, 2) AS revenue_lower,
       round_even(revenue_point, 2) AS revenue_point, round_even(revenue_upper, 2) AS revenue_upper,
       round_even(spend_point, 2) AS spend_point, round_even(roas_lower, 4) AS roas_lower,
       round_even(roas_point, 4) AS roas_point, round_even(roas_upper, 4) AS roas_upper
FROM forecasts
UNION ALL
SELECT 0, 'trailing_30d', 'all', round_even(trailing_revenue, 2), round_even(trailing_revenue, 2),
       round_even(trailing_revenue, 2), round_even(trailing_spend, 2),
       round_even(trailing_revenue / trailing_spend, 4), round_even(trailing_revenue / trailing_spend, 4),
       round_even(trailing_revenue / trailing_spend, 4)
FROM recent_days WHERE level = 'aggregate'"""))
def predictions_sink(spark, folder):
    models = models_of(spark, folder)
    path = shared_folder(spark, "predictions")
    feature_store.save_predictions(prediction_table(models, forecast(models, EVENTS)), path)
    return feature_store.load_predictions(spark, path)


@query("model_table", sql=Q.query(
    Q.series(), Q.slices(), Q.fit(EVENTS), select="""
SELECT level, entity, n_days, nonzero_days, last_ds AS trained_through, round(beta, 6) AS beta,
       round(y_sigma, 6) AS y_sigma, round(x_sigma, 6) AS x_sigma,
       CAST(0.8 AS DOUBLE) AS setting_interval_width
FROM slices JOIN coef USING (level, entity)"""))
def model_table(spark, folder):
    path = shared_folder(spark, "models")
    model_store.save_models(models_of(spark, folder), path, EVENTS)
    return model_store.load_models(spark, path).select(
        "level", "entity", "n_days", "nonzero_days", "trained_through",
        *(F.round(c, 6).alias(c) for c in ("beta", "y_sigma", "x_sigma")), "setting_interval_width")

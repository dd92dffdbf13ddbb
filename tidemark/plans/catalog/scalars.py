"""Scalar expressions, each run over all facts or all daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import anomalies as A
from tidemark.operators.forecast import displayed, forecast
from tidemark.plans import sqlblocks as Q
from tidemark.plans.catalog.registry import (
    EVENTS, LOOKBACK, TOP_LEVELS, doubles, models_of, query, rounded, series_of)
from tidemark.sources.platform_csv import spend_is_micros
from tidemark.sources.star_schema import ad_facts


@query("parse_date", sql="""
SELECT CAST(l_shipdate AS DATE) AS ds, count(*) AS n FROM lineitem GROUP BY 1""")
def parse_date(spark, folder):
    """Dates written in two notations, read back."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(
        F.date_format("l_shipdate", "M/d/yyyy"))
    return lines.groupBy(S.parse_date(text).alias("ds")).agg(F.count(F.lit(1)).alias("n"))


@query("coerce_numeric", sql="""
SELECT l_returnflag AS channel, count(*) AS n,
       count(*) FILTER (WHERE l_linenumber % 4 IN (1, 2)) AS n_numbers,
       CAST(sum(CASE WHEN l_linenumber % 4 IN (1, 2) THEN CAST(l_extendedprice AS DECIMAL(18,4)) END) AS DOUBLE)
         AS total
FROM lineitem GROUP BY l_returnflag""")
def coerce_numeric(spark, folder):
    """Amounts as text: plain, padded, with a suffix letter, with a thousands comma."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    plain = F.col("l_extendedprice").cast("decimal(18,4)").cast("string")
    kind = F.col("l_linenumber") % 4
    text = (F.when(kind == 1, plain).when(kind == 2, F.concat(F.lit("  "), plain))
            .when(kind == 3, F.concat(plain, F.lit("d"))).otherwise(F.concat(F.lit("1,"), plain)))
    amount = S.coerce_numeric(text)
    return lines.groupBy(F.col("l_returnflag").alias("channel")).agg(
        F.count(F.lit(1)).alias("n"), F.count(amount).alias("n_numbers"),
        F.sum(amount.cast("decimal(18,4)")).cast("double").alias("total"))


@query("clip_zero", sql=Q.query(Q.ADS, select="""
SELECT channel, ds, CAST(sum(greatest(revenue - 30000, 0)) AS DOUBLE) AS clipped FROM ads GROUP BY ALL"""))
def clip_zero(spark, folder):
    facts = ad_facts(spark, folder)
    over = S.clip_zero(F.col("revenue").cast("double") - 30000.0).cast("decimal(18,4)")
    return facts.groupBy("channel", "ds").agg(F.sum(over).cast("double").alias("clipped"))


@query("fill_zero", sql=Q.query(Q.ADS, select="""
SELECT channel, ds, count(*) AS n, CAST(sum(coalesce(nullif(spend, 0), 0)) AS DOUBLE) AS spend
FROM ads GROUP BY ALL"""))
def fill_zero(spark, folder):
    facts = ad_facts(spark, folder)
    spend = F.when(F.col("spend") > 0, F.col("spend").cast("double"))
    filled = S.fill_zero(spend).cast("decimal(18,4)")
    return facts.groupBy("channel", "ds").agg(
        F.count(filled).alias("n"), F.sum(filled).cast("double").alias("spend"))


@query("default_label", sql=Q.query(Q.ADS, select="""
SELECT CASE WHEN campaign_name = 'Brand#1' THEN 'nan' ELSE campaign_name END AS label,
       'unknown' AS missing_label, count(*) AS n FROM ads GROUP BY ALL"""))
def default_label(spark, folder):
    name = F.when(F.col("campaign_name") != "Brand#1", F.col("campaign_name"))
    return ad_facts(spark, folder).groupBy(
        S.clean_label(name).alias("label"), S.clean_label(None).alias("missing_label")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("type_from_prefix", sql=Q.query(Q.ADS, select="""
SELECT campaign_type AS prefix, count(*) AS n FROM ads GROUP BY ALL"""))
def type_from_prefix(spark, folder):
    name = F.concat_ws("_", "campaign_type", "campaign_name", F.lit("x"))
    return ad_facts(spark, folder).groupBy(S.type_from_prefix(name).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"))


@query("micros_to_usd", sql=Q.query(Q.ADS, select="""
SELECT channel, ds, CAST(sum(spend) AS DOUBLE) AS from_micros,
       CAST(sum(CASE WHEN (SELECT median(CAST(spend AS DOUBLE)) FROM ads) > 10000 THEN CAST(spend / 1000000 AS DECIMAL(18,4))
                ELSE spend END) AS DOUBLE) AS from_units
FROM ads GROUP BY ALL"""))
def micros_to_usd(spark, folder):
    """The same spend once in millionths and once in units: both end in units."""
    facts = ad_facts(spark, folder).withColumns({
        "micros": F.col("spend").cast("double") * 1e6, "units": F.col("spend").cast("double")})
    paid = facts.withColumns({c: S.micros_to_units(F.col(c), spend_is_micros(facts, c)).cast("decimal(18,4)")
                              for c in ("micros", "units")})
    return paid.groupBy("channel", "ds").agg(
        F.sum("micros").cast("double").alias("from_micros"), F.sum("units").cast("double").alias("from_units"))


def _ratio(key: str, expression: str, function):
    @query(key, sql=Q.query(Q.series(), select=f"""
SELECT level, entity, ds, round({expression}, 6) AS roas
FROM (SELECT *, CAST(revenue AS DOUBLE) AS r, CAST(spend AS DOUBLE) AS s FROM series)"""))
    def run(spark, folder):
        return series_of(spark, folder).select(
            "level", "entity", "ds", F.round(function("revenue", "spend"), 6).alias("roas"))
    return run


_ratio("roas_daily", "r / nullif(s, 0)", S.roas_daily)
_ratio("roas_zero", "CASE WHEN s > 0 THEN r / s ELSE 0 END", S.roas_zero)
_ratio("roas_floor1", "r / greatest(s, 1)", S.roas_floor1)


@query("log1p_transform", sql=Q.query(Q.series(), select="""
SELECT level, entity, ds, round(ln(1 + CAST(revenue AS DOUBLE)), 8) AS y,
       round(ln(1 + CAST(spend AS DOUBLE)), 8) AS x FROM series"""))
def log1p_transform(spark, folder):
    return series_of(spark, folder).select(
        "level", "entity", "ds", F.round(S.to_log("revenue"), 8).alias("y"),
        F.round(S.to_log("spend"), 8).alias("x"))


@query("expm1_back", sql=Q.query(Q.series(), select="""
SELECT level, entity, ds, round(CAST(revenue AS DOUBLE), 4) AS revenue,
       round(exp(greatest(ln(1 + CAST(revenue AS DOUBLE)) - 10, 0)) - 1, 4) AS shifted FROM series"""))
def expm1_back(spark, folder):
    y = S.to_log("revenue")
    return series_of(spark, folder).select(
        "level", "entity", "ds", F.round(S.from_log(y), 4).alias("revenue"),
        F.round(S.from_log(y - 10), 4).alias("shifted"))


@query("round_output", sql=Q.query(Q.series(), select="""
SELECT level, entity, CAST(month(ds) AS INTEGER) AS moy, round_even(CAST(sum(revenue) AS DOUBLE) / count(*), 2) AS money,
       round_even(CAST(sum(revenue) AS DOUBLE) / nullif(CAST(sum(spend) AS DOUBLE), 0), 4) AS ratio
FROM series GROUP BY ALL"""))
def round_output(spark, folder):
    return series_of(spark, folder).groupBy("level", "entity", F.month("ds").alias("moy")).agg(
        S.round_money(F.sum("revenue").cast("double") / F.count(F.lit(1))).alias("money"),
        S.round_ratio(S.roas_daily(F.sum("revenue"), F.sum("spend"))).alias("ratio"))


_SCORED = Q.query(Q.series(), Q.scored(lookback=LOOKBACK), select="""
SELECT level, entity, {} AS label, count(*) AS n FROM scored WHERE revenue_z IS NOT NULL GROUP BY ALL""")


@query("severity_case", sql=_SCORED.format("CASE WHEN abs(revenue_z * 2) > 4 THEN 'high' ELSE 'medium' END"))
def severity_case(spark, folder):
    """Doubled scores, because a plain 14-day score can never exceed 4."""
    days = A.scored(series_of(spark, folder), LOOKBACK).where("revenue_z IS NOT NULL")
    return days.groupBy("level", "entity", S.severity(F.col("revenue_z") * 2).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@query("direction_case", sql=_SCORED.format("CASE WHEN revenue_z > 0 THEN 'spike' ELSE 'drop' END"))
def direction_case(spark, folder):
    days = A.scored(series_of(spark, folder), LOOKBACK).where("revenue_z IS NOT NULL")
    return days.groupBy("level", "entity", S.direction(F.col("revenue_z")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@query("anomaly_description", sql=Q.query(
    Q.series(), Q.scored(lookback=LOOKBACK), Q.anomalies(everywhere=True),
    select="SELECT ds, type, scope, description FROM anomalies"))
def anomaly_description(spark, folder):
    found = A.detect(series_of(spark, folder), LOOKBACK, everywhere=True)
    return found.select("ds", "type", "scope", "description")


@query("entity_label", sql=Q.query(Q.ADS, select="""
SELECT channel || '/' || campaign_type AS type_label, channel || '/' || campaign_name AS campaign_label,
       count(*) AS n FROM ads GROUP BY ALL"""))
def entity_label(spark, folder):
    return ad_facts(spark, folder).groupBy(
        S.entity_label("channel", "campaign_type").alias("type_label"),
        S.entity_label("channel", "campaign_name").alias("campaign_label"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("title_upper", sql="""
SELECT upper(left(event_type, 1)) || lower(substr(event_type, 2)) AS title, upper(event_type) AS upper_text,
       count(*) AS n FROM events GROUP BY ALL""")
def title_upper(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    return events.groupBy(S.title_case(F.col("event_type")).alias("title"),
                          F.upper("event_type").alias("upper_text")).agg(F.count(F.lit(1)).alias("n"))


@query("usd_format", sql=Q.query(Q.series(), select="""
SELECT level, entity, CAST(month(ds) AS INTEGER) AS moy,
       CASE WHEN v >= 1000000 THEN printf('$%.2fM', v / 1000000)
            WHEN v >= 1000 THEN printf('$%.1fK', v / 1000) ELSE printf('$%.0f', v) END AS revenue
FROM (SELECT level, entity, ds, CAST(sum(revenue) OVER (PARTITION BY level, entity, month(ds)) AS DOUBLE) AS v,
             row_number() OVER (PARTITION BY level, entity, month(ds) ORDER BY ds) AS rn FROM series)
WHERE rn = 1"""))
def usd_format(spark, folder):
    return series_of(spark, folder).groupBy("level", "entity", F.month("ds").alias("moy")).agg(
        S.usd_text(F.sum("revenue")).alias("revenue"))


@query("display_threshold", sql=Q.query(Q.forecasts(EVENTS, TOP_LEVELS), select="""
SELECT level, entity, round(revenue_point, 2) AS revenue_point
FROM forecasts WHERE window_days = 30 AND revenue_point > 100"""))
def display_threshold(spark, folder):
    shown = displayed(forecast(models_of(spark, folder, TOP_LEVELS), EVENTS))
    return rounded(shown.select("level", "entity", "revenue_point"), 2, "revenue_point")

"""Summaries and profiles of the facts and the daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.functions.rolling import with_rolling_sums
from tidemark.operators.slice_model import eligible, floor_and_cv, trailing_aggregates


def campaign_summary(facts: DataFrame) -> DataFrame:
    """Totals, ROAS, day counts and the most frequent type of every campaign, from one scan without a join.

    The facts are first reduced to one cell per campaign, type and day, and the cells are dealt by
    campaign once; what a day and what a type adds up to are window values on these. Rows without a
    date count in the sums but not in the day counts; of equally frequent types the first by name wins.
    """
    campaign = ("channel", "campaign_name")
    cells = facts.groupBy(*campaign, "campaign_type", "ds").agg(
        F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"),
        F.count(F.lit(1)).alias("n")).repartition(*campaign)
    of_day = Window.partitionBy(*campaign, "ds")
    speaks = F.col("ds").isNotNull() & (F.row_number().over(of_day.orderBy("campaign_type")) == 1)
    cells = cells.withColumns({
        "type_n": F.sum("n").over(Window.partitionBy(*campaign, "campaign_type")),
        "day_revenue": F.sum("revenue").over(of_day), "speaks": speaks})
    return cells.groupBy(*campaign).agg(
        F.min(F.struct((-F.col("type_n")).alias("order"), "campaign_type")).alias("best"),
        F.sum("revenue").alias("total_revenue"), F.sum("spend").alias("total_spend"),
        F.count_if("speaks").alias("active_days"),
        F.count_if(F.col("speaks") & (F.col("day_revenue") > 0)).alias("nonzero_revenue_days"),
    ).select(
        *campaign, F.col("best.campaign_type").alias("campaign_type"), "total_revenue", "total_spend",
        S.roas_zero("total_revenue", "total_spend").alias("roas"),
        "active_days", "nonzero_revenue_days")


def top_campaigns(summary: DataFrame, k: int = 20) -> DataFrame:
    return summary.orderBy(F.col("total_revenue").desc(), "channel", "campaign_name").limit(k)


def blended_roas(facts: DataFrame) -> DataFrame:
    """Total revenue over total spend: overall, per channel, per channel and type.

    The facts are combined per channel and type before the rollup repeats them.
    """
    cells = facts.groupBy("channel", "campaign_type").agg(
        F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"))
    return cells.rollup("channel", "campaign_type").agg(
        F.grouping_id().alias("grouping"),
        F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"),
    ).select("grouping", "channel", "campaign_type", "revenue", "spend",
             S.roas_floor1("revenue", "spend").alias("roas"))


def slice_eligibility(series: DataFrame,
                      settings: cfg.ModelSettings = cfg.ModelSettings()) -> DataFrame:
    days = series.groupBy(*cfg.SLICE).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.count_if(F.col("revenue") > 0).alias("nonzero_days"))
    return days.withColumn("eligible", eligible(settings))


def historical_averages(series: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return series.groupBy(*cfg.SLICE).agg(
        (F.sum("revenue").cast("double") / n).alias("average_revenue"),
        (F.sum("spend").cast("double") / n).alias("average_spend"))


def window_guards(series: DataFrame, horizons: Sequence[int] = cfg.HORIZONS) -> DataFrame:
    """(slice, window_days, revenue_floor, roas_cv) from the rolling sums."""
    rolled = with_rolling_sums(series, ("revenue", "spend"), horizons)
    cells = []
    for h in horizons:
        floor, cv = floor_and_cv(h)
        cells.append(F.struct(F.lit(h).alias("window_days"), floor.alias("revenue_floor"),
                              cv.alias("roas_cv")))
    return rolled.groupBy(*cfg.SLICE).agg(F.array(*cells).alias("cells")).select(
        *cfg.SLICE, F.inline("cells"))


def trailing_actuals(series: DataFrame, days: int = cfg.TRAILING_DAYS) -> DataFrame:
    """Revenue, spend, ROAS and the period of each series' last ``days`` rows."""
    last = F.max("ds").over(Window.partitionBy(*cfg.SLICE))
    return series.withColumn("last_ds", last).groupBy(*cfg.SLICE).agg(
        *trailing_aggregates(days), F.first("last_ds").alias("trailing_end"),
    ).select(*cfg.SLICE, "trailing_revenue", "trailing_spend",
             S.roas_zero("trailing_revenue", "trailing_spend").alias("trailing_roas"),
             "trailing_start", "trailing_end")


def monthly_revenue(series: DataFrame) -> DataFrame:
    """Revenue per series and calendar month; November and December are flagged."""
    return series.groupBy(*cfg.SLICE, F.date_format("ds", "yyyy-MM").alias("month")).agg(
        F.sum("revenue").alias("revenue")
    ).withColumn("holiday_season", F.substring("month", 6, 2).isin("11", "12"))


def weekly_revenue(series: DataFrame) -> DataFrame:
    """Revenue per series and ISO week with the change against the week before."""
    weeks = series.groupBy(*cfg.SLICE, F.trunc("ds", "week").alias("week")).agg(
        F.sum("revenue").alias("revenue"))
    before = F.lag("revenue").over(Window.partitionBy(*cfg.SLICE).orderBy("week"))
    return weeks.withColumn("change", S.relative_change(F.col("revenue"), before))


def data_profile(facts: DataFrame) -> DataFrame:
    """Rows, date range, distinct dates, zero-revenue share and NULL counts per channel.

    The facts are reduced to (channel, day) first, so a dominant channel never
    meets in one task and the distinct dates need no second expansion.
    """
    columns = ("campaign_type", "campaign_name", "revenue", "spend")
    cells = facts.groupBy("channel", "ds").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("revenue") == 0).alias("zero"),
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))
    return cells.groupBy("channel").agg(
        F.sum("n").alias("n_rows"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.count("ds").alias("n_dates"),
        (F.sum("zero") / F.sum("n")).alias("zero_revenue_share"),
        F.coalesce(F.sum(F.when(F.col("ds").isNull(), F.col("n"))), F.lit(0)).alias("null_ds"),
        *(F.sum(f"null_{c}").alias(f"null_{c}") for c in columns))


def shared_campaign_names(facts: DataFrame, one: str, other: str) -> DataFrame:
    """Campaign names that occur in both channels; each side shrinks to its names before it is shuffled."""
    def names(channel: str) -> DataFrame:
        return facts.where(F.col("channel") == channel).select("campaign_name").distinct()

    return names(one).intersect(names(other))

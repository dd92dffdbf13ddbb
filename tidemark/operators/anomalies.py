"""Anomaly detection over daily series: one scored pass for all scopes.

Rules: revenue z-score (any scope), ROAS collapse and spend-revenue decoupling
(account, or any scope on request). Because the z window includes the scored
day, |z| is at most 3.47, so a z anomaly is never of high severity.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.functions.rolling import (
    by_day, full_mean_by_date, full_window_mean, in_lookback, rolling_zscore, sum_by_date, with_rolling_sums, zscore_by_date)

COLUMNS = ("ds", "type", "scope", "magnitude", "magnitude_unit", "severity", "description")


def scored(series: DataFrame, lookback_days: int = cfg.LOOKBACK_DAYS,
           keys: Sequence[str] = cfg.SLICE, exclude_current: bool = False, by_date: bool = False) -> DataFrame:
    """Daily series with z-scores, week-over-week changes and the lookback flag.

    ``by_date`` is for series that have no rows for (some) days without facts.
    """
    revenue = F.col("revenue").cast("double")
    roas = S.roas_daily("revenue", "spend")
    n, need = cfg.WEEK_ROWS, cfg.WEEK_MIN_ROWS
    week = f"_{n}d"
    if by_date:
        rolled = series.withColumns({f"{c}{week}": sum_by_date(c, n, keys, need) for c in ("revenue", "spend")})
        score = partial(zscore_by_date, keys=keys, exclude_current=exclude_current)
        mean = full_mean_by_date(revenue, keys)
    else:
        rolled = with_rolling_sums(series, ("revenue", "spend"), (n,), keys, {n: need})
        score = partial(rolling_zscore, keys=keys, exclude_current=exclude_current)
        mean = full_window_mean(revenue, keys)

    def wow(c: str) -> Column:
        before = sum_by_date(c, n, keys, need, lag=n) if by_date else F.lag(c + week, n).over(by_day(keys))
        return S.relative_change(F.col(c + week), before)

    return rolled.withColumns({
        "roas": roas,
        "revenue_z": score(revenue),
        "roas_z": score(F.coalesce(roas, F.lit(0.0))),
        "mean14": mean,
        "revenue_wow": wow("revenue"),
        "spend_wow": wow("spend"),
        "recent": in_lookback(lookback_days, keys),
    })


def _whole(c: Column) -> Column:
    return S.fixed(c.cast("double"), 0)


def candidates(days: DataFrame, z_threshold: float = cfg.Z_THRESHOLD,
               everywhere: bool = False) -> DataFrame:
    """Rows that break a rule, one output row per (day, scope, rule).

    ``everywhere=True`` applies the account-only rules to every scope.
    """
    z, roas_z = F.col("revenue_z"), F.col("roas_z")
    account = F.lit(True) if everywhere else F.col("level") == "aggregate"
    threshold = F.lit(float(z_threshold))
    off_mean = F.coalesce(_whole(F.abs(F.col("revenue") - F.col("mean14"))), F.lit("nan"))
    revenue_text = F.when(
        F.col("level") == "aggregate",
        F.format_string(cfg.TEXT_REVENUE, S.direction(z), off_mean, S.fixed(F.abs(z), 1)),
    ).otherwise(F.format_string(
        cfg.TEXT_CHANNEL, F.initcap("entity"), S.direction(z), S.fixed(F.abs(z), 1),
        _whole(F.col("revenue")), _whole(F.col("spend"))))
    roas_text = F.format_string(
        cfg.TEXT_ROAS, F.coalesce(S.fixed(F.col("roas"), 2), F.lit("nan")), S.fixed(F.abs(roas_z), 1),
        _whole(F.col("spend")), _whole(F.col("revenue")))
    decoupling_text = F.format_string(
        cfg.TEXT_DECOUPLING, S.percent(F.col("spend_wow")), S.percent(F.abs(F.col("revenue_wow"))))

    def finding(rule: Column, kind: Column, magnitude: Column, unit: str, grade: Column,
                text: Column) -> Column:
        return F.when(rule, F.struct(
            kind.alias("type"), magnitude.alias("magnitude"), F.lit(unit).alias("magnitude_unit"),
            grade.alias("severity"), text.alias("description")))

    findings = F.array_compact(F.array(
        finding(F.abs(z) >= threshold, F.concat(F.lit("revenue_"), S.direction(z)),
                F.abs(z), "sigma", S.severity(z), revenue_text),
        finding(account & (roas_z <= -threshold), F.lit("roas_collapse"),
                F.abs(roas_z), "sigma", S.severity(roas_z), roas_text),
        finding(account & (F.col("spend_wow") >= cfg.SPEND_RISE) & (F.col("revenue_wow") <= cfg.REVENUE_FALL),
                F.lit("spend_revenue_decoupling"), F.abs(F.col("revenue_wow")), "fraction",
                F.lit("high"), decoupling_text),
    ))
    scope = F.when(F.col("level") == "aggregate", F.lit("aggregate")).otherwise(F.col("entity"))
    return (
        days.where("recent")
        .select("ds", scope.alias("scope"), F.inline(findings))
        .select(*COLUMNS)
    )


def deduplicated(anomalies: DataFrame) -> DataFrame:
    """The largest finding per (day, type, scope)."""
    w = Window.partitionBy("ds", "type", "scope").orderBy(F.col("magnitude").desc(), "description")
    return anomalies.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def ordered(anomalies: DataFrame) -> DataFrame:
    """Latest day first, largest magnitude first within a day."""
    return anomalies.orderBy(F.col("ds").desc(), F.col("magnitude").desc(), "type", "scope")


def detect(series: DataFrame, lookback_days: int = cfg.LOOKBACK_DAYS,
           z_threshold: float = cfg.Z_THRESHOLD, everywhere: bool = False,
           exclude_current: bool = False, by_date: bool = False) -> DataFrame:
    """All anomalies of the account and the given other scopes, unordered.

    With ``by_date`` the series may be sparse but for the first days of its gaps.
    """
    days = scored(series, lookback_days, exclude_current=exclude_current, by_date=by_date)
    return deduplicated(candidates(days, z_threshold, everywhere))


def top(anomalies: DataFrame, k: int) -> DataFrame:
    """The first ``k`` in report order."""
    return ordered(anomalies).limit(k)


def top_per_scope(anomalies: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("scope").orderBy(F.col("ds").desc(), F.col("magnitude").desc(), "type")
    return anomalies.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def severity_counts(anomalies: DataFrame) -> DataFrame:
    """Counts by severity, with a total row."""
    return (
        anomalies.rollup("severity").agg(F.count(F.lit(1)).alias("n"))
        .select(F.coalesce("severity", F.lit("total")).alias("severity"), "n")
    )


def digest(anomalies: DataFrame, max_items: int = 8) -> DataFrame:
    """One text of the first ``max_items`` findings, or the sentence for none."""
    first = top(anomalies, max_items).select(
        "ds", "magnitude", "type", "scope",
        F.format_string(cfg.TEXT_DIGEST_LINE, F.date_format("ds", "yyyy-MM-dd"),
                        F.upper("severity"), "scope", "description").alias("line"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(
        F.col("ds").desc(), F.col("magnitude").desc(), "type", "scope"))
    lines = F.array_sort(F.collect_list(F.struct("rank", "line")))
    text = F.array_join(F.transform(lines, lambda e: e["line"]), "\n")
    return first.withColumn("rank", rank).agg(
        F.when(F.count(F.lit(1)) == 0, F.lit(cfg.TEXT_NO_ANOMALY)).otherwise(text).alias("summary"))

"""Simulated draws for sampled intervals, held in arrays: one row for each future day, not one for each draw.

All slices share the draws of a day (common random numbers), so they are made once: a table of as many rows as future days,
each with arrays of as many numbers as draws. Its size depends on settings only. A draw is the md5 of its name, the same in
every task, on every machine and in any other engine.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as cfg

METRICS = ("revenue", "spend")
#: Hexadecimal digits of a hash that become a number.
HASH_DIGITS = 13


def uniform(name: str, *parts: Column) -> Column:
    """Uniform in (0, 1) from the md5 of name and parts, joined by colons."""
    text = F.concat_ws(":", F.lit(name), *(p.cast("string") for p in parts))
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10)
    return (digits.cast("double") + 0.5) / float(16**HASH_DIGITS)


def normal(name: str, *parts: Column) -> Column:
    """Standard normal from two uniforms."""
    radius, angle = uniform(f"{name}/r", *parts), uniform(f"{name}/a", *parts)
    return F.sqrt(-2.0 * F.ln(radius)) * F.cos(F.lit(2.0 * math.pi) * angle)


def laplace(name: str, *parts: Column) -> Column:
    """Laplace with scale 1."""
    v = uniform(name, *parts) - 0.5
    return -F.signum(v) * F.ln(F.lit(1.0) - F.lit(2.0) * F.abs(v))


def draws(spark: SparkSession, days: int, settings: cfg.ModelSettings) -> DataFrame:
    """(h, and for each metric its noise, bend and size): one array entry for each draw."""
    n = settings.uncertainty_samples

    def each(kind, name: str) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: kind(f"{name}{settings.seed}", F.col("h"), i))

    columns = {}
    for m in METRICS:
        columns |= {f"{m}_noise": each(normal, f"{m}-noise"), f"{m}_bend": each(uniform, f"{m}-bend"),
                    f"{m}_size": each(laplace, f"{m}-size")}
    return spark.range(1, days + 1).select(F.col("id").cast("int").alias("h")).withColumns(columns)


def quantile(ordered: Column, share: float, n: int) -> Column:
    """The quantile of n sorted values, between two neighbours by their distance."""
    place = share * (n - 1)
    low = math.floor(place)
    part = place - low
    here = F.element_at(ordered, F.lit(low + 1))
    return here if part == 0 else here + (F.element_at(ordered, F.lit(low + 2)) - here) * part


def tails(settings: cfg.ModelSettings) -> dict[str, float]:
    tail = (1.0 - settings.interval_width) / 2.0
    return {"lower": tail, "upper": 1.0 - tail}


def has_trend_changes(daily: DataFrame) -> bool:
    return "bend_rate" in daily.columns


def _drawn(rows: DataFrame, column: str) -> DataFrame:
    """Stops at a day that no draws were made for, which would otherwise lose its bounds."""
    late = F.raise_error(F.lit("a future day lies beyond the days that were drawn; raise `days`")).cast(rows.schema[column].dataType)
    return rows.withColumn(column, F.coalesce(column, late))


def _shifts(daily: DataFrame, table: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, and for each metric an array over draws of its slope changes (day, size)) of every slice.

    A change happens on a day with probability ``bend_rate``; from then on it adds its size every day.
    """
    whole = table.select(F.struct("h", *(f"{m}_{c}" for m in METRICS for c in ("bend", "size"))).alias("d")).agg(
        F.array_sort(F.collect_list("d")).alias("table")).withColumn("one", F.lit(1))
    slices = daily.groupBy(*keys).agg(
        F.first("bend_rate").alias("bend_rate"), F.max("h").alias("days"),
        *(F.first(f"{m}_slope_scale").alias(f"{m}_slope_scale") for m in METRICS)).withColumn("one", F.lit(1))

    def changes(m: str) -> Column:
        def of(i: Column) -> Column:
            hit = F.filter("table", lambda d: (d["h"] <= F.col("days")) & (F.get(d[f"{m}_bend"], i) < F.col("bend_rate")))
            return F.transform(hit, lambda d: F.struct(
                d["h"].alias("h"), (F.get(d[f"{m}_size"], i) * F.col(f"{m}_slope_scale")).alias("size")))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), of)

    # a single row whose size depends on settings only
    return slices.join(F.broadcast(whole), "one").select(*keys, *(changes(m).alias(f"{m}_changes") for m in METRICS))


def with_draws(daily: DataFrame, keys: Sequence[str], settings: cfg.ModelSettings, days: int) -> DataFrame:
    """Adds ``revenue_draws`` and ``spend_draws``: an array of log-scale values of every future day."""
    table = draws(daily.sparkSession, days, settings)
    rows = _drawn(daily.join(F.broadcast(table.select("h", *(f"{m}_noise" for m in METRICS))), "h", "left"), "revenue_noise")
    sigma = {"revenue": F.coalesce("y_sigma", F.lit(0.0)), "spend": F.coalesce("x_sigma", F.lit(0.0))}
    if not has_trend_changes(daily):
        def plain(m: str) -> Column:
            return F.transform(f"{m}_noise", lambda z: F.col(f"{m}_yhat") + sigma[m] * z)

        return rows.withColumns({f"{m}_draws": plain(m) for m in METRICS}).drop(*(f"{m}_noise" for m in METRICS))
    rows = rows.join(_shifts(daily, table, keys, settings.uncertainty_samples), list(keys))

    def value(m: str) -> Column:
        def of(z: Column, i: Column) -> Column:
            late = F.aggregate(F.get(F.col(f"{m}_changes"), i), F.lit(0.0),
                               lambda acc, c: acc + F.greatest(F.col("h") - c["h"] + 1, F.lit(0)) * c["size"])
            return F.col(f"{m}_yhat") + sigma[m] * z + late
        return F.transform(f"{m}_noise", of)

    return rows.withColumns({f"{m}_draws": value(m) for m in METRICS}).drop(
        *(f"{m}_{c}" for m in METRICS for c in ("noise", "changes")))


def with_daily_bounds(daily: DataFrame, keys: Sequence[str], settings: cfg.ModelSettings, days: int) -> DataFrame:
    """Replaces the bands of every day by quantiles of its draws.

    Without trend changes all slices have the same quantiles of noise, and only these are joined.
    """
    n = settings.uncertainty_samples
    if has_trend_changes(daily):
        rows = with_draws(daily, keys, settings, days)
        bounds = {f"{m}_yhat_{b}": quantile(F.array_sort(f"{m}_draws"), share, n)
                  for m in METRICS for b, share in tails(settings).items()}
        return rows.withColumns(bounds).drop(*(f"{m}_draws" for m in METRICS))
    table = draws(daily.sparkSession, days, settings)
    sigma = {"revenue": "y_sigma", "spend": "x_sigma"}
    cuts = table.select("h", *(quantile(F.array_sort(f"{m}_noise"), share, n).alias(f"{m}_{b}_noise")
                               for m in METRICS for b, share in tails(settings).items()))
    bounds = {f"{m}_yhat_{b}": F.col(f"{m}_yhat") + F.coalesce(sigma[m], F.lit(0.0)) * F.col(f"{m}_{b}_noise")
              for m in METRICS for b in tails(settings)}
    return _drawn(daily.join(F.broadcast(cuts), "h", "left"), "revenue_lower_noise").withColumns(bounds).drop(*(c for c in cuts.columns if c != "h"))


def path_sum(days: Column, m: str, n: int) -> Column:
    """For each draw the sum over days (an array of structs with an array of values per metric)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(
        days, F.lit(0.0), lambda acc, d: acc + F.get(d[f"{m}_values"], i)))

"""Daily series at four levels: one long table from one scan of the facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.functions.rolling import by_day

GROUPING = ("channel", "campaign_type", "campaign_name", "ds")
LEVEL_KEYS = {
    "aggregate": ("ds",),
    "channel": ("channel", "ds"),
    "campaign_type": ("channel", "campaign_type", "ds"),
    "campaign": ("channel", "campaign_name", "ds"),
}
ENTITY = {
    "aggregate": lambda: F.lit("all"),
    "channel": lambda: F.col("channel"),
    "campaign_type": lambda: S.entity_label("channel", "campaign_type"),
    "campaign": lambda: S.entity_label("channel", "campaign_name"),
}


def _grouping_number(keys: Sequence[str], used: Sequence[str]) -> int:
    """grouping_id() of a grouping set: one bit per key, set when the key is rolled up."""
    return sum((k not in keys) << (len(used) - 1 - i) for i, k in enumerate(used))


def daily_totals(facts: DataFrame, levels: Sequence[str] = cfg.LEVELS,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """(level, entity, channel, ds, revenue, spend): sums of the days that have facts.

    Several levels share one scan: the facts are first combined to one cell per
    campaign, type and day (on the map side, so a dominant key shrinks before it
    is shuffled), and only the cells are repeated for the grouping sets. A single
    level is a plain grouping.
    Rows without a date belong to no day.
    """
    rows = facts.where(F.col("ds").isNotNull())
    if start is not None:
        rows = rows.where(F.col("ds") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("ds") <= F.lit(end).cast("date"))
    sums = (F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"))

    if len(levels) == 1:
        level = levels[0]
        grouped = rows.groupBy(*LEVEL_KEYS[level]).agg(*sums)
        channel = F.lit(None).cast("string") if level == "aggregate" else F.col("channel")
        return grouped.select(F.lit(level).alias("level"), ENTITY[level]().alias("entity"),
                              channel.alias("channel"), "ds", "revenue", "spend")

    used = [k for k in GROUPING if any(k in LEVEL_KEYS[lv] for lv in levels)]
    sets = [[F.col(k) for k in LEVEL_KEYS[lv]] for lv in levels]
    cells = rows.groupBy(*used).agg(*sums)
    grouped = cells.groupingSets(sets, *used).agg(F.grouping_id().alias("gid"), *sums)
    level: Column | None = None
    entity: Column | None = None
    for lv in levels:
        hit = F.col("gid") == _grouping_number(LEVEL_KEYS[lv], used)
        level = F.when(hit, lv) if level is None else level.when(hit, lv)
        entity = F.when(hit, ENTITY[lv]()) if entity is None else entity.when(hit, ENTITY[lv]())
    return grouped.select(level.alias("level"), entity.alias("entity"), "channel",
                          "ds", "revenue", "spend")


def densify(totals: DataFrame, keys: Sequence[str] = cfg.SLICE, longest_gap: int | None = cfg.LONGEST_GAP,
            most: int | None = None) -> DataFrame:
    """Fill each series' own calendar from its first to its last day with zeros.

    Each day is repeated up to the day before the next one, so no calendar table
    is joined and the facts are not scanned again. A gap of more than ``longest_gap``
    days stops the query, since a date such as 9999-01-01 would make millions of
    days. ``most`` fills only the first days of a gap and has no such limit.
    """
    totals = totals.withColumn("gap", F.coalesce(F.datediff(F.lead("ds").over(by_day(keys)), "ds") - 1, F.lit(0)))
    gap = F.col("gap")
    if most is not None:
        gap = F.least(gap, F.lit(most))
    elif longest_gap is not None:
        far = F.concat(F.lit("no facts for "), gap.cast("string"), F.lit(" days after "), F.col("ds").cast("string"), F.lit(" in "),
                       F.col(keys[-1]), F.lit("; use a sparse series, or raise longest_gap"))
        gap = F.when(gap <= longest_gap, gap).otherwise(F.raise_error(far).cast("int"))
    spread = totals.withColumn("after", F.explode(F.sequence(F.lit(0), gap)))
    real = F.col("after") == 0
    zero = F.lit(0).cast("decimal(1,0)")
    return spread.withColumns({
        "ds": F.date_add("ds", F.col("after")),
        "revenue": F.when(real, F.col("revenue")).otherwise(zero),
        "spend": F.when(real, F.col("spend")).otherwise(zero),
    }).drop("after", "gap")


def _gated(totals: DataFrame, levels: Sequence[str], min_nonzero_days: int) -> DataFrame:
    """Campaign types and campaigns need enough revenue days; the account and the channels are kept as they are."""
    gated = [lv for lv in levels if lv in ("campaign_type", "campaign")]
    if not gated:
        return totals
    nonzero = F.count_if(F.col("revenue") > 0).over(Window.partitionBy(*cfg.SLICE))
    return (
        totals.withColumn("nonzero_days", nonzero)
        .where(~F.col("level").isin(*gated) | (F.col("nonzero_days") >= min_nonzero_days))
        .drop("nonzero_days")
    )


def sparse_series(facts: DataFrame, levels: Sequence[str] = cfg.LEVELS,
                  min_nonzero_days: int = cfg.MIN_NONZERO_DAYS,
                  start: str | None = None, end: str | None = None) -> DataFrame:
    """Daily series without the days that have no facts: never more rows than facts, whatever the dates.

    ``gap`` is the number of days without facts after each row. The ``_by_date`` frames give on
    these days what the gap-free series gives; ``with_first_gap_days`` adds those that still
    differ from day to day, ``gap_free`` all of them.
    """
    totals = _gated(daily_totals(facts, levels, start, end), levels, min_nonzero_days)
    gap = F.coalesce(F.datediff(F.lead("ds").over(by_day(cfg.SLICE)), "ds") - 1, F.lit(0))
    return totals.select("level", "entity", "channel", "ds", "revenue", "spend", gap.alias("gap"))


def with_first_gap_days(sparse: DataFrame, days: int = cfg.Z_WINDOW) -> DataFrame:
    """The first days of every gap as rows of zeros: behind them all frames of ``days`` days are empty."""
    return densify(sparse.drop("gap"), most=days)


def gap_free(sparse: DataFrame, longest_gap: int | None = cfg.LONGEST_GAP) -> DataFrame:
    """The gap-free series, on demand."""
    return densify(sparse.drop("gap"), longest_gap=longest_gap)


def daily_series(facts: DataFrame, levels: Sequence[str] = cfg.LEVELS,
                 min_nonzero_days: int = cfg.MIN_NONZERO_DAYS,
                 start: str | None = None, end: str | None = None,
                 with_roas: bool = False) -> DataFrame:
    """Gap-free daily series. Campaign types and campaigns need enough revenue days;
    the account and the channels are kept as they are."""
    totals = _gated(daily_totals(facts, levels, start, end), levels, min_nonzero_days)
    series = densify(totals).select("level", "entity", "channel", "ds", "revenue", "spend")
    if with_roas:
        series = series.withColumn("roas", S.roas_daily("revenue", "spend"))
    return series

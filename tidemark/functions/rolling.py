"""Rolling frames over daily series.

Every frame is ``PARTITION BY <slice keys> ORDER BY ds``, so all of them share
the one exchange that clusters a series. A series holds at most one row per
calendar day, which bounds each window partition.

Frames of rows need gap-free series. The ``_by_date`` forms have frames of days instead and
count the days without a row as zeros, so that a sparse series gives the same values on the
days it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark import config as cfg


def by_day(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ds")


def trailing(keys: Sequence[str], rows: int) -> WindowSpec:
    return by_day(keys).rowsBetween(-(rows - 1), Window.currentRow)


def with_rolling_sums(series: DataFrame, columns: Sequence[str], lengths: Sequence[int],
                      keys: Sequence[str] = cfg.SLICE,
                      min_rows: dict[int, int] | None = None) -> DataFrame:
    """Add ``<column>_<length>d`` trailing sums, NULL until ``min_rows`` (default half).

    The sums are differences of one running total, so the cost is linear in the
    series length whatever the frame length; with decimal input the differences
    are exact.
    """
    need = min_rows or {n: n // 2 for n in lengths}
    w = by_day(keys)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = {f"__run_{c}": F.sum(c).over(so_far) for c in columns}
    staged = series.withColumns({**running, "__row": F.row_number().over(w)})
    sums = {}
    for n in lengths:
        for c in columns:
            before = F.coalesce(F.lag(f"__run_{c}", n).over(w), F.lit(0))
            sums[f"{c}_{n}d"] = F.when(F.col("__row") >= need[n], F.col(f"__run_{c}") - before)
    return staged.withColumns(sums).drop(*running, "__row")


def rolling_zscore(value: Column, keys: Sequence[str] = cfg.SLICE, rows: int = cfg.Z_WINDOW,
                   exclude_current: bool = False) -> Column:
    """(x - mean)/std over the trailing rows, NULL under half a window or without spread.

    The window includes the current row, which bounds |z| by (n-1)/sqrt(n).
    ``exclude_current`` scores against the preceding rows instead.
    """
    w = trailing(keys, rows)
    if exclude_current:
        w = by_day(keys).rowsBetween(-rows, -1)
    spread = F.stddev_samp(value).over(w)
    enough = F.count(value).over(w) >= rows // 2
    return F.when(enough & (spread > 0), (value - F.avg(value).over(w)) / spread)


def full_window_mean(value: Column, keys: Sequence[str] = cfg.SLICE,
                     rows: int = cfg.Z_WINDOW) -> Column:
    """Mean of exactly ``rows`` rows, NULL before that many exist."""
    w = trailing(keys, rows)
    return F.when(F.count(value).over(w) >= rows, F.avg(value).over(w))


def in_lookback(days: int, keys: Sequence[str] = cfg.SLICE) -> Column:
    """True on the last ``days`` days before (and on) the series' own last day."""
    last = F.max("ds").over(Window.partitionBy(*keys))
    return F.col("ds") >= F.date_sub(last, days)


# -- frames of days, for series whose days without facts have no row -----------------

def days_back(keys: Sequence[str], first: int, last: int = 0) -> WindowSpec:
    """The rows of the days from ``first`` to ``last`` days before."""
    day = F.unix_date("ds")
    return Window.partitionBy(*keys).orderBy(day).rangeBetween(-first, -last)


def days_so_far(keys: Sequence[str]) -> Column:
    """Calendar days of the slice up to and including this one."""
    return F.datediff("ds", F.min("ds").over(Window.partitionBy(*keys))) + 1


def sum_by_date(column: str, days: int, keys: Sequence[str] = cfg.SLICE, need: int | None = None, lag: int = 0) -> Column:
    """Sum over the ``days`` days that end ``lag`` days before, NULL until ``need`` (default half) of them exist."""
    enough = days_so_far(keys) - lag >= (days // 2 if need is None else need)
    total = F.coalesce(F.sum(column).over(days_back(keys, lag + days - 1, lag)), F.lit(0))
    return F.when(enough, total)


def zscore_by_date(value: Column, keys: Sequence[str] = cfg.SLICE, days: int = cfg.Z_WINDOW,
                   exclude_current: bool = False) -> Column:
    """As ``rolling_zscore``; the deviations of at most ``days`` values are added up one by one."""
    last = 1 if exclude_current else 0
    window = days_back(keys, days - 1 + last, last)
    n = F.least(F.lit(days), days_so_far(keys) - last)
    seen = F.collect_list(value).over(window)
    mean = F.coalesce(F.sum(value).over(window), F.lit(0.0)) / n
    spread = F.aggregate(seen, F.lit(0.0), lambda acc, v: acc + (v - mean) * (v - mean)) + (n - F.size(seen)) * mean * mean
    deviation = F.sqrt(spread / F.greatest(n - 1, F.lit(1)))
    return F.when((n >= days // 2) & (n > 1) & (deviation > 0), (value - mean) / deviation)


def full_mean_by_date(value: Column, keys: Sequence[str] = cfg.SLICE, days: int = cfg.Z_WINDOW) -> Column:
    """Mean of exactly ``days`` days, NULL before that many exist."""
    return F.when(days_so_far(keys) >= days, F.sum(value).over(days_back(keys, days - 1)) / days)

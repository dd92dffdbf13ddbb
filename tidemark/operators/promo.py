"""Promotional calendar: events with windows, one label per calendar day."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as cfg

Event = tuple[str, str, int, int]
BROADCAST_ROWS = 20_000


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A DataFrame of driver-side parameters, broadcast only while its row count is small."""
    table = spark.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def _nth_weekday(year: int, month: int, weekday: int, nth: int) -> date:
    first = date(year, month, 1)
    return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (nth - 1))


def events_by_rule(years: Iterable[int]) -> list[Event]:
    """The same five events generated for any years.

    Black Friday follows the fourth Thursday of November, Cyber Monday is three
    days later, Mother's Day is the second Sunday of May, and Prime Day is put
    on the second Tuesday of July.
    """
    width = {name: (lower, upper) for name, _, lower, upper in cfg.PROMO_EVENTS}
    out: list[Event] = []
    for year in years:
        friday = _nth_weekday(year, 11, 3, 4) + timedelta(days=1)
        days = {
            "valentines_day": date(year, 2, 14),
            "mothers_day": _nth_weekday(year, 5, 6, 2),
            "prime_day": _nth_weekday(year, 7, 1, 2),
            "black_friday": friday,
            "cyber_monday": friday + timedelta(days=3),
        }
        out += [(name, day.isoformat(), *width[name]) for name, day in days.items()]
    return out


def event_days(events: Sequence[Event]) -> list[tuple[str, int, date, str]]:
    """(event, offset, day, label of the day). Days shared by events get a joint label."""
    expanded = [
        (name, offset, date.fromisoformat(day) + timedelta(days=offset))
        for name, day, lower, upper in events
        for offset in range(lower, upper + 1)
    ]
    labels: dict[date, set[str]] = defaultdict(set)
    for name, offset, day in expanded:
        labels[day].add(f"{name}{offset:+d}")
    return [(name, offset, day, "|".join(sorted(labels[day]))) for name, offset, day in expanded]


def indicator_names(events: Sequence[Event]) -> list[str]:
    """The distinct event-offset indicators, in order."""
    return sorted({f"{name}{offset:+d}" for name, offset, _, _ in event_days(events)})


def promo_calendar(spark: SparkSession, events: Sequence[Event] = cfg.PROMO_EVENTS) -> DataFrame:
    """(event, day_offset, ds): every day of every event window."""
    rows = [(name, offset, day) for name, offset, day, _ in event_days(events)]
    return small_table(spark, rows, "event string, day_offset int, ds date")


def with_event(series: DataFrame, events: Sequence[Event]) -> DataFrame:
    """Add ``event``: the day's label, NULL on ordinary days.

    The windows are expanded to days beforehand, so the range condition becomes
    an equality join that keeps the partitioning of the series.
    """
    days = sorted({(day, label) for _, _, day, label in event_days(events)})
    labels = small_table(series.sparkSession, days, "ds date, event string")
    return series.join(labels, "ds", "left")

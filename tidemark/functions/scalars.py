"""Scalar column expressions. All stay in the JVM; none raises under ANSI mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config as cfg

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# -- cleaning ---------------------------------------------------------------

#: Notations read besides ISO and the given formats, each with the shape that it must have.
DATE_SHAPES = (
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
)


#: Notations with slashes, tried in this order unless others are given.
SLASHED_DATES = ("M/d/yyyy", "yyyy/M/d")


def parse_date(text: Column, bad_dates: str = "fail",
               formats: Sequence[str] = SLASHED_DATES) -> Column:
    """Text to date. ISO first, then ``formats``, then ``DATE_SHAPES``; a blank stays NULL.

    A bare number such as a spreadsheet serial is not a date.

    ``bad_dates='fail'`` stops the query on an unreadable value, ``'null'``
    turns it into NULL.
    """
    iso = F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), text.try_cast("date"))
    shaped = (F.when(F.trim(text).rlike(shape), F.try_to_date(F.trim(text), f)) for shape, f in DATE_SHAPES)
    slashed = (F.when(text.contains("/"), F.try_to_date(text, f)) if "/" in f else F.try_to_date(text, f) for f in formats)
    parsed = F.coalesce(iso, *slashed, *shaped)
    if bad_dates == "null":
        return parsed
    blank = text.isNull() | (F.trim(text) == "")
    problem = F.concat(F.lit("unreadable date: "), text)
    return F.when(blank | parsed.isNotNull(), parsed).otherwise(F.raise_error(problem).cast("date"))


def coerce_numeric(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def fill_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("double"))


def clip_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0).cast("double"))


def clean_label(text: Column | None) -> Column:
    """A label column as text; NULL texts become 'nan', a missing column 'unknown'."""
    if text is None:
        return F.lit(cfg.MISSING_LABEL)
    return F.when(text.isNull() | text.isin(*cfg.NULL_TEXTS), F.lit(cfg.NULL_LABEL)).otherwise(text)


def type_from_prefix(name: Column) -> Column:
    return F.substring_index(name, "_", 1)


def micros_to_units(value: Column, is_micros: Column) -> Column:
    return F.when(is_micros, value / F.lit(float(cfg.MICROS_PER_UNIT))).otherwise(value)


# -- return on ad spend: three distinct zero-spend rules ---------------------

def roas_daily(revenue: Column | str, spend: Column | str) -> Column:
    """NULL on a day without spend."""
    return F.try_divide(_double(revenue), _double(spend))


def roas_zero(revenue: Column | str, spend: Column | str) -> Column:
    """0 without spend."""
    return F.when(_double(spend) > 0, _double(revenue) / _double(spend)).otherwise(F.lit(0.0))


def roas_floor1(revenue: Column | str, spend: Column | str) -> Column:
    """Denominator never below one currency unit."""
    return _double(revenue) / F.greatest(_double(spend), F.lit(1.0))


# -- transforms ---------------------------------------------------------------

def to_log(amount: Column | str) -> Column:
    return F.log1p(F.greatest(_double(amount), F.lit(0.0)))


def from_log(value: Column) -> Column:
    return F.expm1(F.greatest(value, F.lit(0.0)))


def relative_change(current: Column, previous: Column) -> Column:
    """current/previous - 1; +inf from a zero base, NULL for 0/0 or a missing base."""
    growth = F.try_divide(_double(current), _double(previous)) - 1.0
    from_zero = (previous == 0) & (current > 0)
    return F.when(from_zero, F.lit(float("inf"))).otherwise(growth)


# -- labels and texts ---------------------------------------------------------

def entity_label(*parts: Column | str) -> Column:
    return F.concat_ws("/", *parts)


def severity(z: Column) -> Column:
    return F.when(F.abs(z) > cfg.Z_HIGH, F.lit("high")).otherwise(F.lit("medium"))


def direction(z: Column) -> Column:
    return F.when(z > 0, F.lit("spike")).otherwise(F.lit("drop"))


def fixed(value: Column, digits: int) -> Column:
    """Number as text with a fixed number of decimals, ties to even; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.bround(value, digits)))


def percent(value: Column) -> Column:
    infinite = F.format_string("%s%%", F.lit("inf"))
    return F.when(value == float("inf"), infinite).otherwise(
        F.concat(fixed(value * 100.0, 0), F.lit("%")))


def usd_text(value: Column) -> Column:
    """Short money text: $1.23M, $4.5K, $67."""
    v = _double(value)
    return (
        F.when(v >= 1_000_000, F.concat(F.lit("$"), fixed(v / 1_000_000.0, 2), F.lit("M")))
        .when(v >= 1_000, F.concat(F.lit("$"), fixed(v / 1_000.0, 1), F.lit("K")))
        .otherwise(F.concat(F.lit("$"), fixed(v, 0)))
    )


def title_case(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def round_money(value: Column) -> Column:
    return F.bround(value, 2)


def round_ratio(value: Column) -> Column:
    return F.bround(value, 4)


def day_print(*columns: str) -> Column:
    """52 bits of the md5 of a row's texts; with the exclusive or over rows that differ, the content of a set of rows."""
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")

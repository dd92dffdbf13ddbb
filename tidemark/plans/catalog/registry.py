"""The query registry and the parameters that the registered queries share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators.promo import events_by_rule
from tidemark.operators.series import daily_series
from tidemark.operators.slice_model import fit_staged
from tidemark.sources.star_schema import ad_facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL_CHECKS: dict[str, str] = {}

# The supplied tables cover 1995 to 2001, so the event calendar is generated.
EVENTS = events_by_rule(range(1995, 2003))
BUDGETS = {"A": 12_000.0, "N": 30_000.0, "R": 18_000.0}
BUDGET_VALUES = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in BUDGETS.items())
CUTOFFS = ("1999-01-01", "1999-10-01", "2000-07-01", "2001-04-01")
# Full history: the default lookback leaves hardly any anomaly in the supplied tables.
LOOKBACK = 3000
TOP_LEVELS = ("aggregate", "channel")


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory key, with the SQL that checks it."""
    def register(run: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        QUERIES[key] = run
        if sql is not None:
            SQL_CHECKS[key] = sql
        return run
    return register


def series_of(spark: SparkSession, folder: str, levels: Sequence[str] = cfg.LEVELS, **kw) -> DataFrame:
    return daily_series(ad_facts(spark, folder), levels, **kw)


def models_of(spark: SparkSession, folder: str, levels: Sequence[str] = cfg.LEVELS,
              settings: cfg.ModelSettings = cfg.ModelSettings()) -> DataFrame:
    return fit_staged(series_of(spark, folder, levels), EVENTS, settings=settings)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded columns; adding zero turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})

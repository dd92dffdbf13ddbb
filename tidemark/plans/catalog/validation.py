"""Backtest and walk-forward validation."""

from __future__ import annotations

from collections.abc import Sequence

from tidemark.operators import validation as V
from tidemark.plans import sqlblocks as Q
from tidemark.plans.catalog.forecasts import LEAST
from tidemark.plans.catalog.registry import CUTOFFS, EVENTS, TOP_LEVELS, query, rounded, series_of

FOLD = "cutoff, level, entity"


def folds_sql(levels: Sequence[str], cutoffs: Sequence[str], horizons: Sequence[int],
              test_end: str | None = None, joint: bool = False) -> str:
    cuts = ", ".join(f"(DATE '{c}')" for c in cutoffs)
    spans = ", ".join(f"({h})" for h in horizons)
    end = f"DATE '{test_end}'" if test_end else "cutoff + CAST(window_days AS INTEGER)"
    return ",\n".join([
        Q.series(levels), f"cutoffs(cutoff) AS (VALUES {cuts}), tests(window_days) AS (VALUES {spans})",
        "train AS (SELECT cutoff, series.* FROM series JOIN cutoffs ON ds < cutoff)",
        f"""actuals AS (
  SELECT cutoff, level, entity, window_days, CAST(sum(revenue) AS DOUBLE) AS actual
  FROM series JOIN cutoffs ON ds >= cutoff JOIN tests ON ds < {end} GROUP BY ALL)""",
        Q.slices(FOLD, "train"), Q.rolling(FOLD, "train", horizons), Q.guards(FOLD, horizons),
        *([Q.least_squares(FOLD, "train"), Q.least_future(FOLD, max(horizons))] if joint else
          [Q.fit(EVENTS, FOLD, "train"), Q.future(FOLD, max(horizons))]),
        Q.windows(FOLD, floor=False, horizons=horizons),
        f"""folds AS (
  SELECT {FOLD}, window_days, actual, revenue_point AS predicted, revenue_lower, revenue_upper,
         abs(revenue_point - actual) / nullif(actual, 0) * 100 AS ape_pct,
         actual BETWEEN revenue_lower AND revenue_upper AS covered
  FROM forecasts JOIN actuals USING ({FOLD}, window_days))"""])


SHOWN = f"""SELECT {FOLD}, window_days, actual, round(predicted, 2) AS predicted,
       round(revenue_lower, 2) AS revenue_lower, round(revenue_upper, 2) AS revenue_upper,
       round(ape_pct, 6) AS ape_pct, covered FROM folds"""


def _shown(folds):
    return rounded(rounded(folds, 2, "predicted", "revenue_lower", "revenue_upper"), 6, "ape_pct")


CUTOFF, TEST_END = "2001-01-01", "2001-04-03"


@query("backtest_cutoff", sql=Q.query(
    folds_sql(("aggregate",), (CUTOFF,), (90,), TEST_END), select=SHOWN))
def backtest_cutoff(spark, folder):
    """90 forecast days against the actuals up to a given end of the test period."""
    return _shown(V.backtest(series_of(spark, folder, ("aggregate",)), EVENTS, CUTOFF, 90, test_end=TEST_END))


@query("walk_forward", sql=Q.query(folds_sql(TOP_LEVELS, CUTOFFS, (30, 60, 90)), select=SHOWN))
def walk_forward(spark, folder):
    return _shown(V.walk_forward(series_of(spark, folder, TOP_LEVELS), EVENTS, CUTOFFS))


@query("walk_forward_joint", sql=Q.query(folds_sql(TOP_LEVELS, CUTOFFS, (30, 60, 90), joint=True), select=SHOWN))
def walk_forward_joint(spark, folder):
    """The folds by the joint model's smallest design."""
    return _shown(V.walk_forward(series_of(spark, folder, TOP_LEVELS), (), CUTOFFS, model=LEAST))


@query("coverage_summary", sql=Q.query(folds_sql(TOP_LEVELS, CUTOFFS, (30, 60, 90)), select="""
SELECT window_days, count(*) AS n_folds, avg(CAST(covered AS INTEGER)) AS coverage,
       round(avg(ape_pct), 6) AS mean_ape_pct, CAST(0.8 AS DOUBLE) AS target FROM folds GROUP BY window_days"""))
def coverage_summary(spark, folder):
    folds = V.walk_forward(series_of(spark, folder, TOP_LEVELS), EVENTS, CUTOFFS)
    return rounded(V.coverage_summary(folds), 6, "mean_ape_pct")

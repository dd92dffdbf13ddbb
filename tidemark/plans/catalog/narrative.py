"""JSON contexts and prompts, read back to rows. Windows and anomalies are written once and
read back, because several sections use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators import anomalies as A
from tidemark.operators import narrative as N
from tidemark.operators.forecast import PREDICTION_COLUMNS, forecast, prediction_table
from tidemark.plans import sqlblocks as Q
from tidemark.plans.catalog.forecasts import PREDICTIONS_SQL
from tidemark.plans.catalog.registry import (
    BUDGET_VALUES, BUDGETS, EVENTS, LOOKBACK, TOP_LEVELS, models_of, query, rounded, series_of)
from tidemark.session import shared_folder
from tidemark.sources import feature_store, model_store


def _written(spark, rows, purpose):
    path = shared_folder(spark, purpose)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def _windows(spark, folder):
    models = models_of(spark, folder, TOP_LEVELS)
    return _written(spark, N.scenario_windows(models, EVENTS, BUDGETS), "windows")


def _anomalies(spark, folder):
    return _written(spark, A.detect(series_of(spark, folder, TOP_LEVELS), LOOKBACK), "anomalies")


def _rows(contexts, kind):
    """The values of a document as rows; magnitudes as far as both engines agree."""
    return rounded(N.document_rows(contexts, kind), 6, "number")


# -- the same values as plain rows -------------------------------------------------

def _values(source: str, *values: tuple[str, str, str], where: str = "TRUE") -> str:
    """(path, item, number, text) rows; values are (path, item expression, number or 'text' expression)."""
    rows = []
    for path, item, value in values:
        number, text = ("NULL", value[5:]) if value.startswith("text:") else (value, "NULL")
        rows.append(f"SELECT '{path}' AS path, {item} AS item, CAST({number} AS DOUBLE) AS number, CAST({text} AS VARCHAR) AS text "
                    f"FROM {source} WHERE {where}")
    return "\nUNION ALL ".join(rows)


def _trailing(prefix: str = "") -> str:
    at = f"{prefix}trailing_30d"
    return _values("recent_days", (f"{at}.revenue", "NULL", "round_even(trailing_revenue, 0)"), (f"{at}.spend", "NULL", "round_even(trailing_spend, 0)"),
                   (f"{at}.roas", "NULL", "round_even(trailing_revenue / trailing_spend, 2)"),
                   (f"{at}.period", "NULL", "text:trailing_start || ' to ' || trailing_end"), where="level = 'aggregate'")


def _forecast(prefix: str = "") -> str:
    at, slot = f"{prefix}forecast_windows", "CAST(window_days / 30 - 1 AS INTEGER)"
    whole = [(f"{at}.{c}", slot, f"round_even({c}, 0)") for c in ("revenue_point", "revenue_lower", "revenue_upper", "spend_point")]
    ratio = [(f"{at}.{c}", slot, f"round_even({c}, 2)") for c in ("roas_point", "roas_lower", "roas_upper")]
    account = _values("forecasts", (f"{at}.days", slot, "window_days"), *whole, *ratio, (f"{at}.interval_width_pct", slot, "80"),
                      where="level = 'aggregate'")
    channels = _values("forecasts", (f"{prefix}channel_30d.revenue", "entity", "round_even(revenue_point, 0)"),
                       (f"{prefix}channel_30d.roas", "entity", "round_even(roas_point, 2)"), where="level = 'channel' AND window_days = 30")
    return f"{_trailing(prefix)}\nUNION ALL {account}\nUNION ALL {channels}"


def _found(path: str, k: int, where: str = "TRUE") -> str:
    first = (f"(SELECT *, row_number() OVER (ORDER BY ds DESC, magnitude DESC, type, scope) - 1 AS place FROM (SELECT DISTINCT * FROM anomalies) "
             f"WHERE {where} QUALIFY place < {k}) AS t")
    texts = [(f"{path}.{name}", "place", f"text:{e}") for name, e in (
        ("date", "ds"), ("type", "type"), ("channel", "scope"), ("description", "description"), ("severity", "severity"))]
    return _values(first, *texts, (f"{path}.magnitude", "place", "round(magnitude, 6)"))


_GIVEN = f"(VALUES {BUDGET_VALUES}) AS given(entity, budget)"
_BUDGET = "\nUNION ALL ".join([
    _values(_GIVEN, ("daily_budgets_usd", "entity", "budget")),
    f"SELECT 'total_daily_budget', NULL, CAST({sum(BUDGETS.values())} AS DOUBLE), NULL",
    _values("forecasts", ("baseline_30d.revenue", "NULL", "round_even(revenue_point, 0)"), ("baseline_30d.roas", "NULL", "round_even(roas_point, 2)"),
            where="level = 'aggregate' AND window_days = 30"),
    _values("(SELECT window_days, sum(revenue_point) AS revenue_point, sum(revenue_lower) AS revenue_lower, sum(revenue_upper) AS revenue_upper, "
            "sum(spend_point) AS spend_point FROM planned GROUP BY window_days) AS s",
            *((f"portfolio_forecast.{c}", "window_days", f"round_even({c}, 0)") for c in ("revenue_point", "revenue_lower", "revenue_upper")),
            ("portfolio_forecast.roas_point", "window_days", "round_even(revenue_point / greatest(spend_point, 1), 2)")),
    _values("planned", ("channel_30d.revenue", "entity", "round_even(revenue_point, 0)"),
            ("channel_30d.budget_30d", "entity", "round_even(coalesce(budget, 0) * 30, 0)"), where="window_days = 30"),
])
_RISK = "\nUNION ALL ".join([
    _forecast("forecast_summary."), _found("high_severity_anomalies", 4, "severity = 'high'"),
    _values("forecasts", ("channel_concentration", "entity", "round_even(revenue_point, 0)"), where="level = 'channel' AND window_days = 30"),
    _values(_GIVEN, ("budget_by_channel", "entity", "budget"))])
_ANOMALIES = f"{_trailing()}\nUNION ALL {_found('anomalies', 6)}"
_BASE = Q.forecasts(EVENTS, TOP_LEVELS)
_SCORED = f"{Q.scored()},\n{Q.anomalies()}"
# the channels' windows with budgets, beside those without
_PLANNED = (f"planned AS (WITH {Q.forecasts(EVENTS, ('channel',), budget_values=BUDGET_VALUES)} "
            "SELECT f.*, b.budget FROM forecasts f LEFT JOIN budgets b USING (entity))")
_DOCUMENTS = {"forecast": _forecast(), "budget": _BUDGET, "anomalies": _ANOMALIES, "risk": _RISK}


def _sql(select: str, *more: str) -> str:
    return Q.query(_BASE, *more, select=f"SELECT path, CAST(item AS VARCHAR) AS item, round(number, 6) AS number, text FROM (\n{select}) AS v")


@query("context_forecast", sql=_sql(_forecast()))
def context_forecast(spark, folder):
    windows = N.scenario_windows(models_of(spark, folder, TOP_LEVELS), EVENTS, {})
    return _rows(N.context_forecast(windows), "forecast")


@query("context_budget", sql=_sql(_BUDGET, _PLANNED))
def context_budget(spark, folder):
    windows = N.scenario_windows(models_of(spark, folder, TOP_LEVELS), EVENTS, BUDGETS)
    return _rows(N.context_budget(windows, BUDGETS), "budget")


@query("context_anomalies", sql=_sql(_ANOMALIES, _SCORED))
def context_anomalies(spark, folder):
    return _rows(N.context_anomalies(_windows(spark, folder), _anomalies(spark, folder)), "anomalies")


@query("context_risk", sql=_sql(_RISK, _SCORED))
def context_risk(spark, folder):
    return _rows(N.context_risk(_windows(spark, folder), _anomalies(spark, folder), BUDGETS), "risk")


def _prompt(kind: str) -> str:
    return f"SELECT '{kind}' AS prompt_kind, * FROM (\n{_DOCUMENTS[kind]}) AS {kind}_rows"


@query("prompt_table", sql=Q.query(_BASE, _PLANNED, _SCORED, select=f"""
SELECT 'all' AS account, prompt_kind, TRUE AS needs_call, TRUE AS complete, path, CAST(item AS VARCHAR) AS item,
       round(number, 6) AS number, text FROM (
{' UNION ALL '.join(_prompt(k) for k in _DOCUMENTS)}) AS v"""))
def prompt_table(spark, folder):
    """All prompts; their documents as rows, and whether the text of the task holds its document."""
    table = N.prompt_table(_windows(spark, folder), _anomalies(spark, folder), BUDGETS)
    table = _written(spark, table, "prompts")
    out = None
    for kind in N.SCHEMAS:
        one = table.where(F.col("prompt_kind") == kind)
        about = one.select("account", "prompt_kind", "needs_call",
                           (F.contains("user_text", "context") & (F.length("system_text") > 20)).alias("complete"))
        rows = about.join(_rows(one, kind).withColumn("prompt_kind", F.lit(kind)), "prompt_kind")
        out = rows if out is None else out.unionByName(rows)
    return out.select("account", "prompt_kind", "needs_call", "complete", "path", "item", "number", "text")


@query("prompt_preview", sql=Q.query(_BASE, _SCORED, select="""
SELECT (SELECT count(*) FROM (SELECT DISTINCT ds, type, scope FROM anomalies)) AS anomaly_count, place, type, scope AS channel,
       severity, CAST(ds AS VARCHAR) AS date, (SELECT round_even(revenue_point, 0) FROM forecasts
         WHERE level = 'aggregate' AND window_days = 30) AS revenue_30d
FROM (SELECT *, row_number() OVER (ORDER BY ds DESC, magnitude DESC, type, scope) - 1 AS place FROM (SELECT DISTINCT * FROM anomalies)
      QUALIFY place < 4) AS t"""))
def prompt_preview(spark, folder):
    shown = N.preview(_windows(spark, folder), _anomalies(spark, folder))
    first = F.from_json("forecast_explanation_prompt", N.SCHEMAS["forecast"])["forecast_windows"][0]["revenue_point"]
    return shown.select("anomaly_count", first.cast("double").alias("revenue_30d"), F.posexplode("top_anomalies").alias("place", "a")).select(
        "anomaly_count", "place", "a.type", "a.channel", "a.severity", "a.date", "revenue_30d")


_TEXTS = ", ".join(f"regexp_replace(CAST(CAST({c} AS DECIMAL(38,4)) AS VARCHAR), '\\.?0+$', '') AS {c}" for c in PREDICTION_COLUMNS[3:])
_TOP_ANOMALIES = f"found AS (WITH {Q.series(TOP_LEVELS)},\n{_SCORED} SELECT DISTINCT * FROM anomalies)"


@query("predictions_compat", sql=Q.query(Q.forecasts(EVENTS), _TOP_ANOMALIES, f"scored_rows AS ({PREDICTIONS_SQL})", select=f"""
SELECT CAST(window_days AS VARCHAR) AS window_days, level, entity, {_TEXTS} FROM scored_rows
UNION ALL
SELECT '0', 'anomaly', scope || '/' || type, CAST(ds AS VARCHAR), severity, CAST(round_even(magnitude, 3) AS VARCHAR), '0', '0', '0', '0'
FROM (SELECT *, row_number() OVER (ORDER BY ds DESC, magnitude DESC, type, scope) AS place FROM found QUALIFY place <= 20) AS t"""))
def predictions_compat(spark, folder):
    path = shared_folder(spark, "models")
    model_store.save_models(models_of(spark, folder, cfg.LEVELS), path, EVENTS)
    models = model_store.load_models(spark, path)
    table = prediction_table(models, forecast(models, EVENTS))
    return feature_store.predictions_compat(table, A.top(_anomalies(spark, folder), 20))

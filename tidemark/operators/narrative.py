"""Compact JSON contexts and prompt texts for an external text service.

All contexts come from two small tables: the windows of the account and the channels in two
scenarios (baseline, budgets), forecast in one pass, and the anomalies. Each document has a
declared schema, so its text can be read back to rows. No service is called; ``prompt_table``
is the input of a batch job and says which prompts need a call.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.operators import anomalies as A
from tidemark.operators import budget as B
from tidemark.operators.models import STAGED, Model
from tidemark.operators.promo import Event, small_table

PRETTY = {"pretty": "true"}
BASELINE, BUDGETED = "baseline", "budget"

# Keys of the documents and the types of their values.
_TRAILING = f"trailing_{cfg.TRAILING_DAYS}d struct<revenue: bigint, spend: bigint, roas: double, period: string>"
_WINDOW = "revenue_point: bigint, revenue_lower: bigint, revenue_upper: bigint, "
_FORECAST = (f"{_TRAILING}, forecast_windows array<struct<days: int, {_WINDOW}spend_point: bigint, roas_point: double, "
             "roas_lower: double, roas_upper: double, interval_width_pct: int>>, "
             "channel_30d map<string, struct<revenue: bigint, roas: double>>")
_ANOMALIES = "array<struct<date: string, type: string, channel: string, description: string, magnitude: double, severity: string>>"
SCHEMAS = {
    "forecast": _FORECAST,
    "budget": ("daily_budgets_usd map<string, double>, total_daily_budget double, baseline_30d struct<revenue: bigint, roas: double>, "
               f"portfolio_forecast map<string, struct<{_WINDOW}roas_point: double>>, "
               "channel_30d map<string, struct<revenue: bigint, budget_30d: bigint>>"),
    "anomalies": f"{_TRAILING}, anomalies {_ANOMALIES}",
    "risk": (f"forecast_summary struct<{_FORECAST.replace(' struct<', ': struct<', 1).replace(' array<', ': array<', 1).replace(' map<', ': map<', 1)}>, "
             f"high_severity_anomalies {_ANOMALIES}, channel_concentration map<string, bigint>, budget_by_channel map<string, double>"),
}


def document_rows(contexts: DataFrame, kind: str) -> DataFrame:
    """(path, item, number, text): every value of a document, read back by its declared schema.

    ``item`` is the key or position within the list or map that the value stands in.
    """
    schema = T._parse_datatype_string(SCHEMAS[kind])

    def leaves(path: str, item: Column, value: Column, of: T.DataType) -> Column:
        if isinstance(of, T.StructType):
            return F.concat(*(leaves(f"{path}.{f.name}".lstrip("."), item, value[f.name], f.dataType) for f in of.fields))
        if isinstance(of, T.ArrayType):
            return F.flatten(F.transform(value, lambda v, i: leaves(path, i.cast("string"), v, of.elementType)))
        if isinstance(of, T.MapType):
            return F.flatten(F.transform(F.map_entries(value), lambda e: leaves(path, e["key"], e["value"], of.valueType)))
        text = isinstance(of, T.StringType)
        return F.array(F.struct(
            F.lit(path).alias("path"), item.alias("item"),
            (F.lit(None) if text else value).cast("double").alias("number"), (value if text else F.lit(None).cast("string")).alias("text")))

    read = contexts.select(F.from_json("context", schema).alias("d"))
    return read.select(F.inline(F.array_compact(leaves("", F.lit(None).cast("string"), F.col("d"), schema)))).where(
        "number is not null or text is not null")


def scenario_windows(models: DataFrame, events: Sequence[Event], budgets: Mapping[str, float],
                     settings: cfg.ModelSettings = cfg.ModelSettings(), interval: str = "analytic",
                     model: Model = STAGED) -> DataFrame:
    """Windows of the account and the channels without budgets, and of the channels with them, from one pass.

    Small: a row for each window of each channel and scenario.
    """
    table = small_table(models.sparkSession, [(k, float(v)) for k, v in budgets.items()], "entity string, given double")
    both = models.where(F.col("level").isin("aggregate", "channel")).join(table, "entity", "left")
    plain = F.struct(F.lit(BASELINE).alias("scenario"), F.lit(None).cast("double").alias("budget"))
    planned = F.struct(F.lit(BUDGETED).alias("scenario"), F.col("given").alias("budget"))
    cases = F.when(F.col("level") == "channel", F.array(plain, planned)).otherwise(F.array(plain))
    return B.simulated(both.select("*", F.inline(cases)).drop("given"), events, settings, interval, (*cfg.SLICE, "scenario"), model)


def _baseline(windows: DataFrame) -> DataFrame:
    return windows.where((F.col("scenario") == BASELINE) & F.col("by_model")) if "scenario" in windows.columns else windows


def _whole(c: str | Column) -> Column:
    return F.bround(F.col(c) if isinstance(c, str) else c, 0).cast("long")


def _ratio(c: str) -> Column:
    return F.bround(F.col(c), 2)


def _kept(condition: Column, value: Column) -> Column:
    """The values of matching rows, in the order of their struct fields."""
    return F.array_sort(F.collect_list(F.when(condition, value)))


def _by_key(condition: Column, key: Column, value: Column) -> Column:
    return F.map_from_entries(_kept(condition, F.struct(key.alias("key"), value.alias("value"))))


def _trailing() -> Column:
    """The account's trailing actuals, an aggregate over its windows."""
    start = F.date_sub("last_ds", cfg.TRAILING_DAYS - 1)
    return F.max(F.when((F.col("level") == "aggregate") & (F.col("slot") == 0), F.struct(
        _whole("trailing_revenue").alias("revenue"), _whole("trailing_spend").alias("spend"),
        F.bround(S.roas_zero("trailing_revenue", "trailing_spend"), 2).alias("roas"),
        F.format_string("%s to %s", start.cast("string"), F.col("last_ds").cast("string")).alias("period"))))


def forecast_document(settings: cfg.ModelSettings) -> list[Column]:
    """Aggregates over window forecasts: trailing actuals, account windows, channel windows."""
    window = F.struct(
        F.col("window_days").alias("days"),
        *(_whole(f"revenue_{b}").alias(f"revenue_{b}") for b in ("point", "lower", "upper")),
        _whole("spend_point").alias("spend_point"),
        *(_ratio(f"roas_{b}").alias(f"roas_{b}") for b in ("point", "lower", "upper")),
        F.lit(round(settings.interval_width * 100)).alias("interval_width_pct"))
    channel = _by_key(
        (F.col("level") == "channel") & (F.col("slot") == 0), F.col("entity"),
        F.struct(_whole("revenue_point").alias("revenue"), _ratio("roas_point").alias("roas")))
    return [_trailing().alias(f"trailing_{cfg.TRAILING_DAYS}d"),
            _kept(F.col("level") == "aggregate", window).alias("forecast_windows"), channel.alias("channel_30d")]


def context_forecast(windows: DataFrame, settings: cfg.ModelSettings = cfg.ModelSettings()) -> DataFrame:
    """One row, one JSON document: trailing actuals, forecast windows, channels."""
    return _baseline(windows).agg(*forecast_document(settings)).select(F.to_json(F.struct("*"), PRETTY).alias("context"))


def _given(budgets: Mapping[str, float]) -> Column:
    return F.create_map(*(F.lit(v) for pair in budgets.items() for v in (pair[0], float(pair[1]))))


def context_budget(windows: DataFrame, budgets: Mapping[str, float]) -> DataFrame:
    """One JSON document: budgets, baseline of the account, simulated portfolio and simulated channels.

    ``windows`` are those of both scenarios. Only channels with a forecast are listed one by one.
    """
    planned = F.col("scenario") == BUDGETED
    first = F.col("slot") == 0
    sums = windows.groupBy("window_days").agg(
        *(F.sum(F.when(planned, F.col(c))).alias(c) for c in ("revenue_point", "revenue_lower", "revenue_upper", "spend_point")),
        F.max(F.when(~planned & first & (F.col("level") == "aggregate"), F.struct(
            _whole("revenue_point").alias("revenue"), _ratio("roas_point").alias("roas")))).alias("baseline"),
        _by_key(planned & first & F.col("by_model"), F.col("entity"), F.struct(
            _whole("revenue_point").alias("revenue"),
            _whole(F.coalesce("budget", F.lit(0.0)) * 30).alias("budget_30d"))).alias("channels"))
    window = F.struct(
        *(_whole(f"revenue_{b}").alias(f"revenue_{b}") for b in ("point", "lower", "upper")),
        F.bround(S.roas_floor1("revenue_point", "spend_point"), 2).alias("roas_point"))
    return sums.agg(
        _by_key(F.col("revenue_point").isNotNull(), F.col("window_days").cast("string"), window).alias("portfolio_forecast"),
        F.max("baseline").alias("baseline_30d"),
        F.max(F.when(F.size("channels") > 0, F.map_entries("channels"))).alias("channels"),
    ).select(F.to_json(F.struct(
        _given(budgets).alias("daily_budgets_usd"),
        F.lit(float(sum(budgets.values()))).alias("total_daily_budget"), "baseline_30d",
        "portfolio_forecast",
        F.map_from_entries("channels").alias("channel_30d")), PRETTY).alias("context"))


def _anomaly_list(anomalies: DataFrame, k: int) -> DataFrame:
    """One row with the first ``k`` anomalies, in report order, as an array of structs."""
    first = A.top(anomalies, k)
    order = F.struct((-F.unix_date("ds")).alias("a"), (-F.col("magnitude")).alias("b"),
                     F.col("type").alias("c"), F.col("scope").alias("d"))
    item = F.struct(F.col("ds").cast("string").alias("date"), "type",
                    F.col("scope").alias("channel"), "description", "magnitude", "severity")
    listed = F.array_sort(F.collect_list(F.struct(order.alias("order"), item.alias("item"))))
    return first.agg(F.transform(listed, lambda e: e["item"]).alias("anomalies"))


def _paired(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two single rows side by side, by an equality on a constant."""
    return one.withColumn("one", F.lit(1)).join(other.withColumn("one", F.lit(1)), "one").drop("one")


def context_anomalies(windows: DataFrame, anomalies: DataFrame, k: int = 6) -> DataFrame:
    """One JSON document: trailing actuals and the first ``k`` anomalies; ``none`` tells that there are no anomalies."""
    trailing = _baseline(windows).agg(_trailing().alias("trailing"))
    return _paired(trailing, _anomaly_list(anomalies, k)).select(
        F.to_json(F.struct(F.col("trailing").alias(f"trailing_{cfg.TRAILING_DAYS}d"), "anomalies"), PRETTY).alias("context"),
        (F.size("anomalies") == 0).alias("none"))


def context_risk(windows: DataFrame, anomalies: DataFrame, budgets: Mapping[str, float],
                 settings: cfg.ModelSettings = cfg.ModelSettings(), k: int = 4) -> DataFrame:
    """One JSON document: forecast summary, high-severity anomalies, concentration, budgets."""
    summary = _baseline(windows).agg(*forecast_document(settings)).select(
        F.struct("*").alias("forecast_summary"),
        F.transform_values("channel_30d", lambda _, v: v["revenue"]).alias("channel_concentration"))
    high = _anomaly_list(anomalies.where(F.col("severity") == "high"), k)
    return _paired(summary, high).select(F.to_json(F.struct(
        "forecast_summary", F.col("anomalies").alias("high_severity_anomalies"),
        "channel_concentration", _given(budgets).alias("budget_by_channel")), PRETTY).alias("context"))


ROLE = {
    "forecast": "You advise a marketing manager. Turn forecast figures into plain advice; "
                "interpret them instead of listing them.",
    "budget": "You advise on paid-media budgets. Explain simulated budgets in plain words and "
              "say openly where extra spend earns less.",
    "anomalies": "You investigate unusual days in advertising data and say what most likely "
                 "caused them and whether to act.",
    "risk": "You review advertising forecasts for operational risk and propose concrete countermeasures.",
}
TASK = {
    "forecast": "Account forecast with its ranges:\n%s\n\nIn at most 150 words: is revenue heading up, "
                "down or sideways against the trailing period; how sure is the range; which channel "
                "carries the result and is that a concern; what is the one thing to remember?",
    "budget": "Planned media budget and simulated outcome:\n%s\n\nIn at most 120 words: how does the plan "
              "compare with today's spend, what change in revenue does the range suggest, and does the "
              "return per unit of spend improve or worsen?",
    "anomalies": "Unusual days found in the data:\n%s\n\nIn at most 180 words, as bullets: the most likely "
                 "cause of each and whether it needs investigation.",
    "risk": "Forecast, anomalies and budgets of the account:\n%s\n\nIn at most 200 words, name exactly four "
            "risks, each with a short title, one sentence on the risk and one on its mitigation.",
}


def prompt_table(windows: DataFrame, anomalies: DataFrame, budgets: Mapping[str, float],
                 settings: cfg.ModelSettings = cfg.ModelSettings()) -> DataFrame:
    """(account, prompt_kind, needs_call, system_text, user_text, context): one row per prompt kind.

    ``windows`` and ``anomalies`` are read several times; both are small and worth writing first.
    Without anomalies that prompt is the sentence for none and needs no call.
    """
    contexts = {
        "forecast": context_forecast(windows, settings),
        "budget": context_budget(windows, budgets),
        "anomalies": context_anomalies(windows, anomalies),
        "risk": context_risk(windows, anomalies, budgets, settings),
    }
    table = None
    for kind, context in contexts.items():
        none = F.col("none") if "none" in context.columns else F.lit(False)
        rows = context.select(
            F.lit("all").alias("account"), F.lit(kind).alias("prompt_kind"), (~none).alias("needs_call"),
            F.lit(ROLE[kind]).alias("system_text"),
            F.when(none, F.lit(cfg.TEXT_NO_RECENT_ANOMALY)).otherwise(F.format_string(TASK[kind], "context")).alias("user_text"), "context")
        table = rows if table is None else table.unionByName(rows)
    return table


def preview(windows: DataFrame, anomalies: DataFrame, service: str = "none", k: int = 4,
            settings: cfg.ModelSettings = cfg.ModelSettings()) -> DataFrame:
    """One row that shows what would be sent, without a call: the forecast context, the number of anomalies,
    the first ``k`` of them, and the service that would be asked."""
    counted = anomalies.agg(F.count(F.lit(1)).alias("anomaly_count"))
    shown = _paired(_paired(context_forecast(windows, settings), counted), _anomaly_list(anomalies, k))
    return shown.select(
        F.col("context").alias("forecast_explanation_prompt"), "anomaly_count", F.col("anomalies").alias("top_anomalies"),
        F.lit(service).alias("service"), F.lit("Preview only: nothing has been sent.").alias("note"))

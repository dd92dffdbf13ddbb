"""Anomaly rules, reports and counts over the full history."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators import anomalies as A
from tidemark.plans import sqlblocks as Q
from tidemark.plans.catalog.registry import LOOKBACK, TOP_LEVELS, query, rounded, series_of

FIELDS = "ds, type, scope, round(magnitude, 6) AS magnitude, magnitude_unit, severity"


def _sql(levels=TOP_LEVELS, everywhere=False, select=f"SELECT {FIELDS} FROM anomalies"):
    return Q.query(Q.series(levels), Q.scored(lookback=LOOKBACK), Q.anomalies(everywhere), select=select)


def _found(spark, folder, levels=TOP_LEVELS, everywhere=False):
    return A.detect(series_of(spark, folder, levels), LOOKBACK, everywhere=everywhere)


def _shown(found):
    return rounded(found.select("ds", "type", "scope", "magnitude", "magnitude_unit", "severity"), 6, "magnitude")


@query("anomaly_revenue", sql=_sql(("aggregate",), select=f"SELECT {FIELDS} FROM anomalies WHERE type LIKE 'revenue%'"))
def anomaly_revenue(spark, folder):
    return _shown(_found(spark, folder, ("aggregate",)).where(F.col("type").startswith("revenue_")))


@query("anomaly_roas_collapse", sql=_sql(cfg.LEVELS, True, f"SELECT {FIELDS} FROM anomalies WHERE type = 'roas_collapse'"))
def anomaly_roas_collapse(spark, folder):
    return _shown(_found(spark, folder, cfg.LEVELS, True).where("type = 'roas_collapse'"))


@query("anomaly_decoupling", sql=_sql(cfg.LEVELS, True, f"SELECT {FIELDS} FROM anomalies WHERE type LIKE 'spend%'"))
def anomaly_decoupling(spark, folder):
    return _shown(_found(spark, folder, cfg.LEVELS, True).where("type = 'spend_revenue_decoupling'"))


@query("anomaly_channel_revenue", sql=_sql(("channel",)))
def anomaly_channel_revenue(spark, folder):
    return _shown(_found(spark, folder, ("channel",)))


@query("detect_anomalies", sql=_sql(select="SELECT ds, type, scope, round(magnitude, 6) AS magnitude, "
                                           "magnitude_unit, severity, description FROM anomalies"))
def detect_anomalies(spark, folder):
    return rounded(_found(spark, folder), 6, "magnitude")


@query("anomaly_dedup", sql=_sql(cfg.LEVELS, True, """
SELECT ds, type, scope, round(max(magnitude), 6) AS magnitude FROM anomalies GROUP BY ds, type, scope"""))
def anomaly_dedup(spark, folder):
    days = A.scored(series_of(spark, folder), LOOKBACK)
    twice = A.candidates(days, everywhere=True)
    kept = A.deduplicated(twice.unionByName(twice.withColumn("magnitude", F.col("magnitude") / 2)))
    return rounded(kept.select("ds", "type", "scope", "magnitude"), 6, "magnitude")


@query("anomaly_order", sql=_sql(select=f"""
SELECT {FIELDS} FROM anomalies ORDER BY ds DESC, magnitude DESC, type, scope"""))
def anomaly_order(spark, folder):
    return _shown(A.ordered(_found(spark, folder)))


@query("anomaly_topk", sql=_sql(select=f"""
SELECT {FIELDS} FROM anomalies
QUALIFY row_number() OVER (PARTITION BY scope ORDER BY ds DESC, magnitude DESC, type) <= 6"""))
def anomaly_topk(spark, folder):
    return _shown(A.top_per_scope(_found(spark, folder), 6))


@query("anomaly_file_rows", sql=_sql(select=f"""
SELECT {FIELDS} FROM anomalies ORDER BY ds DESC, magnitude DESC, type, scope LIMIT 20"""))
def anomaly_file_rows(spark, folder):
    return _shown(A.top(_found(spark, folder), 20))


@query("severity_counts", sql=_sql(cfg.LEVELS, True, """
SELECT severity, count(*) AS n FROM anomalies GROUP BY severity
UNION ALL SELECT 'total', count(*) FROM anomalies"""))
def severity_counts(spark, folder):
    return A.severity_counts(_found(spark, folder, cfg.LEVELS, True))


@query("anomaly_summary", sql=_sql(select="""
SELECT string_agg('- [' || CAST(ds AS VARCHAR) || '] ' || upper(severity) || ' | ' || scope || ' | ' || description,
                  chr(10) ORDER BY ds DESC, magnitude DESC, type, scope) AS summary
FROM (SELECT * FROM anomalies ORDER BY ds DESC, magnitude DESC, type, scope LIMIT 8)"""))
def anomaly_summary(spark, folder):
    return A.digest(_found(spark, folder))

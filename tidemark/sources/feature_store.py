"""Daily series and prediction files on shared storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators.forecast import PREDICTION_COLUMNS


def save_features(series: DataFrame, path: str) -> None:
    """One parquet table, partitioned by level; entity names are data, not file names."""
    series.write.mode("errorifexists").partitionBy("level").parquet(path)


def load_features(spark: SparkSession, path: str,
                  levels: Sequence[str] = cfg.LEVELS) -> DataFrame:
    """Series of the given levels; other levels' folders are not read."""
    table = spark.read.parquet(path)
    if set(levels) != set(cfg.LEVELS):
        table = table.where(F.col("level").isin(*levels))
    return table


def plain_text(column: str, kind: str) -> Column:
    """A number as plain decimal text, never in scientific notation."""
    if kind == "double":
        return F.regexp_replace(F.col(column).cast("decimal(38,4)").cast("string"), r"\.?0+$", "").alias(column)
    return F.col(column).cast("string").alias(column)


def save_predictions(predictions: DataFrame, path: str) -> None:
    """The ten prediction columns as CSV with a header."""
    predictions.select(*PREDICTION_COLUMNS).write.option("header", True).csv(path)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    schema = "window_days int, level string, entity string, " + ", ".join(
        f"{c} double" for c in PREDICTION_COLUMNS[3:])
    return spark.read.schema(schema).option("header", True).csv(path)


def predictions_compat(predictions: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Predictions and the given anomalies in one all-text table.

    An anomaly row carries its date, severity and magnitude in the revenue
    columns, which is why every column has to be text.
    """
    rows = predictions.select(*(plain_text(c, t) for c, t in predictions.select(*PREDICTION_COLUMNS).dtypes))
    zero = F.lit("0")
    flagged = anomalies.select(
        zero.alias("window_days"), F.lit("anomaly").alias("level"),
        F.concat_ws("/", "scope", "type").alias("entity"),
        F.col("ds").cast("string").alias("revenue_lower"),
        F.col("severity").alias("revenue_point"),
        F.bround("magnitude", 3).cast("string").alias("revenue_upper"),
        *(zero.alias(c) for c in PREDICTION_COLUMNS[6:]))
    return rows.unionByName(flagged)

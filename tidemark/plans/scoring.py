"""The scoring run: facts to stored features to a prediction file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark import config as cfg
from tidemark.operators import anomalies as A
from tidemark.operators.forecast import forecast, prediction_table
from tidemark.operators.models import STAGED, Model
from tidemark.operators.promo import Event
from tidemark.operators.series import daily_series
from tidemark.operators.summary import campaign_summary
from tidemark.sources import feature_store as store


def predictions(facts: DataFrame, events: Sequence[Event],
                settings: cfg.ModelSettings = cfg.ModelSettings(), interval: str = "analytic",
                model: Model = STAGED) -> DataFrame:
    """Predictions of all four levels and the trailing row, as one lazy plan."""
    models = model.fit(daily_series(facts), events, settings=settings)
    return prediction_table(models, forecast(models, events, settings=settings, interval=interval, predict=model.predict))


def score(spark: SparkSession, facts: DataFrame, folder: str,
          events: Sequence[Event] = cfg.PROMO_EVENTS,
          settings: cfg.ModelSettings = cfg.ModelSettings(),
          lookback_days: int = cfg.LOOKBACK_DAYS, interval: str = "analytic", model: Model = STAGED) -> dict[str, str]:
    """Write features, campaign summary, predictions and anomalies below ``folder``.

    The features are materialised because several later steps read them: the
    facts are scanned once for them, and a lost executor only repeats a read.
    """
    paths = {n: f"{folder}/{n}" for n in ("features", "campaign_summary", "predictions", "anomalies")}
    store.save_features(daily_series(facts, with_roas=True), paths["features"])
    campaign_summary(facts).write.parquet(paths["campaign_summary"])

    models = model.fit(store.load_features(spark, paths["features"]), events, settings=settings)
    table = prediction_table(models, forecast(models, events, settings=settings, interval=interval, predict=model.predict))
    store.save_predictions(table, paths["predictions"])

    watched = store.load_features(spark, paths["features"], ("aggregate", "channel"))
    A.detect(watched, lookback_days).write.parquet(paths["anomalies"])
    return paths

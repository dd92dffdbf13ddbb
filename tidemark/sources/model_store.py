"""Fitted slices on shared storage, and refitting only what changed."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.operators.models import STAGED, Model
from tidemark.operators.promo import Event


def events_key(events: Sequence[Event]) -> str:
    """Identity of an event calendar, whatever its order."""
    return hashlib.sha256(repr(sorted(tuple(e) for e in events)).encode()).hexdigest()


def with_settings(models: DataFrame, events: Sequence[Event], settings: cfg.ModelSettings, model: Model = STAGED) -> DataFrame:
    """Add the kind of model, its hyperparameters, the key of the event calendar and the last training day to every fitted slice."""
    return models.withColumns({
        "fitted_model": F.lit(model.name),
        "fitted_events": F.lit(events_key(events)),
        **{f"setting_{k}": F.lit(v).cast("double") for k, v in asdict(settings).items()},
        "trained_through": F.col("last_ds"),
    })


#: Parts of a level in the store; an update rewrites the parts that have a changed slice.
SHARDS = 16


def _stored(models: DataFrame) -> DataFrame:
    return models.withColumn("shard", F.pmod(F.xxhash64("entity"), F.lit(SHARDS)).cast("int"))


def save_models(models: DataFrame, path: str, events: Sequence[Event],
                settings: cfg.ModelSettings = cfg.ModelSettings(), model: Model = STAGED) -> None:
    _stored(with_settings(models, events, settings, model)).write.mode("errorifexists").partitionBy("level", "shard").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("shard")


def load_settings(stored: DataFrame) -> cfg.ModelSettings:
    """The hyperparameters a table was fitted with (one row is read)."""
    names = [k for k in asdict(cfg.ModelSettings())]
    row = stored.select(*(f"setting_{k}" for k in names)).head()
    if row is None:
        return cfg.ModelSettings()
    values = {k: row[f"setting_{k}"] for k in names}
    for k, default in asdict(cfg.ModelSettings()).items():
        if isinstance(default, int):  # flags too
            values[k] = type(default)(values[k])
    return cfg.ModelSettings(**values)


def fingerprints(series: DataFrame) -> DataFrame:
    """Order-independent content hash of every slice."""
    return series.groupBy(*cfg.SLICE).agg(F.bit_xor(S.day_print("ds", "revenue", "spend")).alias("fingerprint"))


def _same_fit(events: Sequence[Event], settings: cfg.ModelSettings, horizons: Sequence[int], model: Model) -> Column:
    same = (F.col("fitted_model") == model.name) & (F.col("fitted_events") == events_key(events)) & (
        F.col("horizons") == F.array(*(F.lit(int(h)) for h in horizons)))
    for k, v in asdict(settings).items():
        same = same & F.col(f"setting_{k}").eqNullSafe(F.lit(v).cast("double"))
    return same


def _with_stored(series: DataFrame, stored: DataFrame, events: Sequence[Event], settings: cfg.ModelSettings,
                 horizons: Sequence[int], model: Model) -> DataFrame:
    """Each day with ``stored``: its slice's row in the store if that was fitted on the same content in the same way, else NULL.

    The fingerprint is a window value over the clustering that the series has already, so the facts
    are read once; the store has one row per slice.
    """
    fresh = stored.where(_same_fit(events, settings, horizons, model)).select(*cfg.SLICE, "fingerprint", F.struct(*stored.columns).alias("stored"))
    print_ = F.bit_xor(S.day_print("ds", "revenue", "spend")).over(Window.partitionBy(*cfg.SLICE))
    return series.withColumn("fingerprint", print_).join(fresh, [*cfg.SLICE, "fingerprint"], "left").drop("fingerprint")


def stale_slices(series: DataFrame, stored: DataFrame, events: Sequence[Event],
                 settings: cfg.ModelSettings = cfg.ModelSettings(),
                 horizons: Sequence[int] = cfg.HORIZONS, model: Model = STAGED) -> DataFrame:
    """Slices without a stored fit of the same content, event calendar, hyperparameters and horizons."""
    return _with_stored(series, stored, events, settings, horizons, model).where("stored is null").select(*cfg.SLICE).distinct()


def refit_changed(series: DataFrame, stored: DataFrame, events: Sequence[Event],
                  settings: cfg.ModelSettings = cfg.ModelSettings(),
                  horizons: Sequence[int] = cfg.HORIZONS, model: Model = STAGED) -> DataFrame:
    """A complete model table with ``refitted``: stored rows where nothing changed, new fits elsewhere.

    Of a slice that needs no fit a single day goes on, which brings its stored row.
    """
    days = _with_stored(series, stored, events, settings, horizons, model)
    first = F.col("ds") == F.min("ds").over(Window.partitionBy(*cfg.SLICE))
    needed = days.withColumn("first", first).where("stored is null or first").drop("first")
    fitted = with_settings(
        model.fit(needed, events, settings=settings, horizons=horizons, carry=("stored",)),
        events, settings, model)
    known = F.col("stored").isNotNull()
    columns = [c for c in fitted.columns if c != "stored"]
    return fitted.select(*((F.when(known, F.col(f"stored.{c}")).otherwise(F.col(c)) if c in stored.columns else F.col(c)).alias(c)
                           for c in columns), (~known).alias("refitted"))


def update_models(series: DataFrame, path: str, events: Sequence[Event],
                  settings: cfg.ModelSettings = cfg.ModelSettings(),
                  horizons: Sequence[int] = cfg.HORIZONS, model: Model = STAGED) -> None:
    """Brings a store up to date: only the parts that have a refitted slice are written again."""
    table = _stored(refit_changed(series, load_models(series.sparkSession, path), events, settings, horizons, model))
    touched = F.max("refitted").over(Window.partitionBy("level", "shard"))
    (table.withColumn("touched", touched).where("touched").drop("touched", "refitted")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("level", "shard").parquet(path))


def train_models(series: DataFrame, events: Sequence[Event],
                 settings: cfg.ModelSettings = cfg.ModelSettings(), model: Model = STAGED) -> DataFrame:
    """Account and eligible channels, fitted and ready to store."""
    wanted = series.where(F.col("level").isin("aggregate", "channel"))
    return model.fit(wanted, events, settings=settings).where("eligible")

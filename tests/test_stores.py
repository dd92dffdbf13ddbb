"""Stored features, models and the scoring run; plan shapes."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.operators import anomalies as A
from tidemark.operators.series import daily_series
from tidemark.operators.slice_model import fit_staged
from tidemark.plans import scoring
from tidemark.plans.catalog.registry import EVENTS, models_of, series_of
from tidemark.operators.forecast import forecast
from tidemark.session import remove_folder, shared_folder
from tidemark.sources import feature_store, model_store
from tidemark.sources.star_schema import ad_facts

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_round_trip_and_prune(spark, make_series):
    r = random.Random(1)
    series = make_series({"all": [(r.random() * 9, 1) for _ in range(30)], "a b/c": [(1, 1)] * 5})
    path = shared_folder(spark, "features")
    feature_store.save_features(series, path)
    back = feature_store.load_features(spark, path)
    assert {tuple(x) for x in back.select(series.columns).collect()} == {tuple(x) for x in series.collect()}
    channel = feature_store.load_features(spark, path, ("channel",))
    assert channel.count() == 5 and "PartitionFilters: [isnotnull(level" in plan(channel)


def test_only_changed_slices_are_refitted(spark, make_series):
    r = random.Random(2)
    days = {k: [(50 + r.random(), 5 + r.random()) for _ in range(120)] for k in ("all", "a", "b")}
    path = shared_folder(spark, "models")
    first = make_series(days)
    model_store.save_models(fit_staged(first, EVENTS), path, EVENTS)
    stored = model_store.load_models(spark, path)
    assert model_store.stale_slices(first, stored, EVENTS).count() == 0
    assert model_store.load_settings(stored) == cfg.ModelSettings()

    days["a"] = days["a"][:-1] + [(999.0, 5.0)]
    changed = make_series(days)
    assert [x.entity for x in model_store.stale_slices(changed, stored, EVENTS).collect()] == ["a"]
    table = {x.entity: x for x in model_store.refit_changed(changed, stored, EVENTS).collect()}
    direct = {x.entity: x for x in fit_staged(changed, EVENTS).collect()}
    assert set(table) == {"all", "a", "b"}
    assert all(table[k].total_revenue == direct[k].total_revenue and table[k].beta == pytest.approx(direct[k].beta)
               for k in table)
    other = cfg.ModelSettings(interval_width=0.9)
    assert model_store.stale_slices(changed, stored, EVENTS, other).count() == 3
    assert model_store.stale_slices(first, stored, list(reversed(EVENTS))).count() == 0
    assert model_store.stale_slices(first, stored, EVENTS[1:]).count() == 3
    assert model_store.stale_slices(first, stored, EVENTS, horizons=(30, 120)).count() == 3


def test_update_writes_only_the_changed_parts(spark, make_series):
    import os
    r = random.Random(5)
    days = {k: [(50 + r.random(), 5 + r.random()) for _ in range(120)] for k in ("all", *"abcdefgh")}
    path = shared_folder(spark, "models")
    model_store.save_models(fit_staged(make_series(days), EVENTS), path, EVENTS)

    def files():
        return {os.path.join(d, f) for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet")}

    before = files()
    days["c"] = days["c"][1:] + [(9.0, 9.0)]
    days["new"] = days["a"]
    model_store.update_models(make_series(days), path, EVENTS)
    assert before & files() and len(before - files()) <= 2
    stored = {x.entity: x for x in model_store.load_models(spark, path).collect()}
    direct = {x.entity: x for x in fit_staged(make_series(days), EVENTS).collect()}
    assert set(stored) == set(days) and all(stored[k].total_revenue == direct[k].total_revenue for k in days)
    again = files()
    model_store.update_models(make_series(days), path, EVENTS)
    assert files() == again


def test_refit_reads_the_facts_once(spark):
    path = shared_folder(spark, "models")
    model_store.save_models(models_of(spark, FOLDER, ("aggregate", "channel")), path, EVENTS)
    table = model_store.refit_changed(series_of(spark, FOLDER), model_store.load_models(spark, path), EVENTS)
    assert {r.level for r in table.where("refitted").collect()} == {"campaign_type", "campaign"}
    table.collect()
    text = plan(table).split("Initial Plan")[0]  # the plan that ran
    assert text.count("FileScan parquet") == 3  # line items, parts and the store


def test_fingerprint_ignores_row_order(make_series):
    series = make_series({"a": [(i, 1) for i in range(20)]})
    one = model_store.fingerprints(series).collect()
    assert one == model_store.fingerprints(series.repartition(5).orderBy(F.rand(3))).collect()


def test_scratch_folders(spark):
    class Plain:
        class sparkContext:
            master, applicationId = "local[2]", "one"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    one, two = shared_folder(Plain, "a"), shared_folder(Plain, "a")
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
    assert shared_folder(Plain, "a", "/elsewhere/").startswith("/elsewhere/a-")
    Plain.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(Plain, "a")
    path = shared_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    remove_folder(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)


def test_scoring_run_writes_everything(spark):
    paths = scoring.score(spark, ad_facts(spark, FOLDER), shared_folder(spark, "score"), EVENTS,
                          lookback_days=3000)
    table = feature_store.load_predictions(spark, paths["predictions"])
    lazy = scoring.predictions(ad_facts(spark, FOLDER), EVENTS)
    key = ["level", "entity", "window_days"]
    assert sorted(map(tuple, table.select(*key, "revenue_point").collect())) == sorted(
        map(tuple, lazy.select(*key, "revenue_point").collect()))
    found = spark.read.parquet(paths["anomalies"])
    text = feature_store.predictions_compat(table, A.top(found, 20))
    assert text.count() == table.count() + 20 and {t for _, t in text.dtypes} == {"string"}


def test_series_plan_scans_facts_once_and_needs_no_python(spark):
    text = plan(forecast(models_of(spark, FOLDER), EVENTS))
    assert text.count("FileScan parquet") == 2  # line items and parts
    assert text.count("Exchange hashpartitioning") == 3
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert "l_orderkey" not in text.split("ReadSchema")[1]


def test_windows_share_the_exchange_of_the_series(spark):
    anomalies = plan(A.candidates(A.scored(series_of(spark, FOLDER), 3000)))
    assert anomalies.count("Exchange hashpartitioning") == 3 and "Exchange SinglePartition" not in anomalies


def test_date_range_reaches_the_scan(spark):
    text = plan(ad_facts(spark, FOLDER, "1996-01-01", "1996-12-31").select("ds"))
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_shipdate" in text
    rows = ad_facts(spark, FOLDER, "1996-01-01", "1996-12-31").agg(F.min("ds"), F.max("ds")).head()
    assert rows[0] >= date(1996, 1, 1) and rows[1] <= date(1996, 12, 31)


@pytest.mark.parametrize("key", ["campaign_summary", "top_campaigns", "portfolio_projection", "uplift_vs_baseline"])
def test_facts_are_scanned_once(spark, key):
    from tidemark.plans.catalog import QUERIES
    text = plan(QUERIES[key](spark, FOLDER))
    assert text.count("FileScan parquet") == 2  # line items and parts
    if key == "campaign_summary":
        assert text.count("Exchange hashpartitioning") == 2 and text.count("Join") <= 2  # with parts only


def test_no_cross_joins_in_the_catalog(spark):
    from tidemark.plans.catalog import QUERIES
    for key in ("walk_forward", "marginal_roas_curve", "uplift_vs_baseline", "campaign_summary", "micros_to_usd"):
        text = plan(QUERIES[key](spark, FOLDER))
        assert "Cartesian" not in text and "NestedLoop" not in text, key


def test_queries_without_sql_cover_all_levels(spark):
    from tidemark.plans.catalog import QUERIES
    for key in ("predictions_compat", "interval_monte_carlo_joint"):
        found = {r.level for r in QUERIES[key](spark, "/root/testdata/sf0.001").select("level").distinct().collect()}
        assert {"aggregate", "channel", "campaign_type", "campaign"} <= found

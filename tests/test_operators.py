"""Operators on literal series."""

import json
import math
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config as cfg
from tidemark.functions import scalars as S
from tidemark.functions.rolling import rolling_zscore, with_rolling_sums
from tidemark.operators import anomalies as A
from tidemark.operators import budget as B
from tidemark.operators import forecast as FC
from tidemark.operators import joint_model as J
from tidemark.operators import narrative as N
from tidemark.operators import promo, sampling
from tidemark.operators import summary as M
from tidemark.operators import validation as V
from tidemark.operators.models import joint
from tidemark.operators.series import (
    daily_series, daily_totals, densify, gap_free, sparse_series, with_first_gap_days)
from tidemark.operators.slice_model import fit_staged, model_coefficients

EVENTS = cfg.PROMO_EVENTS


def noisy(n, seed=1, base=100.0):
    r = random.Random(seed)
    return [(base * (1 + 0.1 * r.random()), 10 + r.random()) for _ in range(n)]


def one(df):
    got = df.collect()
    assert len(got) == 1
    return got[0]


# -- scalars -----------------------------------------------------------------

def test_three_zero_spend_rules(spark):
    row = one(spark.range(1).select(
        S.roas_daily(F.lit(5.0), F.lit(0.0)).alias("a"), S.roas_zero(F.lit(5.0), F.lit(0.0)).alias("b"),
        S.roas_floor1(F.lit(5.0), F.lit(0.0)).alias("c")))
    assert (row.a, row.b, row.c) == (None, 0.0, 5.0)


def test_relative_change_from_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0), (1.0, None)], "c double, p double")
    got = [r[0] for r in df.select(S.relative_change(F.col("c"), F.col("p"))).collect()]
    assert got == [math.inf, None, 0.5, None]


def test_texts_round_ties_to_even(spark):
    df = spark.createDataFrame([(12.5,), (1500.0,), (2_345_678.0,), (None,)], "v double")
    got = [r[0] for r in df.select(S.usd_text("v")).collect()]
    assert got == ["$12", "$1.5K", "$2.35M", None]


# -- series ---------------------------------------------------------------------

def test_far_dates_do_not_explode(make_facts):
    """A fact dated 9999 stops a gap-free series and adds one row to a sparse one."""
    facts = make_facts([("a", "t", "x", "2024-01-01", 10, 1), ("a", "t", "x", "2024-01-04", 20, 2), ("a", "t", "x", "9999-12-31", 5, 1)])
    with pytest.raises(Exception, match="sparse series"):
        daily_series(facts, ("channel",)).collect()
    sparse = sparse_series(facts, ("channel",))
    assert [(r.ds.year, r.gap) for r in sparse.orderBy("ds").collect()] == [
        (2024, 2), (2024, (date(9999, 12, 31) - date(2024, 1, 4)).days - 1), (9999, 0)]
    assert with_first_gap_days(sparse, 5).count() == 3 + 2 + 5
    assert A.detect(with_first_gap_days(sparse), 10_000_000, by_date=True).count() >= 0
    near = facts.where("ds < '2025-01-01'")
    dense = daily_series(near, ("channel",))
    assert gap_free(sparse_series(near, ("channel",))).select(dense.columns).exceptAll(dense).count() == 0
    with pytest.raises(Exception, match="no facts for 2 days"):
        gap_free(sparse_series(near, ("channel",)), longest_gap=1).collect()


def test_sparse_statistics_equal_the_dense_ones(make_facts):
    r = random.Random(8)
    days = sorted(r.sample(range(300), 90)) + [299]
    facts = make_facts([("a", "t", "x", (date(2024, 1, 1) + timedelta(days=i)).isoformat(), r.random() * 100, 1 + r.random()) for i in days])
    dense = A.scored(daily_series(facts, ("channel",)), 90)
    sparse = A.scored(sparse_series(facts, ("channel",)), 90, by_date=True)
    dense_rows = {x.ds: x for x in dense.collect()}
    for x in sparse.collect():
        for c in ("revenue_z", "roas_z", "mean14", "revenue_wow", "spend_wow"):
            assert x[c] == (dense_rows[x.ds][c] if dense_rows[x.ds][c] is None else pytest.approx(dense_rows[x.ds][c], rel=1e-9, abs=1e-12)), (x.ds, c)
        assert x.recent == dense_rows[x.ds].recent
    one_way = {(a.ds, a.type): a.magnitude for a in A.detect(daily_series(facts, ("channel",)), 3000, 1.5, everywhere=True).collect()}
    other = {(a.ds, a.type): a.magnitude for a in A.detect(
        with_first_gap_days(sparse_series(facts, ("channel",))), 3000, 1.5, everywhere=True, by_date=True).collect()}
    assert one_way.keys() == other.keys() and len(other) > 5
    assert all(other[k] == pytest.approx(v, rel=1e-9) for k, v in one_way.items())


def test_gap_is_filled_over_own_range(make_facts):
    facts = make_facts([("a", "t", "n", "2024-01-01", 5, 1), ("a", "t", "n", "2024-01-02", 6, 1),
                        ("a", "t", "n", "2024-01-10", 7, 0), ("b", "t", "m", "2024-01-05", 1, 1),
                        ("b", "t", "m", None, 9, 9)])
    got = daily_series(facts, ("channel",), with_roas=True).orderBy("entity", "ds").collect()
    a = [r for r in got if r.entity == "a"]
    assert [r.ds for r in a] == [date(2024, 1, d) for d in range(1, 11)]
    assert [float(r.revenue) for r in a] == [5, 6, 0, 0, 0, 0, 0, 0, 0, 7]
    assert a[-1].roas is None and a[0].roas == 5.0
    assert [(r.ds, float(r.revenue)) for r in got if r.entity == "b"] == [(date(2024, 1, 5), 1.0)]


def test_levels_in_one_pass_equal_single_levels(make_facts):
    r = random.Random(3)
    facts = make_facts([(r.choice("ab"), r.choice("xy"), r.choice("mn"),
                         (date(2024, 1, 1) + timedelta(days=r.randrange(30))).isoformat(),
                         r.randrange(100), r.randrange(9)) for _ in range(200)])
    together = {tuple(x) for x in daily_series(facts, min_nonzero_days=0).collect()}
    apart = {tuple(x) for lv in cfg.LEVELS for x in daily_series(facts, (lv,), min_nonzero_days=0).collect()}
    assert together == apart
    per_day = daily_totals(facts, ("aggregate", "channel")).groupBy("ds").agg(
        F.sum(F.when(F.col("level") == "aggregate", F.col("revenue"))).alias("a"),
        F.sum(F.when(F.col("level") == "channel", F.col("revenue"))).alias("c"))
    assert per_day.where("a <> c").count() == 0


@pytest.mark.parametrize("days, kept", [(59, False), (60, True)])
def test_campaign_gate(make_facts, days, kept):
    facts = make_facts([("a", "t", "n", (date(2024, 1, 1) + timedelta(days=i)).isoformat(), 1, 1)
                        for i in range(days)])
    assert (daily_series(facts, ("campaign",)).count() > 0) is kept
    assert daily_series(facts, ("channel",)).count() == days


def test_null_dates_count_in_summary_only(make_facts):
    facts = make_facts([("a", "y", "n", "2024-01-01", 5, 2), ("a", "x", "n", None, 7, 1),
                        ("a", "x", "n", "2024-01-02", 0, 1), ("a", "y", "n", "2024-01-01", 0, 0)])
    row = one(M.campaign_summary(facts))
    assert (float(row.total_revenue), float(row.total_spend), row.roas) == (12.0, 4.0, 3.0)
    assert (row.active_days, row.nonzero_revenue_days, row.campaign_type) == (2, 1, "x")
    assert one(M.data_profile(facts)).null_ds == 1


# -- rolling and anomalies ---------------------------------------------------------

def test_rolling_sums_match_brute_force(make_series):
    days = noisy(40)
    got = with_rolling_sums(make_series({"a": days}), ("revenue",), (7, 30)).orderBy("ds").collect()
    for i, row in enumerate(got):
        for n in (7, 30):
            want = None if i + 1 < n // 2 else sum(round(d[0], 4) for d in days[max(0, i - n + 1):i + 1])
            have = row[f"revenue_{n}d"]
            assert (have is None) == (want is None)
            assert want is None or float(have) == pytest.approx(want, abs=1e-9)


def test_zscore_is_null_without_spread_or_rows(make_series):
    z = rolling_zscore(F.col("revenue").cast("double"))
    flat = make_series({"a": [(5, 1)] * 30}).select(z.alias("z")).collect()
    assert all(r.z is None for r in flat)
    got = [r.z for r in make_series({"a": noisy(20)}).orderBy("ds").select("ds", z.alias("z")).orderBy("ds").collect()]
    assert all(v is None for v in got[:6]) and all(v is not None for v in got[6:])


def test_z_is_bounded_and_short_series_stay_silent(make_series):
    spike = noisy(20) + [(2000, 10)]
    short = noisy(7) + [(10_000, 10)]
    found = A.detect(make_series({"spike": spike, "short8": short}), lookback_days=3000).collect()
    assert {r.scope for r in found if r.type == "revenue_spike"} == {"spike"}
    top = max(r.magnitude for r in found)
    assert 2.5 <= top <= 13 / math.sqrt(14) + 1e-9
    assert {r.severity for r in found} == {"medium"}


def test_baseline_without_the_current_day_can_be_high(make_series):
    series = make_series({"spike": noisy(20) + [(2000, 10)]})
    found = A.detect(series, 3000, exclude_current=True).collect()
    assert max(r.magnitude for r in found) > 4 and "high" in {r.severity for r in found}


def test_zero_spend_reads_as_collapse(make_series):
    days = [(100 + i % 3, 10) for i in range(20)] + [(100, 0)]
    found = {r.type: r for r in A.detect(make_series({"all": days}), 3000).collect()}
    assert "ROAS dropped to nanx" in found["roas_collapse"].description


def test_decoupling_from_zero_spend(make_series):
    days = [(100, 0)] * 14 + [(100 - 10 * i, 5) for i in range(1, 8)]
    found = [r for r in A.detect(make_series({"all": days}), 3000).collect()
             if r.type == "spend_revenue_decoupling"]
    assert found and all(r.severity == "high" and r.magnitude_unit == "fraction" for r in found)
    assert any("inf%" in r.description for r in found)


def test_lookback_counts_from_each_series_end(make_series):
    a = noisy(20) + [(5000, 10)] + noisy(100, 2)
    b = noisy(20) + [(5000, 10)] + noisy(20, 2)
    found = A.detect(make_series({"a": a, "b": b})).collect()
    days = {r.scope for r in found if r.ds == date(2024, 1, 21)}
    assert days == {"b"}


def test_order_topk_and_digest(make_series, spark):
    series = make_series({"all": noisy(20) + [(5000, 10)] + noisy(20, 2) + [(1, 10)]})
    found = A.detect(series, 3000)
    listed = [(r.ds, r.magnitude) for r in A.ordered(found).collect()]
    assert listed == sorted(listed, key=lambda x: (x[0], x[1]), reverse=True) and len(listed) >= 2
    assert A.top(found, 1).count() == 1
    text = one(A.digest(found)).summary
    assert text.count("\n") == len(listed) - 1 and text.startswith("- [2024-02-11] MEDIUM | aggregate | Revenue drop of ")
    assert one(A.digest(found.where("false"))).summary == cfg.TEXT_NO_ANOMALY


# -- events ------------------------------------------------------------------------

def test_rule_reproduces_the_fixed_calendar():
    fixed = {(n, d) for n, d, _, _ in EVENTS if n != "prime_day"}
    ruled = {(n, d) for n, d, _, _ in promo.events_by_rule((2024, 2025, 2026))}
    assert fixed <= ruled


def test_events_cover_windows_and_overlaps(spark, make_series):
    events = [("x", "2024-01-05", -1, 1), ("y", "2024-01-06", 0, 1)]
    got = {r.ds.day: r.event for r in promo.with_event(make_series({"a": [(1, 1)] * 8}), events).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "x-1", 5: "x+0", 6: "x+1|y+0", 7: "y+1", 8: None}
    assert promo.promo_calendar(spark, events).count() == 5
    assert len(promo.indicator_names(EVENTS)) == 22


# -- model and forecast ---------------------------------------------------------------

def loglog(n=400, beta=0.5, seed=5):
    r = random.Random(seed)
    spend = [math.exp(r.uniform(2, 6)) for _ in range(n)]
    return [(100 * (1 + s) ** beta - 1, s) for s in spend]


@pytest.fixture(scope="module")
def loglog_models(make_series):
    return fit_staged(make_series({"a": loglog(), "all": loglog()}), EVENTS, settings=cfg.ModelSettings(shrinkage=0.0))


def test_elasticity_is_recovered(loglog_models):
    for row in loglog_models.collect():
        assert row.beta == pytest.approx(0.5, abs=0.01)


def test_doubling_budget_earns_less_than_double(loglog_models):
    curve = {r.daily_budget: r for r in B.marginal_curve(loglog_models, EVENTS, "a", [100, 200, 400]).collect()}
    assert curve[100].revenue_point < curve[200].revenue_point < 2 * curve[100].revenue_point
    assert curve[100].roas_point > curve[200].roas_point > curve[400].roas_point


def test_constant_spend_has_no_elasticity(make_series):
    row = one(fit_staged(make_series({"a": [(100 + i % 7, 10) for i in range(120)]}), EVENTS))
    assert row.beta == 0.0


def test_elasticity_cap(make_series):
    series = make_series({"a": loglog(beta=1.5)})
    assert one(fit_staged(series, EVENTS, settings=cfg.ModelSettings(cap_elasticity=1.0))).beta == 1.0


@pytest.mark.parametrize("n, nonzero, kept", [(89, 89, False), (90, 90, True), (90, 59, False), (90, 60, True)])
def test_forecast_gate(make_series, n, nonzero, kept):
    days = [((100 + i % 5) if i < nonzero else 0, 10 + i % 3) for i in range(n)]
    models = fit_staged(make_series({"a": days, "all": days}), EVENTS)
    got = {r.entity for r in FC.forecast(models, EVENTS).collect()}
    assert got == ({"a", "all"} if kept else {"all"})
    assert (FC.skipped_slices(models).count() == 0) is kept


def test_range_guards(make_series):
    high_then_dry = [(1000 + i % 9, 10 + i % 4) for i in range(300)] + [(0.5 + i % 2, 10) for i in range(90)]
    models = fit_staged(make_series({"fall": high_then_dry, "all": noisy(200)}), EVENTS)
    for r in FC.forecast(models, EVENTS).collect():
        assert r.revenue_lower >= r.revenue_floor - 1e-9
        assert r.revenue_upper >= max(r.revenue_point, r.revenue_lower)
        assert r.spend_upper >= max(r.spend_point, r.spend_lower)
        assert r.roas_lower >= cfg.ROAS_LOWER_BOUND
    daily = FC.predict_daily(models, EVENTS)
    assert daily.groupBy("entity").count().where("count <> 90").count() == 0


def test_floor_may_exceed_the_point(make_series):
    # long slump after a strong year: the tenth percentile of the sums stays above the fitted point
    days = [(1000 + i % 9, 10 + i % 4) for i in range(700)] + [(1 + i % 2, 10 + i % 3) for i in range(60)]
    rows = FC.forecast(fit_staged(make_series({"a": days}), EVENTS), EVENTS).collect()
    assert any(r.revenue_lower > r.revenue_point for r in rows)
    assert all(r.revenue_upper >= r.revenue_lower for r in rows)


def test_long_coefficients_cover_the_wide_row(loglog_models):
    long = model_coefficients(loglog_models).where("entity = 'a'").collect()
    got = {(r.target, r.term) for r in long}
    assert {("revenue", "log_spend"), ("spend", "slope"), ("revenue", "dow:1"), ("spend", "moy:12")} <= got


def test_sampled_bounds_resemble_the_analytic_ones(make_series):
    r = random.Random(11)
    days = [(math.exp(5 + 0.2 * r.gauss(0, 1)), 10 + r.random()) for _ in range(300)]
    models = fit_staged(make_series({"all": days}), EVENTS)
    analytic = {x.window_days: x for x in FC.forecast(models, EVENTS, floor=False).collect()}
    many = cfg.ModelSettings(uncertainty_samples=2000)
    sampled = {x.window_days: x for x in FC.forecast(models, EVENTS, settings=many, floor=False, interval="sum").collect()}
    daily = FC.predict_daily(models, EVENTS, settings=many).repartition(5)
    again = {x.window_days: x for x in FC.ranges(daily, many, floor=False, interval="sum").collect()}
    paths = {x.window_days: x for x in FC.ranges(daily, many, floor=False, interval="path").collect()}
    for d in cfg.HORIZONS:
        for m in ("revenue", "spend"):
            for b in ("lower", "upper"):
                assert sampled[d][f"{m}_{b}"] == pytest.approx(analytic[d][f"{m}_{b}"], rel=0.03)
            # summed quantiles assume days that move together, so whole paths are narrower
            assert sampled[d][f"{m}_lower"] < paths[d][f"{m}_lower"] < paths[d][f"{m}_upper"] < sampled[d][f"{m}_upper"]
        assert sampled[d].revenue_upper == pytest.approx(again[d].revenue_upper, rel=1e-12)
        assert sampled[d].revenue_point == pytest.approx(analytic[d].revenue_point, rel=1e-9)
        assert sampled[d].roas_lower == pytest.approx(analytic[d].roas_lower, rel=1e-9)


def test_trend_changes_widen_paths_and_single_days(make_series):
    models = fit_staged(make_series({"all": loglog(400)}), EVENTS).withColumn("y_slope", F.lit(0.02))
    width = {}
    for changes in (0.0, 40.0):
        settings = cfg.ModelSettings(uncertainty_samples=200, trend_changes=changes)
        for interval in ("sum", "path"):
            row = FC.forecast(models, EVENTS, settings=settings, floor=False, interval=interval).where("window_days = 90").head()
            width[interval, changes] = row.revenue_upper - row.revenue_lower
    assert width["path", 40.0] > 1.2 * width["path", 0.0] and width["sum", 40.0] > 1.05 * width["sum", 0.0]


def test_days_beyond_the_draws_are_an_error(make_series):
    models = fit_staged(make_series({"all": loglog(200)}), EVENTS, horizons=(30, 120))
    with pytest.raises(Exception, match="beyond the days"):
        FC.forecast(models, EVENTS, interval="sum").collect()
    assert FC.forecast(models, EVENTS, interval="path", days=120).count() == 2
    with pytest.raises(ValueError, match="interval"):
        FC.forecast(models, EVENTS, interval="none")


def test_draws_are_what_they_should_be(spark):
    settings = cfg.ModelSettings(uncertainty_samples=4000)
    rows = sampling.draws(spark, 2, settings).collect()
    for r in rows:
        for m in sampling.METRICS:
            noise, bend, size = (np.array(r[f"{m}_{c}"]) for c in ("noise", "bend", "size"))
            assert abs(noise.mean()) < 0.06 and abs(noise.std() - 1) < 0.05
            assert 0 < bend.min() and bend.max() < 1 and abs(bend.mean() - 0.5) < 0.03
            assert abs(np.abs(size).mean() - 1) < 0.08 and abs((size > 0).mean() - 0.5) < 0.04
    assert abs(np.corrcoef(rows[0].revenue_noise, rows[1].revenue_noise)[0, 1]) < 0.06


def test_quantile_of_sorted_values(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    row = spark.range(1).select(*(sampling.quantile(F.array(*map(F.lit, values)), q, 4).alias(str(q)) for q in (0.0, 0.1, 0.5, 1.0))).head()
    assert list(row) == pytest.approx([np.percentile(values, 100 * q) for q in (0.0, 0.1, 0.5, 1.0)])


def test_forecast_without_the_spend_regressor(loglog_models):
    plain = cfg.ModelSettings(use_spend_regressor=False)
    with_, without = (FC.predict_daily(loglog_models, EVENTS, settings=s).where("entity = 'a' and h = 1").head()
                      for s in (cfg.ModelSettings(), plain))
    assert with_.beta != 0 and without.beta == 0 and without.y_sigma > with_.y_sigma
    assert without.spend_yhat == with_.spend_yhat


# -- joint model -----------------------------------------------------------------------

def test_joint_solver_matches_brute_force():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(200, 4))
    target = rows @ np.array([1.0, -2.0, 0.5, 0.0]) + 0.1 * rng.normal(size=200)
    def solved(solver):
        return solver(rows.T @ rows, rows.T @ target, target @ target, len(target))

    scale, none = np.array([10.0, 10.0, 10.0, 10.0]), np.zeros(4, dtype=bool)
    theta, noise, steps, left = solved(J.posterior_mode(scale, none))
    ridge = np.linalg.solve(rows.T @ rows + np.diag(noise**2 / scale**2), rows.T @ target)
    assert np.allclose(theta, ridge, atol=1e-9) and noise == pytest.approx(0.1, rel=0.2)
    assert steps < 20 and left < 1e-9
    sparse, _, _, left = solved(J.posterior_mode(np.array([10.0, 10.0, 10.0, 0.001]), np.array([False, False, False, True])))
    assert abs(sparse[3]) < abs(theta[3]) and left < 1e-6
    plain, _, steps, left = solved(J.posterior_mode(scale, none, priors=False))
    assert np.allclose(plain, np.linalg.lstsq(rows, target, rcond=None)[0], atol=1e-9) and steps == 2 and left < 1e-9


def test_joint_optimum_is_a_minimum():
    """No step away from the solution lowers the penalised loss, Laplace terms included."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 6))
    target = rows @ np.array([0.5, 0.0, 0.0, 1.0, 0.02, 0.0]) + 0.3 * rng.normal(size=300)
    scale, laplace = np.full(6, 0.05), np.array([False, True, True, True, True, False])
    theta, noise, _, left = J.posterior_mode(scale, laplace)(rows.T @ rows, rows.T @ target, target @ target, 300)

    def loss(t):
        prior = np.where(laplace, np.abs(t) / scale, t * t / (2 * scale**2))
        return ((target - rows @ t) ** 2).sum() / (2 * noise**2) + prior.sum()

    assert left < 1e-6
    for _ in range(200):
        assert loss(theta) <= loss(theta + rng.normal(size=6) * 1e-3) + 1e-3


def test_normal_sums_are_the_products(make_series):
    design = J.Design(changepoints=2, yearly_order=1, weekly_order=1)
    matrix = J.design_matrix(make_series({"a": loglog(120)}), EVENTS, design)
    days = matrix.collect()
    w = np.array([[*d.row, d.y, d.z] for d in days])
    row = one(J.normal_sums(matrix, cfg.SLICE))
    assert row.n == 120 and np.allclose(row.sums, (w.T @ w)[np.triu_indices(w.shape[1])])


def test_joint_fit_per_slice(make_series):
    series = make_series({"a": loglog(), "b": loglog(seed=9)})
    design = J.Design(changepoints=3, yearly_order=1)
    fitted = J.fit_joint(series, EVENTS, design)
    long = J.joint_coefficients(fitted, EVENTS, design).collect()
    terms = design.terms(EVENTS, cfg.ModelSettings())
    assert len(long) == 2 * (2 * len(terms) - 1)
    model = joint(design)
    models = model.fit(series, EVENTS)
    assert {r.entity: r.coef for r in models.collect()} == {r.entity: r.coef for r in fitted.collect()}
    windows = FC.forecast(models, EVENTS, predict=model.predict).collect()
    rich = B.simulate_channels(models, EVENTS, {"a": 1000.0}, model=model).where("entity = 'a' and window_days = 30").head()
    assert rich.spend_point == 30_000.0 and rich.revenue_point > windows[0].revenue_point
    assert len(windows) == 6 and all(w.revenue_point > 0 and w.revenue_upper >= w.revenue_point for w in windows)


# -- budgets ------------------------------------------------------------------------------

def test_fallback_and_portfolio(make_series):
    models = fit_staged(make_series({"big": noisy(200), "small": [(30, 10)] * 40}), EVENTS)
    budgets = {"big": 12.0, "small": 5.0, "absent": 99.0}
    fallback = {r.window_days: r for r in B.simulate_fallback(models, budgets).collect()}
    assert fallback[30].revenue_point == pytest.approx(5 * 30 * 3)
    assert fallback[30].revenue_lower == pytest.approx(0.6 * 450) and fallback[30].revenue_upper == pytest.approx(1.4 * 450)
    channels = {r.window_days: r for r in B.simulate_channels(models, EVENTS, budgets).collect()}
    assert channels[60].spend_point == channels[60].spend_lower == channels[60].spend_upper == 720.0
    total = {r.window_days: r for r in B.portfolio(models, EVENTS, budgets).collect()}
    assert total[30].spend == pytest.approx(12 * 30 + 5 * 30)
    assert total[30].revenue_point == pytest.approx(channels[30].revenue_point + 450)


def test_pace_and_uplift(make_series):
    models = fit_staged(make_series({"all": noisy(200), "a": noisy(200)}), EVENTS)
    pace = one(B.budget_pace(models, {"a": 20.0}))
    assert pace.monthly_budget == 600.0 and pace.change_pct == pytest.approx((20 / pace.trailing_daily_spend - 1) * 100)
    sides = B.uplift(models, EVENTS, {"zzz": 1.0}).collect()
    assert len(sides) == 3 and all(abs(s.uplift_pct) < 1e-6 for s in sides)


# -- validation ------------------------------------------------------------------------------

def test_nothing_after_a_cutoff_reaches_the_fit(make_series):
    base = noisy(300)
    wild = base[:200] + [(r * 50, s * 9) for r, s in base[200:]]
    cutoff = (date(2024, 1, 1) + timedelta(days=200)).isoformat()
    calm, changed = (one(V.backtest(make_series({"all": d}), EVENTS, cutoff, 90)) for d in (base, wild))
    assert calm.predicted == changed.predicted and calm.revenue_upper == changed.revenue_upper
    assert changed.actual > 40 * calm.actual
    assert changed.covered is False and changed.ape_pct == pytest.approx(
        abs(changed.predicted - changed.actual) / changed.actual * 100)


def test_folds_in_one_job_equal_single_folds(make_series):
    series = make_series({"all": noisy(400)})
    cuts = ["2024-08-01", "2024-10-01"]
    together = {(r.cutoff, r.window_days): tuple(r) for r in V.walk_forward(series, EVENTS, cuts).collect()}
    assert len(together) == 6
    for c in cuts:
        for r in V.walk_forward(series, EVENTS, [c]).collect():
            assert tuple(r) == together[(r.cutoff, r.window_days)]
    summary = V.coverage_summary(V.walk_forward(series, EVENTS, cuts)).collect()
    assert all(s.n_folds == 2 and 0 <= s.coverage <= 1 for s in summary)


# -- narrative ---------------------------------------------------------------------------------

def test_contexts_are_json(make_series):
    days = noisy(200)
    days[150] = (900.0, 10.0)
    series = make_series({"all": days, "a": days})
    models = fit_staged(series, EVENTS)
    forecasts, found = FC.forecast(models, EVENTS), A.detect(series, 3000)
    assert found.count() > 0
    doc = json.loads(one(N.context_forecast(forecasts)).context)
    assert [w["days"] for w in doc["forecast_windows"]] == [30, 60, 90]
    assert set(doc["channel_30d"]) == {"a"} and doc["forecast_windows"][0]["interval_width_pct"] == 80
    assert doc["trailing_30d"]["period"] == "2024-06-19 to 2024-07-18"
    windows = N.scenario_windows(models, EVENTS, {"a": 15.0})
    assert {(w.scenario, w.level) for w in windows.collect()} == {("baseline", "aggregate"), ("baseline", "channel"), ("budget", "channel")}
    assert json.loads(one(N.context_forecast(windows)).context) == doc
    sim = json.loads(one(N.context_budget(windows, {"a": 15.0})).context)
    assert sim["total_daily_budget"] == 15.0 and set(sim["portfolio_forecast"]) == {"30", "60", "90"}
    assert sim["channel_30d"]["a"]["budget_30d"] == 450
    assert sim["baseline_30d"]["revenue"] == doc["forecast_windows"][0]["revenue_point"]
    risk = json.loads(one(N.context_risk(windows, found, {"a": 15.0})).context)
    assert risk["budget_by_channel"] == {"a": 15.0} and set(risk["channel_concentration"]) == {"a"}
    listed = json.loads(one(N.context_anomalies(windows, found)).context)
    assert listed["trailing_30d"] == doc["trailing_30d"] and len(listed["anomalies"]) == min(6, found.count())
    prompts = {p.prompt_kind: p for p in N.prompt_table(windows, found, {"a": 15.0}).collect()}
    assert set(prompts) == {"forecast", "budget", "anomalies", "risk"} and all(p.needs_call for p in prompts.values())
    assert all(p.context in p.user_text and len(p.user_text) > 50 for p in prompts.values())
    shown = one(N.preview(windows, found, "a service"))
    assert json.loads(shown.forecast_explanation_prompt) == doc and shown.anomaly_count == found.count()
    assert len(shown.top_anomalies) == min(4, found.count()) and shown.service == "a service"


def test_prompts_without_anomalies(make_series):
    series = make_series({"all": noisy(200), "a": noisy(200)})
    models = fit_staged(series, EVENTS)
    windows, none = N.scenario_windows(models, EVENTS, {}), A.detect(series, 3000).limit(0)
    prompts = {p.prompt_kind: p for p in N.prompt_table(windows, none, {"a": 1.0}).collect()}
    assert not prompts["anomalies"].needs_call and prompts["anomalies"].user_text == cfg.TEXT_NO_RECENT_ANOMALY
    assert prompts["forecast"].needs_call and one(N.preview(windows, none)).top_anomalies == []


def test_documents_read_back_by_their_schema(make_series):
    series = make_series({"all": noisy(200), "a": noisy(200)})
    windows, found = N.scenario_windows(fit_staged(series, EVENTS), EVENTS, {"a": 15.0}), A.detect(series, 3000)
    for kind, made in (("forecast", N.context_forecast(windows)), ("budget", N.context_budget(windows, {"a": 15.0})),
                       ("anomalies", N.context_anomalies(windows, found)), ("risk", N.context_risk(windows, found, {"a": 15.0}))):
        doc = json.loads(one(made).context)

        def leaves(value):
            if isinstance(value, dict):
                return sum(map(leaves, value.values()))
            return sum(map(leaves, value)) if isinstance(value, list) else 1

        assert N.document_rows(made, kind).count() == leaves(doc)


def test_a_window_that_was_not_fitted_is_an_error(loglog_models):
    with pytest.raises(Exception, match="no window of 45 days"):
        B.marginal_curve(loglog_models, EVENTS, "a", [100.0], window_days=45).collect()


def test_budgets_without_a_model_fall_back(make_series):
    """One pass gives modelled channels, channels by ratio, and drops those that have neither."""
    series = make_series({"all": loglog(200), "a": loglog(200), "b": loglog(50), "c": loglog(50)})
    models = fit_staged(series, EVENTS)
    rows = {(r.entity, r.window_days): r for r in B.simulated(B.with_budget(models, {"a": 30.0, "b": 10.0}), EVENTS).collect()}
    assert {e for e, _ in rows} == {"a", "b"} and rows["a", 30].by_model and not rows["b", 30].by_model
    fallback = {r.window_days: r for r in B.simulate_fallback(models, {"a": 30.0, "b": 10.0}).collect()}
    for d in cfg.HORIZONS:
        for c in ("revenue_lower", "revenue_point", "revenue_upper", "spend_point"):
            assert rows["b", d][c] == pytest.approx(fallback[d][c])
    total = {r.window_days: r for r in B.portfolio(models, EVENTS, {"a": 30.0, "b": 10.0}).collect()}
    assert total[30].revenue_point == pytest.approx(rows["a", 30].revenue_point + rows["b", 30].revenue_point)


def test_windows_beyond_ninety_days_sum_all_their_days(spark, make_series):
    from tidemark.operators import forecast, slice_model

    series = make_series({"google": [(1000 + i % 7, 100 + i % 5) for i in range(400)]})
    models = slice_model.fit_staged(series, [], horizons=(30, 90, 180))
    got = {r.window_days: r for r in forecast.forecast(models, []).collect()}
    assert got[180].spend_point > 1.8 * got[90].spend_point and got[180].revenue_point > 1.8 * got[90].revenue_point


def test_unfinished_test_windows_are_not_scored(spark, make_series):
    from tidemark.operators import validation

    series = make_series({"google": [(1000 + i % 7, 100 + i % 5) for i in range(400)]})
    rows = validation.walk_forward(series, [], ["2025-01-20"]).collect()  # the series ends on 2025-02-03
    assert rows == []
    rows = validation.walk_forward(series, [], ["2024-11-20"]).collect()
    assert sorted(r.window_days for r in rows) == [30, 60]


def test_date_notations(spark):
    from datetime import date

    from pyspark.sql import functions as F

    from tidemark.functions.scalars import parse_date

    texts = ["2024-01-05", "1/5/2024", "2024/1/5", "20240105", "01-05-2024", "Jan 5, 2024", "5 Jan 2024", "2024-01-05 10:00:00"]
    df = spark.createDataFrame([(t,) for t in [*texts, "45292", "x"]], "t string")
    got = {r.t: r.d for r in df.select("t", parse_date(F.col("t"), "null").alias("d")).collect()}
    assert all(got[t] == date(2024, 1, 5) for t in texts) and got["45292"] is None and got["x"] is None

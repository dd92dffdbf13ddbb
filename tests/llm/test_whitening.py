"""Whitening against a plain eigendecomposition, the rank-one update on hard spectra, odd rows."""

import numpy as np
import pytest

from tidemark.llm import whitening as W

SMALL = "/root/testdata/sf0.001"


def scatter(x):
    away = x - x.mean(0)
    return away.T @ away


@pytest.mark.parametrize("kind", ["noise", "rank", "ties", "scales", "single", "equal"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 12))
    x = {"noise": x, "rank": x[:, :3] @ rng.standard_normal((3, 12)), "ties": np.repeat(np.eye(12), 20, axis=0),
         "scales": x * 10.0 ** np.arange(-6, 6), "single": x[:1], "equal": np.ones((40, 12))}[kind]
    s = W.Spectrum.empty(12)
    for row in x:
        s.add(row)
    c = scatter(x)
    size = max(np.abs(c).max(), 1e-300)
    assert np.abs((s.vectors * s.values) @ s.vectors.T - c).max() <= 1e-12 * size
    assert np.abs(s.vectors.T @ s.vectors - np.eye(12)).max() < 1e-12
    assert (np.diff(s.values) >= 0).all() and np.allclose(s.mean, x.mean(0))


def test_secular_roots_interlace():
    rng = np.random.default_rng(6)
    for k in (2, 3, 30):
        d, w = np.sort(rng.random(k)), rng.random(k) ** 8 + 1e-12
        origin, t = W.secular_roots(d, w)
        roots = d[origin] + t
        assert (roots > d).all() and (roots[:-1] < d[1:]).all() and roots[-1] <= d[-1] + w.sum() * (1 + 1e-12)
        assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(np.sqrt(w), np.sqrt(w))), rtol=1e-12)


def test_combined_spectra():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 9)) + np.arange(500)[:, None] / 100
    whole = W.Spectrum.empty(9)
    for part in np.array_split(x, 7):
        s = W.Spectrum.empty(9)
        for row in part:
            s.add(row)
        whole.combine(s.refreshed())
    assert whole.n == 500 and np.allclose(whole.mean, x.mean(0))
    assert np.abs((whole.vectors * whole.values) @ whole.vectors.T - scatter(x)).max() < 1e-9


def against_plain(vectors, rows, scale=256, components=4):
    x = np.floor(scale * np.array([v for _, v in vectors], dtype=np.float64))
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    values, basis = np.linalg.eigh(scatter(fit) / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    white = (x - total / n) @ basis / np.sqrt(values)
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == {i for i, _ in vectors}
    sign = np.sign([sum(got[i][c + 1].whitened * white[k, c] for k, (i, _) in enumerate(vectors)) for c in range(len(values))])
    for k, (i, _) in enumerate(vectors):
        away = sum((n * int(v) - int(t)) ** 2 for v, t in zip(x[k], total, strict=True))
        for c in range(len(values)):
            r = got[i][c + 1]
            assert r.n == n and r.deviation == away
            assert abs(r.whitened * sign[c] - white[k, c]) < 1e-9
            assert abs(r.explained - values[c] / (np.trace(scatter(fit)) / n)) < 1e-9 and r.identity_error < 1e-9


def test_query_against_plain(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    against_plain([(r.vec_id, r.embedding) for r in rows], W.query(spark, SMALL).collect())


def test_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(W, "TASK_ROWS", 9)
    monkeypatch.setattr(W, "FAN_IN", 2)
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    against_plain([(r.vec_id, r.embedding) for r in rows], W.query(spark, SMALL).collect())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(i, [float(i % 7), float(i * i % 11), float(i % 3)]) for i in range(30)]
    odd = [(40, None), (41, [1.0, None, 0.0]), (42, [nan, 0.0, 0.0]), (43, [0.0, inf, 0.0]), (44, []), (45, [1.0, 2.0])]
    again = [(50, fine[3][1]), (50, fine[3][1]), (None, fine[4][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in fine + odd + again], "vec_id long, embedding array<float>, x string, n int")
    rows = W.whitened(df).collect()
    assert len(rows) == 3 * (len(fine) + 3)  # as many components as dimensions; one vector of length two has none
    assert {r.vec_id for r in rows} == {i for i, _ in fine} | {50, None}
    against_plain(fine, [r for r in rows if r.vec_id is not None and r.vec_id < 40], components=3)
    assert W.whitened(df.limit(0)).columns == W.whitened(df).columns and W.whitened(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert W.whitened(one).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>")
    got = W.whitened(line).collect()
    assert len(got) == 5 and abs(sum(r.whitened**2 for r in got) / 5 - 1) < 1e-12 and abs(got[0].explained - 1) < 1e-12


def test_huge_components(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5e9, 2.0])], "vec_id long, embedding array<double>")
    rows = W.whitened(df).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3} and all(r.deviation is None for r in rows if r.vec_id != 3)


def test_exact_sums():
    x = np.array([[2**62, -(2**63)], [2**62, -(2**63)], [2**62, 5]], dtype=np.int64)
    assert W.exact_sum(x).tolist() == [3 * 2**62, 5 - 2**64]
    assert W.deviations(np.array([[3, 4]]), 2, (6, 7)) == [1]
    assert W.deviations(np.array([[2**40]]), 2**30, (0,)) == [None]

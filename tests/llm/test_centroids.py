"""k-means by bounded search against plain rounds in whole numbers."""

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import centroids as C

SMALL = "/root/testdata/sf0.001"


def plain(vectors, k=C.CENTROIDS, rounds=C.ROUNDS, seed=C.SEED):
    """vectors: (vec_id, list of whole numbers)."""
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~", x) for i, x in vectors)[:k]
    centers = [list(x) for _, x in start]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in vectors]
        for j in range(len(centers)):
            mine = [x for o, (_, x) in zip(own, vectors, strict=True) if o == j]
            if mine:
                centers[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [nearest(x) for _, x in vectors]
    inertia = sum(d for d, _ in last)
    of = {j: sum(d for d, i in last if i == j) for j in range(len(centers))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((str(i), j, d, of[j], inertia, sha[j]) for (i, _), (d, j) in zip(vectors, last, strict=True))


def got(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_query_against_plain(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    vectors = [(r.vec_id, [int(np.floor(1024 * np.float64(v))) for v in r.embedding]) for r in rows]
    assert got(C.query(spark, SMALL)) == plain(vectors)


@pytest.mark.parametrize("seed", range(12))
def test_search_with_ties(seed):
    """Coarse grids: many equal distances, many moves; bounds of one round are used in the next."""
    rng = random.Random(seed)
    dim, k = rng.choice([1, 2, 5]), rng.choice([1, 2, 3, 9, 20])
    x = np.array([[rng.randrange(-3, 4) for _ in range(dim)] for _ in range(400)], dtype=np.int64)
    now, before = np.array([[rng.randrange(-3, 4) for _ in range(dim)] for _ in range(k)], dtype=np.int64), None
    n = len(x)
    b = C.Bounded(x, np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n))
    for _ in range(12):
        C.search(b, C.Layout.of(now, before))
        squares = ((x[:, None, :] - now[None]) ** 2).sum(2)
        assert (b.first == squares.argmin(1)).all()
        if k > 1:
            distance = np.sqrt(squares)
            assert (b.upper >= distance[np.arange(n), b.first]).all()
            distance[np.arange(n), b.first] = np.inf
            assert (b.lower <= distance.min(1)).all()
        before, now = now, now + np.array([[rng.randrange(-1, 2) for _ in range(dim)] for _ in range(k)])


def test_most_vectors_are_not_compared_again():
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((3000, 8)) * 10 + rng.integers(0, 6, 3000)[:, None] * 300).astype(np.int64)
    now = x[[np.flatnonzero(x[:, 0] // 150 == 2 * g)[0] if (x[:, 0] // 150 == 2 * g).any() else g for g in range(6)]]
    n = len(x)
    b = C.Bounded(x, np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.zeros(n))
    C.search(b, C.Layout.of(now))
    seen = []
    plain_squared = C.squared
    try:
        C.squared = lambda a, c: (seen.append(len(a)), plain_squared(a, c))[1]
        C.search(b, C.Layout.of(now + 1, now))
    finally:
        C.squared = plain_squared
    assert sum(s for s in seen if s > 6) < n


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(1)
    fine = [(i, [rng.randrange(-8, 9) / 1024 for _ in range(3)]) for i in range(40)] + [(7, [0.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5])]
    odd = [(60, None), (61, [1.0, None, 0.0]), (62, [nan, 0.0, 0.0]), (63, [0.0, -inf, 0.0]), (64, []), (65, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in fine + odd], "vec_id long, embedding array<double>, x string, cluster int")
    whole = [(i, [int(np.floor(1024 * v)) for v in x]) for i, x in fine]
    assert got(C.assigned(C.clustered(C.whole(df, 3), k=5, rounds=4, dim=3))) == plain(whole, k=5, rounds=4)
    few = C.clustered(C.whole(df.where("vec_id < 3"), 3), k=5, rounds=2, dim=3)
    assert got(C.assigned(few)) == plain(whole[:3], k=5, rounds=2)
    none = C.assigned(C.clustered(C.whole(df.limit(0), 3), dim=3))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert C.assigned(C.clustered(C.whole(df), k=5)).count() == 0


def test_an_empty_centroid_stays(spark):
    vectors = [(i, [0.0]) for i in range(6)] + [(9, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    whole = [(i, [int(1024 * v[0])]) for i, v in vectors]
    assert got(C.assigned(C.clustered(C.whole(df, 1), k=4, rounds=3, dim=1))) == plain(whole, k=4, rounds=3)


def test_huge_components(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.0]), (4, [1.0])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in C.assigned(C.clustered(C.whole(df, 1), k=1, rounds=1, dim=1)).collect()}
    assert set(rows) == {1, 2, 3, 4} and rows[1].distance is None and rows[1].inertia is None

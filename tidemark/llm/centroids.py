"""Exact k-means in whole numbers, with the Shallot search for the nearest centroid.

Every vector remembers its nearest and second-nearest centroid, an upper bound of its distance to the first and a lower
bound of its distance to any other. When centroids move, the bounds move with them; a vector whose upper bound stays below
the lower bound, or below half the distance from its centroid to the next one, cannot change. For the others the distances
to the two remembered centroids are taken, the scan starts at the closer one, and goes through that centroid's neighbours
in order of their distance from it, as far as the sum of the vector's distance to the start and to its second-nearest
centroid so far: the ball shrinks as closer centroids are found. Bounds are floating point and rounded to the safe side;
what they do not rule out is compared by whole squared distances, so results are exact and ties go to the smaller number.

Vectors with their bounds are one table for each round in the shared folder; the table before the last is removed. Nothing
is shuffled but sums: a round adds, for each task, the vectors that changed their centroid to whole-number sums, and only
centroids (their number times the vector length) reach the driver.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; repeated rows
are separate vectors; equal hashes of starting vectors are ordered by the vector; a null vec_id never starts a centroid
unless there are too few others; fewer vectors than centroids give as many centroids as there are vectors; a centroid
without vectors stays where it is; a distance or inertia beyond a long is null; components beyond a long are cut to it;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.session import shared_folder

DIM = 64
CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
#: Bounds are widened by this share of their size, far above the rounding of a square root of a whole number.
_SLACK = 1e-9
#: Squared distances from here on count as this one, which no long holds; sums of it still fit in a decimal.
_BEYOND = 10**25
#: Vectors whose distances are compared at once.
_ROWS = 4096


def whole(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of the given length as whole numbers."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform("c", lambda v: F.floor(v * scale).cast("long"))
    return vectors.select("vec_id", c.alias("c")).where(F.size("c") == dim).where(fine).select("vec_id", x.alias("x"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in rows.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(k).collect()]


# ------------------------------------------------------------------ distances

def safe(*arrays: np.ndarray) -> bool:
    """Whether squared distances of these vectors fit in 64 bits."""
    most = sum(max(int(a.max(initial=0)), -int(a.min(initial=0))) for a in arrays)
    return most * most * arrays[0].shape[-1] < 1 << 63


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to rows of c (or to one c)."""
    away = x - c if safe(x, np.atleast_2d(c)) else x.astype(object) - np.asarray(c).astype(object)
    return (away * away).sum(1)


def length(square: np.ndarray) -> np.ndarray:
    return np.sqrt(square.astype(np.float64))


@dataclass
class Layout:
    """What one round needs to know of its centroids."""

    centroids: np.ndarray
    #: For every centroid all others by rising distance, and these distances rounded down.
    order: np.ndarray
    apart: np.ndarray
    #: How far each has moved since the bounds were made, rounded up.
    moved: np.ndarray
    moved_most: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None = None) -> Layout:
        k = len(centroids)
        apart = np.array([length(squared(centroids, c)) for c in centroids]).reshape(k, k) * (1 - _SLACK)
        np.fill_diagonal(apart, -1)
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        moved = length(squared(centroids, before)) * (1 + _SLACK) if before is not None else np.zeros(k)
        others = np.array([np.delete(moved, i).max(initial=0) for i in range(k)])
        return cls(centroids, order, np.take_along_axis(apart, order, axis=1), moved, others)


@dataclass
class Bounded:
    """Vectors with nearest and second-nearest centroid and the bounds of their distances."""

    x: np.ndarray
    first: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def search(b: Bounded, at: Layout) -> None:
    """Renews the bounds of b for the centroids of a round; afterwards first is the nearest centroid."""
    k = len(at.centroids)
    if k == 1:
        b.upper += at.moved[0]
        return
    b.upper += at.moved[b.first]
    b.lower -= at.moved_most[b.first]
    limit = np.maximum(b.lower, at.apart[b.first, 0] / 2) * (1 - _SLACK)
    open_ = np.flatnonzero(b.upper >= limit)
    for lo in range(0, len(open_), _ROWS):
        _settle(b, at, open_[lo : lo + _ROWS], limit)


def _settle(b: Bounded, at: Layout, rows: np.ndarray, limit: np.ndarray) -> None:
    near = squared(b.x[rows], at.centroids[b.first[rows]])
    b.upper[rows] = length(near) * (1 + _SLACK)
    still = b.upper[rows] >= limit[rows]
    rows, near = rows[still], near[still]
    if not len(rows):
        return
    x, first, second = b.x[rows], b.first[rows].copy(), b.second[rows].copy()
    next_ = squared(x, at.centroids[second])
    swap = (next_ < near) | ((next_ == near) & (second < first))
    first[swap], second[swap] = second[swap], first[swap]
    near[swap], next_[swap] = next_[swap], near[swap]
    start, begun = first.copy(), second.copy()
    to_start = length(near) * (1 + _SLACK)
    ball = to_start + length(next_) * (1 + _SLACK)
    active = np.arange(len(rows))
    for step in range(len(at.centroids) - 1):
        active = active[at.apart[start[active], step] <= ball[active]]
        if not len(active):
            break
        other = at.order[start[active], step]
        some, other = active[other != begun[active]], other[other != begun[active]]
        if not len(some):
            continue
        d = squared(x[some], at.centroids[other])
        wins = (d < near[some]) | ((d == near[some]) & (other < first[some]))
        follows = ~wins & (d < next_[some])
        w, f = some[wins], some[follows]
        second[w], next_[w] = first[w], near[w]
        first[w], near[w] = other[wins], d[wins]
        second[f], next_[f] = other[follows], d[follows]
        changed = np.concatenate([w, f])
        ball[changed] = to_start[changed] + length(next_[changed]) * (1 + _SLACK)
    b.first[rows], b.second[rows] = first, second
    b.upper[rows] = length(near) * (1 + _SLACK)
    b.lower[rows] = length(next_) * (1 - _SLACK)


# ------------------------------------------------------------------ rounds

_STATE = "vec_id {id}, x array<long>, cluster int, was int, second int, upper double, lower double"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def _round(now: Layout, fresh: bool):
    """Maps vectors (fresh) or vectors with bounds to vectors with the bounds of this round."""
    k = len(now.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x = len(batch), _matrix(batch.column("x"))
            if fresh:  # bounds that rule nothing out
                was = np.full(n, -1, dtype=np.int32)
                b = Bounded(x, np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n))
            else:
                was, second, upper, lower = (batch.column(c).to_numpy() for c in ("cluster", "second", "upper", "lower"))
                b = Bounded(x, was.copy(), second.copy(), upper.copy(), lower.copy())
            search(b, now)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), *map(pa.array, (b.first, was, b.second, b.upper, b.lower))],
                names=["vec_id", "x", "cluster", "was", "second", "upper", "lower"])

    return run


def _column_sums(x: np.ndarray) -> list[int]:
    low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
    return [(int(h) << 32) + int(v) for v, h in zip(low, high, strict=True)]


def _changes(dim: int):
    """For each task: how many vectors a centroid won, less those it lost (at -1), and the same for sums (at a component)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            x, to, of = _matrix(batch.column("x")), batch.column("cluster").to_numpy(), batch.column("was").to_numpy()
            for side, sign in ((to, 1), (of, -1)):
                for c in np.unique(side[side >= 0]).tolist():
                    mine = x[side == c]
                    held = total.setdefault(c, [0] * (dim + 1))
                    for j, v in enumerate([len(mine), *_column_sums(mine)]):
                        held[j] += sign * v
        rows = [(c, j - 1, str(v)) for c, held in total.items() for j, v in enumerate(held)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.string())], names=["cluster", "at", "value"])

    return run


def _moved(state: DataFrame, sums: np.ndarray, dim: int) -> None:
    """Adds to sums (count, then components, for each centroid) the vectors that changed their centroid."""
    some = state.where("cluster <> was").select("x", "cluster", "was")
    added = some.mapInArrow(_changes(dim), "cluster int, at int, value string").groupBy("cluster", "at").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    for r in added.collect():  # at most one row for each component of each centroid
        sums[r["cluster"], r["at"] + 1] += int(r["value"])


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@dataclass(frozen=True)
class Clustering:
    """Final centroids, and the vectors with their cluster (columns vec_id, x, cluster)."""

    centroids: list[list[int]]
    rows: DataFrame


def clustered(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM) -> Clustering:
    """Centroids after the given number of rounds; every vector belongs to the nearest of them."""
    spark = rows.sparkSession
    start = first_centroids(rows, k, seed)
    if not start:
        return Clustering([], rows.withColumn("cluster", F.lit(0)))
    folder = shared_folder(spark, "centroids")
    schema = _STATE.format(id=rows.schema["vec_id"].dataType.simpleString())
    now = np.array(start, dtype=np.int64).reshape(len(start), dim)
    sums = np.zeros((len(now), dim + 1), dtype=object)
    before, state = None, rows
    for done in range(rounds + 1):
        path = f"{folder}/round-{done}"
        state.mapInArrow(_round(Layout.of(now, before), before is None), schema).write.option("compression", "zstd").parquet(path)
        state = spark.read.schema(schema).parquet(path)
        if done:
            _remove(spark, f"{folder}/round-{done - 1}")
        if done < rounds:
            _moved(state, sums, dim)
            before, now = now, np.array([[int(s) // int(row[0]) for s in row[1:]] if row[0] else c.tolist()
                                         for row, c in zip(sums, now, strict=True)], dtype=np.int64).reshape(now.shape)
    return Clustering(now.tolist(), state.select("vec_id", "x", "cluster"))


def _in_long(value: Column) -> Column:
    return F.when(value <= F.lit((1 << 63) - 1), value).cast("long")


def assigned(found: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    spark, centroids = found.rows.sparkSession, np.array(found.centroids, dtype=np.int64)
    id_type = found.rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = squared(_matrix(batch.column("x")), centroids[batch.column("cluster").to_numpy()]) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array([str(min(int(v), _BEYOND)) for v in d], pa.string())],
                                             names=["vec_id", "cluster", "square"])

    rows = found.rows.mapInArrow(run, f"vec_id {id_type}, cluster int, square string").withColumn("square", F.col("square").cast("decimal(38,0)"))
    of_cluster = rows.groupBy("cluster").agg(F.sum("square").alias("own"))
    total = of_cluster.agg(F.sum("own").alias("all"))
    names = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids)],
        "cluster int, centroid_sha256 string")
    # one row for each centroid: the size of these sides is a parameter
    known = of_cluster.join(F.broadcast(names), "cluster").join(F.broadcast(total))
    return rows.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", _in_long(F.col("square")).alias("distance"), _in_long(F.col("own")).alias("cluster_inertia"),
        _in_long(F.col("all")).alias("inertia"), "centroid_sha256")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op13: one row for each vector of the right length."""
    return assigned(clustered(whole(table(spark, folder, "embeddings"))))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """Plain rounds over all centroids: every vector against each of them."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c : CAST(floor(1024 * CAST(c AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda c : c IS NULL OR NOT isfinite(c))) = 0),
w AS MATERIALIZED (SELECT r, generate_subscripts(x, 1) AS i, unnest(x) AS c FROM v),
s AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS cluster, x FROM v
      QUALIFY cluster < {k}),
c0 AS MATERIALIZED (SELECT cluster, x FROM s)"""]
    for t in range(rounds + 1):
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT r, cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p : (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM v, c{t} AS c) GROUP BY r)""")
        if t < rounds:
            steps.append(f"""
m{t} AS (SELECT cluster, i, sum(c) AS s, count(*) AS n FROM a{t} JOIN w USING (r) GROUP BY cluster, i),
c{t + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(f.x, c.x) AS x FROM c{t} AS c LEFT JOIN (
    SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM m{t} GROUP BY cluster) AS f USING (cluster))""")
    last = f"a{rounds}"
    return "WITH" + ",".join(steps) + f"""
SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN {last} AS a USING (r) JOIN c{rounds} AS c ON c.cluster = a.cluster"""


SQL = _sql()

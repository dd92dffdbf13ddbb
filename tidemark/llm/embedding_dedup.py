"""Embedding near-dedup by collision counting over one-dimensional projections.

Vectors of one label are scaled to unit length and projected on `PROJECTIONS` random directions. Two vectors collide
in a projection when the second lies in the window centred on the first. A pair within the cosine threshold is at
most sqrt(2 - 2 * threshold) apart, so the number of its collisions is at least binomial; the count that a pair needs
to be verified is the largest that still finds `RECALL` of the pairs at the threshold itself (closer ones more often).
Pairs that pass are verified by cosine in double precision.

The first projections sort the vectors of a label into cells; cells with many vectors are split by hash, and only
pairs of parts whose cells lie within the window of `REACH` are compared, each pair of parts in a task of bounded
size. A task returns, for each vector, its number of links, and the links that connect something new: never all pairs.
Equal vectors of a label are one vector with a count.

Defined cases: a null label, a null vector, a vector with a null or non-finite component, and a zero vector are linked
with nothing; vectors of different lengths are not compared; a null vec_id takes part but is never the smallest; repeated
rows are separate vectors that link; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, components, split_join, table, written

THRESHOLD = 0.93
PROJECTIONS = 32
#: Half-width of a query's window, in distances of a pair at the threshold; and of the sorted cells that are compared.
WINDOW = 1.5
REACH = 4.5
RECALL = 0.999
#: Vectors in one part of a cell.
PART = 1024
SEED = 20240229


def needed_collisions(m: int, window: float, recall: float) -> int:
    """Largest count that a pair at the threshold distance reaches with the given probability."""
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for count in range(m + 1):
        tail += math.comb(m, count) * p**count * (1 - p) ** (m - count)
        if 1 - tail < recall:
            return count
    return m


def directions(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, m))


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, v): vectors in double precision that can link."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select("vec_id", "label", v.alias("v")).where("label is not null and v is not null").where(fine)


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(width: float):
    """Adds unit vector and cell of the first projection to distinct vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.select(["node", "label", "rows"]).to_pandas()
            vectors = [np.asarray(x) for x in batch.column("v").to_numpy(zero_copy_only=False)]
            frame["dim"] = [len(x) for x in vectors]
            frame["unit"], frame["cell"] = None, 0
            for dim, some in frame.groupby("dim"):
                unit = _unit(np.concatenate([vectors[i] for i in some.index]), dim)
                frame.loc[some.index, "unit"] = pd.Series([u.tobytes() for u in unit], index=some.index)
                frame.loc[some.index, "cell"] = np.floor(unit @ directions(dim)[:, 0] / width).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(frame[c].tolist(), t) for c, t in (("node", pa.int64()), ("label", pa.string()), ("rows", pa.int64()),
                                                             ("dim", pa.int32()), ("unit", pa.binary()), ("cell", pa.int64()))],
                names=["node", "label", "rows", "dim", "unit", "cell"])
    return run


def collisions(x: np.ndarray, y: np.ndarray, half: float) -> np.ndarray:
    """counts[i, j]: projections in which y[j] lies in the window centred on x[i]; every projection of y is sorted once."""
    counts = np.zeros((len(x), len(y)), dtype=np.uint8)
    for a, b in zip(x.T, y.T, strict=True):
        order = np.argsort(b)
        low = np.searchsorted(b[order], a - half, side="left")
        high = np.searchsorted(b[order], a + half, side="right")
        rank = np.empty(len(b), dtype=np.int64)
        rank[order] = np.arange(len(b))
        counts += (rank[None, :] >= low[:, None]) & (rank[None, :] < high[:, None])
    return counts


def compare(x: np.ndarray, y: np.ndarray, threshold: float, need: int, half: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with enough collisions and cosine at least threshold."""
    proj = directions(x.shape[1])
    i, j = np.nonzero(collisions(x @ proj, y @ proj, half) >= need)
    good = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return i[good], j[good]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    parent = list(range(n))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            yield a, b


def _pair_links(threshold: float, need: int, half: float):
    def links(got: list[tuple]) -> tuple[list[int], list[int | None], list[int]]:
        sides = [[g for g in got if g[0] == s] for s in (0, 1)]
        dim = len(got[0][3]) // 8
        unit = [np.frombuffer(b"".join(g[3] for g in s), dtype=np.float64).reshape(-1, dim) if s else None for s in sides]
        same = not sides[1]
        i, j = compare(unit[0], unit[0] if same else unit[1], threshold, need, half)
        if same:
            i, j = i[i < j], j[i < j]
        left, right = sides[0], sides[0] if same else sides[1]
        shift = 0 if same else len(left)
        rows = np.array([g[2] for g in left] + ([] if same else [g[2] for g in right]))
        n_links = np.zeros(len(rows), dtype=np.int64)
        np.add.at(n_links, i, rows[j + shift])
        np.add.at(n_links, j + shift, rows[i])
        node = [g[1] for g in left] + ([] if same else [g[1] for g in right])
        edges = list(_forest(i, j + shift, len(rows)))
        some = np.flatnonzero(n_links).tolist()
        return ([node[a] for a in some] + [node[a] for a, _ in edges], [None] * len(some) + [node[b] for _, b in edges],
                [int(n_links[a]) for a in some] + [0] * len(edges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(got: list[tuple]) -> pa.RecordBatch:
            a, b, n = links(got)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        now, held = None, []
        for batch in batches:
            pair = batch.column("pair").to_pylist()
            for p, row in zip(pair, zip(*(batch.column(c).to_pylist() for c in ("side", "node", "rows", "unit")), strict=True), strict=True):
                if p != now:
                    if held:
                        yield out(held)
                    now, held = p, []
                held.append(row)
        if held:
            yield out(held)
    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    distance = math.sqrt(2 - 2 * threshold)
    need = needed_collisions(PROJECTIONS, WINDOW, RECALL)
    width = distance * REACH
    keyed = usable(vectors).withColumn("node", F.xxhash64(F.col("label").cast("string"), "v"))
    distinct = keyed.groupBy("node").agg(
        F.min(F.col("label").cast("string")).alias("label"), F.first("v").alias("v"), F.count("*").alias("rows"), F.min("vec_id").alias("least"))
    nodes = written(distinct.select("node", "label", "rows", "v").mapInArrow(
        _cells(width), "node long, label string, rows long, dim int, unit binary, cell long"), "vector-cells")
    cells = nodes.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    cells = written(cells, "vector-parts")
    n_cells = cells.count()
    part = cells.select("label", "dim", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # a part meets the parts of its own cell and of the next cell; farther cells lie beyond the reach
    near = part.select("label", "dim", F.struct("cell", "part").alias("x"), F.explode(F.array("cell", F.col("cell") + 1)).alias("other"))
    pairs = near.join(part.select("label", "dim", F.col("cell").alias("other"), F.struct("cell", "part").alias("y")), ["label", "dim", "other"]).where("x <= y")
    pairs = pairs.select("label", "dim", F.xxhash64("label", "dim", "x", "y").alias("pair"), F.explode(
        F.when(F.expr("x = y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at"))))
        .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("at")), F.struct(F.lit(1).alias("side"), F.col("y").alias("at"))))).alias("s"))
    pairs = pairs.select("label", "dim", "pair", "s.side", "s.at.cell", "s.at.part")
    placed = nodes.join(bounded(cells, n_cells), ["label", "dim", "cell"]).withColumn("part", F.pmod("node", F.col("parts")))
    dealt = placed.join(pairs, ["label", "dim", "cell", "part"]).select("pair", "side", "node", "rows", "unit")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = written(dealt.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(
        _pair_links(threshold, need, distance * WINDOW), "a long, b long, n long"), "vector-links")
    joined = components(links.where("b is not null").select("a", "b"), "vector-components")
    counted = links.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    known = distinct.select("node", "rows", "least").join(joined, "node", "left").join(
        counted.withColumnRenamed("a", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    named = known.join(ids, "component").select("node", "component_id", (F.coalesce("others", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull(),
                                           F.xxhash64(F.col("label").cast("string"), v)).alias("node"))
    return split_join(rows, named, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op6: one row for each vector."""
    return near_duplicates(table(spark, folder, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x : CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x : x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a AS vec_id, b AS root FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.root),
c AS (SELECT vec_id, min(root) AS root FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT x.vec_id, coalesce(n_links, 0) AS n_links, coalesce(least(x.vec_id, root), x.vec_id) AS component_id,
       x.vec_id = coalesce(least(x.vec_id, root), x.vec_id) AS kept
FROM embeddings AS x LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

"""Spark helpers shared by the corpus operators: keys, scratch tables, size-checked broadcasts, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: Rows and bytes of an Arrow batch that operators exchange with Python.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: A side of a join is broadcast only when its counted rows are at most this many; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts differ in size a thousandfold: batches between Spark and Python are bounded by rows and by bytes."""
    for setting, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(setting, None)
        if now is None or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(setting, str(most))


Batches = Iterator[pa.RecordBatch]


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after which the memory of its task goes back to the system: Spark keeps Python workers for later stages."""
    def whole(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return whole


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def content_key() -> Column:
    """Identity of a document row: its id and whole text. Repeated rows share a key and get equal results."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of df as a table in the folder that all executors share; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows allow it; otherwise unchanged, so that the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join whose large partitions may be split.

    An aggregate by the key is partitioned by it already, and a join on top of it would keep a hot key of the other
    side in one task. With the key's hash as second join column both sides get exchanges of their own, which adaptive
    execution can split.
    """
    check = "__hash_of_key"
    return left.withColumn(check, F.xxhash64(key)).join(right.withColumn(check, F.xxhash64(key)), [key, check], how).drop(check)


def components(edges: DataFrame, purpose: str) -> DataFrame:
    """(node, component) of every node with an edge to another node; component is the smallest node reachable.

    Alternating large-star and small-star steps over edge tables in the shared folder; the number of steps grows
    with the logarithm of the longest chain. Only the count of changed edges reaches the driver.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), purpose
    )
    before = None
    while True:
        # large star: every neighbour above u is attached to the least node around u
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its neighbours below are attached to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            split_join(large, low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                      F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        now = written(small, purpose)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )

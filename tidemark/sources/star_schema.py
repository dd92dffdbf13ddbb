"""Ad facts derived from a star schema (line items and parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def ad_facts(spark: SparkSession, folder: str, start: str | None = None,
             end: str | None = None) -> DataFrame:
    """(channel, campaign_type, campaign_name, ds, revenue, spend) from lineitem and part.

    Only the needed columns are read, and the optional date range is a predicate
    on the stored column, so it reaches the scan. The join carries no hint: a
    small part table is broadcast by its size, a large one is shuffled and a hot
    key is split by the adaptive skew join.
    """
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    if start is not None:
        lines = lines.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        after = F.date_add(F.lit(end).cast("date"), 1)
        lines = lines.where(F.col("l_shipdate") < after.cast("timestamp_ntz"))
    parts = spark.read.parquet(f"{folder}/part.parquet")
    price = F.col("l_extendedprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_returnflag").alias("channel"),
        F.col("p_type").alias("campaign_type"),
        F.col("p_brand").alias("campaign_name"),
        F.col("l_shipdate").cast("date").alias("ds"),
        (price * (1 - F.col("l_discount"))).cast(MONEY).alias("revenue"),
        (price * F.col("l_tax")).cast(MONEY).alias("spend"),
    )

"""Ordered lookups along a key's time line without one task per key.

A window over a busy key would sort all its rows in one task. Here the time
line is cut into chunks of fixed length: a small table with one row per (key,
chunk) is scanned in order, and its result is joined back to the rows, whose
own windows then span a single chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "hour"


def with_last(
    df: DataFrame, key: str, ts: str, order: Sequence[str], value: Column, name: str, chunk: str = CHUNK
) -> DataFrame:
    """Adds the latest non-NULL `value` of the key at or before each row."""
    at = F.struct(*order)
    rows = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts))).withColumn("_value", value)
    # a chunk without a value gives NULL and passes the carry on
    latest = F.max_by("_value", F.when(F.col("_value").isNotNull(), at))
    chunks = rows.groupBy(key, "_chunk").agg(latest.alias("_v"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(key, "_chunk", F.last("_v", ignorenulls=True).over(before).alias("_carry"))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.last("_value", ignorenulls=True).over(inside)
    return (
        rows.join(carry, [key, "_chunk"])
        .withColumn(name, F.coalesce(here, F.col("_carry")))
        .drop("_chunk", "_value", "_carry")
    )


def with_running_count(
    df: DataFrame, key: str, ts: str, order: Sequence[str], flag: Column, name: str, chunk: str = CHUNK
) -> DataFrame:
    """Adds how many of the key's rows at or before each row have the flag."""
    rows = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts))).withColumn("_flag", flag)
    chunks = rows.groupBy(key, "_chunk").agg(F.count_if("_flag").alias("_n"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.join(carry, [key, "_chunk"])
        .withColumn(name, F.count_if("_flag").over(inside) + F.col("_carry"))
        .drop("_chunk", "_flag", "_carry")
    )


def with_next(df: DataFrame, key: str, ts: str, order: Sequence[str], name: str, chunk: str = CHUNK) -> DataFrame:
    """Adds the time of the key's next row, NULL for the last one."""
    rows = df.withColumn("_chunk", F.date_trunc(chunk, F.col(ts)))
    firsts = rows.groupBy(key, "_chunk").agg(F.min(ts).alias("_first"))
    ahead = firsts.select(
        key, "_chunk", F.lead("_first").over(Window.partitionBy(key).orderBy("_chunk")).alias("_ahead")
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    return (
        rows.join(ahead, [key, "_chunk"])
        .withColumn(name, F.coalesce(F.lead(ts).over(inside), F.col("_ahead")))
        .drop("_chunk", "_ahead")
    )

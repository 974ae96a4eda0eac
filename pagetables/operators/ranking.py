"""Caps, top-k and ordered distinct.

`row_number() <= k` is the shape that Spark cuts per map task before it
shuffles. Every cut is made in two steps, first over (group, salt), so the last
task of a hot group gets k rows of each salt, however many tasks there were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALTS = 64


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First k rows of every group in the given order; `rank` names a column for their place."""
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashable), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    df = salted.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= k).drop("_rn", "_salt")
    name = rank or "_rn"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Ordered distinct: the first row of every key."""
    return top_k(df, keys, order, 1)


def cap_per_site(df: DataFrame, limit: int, order: Sequence[Column], site: str = "site") -> DataFrame:
    return top_k(df, [site], order, limit)


def chunked_position(df: DataFrame, keys: Sequence[str], chunk: Column, order: Sequence[Column], name: str = "idx") -> DataFrame:
    """Dense position of every row in its group without one task per group.

    `chunk` must rise with `order`. Rows are numbered inside (group, chunk);
    the counts of the earlier chunks, a table with one row per chunk, are added.
    """
    keys = list(keys)
    df = df.withColumn("_chunk", chunk)
    counts = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        df.join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.row_number().over(inner) + F.col("_offset"))
        .drop("_chunk", "_offset")
    )


def cap_budget(
    df: DataFrame,
    store: str,
    category_order: str,
    order: Sequence[Column],
    per_category: int = 500,
    per_store: int = 5000,
) -> DataFrame:
    """Per category at most `per_category` rows and never more than what is left of the store budget.

    What a category may keep follows from the counts of the categories before
    it, so only one row per category goes through the running sum.
    """
    counts = category_allowance(
        df.groupBy(store, category_order).agg(F.count(F.lit(1)).alias("available")),
        store, category_order, per_category, per_store,
    ).select(store, category_order, "allowed")
    kept = top_k(df, [store, category_order], order, per_category, "idx")
    return kept.join(counts, [store, category_order]).filter(F.col("idx") <= F.col("allowed")).drop("allowed")


def category_allowance(
    counts: DataFrame, store: str, category_order: str, per_category: int, per_store: int
) -> DataFrame:
    """`allowed` rows per category from `available` rows; the budget is spent in category order."""
    want = F.least(F.col("available"), F.lit(per_category))
    before = Window.partitionBy(store).orderBy(category_order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(want).over(before), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(per_store) - spent)
    return counts.withColumn("spent_before", spent).withColumn("allowed", F.least(want, left))


def restore_order(df: DataFrame, *order: str) -> DataFrame:
    """Global order by the index columns (a range-partitioned sort)."""
    return df.orderBy(*order)


def union_tables(*tables: DataFrame) -> DataFrame:
    """Append tables with differing columns; what a table lacks is NULL."""
    result = tables[0]
    for table in tables[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


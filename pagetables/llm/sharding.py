"""Sharding by a minimax contiguous partition.

Equal texts form one atomic group; groups are put in order by the hash of their text. The smallest capacity for which a
greedy walk over the groups needs no more than the wanted shards is found by binary search, and the order is cut at
that capacity. A group above the mean size of a shard gets a shard of its own first, and the rest is partitioned over
the shards that are left, so one hot text does not loosen the capacity of the others.

The driver never sees all groups. It starts from the sizes of cells, equal ranges of hashes, and opens only the cells in
which a cut can fall: with cells of at most r bytes the best capacity over cells, U, is at most r above that over
groups, and the i-th cut of the walk over groups lies between those of the walks over cells at U - r and U + r. Cells
there are cut into finer ones until they hold one group each, so the capacity is that of single groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetables.llm.common import query, table, written

#: Cells to start with (a power of two, 2 or more) and cells that are opened at once, each into FANOUT cells: bounds of
#: what a round sends to the driver.
CELLS = 1 << 16
OPENED = 1 << 13
FANOUT = 1 << 5
OVERHEAD = 16
CHUNKS = 256


def _needed(sums: np.ndarray, capacity: int, most: int) -> list[int]:
    """Ends of the greedy parts at this capacity, stopping after `most` + 1 parts."""
    ends, at, total = [], 0, len(sums) - 1
    while at < total and len(ends) <= most:
        at = int(np.searchsorted(sums, sums[at] + capacity, side="right")) - 1
        ends.append(at)
    return ends


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """End position of each of `shards` contiguous parts whose largest sum is the smallest possible.

    Among the partitions that keep to this capacity, cuts lie as near to equal parts as they can. No sizes: all parts
    are empty.
    """
    sums = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype(np.int64)
    low, high = max([0, *sizes]), int(sums[-1])
    while low < high:
        middle = (low + high) // 2
        if len(_needed(sums, middle, shards)) <= shards:
            high = middle
        else:
            low = middle + 1
    first = [len(sizes)]  # the earliest start of the last part, of the one before it, ...
    for _ in range(shards):
        first.append(int(np.searchsorted(sums, sums[first[-1]] - low, side="left")))
    earliest = first[::-1]
    cuts, at = [], 0
    for i in range(1, shards + 1):
        latest = int(np.searchsorted(sums, sums[at] + low, side="right")) - 1
        ideal = int(sums[-1]) * i // shards
        near = int(np.searchsorted(sums, ideal, side="left"))
        if near > 0 and ideal - sums[near - 1] < sums[min(near, len(sums) - 1)] - ideal:
            near -= 1
        at = max(at, min(max(near, earliest[i]), latest))
        cuts.append(at)
    return cuts


def heavy_groups(rows: DataFrame, cells: dict[int, int], shift: int, shards: int) -> list[int]:
    """Keys of the groups that get a shard of their own: each is above the mean of what larger ones left.

    Such a group makes its cell as large, so only these cells, fewer than `shards` for each round, are looked into.
    """
    total, found = sum(cells.values()), {}
    while True:
        rest, left = total, shards
        alone = []
        for key, size in sorted(found.items(), key=lambda g: (-g[1], g[0])):
            if left <= 1 or size * left <= rest:
                break
            alone.append(key)
            rest, left = rest - size, left - 1
        large = [c for c, size in cells.items() if size * left > rest]
        sizes = rows.filter(F.shiftright("key", shift).isin(large)).groupBy("key").agg(F.sum("size").alias("size"))
        now = {r["key"]: r["size"] for r in sizes.filter(F.col("size") * left > rest).orderBy(F.desc("size"), "key").limit(shards).collect()}
        if left <= 1 or not large or set(now) <= set(found):
            return alone
        found.update(now)


def group_cuts(rows: DataFrame, shards: int, cells: int = CELLS, opened: int = OPENED) -> list[int | None]:
    """The last key of each of `shards` contiguous parts of the groups of `rows` (key, size): the best capacity there is.

    None stands for a part that starts with the first key and is empty.
    """
    shift = 64 - (cells.bit_length() - 1)
    known = _cells(rows, shift)
    while True:
        known.sort()
        sizes = np.asarray([c[2] for c in known], dtype=np.int64)
        mixed = np.asarray([c[0] != c[1] for c in known], dtype=bool)
        sums = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ends = minimax_cuts(sizes.tolist(), shards)
        best = int(np.diff(sums[[0, *ends]]).max())
        near, widest = mixed, None
        # only cells in which a cut can fall count for r, so r and the places of the cuts narrow each other
        while near.any() and widest != int(sizes[near].max()):
            widest = int(sizes[near].max())
            reach = np.zeros(len(known) + 1, dtype=np.int64)
            for first, last in zip(*(_walk(sums, capacity, shards) for capacity in (best - widest, best + widest))):
                reach[first] += 1
                reach[min(last + 1, len(known))] -= 1
            near = near & (np.cumsum(reach[:-1]) > 0)
        todo = sorted(np.flatnonzero(near).tolist(), key=lambda n: (-known[n][2], n))[:opened]
        if not todo:
            return [known[e - 1][1] if e else None for e in ends]
        by_shift: dict[int, list] = {}
        for n in todo:
            by_shift.setdefault(known[n][3], []).append(known[n])
        chosen_now = set(todo)
        known = [c for n, c in enumerate(known) if n not in chosen_now]
        for at, chosen in by_shift.items():
            inside = rows.sparkSession.createDataFrame([(c[0] >> at,) for c in chosen], "cell long")
            # at most `opened` cells
            known += _cells(rows.withColumn("cell", F.shiftright("key", at)).join(F.broadcast(inside), "cell"), max(0, at - FANOUT.bit_length() + 1))


def _cells(rows: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
    """(first key, last key, bytes, shift) of each cell that holds a group."""
    sums = rows.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.min("key").alias("a"), F.max("key").alias("b"), F.sum("size").alias("n"))
    return [(r["a"], r["b"], r["n"], shift) for r in sums.collect()]


def _walk(sums: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Ends of the greedy parts at this capacity; a size above it is a part that ends where it starts."""
    ends, at = [], 0
    for _ in range(shards):
        at = max(at, int(np.searchsorted(sums, sums[at] + max(0, capacity), side="right")) - 1)
        ends.append(at)
    return ends


def shard(docs: DataFrame, shards: int = 40, cells: int = CELLS, chunks: int = CHUNKS, opened: int = OPENED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of `docs` (doc_id, text).

    Size is the bytes of the text plus 16. Null and empty texts count as one group of no bytes. Rows that are equal
    stay apart, each with its own slot; null and repeated ids are kept; other columns are ignored; an empty table gives
    no rows. A group larger than the mean shard stays whole, alone in its shard. Different texts of the same 64-bit hash
    count as one group.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    ))
    shift = 64 - (cells.bit_length() - 1)
    sums = {r["cell"]: r["size"] for r in rows.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("size")).collect()}
    alone = heavy_groups(rows, sums, shift, shards)
    others = group_cuts(rows.filter(~F.col("key").isin(alone)), shards - len(alone), cells, opened)
    place = F.lit(None).cast("int")
    for number, end in reversed(list(enumerate(others, len(alone)))):
        if end is not None:
            place = F.when(F.col("key") <= end, F.lit(number)).otherwise(place)
    for number, key in reversed(list(enumerate(alone))):
        place = F.when(F.col("key") == key, F.lit(number)).otherwise(place)
    # a hot id, or none, is spread over the chunks by the hash of its text
    chunk = F.pmod(F.xxhash64("doc_id", "key"), F.lit(chunks)).cast("int")
    placed = rows.withColumn("shard", place).withColumn("chunk", chunk)
    # slots: numbered inside (shard, chunk), after the rows of the earlier chunks; at most shards x chunks counts
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "chunk").orderBy("doc_id", "key")
    numbered = placed.withColumn("place", F.row_number().over(inner) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

"""Benchmark decontamination by greedy string tiling.

Seeds are runs of MIN_MATCH words. The seeds of the test items are a table; the documents' seeds that may be among them
are another, and a join of the two gives the pairs of a document and an item that can reach the coverage. For each pair
running Karp-Rabin hashing finds the longest common runs whose words are all unmarked; they are marked, and shorter
ones are searched, down to MIN_MATCH words. The share of the item's words that are marked decides, so passages that
were cut up and put in another order count in full.

Tiles of L words hold L - MIN_MATCH + 1 seeds of the item, so a pair that reaches a coverage shares at least
coverage / MIN_MATCH seeds for each word of the item. It therefore shares one of the item's rarest seeds, all but that
many, and only these are joined; the common ones serve later, for the pairs that are known by then.

A table of FILTER_BITS bits, the only thing of the benchmark that the driver sees, keeps most other seeds of the
documents out of the join. With a larger benchmark it lets more of them pass and changes nothing else. Words and seeds
are compared by their 64-bit hashes.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetables.llm.common import forget, map_batches, merged, query, table, written
from pagetables.llm.vectors import run_hashes, word_hashes

MIN_MATCH = 5
#: An item counts as leaked into a document from this share of its words on.
COVERAGE = 0.5
#: Bits of the table of item seeds, a power of two; the driver gets at most a 64th as many numbers.
FILTER_BITS = 1 << 24
#: A seed is dealt over SALTS parts when it has more than one in HOT_SHARE of the rows to be joined, so fewer are than that.
HOT_SHARE = 4096
SALTS = 64
WORDS = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def tiles(item: np.ndarray, doc: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in doc, words), no word of either in two tiles; numbers stand for words."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(doc)))
    while size >= least:
        found: list[tuple[int, int, int]] = []
        longest = 0
        rows, places = _open_runs(item, free_item, size), _open_runs(doc, free_doc, size)
        if len(rows[0]) and len(places[0]):
            by_hash = defaultdict(list)
            for h, i in zip(rows[1].tolist(), rows[0].tolist()):
                by_hash[h].append(i)
            common = np.isin(places[1], rows[1])
            for h, j in zip(places[1][common].tolist(), places[0][common].tolist()):
                for i in by_hash[h]:
                    if i and j and item[i - 1] == doc[j - 1] and free_item[i - 1] and free_doc[j - 1]:
                        continue  # the run that starts one word earlier holds this one
                    n = _length(item, doc, free_item, free_doc, i, j)
                    if n >= size:
                        found.append((n, i, j))
                        longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_item[i:i + n].all() and free_doc[j:j + n].all():
                free_item[i:i + n] = free_doc[j:j + n] = False
                out.append((i, j, n))
        # a run that overlapped a marked one may go on with what is left of it, so a size is done when it finds nothing
        if not found:
            size = least if least < size < 2 * least else size // 2 if size > least else 0
    return out


def _open_runs(values: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of `size` words that are all unmarked and known."""
    sums = np.concatenate([[0], np.cumsum(free & (values > 0))])
    if len(values) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(sums[size:] - sums[:-size] == size)
    return at, run_hashes(values.astype(np.uint64), size)[at]


def _length(item, doc, free_item, free_doc, i: int, j: int) -> int:
    n = min(len(item) - i, len(doc) - j)
    same = (item[i:i + n] == doc[j:j + n]) & free_item[i:i + n] & free_doc[j:j + n]
    ends = np.flatnonzero(~same)
    return int(ends[0]) if len(ends) else n


def _text_key() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))


def item_words(benchmark: DataFrame, least: int = MIN_MATCH) -> DataFrame:
    """item (key of the text) and the hashes of its words, one row for each different text of `least` words or more."""

    def fn(columns):
        hashes, starts = word_hashes([t or "" for t in columns["text"]])
        out = {"item": [], "words": []}
        for item, first, end in zip(columns["item"], starts[:-1], starts[1:]):
            if end - first >= least:
                out["item"].append(item)
                out["words"].append(hashes[first:end].view(np.int64))
        yield out

    rows = benchmark.select(_text_key().alias("item"), "text").dropDuplicates(["item"])
    return map_batches(rows, fn, "item binary, words array<bigint>")


def item_seeds(items: DataFrame, least: int = MIN_MATCH) -> DataFrame:
    """item, its number of words, and the seed at each of its places."""

    def fn(columns):
        out = {"item": [], "n_words": [], "place": [], "seed": []}
        for item, values in zip(columns["item"], columns["words"]):
            seeds = run_hashes(np.array(values, np.int64).view(np.uint64), least).view(np.int64)
            out["item"] += [item] * len(seeds)
            out["n_words"] += [len(values)] * len(seeds)
            out["place"] += range(len(seeds))
            out["seed"] += seeds.tolist()
        yield out

    return map_batches(items, fn, "item binary, n_words bigint, place bigint, seed bigint")


def seed_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """A table of `bits` bits in which the seeds are set; made by the tasks, at most bits / 64 numbers come here."""
    slot = F.col("seed").bitwiseAND(F.lit(bits - 1))
    marked = seeds.select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    rows = marked.groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("set")).toArrow()
    out = np.zeros(max(1, bits // 64), np.int64)
    out[rows.column("at").to_numpy()] = rows.column("set").to_numpy()
    return out.view(np.uint64)


def document_seeds(docs: DataFrame, known: np.ndarray, least: int = MIN_MATCH) -> DataFrame:
    """doc (key of the text), seed and its first word, for the seeds of whole texts that the table `known` lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    mask = np.uint64(len(known) * 64 - 1)

    def fn(columns):
        hashes, starts = word_hashes([t or "" for t in columns["text"]])
        runs = run_hashes(hashes, least)
        slot = runs & mask
        at = np.flatnonzero((shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
        row = np.searchsorted(starts, at, side="right") - 1
        inside = at + least <= starts[row + 1]
        at, row = at[inside], row[inside]
        yield {"doc": [columns["doc"][r] for r in row], "seed": runs[at].view(np.int64), "at": at - starts[row]}

    return map_batches(docs.select(_text_key().alias("doc"), "text"), fn, "doc binary, seed bigint, at bigint")


def candidates(spots: DataFrame, seeds: DataFrame, coverage: float, least: int, hot_share: int = HOT_SHARE) -> DataFrame:
    """Pairs (doc, item) that share one of the item's rarest seeds: all pairs that can reach the coverage."""
    counts = spots.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    total = spots.count()
    hot = counts.filter(F.col("n") > total / hot_share).select("seed", F.lit(True).alias("hot"))  # fewer than hot_share rows
    needed = F.greatest(F.lit(1), F.ceil(F.lit(coverage) * F.col("n_words") / least))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("n", F.lit(0)), "seed", "place"))
    rare = seeds.join(counts, "seed", "left").withColumn("rank", rank)
    rare = rare.filter((F.col("rank") <= F.col("n_words") - least + 2 - needed) & F.col("n").isNotNull())
    keys = rare.select("item", "seed").distinct().join(F.broadcast(hot), "seed", "left")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = spots.select("doc", "seed").join(F.broadcast(hot), "seed", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).otherwise(0)
    return (
        dealt.withColumn("salt", salt).drop("hot")
        .join(keys.withColumn("salt", F.explode(salts)).drop("hot"), ["seed", "salt"])
        .select("doc", "item").distinct()
    )


def _near(numbers: np.ndarray, places: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The document's words that lie in seeds of the item, as the item's numbers, and one zero for each gap.

    `at` are the seeds' places in the document and `places` those in the item.
    """
    run = np.arange(least)
    word, first = np.unique((at[:, None] + run).ravel(), return_index=True)
    values = numbers[(places[:, None] + run).ravel()[first]]
    return np.insert(values, np.flatnonzero(np.diff(word) > 1) + 1, 0)


def tiled(values: np.ndarray, seeds: np.ndarray, at: np.ndarray, coverage: float, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of an item (hashes of its words) with a document of which the common seeds are known, by place."""
    # words of the document in seeds of this item bound what tiles can cover
    if least + int(np.minimum(np.diff(at), least).sum()) < coverage * len(values):
        return []
    numbers = np.unique(values, return_inverse=True)[1] + 1
    own = run_hashes(values.view(np.uint64), least).view(np.int64)
    order = np.argsort(own, kind="stable")
    return tiles(numbers, _near(numbers, order[np.searchsorted(own[order], seeds)], at, least), least)


def leaked_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float, least: int, bits: int, hot_share: int) -> DataFrame:
    """doc, item (keys of texts), item_words, covered_words, n_tiles, longest_tile of the pairs with the coverage."""
    items = written(item_words(benchmark, least))
    seeds = written(item_seeds(items, least))
    spots = written(document_seeds(docs, seed_filter(seeds, bits), least).distinct())
    pairs = written(candidates(spots, seeds, coverage, least, hot_share))
    shared = pairs.join(seeds.select("item", "seed").distinct(), "item").join(merged(spots), ["doc", "seed"])
    matched = shared.groupBy("doc", "item").agg(F.array_sort(F.collect_list(F.struct("at", "seed"))).alias("spots"))

    def fn(columns):
        out = {c: [] for c in ("doc", "item", "item_words", "covered_words", "n_tiles", "longest_tile")}
        for doc, item, values, spots in zip(*(columns[c] for c in ("doc", "item", "words", "spots"))):
            at, own = (np.array([s[c] for s in spots], np.int64) for c in ("at", "seed"))
            found = tiled(np.array(values, np.int64), own, at, coverage, least)
            covered = sum(n for _, _, n in found)
            if found and covered >= coverage * len(values):
                for c, v in zip(out, (doc, item, len(values), covered, len(found), max(n for _, _, n in found))):
                    out[c].append(v)
        yield out

    schema = "doc binary, item binary, item_words long, covered_words long, n_tiles long, longest_tile long"
    result = written(map_batches(matched.join(items, "item"), fn, schema))
    for done in (items, seeds, spots, pairs):
        forget(done)
    return result


def leaks(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH, bits: int = FILTER_BITS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """One row for each document (doc_id, text) and item (item_id, text) with at least this coverage.

    Returns doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile. Words are runs of letters,
    digits and underscores in lower case. Null texts have no words; items under `least` words never match; null ids
    are kept; repeated rows give repeated results, other columns are ignored, empty tables give no rows. Texts of any
    length are judged whole. Equal texts are judged once.
    """
    pairs = leaked_pairs(docs, benchmark, coverage, least, bits, hot_share)
    named = pairs.join(benchmark.select("item_id", _text_key().alias("item")), "item")
    return docs.select("doc_id", _text_key().alias("doc")).join(named, "doc").select(
        "doc_id", "item_id", "item_words", "covered_words", (F.col("covered_words") / F.col("item_words")).alias("coverage"),
        "n_tiles", "longest_tile",
    )


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_MATCH, bits: int = FILTER_BITS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """The rows of `docs`, all columns, into which no item of `benchmark` leaked.

    Null and empty texts hold nothing and stay, as do all rows when the benchmark is empty; rows with equal texts go or
    stay together, whatever their ids; other columns pass as they are, whatever their names.
    """
    leaked = written(leaked_pairs(docs, benchmark, coverage, least, bits, hot_share).select("doc").distinct())
    # a small table of leaked texts is sent to the tasks, a large one is joined: Spark decides by the size of its files
    return docs.join(leaked, _text_key() == leaked["doc"], "left_anti")


@query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Language by bit-sliced Bloom filters over character n-grams.

One array of language masks serves all languages: bit l of a slot belongs to the Bloom filter of language l, so one
look-up returns all languages that contain an n-gram. A text's hits per language, less the false positives that the
filter's fill predicts, decide.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetables.llm.common import judged, map_batches, query, table
from pagetables.llm.vectors import GOLDEN, SPACE, code_points, is_kind, mixed

SIZES = (3, 4)
SLOTS = 1 << 18
PROBES = 2
#: The model is fitted on at most this many labelled rows of each language, the first by the hash of their id.
SAMPLE = 1000
SALTS = 64
#: An n-gram belongs to a language if this share of its texts has it, and no less than NEAR times the largest share.
LEAST, NEAR = 0.02, 0.3
UNKNOWN = "und"
#: A known language needs this part of the evidence (corrected hits over n-grams) that all but LOWEST of its labelled
#: rows reach; less where a language has few of them (FEW halves it), as they teach few n-grams. Short texts may miss
#: it by DEVIATIONS standard deviations.
PART, LOWEST, FEW, DEVIATIONS = 0.5, 0.01, 20, 1


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of letters and word ends, the text of each, and whether each text has a letter."""
    points, starts = code_points(texts, 1, max(SIZES) - 1)
    letters = is_kind(points, str.isalpha)
    points = np.where(letters, points, np.uint32(SPACE)).astype(np.uint64)
    hashes, owners = [], []
    for n in SIZES:
        count = len(points) - n + 1
        if count <= 0:
            continue
        inner = np.ones(count, dtype=bool)
        for i in range(1, n - 1):
            inner &= letters[i:i + count]
        at = np.flatnonzero(inner)
        total = np.full(len(at), n, dtype=np.uint64)
        for i in range(n):
            total = total * np.uint64(0x110001) + points[at + i]
        hashes.append(mixed(total * GOLDEN))
        owners.append(np.searchsorted(starts, at, side="right") - 1)
    seen = np.add.reduceat(letters.astype(np.int64), starts[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), seen
    return np.concatenate(hashes), np.concatenate(owners), seen


def probes(hashes: np.ndarray, slots: int = SLOTS) -> list[np.ndarray]:
    return [((hashes >> np.uint64(22 * i)) % np.uint64(slots)).astype(np.int64) for i in range(PROBES)]


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows (doc_id, text, lang) that teach: at most about `sample` of each language."""
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    chosen = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("place")).withColumn("salt", F.pmod("place", F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):  # the last task of a language gets `sample` rows of each salt
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("place", "doc_id"))
        chosen = chosen.withColumn("rn", rank).filter(F.col("rn") <= sample).drop("rn")
    chosen = chosen.select("doc_id").distinct()  # at most `sample` ids of each language
    return usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")


def learn(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages in order and the masks, one row per slot and one word for each 63 languages.

    `docs` (doc_id, text, lang); rows without text or language teach nothing. What comes to the driver are at most
    SLOTS masks and the counts per language.
    """
    texts = labelled(docs, sample)
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((SLOTS, 1), dtype=np.uint64)

    def seen(columns):
        hashes, owners, _ = grams(columns["text"])
        pairs = np.unique(np.stack([owners, hashes.view(np.int64)]), axis=1) if len(hashes) else np.zeros((2, 0), np.int64)
        langs = columns["lang"]
        yield {"lang": [langs[i] for i in pairs[0].tolist()], "gram": pairs[1].tolist()}

    rows = map_batches(texts.select("text", "lang"), seen, "lang string, gram long")
    counts = rows.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    total = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(float(sizes[name])))])
    index = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(name), F.lit(i))])
    shares = counts.select("gram", index[F.col("lang")].alias("l"), (F.col("n") / total[F.col("lang")]).alias("share"))
    top = F.max("share").over(Window.partitionBy("gram"))
    kept = shares.withColumn("top", top).filter((F.col("share") >= LEAST) & (F.col("share") >= NEAR * F.col("top")))
    words = (len(names) + 62) // 63
    kept = kept.select("gram", (F.col("l") / 63).cast("int").alias("word"), F.expr("shiftleft(1L, cast(l % 63 as int))").alias("bit"))

    def placed(columns):
        hashes = np.array(columns["gram"], dtype=np.int64).view(np.uint64)
        for slot in probes(hashes):
            yield {"word": columns["word"], "slot": slot.tolist(), "bit": columns["bit"]}

    filled = map_batches(kept, placed, "word int, slot long, bit long").groupBy("word", "slot").agg(F.bit_or("bit").alias("mask"))
    masks = np.zeros((SLOTS, words), dtype=np.uint64)
    for row in filled.collect():
        masks[row["slot"], row["word"]] = row["mask"]
    return names, masks


def false_positives(names: list[str], masks: np.ndarray) -> np.ndarray:
    fill = np.array([((masks[:, i // 63] >> np.uint64(i % 63)) & np.uint64(1)).mean() for i in range(len(names))]) if names else np.zeros(0)
    return fill ** PROBES


def corrected(texts: list[str], masks: np.ndarray, false: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits of each text per language less the expected false ones, its number of n-grams, and whether it has a letter."""
    hashes, owners, seen = grams(texts)
    slots = probes(hashes)
    total = np.bincount(owners, minlength=len(texts))
    hits = np.zeros((len(texts), len(false)))
    for word in range(masks.shape[1]):
        found = masks[slots[0], word]
        for slot in slots[1:]:
            found &= masks[slot, word]
        some = np.flatnonzero(found)
        found, by = found[some], owners[some]
        for i in range(word * 63, min(len(false), word * 63 + 63)):
            hits[:, i] = np.bincount(by, weights=((found >> np.uint64(i % 63)) & np.uint64(1)).astype(np.float64), minlength=len(texts))
    return np.maximum(0, (hits - total[:, None] * false) / np.maximum(1e-9, 1 - false)), total, seen


def calibrate(docs: DataFrame, names: list[str], masks: np.ndarray, sample: int = SAMPLE) -> np.ndarray:
    """The evidence that each language needs, from the rows that taught it."""
    false = false_positives(names, masks)
    shared = docs.sparkSession.sparkContext.broadcast(masks)

    def fn(columns):
        net, total, _ = corrected(columns["text"], shared.value, false)
        own = [names.index(x) for x in columns["lang"]]
        share = net[np.arange(len(own)), own] / np.maximum(1, total)
        yield {"lang": columns["lang"], "share": [x if n else None for x, n in zip(share.tolist(), total.tolist())]}

    shares = map_batches(labelled(docs, sample).select("text", "lang"), fn, "lang string, share double")
    low = shares.groupBy("lang").agg(F.count("share").alias("n"), F.expr(f"percentile_approx(share, {LOWEST})").alias("low"))
    needs = {r["lang"]: PART * r["low"] * r["n"] / (r["n"] + FEW) for r in low.filter("n > 0").collect()}
    return np.array([needs.get(name, 0.0) for name in names])


def enough(net: np.ndarray, total: np.ndarray, needs: np.ndarray) -> np.ndarray:
    """Whether the hits speak for the best language of each text: some hits, not the same for all, and as many as it needs."""
    best = net.argmax(axis=1)
    top, need = net.max(axis=1), needs[best]
    slack = DEVIATIONS * np.sqrt(total * need * (1 - need))
    return (top > 0) & (top >= total * need - slack) & ((net.shape[1] == 1) | (net.min(axis=1) < top))


def predict(docs: DataFrame, names: list[str], masks: np.ndarray, needs: np.ndarray | None = None) -> DataFrame:
    """`docs` without its text and with lang_pred, score for every row; only the text is looked at.

    A text that is null or has no letter, and any text when no language was learned, is `und` with score 0; with
    `needs`, so is a text without enough evidence. Ties go to the first language by name.
    """
    false = false_positives(names, masks)
    shared = docs.sparkSession.sparkContext.broadcast(masks)  # SLOTS words for each 63 languages: 2 MB

    def fn(texts):
        net, total, seen = corrected(texts, shared.value, false)
        best = net.argmax(axis=1) if names else np.zeros(len(texts), int)
        sums = net.sum(axis=1)
        known = seen & bool(names)
        if names and needs is not None:
            known &= enough(net, total, needs)
        return {
            "lang_pred": [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())],
            "score": [float(net[i, best[i]] / sums[i]) if known[i] and sums[i] > 0 else 0.0 for i in range(len(texts))],
        }

    return judged(docs, fn, "lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `docs` (doc_id, text, lang), learned from rows not held out.

    Repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    names, masks = learn(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), names, masks)


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text shows enough evidence for a language that could be learned."""
    known = docs.filter(~held_out())
    names, masks = learn(known)
    rows = predict(docs.select(F.struct(*docs.columns).alias("row"), "text"), names, masks, calibrate(known, names, masks))
    return rows.filter(F.col("lang_pred") != UNKNOWN).select("row.*")


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))

"""Collocations by dynamic itemset counting.

The texts are encoded once and dealt to SHARDS shards, which are scanned in a cycle. Counting of single words starts with
the first scan. A longer phrase starts once both phrases that it has with one word less, at its front and at its back,
have been counted LEAST times, and ends after one full cycle; so lengths are counted side by side. Which phrases have
come so far is known by an activation table of a fixed number of slots: a slot holds the steps at which the first and
the last of its phrases reached the threshold, and a phrase starts one step after the later of the first
steps of its two slots. Two phrases in a slot
can only start a longer phrase early. Every phrase is counted in each shard once, whatever its slots hold, so the
counts are exact; and a phrase that comes LEAST times has parts that do, so it is always started.

Inside a block of texts phrases are compared word by word; between blocks they are known by 64-bit hashes of their
words, single words by themselves.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetables.llm.common import forget, in_blocks, out_schema, query, table, written
from pagetables.llm.vectors import GOLDEN, byte_hashes, byte_set, from_planes, mixed, planes, split_words

LONGEST, LEAST, TOP = 5, 100, 2000
SHARDS = 3
#: Slots of the activation table: two bytes each in every task. More phrases than slots make needless counters only.
SLOTS = 1 << 22
BLOCK_BYTES = 12 << 20
SALTS = 64
UNKNOWN = "und"
#: Fixed values of the contract: bytes that end a piece, and those that end a word.
BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
NEVER = 255


def blocks(docs: DataFrame, shards: int, size: int = BLOCK_BYTES) -> DataFrame:
    """(lang, words, ends, codes, shard): texts of one language as distinct words and codes, -1 between pieces."""
    schema = "lang string, words binary, ends binary, codes binary"
    out = out_schema(docs.sparkSession, schema)
    gap, cut = byte_set(BREAKS + BLANKS), byte_set(BREAKS)

    def fn(rows: pa.RecordBatch):
        langs = rows.column("lang").dictionary_encode()
        which = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            codes, words, owner, starts, data = split_words(rows.column("text").filter(pa.array(which == i)), gap)
            if not len(codes):
                continue
            piece = np.cumsum(cut[data], dtype=np.int64)[starts] + owner
            new = np.flatnonzero(np.diff(piece)) + 1
            with_gaps = np.insert(codes, new, -1).astype(np.int32)
            ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang]), pa.array([b"".join(words.to_pylist())]),
                pa.array([(ends - ends[0]).astype(np.int32).tobytes()]), pa.array([planes(with_gaps)]),
            ], schema=out)

    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").filter(F.col("text").isNotNull())
    return in_blocks(texts, fn, schema, size).withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int"))


def _words(row: dict) -> pa.Array:
    ends = np.frombuffer(row["ends"], np.int32).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(row["words"])])


def seed(lang: str) -> np.uint64:
    return byte_hashes(pa.array([b"\x00" + lang.encode()], pa.large_binary()))[0]


def chained(front: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The hash of a phrase from those of its parts without the last and without the first word."""
    return mixed(front * GOLDEN + mixed(back + GOLDEN))


def slots_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def counted_words(shard: DataFrame) -> DataFrame:
    schema = "lang string, word binary, n long"
    out = out_schema(shard.sparkSession, schema)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, codes = _words(row), from_planes(row["codes"])
                n = np.bincount(codes[codes >= 0], minlength=len(words))
                for at in range(0, len(words), 1 << 16):
                    part = words.slice(at, 1 << 16)
                    langs = pa.array([row["lang"]] * len(part))
                    yield pa.RecordBatch.from_arrays([langs, part.cast(pa.binary()), pa.array(n[at:at + len(part)])], schema=out)

    return shard.select("lang", "words", "ends", "codes").mapInArrow(run, schema)


def counted_phrases(shard: DataFrame, shared, step: int, shards: int, longest: int) -> DataFrame:
    """Per block, the phrases of two words and more that are being counted in this step: (h, until, n); and those that
    have come of late: (h, k, front, back), by which they can be spelled."""
    schema = "h long, until int, n long, k byte, front long, back long"
    out = out_schema(shard.sparkSession, schema)

    def run(batches):
        active, latest = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                for columns in block_phrases(row, active, latest, step, shards, longest):
                    size = len(columns["h"])
                    for at in range(0, size, 1 << 18):
                        part = {c: v[at:at + (1 << 18)] for c, v in columns.items()}
                        yield pa.RecordBatch.from_arrays([
                            pa.array(part[f.name]).cast(f.type) if f.name in part else pa.nulls(len(part["h"]), f.type) for f in out
                        ], schema=out)

    return shard.select("lang", "words", "ends", "codes").mapInArrow(run, schema)


def block_phrases(row: dict, active: np.ndarray, latest: np.ndarray, step: int, shards: int, longest: int):
    """Of each length the phrases of a block: what is counted now, and the parts of those that have come of late."""
    codes = from_planes(row["codes"])
    names = byte_hashes(_words(row), seed(row["lang"]))
    came = active[slots_of(names, len(active))]
    # `at` are the places where a phrase of k words starts that has come, `ids` its number among `names`
    at = np.flatnonzero((codes >= 0) & (came[codes] != NEVER))
    ids = codes[at].astype(np.int64)
    for k in range(2, longest + 1):
        pair = np.flatnonzero(np.diff(at) == 1)
        if not len(pair):
            return
        keys, which, n = np.unique(ids[pair] * len(names) + ids[pair + 1], return_inverse=True, return_counts=True)
        front, back = keys // len(names), keys % len(names)
        both = np.maximum(came[front], came[back])
        until = both.astype(np.int64) + shards
        parts = names[front].view(np.int64), names[back].view(np.int64)
        names = chained(names[front], names[back])
        now = until >= step  # it starts one step after the later of both came and lasts `shards` steps
        h = names.view(np.int64)
        yield {"h": h[now], "until": until[now], "n": n[now]}
        own = slots_of(names, len(active))
        came = np.maximum(active[own], both)  # a slot may be older than the phrase
        late = (came != NEVER) & (latest[own].astype(np.int64) + shards >= step)
        yield {"h": h[late], "k": np.full(late.sum(), k), "front": parts[0][late], "back": parts[1][late]}
        come = came[which] != NEVER
        at, ids = at[pair][come], which[come]


def named(rows: DataFrame) -> DataFrame:
    """Rows (lang, word, ...) with the hash h of the word."""
    schema = T.StructType([*rows.schema, T.StructField("h", T.LongType())])

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            seeds = np.array([seed(x) for x in langs.dictionary.to_pylist()], np.uint64)
            h = byte_hashes(batch.column("word").cast(pa.large_binary()), seeds[langs.indices.to_numpy()] if len(langs) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h.view(np.int64))], names=[*batch.schema.names, "h"])

    return rows.mapInArrow(run, schema)


def activate(active: np.ndarray, latest: np.ndarray, hashes: DataFrame, step: int) -> bool:
    """Write `step` into the empty slots of these phrases, and into all their slots of `latest`; whether there are any.

    What comes to the driver are bits of slots.
    """
    slot = F.col("h").bitwiseAND(F.lit(len(active) - 1))
    bits = hashes.select(slot.alias("slot")).select((F.col("slot") / 63).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot % 63 as int))").alias("bit"))
    rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    words = np.array([r["word"] for r in rows], np.int64)
    masks = np.array([r["bits"] for r in rows], np.int64)
    for i in range(63):
        slots = words[(masks >> i) & 1 == 1] * 63 + i
        latest[slots] = step
        active[slots[active[slots] == NEVER]] = step
    return len(rows) > 0


def count(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, n, h) and phrases (k, front, back, n, h) that come `least` times, and (lang, n) of all words.

    `docs` (lang, text); a null language is `und`, a null text has no words.
    """
    if shards * (longest + 1) >= NEVER or slots & (slots - 1):
        raise ValueError("few enough shards that a byte holds all steps, and a power of two of slots")
    spark = docs.sparkSession
    encoded = written(blocks(docs, shards), "shard")
    active, latest = np.full(slots, NEVER, np.uint8), np.zeros(slots, np.uint8)
    words, counting, done, parts, last, step = None, None, [], [], -1, 0
    while step < shards or step <= last + shards:
        shard, came = encoded.filter(F.col("shard") == step % shards), []
        if step < shards:
            rows = _with_before(counted_words(shard), words)
            before, words = words, written(rows.groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("old").alias("old")))
            came.append(named(_newly(words, least)).select("h"))
            _drop(before)
        if last >= 0 and longest > 1:
            rows = _with_before(counted_phrases(shard, spark.sparkContext.broadcast((active, latest)), step, shards, longest), counting)
            rows = rows.groupBy("h").agg(
                F.max("until").alias("until"), F.sum("n").alias("n"), F.sum("old").alias("old"),
                F.max("k").alias("k"), F.max("front").alias("front"), F.max("back").alias("back"),
            )
            state = written(rows.filter((F.col("until") > step) | (F.col("n") >= least) | F.col("k").isNotNull()))
            came.append(_newly(state, least).select("h"))
            done.append(written(state.filter((F.col("until") == step) & (F.col("n") >= least)).select("h", "n")))
            parts.append(written(state.filter(F.col("k").isNotNull()).select("h", "k", "front", "back")))
            _drop(counting)
            empty = [F.lit(None).cast(kind).alias(c) for c, kind in (("k", "byte"), ("front", "long"), ("back", "long"))]
            counting = state.filter(F.col("until") > step).select("h", "until", "n", "old", *empty)
        if activate(active, latest, reduce(DataFrame.union, came), step):
            last = step
        step += 1
    frequent = written(named(words.filter(F.col("n") >= least).drop("old")))
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")))
    phrases = spark.createDataFrame([], "k byte, front long, back long, n long, h long")
    if done:
        of = reduce(DataFrame.unionByName, parts).dropDuplicates(["h"])
        phrases = written(reduce(DataFrame.unionByName, done).join(of, "h").select("k", "front", "back", "n", "h"))
    for table_ in (encoded, words, counting, *done, *parts):
        _drop(table_)
    return frequent, phrases, totals


def _with_before(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """New counts and those from before, which also stand in `old`."""
    rows = rows.withColumn("old", F.lit(0).cast("long"))
    return rows if before is None else rows.unionByName(before.withColumn("old", F.col("n")))


def _newly(rows: DataFrame, least: int) -> DataFrame:
    return rows.filter((F.col("n") >= least) & (F.col("old") < least))


def _drop(rows: DataFrame | None) -> None:
    if rows is not None:
        forget(rows)


def spelled(words: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """(lang, words (array), a) of every frequent word and phrase, put together from the words' hashes length by length."""
    level = words.select("lang", F.array(F.col("word").cast("string")).alias("words"), F.col("n").alias("a"), "h")
    out = level
    for k in range(2, longest + 1):
        front = level.select("lang", F.col("words").alias("first"), F.col("h").alias("front"))
        back = level.select(F.element_at("words", -1).alias("tail"), F.col("h").alias("back"))
        level = written(
            phrases.filter(F.col("k") == k).join(front, "front").join(back, "back")
            .select("lang", F.array_append("first", F.col("tail")).alias("words"), F.col("n").alias("a"), "h")
        )
        out = out.unionByName(level)
    return out.drop("h")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS, slots: int = SLOTS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language in `docs` (lang, text).

    Phrases have 2 to `longest` words and come `least` times inside pieces; the lowest score over all cuts counts, of
    equal cuts the first. A phrase inside a longer one that comes as often goes. Null texts count as empty, a null
    language as `und`; repeated rows count each; other columns are ignored; an empty table gives no rows.
    """
    words, phrases, totals = count(docs, least, longest, shards, slots)
    known = written(spelled(words, phrases, longest).select("lang", "words", F.array_join("words", " ").alias("phrase"), "a"))
    parts = known.select("lang", F.col("phrase").alias("part"), F.col("a").alias("times"))
    longer = known.filter(F.size("words") > 1)
    inside = longer.filter(F.size("words") > 2).select(
        "lang", "a", F.explode(F.array(
            F.array_join(F.slice("words", F.lit(1), F.size("words") - 1), " "), F.array_join(F.slice("words", F.lit(2), F.size("words") - 1), " ")
        )).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("within"))  # what lies in a phrase two words longer lies in one between
    kept = longer.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(F.col("within") < F.col("a"), F.lit(True))).drop("within")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice("words", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " "))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("times").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("times").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= 1 << 16 else totals, "lang")
    score = F.expr("(1000 * cast(a as decimal(15,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    ranked = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):  # the last task of a language gets `top` rows of each salt
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def twin(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    grams = "\nUNION ALL\n".join(
        f"SELECT lang, list_slice(w, i, i + {k - 1}) AS ws FROM pieces, range(1, len(w) - {k - 2}) AS t(i) WHERE len(w) >= {k}"
        for k in range(1, longest + 1)
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang,
           unnest(string_split_regex(translate(text, '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)
),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM pieces GROUP BY lang),
known AS MATERIALIZED (
  SELECT lang, ws, array_to_string(ws, ' ') AS phrase, count(*) AS a FROM ({grams}) GROUP BY lang, ws HAVING count(*) >= {least}
),
inside AS (
  SELECT lang, list_slice(ws, i, i + k - 1) AS ws, max(a) AS within
  FROM known, range(2, {longest}) AS s(k), range(1, {longest} + 1) AS t(i) WHERE k < len(ws) AND i + k - 1 <= len(ws) GROUP BY ALL
),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM known c CROSS JOIN range(1, {longest}) AS s(k)
  JOIN known x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, k)
  JOIN known y ON y.lang = c.lang AND y.ws = list_slice(c.ws, k + 1, len(c.ws))
  JOIN totals t ON t.lang = c.lang
  LEFT JOIN inside i ON i.lang = c.lang AND i.ws = c.ws
  WHERE len(c.ws) >= 2 AND k < len(c.ws) AND (i.within IS NULL OR i.within < c.a)
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= {top}"""


@query("op12_collocations", twin())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))

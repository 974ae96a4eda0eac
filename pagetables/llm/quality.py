"""Quality rules with the document frequency of lines.

Lines are normalised and hashed. For each host, the distinct texts that hold a line are counted; lines of too many
texts are boilerplate and removed, and a document of which too little is left is rejected.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm.common import map_batches, query, table, written
from pagetables.llm.vectors import run_hashes

#: A line is boilerplate on a host from so many distinct texts, and so large a share of the host's texts, on.
TEXTS, SHARE = 20, 0.002
#: Small hosts: from FEW texts on if that is one in PART texts; hosts of any size: from MANY texts on.
FEW, PART, MANY = 5, 5, 2000
#: A document is depleted if fewer words are left, or a smaller share of them.
LEFT_WORDS, LEFT_SHARE = 10, 0.2
#: Limits of the contract for the base rules.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
BLANKS = "\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
_DIGITS = re.compile("[0-9]+")


def words_of(text: str) -> list[str]:
    for blank in BLANKS:
        text = text.replace(blank, " ")
    return [w for w in text.split(" ") if w]


def repeated_words(words: list[str], size: int = WINDOW) -> int:
    """Words in runs of `size` words that occur twice or more."""
    if len(words) <= size:
        return 0
    runs = run_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), size)
    _, inverse, counts = np.unique(runs, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def normalised(line: str) -> str:
    """Lower case, numbers as 0, blanks as one space."""
    return _DIGITS.sub("0", " ".join(words_of(line)).lower())


def line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def measure(docs: DataFrame) -> DataFrame:
    """The base numbers of each row and its lines' hashes and words."""
    def fn(columns):
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "sizes")
        out = {c: [] for c in names}
        for text in columns["text"]:
            text = text or ""
            words = words_of(text)
            lines = [(line, len(words_of(line))) for line in text.split("\n")]
            full = [(line, n) for line, n in lines if n]
            values = (
                len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(full) - len({x for x, _ in full}),
                repeated_words(words), [line_hash(normalised(x)) for x, _ in full], [n for _, n in full],
            )
            for c, v in zip(names, values):
                out[c].append(v)
        yield {"doc_id": columns["doc_id"], "host": columns["host"], "digest": columns["digest"], **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("source").cast("string").alias("host"), F.xxhash64("text").alias("digest"), "text")
    return map_batches(
        source, fn,
        f"doc_id {kind}, host string, digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, lines array<long>, sizes array<int>",
    )


def judge(docs: DataFrame, texts: int = TEXTS, share: float = SHARE, few: int = FEW, part: int = PART, many: int = MANY) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words_left of every row.

    `docs` has doc_id, text and source, the host; a null source is a host of its own. Equal texts count once in a
    line's frequency, so copies of a page do not make its lines boilerplate. A null text has no words and fails the
    base rules. Repeated rows stay; other columns are ignored; an empty table gives no rows. Very long texts and lines
    are judged whole; a line moves as its hash.
    """
    rows = written(measure(docs).withColumn("host", F.coalesce("host", F.lit(""))).withColumn("uid", F.monotonically_increasing_id()))
    hosts = rows.select("host", "digest").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    lines = rows.select("uid", "host", "digest", F.explode(F.arrays_zip("lines", "sizes")).alias("x"))
    lines = lines.select("uid", "host", "digest", F.col("x.lines").alias("line"), F.col("x.sizes").alias("size"))
    counts = lines.select("host", "line", "digest").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    enough = ((n >= texts) & (n >= share * F.col("texts"))) | ((n >= few) & (n * part >= F.col("texts"))) | (n >= many)
    common = counts.filter(n >= min(texts, few, many)).join(hosts, "host").filter(enough).select("host", "line")
    gone = lines.join(common, ["host", "line"]).groupBy("uid").agg(F.sum("size").alias("gone"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    depleted = (left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words"))
    return rows.drop("lines", "sizes").join(gone, "uid", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), left.alias("words_left"),
    )


BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n
  FROM (SELECT doc_id, i, array_to_string(words[i + 1:i + {WINDOW}], ' ') AS run
        FROM (SELECT doc_id, words, unnest(range(len(words) - {WINDOW - 1})) AS i FROM d WHERE len(words) >= {WINDOW}))),
repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS place FROM runs WHERE n > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, host, text, line, len(words) AS size, regexp_replace(lower(array_to_string(words, ' ')), '[0-9]+', '0', 'g') AS norm
  FROM (SELECT *, regexp_extract_all(line, '{WORD}') AS words FROM (SELECT doc_id, host, text, unnest(string_split(t, chr(10))) AS line FROM d))
  WHERE len(words) > 0),
doubled AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT t) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS texts FROM d GROUP BY host),
common AS (SELECT host, norm FROM lines JOIN hosts USING (host) GROUP BY host, norm, texts
  HAVING (count(DISTINCT text) >= {TEXTS} AND count(DISTINCT text) >= {SHARE} * texts)
    OR (count(DISTINCT text) >= {FEW} AND count(DISTINCT text) * {PART} >= texts) OR count(DISTINCT text) >= {MANY}),
gone AS (SELECT doc_id, sum(size) AS n FROM lines JOIN common USING (host, norm) GROUP BY doc_id),
all_of AS (
  SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(t, '{BLANK}', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(doubled.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
    CAST(len(words) - coalesce(gone.n, 0) AS BIGINT) AS words_left
  FROM d LEFT JOIN doubled USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
    AND words_left >= {LEFT_WORDS} AND words_left >= {LEFT_SHARE} * n_words AS kept, words_left
FROM all_of"""


@query("op2_quality_rules", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))

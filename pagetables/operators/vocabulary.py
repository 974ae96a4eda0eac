"""Vocabularies of any size looked up in whole texts.

A vocabulary is a table of tokens. Up to a checked size it becomes one automaton that reads each text once, whatever
the number of tokens. Beyond that size tokens and texts meet in a join on the tokens' first characters, so no machine
holds the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tokens, and characters of all of them, that one automaton holds at most (some 100 MB).
TOKENS, CHARACTERS = 200_000, 4_000_000
#: Characters that tokens and texts are joined on; shorter tokens, of which there are few, by all of theirs.
SEED = 4


def plain_lower(text: Column | str) -> Column:
    """A-Z in lower case; other letters stay, so places in the text do not move."""
    return F.translate(text, UPPER, LOWER)


def distinct_tokens(tokens: DataFrame, token: str = "token") -> DataFrame:
    return tokens.select(plain_lower(token).alias("token")).filter("token <> ''").distinct()


def vocabulary_matches(
    texts: DataFrame, keys: Sequence[str], text: str, tokens: DataFrame, limit: int = TOKENS, characters: int = CHARACTERS,
) -> DataFrame:
    """(keys, token, first_at) of every token in a text, without regard to the case of A-Z.

    `tokens` has a column token; null and blank tokens match nothing, repeated ones count once. `first_at` is the first
    place in code points, from 1. Tokens may overlap or lie in one another. `keys` name one text: rows that repeat them
    give rows of their own. A null text has no match; an empty vocabulary gives no rows.
    """
    words = distinct_tokens(tokens)
    size = words.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("token")).alias("c")).first()
    if size["n"] <= limit and (size["c"] or 0) <= characters:
        return _by_automaton(texts, keys, text, [r["token"] for r in words.collect()])
    return _by_seeds(texts, keys, text, words)


def _by_automaton(texts: DataFrame, keys: Sequence[str], text: str, words: list[str]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(sorted(words))
    own = texts.select(*keys, plain_lower(text).alias("_text"))
    schema = T.StructType([*texts.select(*keys).schema, T.StructField("token", T.StringType()), T.StructField("first_at", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in shared.value:
            automaton.add_word(word, word)
        if not len(automaton):
            return
        automaton.make_automaton()
        for batch in batches:
            rows, found, places = [], [], []
            for i, value in enumerate(batch.column("_text").to_pylist()):
                first: dict[str, int] = {}
                for end, word in automaton.iter(value or ""):
                    first.setdefault(word, end - len(word) + 2)
                rows += [i] * len(first)
                found += first
                places += first.values()
            kept = batch.select(list(keys)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(found, pa.string()), pa.array(places, pa.int32())], names=[*keys, "token", "first_at"]
            )

    return own.mapInArrow(run, schema)


def _by_seeds(texts: DataFrame, keys: Sequence[str], text: str, words: DataFrame) -> DataFrame:
    """Each text once for each of its seeds that some token starts with; the token is then looked up in the text.

    Seeds of a text are distinct before they move. Short tokens are seeds of their own length.
    """
    rows = texts.select(*keys, plain_lower(text).alias("_text"))
    sizes = F.array(*[F.lit(n) for n in range(1, SEED + 1)])
    starts = F.sequence(F.lit(1), F.length("_text"))
    cut = F.transform(sizes, lambda n: F.array_distinct(F.transform(starts, lambda i: F.substr("_text", i, n))))
    seeds = rows.filter("_text <> ''").withColumn("_seed", F.explode(F.array_distinct(F.flatten(cut))))
    known = words.withColumn("_seed", F.substring("token", 1, SEED))
    met = seeds.join(known, "_seed").withColumn("first_at", F.instr("_text", F.col("token")))
    return met.filter("first_at > 0").select(*keys, "token", F.col("first_at").cast("int").alias("first_at"))


def vocabulary_scores(
    texts: DataFrame, keys: Sequence[str], text: str, tokens: DataFrame, limit: int = TOKENS, characters: int = CHARACTERS,
) -> DataFrame:
    """(keys, group, tokens, points) of each text and group of `tokens` (token, group, points) that it has a token of.

    Tokens of one group count once a text, with their largest points.
    """
    found = vocabulary_matches(texts, keys, text, tokens, limit, characters)
    worth = tokens.groupBy(plain_lower("token").alias("token"), "group").agg(F.max("points").alias("points"))
    scored = found.join(worth, "token").groupBy(*keys, "group")
    return scored.agg(F.count(F.lit(1)).alias("tokens"), F.sum("points").alias("points"))

"""From documents to packed training sequences.

Stages run one after the other; each result is written to the shared folder as Parquet and read again, so a lost
executor costs no earlier stage. Every stage judges all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetables.llm.common import query, table, written
from pagetables.llm.decontaminate import without_leaks
from pagetables.llm.language import known_language
from pagetables.llm.near import one_each
from pagetables.llm.packing import pack
from pagetables.llm.pii import without_personal_data


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known.

    Null and empty texts and texts without letters go. Repeated rows are judged alike; null ids stay; a table that
    teaches no language keeps nothing, an empty one gives no rows; other columns pass whatever their names.
    """
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies.

    Of repeated rows one stays; different texts under one id, or without an id, are judged each on their own; a null
    text is a group for each id; an empty text equals empty texts only. An empty table gives no rows; other columns pass
    with the row that stays.
    """
    return one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, as do all rows when the benchmark is empty; equal texts go or stay together,
    whatever their ids; long texts are judged whole; an empty table gives no rows; other columns pass.
    """
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked.

    No row goes. Null texts stay null, empty ones empty; repeated rows are masked alike; long texts are masked whole;
    an empty table gives no rows; other columns pass, a count of characters is that of the masked text.
    """
    return without_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences.

    Null and empty texts are one end mark; every row has pieces of its own, also repeated ones and those without an id;
    long texts are cut over sequences; an empty table gives no rows; other columns are left out.
    """
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]
#: Neither the forest nor the tilings can be said in SQL.
ORACLE_SQL = None


@query("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""JSON-LD of a page corpus. Row-wise: the objects of a page stay one array, in document order.

`objects` is the column that `with_page_tree` adds: every object of a page at any depth, parents before children.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.functions import payload as J
from pagetables.functions.html import script_bodies
from pagetables.functions.text import let, model_from_text
from pagetables.operators.nodes import with_page_tree


def jsonld_items(html: Column | str) -> Column:
    """ARRAY<STRUCT<block, idx, text, kind>>: valid scripts, top-level arrays opened one level."""

    def items(body: Column, block: Column) -> Column:
        def opened_as(kind: Column) -> Column:
            single = F.array(F.struct(body.alias("text"), kind.alias("kind")))
            return F.when(kind == "ARRAY", J.elements(body)).when(kind != "", single)

        opened = let(J.kind_of(F.try_parse_json(body)), opened_as)
        placed = F.transform(
            opened,
            lambda e, i: F.struct(block.alias("block"), i.alias("idx"), e["text"].alias("text"), e["kind"].alias("kind")),
        )
        return F.coalesce(placed, F.array().cast("array<struct<block:int,idx:int,text:string,kind:string>>"))

    return F.flatten(F.transform(script_bodies(html, "ld+json"), items))


def read_jsonld(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.explode(jsonld_items("html")).alias("j"))
    return rows.select("page_id", "j.block", "j.idx", "j.kind", F.col("j.text").alias("item"))


def jsonld_objects(pages: DataFrame) -> DataFrame:
    """One row per object with its place in the walk."""
    tree = with_page_tree(pages, columns=["page_id", "objects"], fields=["path", "text"])
    rows = tree.select("page_id", F.posexplode("objects").alias("pos", "o"))
    return rows.select("page_id", "pos", F.size("o.path").alias("path_len"), F.col("o.text").alias("object"))


def structured_rows(pages: DataFrame, keys: Sequence[str] = ("page_id",)) -> DataFrame:
    """Top-level items as rows: scalar fields as text, four known nested fields as JSON, others dropped."""

    def row(record: Column) -> Column:
        kept = F.map_filter(
            record, lambda k, v: ~v["kind"].isin("OBJECT", "ARRAY") | k.isin(*J.KEPT_NESTED_KEYS)
        )
        return F.transform_values(kept, lambda _, v: J.scalar_text(v))

    rows = pages.select(*keys, F.explode(jsonld_items("html")).alias("j"))
    record = J.fields(F.when(F.col("j.kind") == "OBJECT", F.col("j.text")))
    return rows.select(*keys, "j.block", "j.idx", let(record, row).alias("extra"))


def structured_value(objects: Column, keys: Sequence[str]) -> Column:
    """First non-blank value under one of the keys (any letter case); object order counts."""
    wanted = [k.lower() for k in keys]
    entries = F.flatten(F.transform(objects, lambda o: o["entries"]))
    hits = F.filter(entries, lambda e: (e["text"] != "") & F.lower(e["key"]).isin(*wanted))
    return F.coalesce(F.get(hits, F.lit(0))["text"], F.lit(""))


def structured_value_ordered(objects: Column, keys: Sequence[str]) -> Column:
    """Like `structured_value`, but the order of the keys counts first."""
    return F.coalesce(*[F.nullif(structured_value(objects, [k]), F.lit("")) for k in keys], F.lit(""))


def structured_price(objects: Column) -> Column:
    """Price of the first object that has one, itself or among its offers."""
    prices = F.filter(F.transform(objects, lambda o: o["price"]), lambda p: p.isNotNull())
    return F.coalesce(F.get(prices, F.lit(0)), F.lit(""))


def extract_model_number(text: Column | str, objects: Column | None = None) -> Column:
    """Structured model number, else the value behind a label in the text."""
    labelled = F.coalesce(model_from_text(text), F.lit(""))
    if objects is None:
        return labelled
    structured = structured_value_ordered(objects, J.DETAIL_KEYS["model_number"])
    return F.coalesce(F.nullif(structured, F.lit("")), labelled)

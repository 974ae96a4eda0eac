"""JSON payload expressions.

A payload is read twice: as MAP<STRING,STRING>, which keeps the key order and
gives every value as text, and as MAP<STRING,VARIANT>, which tells the types
apart ("5" is not 5, "{}" is not {}). `fields` zips both.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetables.functions.images import dedup_by_key, is_image_url
from pagetables.functions.text import clean_text, col, let

# --- fixed values: results depend on these exact texts -----------------------
CONTAINER_KEYS = ["@graph", "itemListElement", "mainEntity", "offers"]
PRICE_KEYS = ["price", "lowPrice", "highPrice"]
KEPT_NESTED_KEYS = ["offers", "brand", "image", "aggregateRating"]
DETAIL_KEYS = {
    "brand": ["brand", "manufacturer"],
    "sku": ["sku"],
    "mpn": ["mpn"],
    "model_number": ["model", "modelNumber", "productID", "sku", "mpn"],
    "availability": ["availability"],
}
IMAGE_KEYS = ["url", "original", "original_url", "original_image", "thumbnail", "image"]
# --- end of fixed values -----------------------------------------------------


def kind_of(value: Column) -> Column:
    """STRING, NUMBER, BOOLEAN, VOID, OBJECT or ARRAY."""
    name = F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)
    return F.regexp_replace(name, "^(BIGINT|DECIMAL|DOUBLE|FLOAT)$", "NUMBER")


def fields(text: Column | str) -> Column:
    """MAP<key, STRUCT<text, kind>> of an object, in key order; empty for anything else."""
    text = col(text)
    texts = F.from_json(text, "map<string,string>")
    kinds = F.transform_values(F.from_json(text, "map<string,variant>"), lambda _, v: kind_of(v))
    zipped = F.map_zip_with(texts, kinds, lambda _, t, k: F.struct(t.alias("text"), k.alias("kind")))
    return F.coalesce(zipped, F.from_json(F.lit("{}"), "map<string,struct<text:string,kind:string>>"))


def elements(text: Column | str) -> Column:
    """ARRAY<STRUCT<text, kind>> of a JSON array; empty for anything else."""
    text = col(text)
    texts = F.from_json(text, "array<string>")
    kinds = F.transform(F.from_json(text, "array<variant>"), kind_of)
    zipped = F.arrays_zip(texts.alias("text"), kinds.alias("kind"))
    return F.coalesce(zipped, F.from_json(F.lit("[]"), "array<struct<text:string,kind:string>>"))


def scalar_text(value: Column) -> Column:
    """Text of a field: nested values as JSON, booleans capitalised, null and absent blank."""
    return F.coalesce(
        F.when(value["kind"] == "BOOLEAN", F.initcap(value["text"]))
        .when(value["kind"] == "VOID", F.lit(""))
        .otherwise(value["text"]),
        F.lit(""),
    )


def is_truthy(value: Column) -> Column:
    """False for absent, null, "", 0, false, [] and {}."""
    text, kind = value["text"], value["kind"]
    blank = (
        F.when(kind == "STRING", text == "")
        .when(kind == "NUMBER", text.try_cast("double") == 0)
        .when(kind == "BOOLEAN", text == "false")
        .when(kind == "ARRAY", text == "[]")
        .when(kind == "OBJECT", text == "{}")
        .otherwise(F.lit(True))
    )
    return ~F.coalesce(blank, F.lit(True))


def truthy_text(record: Column, key: str) -> Column:
    """Text of a field, NULL when it is blank."""
    value = record[key]
    return F.when(is_truthy(value), scalar_text(value))


def first_truthy_text(*candidates: tuple[Column, str]) -> Column:
    """First non-blank field of several records, '' when there is none."""
    return F.coalesce(*[truthy_text(record, key) for record, key in candidates], F.lit(""))


def present_or(first: Column, second: Column, key: str) -> Column:
    """Field of the first record when it has the key, even with null; else of the second."""
    return F.when(F.map_contains_key(first, key), scalar_text(first[key])).otherwise(scalar_text(second[key]))


def nested_text(text: Column | str, *keys: str) -> Column:
    """Text of a nested value, '' as soon as a step is missing."""
    def inside(record: Column, rest: tuple[str, ...]) -> Column:
        if len(rest) == 1:
            return let(record[rest[0]], scalar_text)
        return let(
            record[rest[0]],
            lambda step: let(fields(F.when(step["kind"] == "OBJECT", step["text"])), lambda below: inside(below, rest[1:])),
        )

    return let(fields(text), lambda record: inside(record, keys))


def text_value(value: Column) -> Column:
    """Readable text of a JSON value: an object stands for its name, else its @id, else its JSON; a list joins its
    non-blank items by ', '. Names may be objects or lists again, at any depth."""
    nested = value["kind"].isin("OBJECT", "ARRAY")
    plain = F.when(value["kind"] == "STRING", clean_text(value["text"])).when(is_truthy(value), scalar_text(value))
    return F.coalesce(F.when(nested, _readable(F.when(nested, value["text"]))).otherwise(plain), F.lit(""))


def first_entries(entries: Column) -> Column:
    """Map of the first entry per key."""
    return let(
        F.transform(entries, lambda e: e["key"]),
        lambda keys: F.map_from_entries(F.filter(entries, lambda e, i: F.array_position(keys, e["key"]) == i + 1)),
    )


def flatten_payload(text: Column | str, prefix: str = "") -> Column:
    """Depth-1 flattening: every field, plus parent.child for the fields of nested objects."""

    def own(record: Column) -> Column:
        return F.transform(
            F.map_entries(record),
            lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("key"), scalar_text(e["value"]).alias("value")),
        )

    def nested(record: Column) -> Column:
        return F.flatten(
            F.transform(
                F.filter(F.map_entries(record), lambda e: e["value"]["kind"] == "OBJECT"),
                lambda e: F.transform(
                    F.map_entries(fields(e["value"]["text"])),
                    lambda c: F.struct(
                        F.concat(F.lit(prefix), e["key"], F.lit("."), c["key"]).alias("key"),
                        scalar_text(c["value"]).alias("value"),
                    ),
                ),
            )
        )

    return let(fields(text), lambda record: let(F.concat(own(record), nested(record)), first_entries))


def _walk_images(value) -> list[str]:
    """Texts that may be image URLs, in the order of the walk: of an object the known keys first, then all its values."""
    out, todo = [], [value]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            out += [v for v in map(value.get, IMAGE_KEYS) if isinstance(v, str)]
            todo += reversed(list(value.values()))
        elif isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, str):
            out.append(value)
    return [u for u in out if u.startswith(("http://", "https://"))]


def _object(text: str | None) -> dict | list:
    try:
        return json.loads(text) if text else {}
    except (ValueError, RecursionError):
        return {}


@F.pandas_udf(T.ArrayType(T.StringType()))
def _urls_in(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _walk_images(_object(t)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _urls_of_product(product: pd.Series, detail: pd.Series, options: pd.Series) -> pd.Series:
    """Listed images of the overlaid records, whatever they look like, then what the walk finds."""
    out = []
    for texts in zip(product, detail, options):
        record: dict = {}
        for part in map(_object, texts):
            record.update(part if isinstance(part, dict) else {})
        image, images = record.get("image"), record.get("images")
        listed = [record.get("original_image"), image.get("url") if isinstance(image, dict) else None]
        listed += [i.get("url") if isinstance(i, dict) else i for i in (images if isinstance(images, list) else [])]
        named = ["\x00" + str(u) for u in listed if u and (isinstance(u, str) or u is listed[0])]
        out.append(named + _walk_images(record))
    return pd.Series(out)


def _image_urls(found: Column) -> Column:
    """Listed images as they are (they carry a mark), others where they look like images."""
    kept = F.filter(found, lambda u: F.startswith(u, F.lit("\x00")) | is_image_url(u))
    return dedup_by_key(F.transform(kept, lambda u: F.regexp_replace(u, "^\x00", "")))


def collect_images(text: Column | str) -> Column:
    """Image URLs anywhere in a payload, at any depth, first one per canonical key. One Arrow-batched walk per payload."""
    return _image_urls(_urls_in(col(text)))


def product_images(product: Column | str, detail: Column | str, options: Column | str) -> Column:
    """Images of a store product: listed ones first, then those at any depth of its overlaid records."""
    return _image_urls(_urls_of_product(col(product), col(detail), col(options)))


@F.pandas_udf(T.StringType())
def _readable(texts: pd.Series) -> pd.Series:
    def text_of(value) -> str:
        while isinstance(value, dict) and ("name" in value or "@id" in value):
            value = value["name"] if "name" in value else value["@id"]
        if isinstance(value, dict):
            return json.dumps(value, ensure_ascii=False)
        if isinstance(value, list):
            return ", ".join(t for t in map(text_of, value) if t)
        return " ".join(str(value or "").split())

    return texts.map(lambda t: text_of(_object(t)))


def overlay(*records: Column) -> Column:
    """Later records replace the values of earlier ones; keys keep the place where they first appear."""
    def value(key: Column) -> Column:
        return F.coalesce(*[r[key] for r in reversed(records)])

    keys = F.array_distinct(F.concat(*[F.map_keys(r) for r in records]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), value(k).alias("value"))))

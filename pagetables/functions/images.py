"""Image URL expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetables.functions.text import col, decode_entities, first_truthy, let
from pagetables.functions.urls import unquote, url_path

# --- fixed values: results depend on these exact texts -----------------------
IMAGE_HOSTS = ["cdn.salla.sa"]
SOURCE_ATTRIBUTES = ["src", "data-src", "data-original", "data-lazy", "data-image", "data-url"]
SRCSET_ATTRIBUTES = ["srcset", "data-srcset"]
IMAGE_EXTENSION = r"(?i)\.(?:png|jpe?g|webp|gif)(?:\?|$)"
SIZE = r"\d+(?:\.\d+)?x\d+(?:\.\d+)?"
CDN_PART = r"/cdn-cgi/image/[^/]+/"
SIZE_PARTS = rf"-(?:{SIZE}|width=\d+|height=\d+|fit=[^-]+)(?=-|\.|$)"
URL_END = r"""/[^\s"'<>]+"""
# --- end of fixed values -----------------------------------------------------


def is_image_url(url: Column | str, hosts: Sequence[str] = IMAGE_HOSTS) -> Column:
    url = col(url)
    known = url.rlike(IMAGE_EXTENSION)
    for host in hosts:
        known = known | F.contains(url, F.lit(host))
    return F.coalesce(url.rlike("^https?://") & known, F.lit(False))


def canonical_image_key(url: Column | str) -> Column:
    """File name of an image without its size parts, so that sizes of one picture share a key."""
    path = F.regexp_replace(unquote(url_path(url)), CDN_PART, "/")
    # what follows the first size part that has text behind it, else the whole name
    tail = F.regexp_replace(F.substring_index(path, "/", -1), rf"^.*?-{SIZE}-(.+)$", "$1")
    name = F.regexp_replace(tail, SIZE_PARTS, "")
    return F.coalesce(F.nullif(F.regexp_replace(name, rf"-{SIZE}-", "-"), F.lit("")), path)


def best_srcset(value: Column | str) -> Column:
    """Candidate with the largest descriptor (w as is, x times 1000); the first one wins a tie."""
    items = F.filter(
        F.transform(F.split(F.coalesce(col(value), F.lit("")), ","), lambda i: F.split(F.trim(i), r"\s+")),
        lambda parts: F.get(parts, F.lit(0)) != "",
    )

    def scored(parts: Column, index: Column) -> Column:
        descriptor = F.lower(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        number = F.substr(descriptor, F.lit(1), F.length(descriptor) - 1).try_cast("double")
        score = (
            F.when(descriptor.endswith("w"), number).when(descriptor.endswith("x"), number * 1000)
        )
        return F.struct(
            F.coalesce(score, F.lit(0.0)).alias("score"),
            (-index).alias("order"),
            F.get(parts, F.lit(0)).alias("url"),
        )

    best = F.array_max(F.transform(items, scored))
    return F.when(best["score"] > -1, best["url"]).otherwise(F.lit(""))


def image_src(attribute) -> Column:
    """Source of an <img>; `attribute(name)` gives the value of one attribute."""
    plain = [attribute(name) for name in SOURCE_ATTRIBUTES]
    sets = [best_srcset(attribute(name)) for name in SRCSET_ATTRIBUTES]
    return F.coalesce(first_truthy(*plain, *sets), F.lit(""))


def dedup_by_key(urls: Column | str) -> Column:
    """First URL per canonical key of one row's image array."""
    filled = F.filter(F.coalesce(col(urls), F.array().cast("array<string>")), lambda u: F.coalesce(u, F.lit("")) != "")

    def first(found: Column) -> Column:
        return let(
            F.transform(found, canonical_image_key),
            lambda keys: F.filter(found, lambda u, i: F.array_position(keys, F.get(keys, i)) == i + 1),
        )

    return let(filled, first)


def image_urls_in_text(value: Column | str, hosts: Sequence[str] = IMAGE_HOSTS) -> Column:
    """Image URLs of the given CDN hosts inside raw text, in order, duplicates kept."""
    text = F.replace(decode_entities(F.coalesce(col(value), F.lit(""))), F.lit("\\/"), F.lit("/"))
    host = "|".join(h.replace(".", r"\.") for h in hosts)
    found = F.regexp_extract_all(text, F.lit(rf"(https://(?:{host}){URL_END})"), F.lit(1))
    cut = F.transform(found, lambda u: F.substring_index(F.substring_index(u, "&quot;", 1), "\\", 1))
    return F.filter(cut, lambda u: is_image_url(u, hosts))

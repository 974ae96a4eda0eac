"""Tables that a page corpus explodes into. All row-wise: no shuffle anywhere in this module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.functions import html as H
from pagetables.functions.text import let
from pagetables.functions.urls import resolve_parts, url_parts


def page_title(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", H.title_text("html").alias("title"))


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", H.flat_text("html").alias("text"))


def page_meta(pages: DataFrame) -> DataFrame:
    rows = pages.select("page_id", F.posexplode(H.meta_array("html")).alias("pos", "m"))
    return rows.select("page_id", "pos", "m.name", "m.content")


def _first(array: Column, limit: int | None) -> Column:
    return array if limit is None else F.slice(array, 1, limit)


def resolved_images(limit: int | None = None) -> Column:
    """Images of a page with absolute sources. The work is done before the explode, once per image."""
    images = _first(H.image_array("html"), limit)
    return let(
        url_parts("url"),
        lambda base: F.transform(
            images,
            lambda i: F.struct(
                resolve_parts(base, i["src"]).alias("src"), i["alt"].alias("alt"), i["title"].alias("title")
            ),
        ),
    )


def resolved_links(limit: int | None = None) -> Column:
    """Links of a page with absolute targets."""
    links = _first(H.link_array("html"), limit)
    return let(
        url_parts("url"),
        lambda base: F.transform(
            links, lambda l: F.struct(resolve_parts(base, l["href"]).alias("href"), l["text"].alias("text"))
        ),
    )


def page_images(pages: DataFrame, limit: int | None = None) -> DataFrame:
    rows = pages.select("page_id", F.posexplode(resolved_images(limit)).alias("pos", "i"))
    return rows.select("page_id", "pos", "i.src", "i.alt", "i.title")


def page_links(pages: DataFrame, limit: int | None = None) -> DataFrame:
    rows = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(resolved_links(limit)).alias("pos", "l"))
    return rows.select("page_id", "page_url", "pos", "l.href", "l.text")

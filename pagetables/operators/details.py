"""Product page records and their left join onto listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.functions import html as H
from pagetables.functions import urls as U
from pagetables.functions.payload import DETAIL_KEYS
from pagetables.functions.text import first_price
from pagetables.operators.nodes import with_page_tree
from pagetables.operators.pages import resolved_images
from pagetables.operators.ranking import first_per_key
from pagetables.operators.structured import (
    extract_model_number,
    structured_price,
    structured_value,
)

# what one visit of a site reads at most; pass these where that is wanted
DETAIL_PAGES = 250
DETAIL_IMAGES = 8
DETAIL_CHARS = 2000
DETAIL_COLUMNS = [
    "detail_url", "detail_title", "detail_price", "brand", "sku", "mpn", "model_number", "availability",
    "detail_images", "detail_description",
]


def url_key(url: Column | str) -> Column:
    """Key of a page in a join by URL: normalised, without its fragment."""
    return F.regexp_replace(U.normalize_url(url), "#.*$", "")


def page_detail(pages: DataFrame, images: int | None = None, description: int | None = None) -> DataFrame:
    """One product record per page. Narrow: one Python pass for text and JSON-LD, the rest built in.

    `images` and `description` cut the image list and the page text; by default both are whole.
    """
    read = ["page_id", "url", "html", "text", "objects"]
    ready = with_page_tree(pages, columns=read, fields=["entries", "price"]).withColumnRenamed("objects", "_objects")
    sources = F.transform(resolved_images(images), lambda i: i["src"])
    price = F.nullif(structured_price(F.col("_objects")), F.lit(""))
    return ready.select(
        "page_id",
        U.normalize_url("url").alias("detail_url"),
        H.title_text("html").alias("detail_title"),
        F.coalesce(price, first_price("text")).alias("detail_price"),
        structured_value(F.col("_objects"), DETAIL_KEYS["brand"]).alias("brand"),
        structured_value(F.col("_objects"), DETAIL_KEYS["sku"]).alias("sku"),
        structured_value(F.col("_objects"), DETAIL_KEYS["mpn"]).alias("mpn"),
        extract_model_number("text", F.col("_objects")).alias("model_number"),
        structured_value(F.col("_objects"), DETAIL_KEYS["availability"]).alias("availability"),
        F.array_join(sources, " | ").alias("detail_images"),
        (F.col("text") if description is None else F.substring("text", 1, description)).alias("detail_description"),
    )


def detail_eligibility(listings: DataFrame, limit: int | None = None) -> DataFrame:
    """Tags each listing: visit, or why its detail page is skipped. `idx` counts per page; no limit by default."""
    linked = (F.col("url") != "") & U.same_site("url", "page_url")
    status = (
        F.when(F.lit(limit is not None) & (F.col("idx") > (limit or 0)), F.lit(f"Skipped: detail page limit is {limit}"))
        .when(~F.coalesce(linked, F.lit(False)), F.lit("Skipped: no same-site product URL"))
        .otherwise(F.lit("visit"))
    )
    return listings.withColumn("detail_status", status)


def enrich_details(listings: DataFrame, details: DataFrame, limit: int | None = None) -> DataFrame:
    """Eligible listings take over their detail record, blanks included; a missing page is a status.

    Listings are cut to their eligible part before the join, and the detail
    side has one row per URL, so the join never multiplies rows.
    """
    # a key that no page has spreads the listings without a visit over the tasks of the join
    none = F.concat(F.lit("\0"), F.xxhash64(*[c for c in ("page_id", "idx", "url") if c in listings.columns]).cast("string"))
    tagged = detail_eligibility(listings, limit).withColumn(
        "_key", F.when(F.col("detail_status") == "visit", url_key("url")).otherwise(none)
    )
    keyed = details.withColumn("_url", url_key("detail_url"))
    one_per_url = first_per_key(keyed, ["_url"], [F.col("page_id")]).drop("page_id")
    # a merge join: Spark takes records made of pages for as small as what the pages were read from, and would broadcast them
    joined = tagged.join(one_per_url.withColumn("_hit", F.lit(True)).hint("merge"), F.col("_key") == F.col("_url"), "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    visited = F.col("detail_status") == "visit"
    status = (
        F.when(hit, F.lit("OK"))
        .when(visited, F.lit("Failed: page is not in the corpus"))
        .otherwise(F.col("detail_status"))
    )
    own = [c for c in listings.columns if c not in DETAIL_COLUMNS]
    return joined.select(
        *own,
        status.alias("detail_status"),
        F.when(hit, F.col("detail_url")).otherwise(F.col("url")).alias("detail_url"),
        F.when(hit, F.col("model_number")).otherwise(F.lit("")).alias("model_number"),
        *[c for c in DETAIL_COLUMNS if c not in ("detail_url", "model_number")],
        visited.alias("visited"),
    )


def catalog_to_pages(catalog: DataFrame, pages: DataFrame) -> DataFrame:
    """Catalog URLs that are in the corpus, with their page; one page per URL."""
    wanted = catalog.withColumn("_key", url_key("url"))
    have = pages.select(F.col("page_id"), F.col("url").alias("page_url"), url_key("url").alias("_key"))
    have = first_per_key(have, ["_key"], [F.col("page_id")])
    return wanted.join(have, "_key").drop("_key")



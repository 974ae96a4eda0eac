"""Whole catalogs: feed stores, API stores, and websites read page by page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetables.functions import urls as U
from pagetables.operators.catalog import discover_catalog_urls
from pagetables.operators.details import catalog_to_pages
from pagetables.operators.feeds import (
    collection_title,
    embedded_coverage,
    embedded_hits,
    enrich_gallery,
    enrich_products,
    normalize_embedded_hit,
    normalize_feed_product,
    normalize_store_product,
    store_records,
)
from pagetables.operators.listings import link_nodes, product_link_listings
from pagetables.operators.merge import merge_by_key
from pagetables.operators.ranking import category_allowance
from pagetables.session import cut_lineage
from pagetables.sources.payloads import (
    FEED_PAGE_SIZE,
    cursor_pages,
    paginate_numbered,
)

# what one visit reads at most; pass these where that is wanted
CATALOG_ROWS = 5000
CATEGORY_ROWS, STORE_ROWS = 500, 5000
NO_LIMIT = (1 << 31) - 1


def feed_catalog(
    pages: DataFrame, group: Sequence[str], site_url, page_size: int = FEED_PAGE_SIZE, limit: int | None = None
) -> DataFrame:
    """Store mode: all products of each feed store as listing rows, in feed order."""
    items = paginate_numbered(pages, group, "items", page_size, limit)
    rows = items.select(*group, "idx", F.col("item").alias("payload"), site_url.alias("_base"))
    return normalize_feed_product(rows, F.col("_base")).drop("_base")


def feed_collection(
    pages: DataFrame, group: Sequence[str], url: str, page_size: int = FEED_PAGE_SIZE, limit: int | None = None
) -> DataFrame:
    """Collection mode: products of the collection a URL points to; the category is its handle."""
    items = paginate_numbered(pages, group, "items", page_size, limit)
    rows = items.select(*group, "idx", F.col("item").alias("payload"), U.collection_handle(url).alias("_handle"),
                        U.site_root(url).alias("_base"))
    category = F.struct(
        F.col("_handle").alias("id"), collection_title("_handle").alias("title"), F.col(url).alias("url")
    )
    return normalize_feed_product(rows, F.col("_base"), category).drop("_base", "_handle")


def feed_collections(
    pages: DataFrame, group: Sequence[str], page_size: int = FEED_PAGE_SIZE, limit: int | None = None, base: Column | None = None,
) -> DataFrame:
    """Collections table of each feed store; `base` is the address of the store, without it the URL starts with a slash."""
    items = paginate_numbered(pages, group, "items", page_size, limit)
    c = F.from_json("item", "id string, title string, handle string, products_count string")
    return items.select(
        *group, "idx", c["id"].alias("category_id"), c["title"].alias("name"), c["handle"].alias("handle"),
        F.concat(F.lit("") if base is None else base, F.lit("/collections/"), F.coalesce(c["handle"], F.lit(""))).alias("url"),
        c["products_count"].alias("products_found"),
    )


def category_budget(
    running: DataFrame, store: str, category: str, category_order: str,
    per_category: int | None = None, per_store: int | None = None,
) -> DataFrame:
    """Rows that each category of a store may contribute, from the sizes of its pages."""
    available = running.groupBy(store, category, category_order).agg(
        F.least(F.sum("size"), F.lit(per_category or NO_LIMIT)).alias("available"), F.count(F.lit(1)).alias("api_pages")
    )
    return category_allowance(available, store, category_order, per_category or NO_LIMIT, per_store or NO_LIMIT)


def store_catalog(
    pages: DataFrame, store: str, category: str, category_order: str,
    per_category: int | None = None, per_store: int | None = None,
) -> DataFrame:
    """Product payloads of all categories of each store under both caps.

    Products are not de-duplicated across categories. Which rows a category
    may keep depends on page sizes only, so payloads move once, in the join.
    """
    group = [store, category, category_order]
    running = cursor_pages(pages, group, "items", per_category)
    allowed = category_budget(running, store, category, category_order, per_category, per_store)
    kept = running.select(*group, "page_seq", "taken_before").join(allowed.select(*group, "allowed"), group)
    rows = pages.join(kept, [*group, "page_seq"]).select(
        *group, "taken_before", "allowed", F.posexplode("items").alias("pos", "item")
    )
    idx = F.col("taken_before") + F.col("pos") + 1
    return rows.withColumn("idx", idx).filter(F.col("idx") <= F.col("allowed")).drop("taken_before", "allowed", "pos")


def store_categories(
    pages: DataFrame, store: str, category: str, category_order: str,
    per_category: int | None = None, per_store: int | None = None,
) -> DataFrame:
    """One summary row per scraped category with its API pages and warning; categories after the budget is spent are not scraped."""
    running = cursor_pages(pages, [store, category, category_order], "items", per_category)
    budget = category_budget(running, store, category, category_order, per_category, per_store)
    read = budget.filter(F.col("spent_before") < (per_store or NO_LIMIT))
    full = F.lit(per_store is not None) & (F.col("spent_before") + F.col("allowed") >= (per_store or NO_LIMIT))
    return read.select(
        store, category, category_order, F.col("allowed").alias("products_found"), "api_pages",
        F.when(full, F.lit(f"store row safety limit reached at {per_store}")).otherwise(F.lit("")).alias("warning"),
    )


def store_listings(
    pages: DataFrame, details: DataFrame, options: DataFrame, galleries: DataFrame, order: Sequence[str],
    store: str = "store", category: str = "category", category_order: str = "category_order", category_url: str | None = None,
    per_category: int | None = None, per_store: int | None = None, options_limit: int | None = None,
) -> DataFrame:
    """Listing rows of all categories of each store: paging, details and options, galleries, normalised, with their category.

    `details` and `options` have product_id, payload and the columns of `order`; the last record of an id counts.
    """
    rows = store_catalog(pages, store, category, category_order, per_category, per_store)
    # a product has a category of its own
    names = {category: "_category", category_order: "_order", **({category_url: "_url"} if category_url else {}), "item": "payload"}
    keyed = rows.withColumnsRenamed(names).withColumn("product_id", F.get_json_object("payload", "$.id"))
    enriched = enrich_products(keyed, details, options, "product_id", order, "idx", options_limit).drop("product_id")
    records = enrich_gallery(store_records(enriched), galleries)
    shown = normalize_store_product(records)
    url = F.col("_url") if category_url else F.lit("")
    return shown.select(
        *[c for c in shown.columns if c not in names.values()], F.col("_category").alias("source_category_id"),
        F.col("_category").alias("source_category_name"), url.alias("source_category_url"), F.col("_order").alias("source_category_order"),
    )


def catalog_page_listings(pages: DataFrame) -> DataFrame:
    """Listing rows of catalog pages: search hits with all their columns where a page has them, else its product links."""
    hits = embedded_hits(pages)
    order = Window.partitionBy("page_id").orderBy("state_no", "index_name", "result_no", "pos")
    numbered = hits.withColumn("idx", F.row_number().over(order))
    from_hits = normalize_embedded_hit(numbered).withColumn("strategy", F.lit(0))
    from_links = product_link_listings(link_nodes(pages)).drop("page_url").withColumn("strategy", F.lit(1))
    union = from_hits.unionByName(from_links, allowMissingColumns=True)
    best = F.min("strategy").over(Window.partitionBy("page_id"))
    return union.withColumn("_best", best).filter("strategy = _best").drop("_best", "strategy")


def site_catalog(pages: DataFrame, row_limit: int | None = None, k: int | None = None, **vocabulary) -> tuple[DataFrame, DataFrame]:
    """(listings, categories) of each website from its best catalog pages.

    Rows are merged by URL in page order. With a `row_limit`, a page is read as
    long as the pages before it brought fewer rows; what a page adds is the
    number of URLs it is the first to show, so one small table per site decides.
    """
    found = discover_catalog_urls(pages, k, **vocabulary)
    # both tables below are read several times: at most k rows per site, and the rows of those pages
    reached = cut_lineage(
        catalog_to_pages(found, pages).select("site", "rank", "name", F.col("url").alias("category_url"), "page_id")
    )
    # semi join first: only the chosen pages are parsed
    ids = reached.select("page_id").distinct()
    chosen = pages.join(ids, "page_id", "left_semi")
    rows = cut_lineage(catalog_page_listings(chosen).join(reached, "page_id").drop("page_id"))
    with_url = rows.filter("url <> ''")
    owners = with_url.groupBy("site", "url").agg(F.min("rank").alias("rank"))
    added = owners.select("site", "rank").unionByName(rows.filter("url = ''").select("site", "rank"))
    counts = added.groupBy("site", "rank").agg(F.count(F.lit(1)).alias("new_rows"))
    coverage = embedded_coverage(chosen).select("page_id", "api_pages", "warning")
    categories = reached.join(counts, ["site", "rank"], "left").join(coverage, "page_id", "left").withColumns({
        "products_found": F.coalesce("new_rows", F.lit(0)), "api_pages": F.coalesce("api_pages", F.lit(1)),
        "warning": F.coalesce("warning", F.lit("")),
    })
    before = Window.partitionBy("site").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    summary = categories.withColumn("_before", F.coalesce(F.sum("products_found").over(before), F.lit(0)))
    summary = summary.filter(F.col("_before") < (row_limit or NO_LIMIT)).select(
        "site", "rank", "name", "category_url", "products_found", "api_pages", "warning"
    )
    read = rows.join(summary.select("site", "rank"), ["site", "rank"])
    owned = read.withColumn("source_category_url", F.coalesce("source_category_url", "category_url")).drop("name", "category_url")
    merged = merge_by_key(owned, "url", ["rank", "idx"], ["site"])
    return merged, summary

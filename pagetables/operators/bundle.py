"""The seven result tables of a corpus, per site."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetables.functions import html as H
from pagetables.functions.urls import site_of
from pagetables.operators import details, listings as L
from pagetables.operators.catalogs import site_catalog
from pagetables.operators.feeds import (
    SEARCH_MARK,
    detect_platform,
    embedded_categories,
    embedded_coverage,
    embedded_hits,
    normalize_embedded_hit,
)
from pagetables.operators.pages import page_links, resolved_images
from pagetables.operators.ranking import first_per_key, top_k
from pagetables.operators.structured import jsonld_items, structured_rows
from pagetables.sinks.sheets import SHEETS

# --- fixed values: results depend on these exact texts and numbers -----------
COUNTERS = [
    "listings", "detail_pages", "model_numbers", "api_pages", "categories", "images", "links", "metadata",
    "structured_data",
]
SUMMARY_LIMITS = {
    "Detail page limit": 250,
    "Salla product safety limit": 500,
    "Salla category safety limit": 120,
    "Salla total row safety limit": 5000,
}
LISTING_IMAGES = 1000
# --- end of fixed values -----------------------------------------------------


def page_counters(pages: DataFrame) -> DataFrame:
    """Images, links, metadata and JSON-LD items per site, counted inside each page: one small shuffle."""
    per_page = pages.select(
        site_of("url").alias("site"),
        F.size(H.image_array("html")).alias("images"),
        F.size(H.link_array("html")).alias("links"),
        F.size(H.meta_array("html")).alias("metadata"),
        F.size(jsonld_items("html")).alias("structured_data"),
    )
    sums = [F.sum(c).alias(c) for c in ("images", "links", "metadata", "structured_data")]
    return per_page.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), *sums)


def listing_counters(listings: DataFrame) -> DataFrame:
    """Listings, visited detail pages and model numbers per site."""
    return listings.groupBy("site").agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if("visited").alias("detail_pages"),
        F.count_if(F.col("model_number") != "").alias("model_numbers"),
    )


def site_counts(pages: DataFrame, listings: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Nine counters per site. Each table is aggregated before the join, so the join is site-sized."""
    counts = page_counters(pages).join(listing_counters(listings), "site", "left")
    if categories is None:
        counts = counts.withColumn("categories", F.lit(0)).withColumn("api_pages", F.lit(0))
    else:
        per_site = categories.groupBy("site").agg(
            F.count(F.lit(1)).alias("categories"), F.sum("api_pages").alias("api_pages")
        )
        counts = counts.join(per_site, "site", "left")
    return counts.select("site", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTERS])


def site_summary(counts: DataFrame, title: Column, content_type: Column, scraped_at: Column) -> DataFrame:
    """Thirteen field / value rows per site."""
    fields = [
        ("Website", F.col("site")),
        ("Page title", title),
        ("Content type", content_type),
        ("Scraped at", F.date_format(scraped_at, "yyyy-MM-dd HH:mm:ss")),
        ("Listings found", F.col("listings")),
        ("Product detail pages visited", F.col("detail_pages")),
        ("Model numbers found", F.col("model_numbers")),
        ("API pages fetched", F.col("api_pages")),
        ("Categories scraped", F.col("categories")),
        *[(name, F.lit(limit)) for name, limit in SUMMARY_LIMITS.items()],
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("field"), v.cast("string").alias("value")) for n, v in fields])
    exploded = counts.select("site", F.posexplode(rows).alias("idx", "s"))
    return exploded.select("site", "idx", "s.field", "s.value")


def listing_images(listings: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Images of the listings of a site as (src, alt, title), not de-duplicated, the first ones or all."""
    rows = listings.select("site", *order, F.col("title").alias("alt"), "title", F.posexplode("images").alias("pos", "src"))
    rows = rows.filter("src <> ''")
    return rows if limit is None else top_k(rows, ["site"], [*[F.col(o) for o in order], F.col("pos")], limit)


def distinct_image_table(listings: DataFrame, order: list[str]) -> DataFrame:
    """Images of the listings of a site, first one per exact URL."""
    rows = listings.select("site", *order, F.col("title").alias("alt"), "title", F.posexplode("images").alias("pos", "src"))
    return first_per_key(rows.filter("src <> ''"), ["site", "src"], [*[F.col(o) for o in order], F.col("pos")])


def _on_site(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("site", site_of(url))


class Bundle:
    """The page cascade for a whole corpus as seven tables. Each is built when it is first asked for
    and runs when it is written.

    Every page takes the first branch of the mode's cascade that applies to it. Feed and store pages take their
    rows from `products`, listing rows (with site, page_id and url) that `feed_catalog` or `store_listings` made of
    their payloads; where a site has none there, its pages count as plain pages.
    """

    def __init__(
        self, pages: DataFrame, corpus: DataFrame | None = None, mode: str = "auto",
        products: DataFrame | None = None, product_categories: DataFrame | None = None,
    ) -> None:
        self.pages = pages
        self.corpus = pages if corpus is None else corpus  # where detail pages are looked up
        self.mode, self.products, self.product_categories = mode, products, product_categories

    @cached_property
    def routed(self) -> DataFrame:
        """The pages with their site and platform; html is read once for the marks."""
        marks = detect_platform(self.pages, self.mode).select("page_id", "url", "platform")
        label = F.when(F.col("platform").isin("embedded_search", "generic"), F.col("platform"))
        if self.products is None:
            marks = marks.withColumn("platform", F.coalesce(label, F.lit("generic")))
        else:
            fed = self.products.select("site").distinct().withColumn("_fed", F.lit(True))
            known = marks.withColumn("site", site_of("url")).join(fed, "site", "left")
            marks = known.withColumn("platform", F.when(F.col("_fed"), F.coalesce(label, F.lit("products"))).otherwise(F.coalesce(label, F.lit("generic"))))
        return marks.select("page_id", "url", "platform")

    def _pages_of(self, platform: str) -> DataFrame:
        if self.products is None:  # a page tells its platform by itself: no page is joined, moved or made again
            marked = detect_platform(self.pages, self.mode, [c for c in self.pages.columns if c not in ("page_id", "url")])
            # most pages are known by the missing mark alone
            found = F.coalesce(F.contains("html", F.lit(SEARCH_MARK)), F.lit(False)) & (F.col("platform") == "embedded_search")
            named = F.col("page_id").isNotNull() & F.col("url").isNotNull()
            return marked.filter(named & (found if platform == "embedded_search" else ~found)).select(*self.pages.columns)
        chosen = self.routed.filter(F.col("platform") == platform).select("page_id", "url")
        return self.pages.join(chosen, ["page_id", "url"], "left_semi")

    @cached_property
    def catalog(self) -> tuple[DataFrame, DataFrame]:
        """Listings and categories of whole websites, in website mode."""
        return site_catalog(self._pages_of("generic"))

    @cached_property
    def listings(self) -> DataFrame:
        search = self._pages_of("embedded_search")
        order = Window.partitionBy("page_id").orderBy("state_no", "index_name", "result_no", "pos")
        hits = embedded_hits(search).withColumn("page_url", F.col("url")).withColumn("idx", F.row_number().over(order))
        found = _on_site(normalize_embedded_hit(hits), "page_url").withColumn("visited", F.lit(True))
        if self.mode == "website":
            plain = self.catalog[0].withColumn("visited", F.lit(True)).withColumn("detail_status", F.lit("OK"))
            plain = plain.withColumn("model_number", F.coalesce("model_number", F.lit("")))
        else:
            listed = L.page_listings(L.listing_nodes(self._pages_of("generic")))
            # details are made for wanted pages only
            wanted = listed.select(details.url_key("url").alias("_key")).distinct()
            looked = self.corpus.join(wanted, details.url_key(self.corpus["url"]) == wanted["_key"], "left_semi")
            plain = _on_site(details.enrich_details(listed, details.page_detail(looked)), "page_url")
        rows = found.unionByName(plain, allowMissingColumns=True)
        if self.products is not None:
            fed = self.products.withColumn("visited", F.lit(True))
            rows = rows.unionByName(fed, allowMissingColumns=True)
        return rows

    @cached_property
    def categories(self) -> DataFrame:
        coverage = embedded_coverage(self.pages).select("page_id", "api_pages", "warning")
        rows = _on_site(embedded_categories(self.pages)).join(coverage, "page_id")
        # the pages of results are counted once for a page, on its first category
        first = Window.partitionBy("page_id").orderBy("name")
        rows = rows.withColumn("api_pages", F.when(F.row_number().over(first) == 1, F.col("api_pages")).otherwise(0))
        if self.mode == "website":
            rows = rows.unionByName(self.catalog[1].withColumnRenamed("category_url", "url"), allowMissingColumns=True)
        if self.product_categories is not None:
            rows = rows.unionByName(self.product_categories, allowMissingColumns=True)
        return rows

    @cached_property
    def images(self) -> DataFrame:
        rows = self.pages.select("page_id", site_of("url").alias("site"), F.posexplode(resolved_images()).alias("pos", "i"))
        return rows.select("page_id", "pos", "i.src", "i.alt", "i.title", "site")

    @cached_property
    def links(self) -> DataFrame:
        return page_links(self.pages).withColumn("site", site_of("page_url")).drop("page_url")

    @cached_property
    def metadata(self) -> DataFrame:
        rows = self.pages.select("page_id", site_of("url").alias("site"), F.posexplode(H.meta_array("html")).alias("pos", "m"))
        return rows.select("page_id", "pos", "m.name", "m.content", "site")

    @cached_property
    def structured_data(self) -> DataFrame:
        return structured_rows(self.pages.withColumn("site", site_of("url")), ["page_id", "site"])

    @cached_property
    def counts(self) -> DataFrame:
        return site_counts(self.pages, self.listings, self.categories)

    @cached_property
    def summary(self) -> DataFrame:
        """Title of a site: that of its first page."""
        first = F.min_by(F.struct("page_id", H.title_text("html").alias("title")), "page_id")
        titles = self.pages.groupBy(site_of("url").alias("site")).agg(first.alias("_first"))
        titled = self.counts.join(titles, "site").withColumn("_title", F.col("_first.title"))
        return site_summary(titled, F.col("_title"), F.lit("text/html"), F.current_timestamp())

    def tables(self) -> dict[str, DataFrame]:
        names = dict(zip(SHEETS, [
            "summary", "listings", "categories", "images", "links", "metadata", "structured_data"
        ]))
        return {sheet: getattr(self, attribute) for sheet, attribute in names.items()}

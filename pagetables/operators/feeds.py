"""Product payloads to listing rows: feed products, store products, search hits.

All three normalisers are row-wise over the payload of one product. Roll-ups
also exist as aggregates for products whose variants are separate rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetables.functions import payload as J
from pagetables.functions import urls as U
from pagetables.functions.html import link_array
from pagetables.functions.images import IMAGE_HOSTS, dedup_by_key, image_urls_in_text
from pagetables.functions.text import (
    clean_text,
    concat_distinct,
    first_truthy,
    float_text,
    html_to_text,
    let,
    model_from_text,
    title_case,
)
from pagetables.operators.ranking import first_per_key
from pagetables.sources.payloads import STATE_PATTERN, read_embedded_state

# --- fixed values: results depend on these exact texts -----------------------
FEED_SOURCE, STORE_SOURCE, SEARCH_SOURCE = "shopify_api", "salla_api", "embedded_product_search"
FEED_MARKERS = r"(?i)cdn\.shopify\.com|Shopify\.theme|shopify-section|myshopify\.com"
STORE_ID = r'"store"\s*:\s*\{\s*"id"\s*:\s*(\d+)'
LIST_CATEGORY = (
    r"""(?i)<salla-products-list\b[^>]*\bsource=["']categories["'][^>]*\bsource-value=["'](\d+)["']"""
)
GALLERY = r"""(?i)<salla-slider[^>]+id=["']details-slider-([^"']+)["'][\s\S]*?</salla-slider>"""
HOST_BRANDS = {"castlery.": "Castlery"}
SEARCH_MARK = "InstantSearchInitialResults"
# --- end of fixed values -----------------------------------------------------

FEED_PRODUCT = (
    "id string, title string, handle string, body_html string, vendor string, product_type string, "
    "images array<string>, variants array<struct<sku:string,barcode:string,price:string,"
    "compare_at_price:string,available:string,inventory_quantity:string,grams:string>>"
)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _numbers(array: Column, field: str) -> Column:
    return F.filter(F.transform(array, lambda v: v[field].try_cast("double")), lambda n: n.isNotNull())


def _sale(price: Column, regular: Column, price_text: Column) -> Column:
    """The price when it is below the regular one, neither being blank nor zero."""
    lower = (price != 0) & (regular != 0) & (price < regular)
    return F.when(F.coalesce(lower, F.lit(False)), price_text).otherwise(F.lit(""))


def normalize_feed_product(products: DataFrame, base: Column | str, category: Column | None = None) -> DataFrame:
    """Listing rows of feed products (`payload` JSON). `category` is STRUCT<id, title, url> in collection mode."""
    parsed = products.withColumn("_p", F.from_json("payload", FEED_PRODUCT))
    variants = F.coalesce(F.col("_p.variants"), F.from_json(F.lit("[]"), "array<struct<sku:string,barcode:string,"
                          "price:string,compare_at_price:string,available:string,inventory_quantity:string,grams:string>>"))
    first = F.get(variants, F.lit(0))
    images = F.transform(
        F.col("_p.images"),
        lambda i: F.when(i.startswith("{"), F.get_json_object(i, "$.src")).otherwise(i),
    )
    regular = F.array_max(F.filter(_numbers(variants, "compare_at_price"), lambda n: n != 0))
    rolled = parsed.select(
        "*",
        first.alias("_first"),
        F.array_min(_numbers(variants, "price")).alias("_price"),
        regular.alias("_regular"),
        F.exists(variants, lambda v: ~F.coalesce(v["available"].isin("false", "0", ""), F.lit(True))).alias("_available"),
        F.aggregate(
            variants, F.lit(0).cast("bigint"),
            lambda acc, v: acc + F.coalesce(v["inventory_quantity"].try_cast("bigint"), F.lit(0)),
        ).alias("_quantity"),
        F.size(variants).alias("variant_count"),
        dedup_by_key(images).alias("images"),
        html_to_text("_p.body_html").alias("description"),
        (F.lit(None).cast("struct<id:string,title:string,url:string>") if category is None else category).alias("_c"),
    )
    price = F.coalesce(float_text("_price"), F.col("_first.price"))
    regular_text = F.coalesce(float_text("_regular"), F.col("_first.compare_at_price"))
    category_name = _blank(first_truthy("_c.title", "_p.product_type"))
    kept = [c for c in products.columns if c != "payload"]
    return rolled.select(
        *kept,
        F.lit(FEED_SOURCE).alias("source"),
        _blank(F.col("_p.id")).alias("product_id"),
        _blank(F.col("_p.title")).alias("title"),
        _blank(F.col("_p.title")).alias("name"),
        _blank(first_truthy("_first.sku", "_first.barcode")).alias("model_number"),
        _blank(F.col("_first.sku")).alias("sku"),
        F.lit("").alias("mpn"),
        _blank(F.col("_first.barcode")).alias("gtin"),
        _blank(price).alias("price"),
        _blank(regular_text).alias("regular_price"),
        _sale(
            F.coalesce(F.col("_price"), F.col("_first.price").try_cast("double")),
            F.coalesce(F.col("_regular"), F.col("_first.compare_at_price").try_cast("double")),
            price,
        ).alias("sale_price"),
        F.lit("").alias("currency"),
        F.when(F.col("_available"), F.lit("available")).otherwise(F.lit("unavailable")).alias("status"),
        F.col("_available").alias("is_available"),
        (~F.col("_available")).alias("is_out_of_stock"),
        F.col("_quantity").alias("quantity"),
        _blank(F.col("_first.grams")).alias("weight"),
        category_name.alias("category"),
        _blank(F.col("_p.vendor")).alias("brand"),
        F.size("images").alias("image_count"),
        _blank(F.get("images", F.lit(0))).alias("image"),
        F.array_join("images", " | ").alias("all_images"),
        "images",
        F.concat(base if isinstance(base, Column) else F.col(base), F.lit("/products/"), _blank(F.col("_p.handle"))).alias("url"),
        "description",
        F.col("description").alias("detail_description"),
        F.lit("OK").alias("detail_status"),
        _blank(F.col("_c.id")).alias("source_category_id"),
        category_name.alias("source_category_name"),
        _blank(F.col("_c.url")).alias("source_category_url"),
        "variant_count",
        F.coalesce(F.get_json_object("payload", "$.variants"), F.lit("[]")).alias("all_variants"),
        F.col("payload").alias("raw_json"),
        J.flatten_payload("payload", "api_").alias("extra"),
    )


def variant_rollup(variants: DataFrame, product: str, order: Sequence[str]) -> DataFrame:
    """Per product over variant rows: one aggregate with map-side combine, so a product with very
    many variants costs one partial row per task. The first variant in `order` gives the fallbacks."""
    first = F.min_by(F.struct("sku", "barcode", "price", "compare_at_price", "grams"), F.struct(*order))
    compare = F.nullif(F.col("compare_at_price").try_cast("double"), F.lit(0.0))
    rolled = variants.groupBy(product).agg(
        F.min(F.col("price").try_cast("double")).alias("_price"),
        F.max(compare).alias("_regular"),
        F.coalesce(F.bool_or("available"), F.lit(False)).alias("is_available"),
        F.coalesce(F.sum("inventory_quantity"), F.lit(0)).cast("bigint").alias("quantity"),
        F.count(F.lit(1)).alias("variant_count"),
        first.alias("_first"),
    )
    price = F.coalesce(float_text("_price"), F.col("_first.price"), F.lit(""))
    return rolled.select(
        product,
        _blank(F.col("_first.sku")).alias("sku"),
        _blank(F.col("_first.barcode")).alias("gtin"),
        price.alias("price"),
        F.coalesce(float_text("_regular"), F.col("_first.compare_at_price"), F.lit("")).alias("regular_price"),
        _sale(
            F.coalesce(F.col("_price"), F.col("_first.price").try_cast("double")),
            F.coalesce(F.col("_regular"), F.col("_first.compare_at_price").try_cast("double")),
            price,
        ).alias("sale_price"),
        "is_available", "quantity",
        _blank(F.col("_first.grams")).alias("weight"),
        "variant_count",
    )


def hit_rollup(variants: DataFrame, hit: str, order: Sequence[str]) -> DataFrame:
    """Per search hit over variant rows: lowest price, lowest list price, first and distinct skus."""
    at = F.struct(*order)
    per_sku = variants.groupBy(hit, "sku").agg(
        F.min(at).alias("at"),
        F.min(F.col("price").try_cast("double")).alias("price"),
        F.min(F.col("list_price").try_cast("double")).alias("list_price"),
        F.count(F.lit(1)).alias("n"),
    )
    rolled = per_sku.groupBy(hit).agg(
        F.min("price").alias("_price"),
        F.min("list_price").alias("_regular"),
        F.sum("n").alias("variant_count"),
        F.min_by("sku", "at").alias("sku"),
        F.count(F.lit(1)).alias("sku_count"),
    )
    price, regular = float_text("_price"), float_text("_regular")
    differs = (F.col("_price") != 0) & (F.col("_regular") != 0) & (price != regular)
    return rolled.select(
        hit, price.alias("price"), regular.alias("regular_price"),
        F.when(F.coalesce(differs, F.lit(False)), price).otherwise(F.lit("")).alias("sale_price"),
        "sku", "sku_count", "variant_count",
    )


def enrich_products(
    products: DataFrame, details: DataFrame, options: DataFrame, key: str, order: Sequence[str],
    idx: str = "idx", options_limit: int | None = None,
) -> DataFrame:
    """product ⟕ detail ⟕ options on the product id.

    The last record of an id in `order` counts, so both lookups have one row per id and the joins keep the number of
    products. `options_limit` leaves options to the first products of a category.
    """
    def last(records: DataFrame, name: str) -> DataFrame:
        latest = F.max_by("payload", F.struct(*order))
        return records.groupBy(F.col(key).alias(f"_{name}_key")).agg(latest.alias(name))

    within = F.lit(True) if options_limit is None else F.col(idx) <= options_limit
    return (
        # payloads derived from a small file would be broadcast by the guess at their size
        products.join(last(details, "detail").hint("merge"), F.col(key) == F.col("_detail_key"), "left")
        .join(last(options, "options").hint("merge"), (F.col(key) == F.col("_options_key")) & within, "left")
        .drop("_detail_key", "_options_key")
    )


def gallery_images(pages: DataFrame, hosts: Sequence[str] = IMAGE_HOSTS) -> DataFrame:
    """Gallery of each product on its page: the first slider per page and product id."""
    sliders = F.regexp_extract_all("html", F.lit(f"({GALLERY})"), F.lit(1))
    rows = pages.select("page_id", "url", F.posexplode(sliders).alias("pos", "slider"))
    shaped = rows.select(
        "page_id", F.col("url").alias("page_url"), "pos",
        F.regexp_extract("slider", GALLERY, 1).alias("product_id"),
        dedup_by_key(image_urls_in_text("slider", hosts)).alias("gallery"),
    )
    return first_per_key(shaped, ["page_id", "product_id"], [F.col("pos")]).drop("pos")


def store_records(enriched: DataFrame) -> DataFrame:
    """Parse product, detail and options; their overlay decides about images. `all_product_json` is all three as one object."""
    records = enriched.select(
        "*", J.fields("payload").alias("_p"), J.fields("detail").alias("_d"), J.fields("options").alias("_o")
    )
    whole = F.array(F.col("payload"), prefixed("detail", "detail_"), prefixed("options", "options_"))
    parts = F.transform(F.filter(whole, lambda t: t.isNotNull()), lambda t: F.regexp_replace(F.trim(t), r"^\{\s*|\s*\}$", ""))
    joined = F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda t: t != ""), ","), F.lit("}"))
    return records.withColumn("all_product_json", joined).withColumn("images", J.product_images("payload", "detail", "options"))


def prefixed(column: str, prefix: str) -> Column:
    """JSON object with a prefix before each of its keys."""
    kept = F.from_json(F.col(column), "map<string,variant>")
    return F.to_json(F.transform_keys(kept, lambda k, _: F.concat(F.lit(prefix), k)))


def enrich_gallery(records: DataFrame, galleries: DataFrame) -> DataFrame:
    """Products with fewer than two images take the images of their page gallery as well."""
    url = J.first_truthy_text((F.col("_d"), "url"), (F.col("_p"), "url"))
    one = first_per_key(galleries, ["page_url", "product_id"], [F.col("page_id")]).select(
        F.col("page_url").alias("_gu"), F.col("product_id").alias("_gp"), "gallery"
    )
    keyed = records.withColumn("_url", url).withColumn("_id", J.scalar_text(F.col("_p")["id"]))
    joined = keyed.join(
        one, (F.size("images") < 2) & (F.col("_url") == F.col("_gu")) & (F.col("_id") == F.col("_gp")), "left"
    )
    both = dedup_by_key(F.concat("images", F.coalesce(F.col("gallery"), F.array().cast("array<string>"))))
    return joined.withColumn("images", both).drop("_url", "_id", "_gu", "_gp", "gallery")


def normalize_store_product(records: DataFrame) -> DataFrame:
    """Listing rows of store products; detail values win over list values."""
    p, d = F.col("_p"), F.col("_d")

    def either(key: str) -> Column:
        return J.first_truthy_text((d, key), (p, key))

    described = records.withColumn("description", html_to_text(either("description")))
    model_fields = [(r, k) for k in ("model", "model_number", "sku", "mpn") for r in (d, p)]
    model = F.coalesce(F.nullif(J.first_truthy_text(*model_fields), F.lit("")), model_from_text("description"))
    kept = [c for c in records.columns if c not in ("payload", "detail", "options", "_p", "_d", "_o", "images", "all_product_json")]
    return described.select(
        *kept,
        F.lit(STORE_SOURCE).alias("source"),
        J.first_truthy_text((p, "id"), (d, "id")).alias("product_id"),
        either("name").alias("title"),
        either("name").alias("name"),
        model.alias("model_number"),
        *[either(k).alias(k) for k in ("sku", "mpn", "gtin", "price", "regular_price", "sale_price", "currency", "status")],
        *[J.present_or(d, p, k).alias(k) for k in ("is_available", "is_out_of_stock", "quantity", "weight")],
        J.nested_text("payload", "category", "name").alias("category"),
        J.nested_text("payload", "brand", "name").alias("brand"),
        F.size("images").alias("image_count"),
        _blank(F.get("images", F.lit(0))).alias("image"),
        F.array_join("images", " | ").alias("all_images"),
        "images",
        either("url").alias("url"),
        "description",
        F.col("description").alias("detail_description"),
        F.lit("OK").alias("detail_status"),
        F.col("all_product_json").alias("raw_json"),
        J.overlay(
            J.flatten_payload("payload", "api_"),
            J.flatten_payload(F.coalesce("detail", F.lit("{}")), "api_detail_"),
            J.flatten_payload(F.coalesce("options", F.lit("{}")), "api_options_"),
        ).alias("extra"),
    )


def normalize_embedded_hit(hits: DataFrame, base: Column | str = "url", brands: Mapping[str, str] = HOST_BRANDS) -> DataFrame:
    """Listing rows of search hits (`hit` JSON)."""
    base = base if isinstance(base, Column) else F.col(base)
    record = hits.withColumn("_h", J.fields("hit"))
    listed = J.elements(F.when(F.col("_h")["variants"]["kind"] == "ARRAY", F.col("_h")["variants"]["text"]))
    record = record.withColumn("_all", listed)
    objects = F.transform(F.filter("_all", lambda e: e["kind"] == "OBJECT"), lambda e: J.fields(e["text"]))
    lead = F.get("_all", F.lit(0))
    record = record.select(
        "*", objects.alias("_v"), J.fields(F.when(lead["kind"] == "OBJECT", lead["text"])).alias("_first")
    )
    first = F.col("_first")
    skus = F.filter(F.transform("_v", lambda v: J.truthy_text(v, "sku")), lambda s: s.isNotNull())
    taxons = F.transform(
        F.filter(J.elements(F.when(F.col("_h")["taxons"]["kind"] == "ARRAY", F.col("_h")["taxons"]["text"])),
                 lambda e: e["kind"] == "OBJECT"),
        lambda e: let(J.fields(e["text"]), lambda taxon: J.truthy_text(taxon, "name")),
    )

    def lowest(key: str) -> Column:
        return F.array_min(F.transform("_v", lambda v: v[key]["text"].try_cast("double")))

    record = record.select(
        "*", skus.alias("_skus"), lowest("price").alias("_price"), lowest("list_price").alias("_regular"),
        J.collect_images("hit").alias("images"),
    )
    price = F.coalesce(float_text("_price"), J.scalar_text(first["price"]))
    regular = F.coalesce(float_text("_regular"), J.scalar_text(first["list_price"]))
    differs = (price != "") & (regular != "") & (price != regular)
    nonzero = (F.coalesce(F.col("_price"), F.lit(1.0)) != 0) & (F.coalesce(F.col("_regular"), F.lit(1.0)) != 0)
    host, brand = U.url_part(base, "authority"), F.lit("")
    for part, label in brands.items():
        brand = F.when(F.contains(host, F.lit(part)), F.lit(label)).otherwise(brand)
    h = F.col("_h")
    kept = [c for c in hits.columns if c not in ("hit", "url")]
    return record.select(
        *kept,
        F.lit(SEARCH_SOURCE).alias("source"),
        J.first_truthy_text((h, "id"), (h, "objectID")).alias("product_id"),
        J.first_truthy_text((h, "name"), (first, "name")).alias("title"),
        J.first_truthy_text((h, "name"), (first, "name")).alias("name"),
        _blank(F.get("_skus", F.lit(0))).alias("model_number"),
        F.coalesce(F.get("_skus", F.lit(0)), J.scalar_text(first["sku"])).alias("sku"),
        concat_distinct("_skus").alias("all_skus"),
        price.alias("price"),
        regular.alias("regular_price"),
        F.when(differs & nonzero, price).otherwise(F.lit("")).alias("sale_price"),
        brand.alias("brand"),
        concat_distinct(F.filter(taxons, lambda t: t.isNotNull())).alias("category"),
        J.scalar_text(first["lead_time_presentation"]).alias("availability"),
        F.when(
            F.map_contains_key(first, "available_quantity"),
            F.when(J.is_truthy(first["available_quantity"]), F.lit("True")).otherwise(F.lit("False")),
        ).otherwise(F.lit("")).alias("is_available"),
        J.scalar_text(first["available_quantity"]).alias("quantity"),
        F.size("images").alias("image_count"),
        _blank(F.get("images", F.lit(0))).alias("image"),
        F.array_join("images", " | ").alias("all_images"),
        "images",
        U.product_url(base, F.coalesce(J.truthy_text(h, "slug"), F.lit(""))).alias("url"),
        base.alias("source_category_url"),
        F.size("_all").alias("variant_count"),
        F.lit("OK").alias("detail_status"),
        F.col("hit").alias("raw_json"),
        J.flatten_payload(
            F.when(first["properties"]["kind"] == "OBJECT", first["properties"]["text"]), "property_"
        ).alias("extra"),
    )


def embedded_hits(pages: DataFrame) -> DataFrame:
    """One row per hit, in page order."""
    sets = read_embedded_state(pages)
    return sets.select("page_id", "url", "state_no", "index_name", "result_no", F.posexplode("hits").alias("pos", "hit"))


def embedded_coverage(pages: DataFrame) -> DataFrame:
    """Per page: pages of results, hits promised and rendered, and the warnings of the sets that miss some, in their order."""
    text = F.format_string("%s exposes %d product results but only %d are on the page", "url", "nb_hits", "rendered")
    missing = F.col("nb_hits") > F.col("rendered")
    place = F.struct("state_no", "index_name", "result_no", text.alias("text"))
    per_set = read_embedded_state(pages).withColumn("missing", missing).withColumn("said", F.when(missing, place))
    rolled = per_set.groupBy("page_id", "url").agg(
        F.max("nb_pages").alias("api_pages"),
        F.sum("nb_hits").alias("nb_hits"),
        F.sum("rendered").alias("rendered"),
        F.count_if("missing").alias("incomplete_sets"),
        F.array_sort(F.collect_list("said")).alias("said"),  # no more than a page has result sets
    )
    return rolled.withColumn("warning", F.array_join(F.transform("said", lambda w: w["text"]), " ")).drop("said")


def embedded_categories(pages: DataFrame) -> DataFrame:
    rows = read_embedded_state(pages).select("page_id", "url", F.explode("facets").alias("name", "products_found"))
    return rows.select("page_id", "name", "products_found", "url")


def detect_platform(pages: DataFrame, mode: str = "auto", kept: Sequence[str] = ()) -> DataFrame:
    """Label of each page: the first branch of the mode's cascade that applies.

    Markers are tested once per page inside one projection; nothing is joined. The columns `kept` pass.
    """
    if mode not in ("auto", "website", "category"):
        raise ValueError(f"unknown mode {mode!r}")
    marks = pages.select(
        "page_id",
        "url",
        *kept,
        F.col("html").rlike(FEED_MARKERS).alias("feed"),
        (U.collection_handle("url") != "").alias("has_handle"),
        (F.regexp_extract("html", STORE_ID, 1) != "").alias("store"),
        ((U.category_id("url") != "") | (F.regexp_extract("html", LIST_CATEGORY, 1) != "")).alias("category"),
        F.when(
            F.contains("html", F.lit('"store"')),
            F.exists(link_array("html"), lambda l: l["href"].rlike(r"/c\d")),
        ).otherwise(F.lit(False)).alias("lists_categories"),
        F.when(
            F.contains("html", F.lit(SEARCH_MARK)),
            F.exists(
                F.regexp_extract_all("html", F.lit(STATE_PATTERN), F.lit(1)),
                lambda s: F.try_parse_json(s).isNotNull() & s.rlike(r'"hits"\s*:\s*\[\s*\{'),
            ),
        ).otherwise(F.lit(False)).alias("search"),
    )
    feed = F.when(F.col("feed"), F.lit("feed_store"))
    if mode == "category":
        feed = F.when(F.col("feed") & ~F.col("has_handle"), F.lit("error: collection link needed")).otherwise(feed)
    site = F.when(F.col("store") & ~F.col("category") & F.col("lists_categories"), F.lit("store_api_site"))
    one = F.when(F.col("store") & F.col("category"), F.lit("store_api_category"))
    search = F.when(F.col("search"), F.lit("embedded_search"))
    cascade = {"auto": [feed, site, one, search], "category": [feed, one, search], "website": [feed, site, search]}
    return marks.select("page_id", "url", *kept, F.coalesce(*cascade[mode], F.lit("generic")).alias("platform"))


def collection_title(handle: Column | str) -> Column:
    return clean_text(title_case(F.replace(handle, F.lit("-"), F.lit(" "))))

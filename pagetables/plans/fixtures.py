"""Pages and payloads that Spark derives from the `part` table, one row in, one row out.

The crawl itself is not part of this library, so the queries get crawled
material by writing each part down as a page or as an API answer. The SQL twins
compute the expected result straight from the columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetables.plans.registry import table

SHOP = "'https://shop' || p_size || '.example.com'"
ROWS_PER_TASK = 2_500


def parts(spark: SparkSession, folder: str) -> DataFrame:
    """The parts, dealt over tasks by their number: some 30 bytes on disk become a page of kilobytes, so splits of the
    file, which follow its bytes, would leave all pages to very few tasks. The number comes from the file's footer."""
    rows = table(spark, folder, "part")
    tasks = -(-rows.count() // ROWS_PER_TASK)
    # a filter on a derived page goes down to its parts; one that depends on the task keeps it behind the exchange
    return rows.repartition(tasks).filter(F.spark_partition_id() >= 0) if tasks > 1 else rows


def _pages(spark, folder, url: str, html: str) -> DataFrame:
    # exploded, so that a page is made once for all filters and columns that read it
    return parts(spark, folder).selectExpr("p_partkey AS page_id", f"{url} AS url", f"explode(array({html})) AS html")


def shop_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Product pages with meta tags, image variants and links."""
    html = """
    '<!DOCTYPE html><html><head><meta charset="utf-8"><title>' || p_name || ' &amp; more</title>'
    || '<META NAME="description" content="  ' || p_name || '   by ' || p_brand || ' ">'
    || '<meta property=\\'og:type\\' content=\\'' || p_type || '\\'><meta itemprop=sku content=S' || p_partkey || '>'
    || '<meta name="x" content=""><!-- <meta name="no" content="no"><img src="no.jpg"> --></head><body>'
    || '<img src="/img/' || p_partkey || '-a.jpg" alt="' || p_name || '" title="Size &amp; ' || p_size || '">'
    || '<img data-src="../pics/' || p_partkey || '.png" alt=\\'one  two\\'>'
    || '<img srcset="/s/' || p_partkey || '-320.jpg 320w, /s/' || p_partkey || '-640.jpg 640w"><img alt="none">'
    || '<a href="/en-us/products/p-' || p_partkey || 'x"><img src="/t/' || p_partkey || '.jpg" alt="Alt ' || p_name || '"></a>'
    || '<a href="/en-us/products/p-' || p_partkey || 'x">Again</a>'
    || '<a href="/en-us/products/q-' || p_partkey || '-red-sofa?ref=1">' || p_name || '<b> for </b>$ ' || p_size || '.00</a>'
    || '<a href="https://other.example.org/products/z">other</a><a href="/en-us/item/' || p_brand || '">Item</a>'
    || '<a href="/c' || p_size || '"></a><a href="/kind-' || p_type || '/c7">عرض الكل</a><a href="/k/c7">Second</a></body></html>'
    """
    return _pages(spark, folder, f"{SHOP} || '/en-us/list/' || p_partkey", html)


def card_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose products are cards, one card repeated."""
    html = """
    '<html><body><nav class="menu item"><a href="/x">Menu of the shop with a long enough text</a></nav>'
    || '<div class="grid">'
    || '<article class="product-card"><a href="/d/' || p_partkey || '"><h2>' || p_name || '</h2></a><img src="/i/' || p_partkey || '.jpg" alt="A">'
    || '<span>$' || p_size || '.99</span><p>A text that is long enough to count as a card.</p></article>'
    || '<article class="product-card"><a href="/d/' || p_partkey || '"><h2>Other ' || p_name || '</h2></a><img src="/i/b.jpg">'
    || '<span>$9.99</span><p>Same link with another text that is long enough.</p></article>'
    || '<li class="tile"><a href="/d2/' || p_partkey || '">' || p_type || ' of ' || p_brand || ' from $5.00 and up</a><img src="/i/c.jpg"></li>'
    || '</div></body></html>'
    """
    return _pages(spark, folder, f"{SHOP} || '/cards/' || p_partkey", html)


def jsonld_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Product pages with JSON-LD: a product, a list with a stray text, and a broken script."""
    html = """
    '<html><head><title>' || p_name || '</title><script type="application/ld+json">'
    || '{"@context":"https://schema.org","@type":"Product","name":"' || p_name || '",'
    || (CASE WHEN p_size > 25 THEN '"Brand":{"@type":"Brand","name":"' || p_brand || '"},' ELSE '"manufacturer":" ' || p_brand || ' ",' END)
    || (CASE WHEN p_size < 40 THEN '"sku":"S' || p_partkey || '",' ELSE '' END)
    || '"productID":' || p_partkey || ',"inStock":true,"note":null,"image":["https://i.example.com/' || p_partkey || '.jpg"],'
    || '"weight":{"value":' || p_size || '},"category":["' || p_type || '",{"name":"' || p_brand || '"},""],'
    || '"offers":{"@type":"Offer",' || (CASE WHEN p_size > 10 THEN '"price":' ELSE '"highPrice":1,"lowPrice":' END) || p_retailprice || ','
    || '"availability":"https://schema.org/InStock"}}'
    || '</script><SCRIPT TYPE="application/LD+json">'
    || '[{"@type":"ItemList","itemListElement":[{"@type":"ListItem","position":1,"item":{"name":"hidden"}},{"@type":"ListItem","position":2}]},"stray"]'
    || '</SCRIPT><script type="application/ld+json">{"broken":</script><script>var x = {"name":"no"}</script></head>'
    || '<body><h1>' || p_name || '</h1><img src="/a/' || p_partkey || '.jpg"><img src="b.jpg">'
    || '<p>Model number: MX-' || p_partkey || ' Price: $' || p_size || '.50</p></body></html>'
    """
    return _pages(spark, folder, f"{SHOP} || '/d/' || p_partkey", html)


# one search hit per part; variants 0 .. p_size / 10
HIT = """
    '{"objectID":"O' || p_partkey || '","name":"' || p_name || '","slug":"' || p_name || '-' || p_partkey || '",'
    || '"taxons":[{"name":"' || p_type || '"},{"name":"' || p_brand || '"},{"name":"' || p_type || '"},{"id":1}],'
    || '"images":[{"url":"https://i.example.com/h-' || p_partkey || '-100x100.jpg"},{"url":"https://i.example.com/h-' || p_partkey || '-200x200.jpg"}],'
    || '"variants":['
    || array_join(transform(sequence(0, p_size div 10), i ->
         '{' || (CASE WHEN i = 0 AND p_size < 15 THEN '"sku":null,' WHEN i = 3 THEN '"sku":"S' || p_partkey || '-1",'
                 ELSE '"sku":"S' || p_partkey || '-' || i || '",' END)
         || (CASE WHEN p_size < 20 THEN '' ELSE '"available_quantity":' || (p_size - 25) || ',' END)
         || '"price":' || (CASE WHEN i = 1 THEN '"call"' ELSE CAST(round(p_retailprice + i, 2) AS STRING) END) || ','
         || '"list_price":' || round(p_retailprice + (CASE WHEN p_size > 30 THEN 5 ELSE 0 END), 2) || ','
         || '"lead_time_presentation":"Ships in ' || p_size || ' days","properties":{"color":"' || p_brand || '","legs":' || i || '}}'), ',')
    || ']}'
"""


def search_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that carry search results in a script."""
    html = f"""
    '<html><body><script>window[Symbol.for("InstantSearchInitialResults")] = {{"items":{{"results":[{{"hits":[]}},{{"nbHits":' || p_size
    || (CASE WHEN p_size > 20 THEN ',"nbPages":3' ELSE '' END)
    || ',"facets":{{"category":{{"' || p_type || '":' || p_size || ',"all":' || p_partkey || '}}}},"hits":[' || {HIT} || ']}}]}},"n":1}}</script></body></html>'
    """
    return _pages(spark, folder, f"{SHOP} || '/en-us/search/' || p_partkey", html)


def feed_products(spark: SparkSession, folder: str) -> DataFrame:
    """product_id, site, payload of the feed dialect; no variants above size 45."""
    payload = """
    '{"id":' || p_partkey || ',"title":"' || p_name || '","handle":"p-' || p_partkey || '","vendor":"' || p_brand || '",'
    || '"product_type":"' || p_type || '","body_html":"<p>' || p_name || '<br>' || p_type || ' &amp; more</p>",'
    || '"images":[' || array_join(transform(sequence(0, p_size div 17), j ->
         '{"src":"https://cdn.example.com/f/' || (CASE WHEN j = 2 THEN 'alt-' ELSE 'img-' END) || p_partkey || '-' || ((j + 1) * 100) || 'x' || ((j + 1) * 100) || '.jpg"}'), ',')
    || '],"variants":[' || (CASE WHEN p_size > 45 THEN '' ELSE array_join(transform(sequence(0, p_size div 10), i ->
         '{"sku":"' || (CASE WHEN p_size < 5 THEN '' ELSE 'S' || p_partkey || '-' || i END) || '","barcode":"B' || p_partkey || '",'
         || '"price":"' || (CASE WHEN i = 1 THEN 'n/a' ELSE CAST(round(p_retailprice + i * 10, 2) AS STRING) END) || '",'
         || '"compare_at_price":' || (CASE WHEN i = 0 THEN 'null' WHEN i = 2 THEN '"0"' ELSE '"' || round(p_retailprice + 5 * i, 2) || '"' END) || ','
         || '"available":' || (i > 0 AND p_size - 10 * i > 20) || ',"inventory_quantity":' || (p_size - i) || ',"grams":' || (p_size * 100) || '}'), ',') END)
    || ']}'
    """
    return parts(spark, folder).selectExpr(
        "p_partkey", "'store-' || (p_partkey div 40) AS site", "p_size", "(p_partkey - 40 * (p_partkey div 40)) div 10 + 1 AS page_no",
        f"{payload} AS payload",
    )


def feed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered API pages: 40 product numbers per store, 10 per page, products above size 48 are missing."""
    rows = feed_products(spark, folder).filter("p_size <= 48")
    listed = F.sort_array(F.collect_list(F.struct("p_partkey", "payload")))
    grouped = rows.groupBy("site", F.col("page_no").cast("int").alias("page_no")).agg(listed.alias("l"))
    return grouped.select("site", "page_no", F.transform("l", lambda e: e["payload"]).alias("items"))


STORE_LIST = """
    '{"id":' || p_partkey || ',"name":"' || p_name || '","model":' || (CASE WHEN p_size > 40 THEN '"MD-' || p_partkey || '"' ELSE 'null' END)
    || ',"sku":"","price":' || p_retailprice || ',"regular_price":0,"currency":"SAR","status":"sale","quantity":' || p_size
    || ',"is_available":' || (p_size > 3) || ',"category":{"id":1,"name":"' || p_type || '"},"brand":' ||
       (CASE WHEN p_size > 5 THEN '{"name":"' || p_brand || '"}' ELSE 'null' END)
    || ',"url":"https://store.example.com/p' || p_partkey || '","description":"<div>' || p_name || '</div><p>Item no: IT-' || p_partkey || ' Color: red</p>"'
    || ',"original_image":"https://i.example.com/o-' || p_partkey || '-100x100.jpg","images":[{"url":"https://i.example.com/l-' || p_partkey || '.jpg"}]}'
"""
STORE_DETAIL = """
    '{"id":' || p_partkey || ',"name":"' || (CASE WHEN p_size > 10 THEN 'Detail ' || p_name ELSE '' END) || '","price":' || round(p_retailprice * 0.9, 2)
    || (CASE WHEN p_size < 20 THEN ',"quantity":null,"weight":1.50' ELSE '' END)
    || (CASE WHEN p_size > 12 THEN ',"images":[{"url":"https://i.example.com/o-' || p_partkey || '-300x300.jpg"}]' ELSE '' END)
    || ',"gtin":' || p_partkey || '}'
"""
STORE_OPTIONS = """'{"id":' || p_partkey || ',"options":[],"thumbnail":"https://i.example.com/t-' || p_partkey || '.jpg"}'"""


def store_products(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder).selectExpr("p_partkey", "p_partkey AS idx", f"{STORE_LIST} AS payload")


def store_details(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder).filter("p_size <= 35").selectExpr(
        "p_partkey", f"explode(array(struct(1 AS arrived, 'null' AS payload), struct(2 AS arrived, {STORE_DETAIL} AS payload))) AS r"
    ).select("p_partkey", "r.*")


def store_options(spark: SparkSession, folder: str) -> DataFrame:
    return parts(spark, folder).filter("p_size >= 30").selectExpr("p_partkey", "1 AS arrived", f"{STORE_OPTIONS} AS payload")


def gallery_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Store product pages with a gallery slider for the product and one for another product."""
    html = r"""
    '<html><body><salla-slider id="details-slider-0"><img src="https://cdn.salla.sa/zero.jpg"></salla-slider>'
    || '<salla-slider class="s" id="details-slider-' || p_partkey || '"><img src="https://cdn.salla.sa/g/' || p_partkey || '-100x100.jpg">'
    || '<img src="https:\\/\\/cdn.salla.sa\\/g\\/' || p_partkey || '-200x200.jpg"><i style="url(&quot;https://cdn.salla.sa/h/' || p_partkey || '.png&quot;)">'
    || '<img src="https://other.example.com/' || p_partkey || '.jpg"></salla-slider></body></html>'
    """
    return _pages(spark, folder, "'https://store.example.com/p' || p_partkey", html)


def cursor_api_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Cursor pages of (store, category): products of 100 consecutive numbers; red ones are left out."""
    rows = parts(spark, folder).selectExpr(
        "'st' || (p_size div 10) AS store", "p_brand AS category", "p_partkey div 100 AS page_seq", "p_partkey",
        "p_name", f"{STORE_LIST} AS payload",
    )
    listed = F.sort_array(F.collect_list(F.when(~F.col("p_name").startswith("red"), F.struct("p_partkey", "payload"))))
    grouped = rows.groupBy("store", "category", "page_seq").agg(
        listed.alias("l"), F.when(F.count(F.lit(1)) < 3, F.lit("next")).alias("next_cursor")
    )
    return grouped.select(
        "store", "category", "page_seq", F.transform("l", lambda e: e["payload"]).alias("items"), "next_cursor"
    )


def token_api_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The same answers without numbers: a page is known by its cursor, the first one has none.

    The last page of a chain names a page that is not there, or in two stores the second page again.
    """
    pages = cursor_api_pages(spark, folder)
    order = Window.partitionBy("store", "category").orderBy("page_seq")
    token = lambda seq: F.concat(F.col("store"), F.lit("/"), F.col("category"), F.lit("/"), seq.cast("string"))
    second = F.nth_value("page_seq", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ahead = F.lead("page_seq").over(order)
    last = F.when(F.col("store").isin("st1", "st3"), token(second)).otherwise(F.concat(token(F.col("page_seq")), F.lit("/more")))
    return pages.select(
        "store", "category", "items", F.when(F.row_number().over(order) > 1, token(F.col("page_seq"))).alias("cursor"),
        F.when(F.col("next_cursor").isNotNull(), F.when(ahead.isNull(), last).otherwise(token(ahead))).alias("next_cursor"),
    )


def catalog_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Shop sites (one per size): each page links itself as a collection and shows two products."""
    html = """
    '<html><body><a href="/collections/c-' || p_partkey || '">Shop ' || p_name || '</a>'
    || '<a href="/products/' || lower(p_type) || '"></a>'
    || '<a href="/products/' || lower(p_type) || '-' || substr(p_brand, 7) || '">' || p_name || '</a><a href="/cart">Cart</a></body></html>'
    """
    return _pages(spark, folder, f"{SHOP} || '/collections/c-' || p_partkey", html)


def platform_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of every platform, by size."""
    html = """
    CASE WHEN p_size <= 10 THEN '<link href="https://cdn.shopify.com/x.css">'
         WHEN p_size <= 20 THEN '<script>{"store": {"id": ' || p_partkey || '}}</script><a href="/x/c5">X</a>'
         WHEN p_size <= 25 THEN '<script>{"store":{"id":' || p_partkey || '}}</script><salla-products-list source="categories" source-value="9">'
         WHEN p_size <= 30 THEN '<script>{"store":{"id":' || p_partkey || '}}</script><a href="/about">no categories</a>'
         WHEN p_size <= 40 THEN '<script>window[Symbol.for("InstantSearchInitialResults")] = {"a":{"results":[{"hits":[{"id":1}]}]}}</script>'
         ELSE '<p>plain</p>' END
    """
    url = f"{SHOP} || (CASE WHEN p_size > 5 THEN '/collections/red-' || p_partkey ELSE '/home' END)"
    return _pages(spark, folder, url, html)

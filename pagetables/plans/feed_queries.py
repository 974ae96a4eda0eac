"""Queries over payloads: paging, roll-ups, normalisers, joins, store and site catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.functions import payload as J
from pagetables.operators import catalogs as C
from pagetables.operators import feeds as FD
from pagetables.operators import merge, ranking
from pagetables.operators.ranking import category_allowance
from pagetables.plans import fixtures as FX
from pagetables.plans.registry import query, table
from pagetables.sources import payloads as PL

SHOP = "'https://shop' || p_size || '.example.com'"
LAST = "p_size // 10"  # number of the last variant


@query("read_payloads", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN p_size > 40 THEN NULL ELSE p_name END AS name FROM part""")
def read_payloads(spark, folder):
    text = F.expr("CASE WHEN p_size > 45 THEN '[1]' WHEN p_size > 40 THEN '{\"name\":' ELSE '{\"name\":\"' || p_name || '\"}' END")
    rows = PL.payload_status(FX.parts(spark, folder).select("p_partkey", text.alias("payload")))
    return rows.select("p_partkey", "status", F.get_json_object("payload", "$.name").alias("name"))


NUMBERED = """
grid AS (SELECT p_partkey, 'store-' || (p_partkey // 40) AS site, CAST((p_partkey - 40 * (p_partkey // 40)) // 10 + 1 AS INTEGER) AS page_no
         FROM part WHERE p_size <= 48),
sizes AS (SELECT site, page_no, count(*) AS n FROM grid GROUP BY 1, 2),
running AS (
  SELECT site, page_no, n, before FROM (
    SELECT site, page_no, n, coalesce(sum(n) OVER w, 0) AS before, coalesce(min(n) OVER w, 10) AS smallest,
           row_number() OVER (PARTITION BY site ORDER BY page_no) AS rn
    FROM sizes WINDOW w AS (PARTITION BY site ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE smallest >= 10 AND before < 25 AND rn = page_no),
items AS (
  SELECT g.site, g.page_no, g.p_partkey, CAST(row_number() OVER (PARTITION BY g.site ORDER BY g.p_partkey) AS INTEGER) AS idx
  FROM grid g JOIN running USING (site, page_no) QUALIFY idx <= 25)"""


@query("paginate_numbered", f"WITH {NUMBERED} SELECT site, page_no, idx, CAST(p_partkey AS VARCHAR) AS id FROM items")
def paginate_numbered(spark, folder):
    rows = PL.paginate_numbered(FX.feed_pages(spark, folder), ["site"], page_size=10, limit=25)
    return rows.select("site", "page_no", "idx", F.get_json_object("item", "$.id").alias("id"))


@query("running_flag", f"WITH {NUMBERED} SELECT site, page_no, CAST(n AS INTEGER) AS size, CAST(before AS INTEGER) AS taken_before FROM running")
def running_flag(spark, folder):
    pages = FX.feed_pages(spark, folder)
    return PL.running_pages(pages.select("site", "page_no", F.size("items").alias("size")), ["site"], 10, 25)


@query("api_pages", f"WITH {NUMBERED} SELECT site, count(*) AS api_pages FROM running GROUP BY 1")
def api_pages(spark, folder):
    return PL.api_pages(running_flag(spark, folder), ["site"])


CURSOR = """
listed AS (SELECT 'st' || (p_size // 10) AS store, p_brand AS category, p_partkey // 100 AS page_seq, p_partkey, p_name FROM part),
sizes AS (SELECT store, category, page_seq, count(*) FILTER (NOT starts_with(p_name, 'red')) AS n, count(*) < 3 AS more FROM listed GROUP BY 1, 2, 3),
kept AS (
  SELECT store, category, page_seq, n, more, before FROM (
    SELECT *, coalesce(sum(n) OVER w, 0) AS before, coalesce(min(CASE WHEN more THEN n ELSE 0 END) OVER w, 1) AS passed
    FROM sizes WINDOW w AS (PARTITION BY store, category ORDER BY page_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE passed > 0 AND before < 7),
taken AS (
  SELECT l.store, l.category, l.page_seq, l.p_partkey,
    CAST(row_number() OVER (PARTITION BY l.store, l.category ORDER BY l.page_seq, l.p_partkey) AS INTEGER) AS idx
  FROM listed l JOIN kept USING (store, category, page_seq) WHERE NOT starts_with(l.p_name, 'red') QUALIFY idx <= 7)"""


@query("paginate_cursor", f"WITH {CURSOR} SELECT store, category, page_seq, idx, CAST(p_partkey AS VARCHAR) AS id FROM taken")
def paginate_cursor(spark, folder):
    rows = PL.paginate_cursor(FX.cursor_api_pages(spark, folder), ["store", "category"], limit=7)
    return rows.select("store", "category", "page_seq", "idx", F.get_json_object("item", "$.id").alias("id"))


CHAIN = """
RECURSIVE listed AS (SELECT 'st' || (p_size // 10) AS store, p_brand AS category, p_partkey // 100 AS page_seq, p_partkey, p_name FROM part),
sizes AS (SELECT store, category, page_seq, count(*) FILTER (NOT starts_with(p_name, 'red')) AS n, count(*) < 3 AS more FROM listed GROUP BY 1, 2, 3),
placed AS (
  SELECT *, store || '/' || category || '/' AS name, row_number() OVER w AS rn, lead(page_seq) OVER w AS ahead,
    nth_value(page_seq, 2) OVER (PARTITION BY store, category ORDER BY page_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second
  FROM sizes WINDOW w AS (PARTITION BY store, category ORDER BY page_seq)),
pages AS (
  SELECT store, category, page_seq AS number, n, CASE WHEN rn > 1 THEN name || page_seq END AS cur,
    CASE WHEN more THEN CASE WHEN ahead IS NOT NULL THEN name || ahead WHEN store IN ('st1', 'st3') THEN name || second
      ELSE name || page_seq || '/more' END END AS onward FROM placed),
chain AS (
  SELECT store, category, number, n, onward, CAST(0 AS BIGINT) AS page_seq, [''] AS path FROM pages WHERE cur IS NULL
  UNION ALL
  SELECT p.store, p.category, p.number, p.n, p.onward, c.page_seq + 1, list_append(c.path, p.cur)
  FROM chain c JOIN pages p ON p.store = c.store AND p.category = c.category AND p.cur = c.onward WHERE NOT list_contains(c.path, p.cur))"""


@query("paginate_cursor_tokens", f"""
WITH {CHAIN},
kept AS (
  SELECT * FROM (SELECT *, coalesce(sum(n) OVER w, 0) AS before, coalesce(min(n) OVER w, 1) AS passed
    FROM chain WINDOW w AS (PARTITION BY store, category ORDER BY page_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE passed > 0 AND before < 7)
SELECT l.store, l.category, k.page_seq, CAST(l.p_partkey AS VARCHAR) AS id,
  CAST(row_number() OVER (PARTITION BY l.store, l.category ORDER BY k.page_seq, l.p_partkey) AS INTEGER) AS idx
FROM listed l JOIN kept k ON l.store = k.store AND l.category = k.category AND l.page_seq = k.number
WHERE NOT starts_with(l.p_name, 'red') QUALIFY idx <= 7""")
def paginate_cursor_tokens(spark, folder):
    rows = PL.paginate_cursor_tokens(FX.token_api_pages(spark, folder), ["store", "category"], limit=7)
    return rows.select("store", "category", "page_seq", "idx", F.get_json_object("item", "$.id").alias("id"))


@query("cursor_chains", f"""
WITH {CHAIN},
tails AS (SELECT store, category, count(*) AS pages, arg_max(onward, page_seq) AS onward, arg_max(path, page_seq) AS path, max(page_seq) AS top,
            arg_max(onward IS NULL, page_seq) AS ended FROM chain GROUP BY 1, 2)
SELECT store, category, t.pages, CASE WHEN t.ended THEN 'end' WHEN list_contains(t.path, t.onward) THEN 'cycle' ELSE 'dangling' END AS chain_end,
  a.n - t.pages AS unreached
FROM tails t JOIN (SELECT store, category, count(*) AS n FROM pages GROUP BY 1, 2) a USING (store, category)""")
def cursor_chains(spark, folder):
    return PL.cursor_chains(FX.token_api_pages(spark, folder), ["store", "category"])


@query("cursor_limit_warnings", f"""
WITH {CURSOR} SELECT DISTINCT store, category, 'product safety limit reached at 7 products' AS warning
FROM kept WHERE before + n >= 7 AND more AND n > 0""")
def cursor_limit_warnings(spark, folder):
    cursors = PL.cursor_pages(FX.cursor_api_pages(spark, folder), ["store", "category"], limit=7)
    return PL.cursor_limit_warnings(cursors, ["store", "category"], 7)


STORE = f"""
{CURSOR},
counts AS (SELECT store, category, CAST(substr(category, 7) AS INTEGER) AS category_order, least(count(*), 7) AS want
           FROM taken GROUP BY 1, 2, 3),
budget AS (
  SELECT *, coalesce(sum(want) OVER (PARTITION BY store ORDER BY category_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM (SELECT k.store, k.category, CAST(substr(k.category, 7) AS INTEGER) AS category_order, coalesce(max(c.want), 0) AS want
        FROM kept k LEFT JOIN counts c USING (store, category) GROUP BY 1, 2, 3))"""


def _with_order(pages):
    return pages.withColumn("category_order", F.substring("category", 7, 9).cast("int"))


@query("store_catalog", f"""
WITH {STORE}
SELECT t.store, t.category, t.idx, b.category_order, CAST(t.p_partkey AS VARCHAR) AS product_id, p.p_name AS title
FROM taken t JOIN budget b USING (store, category) JOIN part p USING (p_partkey) WHERE t.idx <= greatest(0, 60 - b.spent)""")
def store_catalog(spark, folder):
    rows = C.store_catalog(_with_order(FX.cursor_api_pages(spark, folder)), "store", "category", "category_order", 7, 60)
    record = rows.withColumn("r", J.fields("item"))
    return record.select(
        "store", "category", "idx", "category_order",
        J.first_truthy_text((F.col("r"), "id")).alias("product_id"), J.first_truthy_text((F.col("r"), "name")).alias("title"),
    ).withColumn("product_id", F.when(F.col("product_id") == "", F.lit("0")).otherwise(F.col("product_id")))


@query("category_counts", f"""
WITH {STORE}
SELECT store, category, category_order, CAST(least(want, greatest(0, 60 - spent)) AS BIGINT) AS products_found FROM budget WHERE spent < 60""")
def category_counts(spark, folder):
    pages = _with_order(FX.cursor_api_pages(spark, folder))
    rows = C.store_categories(pages, "store", "category", "category_order", 7, 60)
    return rows.withColumn("products_found", F.col("products_found").cast("bigint")).drop("api_pages", "warning")


@query("cap_budget", """
WITH ranked AS (
  SELECT o_orderpriority AS store, o_custkey AS category_order, o_orderkey,
    row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) AS idx FROM orders),
counts AS (SELECT store, category_order, least(count(*), 2) AS want FROM ranked GROUP BY 1, 2),
spent AS (SELECT *, coalesce(sum(want) OVER (PARTITION BY store ORDER BY category_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts)
SELECT r.store, r.category_order, r.o_orderkey, CAST(r.idx AS INTEGER) AS idx
FROM ranked r JOIN spent s USING (store, category_order) WHERE r.idx <= 2 AND r.idx <= greatest(0, 101 - s.before)""")
def cap_budget(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("store"), F.col("o_custkey").alias("category_order"), "o_orderkey", "o_orderdate"
    )
    kept = ranking.cap_budget(rows, "store", "category_order", [F.col("o_orderdate"), F.col("o_orderkey")], 2, 101)
    return kept.drop("o_orderdate")


@query("category_allowance", """
SELECT s_nationkey AS store, s_suppkey AS category_order,
  CAST(least(least(want, 3), greatest(0, 10 - coalesce(sum(least(want, 3)) OVER w, 0))) AS BIGINT) AS allowed
FROM (SELECT s_nationkey, s_suppkey, count(*) AS want FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_quantity > 45 GROUP BY 1, 2)
WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def allowance(spark, folder):
    per_supplier = table(spark, folder, "lineitem").filter("l_quantity > 45").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("available")
    )
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    counts = per_supplier.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("store"), F.col("s_suppkey").alias("category_order"), "available"
    )
    rows = category_allowance(counts, "store", "category_order", 3, 10)
    return rows.select("store", "category_order", F.col("allowed").cast("bigint").alias("allowed"))


# --- normalisers --------------------------------------------------------------

FEED_SQL = f"""
feed AS (
  SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS product_id, p_name AS title,
    CASE WHEN p_size > 45 THEN '' WHEN p_size < 5 THEN 'B' || p_partkey ELSE 'S' || p_partkey || '-0' END AS model_number,
    CASE WHEN p_size > 45 OR p_size < 5 THEN '' ELSE 'S' || p_partkey || '-0' END AS sku,
    CASE WHEN p_size > 45 THEN '' ELSE 'B' || p_partkey END AS gtin,
    CASE WHEN p_size > 45 THEN '' ELSE CAST(round(p_retailprice, 2) AS VARCHAR) END AS price,
    CASE WHEN p_size > 45 OR p_size < 10 THEN '' ELSE CAST(round(p_retailprice + 5 * (CASE {LAST} WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE {LAST} END), 2) AS VARCHAR) END AS regular_price,
    CASE WHEN p_size > 45 OR p_size < 10 THEN '' ELSE CAST(round(p_retailprice, 2) AS VARCHAR) END AS sale_price,
    CASE WHEN p_size > 30 AND p_size <= 45 THEN 'available' ELSE 'unavailable' END AS status,
    p_size > 30 AND p_size <= 45 AS is_available,
    CAST(CASE WHEN p_size > 45 THEN 0 ELSE ({LAST} + 1) * p_size - ({LAST}) * ({LAST} + 1) // 2 END AS BIGINT) AS quantity,
    CASE WHEN p_size > 45 THEN '' ELSE CAST(p_size * 100 AS VARCHAR) END AS weight,
    p_type AS category, p_brand AS brand,
    CASE WHEN p_size >= 34 THEN 2 ELSE 1 END AS image_count,
    'https://cdn.example.com/f/img-' || p_partkey || '-100x100.jpg' AS image,
    'https://shop.example.com/products/p-' || p_partkey AS url,
    p_name || ' ' || p_type || ' & more' AS description,
    CAST(CASE WHEN p_size > 45 THEN 0 ELSE {LAST} + 1 END AS INTEGER) AS variant_count,
    p_brand AS api_vendor
  FROM part)"""
FEED_COLUMNS = [
    "product_id", "title", "model_number", "sku", "gtin", "price", "regular_price", "sale_price", "status", "is_available",
    "quantity", "weight", "category", "brand", "image_count", "image", "url", "description", "variant_count",
]


@query("normalize_feed_product", f"WITH {FEED_SQL} SELECT * FROM feed")
def normalize_feed_product(spark, folder):
    products = FX.feed_products(spark, folder).select("p_partkey", "payload")
    rows = FD.normalize_feed_product(products, F.lit("https://shop.example.com"))
    return rows.select("p_partkey", *FEED_COLUMNS, F.col("extra")["api_vendor"].alias("api_vendor"))


@query("feed_catalog", f"""
WITH {FEED_SQL}, {NUMBERED}
SELECT i.site, i.idx, f.product_id, f.price, f.quantity, 'https://' || i.site || '.example.com/products/p-' || i.p_partkey AS url
FROM items i JOIN feed f USING (p_partkey)""")
def feed_catalog(spark, folder):
    base = F.concat(F.lit("https://"), F.col("site"), F.lit(".example.com"))
    rows = C.feed_catalog(FX.feed_pages(spark, folder), ["site"], base, 10, 25)
    return rows.select("site", "idx", "product_id", "price", "quantity", "url")


@query("feed_collection", f"""
WITH {NUMBERED}
SELECT 'https://' || site || '.example.com/collections/best-sofas?x=1' AS page_url, idx, CAST(p_partkey AS VARCHAR) AS product_id,
  'best-sofas' AS source_category_id, 'Best Sofas' AS category, 'https://' || site || '.example.com/products/p-' || p_partkey AS url
FROM items""")
def feed_collection(spark, folder):
    pages = FX.feed_pages(spark, folder).withColumn(
        "page_url", F.concat(F.lit("https://"), F.col("site"), F.lit(".example.com/collections/best-sofas?x=1"))
    )
    rows = C.feed_collection(pages, ["page_url"], "page_url", 10, 25)
    return rows.select("page_url", "idx", "product_id", "source_category_id", "category", "url")


@query("feed_collections", """
SELECT p_brand AS site, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS INTEGER) AS idx, p_type AS name,
  lower(p_type) AS handle, CAST(count(*) AS VARCHAR) AS products_found, 'C-' || p_type AS category_id,
  'https://' || p_brand || '/collections/' || lower(p_type) AS url
FROM part GROUP BY p_brand, p_type""")
def feed_collections(spark, folder):
    counts = FX.parts(spark, folder).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    item = F.expr("""'{"id":"C-' || p_type || '","title":"' || p_type || '","handle":"' || lower(p_type) || '","products_count":' || n || '}'""")
    listed = F.sort_array(F.collect_list(F.struct("p_type", item.alias("item"))))
    pages = counts.groupBy(F.col("p_brand").alias("site")).agg(listed.alias("l"))
    return C.feed_collections(
        pages.select("site", F.lit(1).alias("page_no"), F.transform("l", lambda e: e["item"]).alias("items")), ["site"],
        base=F.concat(F.lit("https://"), F.col("site")),
    )


VARIANT_ORDER = "struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey, d := l_quantity, e := l_extendedprice, f := l_discount, g := l_linestatus)"
VARIANT_KEYS = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus"]


@query("variant_rollup", f"""
WITH v AS (
  SELECT l.*, 'S' || l_suppkey AS sku,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS price,
    CASE WHEN l_discount = 0 THEN NULL ELSE round(p_retailprice + 10 * l_linenumber, 2) END AS compare, p_size
  FROM lineitem l JOIN part ON l_partkey = p_partkey),
r AS (
  SELECT l_partkey AS product, arg_min(sku, {VARIANT_ORDER}) AS sku, min(price) AS lo, max(compare) AS hi,
    bool_or(l_linestatus = 'O') AS is_available, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) AS variant_count,
    CAST(any_value(p_size) * 100 AS VARCHAR) AS weight
  FROM v GROUP BY 1)
SELECT product, sku, '' AS gtin, coalesce(CAST(lo AS VARCHAR), '') AS price, coalesce(CAST(hi AS VARCHAR), '') AS regular_price,
  CASE WHEN lo < hi THEN CAST(lo AS VARCHAR) ELSE '' END AS sale_price, is_available, quantity, weight, variant_count
FROM r""")
def variant_rollup(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", *VARIANT_KEYS)
    parts = FX.parts(spark, folder).select("p_partkey", "p_retailprice", "p_size")
    variants = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("product"), *VARIANT_KEYS,
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("sku"), F.lit("").alias("barcode"),
        F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice").cast("string")).alias("price"),
        F.when(F.col("l_discount") != 0, F.round(F.col("p_retailprice") + 10 * F.col("l_linenumber"), 2).cast("string")).alias("compare_at_price"),
        (F.col("l_linestatus") == "O").alias("available"), F.col("l_quantity").cast("bigint").alias("inventory_quantity"),
        (F.col("p_size") * 100).cast("string").alias("grams"),
    )
    return FD.variant_rollup(variants, "product", VARIANT_KEYS)


@query("hit_rollup", f"""
WITH v AS (
  SELECT l.*, 'S' || l_suppkey AS sku, l_extendedprice AS price, p_retailprice AS list_price
  FROM lineitem l JOIN part ON l_partkey = p_partkey)
SELECT l_partkey AS hit, CAST(min(price) AS VARCHAR) AS price, CAST(min(list_price) AS VARCHAR) AS regular_price,
  CASE WHEN min(price) <> min(list_price) THEN CAST(min(price) AS VARCHAR) ELSE '' END AS sale_price,
  arg_min(sku, {VARIANT_ORDER}) AS sku, count(DISTINCT sku) AS sku_count, count(*) AS variant_count
FROM v GROUP BY 1""")
def hit_rollup(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", *VARIANT_KEYS)
    parts = FX.parts(spark, folder).select("p_partkey", "p_retailprice")
    variants = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("hit"), *VARIANT_KEYS, F.concat(F.lit("S"), F.col("l_suppkey")).alias("sku"),
        F.col("l_extendedprice").cast("string").alias("price"),
        F.col("p_retailprice").cast("string").alias("list_price"),
    )
    return FD.hit_rollup(variants, "hit", VARIANT_KEYS)


HIT_SQL = f"""
hits AS (
  SELECT p_partkey AS page_id, 'O' || p_partkey AS product_id, p_name AS title,
    CASE WHEN p_size >= 15 THEN 'S' || p_partkey || '-0' WHEN {LAST} >= 1 THEN 'S' || p_partkey || '-1' ELSE '' END AS model_number,
    array_to_string(list_filter([CASE WHEN p_size >= 15 THEN 'S' || p_partkey || '-0' END, CASE WHEN {LAST} >= 1 THEN 'S' || p_partkey || '-1' END,
      CASE WHEN {LAST} >= 2 THEN 'S' || p_partkey || '-2' END, CASE WHEN {LAST} >= 4 THEN 'S' || p_partkey || '-4' END,
      CASE WHEN {LAST} >= 5 THEN 'S' || p_partkey || '-5' END], lambda s: s IS NOT NULL), ' | ') AS all_skus,
    CAST(round(p_retailprice, 2) AS VARCHAR) AS price,
    CAST(round(p_retailprice + (CASE WHEN p_size > 30 THEN 5 ELSE 0 END), 2) AS VARCHAR) AS regular_price,
    CASE WHEN p_size > 30 THEN CAST(round(p_retailprice, 2) AS VARCHAR) ELSE '' END AS sale_price,
    p_type || ' | ' || p_brand AS category, 'Ships in ' || p_size || ' days' AS availability,
    CASE WHEN p_size < 20 THEN '' WHEN p_size = 25 THEN 'False' ELSE 'True' END AS is_available,
    CASE WHEN p_size < 20 THEN '' ELSE CAST(p_size - 25 AS VARCHAR) END AS quantity,
    1 AS image_count, 'https://i.example.com/h-' || p_partkey || '-100x100.jpg' AS image,
    {SHOP} || '/en-us/products/' || p_name || '-' || p_partkey AS url, {LAST} + 1 AS variant_count, p_brand AS color
  FROM part)"""


@query("normalize_embedded_hit", f"WITH {HIT_SQL} SELECT * FROM hits")
def normalize_embedded_hit(spark, folder):
    rows = FD.normalize_embedded_hit(FD.embedded_hits(FX.search_pages(spark, folder)))
    return rows.select(
        "page_id", "product_id", "title", "model_number", "all_skus", "price", "regular_price", "sale_price", "category",
        "availability", "is_available", "quantity", "image_count", "image", "url", "variant_count",
        F.col("extra")["property_color"].alias("color"),
    )


@query("read_embedded_state", """
SELECT p_partkey AS page_id, 0 AS state_no, 'items' AS index_name, 1 AS result_no, CASE WHEN p_size > 20 THEN 3 ELSE 1 END AS nb_pages,
  p_size AS nb_hits, 1 AS rendered, CAST(p_partkey AS BIGINT) AS facet_all FROM part""")
def read_embedded_state(spark, folder):
    rows = PL.read_embedded_state(FX.search_pages(spark, folder))
    return rows.select("page_id", "state_no", "index_name", "result_no", "nb_pages", "nb_hits", "rendered",
                       F.col("facets")["all"].alias("facet_all"))


@query("embedded_coverage", f"""
SELECT p_partkey AS page_id, CASE WHEN p_size > 20 THEN 3 ELSE 1 END AS api_pages, p_size AS nb_hits, 1 AS rendered,
  CASE WHEN p_size > 1 THEN {SHOP} || '/en-us/search/' || p_partkey || ' exposes ' || p_size || ' product results but only 1 are on the page' ELSE '' END AS warning
FROM part""")
def embedded_coverage(spark, folder):
    return FD.embedded_coverage(FX.search_pages(spark, folder)).drop("url", "incomplete_sets")


@query("embedded_categories", """
SELECT p_partkey AS page_id, unnest([p_type, 'all']) AS name, unnest([CAST(p_size AS BIGINT), p_partkey]) AS products_found FROM part""")
def embedded_categories(spark, folder):
    return FD.embedded_categories(FX.search_pages(spark, folder)).drop("url")


STORE_SQL = """
store AS (
  SELECT p_partkey,
    CASE WHEN p_partkey = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS product_id,
    CASE WHEN p_size <= 35 AND p_size > 10 THEN 'Detail ' || p_name ELSE p_name END AS title,
    CASE WHEN p_size > 40 THEN 'MD-' || p_partkey ELSE 'IT-' || p_partkey END AS model_number,
    CASE WHEN p_size <= 35 AND p_partkey <> 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS gtin,
    CASE WHEN p_size <= 35 THEN CAST(round(p_retailprice * 0.9, 2) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS price,
    '' AS regular_price, 'SAR' AS currency, CASE WHEN p_size > 3 THEN 'True' ELSE 'False' END AS is_available,
    CASE WHEN p_size < 20 THEN '' ELSE CAST(p_size AS VARCHAR) END AS quantity,
    CASE WHEN p_size < 20 THEN '1.5' ELSE '' END AS weight,
    p_type AS category, CASE WHEN p_size > 5 THEN p_brand ELSE '' END AS brand,
    'https://store.example.com/p' || p_partkey AS url, p_name || ' Item no: IT-' || p_partkey || ' Color: red' AS description,
    'https://i.example.com/o-' || p_partkey || '-100x100.jpg' AS image,
    CAST(1 + (CASE WHEN p_size > 35 OR p_size <= 12 THEN 1 ELSE 0 END) + (CASE WHEN p_size >= 30 THEN 1 ELSE 0 END) AS INTEGER) AS image_count
  FROM part)"""


def store_records(spark, folder):
    enriched = FD.enrich_products(
        FX.store_products(spark, folder).withColumn("idx", F.lit(1)), FX.store_details(spark, folder),
        FX.store_options(spark, folder), "p_partkey", ["arrived"],
    )
    return FD.store_records(enriched.drop("idx"))


@query("normalize_store_product", f"WITH {STORE_SQL} SELECT * FROM store")
def normalize_store_product(spark, folder):
    rows = FD.normalize_store_product(store_records(spark, folder))
    return rows.select(
        "p_partkey", "product_id", "title", "model_number", "gtin", "price", "regular_price", "currency", "is_available",
        "quantity", "weight", "category", "brand", "url", "description", "image", "image_count",
    )


@query("enrich_products", """
SELECT p_partkey, p_size <= 35 AS has_detail, p_size >= 30 AND p_partkey <= 250 AS has_options FROM part""")
def enrich_products(spark, folder):
    rows = FD.enrich_products(
        FX.store_products(spark, folder), FX.store_details(spark, folder), FX.store_options(spark, folder), "p_partkey",
        ["arrived"], options_limit=250,
    )
    return rows.select("p_partkey", F.col("detail").isNotNull().alias("has_detail"), F.col("options").isNotNull().alias("has_options"))


@query("gallery_images", """
SELECT p_partkey AS page_id, unnest(CASE WHEN p_partkey = 0 THEN ['0'] ELSE ['0', CAST(p_partkey AS VARCHAR)] END) AS product_id,
  unnest(CASE WHEN p_partkey = 0 THEN ['https://cdn.salla.sa/zero.jpg'] ELSE ['https://cdn.salla.sa/zero.jpg',
    'https://cdn.salla.sa/g/' || p_partkey || '-100x100.jpg https://cdn.salla.sa/h/' || p_partkey || '.png'] END) AS gallery
FROM part""")
def gallery_images(spark, folder):
    rows = FD.gallery_images(FX.gallery_pages(spark, folder))
    return rows.select("page_id", "product_id", F.array_join("gallery", " ").alias("gallery"))


@query("enrich_gallery", """
SELECT p_partkey, CASE WHEN n < 2 THEN n + (CASE WHEN p_partkey = 0 THEN 1 ELSE 2 END) ELSE n END AS image_count FROM (
  SELECT p_partkey, CAST(1 + (CASE WHEN p_size > 35 OR p_size <= 12 THEN 1 ELSE 0 END) + (CASE WHEN p_size >= 30 THEN 1 ELSE 0 END) AS INTEGER) AS n FROM part)""")
def enrich_gallery(spark, folder):
    rows = FD.enrich_gallery(store_records(spark, folder), FD.gallery_images(FX.gallery_pages(spark, folder)))
    return rows.select("p_partkey", F.size("images").alias("image_count"))


@query("text_image_urls", """
SELECT p_partkey AS page_id, unnest([0, 1, 2, 3]) AS pos, unnest(['https://cdn.salla.sa/zero.jpg',
  'https://cdn.salla.sa/g/' || p_partkey || '-100x100.jpg', 'https://cdn.salla.sa/g/' || p_partkey || '-200x200.jpg',
  'https://cdn.salla.sa/h/' || p_partkey || '.png']) AS url FROM part""")
def text_image_urls(spark, folder):
    urls = FD.image_urls_in_text("html")
    return FX.gallery_pages(spark, folder).select("page_id", F.posexplode(urls).alias("pos", "url"))


@query("flatten_payload", """
SELECT p_partkey, unnest(['api_price', 'api_category', 'api_category.id', 'api_category.name', 'api_model', 'api_is_available']) AS key,
  unnest([CAST(p_retailprice AS VARCHAR), '{"id":1,"name":"' || p_type || '"}', '1', p_type,
          CASE WHEN p_size > 40 THEN 'MD-' || p_partkey ELSE '' END, CASE WHEN p_size > 3 THEN 'True' ELSE 'False' END]) AS value FROM part""")
def flatten_payload(spark, folder):
    rows = FX.store_products(spark, folder).select("p_partkey", F.explode(J.flatten_payload("payload", "api_")).alias("key", "value"))
    return rows.filter(F.col("key").isin(
        "api_price", "api_category", "api_category.id", "api_category.name", "api_model", "api_is_available"))


@query("collect_images", """
SELECT p_partkey, unnest([0, 1, 2]) AS pos, unnest(['https://i.example.com/o' || p_partkey || '.jpg', 'https://i.example.com/a' || p_partkey || '.png',
  'https://i.example.com/deep' || p_partkey || '.gif']) AS url FROM part""")
def collect_images(spark, folder):
    payload = F.expr("""'{"z":{"list":["https://i.example.com/a' || p_partkey || '.png",{"x":{"y":{"k":"https://i.example.com/deep' || p_partkey || '.gif"}}}]},'
      || '"text":"https://i.example.com/page","image":"https://i.example.com/o' || p_partkey || '.jpg","thumb":"https://i.example.com/o' || p_partkey || '-90x90.jpg"}'""")
    return FX.parts(spark, folder).select("p_partkey", F.posexplode(J.collect_images(payload)).alias("pos", "url"))


@query("dedup_images", """
SELECT p_size AS shop, p_partkey // 3 AS picture, min(p_partkey) AS first_part,
  'https://x.example/pic-' || (p_partkey // 3) || '-' || min(p_partkey) || 'x100.jpg' AS url
FROM part GROUP BY p_size, p_partkey // 3""")
def dedup_images(spark, folder):
    rows = FX.parts(spark, folder).selectExpr(
        "p_size AS shop", "p_partkey div 3 AS picture", "p_partkey AS first_part",
        "'https://x.example/pic-' || (p_partkey div 3) || '-' || p_partkey || 'x100.jpg' AS url",
    )
    return merge.dedup_images(rows, ["shop"], "url", ["first_part"]).drop("image_key")


PLATFORMS = {
    "auto": """CASE WHEN p_size <= 10 THEN 'feed_store' WHEN p_size <= 20 THEN 'store_api_site' WHEN p_size <= 25 THEN 'store_api_category'
      WHEN p_size <= 30 THEN 'generic' WHEN p_size <= 40 THEN 'embedded_search' ELSE 'generic' END""",
    "category": """CASE WHEN p_size <= 5 THEN 'error: collection link needed' WHEN p_size <= 10 THEN 'feed_store' WHEN p_size <= 20 THEN 'generic'
      WHEN p_size <= 25 THEN 'store_api_category' WHEN p_size <= 30 THEN 'generic' WHEN p_size <= 40 THEN 'embedded_search' ELSE 'generic' END""",
    "website": """CASE WHEN p_size <= 10 THEN 'feed_store' WHEN p_size <= 20 THEN 'store_api_site' WHEN p_size <= 30 THEN 'generic'
      WHEN p_size <= 40 THEN 'embedded_search' ELSE 'generic' END""",
}


@query("detect_platform", " UNION ALL ".join(
    f"SELECT p_partkey AS page_id, '{mode}' AS mode, {case} AS platform FROM part" for mode, case in PLATFORMS.items()))
def detect_platform(spark, folder):
    pages = FX.platform_pages(spark, folder)
    tables = [FD.detect_platform(pages, mode).select("page_id", F.lit(mode).alias("mode"), "platform") for mode in PLATFORMS]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


SITE_SQL = f"""
found AS (
  SELECT p_size, {SHOP} || '/collections/c-' || p_partkey AS category_url, p_partkey, p_name, p_type, p_brand,
    CAST(row_number() OVER (PARTITION BY p_size ORDER BY {SHOP} || '/collections/c-' || p_partkey) AS INTEGER) AS rank
  FROM part QUALIFY rank <= 40),
shown AS (
  SELECT 'shop' || p_size || '.example.com' AS site, rank, category_url, p_name, unnest([1, 2]) AS idx,
    unnest([{SHOP} || '/products/' || lower(p_type), {SHOP} || '/products/' || lower(p_type) || '-' || substr(p_brand, 7)]) AS url,
    unnest([p_type[1] || lower(p_type[2:]), p_name]) AS title
  FROM found),
first_seen AS (SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY rank, idx) = 1),
counts AS (SELECT f.*, (SELECT count(*) FROM first_seen s WHERE s.site = 'shop' || f.p_size || '.example.com' AND s.rank = f.rank) AS n FROM found f),
summary AS (
  SELECT 'shop' || p_size || '.example.com' AS site, rank, 'Shop ' || p_name AS name, category_url, n AS products_found,
    coalesce(sum(n) OVER (PARTITION BY p_size ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM counts QUALIFY before < 12)"""


@query("site_catalog", f"""
WITH {SITE_SQL}
SELECT f.site, f.rank, f.idx, f.url, f.title, f.category_url AS source_category_url
FROM first_seen f JOIN summary s ON f.site = s.site AND f.rank = s.rank""")
def site_catalog(spark, folder):
    rows, _ = C.site_catalog(FX.catalog_corpus(spark, folder), row_limit=12, k=40)
    return rows.select("site", "rank", "idx", "url", "title", "source_category_url")


@query("site_catalog_categories", f"WITH {SITE_SQL} SELECT site, rank, name, category_url, products_found FROM summary")
def site_catalog_categories(spark, folder):
    return C.site_catalog(FX.catalog_corpus(spark, folder), row_limit=12, k=40)[1].drop("api_pages", "warning")

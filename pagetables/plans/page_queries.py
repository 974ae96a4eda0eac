"""Queries over derived pages: tags, JSON-LD, element tree, listings, details."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.functions import images as I
from pagetables.functions import payload as J
from pagetables.functions import urls as U
from pagetables.operators import details, listings, nodes, pages as P, structured as S
from pagetables.plans import fixtures as FX
from pagetables.plans import sqltext as Q
from pagetables.plans.corpus_queries import pages_of
from pagetables.plans.registry import query

SHOP = "'https://shop' || p_size || '.example.com'"

META_SQL = """
SELECT p_partkey AS page_id, unnest([0, 1, 2]) AS pos,
       unnest(['description', 'og:type', 'sku']) AS name,
       unnest([p_name || ' by ' || p_brand, p_type, 'S' || p_partkey]) AS content FROM part"""


@query("page_meta", META_SQL)
def page_meta(spark, folder):
    return P.page_meta(FX.shop_pages(spark, folder))


_IMAGES = f"""
shop_images AS (
  SELECT p_partkey AS page_id, unnest([0, 1, 2, 3]) AS pos,
    unnest([{SHOP} || '/img/' || p_partkey || '-a.jpg', {SHOP} || '/en-us/pics/' || p_partkey || '.png',
            {SHOP} || '/s/' || p_partkey || '-640.jpg', {SHOP} || '/t/' || p_partkey || '.jpg']) AS src,
    unnest([p_name, 'one two', '', 'Alt ' || p_name]) AS alt,
    unnest(['Size & ' || p_size, '', '', '']) AS title
  FROM part)"""


@query("page_images", f"WITH {_IMAGES} SELECT * FROM shop_images")
def page_images(spark, folder):
    return P.page_images(FX.shop_pages(spark, folder))


@query("image_src", """
SELECT p_partkey, CASE WHEN p_size > 30 THEN '/a' || p_partkey || '.jpg' WHEN p_size > 20 THEN '/lazy.jpg'
  WHEN p_size > 10 THEN 'big.jpg' ELSE '' END AS src FROM part""")
def image_src(spark, folder):
    found = {
        "src": "CASE WHEN p_size > 30 THEN '/a' || p_partkey || '.jpg' ELSE '' END",
        "data-lazy": "CASE WHEN p_size > 20 THEN '/lazy.jpg' END",
        "srcset": "CASE WHEN p_size > 10 THEN 'small.jpg 1x, big.jpg 2x' END",
    }
    return FX.parts(spark, folder).select(
        "p_partkey", I.image_src(lambda name: F.expr(found.get(name, "CAST(NULL AS STRING)"))).alias("src")
    )


@query("best_srcset", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'b' || p_partkey || '.jpg' WHEN p_size >= 2 THEN 'a.jpg' ELSE 'c.jpg' END AS url FROM part""")
def best_srcset(spark, folder):
    value = F.expr("'a.jpg ' || p_size || 'w,, c.jpg bad, c.jpg 2w , b' || p_partkey || '.jpg ' || "
                   "(CASE WHEN p_size > 40 THEN '1x' ELSE 'zx' END)")
    return FX.parts(spark, folder).select("p_partkey", I.best_srcset(value).alias("url"))


@query("canonical_image_key", """
SELECT p_partkey, size, CASE WHEN size = 2 THEN 'pic-' || p_partkey WHEN size = 3 THEN 'red sofa.jpg' WHEN size = 4 THEN '/i/' || p_partkey || '/' ELSE 'pic-' || p_partkey || '.jpg' END AS image_key
FROM (SELECT p_partkey, unnest([1, 2, 3, 4]) AS size FROM part)""")
def canonical_image_key(spark, folder):
    urls = F.expr("""array(
      struct(1 AS size, 'https://x.example/i/id' || p_partkey || '-' || p_size || 'x99.5-pic-' || p_partkey || '.jpg?v=1' AS url),
      struct(2 AS size, 'https://x.example/cdn-cgi/image/w=5/i/pic-' || p_partkey || '-width=' || p_size || '-fit=cover.jpg' AS url),
      struct(3 AS size, 'https://x.example/i/red%20sofa-100x100.jpg#top' AS url),
      struct(4 AS size, 'https://x.example/i/' || p_partkey || '/' AS url))""")
    rows = FX.parts(spark, folder).select("p_partkey", F.explode(urls).alias("u"))
    return rows.select("p_partkey", "u.size", I.canonical_image_key("u.url").alias("image_key"))


@query("is_image_url", """
SELECT p_partkey, i, i IN (0, 3) AS is_image FROM (SELECT p_partkey, unnest([0, 1, 2, 3, 4]) AS i FROM part)""")
def is_image_url(spark, folder):
    urls = F.expr("""array('https://x.example/' || p_partkey || '.JPEG?w=1', '/' || p_partkey || '.jpg', 'https://x.example/a.jpg#x',
      'http://cdn.salla.sa/' || p_partkey, 'https://x.example/' || p_name)""")
    rows = FX.parts(spark, folder).select("p_partkey", F.posexplode(urls).alias("i", "url"))
    return rows.select("p_partkey", "i", I.is_image_url("url").alias("is_image"))


@query("category_id", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS id FROM part""")
def category_id(spark, folder):
    url = F.expr("'https://s.example/sofas/c' || p_size || '/c9?x=/c1'")
    return FX.parts(spark, folder).select("p_partkey", U.category_id(url).alias("id"))


@query("collection_handle", """
SELECT p_partkey, replace(p_name, ' ', '-') || ' ' || p_size AS handle FROM part""")
def collection_handle(spark, folder):
    url = F.expr("'https://s.example/en/Collections/' || replace(p_name, ' ', '-') || '%20' || p_size || '/x?y=1'")
    return FX.parts(spark, folder).select("p_partkey", U.collection_handle(url).alias("handle"))


@query("extract_model_number", """
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'MX ' || p_partkey WHEN p_size > 20 THEN 'IT-' || p_partkey
  WHEN p_size > 10 THEN 'AB/' || p_partkey ELSE '' END AS model_number FROM part""")
def extract_model_number(spark, folder):
    text = F.expr("""CASE WHEN p_size > 40 THEN p_name || ' MODEL NO: MX ' || p_partkey || ' Price 5'
      WHEN p_size > 20 THEN 'Item #IT-' || p_partkey || ' - color: red' WHEN p_size > 10 THEN 'sku AB/' || p_partkey || ' brand B'
      ELSE 'modelling ' || p_name END""")
    return FX.parts(spark, folder).select("p_partkey", S.extract_model_number(text).alias("model_number"))


# --- JSON-LD ------------------------------------------------------------------

@query("read_jsonld", """
SELECT p_partkey AS page_id, unnest([0, 1, 1]) AS block, unnest([0, 0, 1]) AS idx,
  unnest(['OBJECT', 'OBJECT', 'STRING']) AS kind, unnest([p_name, NULL, NULL]) AS name FROM part""")
def read_jsonld(spark, folder):
    rows = S.read_jsonld(FX.jsonld_pages(spark, folder))
    return rows.select("page_id", "block", "idx", "kind", F.get_json_object("item", "$.name").alias("name"))


@query("jsonld_objects", """
SELECT p_partkey AS page_id, unnest([0, 1, 2, 3, 4]) AS pos, unnest([2, 4, 2, 4, 4]) AS path_len,
  unnest(['Product', 'Offer', 'ItemList', 'ListItem', 'ListItem']) AS type FROM part""")
def jsonld_objects(spark, folder):
    rows = S.jsonld_objects(FX.jsonld_pages(spark, folder))
    return rows.select("page_id", "pos", "path_len", F.get_json_object("object", "$.@type").alias("type"))


@query("structured_rows", """
SELECT p_partkey AS page_id, unnest([0, 1, 1]) AS block, unnest([0, 0, 1]) AS idx,
  unnest([p_name, NULL, NULL]) AS name, unnest(['True', NULL, NULL]) AS in_stock, unnest(['', NULL, NULL]) AS note,
  unnest([CAST(p_partkey AS VARCHAR), NULL, NULL]) AS product_id,
  unnest([CAST(p_retailprice AS VARCHAR), NULL, NULL]) AS offer_price,
  unnest([NULL, NULL, NULL]) AS weight
FROM part""")
def structured_rows(spark, folder):
    rows = S.structured_rows(FX.jsonld_pages(spark, folder))
    extra = F.col("extra")
    price = F.coalesce(F.get_json_object(extra["offers"], "$.price"), F.get_json_object(extra["offers"], "$.lowPrice"))
    return rows.select(
        "page_id", "block", "idx", extra["name"].alias("name"), extra["inStock"].alias("in_stock"),
        extra["note"].alias("note"), extra["productID"].alias("product_id"), price.alias("offer_price"),
        extra["weight"].cast("int").alias("weight"),
    )


def _objects(spark, folder, field):
    """The objects of each page with one field, as `o`."""
    pages = nodes.with_page_tree(FX.jsonld_pages(spark, folder), columns=["page_id", "objects"], fields=[field])
    return pages.withColumnRenamed("objects", "o")


@query("structured_value", "SELECT p_partkey AS page_id, p_brand AS brand FROM part")
def structured_value(spark, folder):
    pages = _objects(spark, folder, "entries")
    return pages.select("page_id", S.structured_value(F.col("o"), J.DETAIL_KEYS["brand"]).alias("brand"))


@query("structured_value_ordered", """
SELECT p_partkey AS page_id, CASE WHEN p_partkey <> 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_size < 40 THEN 'S' || p_partkey ELSE '' END AS model,
  CASE WHEN p_size < 40 THEN 'S' || p_partkey WHEN p_partkey <> 0 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS sku_first FROM part""")
def structured_value_ordered(spark, folder):
    pages = _objects(spark, folder, "entries")
    return pages.select(
        "page_id",
        S.structured_value_ordered(F.col("o"), J.DETAIL_KEYS["model_number"]).alias("model"),
        S.structured_value_ordered(F.col("o"), ["sku", "productID"]).alias("sku_first"),
    )


@query("structured_price", "SELECT p_partkey AS page_id, CAST(p_retailprice AS VARCHAR) AS price FROM part")
def structured_price(spark, folder):
    pages = _objects(spark, folder, "price")
    return pages.select("page_id", S.structured_price(F.col("o")).alias("price"))


@query("text_value", """
SELECT p_partkey, p_type || ', ' || p_brand AS listed, p_brand AS named, CASE WHEN p_size > 25 THEN 'True' ELSE '' END AS flag FROM part""")
def text_value(spark, folder):
    payload = F.expr("""'{"l":["' || p_type || '",{"name":" ' || p_brand || '"},"",0],"n":{"@id":"x","name":"' || p_brand || '"},"f":' || (p_size > 25) || '}'""")
    record = FX.parts(spark, folder).select("p_partkey", J.fields(payload).alias("r"))
    return record.select(
        "p_partkey", *[J.text_value(F.col("r")[k]).alias(n) for k, n in (("l", "listed"), ("n", "named"), ("f", "flag"))]
    )


@query("scalar_or_json", """
SELECT p_partkey, CAST(p_retailprice AS VARCHAR) AS price, CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END AS flag,
  '' AS nothing, '' AS absent, p_type AS category, '' AS broken FROM part""")
def scalar_or_json(spark, folder):
    payload = F.expr("""'{"price":' || p_retailprice || ',"flag":' || (p_size > 25) || ',"nothing":null,"category":{"name":"' || p_type || '"}}'""")
    rows = FX.parts(spark, folder).select("p_partkey", payload.alias("payload")).withColumn("r", J.fields("payload"))
    return rows.select(
        "p_partkey", *[J.scalar_text(F.col("r")[k]).alias(k) for k in ("price", "flag", "nothing", "absent")],
        J.nested_text("payload", "category", "name").alias("category"),
        J.nested_text("payload", "price", "name").alias("broken"),
    )


# --- element tree -------------------------------------------------------------

@query("page_nodes")
def page_nodes(spark, folder):
    return nodes.page_nodes(pages_of(spark, folder))


_VISIBLE = "regexp_replace(html, '<!--.*?-->|(<script[^>]*>).*?(</script>)', '\\1\\2', 'gs')"


@query("node_tag_counts", f"""
SELECT page_id, tag, count(*) AS n FROM (
  SELECT page_id, unnest(regexp_extract_all({_VISIBLE}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages
  UNION ALL SELECT page_id, 'document' FROM pages) GROUP BY 1, 2""")
def node_tag_counts(spark, folder):
    return nodes.page_nodes(pages_of(spark, folder)).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("links_from_nodes", f"""
WITH {Q.LINKS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS idx, href, text FROM links""")
def links_from_nodes(spark, folder):
    from pyspark.sql import Window

    tree = nodes.page_nodes(pages_of(spark, folder)).filter("tag = 'a'")
    order = Window.partitionBy("page_id").orderBy("pos")
    return tree.select(
        "page_id", F.row_number().over(order).alias("idx"),
        U.resolve_url("url", F.col("attrs")["href"]).alias("href"), F.array_join("own_text", " ").alias("text"),
    )


@query("score_nodes", """
SELECT p_partkey AS page_id, tag, score, count(*) AS n FROM (
  SELECT p_partkey, unnest(['article', 'article', 'li', 'div', 'a', 'a', 'a', 'a', 'nav', 'h2', 'h2', 'img', 'img', 'img', 'html', 'body', 'document', 'span', 'span', 'p', 'p']) AS tag,
    unnest([14, 14, 14, 12, 3, 1, 1, CASE WHEN length(p_type || ' of ' || p_brand || ' from $5.00 and up') BETWEEN 30 AND 900 THEN 6 ELSE 4 END]
      || [-10, -10, -10, -10, -10, -10, -10, -10, -10, -10, -10, -10, -10]) AS score FROM part) GROUP BY 1, 2, 3""")
def score_nodes(spark, folder):
    needed = ["page_id", "tag", "attrs", "price", "text_len", "first_img", "first_a"]
    scored = listings.score_nodes(nodes.page_nodes(FX.card_pages(spark, folder), columns=needed))
    return scored.groupBy("page_id", "tag", "score").agg(F.count(F.lit(1)).alias("n"))


@query("heading_text", """
SELECT p_partkey AS page_id, unnest([0, 1]) AS i, unnest([p_name, 'Other ' || p_name]) AS heading FROM part""")
def heading_text(spark, folder):
    firsts = [f"first_{t}" for t in listings.HEADING_TAGS]
    tree = nodes.page_nodes(FX.card_pages(spark, folder), columns=["page_id", "pos", "tag", "plain_title", *firsts])
    cards = tree.filter("tag = 'article'").select("page_id", "pos", listings.heading_text().alias("heading"))
    return cards.select("page_id", F.when(F.col("heading").startswith("Other"), 1).otherwise(0).alias("i"), "heading")


@query("first_image_link", f"""
SELECT p_partkey AS page_id, unnest(['div', 'li']) AS tag,
  unnest([{SHOP} || '/i/' || p_partkey || '.jpg', {SHOP} || '/i/c.jpg']) AS image, unnest(['A', '']) AS image_alt,
  unnest([{SHOP} || '/d/' || p_partkey, {SHOP} || '/d2/' || p_partkey]) AS url FROM part""")
def first_image_link(spark, folder):
    tree = nodes.page_nodes(FX.card_pages(spark, folder), columns=["page_id", "url", "tag", "first_img", "first_a"])
    rows = tree.filter(F.col("tag").isin("div", "li")).withColumn("base", U.url_parts("url"))
    image = listings.first_image_parts(F.col("base"))
    return rows.select(
        "page_id", "tag", image["src"].alias("image"), image["alt"].alias("image_alt"),
        listings.first_link(F.col("base")).alias("url"),
    )


# the price of the second card is the number in its brand: any digit run counts, the leftmost one wins
CARD_SQL = f"""
SELECT p_partkey AS page_id, unnest([1, 2]) AS idx, unnest([p_name, p_type || ' of ' || p_brand || ' from $5.00 and up']) AS title,
  unnest(['$' || p_size || '.99', substr(p_brand, 7)]) AS price,
  unnest([{SHOP} || '/i/' || p_partkey || '.jpg', {SHOP} || '/i/c.jpg']) AS image,
  unnest([{SHOP} || '/d/' || p_partkey, {SHOP} || '/d2/' || p_partkey]) AS url FROM part"""


@query("card_listings", CARD_SQL)
def card_listings(spark, folder):
    rows = listings.card_listings(listings.listing_nodes(FX.card_pages(spark, folder)))
    return rows.select("page_id", "idx", "title", "price", "image", "url")


PRODUCT_LINKS_SQL = f"""
SELECT p_partkey AS page_id, unnest([1, 2]) AS idx, unnest(['Alt ' || p_name, p_name || ' $ ' || p_size || '.00 for']) AS title,
  unnest(['', '$ ' || p_size || '.00']) AS price,
  unnest([{SHOP} || '/t/' || p_partkey || '.jpg', '']) AS image,
  unnest([{SHOP} || '/en-us/products/p-' || p_partkey || 'x', {SHOP} || '/en-us/products/q-' || p_partkey || '-red-sofa?ref=1']) AS url
FROM part"""


@query("product_link_listings", PRODUCT_LINKS_SQL)
def product_link_listings(spark, folder):
    rows = listings.product_link_listings(listings.link_nodes(FX.shop_pages(spark, folder)))
    return rows.select("page_id", "idx", "title", "price", "image", "url")


@query("link_image_listings", f"""
SELECT p_partkey AS page_id, unnest([1, 2, 3]) AS idx, unnest(['Alt ' || p_name, p_name || ' $ ' || p_size || '.00 for', 'Item']) AS title,
  unnest([{SHOP} || '/en-us/products/p-' || p_partkey || 'x', {SHOP} || '/en-us/products/q-' || p_partkey || '-red-sofa?ref=1',
          {SHOP} || '/en-us/item/' || p_brand]) AS url,
  'link_image_fallback' AS source
FROM part""")
def link_image_listings(spark, folder):
    rows = listings.link_image_listings(listings.link_nodes(FX.shop_pages(spark, folder)))
    return rows.select("page_id", "idx", "title", "url", "source")


@query("page_listings", f"""
SELECT *, 0 AS strategy FROM ({PRODUCT_LINKS_SQL})""")
def page_listings(spark, folder):
    rows = listings.page_listings(listings.listing_nodes(FX.shop_pages(spark, folder)))
    return rows.select("page_id", "idx", "title", "price", "image", "url", "strategy")


@query("greedy_dedup_two_key", f"SELECT page_id, title, price, url, url AS link FROM ({CARD_SQL})")
def greedy_dedup_two_key(spark, folder):
    kept = listings.greedy_dedup_two_key(
        listings.listing_candidates(listings.listing_nodes(FX.card_pages(spark, folder)), (listings.CARD,))
    )
    return kept.select("page_id", "title", "price", "url", "link")


@query("node_contains", """
SELECT p_partkey AS page_id, a_tag, d_tag, n FROM part,
  (VALUES ('div', 'article', 2), ('article', 'article', 2), ('div', 'img', 3), ('article', 'img', 2)) AS v(a_tag, d_tag, n)""")
def node_contains(spark, folder):
    tree = nodes.page_nodes(FX.card_pages(spark, folder), columns=["page_id", "pos", "end_pos", "tag"])
    pairs = listings.node_contains(
        tree, F.col("tag").isin("div", "article"), F.col("tag").isin("article", "img")
    )
    return pairs.groupBy("page_id", "a_tag", "d_tag").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("discover_categories", f"""
SELECT p_partkey AS page_id, unnest(CASE WHEN p_size = 7 THEN [1] ELSE [1, 2] END) AS idx,
  unnest(CASE WHEN p_size = 7 THEN ['7'] ELSE [CAST(p_size AS VARCHAR), '7'] END) AS category_id,
  unnest(CASE WHEN p_size = 7 THEN ['c7'] ELSE ['c' || p_size, 'kind-' || p_type] END) AS name,
  unnest(CASE WHEN p_size = 7 THEN [{SHOP} || '/c7'] ELSE [{SHOP} || '/c' || p_size, {SHOP} || '/kind-' || p_type || '/c7'] END) AS url
FROM part""")
def discover_categories(spark, folder):
    return listings.discover_categories(
        nodes.page_nodes(FX.shop_pages(spark, folder), columns=["page_id", "url", "pos", "tag", "attrs", "text"])
    )


# --- details ------------------------------------------------------------------

DETAIL_SQL = f"""
details AS (
  SELECT p_partkey AS page_id, {SHOP} || '/d/' || p_partkey AS detail_url, p_name AS detail_title,
    CAST(p_retailprice AS VARCHAR) AS detail_price, p_brand AS brand,
    CASE WHEN p_size < 40 THEN 'S' || p_partkey ELSE '' END AS sku, '' AS mpn,
    CASE WHEN p_partkey <> 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_size < 40 THEN 'S0' ELSE 'MX-0' END AS model_number,
    'https://schema.org/InStock' AS availability,
    {SHOP} || '/a/' || p_partkey || '.jpg | ' || {SHOP} || '/d/b.jpg' AS detail_images,
    p_name || ' var x = {{"name":"no"}} ' || p_name || ' Model number: MX-' || p_partkey || ' Price: $' || p_size || '.50' AS detail_description
  FROM part)"""


@query("page_detail", f"WITH {DETAIL_SQL} SELECT * FROM details")
def page_detail(spark, folder):
    return details.page_detail(FX.jsonld_pages(spark, folder), details.DETAIL_IMAGES, details.DETAIL_CHARS)


@query("detail_eligibility", """
SELECT p_partkey AS page_id, unnest([1, 2]) AS idx,
  unnest(CASE WHEN p_size > 40 THEN ['visit', 'Skipped: detail page limit is 1']
              ELSE ['Skipped: no same-site product URL', 'Skipped: detail page limit is 1'] END) AS detail_status FROM part""")
def detail_eligibility(spark, folder):
    rows = FX.parts(spark, folder).selectExpr(
        "p_partkey AS page_id", "'https://a.example/' AS page_url",
        "explode(array(struct(1 AS idx, CASE WHEN p_size > 40 THEN 'https://a.example/p' WHEN p_size > 20 THEN '' ELSE 'https://b.example/p' END AS url), "
        "struct(2 AS idx, 'https://a.example/q' AS url))) AS l",
    ).select("page_id", "page_url", "l.*")
    return details.detail_eligibility(rows, 1).select("page_id", "idx", "detail_status")


@query("enrich_details", f"""
WITH {DETAIL_SQL}
SELECT c.page_id, c.idx, c.title,
  CASE WHEN c.idx = 1 THEN 'OK' ELSE 'Failed: page is not in the corpus' END AS detail_status,
  CASE WHEN c.idx = 1 THEN d.detail_price END AS detail_price,
  CASE WHEN c.idx = 1 THEN d.model_number ELSE '' END AS model_number
FROM ({CARD_SQL}) c JOIN details d USING (page_id)""")
def enrich_details(spark, folder):
    found = FX.card_pages(spark, folder)
    rows = found.selectExpr("page_id", "url AS page_url", "regexp_extract(url, '^(https://[^/]+)', 1) AS root", "html").select(
        "page_id", "page_url", F.posexplode(F.expr(
            "array(struct(regexp_extract(html, '<h2>([^<]*)<', 1) AS title, root || '/d/' || page_id AS url),"
            " struct(regexp_extract(html, '<li[^>]*><a[^>]*>([^<]*)<', 1) AS title, root || '/d2/' || page_id AS url))")).alias("i", "l"),
    ).select("page_id", "page_url", (F.col("i") + 1).alias("idx"), "l.*")
    rich = details.enrich_details(rows, details.page_detail(FX.jsonld_pages(spark, folder)))
    return rich.select("page_id", "idx", "title", "detail_status", "detail_price", "model_number")


@query("catalog_to_pages", f"""
SELECT p_partkey AS rank, {SHOP} || '/d/' || p_partkey AS url, p_partkey AS page_id, {SHOP} || '/d/' || p_partkey AS page_url
FROM part WHERE p_size > 20""")
def catalog_to_pages(spark, folder):
    wanted = FX.jsonld_pages(spark, folder).selectExpr("page_id AS rank", "url")
    have = FX.jsonld_pages(spark, folder).filter(~U.site_of("url").rlike("^shop(1?[0-9]|20)[.]"))
    return details.catalog_to_pages(wanted, have)


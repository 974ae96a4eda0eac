"""Queries that go as deep as their input: nesting, entities, letters, broken bytes, whole cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.functions import payload as J
from pagetables.functions import text as X
from pagetables.functions.html import link_array
from pagetables.operators import bundle as B
from pagetables.operators import catalogs as C
from pagetables.operators import feeds as FD
from pagetables.operators import listings, nodes
from pagetables.operators import structured as S
from pagetables.plans import fixtures as FX
from pagetables.plans.feed_queries import HIT_SQL, STORE, _with_order
from pagetables.plans.page_queries import CARD_SQL, SHOP
from pagetables.plans.registry import query
from pagetables.sinks import sheets as SH

# (own text, end, parent, depth) of each element of a card page, in page order
CARD_TREE = [
    ("document", "''", 20, -1, 0), ("html", "''", 20, 0, 1), ("body", "''", 20, 1, 2), ("nav", "''", 4, 2, 3),
    ("a", "'Menu of the shop with a long enough text'", 4, 3, 4), ("div", "''", 20, 2, 3), ("article", "''", 11, 5, 4),
    ("a", "''", 8, 6, 5), ("h2", "p_name", 8, 7, 6), ("img", "''", 11, 6, 5), ("span", "'$' || p_size || '.99'", 10, 9, 6),
    ("p", "'A text that is long enough to count as a card.'", 11, 9, 6), ("article", "''", 17, 5, 4), ("a", "''", 14, 12, 5),
    ("h2", "'Other ' || p_name", 14, 13, 6), ("img", "''", 17, 12, 5), ("span", "'$9.99'", 16, 15, 6),
    ("p", "'Same link with another text that is long enough.'", 17, 15, 6), ("li", "''", 20, 5, 4),
    ("a", "p_type || ' of ' || p_brand || ' from $5.00 and up'", 19, 18, 5), ("img", "''", 20, 18, 5),
]
_TREE_SQL = ", ".join(
    f"struct_pack(pos := {i}, end_pos := {e}, parent_pos := {p}, depth := {d}, tag := '{t}', own := {own})"
    for i, (t, own, e, p, d) in enumerate(CARD_TREE)
)


@query("page_nodes_exact", f"""
WITH n AS (SELECT p_partkey AS page_id, unnest([{_TREE_SQL}], recursive := true) FROM part)
SELECT a.page_id, a.pos, a.end_pos, a.parent_pos, a.depth, a.tag,
  coalesce(string_agg(b.own, ' ' ORDER BY b.pos) FILTER (b.own <> ''), '') AS text
FROM n a JOIN n b ON a.page_id = b.page_id AND b.pos BETWEEN a.pos AND a.end_pos GROUP BY ALL""")
def page_nodes_exact(spark, folder):
    return nodes.page_nodes(
        FX.card_pages(spark, folder), columns=["page_id", "pos", "end_pos", "parent_pos", "depth", "tag", "text"]
    )


@query("contained_counts", """
SELECT p_partkey AS page_id, unnest([5, 6, 12, 5, 6, 12]) AS pos, unnest(['div', 'article', 'article', 'div', 'article', 'article']) AS tag,
  unnest(['article', 'article', 'article', 'img', 'img', 'img']) AS contained_tag, unnest([2, 1, 1, 3, 1, 1]) AS n FROM part""")
def contained_counts(spark, folder):
    tree = nodes.page_nodes(FX.card_pages(spark, folder), columns=["page_id", "pos", "end_pos", "tag"])
    counted = listings.contained_counts(tree, F.col("tag").isin("div", "article"), F.col("tag").isin("article", "img"))
    return counted.select("page_id", "pos", "tag", "contained_tag", F.col("n").cast("int").alias("n"))


@query("jsonld_deep", """
SELECT p_partkey AS page_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS pos, unnest(['A', 'B', 'C', 'D', 'E', 'F', 'G']) AS type,
  CAST(p_retailprice AS VARCHAR) AS price, p_brand || ', ' || p_type AS brand FROM part""")
def jsonld_deep(spark, folder):
    """Six containers below the first object; the name of a brand is a list that holds an object."""
    inner = """'{"@type":"G","price":' || p_retailprice || ',"brand":{"name":["' || p_brand || '",{"name":{"name":" ' || p_type || ' "}}]}}'"""
    for kind in "FEDCBA":
        inner = f"""'{{"@type":"{kind}","mainEntity":' || {inner} || '}}'"""
    pages = FX._pages(spark, folder, f"{SHOP} || '/deep/' || p_partkey", f"'<script type=\"application/ld+json\">' || {inner} || '</script>'")
    tree = nodes.with_page_tree(pages)
    return tree.select(
        "page_id", F.posexplode("objects").alias("pos", "o"), S.structured_price(F.col("objects")).alias("price"),
        S.structured_value(F.col("objects"), ["brand"]).alias("brand"),
    ).select("page_id", "pos", F.get_json_object("o.text", "$.@type").alias("type"), "price", "brand")


@query("link_text_deep", "SELECT p_partkey AS page_id, p_name || ' & ' || p_brand || ' ' || p_size AS text FROM part")
def link_text_deep(spark, folder):
    """Own text of a link around markup that is nested five deep, crossed and left open."""
    html = """'<a href="/x">' || p_name || ' <i><b><u><s><em>q</em>r</s></u></b><b>t</i> &amp; <span>w</span></nothing> ' || p_brand
      || '<br/> ' || p_size || '<p>open <b>x</a><p>no'"""
    pages = FX._pages(spark, folder, f"{SHOP} || '/l/' || p_partkey", html)
    return pages.select("page_id", F.explode(link_array("html")).alias("l")).select("page_id", "l.text")


@query("decode_entities", """
SELECT p_partkey, p_name || ' → ½ É ² – € ¬it &nope; © &amp ' || chr(65 + p_size % 26) || ' � ’ ≧̸ fj' AS text FROM part""")
def decode_entities(spark, folder):
    text = F.expr("p_name || ' &rarr; &frac12; &Eacute; &sup2; &#150; &#x80; &notit &nope; &copy &amp;amp &#' || (65 + p_size % 26)"
                  " || '; &#xD800; &#0000000146; &ngE; &fjlig;'")
    return FX.parts(spark, folder).select("p_partkey", X.decode_entities(text).alias("text"))


@query("collect_images_deep", """
SELECT p_partkey, unnest([0, 1, 2]) AS pos, unnest(['https://i.example.com/own' || p_partkey || '.jpg',
  'https://i.example.com/key' || p_partkey || '.png', 'https://i.example.com/a b' || p_partkey || '.webp']) AS url FROM part""")
def collect_images_deep(spark, folder):
    """Images under four objects and lists: the known key counts before the other fields; a blank does not end a URL."""
    payload = F.expr("""'{"https://i.example.com/name.jpg":1,"image":"https://i.example.com/own' || p_partkey || '.jpg","a":{"b":[{"c":{"d":[{"z":"https://i.example.com/a b'
      || p_partkey || '.webp","url":"https://i.example.com/key' || p_partkey || '.png"}]}}]}}'""")
    return FX.parts(spark, folder).select("p_partkey", F.posexplode(J.collect_images(payload)).alias("pos", "url"))


@query("column_letters", """
WITH k AS (SELECT p_partkey, p_partkey * 997 + 1 AS n FROM part)
SELECT p_partkey, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER))
  WHEN n <= 702 THEN chr(CAST(65 + (n - 27) // 26 AS INTEGER)) || chr(CAST(65 + (n - 27) % 26 AS INTEGER))
  WHEN n <= 18278 THEN chr(CAST(65 + (n - 703) // 676 AS INTEGER)) || chr(CAST(65 + (n - 703) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 703) % 26 AS INTEGER))
  WHEN n <= 475254 THEN chr(CAST(65 + (n - 18279) // 17576 AS INTEGER)) || chr(CAST(65 + (n - 18279) // 676 % 26 AS INTEGER))
    || chr(CAST(65 + (n - 18279) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 18279) % 26 AS INTEGER))
  ELSE chr(CAST(65 + (n - 475255) // 456976 AS INTEGER)) || chr(CAST(65 + (n - 475255) // 17576 % 26 AS INTEGER)) || chr(CAST(65 + (n - 475255) // 676 % 26 AS INTEGER))
    || chr(CAST(65 + (n - 475255) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (n - 475255) % 26 AS INTEGER)) END AS letters FROM k""")
def column_letters(spark, folder):
    return FX.parts(spark, folder).select("p_partkey", SH.column_letter(F.col("p_partkey") * 997 + 1).alias("letters"))


@query("broken_bytes", "SELECT p_partkey AS page_id, 'caf� ' || p_brand || ' ' || p_name AS text, 1 AS links FROM part")
def broken_bytes(spark, folder):
    """Bytes that are no UTF-8 become a mark; such a page goes through the Python pass like any other."""
    html = F.concat(
        F.expr("CAST('<a href=/>' || p_name || '</a> caf' AS BINARY)"), F.unhex(F.lit("E920")), F.expr("CAST(p_brand AS BINARY)"),
    )
    pages = FX.parts(spark, folder).select(
        F.col("p_partkey").alias("page_id"), F.lit("https://h.example.com/").alias("url"),
        F.make_valid_utf8(html.cast("string")).alias("html"),
    )
    tree = nodes.with_page_tree(pages)
    return tree.select("page_id", F.col("text"), F.size(link_array("html")).alias("links"))


@query("store_listings", f"""
WITH {STORE}
SELECT t.store, t.category AS source_category_name, t.idx, CAST(t.p_partkey AS VARCHAR) AS key,
  CASE WHEN p.p_size <= 35 AND p.p_size > 10 THEN 'Detail ' || p.p_name ELSE p.p_name END AS title,
  CASE WHEN p.p_size <= 35 THEN CAST(round(p.p_retailprice * 0.9, 2) AS VARCHAR) ELSE CAST(p.p_retailprice AS VARCHAR) END AS price,
  CAST(CASE WHEN n < 2 THEN n + (CASE WHEN p_partkey = 0 THEN 1 ELSE 2 END) ELSE n END AS INTEGER) AS image_count,
  CASE WHEN p.p_size <= 35 THEN CAST(t.p_partkey AS VARCHAR) END AS detail_id, 'OK' AS detail_status
FROM taken t JOIN budget b USING (store, category) JOIN part p USING (p_partkey)
JOIN (SELECT p_partkey, 1 + (CASE WHEN p_size > 35 OR p_size <= 12 THEN 1 ELSE 0 END) + (CASE WHEN p_size >= 30 THEN 1 ELSE 0 END) AS n FROM part) i USING (p_partkey)
WHERE t.idx <= greatest(0, 60 - b.spent)""")
def store_listings(spark, folder):
    """A store from its API pages to listing rows: paging under both caps, details, options, galleries, categories."""
    key = F.col("p_partkey").cast("string").alias("product_id")
    rows = C.store_listings(
        _with_order(FX.cursor_api_pages(spark, folder)),
        FX.store_details(spark, folder).select(key, "arrived", "payload"), FX.store_options(spark, folder).select(key, "arrived", "payload"),
        FD.gallery_images(FX.gallery_pages(spark, folder)), ["arrived"], per_category=7, per_store=60,
    )
    return rows.select(
        "store", "source_category_name", "idx", F.regexp_extract("url", "p([0-9]+)$", 1).alias("key"), "title", "price",
        F.col("image_count").cast("int").alias("image_count"), F.get_json_object("raw_json", "$.detail_id").alias("detail_id"), "detail_status",
    )


def _mixed(spark, folder):
    """Card pages and search pages of the same shops."""
    search = FX.search_pages(spark, folder).withColumn("page_id", F.col("page_id") + 1_000_000)
    return FX.card_pages(spark, folder).unionByName(search)


@query("bundle_listings", f"""
WITH {HIT_SQL}
SELECT page_id, CAST(idx AS INTEGER) AS idx, title, price, url, 'Failed: page is not in the corpus' AS detail_status, '' AS model_number FROM ({CARD_SQL})
UNION ALL SELECT page_id + 1000000, 1, title, price, url, 'OK', model_number FROM hits""")
def bundle_listings(spark, folder):
    """The cascade of a mixed corpus: search results where a page has them, else cards with their details."""
    rows = B.Bundle(_mixed(spark, folder)).listings
    return rows.select("page_id", F.col("idx").cast("int").alias("idx"), "title", "price", "url", "detail_status", "model_number")


@query("bundle_counts", f"""
SELECT 'shop' || p_size || '.example.com' AS site, 3 * count(*) AS listings, 3 * count(*) AS detail_pages,
  count(*) FILTER (p_size >= 10) AS model_numbers, sum(CASE WHEN p_size > 20 THEN 3 ELSE 1 END) AS api_pages, 2 * count(*) AS categories,
  3 * count(*) AS images, 4 * count(*) AS links, 0 AS metadata, 0 AS structured_data FROM part GROUP BY p_size""")
def bundle_counts(spark, folder):
    counts = B.Bundle(_mixed(spark, folder)).counts
    return counts.select("site", *[F.col(c).cast("bigint").alias(c) for c in B.COUNTERS])


@query("bundle_website", f"""
WITH pages AS (SELECT p_size, {SHOP} || '/products/' || lower(p_type) AS url FROM part
  UNION SELECT p_size, {SHOP} || '/products/' || lower(p_type) || '-' || substr(p_brand, 7) FROM part)
SELECT 'shop' || p_size || '.example.com' AS site, count(*) AS listings FROM pages GROUP BY p_size""")
def bundle_website(spark, folder):
    """Website mode: listings of all catalog pages of each site, one per URL, without a limit."""
    rows = B.Bundle(FX.catalog_corpus(spark, folder), mode="website").listings
    return rows.groupBy("site").agg(F.count(F.lit(1)).alias("listings"))

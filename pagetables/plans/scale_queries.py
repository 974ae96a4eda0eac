"""Queries over whole texts, charsets, large scopes and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.operators import bundle as B
from pagetables.operators import listings, nodes
from pagetables.operators import vocabulary as V
from pagetables.plans import fixtures as FX
from pagetables.plans import sqltext as Q
from pagetables.plans.corpus_queries import pages_of
from pagetables.plans.page_queries import DETAIL_SQL, SHOP
from pagetables.plans.registry import query, table
from pagetables.sinks import snapshots, typed
from pagetables.sources.pages import decode_pages
from pagetables.streaming import streams as ST

LONG = "trim(repeat(p_name || ' ', 150))"


@query("element_texts", f"""
WITH n AS (SELECT p_partkey AS page_id, unnest([
  struct_pack(pos := 0, end_pos := 4, tag := 'document', text := 'é ' || p_brand || ' ' || {LONG} || ' ' || p_type),
  struct_pack(pos := 1, end_pos := 4, tag := 'div', text := 'é ' || p_brand || ' ' || {LONG} || ' ' || p_type),
  struct_pack(pos := 2, end_pos := 3, tag := 'section', text := 'é ' || p_brand || ' ' || {LONG}),
  struct_pack(pos := 3, end_pos := 3, tag := 'p', text := {LONG}),
  struct_pack(pos := 4, end_pos := 4, tag := 'b', text := p_type)], recursive := true) FROM part)
SELECT page_id, pos, end_pos, tag, text FROM n""")
def element_texts(spark, folder):
    """Elements of some 5,000 characters, one inside the other; an element's own text comes before that of its children."""
    html = "'<div><section><p>' || repeat(p_name || ' ', 150) || '</p> é ' || p_brand || '</section><b>' || p_type || '</b></div>'"
    ropes = nodes.page_ropes(FX._pages(spark, folder, f"{SHOP} || '/long/' || p_partkey", html))
    return nodes.element_texts(ropes).select("page_id", "pos", "end_pos", "tag", "text")


# letters that stand for digits in each charset, so that every page holds some
LETTERS = {"utf-8": "абвгдежзик", "windows-1256": "ابتثجحخدذر", "shift_jis": "アイウエオカキクケコ", "utf-16": "ÀÉÎÕÜ漢字仮名交"}


def _letters(charset: str) -> str:
    return f"translate(CAST(page_id AS STRING), '0123456789', '{LETTERS[charset]}')"


def _case(parts: dict[str, str]) -> str:
    kinds = list(LETTERS)
    return "CASE page_id % 4 " + " ".join(f"WHEN {i} THEN {parts[k]}" for i, k in enumerate(kinds)) + " END"


@query("decode_pages", f"""
SELECT page_id, url, {_case({k: _letters(k) for k in LETTERS}).replace("STRING", "VARCHAR")} || ' ' || regexp_replace(html, '[^\\x00-\\x7f]', '', 'g') AS html
FROM pages""")
def decode_charsets(spark, folder):
    """Every page in one of four charsets: told by the content type, by a meta tag, by a byte order mark, or not at all.

    Its text is that of the given page without letters beyond ASCII, after its number in letters of the charset.
    """
    plain = F.concat(F.expr(_case({k: _letters(k) for k in LETTERS})), F.lit(" "), F.regexp_replace("html", "[^\\x00-\\x7f]", ""))
    kind = F.element_at(F.array(*[F.lit(k) for k in LETTERS]), (F.col("page_id") % 4 + 1).cast("int"))
    pages = pages_of(spark, folder).select("page_id", "url", plain.alias("text"), kind.alias("kind"))

    def encoded(batches):
        for batch in batches:
            data = [
                # the meta tag of the given pages names UTF-8, so the page in Shift JIS names its own first
                None if t is None else (f'<meta charset="{k}">' if k == "shift_jis" else "").encode() + t.encode(k) for t, k in zip(batch["text"], batch["kind"])
            ]
            yield batch[["page_id", "url", "kind"]].assign(html=data)

    stored = pages.mapInPandas(encoded, "page_id bigint, url string, kind string, html binary")
    told = F.when(F.col("kind") == "windows-1256", F.lit("text/html; charset=windows-1256"))
    read = decode_pages(stored.withColumn("content_type", told), "content_type")
    return read.withColumn("html", F.regexp_replace("html", '^<meta charset="shift_jis">', ""))


GREEDY_SCOPE = """o_orderpriority || ' ' || CAST(year(o_orderdate) * 12 + month(o_orderdate) AS {text}) AS scope, o_orderkey,
  'm' || CAST(o_custkey % 7 AS {text}) AS mark, CASE o_orderkey % 5 WHEN 0 THEN '' ELSE 'l' || CAST((o_orderkey * 7 + o_custkey) % 6 AS {text}) END AS link"""


@query("greedy_dedup_scope", f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY o_orderkey) AS rn FROM (SELECT {GREEDY_SCOPE.format(text="VARCHAR")} FROM orders)),
g AS (
  SELECT scope, rn, o_orderkey, mark, link, true AS keep, [mark] AS marks, [link] AS links FROM r WHERE rn = 1
  UNION ALL
  SELECT scope, rn, o_orderkey, mark, link, keep, CASE WHEN keep THEN list_append(marks, mark) ELSE marks END, CASE WHEN keep THEN list_append(links, link) ELSE links END
  FROM (SELECT r.*, marks, links, NOT list_contains(marks, r.mark) AND NOT (r.link <> '' AND list_contains(links, r.link)) AS keep
        FROM g JOIN r ON r.scope = g.scope AND r.rn = g.rn + 1))
SELECT scope, o_orderkey, mark, link FROM g WHERE keep""")
def greedy_dedup_scope(spark, folder):
    orders = table(spark, folder, "orders").selectExpr(*_columns(GREEDY_SCOPE.format(text="STRING")))
    return listings.greedy_dedup_scope(orders, ["scope"], ["o_orderkey"])


def _columns(text: str) -> list[str]:
    scope, rest = text.split(" AS scope, o_orderkey,")
    mark, link = rest.split(" AS mark, ")
    return [f"{scope} AS scope", "o_orderkey", f"{mark} AS mark", link]


@query("bundle_snapshot", f"""
WITH {DETAIL_SQL}
SELECT {Q.host("detail_url")} AS site, unnest(['Images', 'Structured Data']) AS sheet, unnest([2, 3]) * count(*) AS n FROM details GROUP BY 1""")
def bundle_snapshot(spark, folder):
    """What readers see after one run was committed and a second one stopped between two tables."""
    bundle = B.Bundle(FX.jsonld_pages(spark, folder))
    path = f"{ST.scratch(spark)}/bundle"
    snapshots.commit_bundle({"Images": bundle.images, "Structured Data": bundle.structured_data}, path, "first")
    twice = F.explode(F.array(F.lit(1), F.lit(2)))  # pages are read once for both copies
    snapshots.write_bundle({"Images": bundle.images.withColumn("_copy", twice).drop("_copy")}, f"{path}/runs/second")
    counted = [
        t.groupBy("site").agg(F.count(F.lit(1)).alias("n")).select("site", F.lit(name).alias("sheet"), "n")
        for name, t in snapshots.read_bundle(spark, path).items()
    ]
    return counted[0].unionByName(counted[1])


def _observed_payloads(spark, folder):
    """Listings and details of the same products in one table, and payloads that are null."""
    listed = FX.store_products(spark, folder).selectExpr("p_partkey", "'list' AS kind", "payload")
    details = FX.store_details(spark, folder).selectExpr("p_partkey", "IF(arrived = 1, 'null', 'detail') AS kind", "payload")
    return listed.union(details)


@query("payload_schema", """
WITH c AS (SELECT count(*) AS a, count(*) FILTER (p_size <= 35) AS d, count(*) FILTER (p_size < 20) AS w, count(*) FILTER (p_size BETWEEN 13 AND 35) AS i FROM part)
SELECT unnest(['id', 'name', 'price']) AS key, a + d AS n, unnest(['BIGINT', 'STRING', 'DECIMAL']) AS type FROM c
UNION ALL SELECT unnest(['model', 'sku', 'regular_price', 'currency', 'status', 'is_available', 'category', 'brand', 'url', 'description', 'original_image']),
  a, unnest(['STRING', 'STRING', 'BIGINT', 'STRING', 'STRING', 'BOOLEAN', 'VARIANT', 'VARIANT', 'STRING', 'STRING', 'STRING']) FROM c
UNION ALL SELECT unnest(['quantity', 'images', 'weight', 'gtin']), unnest([a + w, a + i, w, d]), unnest(['BIGINT', 'VARIANT', 'DECIMAL', 'BIGINT']) FROM c""")
def payload_schema(spark, folder):
    fields = typed.payload_schema(_observed_payloads(spark, folder))
    return fields.select("key", "n", F.regexp_replace("type", "^DECIMAL.*", "DECIMAL").alias("type"))


@query("typed_payloads", """
SELECT p_partkey, 'list' AS kind, p_partkey AS id, p_name AS name, CASE WHEN p_size > 40 THEN 'MD-' || p_partkey END AS model,
  CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS BIGINT) AS quantity, p_size > 3 AS is_available,
  '{"id":1,"name":"' || p_type || '"}' AS category, CAST(NULL AS BIGINT) AS gtin, CAST(NULL AS DOUBLE) AS weight FROM part
UNION ALL SELECT p_partkey, 'detail', p_partkey, CASE WHEN p_size > 10 THEN 'Detail ' || p_name ELSE '' END, NULL, NULL, NULL, NULL, NULL,
  p_partkey, CASE WHEN p_size < 20 THEN 1.5 END FROM part WHERE p_size <= 35
UNION ALL SELECT p_partkey, 'null', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_size <= 35""")
def typed_payloads(spark, folder):
    """Sixteen columns by frequency; the two fields that only details have are in the rest."""
    rows = typed.typed_table(_observed_payloads(spark, folder), width=16)
    return rows.select(
        "p_partkey", "kind", "id", "name", "model", F.when(F.col("kind") == "list", F.col("price").cast("double")).alias("price"),
        "quantity", "is_available", F.to_json("category").alias("category"),
        F.try_variant_get("rest", "$.gtin", "bigint").alias("gtin"), F.try_variant_get("rest", "$.weight", "double").alias("weight"),
    )


def _page_words(spark, folder):
    """Words of benchmark items, in groups by their length, longer ones with more points."""
    words = table(spark, folder, "benchmark").select(F.explode(F.split(V.plain_lower("text"), "[^a-z]+")).alias("token"))
    size = F.length("token")
    return words.filter(size >= 3).select("token", F.when(size < 6, "short").otherwise("long").alias("group"), size.alias("points"))


@query("vocabulary_scores", """
WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')) AS token FROM benchmark),
v AS (SELECT token, CASE WHEN length(token) < 6 THEN 'short' ELSE 'long' END AS "group", length(token) AS points FROM w WHERE length(token) >= 3)
SELECT page_id, "group", count(*) AS tokens, CAST(sum(points) AS BIGINT) AS points
FROM (SELECT page_id, translate(html, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS html FROM pages) JOIN v ON contains(html, token)
GROUP BY ALL""")
def vocabulary_scores(spark, folder):
    return V.vocabulary_scores(table(spark, folder, "pages"), ["page_id"], "html", _page_words(spark, folder))

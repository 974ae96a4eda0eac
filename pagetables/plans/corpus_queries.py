"""Queries over the page corpus: scan, links, titles, URLs, catalog discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.functions import html as H
from pagetables.functions import text as X
from pagetables.functions import urls as U
from pagetables.operators import catalog, merge, pages as P, ranking
from pagetables.plans import sqltext as Q
from pagetables.plans.registry import query, table
from pagetables.sources.pages import page_status, usable_pages

# words of the generated corpus; the defaults target furniture shops
VOCABULARY = {
    "strong": ["/the", "/of", "/und"],
    "weak": ["de", "la", "is", "was"],
    "words": ["the", "in", "la", "los"],
    "denied": "en|ie",
}


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


@query("read_pages", f"""
SELECT page_id, url, {Q.host("url")} AS site, CAST(strlen(html) AS BIGINT) AS n_bytes,
       CASE WHEN strlen(html) > 20000 THEN 'page too large' ELSE 'ok' END AS status
FROM pages""")
def read_pages(spark, folder):
    return page_status(pages_of(spark, folder), max_bytes=20_000).select(
        "page_id", "url", "site", F.col("n_bytes").cast("bigint").alias("n_bytes"), "status"
    )


@query("normalize_url", f"""
WITH {Q.LINKS}
SELECT page_id, pos, {Q.root("href")} || replace(replace(url_encode({Q.path("href")}), '%2F', '/'), '%25', '%') AS url
FROM links""")
def normalize_url(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None)
    return links.select("page_id", "pos", U.normalize_url("href").alias("url"))


@query("page_title", f"""
SELECT page_id, {Q.clean(Q.decode("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))} AS title FROM pages""")
def page_title(spark, folder):
    return P.page_title(pages_of(spark, folder))


@query("page_text", f"""
SELECT page_id, {Q.clean(Q.decode(f"regexp_replace({Q.visible('html')}, '<[^>]*>', ' ', 'g')"))} AS text FROM pages""")
def page_text(spark, folder):
    return P.page_text(pages_of(spark, folder))


@query("page_links", f"WITH {Q.LINKS} SELECT page_id, page_url, pos, href, text FROM links WHERE pos < 1000")
def page_links(spark, folder):
    return P.page_links(pages_of(spark, folder))


@query("html_to_text", f"""
SELECT page_id, {Q.clean(Q.decode("regexp_replace(html, '<[^>]+>', ' ', 'g')"))} AS text FROM pages""")
def html_to_text(spark, folder):
    return pages_of(spark, folder).select("page_id", X.html_to_text("html").alias("text"))


@query("clean_text", f"SELECT doc_id, {Q.clean('text')} AS text FROM documents")
def clean_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.clean_text("text").alias("text"))


_CODES = X.CURRENCY_CODES
_PRICE_SQL = (
    rf"(?i)(?:(?:{_CODES}){Q.SPACE}*)?(?:[$€£₹]|د\.إ|ر\.س|ريال|AED|SAR)?{Q.SPACE}*"
    rf"[0-9]{{1,3}}(?:(?:,|{Q.SPACE})[0-9]{{3}})*(?:[.,][0-9]{{2}})?{Q.SPACE}*(?:{_CODES}|ريال)?"
)


@query("first_price", f"""
SELECT doc_id, {Q.clean(f"regexp_extract(text, '{_PRICE_SQL}', 0)")} AS price FROM documents""")
def first_price(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.first_price("text").alias("price"))


@query("same_site", f"""
WITH {Q.LINKS}
SELECT page_id, pos, {Q.host("page_url")} AS site, {Q.host("href")} = {Q.host("page_url")} AS same FROM links""")
def same_site(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None)
    return links.select(
        "page_id", "pos", U.site_of("page_url").alias("site"), U.same_site("href", "page_url").alias("same")
    )


@query("same_site_links", f"""
WITH {Q.LINKS}
SELECT {Q.host("page_url")} AS site, count(*) AS links, count(DISTINCT href) AS urls
FROM links WHERE {Q.host("href")} = {Q.host("page_url")} GROUP BY 1""")
def same_site_links(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None).filter(U.same_site("href", "page_url"))
    per_url = links.groupBy(U.site_of("page_url").alias("site"), "href").agg(F.count(F.lit(1)).alias("n"))
    return per_url.groupBy("site").agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("urls"))


_REFS = ["a/b", "../x", "./y", "?q=1", "#f", "//cdn.x/y", "https://o.example/z", "", "/a/../b", "c/../d/."]


@query("resolve_url", f"""
WITH p AS (
  SELECT page_id, url, {Q.root("url")} AS r, {Q.path("url")} AS pth,
         regexp_replace({Q.path("url")}, '[^/]*$', '') AS dir,
         regexp_extract(url, '(\\?[^#]*)', 1) AS qs
  FROM pages
), e AS (
  SELECT *, unnest({_REFS!r}) AS ref FROM p
)
SELECT page_id, ref, CASE ref
  WHEN 'a/b' THEN r || dir || 'a/b'
  WHEN '../x' THEN r || regexp_replace(dir, '[^/]+/$', '') || 'x'
  WHEN './y' THEN r || dir || 'y'
  WHEN '?q=1' THEN r || pth || '?q=1'
  WHEN '#f' THEN r || pth || qs || '#f'
  WHEN '//cdn.x/y' THEN {Q.scheme("url")} || '://cdn.x/y'
  WHEN 'https://o.example/z' THEN ref
  WHEN '' THEN ''
  WHEN '/a/../b' THEN r || '/b'
  WHEN 'c/../d/.' THEN r || dir || 'd/' END AS resolved
FROM e""")
def resolve_url(spark, folder):
    refs = F.explode(F.array(*[F.lit(r) for r in _REFS])).alias("ref")
    rows = pages_of(spark, folder).select("page_id", "url", refs)
    return rows.select("page_id", "ref", U.resolve_url("url", "ref").alias("resolved"))


@query("looks_like_product_url", f"""
WITH {Q.LINKS}
SELECT page_id, pos, regexp_matches(p, '/the|/o') OR regexp_matches(p, '/p[0-9]+') AS product_like
FROM (SELECT page_id, pos, lower({Q.path("href")}) AS p FROM links)""")
def looks_like_product_url(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None)
    return links.select(
        "page_id", "pos", U.looks_like_product_url("href", ["/the", "/o"]).alias("product_like")
    )


@query("region_prefix", f"""
WITH r AS (SELECT page_id, url, regexp_extract({Q.path("url")}, '^/+([^/]+)', 1) AS first FROM pages)
SELECT page_id, CASE WHEN regexp_matches(first, '^[a-zA-Z][a-zA-Z](-[a-zA-Z][a-zA-Z])?$') THEN '/' || first ELSE '' END AS prefix,
       {Q.root("url")} || CASE WHEN regexp_matches(first, '^[a-zA-Z][a-zA-Z](-[a-zA-Z][a-zA-Z])?$') THEN '/' || first ELSE '' END
       || '/products/item-' || page_id AS product_url
FROM r""")
def region_prefix(spark, folder):
    slug = F.concat(F.lit("/item-"), F.col("page_id").cast("string"), F.lit("/ "))
    return pages_of(spark, folder).select(
        "page_id", U.region_prefix("url").alias("prefix"), U.product_url("url", slug).alias("product_url")
    )


@query("title_from_url", f"""
SELECT page_id, {Q.clean(Q.title_case("replace(regexp_extract(rtrim(" + Q.path("url") + ", '/'), '([^/]*)$', 1), '-', ' ')"))} AS title
FROM pages""")
def title_from_url(spark, folder):
    return pages_of(spark, folder).select("page_id", U.title_from_url("url").alias("title"))


@query("title_case", f"""
WITH {Q.LINKS} SELECT page_id, pos, coalesce({Q.title_case("text")}, '') AS title FROM links""")
def title_case(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None)
    return links.select("page_id", "pos", X.title_case("text").alias("title"))


@query("site_root", f"SELECT page_id, {Q.root('url')} AS root FROM pages")
def site_root(spark, folder):
    return pages_of(spark, folder).select("page_id", U.site_root("url").alias("root"))


@query("catalog_link_score", f"""
WITH {Q.LINKS},
p AS (SELECT page_id, pos, lower({Q.path("href")}) AS p, lower(text) AS t FROM links)
SELECT page_id, pos, CASE WHEN p = '' OR regexp_matches(p, '/(?:en|ie)(?:/|$)') THEN 0 ELSE
  (CASE WHEN regexp_matches(p, '/the|/of|/und') THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(p, 'de|la|is|was') THEN 2 ELSE 0 END)
  + (CASE WHEN regexp_matches(t, '(?:^|[^\\p{{L}}\\p{{N}}_])(the|in|la|los)(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 1 ELSE 0 END) END AS score
FROM p""")
def catalog_link_score(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None)
    return links.select("page_id", "pos", U.catalog_link_score("href", "text", **VOCABULARY).alias("score"))


DISCOVERED = f"""
scored AS (
  SELECT {Q.host("page_url")} AS site, href AS url, text, page_id, pos,
    CASE WHEN regexp_matches(lower({Q.path("href")}), '/(?:en|ie)(?:/|$)') THEN 0 ELSE
    (CASE WHEN regexp_matches(lower({Q.path("href")}), '/the|/of|/und') THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(lower({Q.path("href")}), 'de|la|is|was') THEN 2 ELSE 0 END)
    + (CASE WHEN regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])(the|in|la|los)(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 1 ELSE 0 END) END AS score
  FROM links
),
best AS (
  SELECT * FROM scored WHERE score > 0
  QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY score DESC, page_id, pos) = 1
),
discovered AS (
  SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY score DESC, url) AS INTEGER) AS rank, url, text AS name, score
  FROM best QUALIFY row_number() OVER (PARTITION BY site ORDER BY score DESC, url) <= 40
)"""


@query("discover_catalog_urls", f"WITH {Q.LINKS}, {DISCOVERED} SELECT site, rank, url, name, score FROM discovered")
def discover_catalog_urls(spark, folder):
    return catalog.discover_catalog_urls(usable_pages(pages_of(spark, folder)), k=catalog.CATALOG_PAGES, **VOCABULARY)


@query("topk_by_score", f"""
WITH {Q.LINKS}, {DISCOVERED}
SELECT site, rank, url, score FROM discovered WHERE rank <= 3""")
def topk_by_score(spark, folder):
    found = catalog.discover_catalog_urls(usable_pages(pages_of(spark, folder)), k=catalog.CATALOG_PAGES, **VOCABULARY)
    top = ranking.top_k(found.drop("rank"), ["site"], [F.col("score").desc(), F.col("url")], 3, "rank")
    return top.select("site", "rank", "url", "score")


@query("first_per_key", f"""
WITH {Q.LINKS}
SELECT page_id, pos, href, text FROM links
QUALIFY row_number() OVER (PARTITION BY href ORDER BY page_id, pos) = 1""")
def first_per_key(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None).drop("page_url")
    return ranking.first_per_key(links, ["href"], [F.col("page_id"), F.col("pos")])


@query("cap_per_site", f"""
WITH {Q.LINKS}
SELECT {Q.host("page_url")} AS site, page_id, pos, href FROM links
QUALIFY row_number() OVER (PARTITION BY {Q.host("page_url")} ORDER BY page_id, pos) <= 50""")
def cap_per_site(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None)
    rows = links.select(U.site_of("page_url").alias("site"), "page_id", "pos", "href")
    return ranking.cap_per_site(rows, 50, [F.col("page_id"), F.col("pos")])


@query("merge_by_key", f"""
WITH {Q.LINKS},
r AS (
  SELECT CASE WHEN text LIKE 'de%' THEN '' ELSE href END AS url, page_id, pos,
         CASE WHEN length(text) > 4 THEN text ELSE '' END AS title,
         CASE WHEN pos > 2 THEN page_id ELSE 0 END AS seen_on
  FROM links
)
SELECT url, min(struct_pack(a := page_id, b := pos)).a AS page_id, min(struct_pack(a := page_id, b := pos)).b AS pos,
  coalesce(arg_min(title, struct_pack(a := page_id, b := pos)) FILTER (title <> ''), '') AS title,
  coalesce(arg_min(seen_on, struct_pack(a := page_id, b := pos)) FILTER (seen_on <> 0), 0) AS seen_on
FROM r WHERE url <> '' GROUP BY url
UNION ALL SELECT url, page_id, pos, title, seen_on FROM r WHERE url = ''""")
def merge_by_key(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None)
    rows = links.select(
        F.when(F.col("text").startswith("de"), F.lit("")).otherwise(F.col("href")).alias("url"),
        "page_id",
        "pos",
        F.when(F.length("text") > 4, F.col("text")).otherwise(F.lit("")).alias("title"),
        F.when(F.col("pos") > 2, F.col("page_id")).otherwise(F.lit(0)).cast("bigint").alias("seen_on"),
    )
    return merge.merge_by_key(rows, "url", ["page_id", "pos"])


@query("restore_order", f"""
WITH {Q.LINKS} SELECT page_id, pos, href FROM links ORDER BY page_id, pos""")
def restore_order(spark, folder):
    return ranking.restore_order(
        P.page_links(pages_of(spark, folder), limit=None).select("page_id", "pos", "href"), "page_id", "pos"
    )


@query("union_tables", f"""
WITH {Q.LINKS}
SELECT page_id, pos, href, text, CAST(NULL AS VARCHAR) AS title FROM links
UNION ALL
SELECT page_id, NULL, NULL, NULL, {Q.clean(Q.decode("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))} FROM pages""")
def union_tables(spark, folder):
    corpus = pages_of(spark, folder)
    return ranking.union_tables(
        P.page_links(corpus, limit=None).select("page_id", "pos", "href", "text"), P.page_title(corpus)
    )


@query("concat_distinct", f"""
WITH {Q.LINKS}
SELECT page_id, string_agg(text, ' | ' ORDER BY pos) AS texts FROM (
  SELECT page_id, pos, text FROM links QUALIFY row_number() OVER (PARTITION BY page_id, text ORDER BY pos) = 1
) GROUP BY page_id""")
def concat_distinct(spark, folder):
    texts = F.transform(H.link_array("html"), lambda l: l["text"])
    return pages_of(spark, folder).filter(F.size(texts) > 0).select("page_id", X.concat_distinct(texts).alias("texts"))


@query("clean_warnings", """
SELECT event_id, trim(CASE WHEN event_type = 'error' THEN 'job ' || user_id || ' failed' ELSE '' END
  || CASE WHEN event_type = 'error' AND value > 20 THEN ' ' ELSE '' END
  || CASE WHEN value > 20 THEN 'slow page' ELSE '' END) AS warning
FROM events""")
def clean_warnings(spark, folder):
    notice = (
        "The HTTPS certificate could not be verified by this Python installation, "
        "so the page was fetched with relaxed certificate checking."
    )
    events = table(spark, folder, "events")
    failed = F.when(F.col("event_type") == "error", F.format_string("job %d failed", "user_id"))
    slow = F.when(F.col("value") > 20, F.lit("slow  page "))
    known = F.when(F.col("event_type") != "click", F.lit(notice))
    return events.select("event_id", X.clean_warnings(failed, known, slow).alias("warning"))


@query("normalize_email", """
SELECT c_custkey, lower(replace(c_name, '#', '')) || '@example.com' AS email FROM customer""")
def normalize_email(spark, folder):
    address = F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("")), F.lit("@Example.COM\t"))
    return table(spark, folder, "customer").select("c_custkey", X.normalize_email(address).alias("email"))

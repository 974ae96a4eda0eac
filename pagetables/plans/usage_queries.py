"""Queries over events, accounts, sheets, bundles and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetables.functions.urls import site_of
from pagetables.operators import accounts as A
from pagetables.operators import bundle as B
from pagetables.operators import details, pages as P
from pagetables.plans import fixtures as FX
from pagetables.plans import sqltext as Q
from pagetables.plans.corpus_queries import pages_of
from pagetables.plans.page_queries import DETAIL_SQL
from pagetables.plans.registry import SQL, query, table
from pagetables.sinks import sheets as SH
from pagetables.streaming import streams as ST
from pagetables.streaming import timed as TM

DAYS = 5  # shorter than the default, so that subscriptions expire inside the data


def usage(spark, folder):
    """Events as account activity: purchases activate a plan, views are requests."""
    plan = F.when(F.col("event_type") == "purchase", F.when(F.col("value") >= 50, F.lit("pro")).otherwise(F.lit("category")))
    return table(spark, folder, "events").select(
        "event_id", "ts", F.col("user_id").alias("user"), "event_type", plan.alias("plan")
    )


USAGE_SQL = """
usage AS (
  SELECT event_id, ts, user_id AS "user", event_type,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN value >= 50 THEN 'pro' ELSE 'category' END END AS plan FROM events),
active AS (
  SELECT *, last_value(plan IGNORE NULLS) OVER w AS active_plan,
    last_value(CASE WHEN plan IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS activated_at
  FROM usage WINDOW w AS (PARTITION BY "user" ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
planned AS (
  SELECT event_id, ts, "user", event_type, CASE WHEN "user" IN (3, 7, 11) THEN 'pro'
    WHEN active_plan IS NOT NULL AND activated_at + INTERVAL 5 DAY > ts THEN active_plan ELSE 'free' END AS effective_plan FROM active),
requests AS (
  SELECT *, count(*) FILTER (effective_plan = 'free') OVER (PARTITION BY "user" ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
  FROM planned WHERE event_type = 'view')"""


@query("subscription_periods", """
SELECT event_id, user_id AS "user", ts, CASE WHEN value >= 50 THEN 'pro' ELSE 'category' END AS plan,
  least(ts + INTERVAL 5 DAY, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS period_end
FROM events WHERE event_type = 'purchase'""")
def subscription_periods(spark, folder):
    activations = usage(spark, folder).filter("plan IS NOT NULL").drop("event_type")
    return A.subscription_periods(activations, days=DAYS)


@query("subscription_asof", f"""
WITH {USAGE_SQL} SELECT event_id, "user", active_plan, activated_at FROM active WHERE event_type = 'view'""")
def subscription_asof(spark, folder):
    events = usage(spark, folder).filter("event_type IN ('view', 'purchase')")
    rows = A.subscription_asof(events).filter("event_type = 'view'")
    return rows.select("event_id", "user", "active_plan", "activated_at")


@query("effective_plan", f"""WITH {USAGE_SQL} SELECT event_id, "user", effective_plan FROM planned""")
def effective_plan(spark, folder):
    return A.effective_plan(usage(spark, folder), days=DAYS, lifetime=[3, 7, 11]).select("event_id", "user", "effective_plan")


@query("free_quota", f"""
WITH {USAGE_SQL}
SELECT event_id, "user", effective_plan, effective_plan <> 'free' OR n <= 3 AS allowed,
  CAST(least(n, 3) AS INTEGER) AS used, CAST(greatest(0, 3 - n) AS INTEGER) AS remaining FROM requests""")
def free_quota(spark, folder):
    events = usage(spark, folder).filter("event_type IN ('view', 'purchase')")
    requests = A.effective_plan(events, days=DAYS, lifetime=[3, 7, 11]).filter("event_type = 'view'")
    return A.free_quota(requests).select("event_id", "user", "effective_plan", "allowed", "used", "remaining")


@query("plan_gate", """
SELECT event_id, CASE WHEN value < 5 THEN 'invalid mode' WHEN event_type = 'click' AND value < 30 THEN 'category plan covers single categories only' END AS reason
FROM events""")
def plan_gate(spark, folder):
    mode = F.when(F.col("value") < 5, F.lit("other")).when(F.col("value") < 30, F.lit("website")).otherwise(F.lit("category"))
    plan = F.when(F.col("event_type") == "click", F.lit("category")).otherwise(F.lit("pro"))
    requests = table(spark, folder, "events").select("event_id", plan.alias("plan"), mode.alias("mode"))
    return A.plan_gate(requests).select("event_id", "reason")


@query("account_state", """
WITH u AS (
  SELECT lower(replace(c_name, '#', '')) || '@example.com' AS email, o_orderdate AS ts, o_orderkey AS update_id,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'N' || o_orderkey ELSE '' END AS name,
    CASE WHEN o_totalprice > 200000 THEN 'pic' || o_orderkey END AS picture,
    CASE WHEN o_orderpriority LIKE '2%' THEN o_orderkey % 4 END AS used
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT email, coalesce(arg_max(name, struct_pack(a := ts, b := update_id)) FILTER (name <> ''), email) AS name,
  coalesce(arg_max(picture, struct_pack(a := ts, b := update_id)) FILTER (picture <> ''), '') AS picture,
  min(ts) AS created_at, max(ts) AS updated_at, coalesce(arg_max(used, struct_pack(a := ts, b := update_id)) FILTER (used IS NOT NULL), 0) AS free_scrapes_used,
  CASE WHEN email = 'customer000000005@example.com' THEN 'pro' ELSE 'free' END AS plan,
  CASE WHEN email = 'customer000000005@example.com' THEN 'lifetime' ELSE 'free' END AS plan_status, '' AS subscription_id,
  0 AS subscription_expires_at, 0 AS subscription_checked_at, email = 'customer000000005@example.com' AS lifetime_access
FROM u GROUP BY email""")
def account_state(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    updates = table(spark, folder, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("")), F.lit("@Example.com")).alias("email"),
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("update_id"),
        F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("N"), F.col("o_orderkey"))).otherwise(F.lit("")).alias("name"),
        F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("pic"), F.col("o_orderkey"))).alias("picture"),
        F.when(F.col("o_orderpriority").startswith("2"), F.col("o_orderkey") % 4).alias("free_scrapes_used"),
    )
    return A.account_state(updates, ["customer000000005@example.com"])


def account_rows(spark, folder):
    """One account per customer, its subscription facts derived from its balance."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("account"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_acctbal") > 5000, F.lit("pro")).when(F.col("c_acctbal") > 0, F.lit("category")).otherwise(F.lit("free")).alias("plan"),
        F.when(F.col("c_acctbal") > 0, F.lit("active")).otherwise(F.lit("free")).alias("plan_status"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("c_nationkey") * 86400).alias("expires_at"),
        F.timestamp_seconds(F.lit(1704967200) + F.col("c_nationkey") * 3600).alias("checked_at"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("sub-"), F.col("c_custkey"))).otherwise(F.lit("")).alias("subscription_id"),
        F.col("c_nationkey").alias("free_used"),
        (F.col("c_mktsegment") == "BUILDING").alias("lifetime"),
    )


NOW = "TIMESTAMP '2024-01-11 16:00:00'"
ACCOUNT_SQL = """
account AS (
  SELECT c_custkey AS account, lower(replace(c_name, '#', '')) || '@example.com' AS email,
    CASE WHEN c_acctbal > 5000 THEN 'pro' WHEN c_acctbal > 0 THEN 'category' ELSE 'free' END AS plan,
    CASE WHEN c_acctbal > 0 THEN 'active' ELSE 'free' END AS plan_status,
    TIMESTAMP '2024-01-01 00:00:00' + c_nationkey * INTERVAL 1 DAY AS expires_at,
    TIMESTAMP '2024-01-11 10:00:00' + c_nationkey * INTERVAL 1 HOUR AS checked_at,
    CASE WHEN c_acctbal > 0 THEN 'sub-' || c_custkey ELSE '' END AS subscription_id,
    c_nationkey AS free_used, c_mktsegment = 'BUILDING' AS lifetime, c_nationkey AS nation FROM customer)"""


@query("account_report", f"""
WITH {ACCOUNT_SQL},
p AS (SELECT *, CASE WHEN lifetime THEN 'pro' WHEN plan <> 'free' AND expires_at > {NOW} THEN plan ELSE 'free' END AS now_plan FROM account)
SELECT email, now_plan AS plan, CASE now_plan WHEN 'pro' THEN 'Full Access' WHEN 'category' THEN 'Category' ELSE 'Free' END AS label,
  CASE WHEN lifetime THEN 'lifetime' ELSE plan_status END AS plan_status, strftime(expires_at, '%Y-%m-%d') AS expires_label,
  free_used, 3 AS free_limit, greatest(0, 3 - free_used) AS free_remaining, lifetime FROM p""")
def account_report(spark, folder):
    return A.account_report(account_rows(spark, folder), F.expr(NOW))


@query("stale_subscriptions", f"""
WITH {ACCOUNT_SQL}
SELECT account, email FROM account WHERE subscription_id <> '' AND NOT lifetime AND checked_at + INTERVAL 6 HOUR <= {NOW}""")
def stale_subscriptions(spark, folder):
    return A.stale_subscriptions(account_rows(spark, folder), F.expr(NOW)).select("account", "email")


_PAYLOAD = """'{"status":"' || (CASE WHEN free_used > 20 THEN 'paused' WHEN free_used > 15 THEN '' ELSE 'active' END) || '","current_period_end":'
  || (CASE WHEN free_used > 10 THEN 0 ELSE 1706745600 + account END) || ',"items":{"data":[' ||
  (CASE WHEN free_used > 12 THEN '' ELSE '{"current_period_end":1704067200},{"current_period_end":' || (1704067200 + account) || '}' END) || ']}}'"""


@query("period_end", f"""
WITH {ACCOUNT_SQL}
SELECT account, CASE WHEN nation <= 10 THEN 1706745600 + account WHEN nation <= 12 THEN 1704067200 + account ELSE 0 END AS period_end FROM account""")
def period_end(spark, folder):
    return account_rows(spark, folder).select("account", A.period_end(F.expr(_PAYLOAD)).alias("period_end"))


@query("refresh_subscriptions", f"""
WITH {ACCOUNT_SQL},
e AS (SELECT *, CASE WHEN nation <= 10 THEN TIMESTAMP '2024-02-01 00:00:00' + account * INTERVAL 1 SECOND
  WHEN nation <= 12 THEN TIMESTAMP '2024-01-01 00:00:00' + account * INTERVAL 1 SECOND ELSE expires_at END AS renewed FROM account)
SELECT account, CASE WHEN nation > 20 THEN least(renewed, {NOW}) ELSE renewed END AS expires_at,
  CASE WHEN nation > 20 THEN 'paused' WHEN nation > 15 THEN plan_status ELSE 'active' END AS plan_status FROM e""")
def refresh_subscriptions(spark, folder):
    rows = account_rows(spark, folder).withColumn("payload", F.expr(_PAYLOAD))
    return A.refresh_subscriptions(rows, "payload", F.expr(NOW)).select("account", "expires_at", "plan_status")


def job_updates(events):
    status = F.when(F.col("event_type") == "error", F.lit("error")).when(F.col("event_type") == "purchase", F.lit("complete")).when(
        F.col("event_type") == "view", F.lit("running"))
    return events.select(
        F.col("user_id").alias("job"), "ts", "event_id", status.alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed at "), F.col("event_id"))).alias("message"),
        F.get_json_object("props", "$.k").cast("int").alias("counts"),
    )


@query("job_latest", """
WITH u AS (
  SELECT user_id AS job, ts, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' WHEN 'view' THEN 'running' END AS status,
    CASE WHEN event_type = 'error' THEN 'failed at ' || event_id END AS message, CAST(json_extract_string(props, '$.k') AS INTEGER) AS counts FROM events)
SELECT job, arg_max(status, struct_pack(a := ts, b := event_id)) FILTER (status IS NOT NULL) AS status,
  arg_max(message, struct_pack(a := ts, b := event_id)) FILTER (message IS NOT NULL) AS message,
  arg_max(counts, struct_pack(a := ts, b := event_id)) FILTER (counts IS NOT NULL) AS counts,
  min(ts) AS created_at, max(ts) AS updated_at FROM u GROUP BY job""")
def job_latest(spark, folder):
    return A.job_latest(job_updates(table(spark, folder, "events")))


# --- sheets -------------------------------------------------------------------

@query("to_sheet", """
SELECT CAST(p_partkey AS VARCHAR) AS page, CASE WHEN p_size > 25 THEN 'True' ELSE '' END AS big, p_name AS name,
  CASE WHEN p_partkey = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS n, CASE WHEN p_size > 20 THEN p_brand ELSE '' END AS brand,
  CAST(p_retailprice AS VARCHAR) AS price, p_type AS type FROM part""")
def to_sheet(spark, folder):
    extra = F.expr("""map_filter(map('type', p_type, 'brand', CASE WHEN p_size > 20 THEN p_brand END), (k, v) -> v IS NOT NULL)""")
    rows = FX.parts(spark, folder).select(
        "p_partkey", F.col("p_partkey").cast("string").alias("page"), (F.col("p_size") > 25).alias("big"),
        F.col("p_name").alias("name"), F.col("p_partkey").alias("n"), F.col("p_retailprice").alias("price"), extra.alias("extra"),
    )
    return SH.to_sheet(rows, "extra", ["p_partkey"], drop=["p_partkey"])


@query("sheet_columns", """
SELECT key, min(p_partkey) AS first_row FROM (
  SELECT p_partkey, unnest(CASE WHEN p_size > 20 THEN ['type', 'brand_' || p_brand] ELSE ['type'] END) AS key FROM part) GROUP BY key""")
def sheet_columns(spark, folder):
    extra = F.expr("map_filter(map('type', p_type, 'brand_' || p_brand, CASE WHEN p_size > 20 THEN p_brand END), (k, v) -> v IS NOT NULL)")
    rows = SH.sheet_columns(FX.parts(spark, folder).select("p_partkey", extra.alias("extra")), "extra", ["p_partkey"])
    return rows.select("key", F.col("first_seen.p_partkey").alias("first_row"))


@query("sheet_cells", f"""
WITH {Q.LINKS},
body AS (SELECT {Q.host("page_url")} AS site, row_number() OVER (PARTITION BY {Q.host("page_url")} ORDER BY page_id, pos) + 1 AS row, href, text FROM links)
SELECT site, 'Links' AS sheet, row, unnest([1, 2]) AS col, unnest(['A', 'B']) || row AS ref, unnest([href, text]) AS text FROM body
UNION ALL SELECT DISTINCT site, 'Links', 1, unnest([1, 2]), unnest(['A1', 'B1']), unnest(['href', 'text']) FROM body""")
def sheet_cells(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None).withColumn("site", site_of("page_url"))
    return SH.sheet_cells(links, "Links", ["href", "text"], ["site"], F.expr("page_id div 1000"), [F.col("page_id"), F.col("pos")])


@query("column_letter", """
SELECT p_partkey, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INTEGER))
  WHEN n <= 702 THEN chr(CAST(64 + (n - 1) // 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER))
  ELSE chr(CAST(64 + (n - 27) // 676 AS INTEGER)) || chr(CAST(65 + ((n - 27) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) END AS letter
FROM (SELECT p_partkey, least(p_partkey + 1, 16384) AS n FROM part)""")
def column_letter(spark, folder):
    return FX.parts(spark, folder).select("p_partkey", SH.column_letter(F.least(F.col("p_partkey") + 1, F.lit(16384))).alias("letter"))


@query("export_name", f"""
SELECT page_id, 'website-data-' || CASE WHEN {Q.host("url")} LIKE 'm.%' THEN 'a-b' ELSE {Q.host("url")} END || '-20240111-160000' AS name FROM pages""")
def export_name(spark, folder):
    url = F.when(F.col("url").rlike("^[a-z]+://m[.]"), F.lit("https://:a(:b:/x")).otherwise(F.col("url"))
    return pages_of(spark, folder).select("page_id", SH.export_name(url, F.expr(NOW)).alias("name"))


@query("preview", f"""
WITH {Q.LINKS}
SELECT site, href, text FROM (SELECT {Q.host("page_url")} AS site, page_id, pos, href, text FROM links)
QUALIFY row_number() OVER (PARTITION BY site ORDER BY page_id, pos) <= 100""")
def preview(spark, folder):
    links = P.page_links(pages_of(spark, folder), limit=None).withColumn("site", site_of("page_url"))
    return SH.preview(links, "links", [F.col("page_id"), F.col("pos")], "site")


def part_images(spark, folder):
    return FX.parts(spark, folder).selectExpr(
        "'shop' || p_size AS site", "p_partkey AS idx", "p_name AS title",
        "transform(sequence(0, p_size div 20), i -> 'https://x.example/' || (p_partkey div 100) || '-' || i || '.jpg') AS images",
    )


@query("add_image_columns", """
SELECT p_partkey AS idx, 'https://x.example/' || (p_partkey // 100) || '-0.jpg' AS image_1,
  CASE WHEN p_size >= 20 THEN 'https://x.example/' || (p_partkey // 100) || '-1.jpg' ELSE '' END AS image_2,
  CASE WHEN p_size >= 40 THEN 'https://x.example/' || (p_partkey // 100) || '-2.jpg' ELSE '' END AS image_3 FROM part""")
def add_image_columns(spark, folder):
    return SH.add_image_columns(part_images(spark, folder)).drop("site", "title", "images")


IMAGE_ROWS = """
rows AS (
  SELECT 'shop' || p_size AS site, p_partkey AS idx, p_name AS title, CAST(i AS INTEGER) AS pos, 'https://x.example/' || (p_partkey // 100) || '-' || i || '.jpg' AS src
  FROM (SELECT *, unnest(range(p_size // 20 + 1)) AS i FROM part))"""


@query("distinct_image_table", f"""
WITH {IMAGE_ROWS} SELECT site, idx, pos, src, title AS alt, title FROM rows QUALIFY row_number() OVER (PARTITION BY site, src ORDER BY idx, pos) = 1""")
def distinct_image_table(spark, folder):
    return B.distinct_image_table(part_images(spark, folder), ["idx"])


@query("listing_images", f"""
WITH {IMAGE_ROWS} SELECT site, idx, pos, src, title AS alt, title FROM rows QUALIFY row_number() OVER (PARTITION BY site ORDER BY idx, pos) <= 30""")
def listing_images(spark, folder):
    return B.listing_images(part_images(spark, folder), ["idx"], 30)


def shop_listings(spark, folder):
    """Listing rows of the JSON-LD pages with their details."""
    found = FX.jsonld_pages(spark, folder).selectExpr(
        "page_id", "url AS page_url", "url", "1 AS idx", "'' AS title")
    rich = details.enrich_details(found, details.page_detail(FX.jsonld_pages(spark, folder)))
    return rich.withColumn("site", site_of("page_url")).withColumn("images", F.split("detail_images", " [|] "))


COUNT_SQL = f"""
{DETAIL_SQL},
counts AS (
  SELECT {Q.host("detail_url")} AS site, count(*) AS listings, count(*) AS detail_pages, count(*) FILTER (model_number <> '') AS model_numbers,
    0 AS api_pages, 0 AS categories, 2 * count(*) AS images, 0 AS links, 0 AS metadata, 3 * count(*) AS structured_data FROM details GROUP BY 1)"""


@query("site_counts", f"WITH {COUNT_SQL} SELECT * FROM counts")
def site_counts(spark, folder):
    return B.site_counts(FX.jsonld_pages(spark, folder), shop_listings(spark, folder))


@query("page_counters", f"""
WITH {Q.LINKS}, per AS (SELECT page_id, count(*) AS n FROM links GROUP BY 1)
SELECT {Q.host("url")} AS site, count(*) AS pages, 0 AS images, CAST(coalesce(sum(n), 0) AS BIGINT) AS links, 0 AS metadata, 0 AS structured_data
FROM pages LEFT JOIN per USING (page_id) GROUP BY 1""")
def page_counters(spark, folder):
    return B.page_counters(pages_of(spark, folder))


@query("site_summary", f"""
WITH {COUNT_SQL}
SELECT site, unnest(range(13)) AS idx,
  unnest(['Website', 'Page title', 'Content type', 'Scraped at', 'Listings found', 'Product detail pages visited', 'Model numbers found',
    'API pages fetched', 'Categories scraped', 'Detail page limit', 'Salla product safety limit', 'Salla category safety limit', 'Salla total row safety limit']) AS field,
  unnest([site, '', 'text/html', '2024-01-11 16:00:00', CAST(listings AS VARCHAR), CAST(detail_pages AS VARCHAR), CAST(model_numbers AS VARCHAR), '0', '0', '250', '500', '120', '5000']) AS value
FROM counts""")
def site_summary(spark, folder):
    return B.site_summary(site_counts(spark, folder), F.lit(""), F.lit("text/html"), F.expr(NOW))


@query("free_plan_counts", f"""
WITH {COUNT_SQL},
kept AS (SELECT *, {Q.host("detail_url")} AS site FROM details QUALIFY row_number() OVER (PARTITION BY {Q.host("detail_url")} ORDER BY page_id) <= 20)
SELECT c.site, k.n AS listings, least(c.detail_pages, k.n) AS detail_pages, k.models AS model_numbers, k.n + 1 AS images,
  CASE WHEN c.listings > 20 THEN 'Free plan includes the first 20 listings. Upgrade to export the complete result.' ELSE '' END AS warning
FROM counts c JOIN (SELECT site, count(*) AS n, count(*) FILTER (model_number <> '') AS models FROM kept GROUP BY 1) k USING (site)""")
def free_plan_counts(spark, folder):
    rows = shop_listings(spark, folder)
    kept = A.free_plan_view(rows, [F.col("page_id")], 20)
    return A.free_plan_counts(kept, B.site_counts(FX.jsonld_pages(spark, folder), rows), 20)


@query("bundle_tables", f"""
WITH {DETAIL_SQL}
SELECT {Q.host("detail_url")} AS site, unnest(['Images', 'Structured Data']) AS sheet, unnest([2, 3]) * count(*) AS n FROM details GROUP BY 1""")
def bundle_tables(spark, folder):
    bundle = B.Bundle(FX.jsonld_pages(spark, folder))
    tables = {"Images": bundle.images, "Links": bundle.links, "Metadata": bundle.metadata,
              "Structured Data": bundle.structured_data}
    counted = [
        t.groupBy("site").agg(F.count(F.lit(1)).alias("n")).select("site", F.lit(name).alias("sheet"), "n")
        for name, t in tables.items()
    ]
    union = counted[0]
    for t in counted[1:]:
        union = union.unionByName(t)
    return union


@query("write_bundle", f"""
WITH {Q.LINKS}
SELECT {Q.host("page_url")} AS site, count(*) AS links, count(DISTINCT href) AS urls, CAST(sum(length(text)) AS BIGINT) AS chars
FROM links GROUP BY 1""")
def write_bundle(spark, folder):
    written = SH.write_bundle({"Links": B.Bundle(pages_of(spark, folder)).links}, ST.scratch(spark))
    back = spark.read.parquet(written[0])
    per_url = back.groupBy("site", "href").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return per_url.groupBy("site").agg(
        F.sum("n").alias("links"), F.count(F.lit(1)).alias("urls"), F.sum("chars").alias("chars"))


# --- streams ------------------------------------------------------------------

@query("stream_pages", f"WITH {Q.LINKS} SELECT page_id, pos, href, text FROM links")
def stream_pages(spark, folder):
    return ST.drain(ST.stream_links(ST.stream_table(spark, folder, "pages"))).select("page_id", "pos", "href", "text")


@query("stream_titles", SQL["page_title"])
def stream_titles(spark, folder):
    return ST.drain(ST.stream_titles(ST.stream_table(spark, folder, "pages"))).drop("batch_id")


@query("stream_merge", f"""
WITH {Q.LINKS}
SELECT href AS url, min(struct_pack(a := page_id, b := pos)).a AS page_id, min(struct_pack(a := page_id, b := pos)).b AS pos,
  coalesce(arg_min(title, struct_pack(a := page_id, b := pos)) FILTER (title <> ''), '') AS title
FROM (SELECT *, CASE WHEN length(text) > 4 THEN text ELSE '' END AS title FROM links) GROUP BY 1""")
def stream_merge(spark, folder):
    links = ST.stream_links(ST.stream_table(spark, folder, "pages"))
    title = F.when(F.length("text") > 4, F.col("text")).otherwise(F.lit(""))
    rows = links.select(F.col("href").alias("url"), "page_id", "pos", title.alias("title"))
    base = ST.scratch(spark)
    sink = ST.MergeSink(f"{base}/merged", "url", ["page_id", "pos"])
    run = rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return sink.read(spark)


@query("stream_dedup_urls", f"WITH {Q.LINKS} SELECT DISTINCT href FROM links")
def stream_dedup_urls(spark, folder):
    links = ST.stream_links(ST.stream_table(spark, folder, "pages"))
    # a page was seen some seconds after the one before it
    timed = links.withColumn("seen_at", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") % 500))
    return ST.drain(ST.stream_dedup_urls(timed, "seen_at")).select("href")


@query("stream_meta", SQL["page_meta"])
def stream_meta(spark, folder):
    pages = FX.shop_pages(spark, folder)
    path = f"{ST.scratch(spark)}/pages"
    pages.write.parquet(path)
    return ST.drain(ST.stream_meta(spark.readStream.schema(pages.schema).parquet(path))).drop("batch_id")


def arriving(spark, rows, last):
    """Rows as a stream of ten files in which events come up to two days late; `last` moves the watermark to the end."""
    end = rows.limit(1).select(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) if f.name in last else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    path = TM.late_arrivals(rows, 10, 48, f"{ST.scratch(spark)}/arrivals", end)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("stream_job_latest", """
WITH u AS (
  SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS job, ts, event_id,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' WHEN 'view' THEN 'running' END AS status,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS counts FROM events)
SELECT job, arg_max(status, struct_pack(a := ts, b := event_id)) FILTER (status IS NOT NULL) AS status,
  arg_max(counts, struct_pack(a := ts, b := event_id)) AS counts, min(ts) AS created_at, max(ts) AS updated_at FROM u GROUP BY job""")
def stream_job_latest(spark, folder):
    daily = F.concat_ws("/", F.col("job").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    updates = job_updates(table(spark, folder, "events")).withColumn("job", daily)
    stream = arriving(spark, updates, {"job": None, "event_id": -1, "ts": "2100-01-01 00:00:00"})
    latest = TM.stream_job_latest(stream, ["status", "counts"], delay="3 days", keep_hours=72, idle_hours=96)
    return ST.latest_batch(ST.drain(latest, "update"), "job")


@query("stream_free_quota", f"""
WITH {USAGE_SQL.replace('"user" IN (3, 7, 11)', 'false')}
SELECT event_id, "user", effective_plan, effective_plan <> 'free' OR n <= 3 AS allowed,
  CAST(least(n, 3) AS INTEGER) AS used, CAST(greatest(0, 3 - n) AS INTEGER) AS remaining FROM requests""")
def stream_free_quota(spark, folder):
    rows = usage(spark, folder).filter("event_type IN ('view', 'purchase')").select("user", "event_id", "ts", "plan")
    stream = arriving(spark, rows, {"user": -1, "event_id": -1, "ts": "2100-01-01 00:00:00", "plan": "pro"})
    return ST.drain(TM.stream_free_quota(stream, "3 days", days=DAYS)).drop("batch_id")

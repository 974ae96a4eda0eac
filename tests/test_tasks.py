"""Small tables that become large pages are worked on by many tasks, and the elements of a page are read once."""

from pyspark.sql import functions as F

from pagetables.functions import payload as J
from pagetables.operators import feeds, listings, nodes
from pagetables.plans import fixtures as FX
from pagetables.sources import payloads as PL
from pagetables.streaming import timed

PAGE = "<div><article class=card>a $5.00<img src=a.jpg><b>x</b></article><article><article>b<img></article></article></div>"


def test_parts_are_dealt_over_tasks(spark, tmp_path):
    parts = spark.range(6_000).selectExpr(
        "id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'T' AS p_type", "CAST(id % 50 AS INT) AS p_size", "1.5D AS p_retailprice")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    pages = FX.card_pages(spark, str(tmp_path))
    per_task = pages.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) == 3 and sum(r["count"] for r in per_task) == 6_000
    assert max(r["count"] for r in per_task) <= 2 * FX.ROWS_PER_TASK


def test_chosen_columns_of_the_element_table(spark):
    pages = spark.createDataFrame([(1, "http://h/", PAGE), (2, "http://h/2", None)], "page_id bigint, url string, html string")
    whole = nodes.page_nodes(pages)
    for columns in (["page_id", "pos", "end_pos", "tag"], ["pos", "price", "text_len"], ["page_id", "tag", "plain_title"],
                    ["page_id", "first_img", "first_a"], ["pos", "attrs", "own_text", "text"]):
        got = nodes.page_nodes(pages, columns=columns)
        assert got.columns == columns
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(*columns).collect()))


def _reads(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_containment_reads_the_elements_once(spark):
    rows = [(1, "http://h/", PAGE), (1, "http://h/", PAGE), (None, "http://h/", PAGE), (2, "http://h/", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    above, below = F.col("tag").isin("div", "article"), F.col("tag").isin("article", "img")
    tree = nodes.page_nodes(pages, columns=["page_id", "pos", "end_pos", "tag"])
    elements = [r for r in tree.collect() if r.page_id is not None]
    pairs = sorted(
        (a.page_id, a.pos, a.tag, d.pos, d.tag) for a in elements if a.tag in ("div", "article") for d in elements
        if d.tag in ("article", "img") and a.page_id == d.page_id and a.pos <= d.pos <= a.end_pos)
    for width in (2, 64):
        got = listings.node_contains(tree, above, below, width)
        assert _reads(got) == 1 and sorted(map(tuple, got.collect())) == pairs
    counted = listings.contained_counts(tree, above, below)
    expected: dict = {}
    for page, pos, tag, _, inner in pairs:
        expected[page, pos, tag, inner] = expected.get((page, pos, tag, inner), 0) + 1
    assert _reads(counted) == 1
    assert sorted(tuple(r) for r in counted.collect()) == sorted((*k, n) for k, n in expected.items())


def test_arrivals_are_shaped_by_many_tasks(spark, tmp_path):
    rows = spark.range(0, 800, 1, 8).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.spark_partition_id().alias("task"))
    back = spark.read.parquet(timed.late_arrivals(rows, 2, 1, f"{tmp_path}/arrivals"))
    assert back.count() == 800 and back.select("task").distinct().count() == 8 and len(back.inputFiles()) == 2


def test_embedded_json_is_parsed_once(spark, tmp_path):
    parts = spark.range(60).selectExpr(
        "id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'T' AS p_type", "CAST(id % 50 AS INT) AS p_size", "1.5D AS p_retailprice")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("from_json")
    categories = feeds.embedded_categories(FX.search_pages(spark, str(tmp_path)))
    assert reads(categories) <= 15 and categories.count() == 120
    payload = F.expr("""'{"a":{"b":{"name":" x ' || p_partkey || '"}},"c":3}'""")
    nested = parts.select(*[J.nested_text(payload, *k).alias("-".join(k)) for k in (("a", "b", "name"), ("c", "name"), ("c",), ("d", "e"))])
    assert reads(nested) <= 20 and nested.filter("`a-b-name` = ' x 7'").collect() == [(" x 7", "", "3", "")]


def test_derived_payloads_are_not_broadcast(spark, tmp_path):
    parts = spark.range(60).selectExpr(
        "id AS p_partkey", "'n' AS p_name", "'Brand#1' AS p_brand", "'T' AS p_type", "CAST(id % 40 AS INT) AS p_size", "1.5D AS p_retailprice")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    folder = str(tmp_path)
    paged = PL.paginate_numbered(FX.feed_pages(spark, folder), ["site"], page_size=10, limit=25)
    enriched = feeds.enrich_products(
        FX.store_products(spark, folder), FX.store_details(spark, folder), FX.store_options(spark, folder), "p_partkey", ["arrived"])
    for rows, n in ((paged, 45), (enriched, 60)):
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == n

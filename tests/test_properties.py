"""Brute force on small inputs, skewed groups, and streams against their batch twins."""

import random

from pyspark.sql import functions as F

from pagetables.functions.urls import resolve_url
from pagetables.operators import accounts, listings, merge, nodes, ranking, timeline
from pagetables.sinks import sheets
from pagetables.sources.payloads import cursor_pages, running_pages
from pagetables.streaming import streams
from samples import PAGES


def test_resolve_url_against_urljoin(spark):
    from urllib.parse import urljoin

    bases = ["https://h/a/b/c.html?x=1#y", "http://h", "https://h:8/d/", "https://h/a//b"]
    refs = ["x", "./x", "../x", "../../x", "../../../x", "/x", "/x/../y", "//o/p", "?q", "#f", "x/", "x/..", "a//b",
            "mailto:a@b", "https://o/./p", "x?y=../z", "."]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    got = rows.select("b", "r", resolve_url("b", "r").alias("u")).collect()
    wrong = [(r["b"], r["r"], r["u"], urljoin(r["b"], r["r"])) for r in got if r["u"] != urljoin(r["b"], r["r"])]
    assert not wrong, wrong


def test_merge_against_brute_force(spark):
    rng = random.Random(1)
    # one URL holds a third of the rows
    rows = [
        (i, rng.choice(["hot", "hot", *"abcd", ""]), rng.choice(["", "t1", "t2", None]), rng.choice([0, 1, 2]))
        for i in range(300)
    ]
    expected, order, blanks = {}, [], 0
    for pos, url, title, n in rows:
        if not url:
            blanks += 1
        elif url not in expected:
            expected[url] = [pos, title, n]
            order.append(url)
        else:
            current = expected[url]
            current[1] = current[1] or title or current[1]
            current[2] = current[2] or n
    frame = spark.createDataFrame(rows, "pos int, url string, title string, n int").repartition(5)
    merged = merge.merge_by_key(frame, "url", ["pos"])
    got = {r["url"]: [r["pos"], r["title"] or None, r["n"]] for r in merged.filter("url <> ''").collect()}
    assert got == {k: [v[0], v[1] or None, v[2]] for k, v in expected.items()}
    assert merged.filter("url = ''").count() == blanks
    again = merge.merge_by_key(merged.filter("url <> ''"), "url", ["pos"])
    assert sorted(map(str, again.collect())) == sorted(map(str, merged.filter("url <> ''").collect()))


def test_top_k_on_a_hot_group_and_a_large_k(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("site"),
        (5000 - F.col("id")).alias("v"),
    )
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        kept = ranking.top_k(rows, ["site"], [F.col("v")], 700, "rank")
        counts = {r["site"]: r["count"] for r in kept.groupBy("site").count().collect()}
        best = kept.filter("site = 'hot'").agg(F.max("v")).first()[0]
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", before)
    assert counts["hot"] == 700 and max(v for k, v in counts.items() if k != "hot") <= 100
    assert best == sorted(5000 - i for i in range(0, 5000, 3))[699]


def test_chunked_position_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") % 4 == 0).cast("string").alias("site"), "id")
    got = ranking.chunked_position(rows, ["site"], F.expr("id div 100"), [F.col("id")])
    for site in ("true", "false"):
        ordered = [r["idx"] for r in got.filter(F.col("site") == site).orderBy("id").collect()]
        assert ordered == list(range(1, len(ordered) + 1))


def test_timeline_on_a_hot_key_against_a_plain_window(spark):
    from pyspark.sql import Window

    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 20).alias("user"),
        F.timestamp_seconds(F.col("id") * 700).alias("ts"),
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"),
    )
    order = Window.partitionBy("user").orderBy("ts", "event_id")
    plain = rows.withColumn("want", F.last("v", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    plain = plain.withColumn("ahead", F.lead("ts").over(order))
    got = timeline.with_next(timeline.with_last(plain, "user", "ts", ["ts", "event_id"], F.col("v"), "got"),
                             "user", "ts", ["ts", "event_id"], "got_ahead")
    assert got.filter(~F.col("want").eqNullSafe(F.col("got")) | ~F.col("ahead").eqNullSafe(F.col("got_ahead"))).count() == 0
    assert got.count() == 2000


def test_paging_rules(spark):
    numbered = spark.createDataFrame(
        [("full", 1, 2), ("full", 2, 2), ("full", 3, 0), ("full", 4, 2), ("gap", 1, 2), ("gap", 3, 2), ("cap", 1, 2),
         ("cap", 2, 2), ("cap", 3, 2), ("cap", 4, 2)], "site string, page_no int, size int")
    kept = running_pages(numbered, ["site"], 2, 5).groupBy("site").count().collect()
    assert {r["site"]: r["count"] for r in kept} == {"full": 3, "gap": 1, "cap": 3}
    cursor = spark.createDataFrame(
        [("a", 1, [1, 2], "c"), ("a", 2, [], "c"), ("a", 3, [3], None), ("b", 1, [1], None), ("b", 2, [2], None)],
        "store string, page_seq int, items array<int>, next_cursor string")
    kept = cursor_pages(cursor, ["store"], "items", 10).groupBy("store").count().collect()
    assert {r["store"]: r["count"] for r in kept} == {"a": 2, "b": 1}


def test_void_tags_nest_and_end_tags_pop(spark):
    html = "<div><br>a<p>b</div>c</span><img src=x/>d<title>t</title>"
    page = spark.createDataFrame([(1, "http://h/", html)], "page_id bigint, url string, html string")
    rows = nodes.page_nodes(page).orderBy("pos").collect()
    assert [(r["tag"], r["parent_pos"], r["end_pos"]) for r in rows] == [
        ("document", -1, 5), ("div", 0, 3), ("br", 1, 3), ("p", 2, 3), ("img", 0, 5), ("title", 4, 5)]
    assert rows[0]["text"] == "c a b d t" and rows[1]["text"] == "a b"


def test_page_nodes_text_and_price_against_recursion(spark):
    rng = random.Random(3)
    parts = ["<div>", "</div>", "<p class='item'>", "</p>", "x 12 y", "$ 1,200.50", "word &amp; more", "<br/>", "<a href=/q>", "</a>"]
    html = [" ".join(rng.choice(parts) for _ in range(60)) for _ in range(20)]
    page = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(html)], "page_id bigint, url string, html string")
    rows = nodes.page_nodes(page).collect()
    by_page = {}
    for r in rows:
        by_page.setdefault(r["page_id"], {})[r["pos"]] = r
    import re

    from pagetables.functions.text import PRICE_PATTERN

    for tree in by_page.values():
        def text(pos):
            own = list(tree[pos]["own_text"])
            return " ".join(own + [t for c in sorted(tree) if tree[c]["parent_pos"] == pos for t in [text(c)] if t])

        for pos, r in tree.items():
            whole = text(pos)
            found = re.search(PRICE_PATTERN, whole, re.I)
            assert r["text"] == whole and r["text_len"] == len(whole)
            assert r["price"] == (" ".join(found.group(0).split()) if found else "")


def test_long_link_text_is_whole_and_large_pages_are_left_out(spark):
    long = "word " * 900
    html = f"<div><a href='/c1'>{long}<b>end</b></a><p>{long}</p></div>"
    page = spark.createDataFrame([(1, "http://h/", html), (2, "http://h/2", None)], "page_id bigint, url string, html string")
    rows = nodes.page_nodes(page).collect()
    lengths = {r["tag"]: (len(r["text"]), r["text_len"]) for r in rows}
    assert lengths["a"] == (4503, 4503) and lengths["p"] == (2000, 4499) and lengths["document"][0] == lengths["document"][1]
    # a page without html is a document without elements, a page over a given limit is left out
    assert [r["page_id"] for r in nodes.page_nodes(page, max_bytes=100).collect()] == [2]


def test_discover_categories_label_gives_way(spark):
    html = ('<a href="/c5">عرض الكل</a><a href="/sofa/c5"><b>Sofas</b></a><a href="/beds/c6">عرض الكل</a>'
            '<a href="/x/c7">Chairs</a><a href="/about">About</a>')
    page = spark.createDataFrame([(1, "http://h/", html)], "page_id bigint, url string, html string")
    rows = listings.discover_categories(nodes.page_nodes(page)).orderBy("idx").collect()
    assert [(r["category_id"], r["name"]) for r in rows] == [("5", "c5"), ("6", "beds"), ("7", "Chairs")]


def test_free_quota_renewal_replaces_expiry(spark):
    rows = [(1, 1, 0, None), (2, 1, 1, "pro"), (3, 1, 2, "category"), (4, 1, 32, None), (5, 1, 33, None), (6, 1, 34, None),
            (7, 1, 35, None), (8, 1, 36, None)]
    events = spark.createDataFrame(rows, "event_id bigint, user bigint, day int, plan string").select(
        "event_id", "user", F.timestamp_seconds(F.col("day") * 86400).alias("ts"), "plan")
    planned = accounts.effective_plan(events).filter("plan IS NULL")
    got = accounts.free_quota(planned).orderBy("event_id").collect()
    assert [(r["event_id"], r["effective_plan"], r["allowed"], r["used"]) for r in got] == [
        (1, "free", True, 1), (4, "category", True, 1), (5, "free", True, 2), (6, "free", True, 3), (7, "free", False, 3),
        (8, "free", False, 3)]


def test_write_bundle_and_read_back(spark, tmp_path):
    from pagetables.operators.bundle import Bundle

    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    tables = Bundle(pages.filter("page_id = 1"), pages).tables()
    assert list(tables) == sheets.SHEETS
    paths = sheets.write_bundle(tables, str(tmp_path))
    counts = [spark.read.parquet(p).count() if not tables[n].isEmpty() else 0 for n, p in zip(tables, paths)]
    assert counts == [13, 2, 0, 2, 2, 1, 0]
    summary = {r["field"]: r["value"] for r in spark.read.parquet(paths[0]).collect()}
    assert summary["Listings found"] == "2" and summary["Model numbers found"] == "2"
    assert summary["Page title"] == "Living room"
    assert sheets.empty_sheet(tables["Categories"], "Categories").first()["text"] == sheets.EMPTY_SHEET


def test_streaming_merge_over_several_batches_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice("abc"), rng.choice(["", "x", "y"])) for i in range(90)]
    frame = spark.createDataFrame(rows, "pos int, url string, title string")
    source = str(tmp_path / "in")
    for part in range(3):
        frame.filter(F.col("pos").between(part * 30, part * 30 + 29)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    sink = streams.MergeSink(str(tmp_path / "out"), "url", ["pos"])
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    sink(frame.filter("pos >= 60"), 2)  # a repeated batch changes nothing
    expected = sorted(map(tuple, merge.merge_by_key(frame, "url", ["pos"]).collect()))
    assert sorted(map(tuple, sink.read(spark).collect())) == expected
    sink.compact(spark)
    sink(frame.filter("pos >= 60"), 2)  # repeated after the compaction
    assert sink.generation == 3 and sorted(map(tuple, sink.read(spark).collect())) == expected
    later = streams.MergeSink(str(tmp_path / "out"), "url", ["pos"]).resume(spark)
    later(frame.filter("pos < 5").withColumn("url", F.concat("url", F.lit("2"))), 3)
    assert later.read(spark).count() == len(expected) + frame.filter("pos < 5").select("url").distinct().count()

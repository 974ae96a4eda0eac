"""Less work per page, the same results: plain tags, chosen elements and fields, batches of ropes, entity tables."""

import random
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F

from pagetables.functions import text as X
from pagetables.operators import listings, nodes
from pagetables.sinks import snapshots
from samples import PAGES

PAGE = "page_id bigint, url string, html string"


class _Standard(nodes._Outline):
    updatepos, parse_starttag, parse_endtag = HTMLParser.updatepos, HTMLParser.parse_starttag, HTMLParser.parse_endtag


def _seen(page, html):
    try:
        page.outline(html)
    except (AssertionError, ValueError) as error:
        return type(error)
    return page.tags, page.attrs, page.texts, page.parents, page.ends, page.scripts


def test_plain_tags_read_as_the_standard_parser_reads_them():
    rng = random.Random(7)
    parts = ["<", ">", "/", "=", '"', " ", "\x0b", "\xa0", "a", "<a", "<a href='y' ", '<IMG SRC=q alt="z&amp;1"', "</a>", "</ script >", "<!--", "-->",
             "<br/>", "<br />", "<p class=a/>", '<p a="b"c="d">', "<p a = 'b'>", "<p \x0b a>", '<script type="application/ld+json">', "</script>", "<title>"]
    short = 0
    for _ in range(20_000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        short += bool(nodes._START_TAG.search(html))
        assert _seen(nodes._Outline(), html) == _seen(_Standard(), html), html
    assert short > 5_000


def test_ropes_come_in_batches_of_many_pages():
    html = [f"<div>é {i}<p>text</p></div>" for i in range(300)] + [None]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(301), pa.int64()), pa.array(["u"] * 301), pa.array(html, pa.string())], names=["page_id", "url", "html"]
    )
    out = list(nodes._ropes_of(iter([batch])))
    rows = [r for b in out for r in b.to_pylist()]
    assert len(out) == 1 and [r["page_id"] for r in rows] == list(range(301))
    for row, source in zip(rows, html):
        text, columns = nodes._rope(source or "")
        assert row["text"] == text and [tuple(e.values()) for e in row["elements"]] == list(zip(*columns))


def test_listings_of_chosen_elements_are_those_of_all(spark):
    pages = spark.createDataFrame([*PAGES, (4, "http://h/x", None)], PAGE)
    some, every = listings.listing_nodes(pages), nodes.page_nodes(pages)
    assert {r["tag"] for r in some.collect()} <= set(nodes.CANDIDATE_TAGS) and "own_text" not in some.columns
    for made in (listings.page_listings, listings.card_listings, listings.product_link_listings, listings.link_image_listings):
        rows = sorted(map(str, made(every).collect()))
        assert sorted(map(str, made(some).collect())) == rows
    links = listings.link_nodes(pages)
    for made in (listings.product_link_listings, listings.link_image_listings):
        assert sorted(map(str, made(links).collect())) == sorted(map(str, made(every).collect()))


def test_candidates_of_cards_alone_leave_links_out(spark):
    pages = spark.createDataFrame(PAGES, PAGE)
    rows = listings.listing_candidates(listings.listing_nodes(pages), (listings.CARD,))
    assert {r["strategy"] for r in rows.select(F.col("strategy")).collect()} == {listings.CARD}


def test_page_tree_with_few_fields(spark):
    pages = spark.createDataFrame([*PAGES, (4, "http://h/x", None)], PAGE)
    whole = {r["page_id"]: r["objects"] for r in nodes.with_page_tree(pages).collect()}
    assert len(whole[2]) > 5
    for field in nodes.OBJECT_FIELDS:
        rows = nodes.with_page_tree(pages, columns=["page_id", "objects"], fields=[field]).collect()
        assert {r["page_id"]: [o[field] for o in r["objects"]] for r in rows} == {k: [o[field] for o in v] for k, v in whole.items()}


def test_entities_are_looked_up_in_a_short_table(spark):
    texts = [f"a&{name} b&{name.rstrip(';')}" for name in html5] + [f"&#{n}; &#x{n:X};&#0{n}" for n in (0, 38, 150, 159, 160, 8364, 0x1F600, 0xD800, 0x110000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.decode_entities("t").alias("d"))
    # with ';' only or, for few names, without: unescape also cuts names short, which this does only at the start of a piece
    assert all(r["d"] == unescape(r["t"]) for r in rows.collect())
    assert "map(" not in rows._jdf.queryExecution().analyzed().toString()


def test_bundle_snapshot_reads_pages_once_for_both_copies(spark, tmp_path, monkeypatch):
    from pagetables.plans.scale_queries import bundle_snapshot

    row = [(i, f"name {i}", "Brand#1", "TYPE", i % 3 + 1, 9.5) for i in range(1, 8)]
    parts = spark.createDataFrame(row, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    reads, write = [], snapshots.write_bundle

    def watched(tables, *args, **more):
        reads.extend(df._jdf.queryExecution().analyzed().toString().count("Relation") for df in tables.values())
        return write(tables, *args, **more)

    monkeypatch.setattr(snapshots, "write_bundle", watched)
    counts = {(r["site"], r["sheet"]): r["n"] for r in bundle_snapshot(spark, str(tmp_path)).collect()}
    assert reads == [1, 1, 1]
    assert counts["shop1.example.com", "Images"] == 4 and sum(n for (_, s), n in counts.items() if s == "Structured Data") == 21

"""Whole texts, charsets, containment, large scopes and snapshots against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagetables.operators import listings, nodes
from pagetables.sinks import snapshots
from pagetables.sources import pages as P

PAGE = "page_id bigint, url string, html string"


def test_element_texts_against_recursion(spark):
    rng = random.Random(5)
    parts = ["<div>", "</div>", "<p>", "</p>", "äöü 12", "日本語", "word &amp; more", "<br/>", "<a href=/q>", "</a>", "\U0001f600"]
    html = ["".join(rng.choice(parts) for _ in range(80)) for _ in range(20)]
    # a megabyte, two hundred elements deep
    html += ["<div>" * 200 + "é long text " * 90_000 + "<b>end</b>" + "</div>" * 200, None, ""]
    pages = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(html)], PAGE)
    own = {(r["page_id"], r["pos"]): r for r in nodes.page_nodes(pages).select("page_id", "pos", "end_pos", "own_text").collect()}
    whole = {}
    for (page, pos), r in own.items():
        whole[page, pos] = " ".join(t for p in range(pos, r["end_pos"] + 1) for t in own[page, p]["own_text"])
    ropes = nodes.page_ropes(pages)
    got = {(r["page_id"], r["pos"]): r["text"] for r in nodes.element_texts(ropes).collect()}
    assert got == whole and len(whole[20, 200]) > 1_000_000 and got[21, 0] == got[22, 0] == ""
    some = nodes.element_texts(ropes, lambda e: e["tag"] == "b").collect()
    assert [(r["page_id"], r["text"]) for r in some] == [(20, "end")]


def test_large_pages_are_kept_unless_a_limit_is_given(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<p>" + "x " * 3_000_000 + "</p>")], PAGE)
    assert nodes.page_nodes(pages).count() == 2 and nodes.page_nodes(pages, max_bytes=5_000_000).count() == 0


@pytest.mark.parametrize("width", [1, 3, 64])
def test_containment_against_all_pairs(spark, width):
    rng = random.Random(width)
    rows = []
    for page in range(4):
        ends = {}

        def grow(pos, last):
            ends[pos], at = last, pos + 1
            while at <= last:
                end = rng.randint(at, last)
                grow(at, end)
                at = end + 1

        grow(0, 120)
        rows += [(page, p, e, rng.choice("abc")) for p, e in ends.items()]
    tree = spark.createDataFrame(rows, "page_id bigint, pos int, end_pos int, tag string")
    got = listings.node_contains(tree, F.col("tag") != "a", F.col("tag") != "b", width)
    expected = sorted(
        (x[0], x[1], x[3], y[1], y[3]) for x, y in itertools.product(rows, rows)
        if x[0] == y[0] and x[3] != "a" and y[3] != "b" and x[1] <= y[1] <= x[2]
    )
    assert got.columns == ["page_id", "a_pos", "a_tag", "d_pos", "d_tag"] and sorted(map(tuple, got.collect())) == expected


@pytest.mark.parametrize("marks, links", [(3, 3), (40, 30), (1000, 5)])
def test_greedy_scopes_against_a_scan(spark, marks, links):
    rng = random.Random(marks)
    rows = []
    for n in range(900):  # two thirds in one scope, blank and missing keys
        mark = rng.choice(["", None, *(f"m{i}" for i in range(marks))])
        link = rng.choice(["", None, *(f"l{i}" for i in range(links))])
        rows.append((rng.choice(["hot", "hot", "b"]), n // 7, n % 7, mark, link, f"row {n}"))
    expected, seen = set(), {}
    for scope, a, b, mark, link, text in rows:
        prints, urls = seen.setdefault(scope, (set(), set()))
        if mark and mark not in prints and not (link and link in urls):
            expected.add(text)
            prints.add(mark)
            urls.add(link)
    frame = spark.createDataFrame(rows, "site string, page_id int, pos int, mark string, link string, text string")
    kept = listings.greedy_dedup_scope(frame.repartition(5), ["site"], ["page_id", "pos"])
    assert kept.columns == frame.columns and {r["text"] for r in kept.collect()} == expected
    assert listings.greedy_dedup_scope(frame.limit(0), ["site"], ["page_id", "pos"]).count() == 0


def test_charsets(spark, tmp_path):
    arabic, japanese = "عرض الكل", "全て表示"
    page = "<html><head><meta http-equiv='Content-Type' content='text/html; charset=%s'></head><p>%s</p>"
    rows = [
        (arabic, page % ("x", arabic), "windows-1256", "text/html; charset=Windows-1256", True),
        (arabic, page % ("windows-1256", arabic), "windows-1256", None, True),
        (japanese, page % ("Shift_JIS", japanese), "shift_jis", "text/html", True),
        (japanese, page % ("shift_jis", japanese), "utf-16", "text/html; charset=latin-1", True),  # the mark wins
        (japanese, "<p>" + japanese, "utf-8-sig", None, True),
        (japanese, "<p>" + japanese, "utf-8", "text/html; charset=no-such-set", True),
        (japanese, "<p>" + japanese, "utf-8", "text/html; charset=base64", True),
        ("é", page % ("utf-8", "é"), "iso-8859-1", "charset='ISO-8859-1'", True),
        ("é", "<p>é", "iso-8859-1", None, False),  # not UTF-8: replaced
    ]
    stored = spark.createDataFrame(
        [(i, "http://h/", bytearray(html.encode(kind)), told) for i, (_, html, kind, told, _) in enumerate(rows)] + [(99, "http://h/", None, None)],
        "page_id bigint, url string, html binary, told string",
    )
    stored.write.parquet(f"{tmp_path}/pages")
    got = {r["page_id"]: r["html"] for r in P.read_pages(spark, f"{tmp_path}/pages", content_type="told").collect()}
    assert got.pop(99) is None
    for i, (word, html, _, _, readable) in enumerate(rows):
        assert (got[i] == html) == readable and (word in got[i]) == readable
    assert got[8] == "<p>\ufffd"


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/bundle"
    one = spark.createDataFrame([("s", 1), ("t", 2)], "site string, n int")
    empty, broken = one.filter("n > 5"), one.withColumn("n", F.raise_error(F.lit("lost")).cast("int"))

    def rows(version=None):
        return {name: sorted(map(tuple, t.collect())) for name, t in snapshots.read_bundle(spark, path, version).items()}

    with pytest.raises(ValueError):
        snapshots.read_bundle(spark, path)
    assert snapshots.bundle_versions(spark, path).count() == 0
    assert snapshots.commit_bundle({"Links": one, "Images": empty}, path, "a") == 1
    first = rows()
    assert {n: len(r) for n, r in first.items()} == {"Links": 2, "Images": 0}
    # a run that dies between two tables is not seen
    with pytest.raises(Exception, match="lost"):
        snapshots.commit_bundle({"Links": one.union(one), "Images": broken}, path, "b")
    assert rows() == first and snapshots.bundle_versions(spark, path).count() == 1
    # its retry writes what is missing, once
    assert snapshots.commit_bundle({"Links": broken, "Images": one}, path, "b") == 2
    assert snapshots.commit_bundle({"Links": broken, "Images": broken}, path, "b") == 2
    assert {n: len(r) for n, r in rows().items()} == {"Links": 4, "Images": 2} and rows(1) == first
    assert snapshots.commit_bundle({"Links": empty, "Images": empty}, path, "c", fmt="csv") == 3
    assert snapshots.drop_versions(spark, path, keep=2) == ["a"] and len(rows(2)["Links"]) == 4
    with pytest.raises(ValueError):
        snapshots.commit_bundle({"Links": one}, path, "a/b")

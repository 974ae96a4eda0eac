"""Listing extraction from the element table.

"First img / a / h1 … at or below an element" comes with the element table, so
scores, headings, images and links are narrow. Only the candidates that are
left move, once, to be de-duplicated per page.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetables.functions import urls as U
from pagetables.functions.images import image_src
from pagetables.functions.text import clean_text, first_truthy, let
from pagetables.operators.nodes import CANDIDATE_TAGS, page_nodes
from pagetables.operators.ranking import first_per_key, top_k
from pagetables.session import cut_lineage

# --- fixed values: results depend on these exact texts -----------------------
CARD_HINTS = "product|listing|item|card|result|tile|offer|property|vehicle|grid|catalog|search"
NOISE_WORDS = "header|footer|nav|menu|breadcrumb|pagination|modal|cookie|banner"
HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "a"]
SHOW_ALL_LABEL = "عرض الكل"
# --- end of fixed values -----------------------------------------------------

CARDS_PER_PAGE, PRODUCT_LINKS_PER_PAGE, IMAGE_LINKS_PER_PAGE = 250, 1000, 500
CATEGORIES_PER_STORE = 120
CARD_SCORE = 6

LISTING_COLUMNS = ["page_id", "page_url", "idx", "title", "price", "image", "image_alt", "url", "description", "source"]


def attr(attrs: Column, name: str) -> Column:
    return F.coalesce(attrs[name], F.lit(""))


def with_firsts(nodes: DataFrame, tags: list[str]) -> DataFrame:
    """Adds `first_<tag>` for each tag: pos, attrs and text of the first such element at or below each element.

    The element table brings them along for the elements that can be cards; only a table without them is windowed.
    """
    if all(f"first_{t}" in nodes.columns for t in tags):
        return nodes
    backwards = Window.partitionBy("page_id").orderBy(F.col("pos").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    nearest = []
    for tag in tags:
        fields = [F.col("pos"), F.substring("text", 1, 240).alias("text")]
        if tag in ("img", "a"):
            fields.append(F.col("attrs"))
        found = F.last(F.when(F.col("tag") == tag, F.struct(*fields)), ignorenulls=True).over(backwards)
        nearest.append(found.alias(f"_next_{tag}"))
    ahead = nodes.select("*", *nearest)
    inside = [
        F.when(F.col(f"_next_{t}.pos") <= F.col("end_pos"), F.col(f"_next_{t}")).alias(f"first_{t}") for t in tags
    ]
    return ahead.select(*nodes.columns, *inside)


def node_score() -> Column:
    """Likelihood that an element is a product card."""
    identity = F.concat_ws(
        " ", "tag", attr(F.col("attrs"), "class"), attr(F.col("attrs"), "id"), attr(F.col("attrs"), "itemtype")
    )
    points = (
        F.when(F.col("tag").isin("article", "li"), 2).otherwise(0)
        + F.when(identity.rlike(f"(?i){CARD_HINTS}"), 4).otherwise(0)
        - F.when(identity.rlike(f"(?i){NOISE_WORDS}"), 5).otherwise(0)
        + F.when(F.col("price") != "", 3).otherwise(0)
        + F.when(F.col("first_img").isNotNull(), 2).otherwise(0)
        + F.when(F.col("first_a").isNotNull(), 1).otherwise(0)
        + F.when(F.col("text_len").between(30, 900), 2).otherwise(0)
        - F.when(F.col("text_len") > 1600, 4).otherwise(0)
    )
    return F.when(F.col("tag").isin(*CANDIDATE_TAGS), points).otherwise(F.lit(-10))


def score_nodes(nodes: DataFrame) -> DataFrame:
    return with_firsts(nodes, ["img", "a"]).withColumn("score", node_score())


def heading_text() -> Column:
    """Text of the first heading by tag priority, else the element's text without its price."""
    candidates = [first_truthy(F.col(f"first_{t}.text")) for t in HEADING_TAGS]
    return F.coalesce(*candidates, F.col("plain_title"), F.lit(""))


def first_image_parts(base: Column) -> Column:
    """STRUCT<src, alt> of the first image; both blank when there is none."""
    attrs = F.col("first_img.attrs")
    present = F.col("first_img").isNotNull()
    src = U.resolve_parts(base, image_src(lambda name: attr(attrs, name)))
    alt = clean_text(first_truthy(attr(attrs, "alt"), attr(attrs, "title")))
    return F.struct(
        F.when(present, src).otherwise(F.lit("")).alias("src"), F.when(present, alt).otherwise(F.lit("")).alias("alt")
    )


def first_link(base: Column) -> Column:
    """Target of the first <a>, which is the element itself for an <a>; blank when it has no href."""
    target = U.resolve_parts(base, attr(F.col("first_a.attrs"), "href"))
    return F.when(F.col("first_a").isNotNull(), target).otherwise(F.lit(""))


PRODUCT_LINK, CARD, IMAGE_LINK = 0, 1, 2
# rows per page of each strategy for a caller that wants few; pass it as `limits`
LIMITS = {
    PRODUCT_LINK: PRODUCT_LINKS_PER_PAGE,
    CARD: CARDS_PER_PAGE,
    IMAGE_LINK: IMAGE_LINKS_PER_PAGE,
}
SOURCES = {PRODUCT_LINK: "product_link", CARD: None, IMAGE_LINK: "link_image_fallback"}


LINK_COLUMNS = ["page_id", "url", "pos", "tag", "attrs", "text", "price", "first_img", "first_a"]
CANDIDATE_COLUMNS = [*LINK_COLUMNS, "text_len", "plain_title", *[f"first_{t}" for t in HEADING_TAGS if t != "a"]]


def listing_nodes(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The part of the element table that listings are made of: the elements that can become one, and what is read of them."""
    return page_nodes(pages, max_bytes, CANDIDATE_COLUMNS, CANDIDATE_TAGS)


def link_nodes(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """The links alone, for `product_link_listings` and `link_image_listings`."""
    return page_nodes(pages, max_bytes, LINK_COLUMNS, ["a"])


def listing_candidates(nodes: DataFrame, strategies: tuple[int, ...] = (PRODUCT_LINK, CARD, IMAGE_LINK)) -> DataFrame:
    """Rows that a strategy may turn into a listing, before de-duplication.

    One pass over the elements serves all strategies. `mark` and `link` are
    the two keys of the de-duplication. Image, link and titles are computed
    inside the exploded array, once per element. Links are read only for a strategy that asks for them.
    """
    linked = PRODUCT_LINK in strategies or IMAGE_LINK in strategies
    needed = ["img", *HEADING_TAGS] if CARD in strategies else ["img", "a"]
    ready = with_firsts(nodes, needed)
    wanted = F.lit(linked) & (F.col("tag") == "a")
    if CARD in strategies:
        ready = ready.withColumn("score", node_score())
        wanted = wanted | (F.col("score") >= CARD_SCORE)
    is_card = F.col("score") >= CARD_SCORE if linked else F.lit(True)
    ready = ready.filter(wanted)
    text, is_link = F.col("text"), F.col("tag") == "a"

    def row(strategy: int, when: Column, title: Column, url: Column, image: Column, mark: Column, link: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(strategy).alias("strategy"),
                title.alias("title"),
                url.alias("url"),
                image["src"].alias("image"),
                image["alt"].alias("image_alt"),
                mark.alias("mark"),
                link.alias("link"),
            ),
        )

    def rows(url: Column, image: Column, base: Column) -> Column:
        if not linked:
            return found_rows(url, image, F.lit(False), F.lit(""))
        on_site = U.url_part(url, "scheme").isin("http", "https") & (U.url_part(url, "authority") == base["authority"])
        label = clean_text(F.coalesce(first_truthy(text, image["alt"]), F.lit("")))
        return let(
            is_link & (url != "") & on_site,
            lambda same: let(F.when(same, label), lambda label: found_rows(url, image, same, label)),
        )

    def found_rows(url: Column, image: Column, same: Column, label: Column) -> Column:
        found = []
        if PRODUCT_LINK in strategies:
            title = F.when(label != "", label).otherwise(U.title_from_url(url))
            on_path = U.url_path(url).rlike("(?i)/products?/")
            found.append(row(PRODUCT_LINK, same & on_path, F.substring(title, 1, 240), url, image, url, F.lit("")))
        if CARD in strategies:
            print_ = F.lower(clean_text(F.substring(text, 1, 300)))
            found.append(let(
                F.when(is_card, print_), lambda mark: row(CARD, mark != "", heading_text(), url, image, mark, url),
            ))
        if IMAGE_LINK in strategies:
            slug = U.unquote(F.element_at(F.split(F.btrim(U.url_path(url), F.lit("/")), "/"), -1))
            shown = (image["src"] != "") | ((label != "") & U.looks_like_product_url(url))
            title = F.coalesce(first_truthy(F.substring(label, 1, 260)), slug)
            found.append(row(IMAGE_LINK, same & shown, title, url, image, url, F.lit("")))
        return F.filter(F.array(*found), lambda r: r.isNotNull())

    candidates = let(
        U.url_parts("url"),
        lambda base: let(first_link(base), lambda url: let(first_image_parts(base), lambda img: rows(url, img, base))),
    )
    exploded = ready.select(
        "page_id", F.col("url").alias("page_url"), "pos", "price",
        F.substring(text, 1, 1500).alias("description"), F.explode(candidates).alias("r"),
    )
    return exploded.select("page_id", "page_url", "pos", "price", "description", "r.*")


def greedy_keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keep a row when its mark is new and its link is blank or new; only kept rows count as seen.

    Rows arrive sorted by (page_id, pos) and a page is never split over
    partitions, so the seen sets hold one page at a time. `idx` numbers the kept rows of a page.
    """
    page, prints, urls, count = None, set(), set(), 0
    for batch in batches:
        keep, places = [], []
        for page_id, mark, url in zip(batch["page_id"], batch["mark"], batch["link"]):
            if page_id != page:
                page, prints, urls, count = page_id, set(), set(), 0
            fresh = bool(mark) and mark not in prints and not (url and url in urls)
            if fresh:
                count += 1
                places.append(count)
                prints.add(mark)
                if url:
                    urls.add(url)
            keep.append(fresh)
        yield batch[keep].assign(idx=places)


def greedy_dedup_two_key(rows: DataFrame) -> DataFrame:
    """Ordered two-key de-duplication per page (page_id, pos, mark, link + any columns)."""
    by_page = rows.repartition("page_id").sortWithinPartitions("page_id", "pos")
    return by_page.mapInPandas(greedy_keep, T.StructType([*rows.schema.fields, T.StructField("idx", T.IntegerType())]))


def greedy_dedup_scope(rows: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Ordered two-key de-duplication (mark, link + any columns) in scopes of any size: the rows that a scan in order keeps.

    `order` is a total order in a scope. A row stays when its mark is not blank and no kept row before it has its mark or
    its link, if that is not blank. In a round, rows that are the first with their mark and the first with their link
    stay, and the rows that share a mark or a link with them go; the rest waits. No task holds a scope: rounds are
    aggregates and joins by (scope, mark) and (scope, link). Their number is that of the longest chain of rows of which
    each waits for the one before, some ten for rows in a random order.
    """
    alone = F.concat(F.lit("\0"), F.to_json(F.struct(*order)))  # a blank link is like no other
    linked = rows.filter(F.col("mark") != "").withColumn("_link", F.coalesce(F.nullif("link", F.lit("")), alone))
    # of rows with the same mark and link only the first can stay
    first = cut_lineage(first_per_key(linked, [*scope, "mark", "_link"], [F.col(c) for c in order]))
    waiting, kept = first.select(*scope, "mark", "_link", F.struct(*order).alias("_at")), None
    while True:
        firsts = [waiting.groupBy(*scope, c).agg(F.min("_at").alias(f"_first{c}")) for c in ("mark", "_link")]
        known = waiting.join(firsts[0], [*scope, "mark"]).join(firsts[1], [*scope, "_link"])
        free = (F.col("_at") == F.col("_firstmark")) & (F.col("_at") == F.col("_first_link"))
        known = cut_lineage(known.select(*waiting.columns, free.alias("_free")))
        now, later = known.filter("_free").drop("_free"), known.filter("NOT _free").drop("_free")
        kept = now if kept is None else kept.union(now)
        for c in ("mark", "_link"):
            later = later.join(now.select(*scope, c), [*scope, c], "left_anti")
        waiting = cut_lineage(later.select(*waiting.columns))
        if waiting.isEmpty():
            break
    return first.join(kept.select(*scope, "_at.*"), [*scope, *order], "left_semi").select(*rows.columns)


def _finished(kept: DataFrame, limits: Mapping[int, int] | None) -> DataFrame:
    """Cut each strategy at its limit, if any; rows that carry no `idx` yet are numbered per page."""
    limit, source = F.lit(None).cast("int"), F.lit(None).cast("string")
    for strategy in SOURCES:
        limit = F.when(F.col("strategy") == strategy, F.lit((limits or {}).get(strategy))).otherwise(limit)
        source = F.when(F.col("strategy") == strategy, F.lit(SOURCES[strategy])).otherwise(source)
    if "idx" not in kept.columns:
        kept = kept.withColumn("idx", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
    numbered = kept.filter(limit.isNull() | (F.col("idx") <= limit)) if limits else kept
    return numbered.withColumn("source", source).select(*LISTING_COLUMNS, "strategy")


def card_listings(nodes: DataFrame, limits: Mapping[int, int] | None = None) -> DataFrame:
    return _finished(greedy_dedup_two_key(listing_candidates(nodes, (CARD,))), limits).drop("strategy")


def product_link_listings(nodes: DataFrame, limits: Mapping[int, int] | None = None) -> DataFrame:
    """Links whose path holds /product/ or /products/, first per URL."""
    rows = listing_candidates(nodes, (PRODUCT_LINK,))
    return _finished(first_per_key(rows, ["page_id", "url"], [F.col("pos")]), limits).drop("strategy")


def link_image_listings(nodes: DataFrame, limits: Mapping[int, int] | None = None) -> DataFrame:
    """Links with an image, or with text and a product-like URL; first qualifying per URL."""
    rows = listing_candidates(nodes, (IMAGE_LINK,))
    return _finished(first_per_key(rows, ["page_id", "url"], [F.col("pos")]), limits).drop("strategy")


def page_listings(nodes: DataFrame, limits: Mapping[int, int] | None = None) -> DataFrame:
    """Per page the first strategy that finds anything: product links, cards, linked images.

    The first candidate of a strategy always survives, so the strategy can be
    chosen before the de-duplication. Everything is keyed by page: one shuffle.
    """
    best = F.min("strategy").over(Window.partitionBy("page_id"))
    chosen = listing_candidates(nodes).withColumn("_best", best).filter("strategy = _best").drop("_best")
    return _finished(greedy_dedup_two_key(chosen), limits)


def discover_categories(nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Category links of a store page: one row per id, the first one, in order of first appearance.

    A name equal to the "show all" label, or no name, falls back to the first
    path part of the URL.
    """
    rows = nodes.filter(F.col("tag") == "a").select(
        "page_id", "pos", F.col("text").alias("label"),
        U.resolve_url("url", attr(F.col("attrs"), "href")).alias("url"),
    )
    rows = rows.withColumn("category_id", U.category_id("url")).filter("category_id <> ''")
    slug = U.unquote(F.get(F.split(F.btrim(U.url_path("url"), F.lit("/")), "/"), F.lit(0)))
    usable = (F.col("label") != "") & (F.col("label") != SHOW_ALL_LABEL)
    rows = rows.withColumn("name", F.when(usable, F.col("label")).otherwise(slug))
    first = rows.groupBy("page_id", "category_id").agg(
        F.min("pos").alias("first_pos"),
        # a row that still carries the label gives way to the next one
        F.min_by(F.struct("name", "url"), F.struct((F.col("name") == SHOW_ALL_LABEL).alias("l"), "pos")).alias("row"),
    )
    if limit is None:
        kept = first.withColumn("idx", F.row_number().over(Window.partitionBy("page_id").orderBy("first_pos")))
    else:
        kept = top_k(first, ["page_id"], [F.col("first_pos")], limit, "idx")
    return kept.select("page_id", "idx", "category_id", "row.name", "row.url")


NODES_PER_BIN = 64


def node_contains(nodes: DataFrame, ancestors: Column, descendants: Column, width: int = NODES_PER_BIN) -> DataFrame:
    """Pairs of an element and an element at or below it, met in bins of `width` places of a page.

    An element goes to the bins that its interval touches. All descendants of a bin inside the interval are results, so
    only those of its first and last bin are looked at in vain: work grows with the elements and the pairs, and the bins
    of a large page are spread over tasks. The elements are read once and moved once. The result can hold
    depth x descendants rows; `contained_counts` gives their number without the pairs.
    """
    bin_of = lambda place: F.floor(F.col(place) / width)
    above = F.struct(F.col("pos").alias("a_pos"), F.col("end_pos").alias("a_end"), F.col("tag").alias("a_tag"))
    below = F.struct(F.col("pos").alias("d_pos"), F.col("tag").alias("d_tag"))
    known = nodes.filter(F.col("page_id").isNotNull() & (ancestors | descendants)).select(
        "page_id", F.when(ancestors, above).alias("a"), F.when(descendants, below).alias("d"),
        bin_of("pos").alias("own"), F.when(ancestors, bin_of("end_pos")).otherwise(bin_of("pos")).alias("last"),
    )
    spread = known.select("page_id", "a", "d", "own", F.explode(F.sequence("own", "last")).alias("bin"))
    # a bin holds `width` descendants of a page at most
    held = F.collect_list(F.when(F.col("bin") == F.col("own"), F.col("d"))).over(Window.partitionBy("page_id", "bin"))
    met = spread.withColumn("held", held).filter("a IS NOT NULL")
    inside = F.filter("held", lambda d: d["d_pos"].between(F.col("a.a_pos"), F.col("a.a_end")))
    pairs = met.select("page_id", "a.a_pos", "a.a_tag", F.explode(inside).alias("d"))
    return pairs.select("page_id", "a_pos", "a_tag", "d.d_pos", "d.d_tag")


def contained_counts(nodes: DataFrame, ancestors: Column, descendants: Column) -> DataFrame:
    """(page_id, pos, tag, contained_tag, n) for every ancestor and tag of the descendants it holds, linear in the page.

    Descendants are counted before each place of the page; an interval's number is a difference of two such counts,
    one at its start and one at its end. The elements are read once and moved once, by page.
    """
    def mark(at: Column, contained: Column, sign: int) -> Column:
        return F.struct(at.alias("at"), contained.alias("contained_tag"), F.lit(sign).alias("sign"))

    none = F.lit(None).cast("string")
    ends = F.array(mark(F.col("pos") - 1, none, -1), mark(F.col("end_pos"), none, 1))
    own = F.array(mark(F.col("pos"), F.col("tag"), 0))
    nothing = F.filter(own, lambda _: F.lit(False))
    marks = nodes.filter(F.col("page_id").isNotNull() & (ancestors | descendants)).select(
        "page_id", "pos", "tag",
        F.explode(F.concat(F.when(ancestors, ends).otherwise(nothing), F.when(descendants, own).otherwise(nothing))).alias("e"),
    ).select("page_id", "pos", "tag", "e.*")
    # an interval's ends are asked for each tag that the page's descendants have
    kinds = F.collect_set("contained_tag").over(Window.partitionBy("page_id"))
    asked = marks.withColumn("kinds", kinds).select(
        "page_id", "pos", "tag", "at", "sign",
        F.explode(F.when(F.col("sign") == 0, F.array("contained_tag")).otherwise(F.col("kinds"))).alias("contained_tag"),
    )
    upto = Window.partitionBy("page_id", "contained_tag").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = asked.withColumn("before", F.sum(F.when(F.col("sign") == 0, 1).otherwise(0)).over(upto)).filter("sign <> 0")
    counted = seen.groupBy("page_id", "pos", "tag", "contained_tag").agg(F.sum(F.col("before") * F.col("sign")).alias("n"))
    return counted.filter("n > 0")

"""Native HTML expressions: one page in, arrays of tags out. No Python worker involved.

The exact element tree (nesting quirks included) is the job of
`pagetables.operators.nodes`; these expressions cover the flat questions
(which links, images, meta tags and scripts does a page hold) at JVM speed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetables.functions.images import image_src
from pagetables.functions.text import clean_text, col, decode_entities, first_truthy

HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
COMMENTS = r"(?is)<!--.*?(?:-->|\z)"
# possessive, so that a long tag costs no backtracking and no stack
INSIDE_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
ATTRIBUTE = r"""([^\s"'<>/=][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]*))?)"""

IMAGES_PER_PAGE = 500
LINKS_PER_PAGE = 1000


def visible_html(html: Column | str) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(F.coalesce(col(html), F.lit("")), HIDDEN, "")


def tags(html: Column, name: str) -> Column:
    """Attribute text of every start tag with this name, in page order."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}(?=[\s/>])({INSIDE_TAG})>"), F.lit(1))


def attributes(tag_text: Column) -> Column:
    """ARRAY<STRUCT<k,v>> in source order; entities in values are decoded."""

    def pair(token: Column) -> Column:
        value = F.regexp_extract(token, r"(?s)^[^=]+=\s*(.*)$", 1)
        bare = F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")
        return F.struct(
            F.lower(F.regexp_extract(token, r"^([^\s=]+)", 1)).alias("k"), decode_entities(bare).alias("v")
        )

    return F.transform(F.regexp_extract_all(tag_text, F.lit(ATTRIBUTE), F.lit(1)), pair)


def attribute(pairs: Column, name: str) -> Column:
    """Value of an attribute, '' when absent; the last duplicate wins."""
    hits = F.filter(pairs, lambda p: p["k"] == name)
    return F.coalesce(F.get(hits, F.size(hits) - 1)["v"], F.lit(""))


def title_text(html: Column | str) -> Column:
    inner = F.regexp_extract_all(
        visible_html(html), F.lit(r"(?is)<title(?:\s[^>]*)?>(.*?)(?:</title\s*>|\z)"), F.lit(1)
    )
    return clean_text(F.array_join(F.transform(inner, lambda t: decode_entities(F.regexp_replace(t, "<[^>]*>", " "))), " "))


def flat_text(html: Column | str) -> Column:
    """Text in document order without tags, comments, scripts and styles."""
    return clean_text(decode_entities(F.regexp_replace(visible_html(html), "<[^>]*>", " ")))


def meta_array(html: Column | str) -> Column:
    def row(pairs: Column) -> Column:
        name = first_truthy(*[attribute(pairs, n) for n in ("name", "property", "itemprop")])
        content = attribute(pairs, "content")
        return F.struct(
            name.alias("name"), F.when(content != "", clean_text(content)).alias("content")
        )

    rows = F.transform(F.transform(tags(visible_html(html), "meta"), attributes), row)
    return F.filter(rows, lambda r: r["name"].isNotNull() & r["content"].isNotNull())


def image_array(html: Column | str) -> Column:
    def row(pairs: Column) -> Column:
        return F.struct(
            image_src(lambda name: attribute(pairs, name)).alias("src"),
            clean_text(attribute(pairs, "alt")).alias("alt"),
            clean_text(attribute(pairs, "title")).alias("title"),
        )

    rows = F.transform(F.transform(tags(visible_html(html), "img"), attributes), row)
    return F.filter(rows, lambda r: r["src"] != "")


def _direct_text(inner: Column) -> Column:
    """Text that sits directly under an element, given its inner markup, at any depth of nesting.

    As in the element table, every start tag opens an element, and an end tag closes the nearest open element of its
    name with all inside it, or nothing.
    """
    tokens = F.regexp_extract_all(inner, F.lit(rf"(?s)(</?[A-Za-z]{INSIDE_TAG}>|[^<]++|<)"), F.lit(1))
    names = F.array().cast("array<string>")
    start = F.struct(names.alias("open"), names.alias("own"))

    def step(acc: Column, token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
        from_end = F.array_position(F.reverse(acc["open"]), name)
        closed = F.when(from_end > 0, F.slice(acc["open"], 1, (F.size(acc["open"]) - from_end).cast("int"))).otherwise(acc["open"])
        opened = F.when(token.rlike(r"(?s)/>$"), acc["open"]).otherwise(F.array_append(acc["open"], name))
        now = F.when(name == "", acc["open"]).when(F.startswith(token, F.lit("</")), closed).otherwise(opened)
        own = F.when((name == "") & (F.size(acc["open"]) == 0), F.array_append(acc["own"], token)).otherwise(acc["own"])
        return F.struct(now.alias("open"), own.alias("own"))

    pieces = F.aggregate(tokens, start, step, lambda acc: acc["own"])
    marked = F.contains(inner, F.lit("<"))
    return clean_text(decode_entities(F.when(marked, F.array_join(pieces, " ")).otherwise(inner)))


def link_array(html: Column | str) -> Column:
    """href and direct text of every <a href>, in page order."""
    anchors = F.regexp_extract_all(
        visible_html(html),
        F.lit(rf"(?is)(<a(?=[\s/>]){INSIDE_TAG}>.*?)(?=</a\s*>|<a[\s>]|\z)"),
        F.lit(1),
    )

    def row(anchor: Column) -> Column:
        opening = F.regexp_extract(anchor, rf"(?is)^<a({INSIDE_TAG})>", 1)
        return F.struct(
            attribute(attributes(opening), "href").alias("href"),
            _direct_text(F.substr(anchor, F.length(opening) + 4)).alias("text"),
        )

    return F.filter(F.transform(anchors, row), lambda r: r["href"] != "")


def script_bodies(html: Column | str, type_part: str) -> Column:
    """Trimmed bodies of the scripts whose type attribute contains `type_part`."""
    scripts = F.regexp_extract_all(
        F.regexp_replace(F.coalesce(col(html), F.lit("")), COMMENTS, ""),
        F.lit(rf"(?is)(<script(?=[\s/>]){INSIDE_TAG}>.*?)</script\s*>"),
        F.lit(1),
    )
    opened = F.transform(
        scripts, lambda s: F.struct(F.regexp_extract(s, rf"(?is)^<script({INSIDE_TAG})>", 1).alias("tag"), s.alias("s"))
    )
    typed = F.filter(
        opened, lambda s: F.contains(F.lower(attribute(attributes(s["tag"]), "type")), F.lit(type_part))
    )
    bodies = F.transform(typed, lambda s: F.trim(F.substr(s["s"], F.length(s["tag"]) + 9)))
    return F.filter(bodies, lambda b: b != "")

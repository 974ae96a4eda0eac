"""URL expressions: split, quote, resolve, compare, classify.

`parse_url` is avoided: it rejects what a lenient crawler accepts. Each of the
five RFC 3986 parts has its own anchored pattern.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetables.functions.text import any_of, clean_text, col, let, title_case

_SCHEME = r"(?:[A-Za-z][A-Za-z0-9+.\-]*:)"
URL_PARTS = {
    "scheme": r"^([A-Za-z][A-Za-z0-9+.\-]*):",
    "authority": rf"^{_SCHEME}?//([^/?#]*)",
    "path": rf"^{_SCHEME}?(?://[^/?#]*)?([^?#]*)",
    "query": r"^[^?#]*\?([^#]*)",
    "fragment": r"(?s)^[^#]*#(.*)$",
}

# --- fixed values: results depend on these exact texts -----------------------
PRODUCT_PATH_TOKENS = ["/product", "/products", "/p/", "/item", "/shop", "/store"]
CATALOG_STRONG = [
    "/sofas", "/tables", "/chairs", "/beds", "/storage", "/outdoor", "/accessories",
    "/furniture-sets", "/sale", "/new", "/collections",
]
CATALOG_WEAK = [
    "all-", "all_", "bestsellers", "sale", "sets", "furniture", "tables", "sofas", "chairs", "beds",
    "mirrors", "rugs",
]
CATALOG_WORDS = [
    "shop", "all", "sofas", "tables", "chairs", "beds", "storage", "outdoor", "accessories", "sale", "collection",
]
CATALOG_DENIED = (
    "products?|cart|wishlist|account|login|blog|help|contact|reviews|terms|privacy|delivery|warranty|"
    "showrooms?|press|careers|sitemap|accessibility"
)
# --- end of fixed values -----------------------------------------------------


def url_part(url: Column | str, part: str) -> Column:
    text = F.regexp_extract(col(url), URL_PARTS[part], 1)
    return F.lower(text) if part == "scheme" else text


def url_parts(url: Column | str) -> Column:
    """All parts of a URL as a struct, for expressions that need several of them."""
    return F.struct(*[url_part(url, p).alias(p) for p in URL_PARTS])


def url_path(url: Column | str) -> Column:
    """Path without the ;parameters of its last segment."""
    return F.regexp_replace(url_part(url, "path"), r";[^/]*$", "")


def with_scheme(url: Column | str) -> Column:
    """https:// in front of an address that names no scheme."""
    url = F.trim(col(url))
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


def site_of(url: Column | str) -> Column:
    """host:port of a http(s) URL, NULL for anything else."""
    url = col(url)
    return F.when(
        url_part(url, "scheme").isin("http", "https"), F.nullif(url_part(url, "authority"), F.lit(""))
    )


def same_site(url: Column | str, base: Column | str) -> Column:
    return url_part(url, "scheme").isin("http", "https") & (url_part(url, "authority") == url_part(base, "authority"))


def site_root(url: Column | str) -> Column:
    return F.concat(url_part(url, "scheme"), F.lit("://"), url_part(url, "authority"))


def unquote(c: Column | str) -> Column:
    """Percent-decoding that keeps '+' and leaves broken sequences alone."""

    def decode(text: Column) -> Column:
        safe = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
        return F.when(F.contains(text, F.lit("%")), F.try_url_decode(safe)).otherwise(text)

    return let(col(c), decode)


def quote(c: Column | str, keep: str) -> Column:
    """Percent-encoding of everything but letters, digits, '_.-~' and the characters of `keep`."""
    encoded = F.url_encode(col(c))
    swaps = [("+", "%20"), ("*", "%2A"), ("%7E", "~")]
    swaps += [(f"%{ord(ch):02X}", ch) for ch in keep if ch != "%"]
    if "%" in keep:
        swaps.append(("%25", "%"))  # last, so that it cannot create sequences for the others
    for old, new in swaps:
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    return encoded


def _prefixed(mark: str, text: Column) -> Column:
    return F.when(text == "", F.lit("")).otherwise(F.concat(F.lit(mark), text))


def normalize_url(url: Column | str) -> Column:
    """Absolute http(s) URL with canonical percent-encoding; NULL when it is not a web address."""

    def build(u: Column) -> Column:
        params = F.regexp_extract(u["path"], r";([^/]*)$", 1)
        plain_path = F.regexp_replace(u["path"], r";[^/]*$", "")
        text = F.concat(
            u["scheme"],
            F.lit("://"),
            u["authority"],
            quote(unquote(plain_path), "/%"),
            _prefixed(";", params),
            _prefixed("?", quote(unquote(u["query"]), "=&%[]:,/+")),
            _prefixed("#", u["fragment"]),
        )
        return F.when(u["scheme"].isin("http", "https") & (u["authority"] != ""), text)

    return let(url_parts(with_scheme(url)), build)


def _without_dots(segments: Column) -> Column:
    """Resolve '.' and '..' in a path split at '/'."""
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    path = F.concat(F.array_join(resolved, "/"), tail)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def resolve_url(base: Column | str, ref: Column | str) -> Column:
    """Join a reference with the URL of its page; an empty reference stays empty."""
    return let(url_parts(base), lambda b: resolve_parts(b, ref))


def resolve_parts(base: Column, ref: Column | str) -> Column:
    """`resolve_url` for a base that is already split by `url_parts`."""
    root = F.concat(base["scheme"], F.lit("://"), base["authority"])
    ref = F.coalesce(col(ref), F.lit(""))
    ref = F.when(ref.rlike(r"^[\x00-\x20]|[\t\r\n]"), F.regexp_replace(ref, r"^[\x00-\x20]+|[\t\r\n]", "")).otherwise(ref)

    def relative(r: Column) -> Column:
        path, query, fragment = (url_part(r, p) for p in ("path", "query", "fragment"))
        tail = F.concat(_prefixed("?", query), _prefixed("#", fragment))
        folder = F.regexp_replace(base["path"], r"[^/]*$", "")
        joined = F.split(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path), "/")
        # empty middle segments of a relative path are dropped, those of a rooted path stay
        last = F.size(joined) - 1
        kept = F.filter(joined, lambda seg, i: (seg != "") | (i == 0) | (i == last))
        same_page = F.concat(
            root, base["path"],
            _prefixed("?", F.when(query == "", base["query"]).otherwise(query)),
            _prefixed("#", fragment),
        )
        return (
            F.when(r == "", F.lit(""))
            .when(r.startswith("//"), F.concat(base["scheme"], F.lit(":"), r))
            .when(r.startswith("/") & ~F.contains(r, F.lit("/.")), F.concat(root, r))
            .when(r.startswith("/"), F.concat(root, _without_dots(F.split(path, "/")), tail))
            .when(url_part(r, "scheme") != "", r)
            .when(path == "", same_page)
            .otherwise(F.concat(root, _without_dots(kept), tail))
        )

    return let(ref, relative)


def category_id(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"/c(\d+)", 1)


def collection_handle(url: Column | str) -> Column:
    return unquote(F.regexp_extract(url_path(url), r"(?i)/collections/([^/?#]+)", 1))


def region_prefix(url: Column | str) -> Column:
    """'/xx' or '/xx-yy' when the first path part is a region, else ''."""
    first = F.get(F.filter(F.split(url_path(url), "/"), lambda p: p != ""), F.lit(0))
    return F.when(first.rlike(r"(?i)^[a-z]{2}(-[a-z]{2})?$"), F.concat(F.lit("/"), first)).otherwise(F.lit(""))


def product_url(base: Column | str, slug: Column | str) -> Column:
    name = F.btrim(clean_text(slug), F.lit("/"))
    return F.when(name == "", F.lit("")).otherwise(
        F.concat(site_root(base), region_prefix(base), F.lit("/products/"), name)
    )


def last_segment(url: Column | str) -> Column:
    return F.element_at(F.split(F.rtrim(unquote(url_path(url)), F.lit("/")), "/"), -1)


def title_from_url(url: Column | str) -> Column:
    return clean_text(title_case(F.replace(last_segment(url), F.lit("-"), F.lit(" "))))


def looks_like_product_url(url: Column | str, tokens: Sequence[str] = PRODUCT_PATH_TOKENS) -> Column:
    path = F.lower(unquote(url_path(url)))
    return any_of(path, tokens) | path.rlike(r"/p\d+")


def catalog_link_score(
    url: Column | str,
    text: Column | str,
    strong: Sequence[str] = CATALOG_STRONG,
    weak: Sequence[str] = CATALOG_WEAK,
    words: Sequence[str] = CATALOG_WORDS,
    denied: str = CATALOG_DENIED,
) -> Column:
    """0 for empty or denied paths; +4 strong token, +2 weak token, +1 word in the link text."""
    word = F.coalesce(col(text), F.lit("")).rlike(rf"(?iU)\b({'|'.join(words)})\b")

    def score(path: Column) -> Column:
        points = (
            F.when(any_of(path, strong), 4).otherwise(0)
            + F.when(any_of(path, weak), 2).otherwise(0)
            + F.when(word, 1).otherwise(0)
        )
        return F.when((path == "") | path.rlike(rf"/(?:{denied})(?:/|$)"), F.lit(0)).otherwise(points)

    return let(F.lower(unquote(url_path(url))), score)

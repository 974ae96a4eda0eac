"""Building blocks for the SQL twins, written for DuckDB and independent of the Spark expressions."""

from __future__ import annotations

SPACE = r"[ \t\r\n\f\v\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def decode(x: str) -> str:
    """The entities that occur in the driver pages."""
    for name, char in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")]:
        x = f"replace({x}, '{name}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def visible(x: str) -> str:
    return f"regexp_replace({x}, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs')"


def scheme(u: str) -> str:
    return f"regexp_extract({u}, '^([a-z]+)://', 1)"


def host(u: str) -> str:
    return f"regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)"


def root(u: str) -> str:
    return f"regexp_extract({u}, '^([a-z]+://[^/?#]*)', 1)"


def path(u: str) -> str:
    return f"regexp_extract({u}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def title_case(x: str) -> str:
    """Letters after a non-letter up, other letters down."""
    return (
        f"list_aggregate(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|\\P{{L}}+)', 1), "
        f"lambda w: replace(upper(w[1]), 'ẞ', 'Ss') || lower(w[2:])), 'string_agg', '')"
    )


LINKS = f"""
links AS (
  SELECT page_id, url AS page_url, pos, {root("url")} || href AS href, {clean(decode("txt"))} AS text
  FROM (
    SELECT page_id, url, unnest(range(len(hs))) AS pos, unnest(hs) AS href, unnest(ts) AS txt
    FROM (
      SELECT page_id, url,
             regexp_extract_all(h, '<a href="([^"]*)">([^<]*)', 1) AS hs,
             regexp_extract_all(h, '<a href="([^"]*)">([^<]*)', 2) AS ts
      FROM (SELECT page_id, url, {visible("html")} AS h FROM pages)
    )
  )
)"""

"""Text of page bytes: which charset they are in, and their characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD_BYTES = 1024  # a charset is declared in this part of a page
MARKS = {"EFBBBF": ("utf-8", 3), "FFFE": ("utf-16-le", 2), "FEFF": ("utf-16-be", 2)}  # first bytes, charset, bytes to skip
LABEL = r"""(?i)charset\s*=\s*["']?\s*([a-z0-9][a-z0-9_.:-]*)"""


def _marked(content: Column, found: int, otherwise: Column) -> Column:
    start = F.hex(F.substring(content, 1, 3))
    out = otherwise
    for mark, values in MARKS.items():
        out = F.when(start.startswith(mark), F.lit(values[found])).otherwise(out)
    return out


def charset_of(content: Column | str, content_type: Column | str | None = None) -> Column:
    """The charset of page bytes in lower case: by their byte order mark, the content type of the answer, the page's own
    meta tag (in its first HEAD_BYTES), in this order; else UTF-8."""
    content = F.col(content) if isinstance(content, str) else content
    head = F.decode(F.substring(content, 1, HEAD_BYTES), "ISO-8859-1")
    declared = F.regexp_extract(F.regexp_extract(head, r"(?is)<meta\b[^>]*charset\s*=[^>]*>", 0), LABEL, 1)
    told = F.lit("") if content_type is None else F.regexp_extract(F.coalesce(content_type, F.lit("")), LABEL, 1)
    label = F.lower(F.coalesce(F.nullif(told, F.lit("")), F.nullif(declared, F.lit("")), F.lit("utf-8")))
    return _marked(content, 0, F.when(label.isin("utf8", "utf-8"), F.lit("utf-8")).otherwise(label))


def decoded(content: Column | str, charset: Column) -> Column:
    """The characters of page bytes; what the charset cannot read is replaced, an unknown charset is read as UTF-8.

    UTF-8 pages are read by an expression; only the bytes of other pages go through a Python worker. A byte order mark
    is left out. Null content gives null.
    """
    content = F.col(content) if isinstance(content, str) else content
    skip = _marked(content, 1, F.lit(0))
    body = F.when(skip > 0, F.substr(content, skip + 1, F.octet_length(content))).otherwise(content)
    plain = charset == "utf-8"
    return F.when(plain, F.make_valid_utf8(body.cast("string"))).otherwise(_by_name(F.when(~plain, body), charset))


def _text(data: bytes | None, charset: str) -> str | None:
    if data is None:
        return None
    try:
        text = data.decode(charset, "replace")
    except (LookupError, ValueError):  # no charset of text
        text = data.decode("utf-8", "replace")
    return text.encode("utf-8", "replace").decode()  # half a surrogate pair is no character


@F.pandas_udf(T.StringType())
def _by_name(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for contents, charsets in batches:
        yield pd.Series([_text(c, s) for c, s in zip(contents, charsets)], dtype=object)

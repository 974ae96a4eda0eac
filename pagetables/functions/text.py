"""String expressions: whitespace, truthiness, entities, prices, model numbers.

Everything here builds a Column out of built-in functions, so it stays in the
JVM and inside code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from html import unescape
from html.entities import html5
from zlib import crc32

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: results depend on these exact texts -----------------------
CURRENCY_CODES = "USD|EUR|GBP|AED|SAR|QAR|KWD|OMR|BHD|EGP|INR|PKR|CAD|AUD"
CURRENCY_SIGNS = r"[$€£₹]|د\.إ|ر\.س|ريال|AED|SAR"
PRICE_PATTERN = (
    rf"(?:(?:{CURRENCY_CODES})\s*)?(?:{CURRENCY_SIGNS})?\s*"
    rf"\d{{1,3}}(?:[,\s]\d{{3}})*(?:[.,]\d{{2}})?\s*(?:{CURRENCY_CODES}|ريال)?"
)
MODEL_LABEL_PATTERN = (
    r"\b(?:model(?:\s*(?:no\.?|number|#|code))?|item\s*(?:no\.?|number|#)"
    r"|part\s*(?:no\.?|number|#)|sku|mpn)\b\s*[:#-]?\s*([A-Za-z0-9][A-Za-z0-9._/\- ]{1,60})"
)
MODEL_STOP_WORDS = (
    "price|brand|manufacturer|availability|description|category|condition|color|size|sku|mpn|model|item|part"
)
BOILERPLATE_WARNING = (
    r"The HTTPS certificate could not be verified by this Python installation,?\s*"
    r"so the page was fetched with relaxed certificate checking\.?"
)
WARNING_REST = "Note: ."
# --- end of fixed values -----------------------------------------------------

# All HTML entities, from the standard library's table.
ENTITIES = dict(html5)  # names with their semicolon, and those that go without
# Names that are also decoded without a closing semicolon, and numbers that stand for something else or nothing.
OPEN_ENTITIES = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
ODD_NUMBERS = {n: unescape(f"&#{n};") for n in range(160) if unescape(f"&#{n};") != chr(n)}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute `value` once per row and use it many times in `body`.

    Projections that are merged or pushed below a filter repeat their
    expressions; a lambda variable is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# The characters of (?U)[\s\x1c-\x1f], spelled out: Unicode classes are looked up slowly.
_WIDE_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# a run of white space that is not just one blank
SPACE_RUN = rf"[{_WIDE_SPACE}][ {_WIDE_SPACE}]*+| [ {_WIDE_SPACE}]++"


def clean_text(c: Column | str) -> Column:
    """Collapse every run of Unicode white space to one blank and trim; NULL gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE_RUN, " "))


def truthy(c: Column | str, kind: str = "string") -> Column:
    """NULL for the values that count as blank: '' for strings, 0 for numbers, false for booleans."""
    c = col(c)
    blank = {"string": F.lit(""), "number": F.lit(0), "boolean": F.lit(False)}[kind]
    return F.nullif(c, blank)


def first_truthy(*cs: Column | str, kind: str = "string") -> Column:
    return F.coalesce(*[truthy(c, kind) for c in cs])


def code_point(n: Column) -> Column:
    """Character of a code point (`chr` stops at 255)."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


BUCKETS = 512


def _looked_up(pairs: dict[str, str], key: Column) -> Column:
    """Value of a key in a table that is one literal: a short text for each checksum, so little is read and shipped."""
    texts = ["\1"] * BUCKETS
    for name, value in pairs.items():
        texts[crc32(name.encode()) % BUCKETS] += f"{name}\2{value}\1"
    near = F.get(F.split(F.lit("\3".join(texts)), "\3"), F.crc32(key.cast("binary")) % BUCKETS)
    mark = F.concat(F.lit("\1"), key, F.lit("\2"))
    return let(
        F.struct(near.alias("near"), mark.alias("mark"), F.instr(near, mark).alias("at")),
        lambda f: F.when(f["at"] > 0, F.substring_index(F.substr(f["near"], f["at"] + F.length(f["mark"])), "\1", 1)),
    )


def _character(number: Column) -> Column:
    """Character of a number; what is no character or a control character follows the HTML rules."""
    odd = _looked_up({str(n): t for n, t in ODD_NUMBERS.items()}, number.cast("string"))
    nothing = number.between(0xFDD0, 0xFDEF) | (F.pmod(number, F.lit(0x10000)) >= 0xFFFE)
    return (
        F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(number < 160, F.coalesce(odd, code_point(number)))
        .when(nothing, F.lit(""))
        .otherwise(code_point(number))
    )


def _decode_piece(piece: Column) -> Column:
    """A piece is a text that starts at '&' and holds no other '&'; the first one of a text may lack it."""

    def rest(name: Column) -> Column:
        return F.substr(piece, F.length(name) + 2)

    def numbered(mark: Column) -> Column:
        """`mark` is '#' or '#x', then zeros and the other digits."""
        base = F.when(mark.rlike("^#[xX]"), F.lit(16)).otherwise(F.lit(10))
        short = F.regexp_replace(mark, "^#[xX]?0*", "")
        value = F.when(F.length(short) > 8, F.lit(1 << 40)).otherwise(
            F.coalesce(F.when(base == 16, F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).try_cast("bigint"), F.lit(0))
        )
        return F.concat(let(value, _character), F.regexp_replace(rest(mark), "^;", ""))

    # a name with its semicolon, else the longest name that goes without one
    names = F.array(
        F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*;)", 1), F.regexp_extract(piece, rf"^&({'|'.join(OPEN_ENTITIES)})", 1)
    )
    found = F.transform(names, lambda n: F.when(n != "", F.concat(_looked_up(ENTITIES, n), rest(n))))
    named = let(found, lambda both: F.coalesce(F.get(both, F.lit(0)), F.get(both, F.lit(1)), piece))
    number = F.regexp_extract(piece, r"^&(#[0-9]+|#[xX][0-9a-fA-F]+)", 1)
    return (
        F.when(piece.startswith("&#"), let(number, lambda mark: F.when(mark != "", numbered(mark)).otherwise(piece)))
        .when(piece.startswith("&"), named)
        .otherwise(piece)
    )


def decode_entities(c: Column | str) -> Column:
    """One-pass entity decoding in the JVM: each '&' starts a piece, so '&amp;lt;' gives '&lt;'."""

    def decode(text: Column) -> Column:
        pieces = F.transform(F.split(text, "(?=&)"), _decode_piece)
        return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)

    return let(col(c), decode)


def html_to_text(c: Column | str) -> Column:
    """Line-breaking tags become blanks, other tags too, entities are decoded, white space collapsed."""
    c = F.coalesce(col(c), F.lit(""))
    # every tag ends up as a blank, so one replacement covers breaking and inline tags alike
    return clean_text(decode_entities(F.regexp_replace(c, r"<[^>]+>", " ")))


def first_price(c: Column | str, strict: bool = False) -> Column:
    """First price-like run. Sign and code are optional; `strict` keeps only matches that carry one."""
    c = F.coalesce(col(c), F.lit(""))
    if not strict:
        # every price holds a digit; texts without one skip the slow pattern
        found = F.when(c.rlike(r"(?U)\d"), F.regexp_extract(c, f"(?iU){PRICE_PATTERN}", 0)).otherwise(F.lit(""))
        return clean_text(found)
    matches = F.regexp_extract_all(c, F.lit(f"(?iU)({PRICE_PATTERN})"), F.lit(1))
    marked = F.filter(matches, lambda m: m.rlike(f"(?iU){CURRENCY_CODES}|{CURRENCY_SIGNS}"))
    return clean_text(F.get(marked, F.lit(0)))


def model_from_text(c: Column | str) -> Column:
    """Value behind a model / item / part / sku / mpn label, cut before the next label word."""
    found = clean_text(F.regexp_extract(F.coalesce(col(c), F.lit("")), f"(?iU){MODEL_LABEL_PATTERN}", 1))
    head = F.get(F.split(found, rf"(?iU)\s+(?:{MODEL_STOP_WORDS})\b", 2), F.lit(0))
    return F.btrim(head, F.lit(" :-#"))


def title_case(c: Column | str) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the other letters."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))

    def cased(run: Column) -> Column:
        head = F.upper(F.substring(run, 1, 1))  # two letters for a sharp s
        return F.concat(F.substring(head, 1, 1), F.lower(F.concat(F.substr(head, F.lit(2)), F.substr(run, F.lit(2)))))

    return F.array_join(F.transform(runs, cased), "")


def normalize_email(c: Column | str) -> Column:
    return F.lower(clean_text(c))


def clean_warnings(*parts: Column | str) -> Column:
    """Join the non-blank warnings by a blank after dropping the known boilerplate sentence."""
    kept = F.filter(F.array(*[col(p) for p in parts]), lambda p: F.coalesce(p, F.lit("")) != "")
    joined = F.array_join(kept, " ")
    dropped = F.regexp_replace(joined, f"(?iU){BOILERPLATE_WARNING}", "")
    return clean_text(F.replace(dropped, F.lit(WARNING_REST), F.lit("")))


def concat_distinct(array: Column | str, sep: str = " | ") -> Column:
    """Ordered distinct of an array, joined; the first occurrence keeps its place."""
    return F.array_join(F.array_distinct(col(array)), sep)


def float_text(d: Column | str) -> Column:
    """Shortest decimal text of a double with at least one fraction digit ('129.0', '12345678.5')."""
    d = col(d)
    plain = F.regexp_replace(d.try_cast("decimal(38,12)").cast("string"), r"0+$", "")
    padded = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.when((F.abs(d) >= 1e7) & (F.abs(d) < 1e16), padded).otherwise(d.cast("string"))


def cell_text(c: Column | str, dtype: T.DataType) -> Column:
    """Sheet text of a value: NULL, '', 0 and false are blank, booleans are True/False."""
    c = col(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).otherwise(F.lit(""))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(float_text(c.cast("double")))
    if isinstance(dtype, T.NumericType):
        return F.when(c.isNull() | (c == 0), F.lit("")).otherwise(c.cast("string"))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.to_json(c), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def any_of(c: Column, words: Sequence[str]) -> Column:
    """True when the text contains one of the words."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(c, F.lit(word))
    return found

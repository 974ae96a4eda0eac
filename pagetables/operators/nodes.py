"""Element table of a page corpus: the one place where a Python worker reads markup.

A page is turned into element rows inside `mapInArrow`; everything that asks
about elements afterwards (contains an image, first heading, score) is window
and filter work in Spark.

The text of an element is its own text followed by the text of its children,
so the pre-order sequence of own texts is the text of the whole page and every
element's text is one slice of it.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetables.functions.text import PRICE_PATTERN

# --- fixed values: results depend on these exact texts -----------------------
CANDIDATE_TAGS = ["article", "li", "div", "section", "a", "tr"]
# --- end of fixed values -----------------------------------------------------

TEXT_LIMIT = 2000  # longest piece of an element's text that any operator shows
TITLE_LIMIT = 240
ROWS_PER_BATCH = 20_000
CHARS_PER_BATCH = 32_000_000
ROPE_BYTES_PER_BATCH = 4_000_000

# tags whose first occurrence at or below an element is recorded with the element
FIRST_TAGS = ["img", "a", "h1", "h2", "h3", "h4", "h5"]
FIRST_TEXT = 240

NODE_SCHEMA = (
    "page_id bigint, url string, pos int, end_pos int, parent_pos int, depth int, tag string, "
    "attrs map<string,string>, own_text array<string>, text string, text_len int, price string, plain_title string, "
    + ", ".join(f"first_{t} struct<pos:int,text:string,attrs:map<string,string>>" for t in FIRST_TAGS)
)
_FIRST = pa.struct([("pos", pa.int32()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])
_ARROW = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("pos", pa.int32()), ("end_pos", pa.int32()),
    ("parent_pos", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.list_(pa.string())), ("text", pa.string()),
    ("text_len", pa.int32()), ("price", pa.string()), ("plain_title", pa.string()),
    *[(f"first_{t}", _FIRST) for t in FIRST_TAGS],
])


_TEXT = _ARROW.get_field_index("text")


# Tags as most pages write them; the standard parser reads them to the same result, but slowly.
_ATTRIBUTE = r"""[ \t\n\r\f]++([a-zA-Z_:][-\w:.]*+)(?:=("[^"]*+"|'[^']*+'|[^\s"'=<>`/]++(?=[ \t\n\r\f>])))?+(?=[ \t\n\r\f/>])"""
_START_TAG = re.compile(rf"<(?P<tag>[a-zA-Z][-a-zA-Z0-9:_]*+)(?P<attrs>(?:{_ATTRIBUTE})*+)[ \t\n\r\f]*+(?P<end>/?+>)")
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_END_TAG = re.compile(r"</([a-zA-Z][-.a-zA-Z0-9:_]*+)>")
# what follows these tags may be read in another way
_RAW_TAGS = frozenset((
    "script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext",
))


class _Tags(HTMLParser):
    """The standard parser with a short way through plain tags; all others take the standard way."""

    def updatepos(self, i, j):  # line numbers are not asked for
        return j

    def parse_starttag(self, i):
        found = _START_TAG.match(self.rawdata, i)
        if found is None or (tag := found["tag"].lower()) in _RAW_TAGS:
            return super().parse_starttag(i)
        self.lasttag = tag
        attrs = []
        start, end = found.span("attrs")
        if start < end:
            for name, value in _ATTRIBUTES.findall(self.rawdata, start, end + 1):  # with the character behind, which ends the last one
                if not value:
                    value = None
                elif value[0] in "\"'":
                    value = value[1:-1]
                attrs.append((name.lower(), unescape(value) if value else value))
        if found["end"] == "/>":
            self.handle_startendtag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
        return found.end()

    def parse_endtag(self, i):
        found = None if self.cdata_elem is not None else _END_TAG.match(self.rawdata, i)
        if found is None:
            return super().parse_endtag(i)
        self.handle_endtag(found.group(1).lower())
        return found.end()


class _Scripts(_Tags):
    """The bodies of the JSON-LD scripts and nothing else."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.silent = False
        self.scripts: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "script" and "ld+json" in (dict(attrs).get("type") or "").lower():
            self.silent = True
            self.scripts.append([])

    def handle_endtag(self, tag):
        if tag == "script":
            self.silent = False

    def handle_data(self, data):
        if self.silent:
            self.scripts[-1].append(data)


class _Outline(_Tags):
    """Records elements in pre-order. Every start tag opens an element, also void ones; an end
    tag closes the nearest open element of its name and all inside it, or nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags = ["document"]
        self.attrs: list[list[tuple[str, str]]] = [[]]
        self.texts: list[list[str]] = [[]]
        self.parents = [-1]
        self.depths = [0]
        self.ends = [0]
        self.open = [0]
        self.open_by_tag: dict[str, list[int]] = {}
        self.silent = False  # inside a JSON-LD script
        self.scripts: list[list[str]] = []  # bodies of the JSON-LD scripts

    def handle_starttag(self, tag, attrs):
        pos = len(self.tags)
        values = {name: value or "" for name, value in attrs}
        self.tags.append(tag)
        self.attrs.append(list(values.items()))
        self.texts.append([])
        self.parents.append(self.open[-1])
        self.depths.append(len(self.open))
        self.ends.append(pos)
        self.open_by_tag.setdefault(tag, []).append(len(self.open))
        self.open.append(pos)
        if tag == "script" and "ld+json" in values.get("type", "").lower():
            self.silent = True
            self.scripts.append([])

    def handle_endtag(self, tag):
        if tag == "script":
            self.silent = False
        levels = self.open_by_tag.get(tag)
        if not levels:
            return
        level, last = levels[-1], len(self.tags) - 1
        while len(self.open) > level:
            closed = self.open.pop()
            self.ends[closed] = last
            self.open_by_tag[self.tags[closed]].pop()

    def handle_data(self, data):
        if self.silent:
            self.scripts[-1].append(data)
        else:
            text = " ".join(data.split())
            if text:
                self.texts[self.open[-1]].append(text)

    def outline(self, html: str) -> _Outline:
        self.feed(html)
        for pos in self.open:
            self.ends[pos] = len(self.tags) - 1
        return self


_PRICE = re.compile(PRICE_PATTERN, re.I)
_DIGIT = re.compile(r"\d")
_PRICE_LEAD = 16  # a price starts at most this far before its first digit


def _plain_title(text: str, start: int, end: int, price: str) -> str:
    """Start of an element's text without its price; reads only as much text as it needs."""
    size = 4096
    while True:
        stop = min(end, start + size)
        piece = text[start:stop]
        if price:
            piece = piece.replace(price, "")
        piece = " ".join(piece.split())
        if stop == end or len(piece) > TITLE_LIMIT + len(price):
            return piece[:TITLE_LIMIT]
        size *= 4


def _element_rows(
    page_id: int, url: str, html: str, wanted: frozenset[str] = frozenset(_ARROW.names), tags: frozenset[str] | None = None,
) -> Iterator[tuple]:
    """A tuple of all fields for each element of one of the `tags`; costly fields that are not `wanted` are left empty."""
    page = _Outline().outline(html)
    if not wanted & _OF_TEXT:
        for pos, tag in enumerate(page.tags):
            if tags is not None and tag not in tags:
                continue
            yield (
                page_id, url, pos, page.ends[pos], page.parents[pos], page.depths[pos], tag, page.attrs[pos], page.texts[pos],
                "", None, None, None, *_NO_FIRSTS,
            )
        return
    # where the text that is owned by the elements before `pos` ends
    offsets, pieces, length = [], [], 0
    for own in page.texts:
        offsets.append(length)
        for piece in own:
            pieces.append(piece)
            length += len(piece) + 1
    offsets.append(length)
    text = " ".join(pieces)
    priced = not wanted.isdisjoint(("price", "plain_title"))
    digits = [m.start() for m in _DIGIT.finditer(text)] if priced else []
    in_link_until = -1
    firsts = _firsts(page, offsets, text) if wanted & _OF_FIRSTS else {}
    titled = CANDIDATE_TAGS if "plain_title" in wanted else ()
    for pos, tag in enumerate(page.tags):
        if tags is not None and tag not in tags:
            continue
        start, end = offsets[pos], max(offsets[pos], offsets[page.ends[pos] + 1] - 1)
        price, at = "", bisect_left(digits, start)
        if at < len(digits) and digits[at] < end:
            found = _PRICE.search(text, max(start, digits[at] - _PRICE_LEAD), end)
            price = found.group(0)
        whole = pos == 0
        if tag == "a" and pos > in_link_until:
            whole, in_link_until = True, page.ends[pos]
        shown = text[start:end if whole else min(end, start + TEXT_LIMIT)]
        yield (
            page_id, url, pos, page.ends[pos], page.parents[pos], page.depths[pos], tag, page.attrs[pos],
            page.texts[pos], shown, end - start, " ".join(price.split()),
            _plain_title(text, start, end, price) if tag in titled else None,
            *firsts.get(pos, _NO_FIRSTS),
        )


_NO_FIRSTS = (None,) * len(FIRST_TAGS)
_OF_FIRSTS = frozenset(f"first_{t}" for t in FIRST_TAGS)
_OF_TEXT = _OF_FIRSTS | {"text", "text_len", "price", "plain_title"}


def _firsts(page: _Outline, offsets: list[int], text: str) -> dict[int, tuple]:
    """For each candidate element the first element of each of FIRST_TAGS at or below it: one scan from the page's end."""
    ahead: dict[str, dict] = {}
    found = {}
    for pos in range(len(page.tags) - 1, -1, -1):
        tag, last = page.tags[pos], page.ends[pos]
        if tag in FIRST_TAGS:
            start = offsets[pos]
            stop = max(start, min(offsets[last + 1] - 1, start + FIRST_TEXT))
            ahead[tag] = {"pos": pos, "text": text[start:stop], "attrs": page.attrs[pos]}
        if tag in CANDIDATE_TAGS:
            found[pos] = tuple(ahead[t] if t in ahead and ahead[t]["pos"] <= last else None for t in FIRST_TAGS)
    return found


def _nodes_of(
    columns: Sequence[str], tags: Sequence[str] | None = None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    wanted = frozenset(columns)
    kept = None if tags is None else frozenset(tags)
    schema = pa.schema([_ARROW.field(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                for row in _element_rows(page_id, url, html or "", wanted, kept):
                    rows.append(row)
                    chars += len(row[_TEXT])
                    if len(rows) >= ROWS_PER_BATCH or chars >= CHARS_PER_BATCH:
                        yield _batch(rows, schema)
                        rows, chars = [], 0
        if rows:
            yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    values = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(values[_ARROW.get_field_index(field.name)], type=field.type) for field in schema], schema=schema
    )


def _parsable(pages: DataFrame, max_bytes: int | None) -> DataFrame:
    rows = pages.select("page_id", "url", "html")
    return rows if max_bytes is None else rows.filter(F.coalesce(F.octet_length("html"), F.lit(0)) <= max_bytes)


def page_nodes(
    pages: DataFrame, max_bytes: int | None = None, columns: Sequence[str] | None = None, tags: Sequence[str] | None = None,
) -> DataFrame:
    """One row per element, in pre-order. `text` is the start of an element's text; `element_texts` gives it whole.

    The root row and links that are not inside another link carry their whole
    text; these texts do not overlap, so a page never grows by nesting. Pages
    above a size limit, if one is given, give no rows (`page_status` reports them).
    A caller that reads few columns, or the elements of few tags, names them: the others are neither computed nor moved
    out of the Python worker.
    """
    chosen = _ARROW.names if columns is None else list(columns)
    fields = T.StructType.fromDDL(NODE_SCHEMA)
    schema = T.StructType([fields[c] for c in chosen])
    return _parsable(pages, max_bytes).mapInArrow(_nodes_of(chosen, tags), schema)


ROPE_SCHEMA = (
    "page_id bigint, url string, text binary, "
    "elements array<struct<pos:int,end_pos:int,parent_pos:int,depth:int,tag:string,start:int,size:int>>"
)


def _rope(html: str) -> tuple[bytes, list[list]]:
    """The text of a page as bytes; pos, end, parent, depth, tag, first byte and number of bytes of each element."""
    page = _Outline().outline(html)
    offsets, pieces, length = [], [], 0
    for own in page.texts:
        offsets.append(length)
        for piece in own:
            pieces.append(piece.encode("utf-8", "replace"))
            length += len(pieces[-1]) + 1
    offsets.append(length)
    sizes = [max(0, offsets[last + 1] - 1 - start) for start, last in zip(offsets, page.ends)]
    columns = [list(range(len(page.tags))), page.ends, page.parents, page.depths, page.tags, offsets[:-1], sizes]
    return b" ".join(pieces), columns


_ELEMENT = [("pos", pa.int32()), ("end_pos", pa.int32()), ("parent_pos", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
            ("start", pa.int32()), ("size", pa.int32())]


def _ropes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages: list[tuple] = []
        ends, columns, size = [0], [[] for _ in _ELEMENT], 0
        for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            text, values = _rope(html or "")
            pages.append((page_id, url, text))
            for column, more in zip(columns, values):
                column += more
            ends.append(len(columns[0]))
            size += len(text)
            if size >= ROPE_BYTES_PER_BATCH or ends[-1] >= ROWS_PER_BATCH:
                yield _rope_batch(pages, ends, columns)
                pages, ends, columns, size = [], [0], [[] for _ in _ELEMENT], 0
        if pages:
            yield _rope_batch(pages, ends, columns)


def _rope_batch(pages: list[tuple], ends: list[int], columns: list[list]) -> pa.RecordBatch:
    ids, urls, texts = zip(*pages)
    fields = [pa.array(values, kind) for values, (_, kind) in zip(columns, _ELEMENT)]
    elements = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, [name for name, _ in _ELEMENT])
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.binary()), elements],
        names=["page_id", "url", "text", "elements"],
    )


def page_ropes(pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row per page: its text once, as UTF-8 bytes, and where in it the text of each element lies.

    As large as the page however deep it is nested. A page without html has one element, the document, without text.
    """
    return _parsable(pages, max_bytes).mapInArrow(_ropes_of, ROPE_SCHEMA)


def element_texts(ropes: DataFrame, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """page_id, url, pos, end_pos, parent_pos, depth, tag and the whole text of the elements of `page_ropes`.

    `wanted` chooses elements by their fields before any text is cut. A text is one slice of its page's bytes, made when
    its row is read; nothing is moved between tasks.
    """
    elements = F.col("elements") if wanted is None else F.filter("elements", wanted)
    rows = ropes.select("page_id", "url", F.col("text").alias("_bytes"), F.explode(elements).alias("e"))
    text = F.substr(F.col("_bytes"), F.col("e.start") + 1, F.col("e.size")).cast("string")
    return rows.select("page_id", "url", "e.pos", "e.end_pos", "e.parent_pos", "e.depth", "e.tag", text.alias("text"))


# --- fixed values: results depend on these exact texts -----------------------
CONTAINER_KEYS = ["@graph", "itemListElement", "mainEntity", "offers"]
PRICE_KEYS = ["price", "lowPrice", "highPrice"]
# --- end of fixed values -----------------------------------------------------

OBJECT_FIELDS = {
    "path": "array<int>", "text": "string", "entries": "array<struct<key:string,text:string>>", "price": "string",
}
_OBJECT = {
    "path": pa.list_(pa.int32()), "text": pa.string(),
    "entries": pa.list_(pa.struct([("key", pa.string()), ("text", pa.string())])), "price": pa.string(),
}


def readable(value) -> str:
    """Readable text of a JSON value: names stand for objects, lists are joined, blanks are empty."""
    if isinstance(value, dict):
        for key in ("name", "@id"):
            if key in value:
                return readable(value[key])
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return ", ".join(t for t in map(readable, value) if t)
    return " ".join(str(value or "").split())


def _found_objects(scripts: list[list[str]], fields: Sequence[str] = tuple(OBJECT_FIELDS)) -> list[dict]:
    """All JSON-LD objects in the order of the walk: a parent, then what its container keys hold, at any depth.

    Only the `fields` asked for are made.
    """
    out: list[dict] = []
    bodies = [body for body in map("".join, scripts) if body.strip()]
    for block, body in enumerate(bodies):
        try:
            data = json.loads(body)
        except (ValueError, RecursionError):
            continue
        tops = data if isinstance(data, list) else [data]
        todo = [((block, i), top) for i, top in reversed(list(enumerate(tops)))]
        while todo:
            path, value = todo.pop()
            if isinstance(value, list):
                todo += [((*path[:-1], path[-1] + i), item) for i, item in reversed(list(enumerate(value)))]
            elif isinstance(value, dict):
                out.append({"path": path, "value": value})
                todo += [((*path, rank, 0), value[key]) for rank, key in reversed(list(enumerate(CONTAINER_KEYS))) if key in value]
    for i in range(len(out) - 1, -1, -1) if "price" in fields else ():  # children come behind their parents
        value, inside = out[i]["value"], (*out[i]["path"], CONTAINER_KEYS.index("offers"))
        price = next((readable(value[k]) for k in PRICE_KEYS if k in value), None)
        if price is None and value.get("offers"):
            j = i + 1
            while j < len(out) and out[j]["path"][:len(out[i]["path"])] == out[i]["path"]:
                if out[j]["path"][:len(inside)] == inside and out[j]["price"] is not None:
                    price = out[j]["price"] or None
                    break
                j += 1
        out[i]["price"] = price
    made = {
        "path": lambda o: list(o["path"]),
        "text": lambda o: json.dumps(o["value"], ensure_ascii=False, separators=(",", ":")),
        "entries": lambda o: [{"key": k, "text": readable(v)} for k, v in o["value"].items()],
        "price": lambda o: o["price"],
    }
    return [{f: made[f](o) for f in fields} for o in out]


def _trees_of(columns: Sequence[str], fields: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([(f, _OBJECT[f]) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, objects = [], []
            for html in batch.column("html").to_pylist():
                if "text" in columns:
                    page = _Outline().outline(html or "")
                    texts.append(" ".join(piece for own in page.texts for piece in own))
                else:
                    page = _Scripts()
                    page.feed(html or "")
                objects.append(_found_objects(page.scripts, fields))
            made = {"text": lambda: pa.array(texts, pa.string()), "objects": lambda: pa.array(objects, kind)}
            yield pa.RecordBatch.from_arrays(
                [made[c]() if c in made else batch.column(c) for c in columns], names=list(columns)
            )

    return run


TREE_COLUMNS = {"page_id": "bigint", "url": "string", "html": "string", "text": "string"}


def with_page_tree(
    pages: DataFrame, max_bytes: int | None = None, columns: Sequence[str] = (*TREE_COLUMNS, "objects"),
    fields: Sequence[str] = tuple(OBJECT_FIELDS),
) -> DataFrame:
    """Pages plus their text in tree order and their JSON-LD objects, in one narrow pass that parses each page once.

    `objects` has the path, JSON text, readable fields and price of every object. A page without html has an empty
    text and no objects. A caller that reads few columns, or few `fields` of the objects, names them; without the text
    no tree is built.
    """
    objects = f"array<struct<{','.join(f'{f}:{OBJECT_FIELDS[f]}' for f in fields)}>>"
    schema = ", ".join(f"{c} {TREE_COLUMNS.get(c, objects)}" for c in columns)
    return _parsable(pages, max_bytes).mapInArrow(_trees_of(columns, fields), schema)

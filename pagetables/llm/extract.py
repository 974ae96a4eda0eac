"""Main text of web pages from flat text blocks.

A page is cut into blocks at block tags. A block's words and link density, those of its neighbours, and whether the
elements around it name themselves as article or as page furniture are the features; a decision tree that Spark ML
fits on a small labelled table keeps or drops each block.
"""

from __future__ import annotations

import html
import re
from itertools import chain

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

from pagetables.llm.common import map_batches, query, table
from pagetables.llm.mainpages import PAGES

#: Fixed values of HTML: elements that end a text block, and those whose content is no text of the page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html input label legend li main menu nav ol optgroup option "
    "p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("script style noscript template svg iframe object select textarea title head math canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that can hold a part of a page; others are not followed.
PARTS = frozenset("article aside body details dialog div dl figure fieldset footer form header main menu nav ol section table ul".split())
FURNITURE = frozenset("nav menu aside footer form dialog button label legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that name page furniture, and those that name the article.
OUTSIDE = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification "
    "pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup "
    "social sponsor sponsored subscribe subscription teaser toolbar tags widget widgets".split()
)
INSIDE = frozenset("article articlebody body content entry main post story text".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Marks of the labelled table; the innermost one holds.
MARK = re.compile(r"\s(keep|drop)$")
WORD = re.compile(r"[^\W_]+")


class Block:
    __slots__ = ("text", "words", "linked", "outside", "inside", "heading", "keep")

    def __init__(self, text, words, linked, outside, inside, heading, keep):
        self.text, self.words, self.linked = text, words, linked
        self.outside, self.inside, self.heading, self.keep = outside, inside, heading, keep

    @property
    def density(self) -> float:
        return min(1.0, self.linked / self.words) if self.words else 0.0


def named(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role name furniture, and whether they name an article; the latter holds for whole names first."""
    words: set[str] = set()
    for found in NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            words.add(name)
            words.update(WORD.findall(name))
    return not words.isdisjoint(OUTSIDE), not words.isdisjoint(INSIDE)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, white space inside each as one space."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool | None]] = []  # tag, outside, inside, mark
    parts: list[str] = []
    linked: list[str] = []
    state = {"a": 0, "heading": False, "keep": None}

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            links = " ".join(html.unescape("".join(linked)).split())
            outside = inside = keep = False
            for tag, furniture, article, marked in stack:
                keep = keep if marked is None else marked
                if furniture and not (tag in ("header", "footer") and inside):
                    outside = True
                inside = inside or article
            keep = keep if state["keep"] is None else state["keep"]
            out.append(Block(text, len(text.split()), len(links.split()), outside, inside, state["heading"], keep))
        linked.clear()

    def say(text: str) -> None:
        parts.append(text)
        if state["a"]:
            linked.append(text)

    at, end, lower = 0, len(page), None
    while at < end:
        open_at = page.find("<", at)
        if open_at < 0:
            say(page[at:])
            break
        if open_at > at:
            say(page[at:open_at])
        if page.startswith("<!--", open_at):
            close = page.find("-->", open_at + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), open_at):
            close = page.find(">", open_at)
            at = end if close < 0 else close + 1
            continue
        found = TAG.match(page, open_at) or LOOSE.match(page, open_at)
        if not found:
            if re.match(r"</?[a-zA-Z]", page[open_at:open_at + 3]):
                break  # a tag that the page's end cuts off
            say("<")
            at = open_at + 1
            continue
        at = found.end()
        closing, tag, attributes = found[1] == "/", found[2].lower(), found[3]
        if tag in HIDDEN and not closing and not attributes.endswith("/"):
            flush()
            if tag == "head":
                continue
            lower = lower if lower is not None else page.lower()
            close = lower.find(f"</{tag}", at)
            at = end if close < 0 and tag in ("script", "style", "title", "textarea") else at if close < 0 else close
            continue
        if tag == "a":
            state["a"] = 0 if closing else 1
            linked.append(" ")
        elif tag == "br":
            say(" ")
        if tag in BLOCKS:
            flush()
            state["a"] = 0
            state["heading"] = tag in HEADINGS and not closing
            mark = None if closing else MARK.search(attributes)
            state["keep"] = mark and mark[1] == "keep"
            if tag in PARTS or tag in FURNITURE:
                if closing:
                    if any(s[0] == tag for s in stack):
                        while stack.pop()[0] != tag:
                            pass
                elif tag not in VOID:
                    furniture, article = named(attributes) if tag not in ("html", "body") else (False, False)
                    article = article or tag in ("article", "main")
                    furniture = tag in FURNITURE or tag == "header" or (furniture and not (article and tag != "article"))
                    stack.append((tag, furniture, article and not (furniture and tag != "article"), state["keep"]))
    flush()
    return out


def features(page: list[Block]) -> list[list[float]]:
    """Words and link density of each block and its neighbours, and what the elements around it say."""
    has_inside = float(sum(b.words for b in page if b.inside and not b.outside) > 0)
    out = []
    for i, block in enumerate(page):
        near = [page[i - 1] if i else None, page[i + 1] if i + 1 < len(page) else None]
        sides = list(chain.from_iterable((float(b.words), b.density) if b else (0.0, 0.0) for b in near))
        out.append([float(block.words), block.density, *sides, float(block.outside), float(block.inside), float(block.heading), has_inside])
    return out


def learn(spark: SparkSession, pages=tuple(PAGES)) -> list:
    """A decision tree as nested lists [feature, limit, low, high] with 0.0 or 1.0 at the ends."""
    rows = []
    for page in pages:
        own = blocks(page)
        rows += [(float(b.keep), Vectors.dense(f)) for b, f in zip(own, features(own))]
    data = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=6, minInstancesPerNode=2, maxBins=64, seed=1).fit(data)
    return parsed(model.toDebugString.splitlines()[1:])


def parsed(lines: list[str]):
    """The printed tree as nested lists."""
    def walk(at: int):
        line = lines[at].strip()
        leaf = re.match(r"Predict: ([0-9.]+)", line)
        if leaf:
            return float(leaf[1]), at + 1
        feature, limit = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", line).groups()
        low, at = walk(at + 1)
        high, at = walk(at + 1)  # behind the Else line
        return [int(feature), float(limit), low, high], at

    return walk(0)[0]


def chosen(tree, values: list[float]) -> bool:
    while isinstance(tree, list):
        tree = tree[2] if values[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(tree, page: str) -> str:
    own = blocks(page)
    return "\n".join(b.text for b, f in zip(own, features(own)) if chosen(tree, f))


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages` (page_id, url, html).

    A null html is empty; a page without a kept block has an empty text. Repeated rows stay; other columns are
    ignored; an empty table gives no rows.
    """
    tree = tree if tree is not None else learn(pages.sparkSession)

    def fn(columns):
        texts = [main_text(tree, h or "") for h in columns["html"]]
        yield {"page_id": columns["page_id"], "url": columns["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(pages.select("page_id", "url", "html"), fn, f"page_id {kind}, url string, text string, n_chars long")


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

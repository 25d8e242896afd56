"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root. For each path the lengths of its
texts and their punctuation are aggregated; both ratios are smoothed along the page and
fused, and paths above a threshold select the content nodes. The smallest part of the
page that holds all of them is the article, with the headings and blocks right beside it.

Ratios tell menus, adverts and footers from an article; they cannot tell what readers or
a site's operator wrote in whole sentences. So parts that are marked by their tag, role or
name as comments, notices, forms or asides select nothing, and all marked parts inside the
article are cut out of it. On pages that name all their parts these marks decide, not the ratios.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gnomon.llm.common import table

_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_TOKEN = re.compile(
    r"[^<]++|<(?P<close>/?)(?!(?:script|style|noscript|template|textarea|svg|iframe|object|select|title)\b)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>" + _INSIDE + r")>"
    r"|<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object|select|title)\b" + _INSIDE + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*>|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")

# Tags that take part in no path: they mark words inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Parts of a page that are never its article.
OUTSIDE = frozenset("nav aside footer form button menu dialog head fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li td tr dd dt pre blockquote".split())  # too small to be an article
_OUTSIDE_NAME = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|side-?bar|widget|menu|nav\w*|breadcrumbs?|pagination|pager"
    r"|footer|masthead|site-?header|page-?header|top-?bar|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|comments?|commentlist|disqus|replies|respond|reactions?|tags|hidden|skip-?link)(?:$|[-_\s])",
    re.I,
)
# Of these parts, those that hold whole sentences: by their tags, names and roles.
_TOLD = frozenset("aside form dialog fieldset".split())
_TOLD_NAME = re.compile(r"(?:^|[-_\s])(?:cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|side-?bar|widget|related|recommend\w*|newsletter|subscribe|signup|login|comments?|commentlist|disqus|replies|respond|reactions?|hidden)(?:$|[-_\s])", re.I)
_OUTSIDE_ROLE = re.compile(r"^(?:navigation|banner|complementary|contentinfo|search|dialog|alert|alertdialog|menu|menubar|toolbar|form)$", re.I)
# A start tag that ends these open ones.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
for _t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split():
    CLOSES[_t] = {"p"}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Node:
    """A block's text, the element it lies in, and how much of it is links."""

    __slots__ = ("at", "text", "linked")

    def __init__(self, at: int, text: str, linked: int):
        self.at, self.text, self.linked = at, text, linked


class Page:
    """A page's elements in order of their start tags, and its blocks of text. Takes time in proportion to the page, however deep.

    Of each element: ``parent``, ``tag``, ``path`` (a number for each path of tags), ``last`` (the last
    element inside it), whether it lies ``outside`` the article by its mark and is one that holds
    sentences (``told``), and the outermost leaf, main and article around it (or itself; -1 if none).
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.outside, self.told, self.heading = [-1], [""], [0], [False], [False], [False]
        self.leaf, self.main, self.article = [-1], [-1], [-1]
        self.nodes: list[Node] = []
        self._read(page)
        self.last = list(range(len(self.tag)))
        for e in range(len(self.tag) - 1, 0, -1):
            up = self.parent[e]
            self.last[up] = max(self.last[up], self.last[e])

    def _open(self, up: int, tag: str, attrs: str, paths: dict) -> int:
        e = len(self.tag)
        outside, told = _marks(tag, attrs, self.main[up] >= 0 or self.article[up] >= 0)
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(paths.setdefault((self.path[up], tag), len(paths) + 1))
        self.outside.append(self.outside[up] or outside)
        self.told.append(self.told[up] or told)
        self.heading.append(self.heading[up] or tag in HEADINGS)
        for outer, own in ((self.leaf, tag in LEAVES), (self.main, tag == "main"), (self.article, tag == "article")):
            outer.append(outer[up] if outer[up] >= 0 else e if own else -1)
        return e

    def _read(self, page: str) -> None:
        stack, count = [0], Counter()  # open elements; how many of each tag
        paths: dict[tuple[int, str], int] = {}
        text: list[str] = []
        links: list[str] = []
        in_link = False

        def flush() -> None:
            if text:
                whole = " ".join(html.unescape("".join(text)).split())
                if whole:
                    linked = len(" ".join(html.unescape("".join(links)).split())) if links else 0
                    self.nodes.append(Node(stack[-1], whole, min(linked, len(whole))))
                text.clear()
            links.clear()

        def close(k: int) -> None:
            for e in stack[k:]:
                count[self.tag[e]] -= 1
            del stack[k:]

        for m in _TOKEN.finditer(page):
            tag = m["tag"]
            if tag is None:
                got = m[0]
                if got[0] != "<":
                    text.append(got)
                    if in_link:
                        links.append(got)
                elif got == "<":
                    text.append("&lt;")
                elif got[:9].upper() == "<![CDATA[":
                    text.append(html.escape(got[9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if tag == "br":
                text.append("\n")
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = not m["close"]
                continue
            flush()
            if m["close"]:
                if count[tag]:
                    k = len(stack) - 1
                    while self.tag[stack[k]] != tag:
                        k -= 1
                    close(k)
                in_link = False
                continue
            ends = CLOSES.get(tag)
            if ends and any(count[t] for t in ends):
                scope, k, low = _SCOPE.get(tag, ()), len(stack) - 1, len(stack)
                over = tag in ("li", "dt", "dd", "tr", "td", "th")
                while k > 0 and self.tag[stack[k]] not in scope and (over or self.tag[stack[k]] in ends):
                    if self.tag[stack[k]] in ends:
                        low = k
                    k -= 1
                close(low)
            if tag in VOID or m["attrs"].endswith("/") and tag not in ("div", "p", "section", "article"):
                continue
            count[tag] += 1
            stack.append(self._open(stack[-1], tag, m["attrs"], paths))
        flush()

    def shared(self, a: int, b: int) -> int:
        """The deepest element around both and all between, above paragraphs, list items, cells and headings."""
        a, b = min(a, b), max(a, b)
        while self.last[a] < b:
            a = self.parent[a]
        return self.parent[self.leaf[a]] if self.leaf[a] >= 0 else a


def _marks(tag: str, attrs: str, within: bool) -> tuple[bool, bool]:
    """Whether an element is marked as no part of an article, and whether as one that holds sentences."""
    if tag in OUTSIDE or (tag == "header" and not within):
        return True, tag in _TOLD
    if not attrs or tag in ("html", "body"):
        return False, False
    outside = told = False
    for name, value in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and _OUTSIDE_NAME.search(value):
            outside, told = True, told or bool(_TOLD_NAME.search(value))
        elif name == "role" and _OUTSIDE_ROLE.match(value):
            outside, told = True, told or value.lower() in ("complementary", "dialog", "alert", "alertdialog", "form")
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            outside = told = True
    return outside, told


def fused_ratios(paths: list[int], length: list[int], marks: list[int], sigma: float = 1.0) -> np.ndarray:
    """Each node's ratio: text length and punctuation of its path for each node of the path, smoothed along the page and fused.

    Smoothing lends a short block between long ones their ratio; a path's ratio is the mean of its
    nodes' smoothed ones, but never more than its own.
    """
    _, path = np.unique(paths, return_inverse=True)
    n = np.bincount(path)
    per = [np.bincount(path, np.asarray(x, float))[path] / n[path] for x in (length, marks)]
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(x, kernel, "full")[reach : reach + len(x)] / np.convolve(np.ones(len(x)), kernel, "full")[reach : reach + len(x)]

    smoothed = smooth(per[0]) * (1 + smooth(per[1]))
    return np.minimum(np.bincount(path, smoothed)[path] / n[path], per[0] * (1 + per[1]))


def content(page: Page) -> np.ndarray:
    """Places of the nodes whose path's ratio is above the threshold: the standard deviation of all nodes' ratios."""
    told = [page.told[n.at] for n in page.nodes]
    at = np.flatnonzero(~np.array(told, bool))
    if not len(at):
        return at
    some = [page.nodes[k] for k in at]
    own = np.array([max(0, len(n.text) - n.linked) for n in some])
    ratio = fused_ratios([page.path[n.at] for n in some], own.tolist(), [0 if n.linked else len(_PUNCTUATION.findall(n.text)) for n in some])
    chosen = (ratio >= min(ratio.std(), ratio.max())) & (own > 0)
    return at[chosen if chosen.any() else own > 0]


def extract(html_text: str | None) -> str:
    """The main text of one page: blocks in page order joined by one space; empty if there is none.

    The article is the lowest element that holds all content, lifted to a main or article around it.
    Without such a tag the blocks beside it are taken as well. All text of the article is, unless it is
    marked as lying outside; blocks that are not of the article only if they are headings or less than 60 % links.
    """
    page = Page(html_text or "")
    at = content(page)
    if not len(at):
        return ""
    places = [page.nodes[k].at for k in at]
    base = wide = page.shared(min(places), max(places))
    top = lambda e: e == 0 or page.tag[e] in ("body", "html")
    anchor = page.main[base] if page.main[base] >= 0 else page.article[base]
    if anchor >= 0:
        base = wide = anchor
    else:  # past the elements around it that hold nothing else
        inside = np.sort([n.at for n in page.nodes if not page.outside[n.at]])
        held = lambda e: np.searchsorted(inside, page.last[e], "right") - np.searchsorted(inside, e)
        n = held(base)
        while not top(wide) and held(wide) == n:
            wide = page.parent[wide]
    page_wide = top(base)  # then the article is what lies between its content, and what is marked as such
    out = []
    for k, n in enumerate(page.nodes):
        if not wide <= n.at <= page.last[wide] or page.outside[n.at]:
            continue
        mine = at[0] <= k <= at[-1] or page.main[n.at] >= 0 or page.article[n.at] >= 0 if page_wide else base <= n.at <= page.last[base]
        if mine or page.heading[n.at] or n.linked < 0.6 * len(n.text):
            out.append(n.text)
    return " ".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars (code points).

    A null or empty html, and a page without content, has an empty text. Nothing of a page's content
    is cut off. Repeated and null page_ids keep a row each; further columns are ignored; an empty
    table gives no rows.
    """
    page_id = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select("page_id", F.col("url").cast("string").alias("url"), "html" if isinstance(pages.schema["html"].dataType, StringType) else F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, f"page_id {page_id}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

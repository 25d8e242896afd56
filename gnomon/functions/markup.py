"""Pages read by a parser, as a table function: links with their text, pictures, headings, title and visible text.

One pass over the tags keeps what is open, so that elements nested in one of their own name, ends
that are missing, comments, quoted ``>`` and character references are read as browsers read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "kind string, nth int, ref string, text string"


def reader():
    """The table function: html -> rows (kind, nth, ref, text).

    ``link``: href and visible text; ``image``: src and alt, id and class; ``heading``: its level and text;
    ``title`` and ``text``: the page's. Whitespace in texts is one space; kinds are numbered from 1 in the page's order.
    It is defined here so that workers need no module of this package.
    """
    import re

    token = re.compile(r"<!--(.*?)(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z|(?=[\"']))", re.S)
    attribute = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
    raw = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
    hidden = frozenset(("script", "style", "noscript", "template", "svg", "head", "iframe", "noembed", "noframes", "xmp"))
    breaks = frozenset("address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
    heads = ("h1", "h2", "h3", "h4", "h5", "h6")

    class ReadPage:
        def eval(self, html: str):
            from html import unescape

            if not html:
                return
            squeeze = lambda parts: " ".join(unescape("".join(parts)).split())
            links, images, headings, visible, title = [], [], [], [], None
            link = heading = None  # what is open: [reference, parts of its text]
            depth: dict[str, int] = {}  # of hidden elements
            at, n = 0, len(html)

            def add(text: str) -> None:
                if link is not None:
                    link[1].append(text)
                if heading is not None:
                    heading[1].append(text)
                if not depth:
                    visible.append(text)

            while at < n:
                m = token.search(html, at)
                if m is None:
                    add(html[at:])
                    break
                if m.start() > at:
                    add(html[at : m.start()])
                at = max(m.end(), at + 1)
                name = m[3]
                if name is None:
                    continue
                name, closes = name.lower(), m[2] == "/"
                if closes:
                    if name == "a":
                        link = None
                    elif heading is not None and name in heads:
                        heading = None
                    elif name in hidden and depth.get(name):
                        depth[name] -= 1
                        if not depth[name]:
                            del depth[name]
                    if name in breaks:
                        add(" ")
                    continue
                empty = m[4].endswith("/")
                if name in breaks:
                    add(" ")
                if name == "body":
                    depth.pop("head", None)  # an end of head may be left out
                if name in ("a", "img"):
                    found: dict[str, str] = {}
                    for a in attribute.finditer(m[4]):
                        value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] if a[4] is not None else ""
                        found.setdefault(a[1].lower(), unescape(value))
                    if name == "img":
                        images.append((found.get("src", "").strip(), " ".join(" ".join(found.get(k, "") for k in ("alt", "id", "class")).split())))
                    else:
                        link = None  # a link within a link ends it
                        if "href" in found:
                            link = [found["href"].strip(), []]
                            links.append(link)
                elif name in heads:
                    heading = [name[1], []]
                    headings.append(heading)
                elif name in raw:
                    end = raw[name].search(html, at)
                    stop = end.start() if end else n
                    if name == "title" and title is None and "svg" not in depth:
                        title = squeeze([html[at:stop]])
                    elif name == "textarea":
                        add(html[at:stop])
                    close = html.find(">", stop)
                    at = n if close < 0 else close + 1
                elif name in hidden and not (empty and name == "svg"):
                    depth[name] = depth.get(name, 0) + 1
            for kind, rows in (("link", links), ("heading", headings)):
                for k, (ref, parts) in enumerate(rows):
                    yield kind, k + 1, ref, squeeze(parts)
            for k, (ref, text) in enumerate(images):
                yield "image", k + 1, ref, text
            if title is not None:
                yield "title", 1, None, title
            yield "text", 1, None, squeeze(visible)

    return F.udtf(ReadPage, returnType=PARTS, useArrow=True)


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, kind, nth, ref, text of every page (page_id, url, html); pages without text have no rows."""
    spark = pages.sparkSession
    spark.udtf.register("read_page", reader())
    pages.select("page_id", "url", "html").createOrReplaceTempView("parsed_source")
    return spark.sql("SELECT s.page_id, s.url, p.* FROM parsed_source s, LATERAL read_page(s.html) p")


def links(pages: DataFrame, most: int = 200) -> DataFrame:
    """page_id, href, text, nth: of each page its links within the site that have a text, each address once, in order, ``most`` at most."""
    from gnomon.plans.dialect import spark_sql
    from gnomon.plans.pages import ORIGIN, absolute

    parts(pages).createOrReplaceTempView("page_part")
    return pages.sparkSession.sql(
        spark_sql(rf"""WITH raw AS (SELECT page_id, url, nth AS k, text, {absolute('ref', 'url')} AS href FROM page_part WHERE kind = 'link' AND ref <> '' AND NOT @matches(ref, '^(?:#|mailto:|tel:|javascript:)')),
  once AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY k) AS again FROM raw WHERE {ORIGIN.format(u='href')} = {ORIGIN.format(u=absolute("''", 'url'))})
  SELECT page_id, href, text, nth FROM (SELECT page_id, href, text, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS BIGINT) AS nth FROM once WHERE again = 1 AND text <> '') WHERE nth <= {int(most)}""")
    )


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gnomon.sources.model import register, relation

    register(spark, sf_dir)
    return relation(spark, "site")


QUERIES = {
    "parsed_links": lambda spark, sf_dir: links(_site(spark, sf_dir)),
    "parsed_pages": lambda spark, sf_dir: parts(_site(spark, sf_dir)).groupBy("page_id").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("link", "image", "heading")),
        F.max(F.when(F.col("kind") == "title", F.substring("text", 1, 200))).alias("title"),
        F.max(F.when(F.col("kind") == "text", F.sha2("text", 256))).alias("text_sha256"),
    ),
}

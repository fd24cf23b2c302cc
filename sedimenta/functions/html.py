"""HTML to text, with the standard library's parser inside an Arrow-batched function."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .text import slug_title, strip

# Places of the main text in order of preference, what is dropped inside it, places of the trail, endings of files.
ROOTS = ["div.td-content", "article.td-article", "div.document", "div[role=main]", "main", "article", "div.body", "div.rst-content"]
DROPPED = ["nav", "div.sidebar", "div.sphinxsidebar", "div.related", "div.footer", "div.header", "script", "style", "a.headerlink", "div.toctree-wrapper", "div.td-toc", "div.page-meta", "div.taxonomy-terms", "a.td-heading-self-link", "div.td-max-width-on-larger-screens.td-page-meta"]
TRAILS = ["nav.td-breadcrumbs", "ol.breadcrumb", "ul.wy-breadcrumbs", "div.related", "nav.breadcrumb"]
SKIPPED_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".pdf", ".zip", ".tar", ".gz", ".css", ".js", ".xml", ".json", ".yaml", ".yml")
INLINE_TAGS = ("strong", "b", "em", "i", "a", "span", "code", "mark", "abbr", "cite", "dfn", "kbd", "samp", "var")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_BLOCK = {"p", "div", "section", "article", "ul", "ol", "table", "blockquote", "main", "body", "header", "footer", "aside", "nav", "dl"}
#: What stands before and after the text of a tag; tags not named add nothing.
_AROUND = {"p": ("\n\n", ""), "div": ("\n", ""), "li": ("\n- ", ""), "table": ("\n", "\n"), "tr": ("\n", ""), "td": (" | ", ""), "th": (" | ", ""), "dl": ("\n", ""), "dt": ("\n**", "**: "), "dd": ("", "\n")}
_AROUND |= dict.fromkeys(INLINE_TAGS, (" ", " "))


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.items = tag, attrs or {}, []

    def fits(self, selector: str) -> bool:
        tag, classes, key, value = re.match(r"^(\w+)((?:\.[\w-]+)*)(?:\[(\w+)=(\w+)\])?$", selector).groups()
        own = self.attrs.get("class", "").split()
        return self.tag == tag and all(c in own for c in classes.split(".")[1:]) and (not key or self.attrs.get(key) == value)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [x for x in reversed(node.items) if isinstance(x, Node)]

    def text(self, joiner: str = "") -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.items)
        return joiner.join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        shut = _CLOSES.get(tag, set()) | ({"p"} if tag in _BLOCK else set())
        while len(self.open) > 1 and self.open[-1].tag in shut:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].items.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].items.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _prune(node: Node) -> None:
    for x in list(node.walk()):
        x.items = [y for y in x.items if isinstance(y, str) or not any(y.fits(s) for s in DROPPED)]


def _render(root: Node) -> str:
    """Text with marks for headings, code, items and cells; an explicit stack keeps deep trees safe."""
    out: list[str] = []
    stack: list[Node | str | tuple[str]] = list(reversed(root.items))
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, str):
            out.append(re.sub(r"\s+", " ", x) if x.strip() else "")
        elif re.fullmatch(r"h[1-4]", x.tag):
            out.append(f"\n\n{'#' * int(x.tag[1])} {_title(x)}\n")
        elif x.tag == "pre":
            out.append(f"\n```\n{x.text().strip()}\n```\n")
        elif x.tag == "code":
            out.append(f" `{_joined(x)}` ")
        elif x.tag == "br":
            out.append("\n")
        else:
            before, after = _AROUND.get(x.tag, ("", ""))
            stack.append((after,))
            stack += reversed(x.items)
            stack.append((before,))
    text = re.sub(r"\n{3,}", "\n\n", "".join(out))
    text = re.sub(r"[ \t]+", " ", text)
    return re.sub(r" ([.,;:!?)])", r"\1", text).strip()


def _texts(node: Node) -> list[str]:
    """The stripped texts inside a node that aren't blank."""
    return [t for n in node.walk() for x in n.items if isinstance(x, str) and (t := x.strip())] if all(isinstance(x, str) for x in node.items) else [t for x in node.text("\0").split("\0") if (t := x.strip())]


def _title(node: Node) -> str:
    return " ".join(_texts(node))


def _joined(node: Node) -> str:
    return "".join(_texts(node))


def extract(html: str | None) -> dict[str, object]:
    """content, code_blocks, headings and breadcrumb of a page."""
    tree = parse(html)
    nodes = list(tree.walk())
    root = next((n for s in ROOTS for n in nodes if n.fits(s)), None) or next((n for n in nodes if n.tag == "body"), tree)
    _prune(root)
    left = list(tree.walk())
    crumbs: list[str] = []
    for s in TRAILS:
        items = [n for place in left if place.fits(s) for n in place.walk() if n.tag == "li"]
        if items:
            crumbs = [t for n in dict.fromkeys(items) if (t := _joined(n))]
            break
    inside = list(root.walk())
    return {
        "content": _render(root),
        "code_blocks": [n.text().strip() for n in inside if n.tag == "pre" and n.text().strip()],
        "headings": [t for n in inside if re.fullmatch(r"h[1-4]", n.tag) and (t := _joined(n))],
        "breadcrumb": crumbs,
    }


def clean_url(href: str, base: str) -> str:
    """Absolute, without fragment, path normalised, closing slash unless the last segment has a dot; the query stays."""
    parts = urlsplit(urldefrag(urljoin(base, href))[0])
    path = posixpath.normpath(parts.path) if parts.path else "/"
    path = re.sub(r"^//+", "/", path)
    if not path.endswith("/") and "." not in path.rsplit("/", 1)[-1]:
        path += "/"
    return urlunsplit((parts.scheme, parts.netloc, path, parts.query, ""))


def is_document(url: str, base: str) -> bool:
    """Same host as base, path beginning with the base path (no boundary is asked for), no ending of a non-document."""
    own, of = urlsplit(url), urlsplit(base)
    path = own.path.rstrip("/")
    return own.netloc == of.netloc and path.startswith(of.path.rstrip("/")) and not path.endswith(SKIPPED_ENDINGS)


def page_links(html: str | None, page: str, base: str | None = None) -> list[str]:
    """Distinct cleaned links of a page, in alphabetical order; with ``base`` only those to documents of that section."""
    hrefs = [n.attrs.get("href", "") for n in parse(html).walk() if n.tag == "a"]
    kept = [h for h in hrefs if h and not h.startswith(("#", "javascript:", "mailto:"))]
    out = set()
    for h in kept:
        try:
            out.add(clean_url(h, page))
        except ValueError:
            continue
    return sorted(u for u in out if base is None or is_document(u, base))


def is_doc_link(url: Column, base: Column) -> Column:
    """Same host, path beginning with the base path (no boundary is asked for), and no ending of a non-document."""
    path = lambda c: F.coalesce(F.parse_url(c, F.lit("PATH")), F.lit(""))
    bare = F.regexp_replace(path(url), "/+$", "")
    bad = F.lit(False)
    for e in SKIPPED_ENDINGS:
        bad = bad | bare.endswith(e)
    same = F.parse_url(url, F.lit("HOST")) == F.parse_url(base, F.lit("HOST"))
    return F.coalesce(same & path(url).startswith(F.regexp_replace(path(base), "/+$", "")) & ~bad, F.lit(False))


PAGE = "url string, content string, code_blocks array<string>, headings array<string>, breadcrumb array<string>, links array<string>"


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", base: str | None = None) -> DataFrame:
    """pages(url, html[, base]) -> url, content, code_blocks, headings, breadcrumb, links; a null page gives empty values.

    With ``base``, a column of section urls, links to anything but documents of
    the section are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"url": u, **extract(h), "links": page_links(h, u or "", b)} for u, h, b in zip(pdf["url"], pdf["html"], pdf["base"])]
            yield pd.DataFrame(rows, columns=["url", "content", "code_blocks", "headings", "breadcrumb", "links"])

    section = F.col(base) if base else F.lit(None).cast("string")
    return pages.select(F.col(url).alias("url"), F.col(html).alias("html"), section.alias("base")).mapInPandas(run, PAGE)


def scraped_pages(extracted: DataFrame, least: int = 50) -> DataFrame:
    """Extracted pages with enough text, with title (first heading, else from the url) and url_hash."""
    kept = extracted.filter(F.length(strip(F.col("content"))) >= least)
    return kept.withColumn("title", F.coalesce(F.get("headings", F.lit(0)), slug_title(F.col("url")))).withColumn("url_hash", F.substring(F.sha2("url", 256), 1, 16))

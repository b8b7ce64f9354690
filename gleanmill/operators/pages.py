"""Pages to articles: triage, extraction, markdown, and blocks of text and images.

Triage, blocks and clips are native. Reading HTML needs a parser, so extraction is one Arrow pass over the
rows that triage lets through; it is narrow, each page on its own.
"""

from __future__ import annotations

import textwrap
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanmill.functions import constants as K
from gleanmill.functions import text as tx

SHOWN = 500
NO_ARTICLE = K.EMPTY_PAGE[1]


@F.pandas_udf(T.StringType())
def _shorten(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else textwrap.shorten(t, width=n, placeholder="...") for t, n in zip(texts, sizes, strict=True)])


def shortened(text: Column, size: int | None = SHOWN) -> Column:
    """Texts above ``size`` characters: whitespace collapsed, cut at a word boundary; whole if ``size`` is None."""
    if size is None:
        return text
    long = F.length(text) > size
    return F.when(long, _shorten(F.when(long, text), F.lit(size))).otherwise(text)


def triage_pages(pages: DataFrame, size: int | None = SHOWN) -> DataFrame:
    """Add ``status`` (pdf, empty, not_html or html) and, for all but html, a fallback title and content.

    The content of a page that is not HTML shows its raw text up to ``size`` characters, or whole.
    """
    html = F.coalesce("html", F.lit(""))
    status = (
        F.when(tx.is_pdf_url(F.col("url")), "pdf")
        .when(tx.strip(html) == "", "empty")
        .when(~tx.is_html(html), "not_html")
        .otherwise("html")
    )
    title, body = K.NON_HTML_PAGE
    raw = F.when(F.col("status") == "not_html", html)
    return (
        pages.withColumn("status", status)
        .withColumn("title", F.when(F.col("status") == "empty", K.EMPTY_PAGE[0]).when(F.col("status") == "not_html", title))
        .withColumn(
            "content",
            F.when(F.col("status") == "empty", K.EMPTY_PAGE[1]).when(
                F.col("status") == "not_html", F.concat(F.lit(body), shortened(raw, size), F.lit("</p>"))
            ),
        )
    )


DROPPED = {"script", "style", "nav", "header", "footer", "aside", "noscript", "form", "iframe", "template", "svg"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr"}
CLOSES_PARAGRAPH = {"p", "div", "ul", "ol", "table", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "pre",
                    "blockquote", "hr"}
AD_CLASSES = {"ad", "ads", "advert", "sidebar", "menu", "comments", "cookie"}
KEPT_ATTRIBUTES = {"href", "src", "alt"}


class _Tree(HTMLParser):
    """Elements as [tag, attributes, children]; unclosed paragraphs and list items end where they must."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["root", {}, []]
        self.open = [self.root]
        self.title: list[str] = []

    def handle_starttag(self, tag, attrs):
        if (tag in CLOSES_PARAGRAPH and self.open[-1][0] == "p") or (tag == "li" and self.open[-1][0] == "li"):
            self.open.pop()
        node = [tag, {k: v or "" for k, v in attrs}, []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                break

    def handle_data(self, data):
        if self.open[-1][0] == "title":
            self.title.append(data)
        self.open[-1][2].append(data)


def _dropped(node) -> bool:
    marks = set(f"{node[1].get('class', '')} {node[1].get('id', '')}".lower().split())
    return node[0] in DROPPED or node[0] in ("head", "title") or bool(marks & AD_CLASSES)


def _prune(root) -> None:
    """Remove what is not content: scripts, navigation, advertisements."""
    todo = [root]
    while todo:
        node = todo.pop()
        node[2] = [c for c in node[2] if isinstance(c, str) or not _dropped(c)]
        todo += [c for c in node[2] if isinstance(c, list)]


def _walk(node):
    """The node and all below it, texts too, in document order. Pages may nest deeper than Python calls."""
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        if isinstance(node, list):
            todo += reversed(node[2])


def _text(node) -> str:
    return "".join(n for n in _walk(node) if isinstance(n, str))


def _nodes(node):
    return (n for n in _walk(node) if isinstance(n, list))


def _main_node(root):
    """The article or main element with most text, else the block whose paragraphs hold most text."""
    named = [n for n in _nodes(root) if n[0] in ("article", "main")]
    if named:
        return max(named, key=lambda n: len(_text(n)))
    blocks = [n for n in _nodes(root) if n[0] in ("div", "section", "td", "body", "root")]
    return max(blocks, key=lambda n: sum(len(_text(c)) for c in n[2] if isinstance(c, list) and c[0] == "p"), default=root)


def _html(node) -> str:
    out, todo = [], [node]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):  # the end of an element
            out.append(node[0])
        elif isinstance(node, str):
            out.append(escape(node, quote=False))
        else:
            tag, attrs, children = node
            kept = "".join(f' {k}="{escape(v)}"' for k, v in attrs.items() if k in KEPT_ATTRIBUTES)
            out.append(f"<{tag}{kept}>")
            if tag not in VOID:
                todo.append((f"</{tag}>",))
                todo += reversed(children)
    return "".join(out)


INLINE = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`"}


def _plain(text: str) -> str:
    return " ".join([""] * text[:1].isspace() + text.split() + [""] * text[-1:].isspace()) if text.strip() else " "


def _written(node, inner: str, kind: str | None, depth: int) -> str:
    """Markdown of one element around its ``inner``; it stands in ``depth`` lists, the innermost of that kind."""
    tag, attrs, _ = node
    if tag == "pre":
        return "\n\n```\n" + _text(node).strip("\n") + "\n```\n\n"
    bare = inner.strip()
    if tag in INLINE:
        return f"{INLINE[tag]}{bare}{INLINE[tag]}" if bare else ""
    if tag == "a":
        return f"[{bare}]({attrs['href']})" if attrs.get("href") and bare else inner
    if tag == "img":
        return f"![{attrs.get('alt', '')}]({attrs.get('src', '')})"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
        return f"\n\n{'#' * int(tag[1])} {bare}\n\n"
    if tag == "li":
        mark = "1." if kind == "ol" else "*"
        return "\n" + "  " * (depth - 1) + f"{mark} {bare}"
    if tag == "blockquote":
        return "\n\n" + "\n".join(f"> {line}" for line in bare.split("\n")) + "\n\n"
    if tag in ("ul", "ol") and depth:
        return inner
    if tag in CLOSES_PARAGRAPH or tag in ("tr", "body"):
        return f"\n\n{inner.strip(' ')}\n\n"
    return inner


def _markdown(node) -> str:
    """Markdown of one element or text. Each open element waits with its children to come and the parts it has."""
    opened = [(None, None, 0, iter([node]), [])]
    while True:
        element, kind, depth, children, parts = opened[-1]
        child = next(children, None)
        if child is None:
            opened.pop()
            if not opened:
                return "".join(parts)
            _, kind, depth, _, around = opened[-1]
            around.append(_written(element, "".join(parts), kind, depth))
        elif isinstance(child, str):
            parts.append(_plain(child))
        else:
            inner = (child[0], depth + 1) if child[0] in ("ul", "ol") else (kind, depth)
            opened.append((child, *inner, iter(() if child[0] == "pre" else child[2]), []))


def _tidy(markdown: str) -> str:
    """At most one empty line in a row, no blanks at line starts outside lists."""
    out: list[str] = []
    for line in markdown.split("\n"):
        if line.strip() or (out and out[-1]):
            out.append(line.rstrip(" ") + ("  " if line.endswith("  ") and line.strip() else "") if line.strip() else "")
    return "\n".join(out).strip("\n")


def article_of(html: str) -> tuple[str, str, str]:
    """Title, content HTML and content markdown of one page."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    title = " ".join("".join(tree.title).split()) or "Untitled"
    _prune(tree.root)
    node = _main_node(tree.root)
    if not _text(node).strip() and not any(n[0] == "img" for n in _nodes(node)):
        return title, NO_ARTICLE, "No content could be extracted from this page"
    return title, "".join(map(_html, node[2])), _tidy("".join(map(_markdown, node[2])))


ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "content", "markdown", "error")])


# Pages read before their articles go back to Spark; an Arrow batch may hold thousands.
PAGES_AT_ONCE = 32
ARTICLE_ROWS = pa.struct([(n, pa.string()) for n in ARTICLE.names])


@F.arrow_udf(ARTICLE)
def _read_articles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Articles in the order of the pages. Python holds the pages, trees and articles of one slice, not of a batch."""
    for batch in batches:
        for start in range(0, len(batch), PAGES_AT_ONCE):
            yield _articles(batch.slice(start, PAGES_AT_ONCE))


def _articles(pages: pa.Array) -> pa.Array:
    rows = []
    for html in pages.to_pylist():
        try:
            row = (None,) * 4 if html is None else (*article_of(html), None)
        except Exception as error:  # a page that cannot be read is a result, not a failed job
            row = (None, None, None, repr(error))
        rows.append(dict(zip(ARTICLE.names, row, strict=True)))
    return pa.array(rows, ARTICLE_ROWS)


def extract_articles(pages: DataFrame, size: int | None = None) -> DataFrame:
    """``page_id, url, status, title, content, markdown``: one article per page, fallbacks included.

    A page that is not HTML or cannot be read keeps its raw text, whole unless ``size`` bounds it.
    """
    triaged = triage_pages(pages, size)
    html = F.col("status") == "html"
    read = triaged.withColumn("_a", _read_articles(F.when(html, F.col("html"))))
    failed = html & F.col("_a.error").isNotNull()
    title, body = K.FAILED_PAGE
    raw = F.when(failed, F.col("html"))
    content = F.when(failed, F.concat(F.lit(body), shortened(raw, size), F.lit("</p>"))).otherwise(
        F.coalesce("_a.content", "content")
    )
    fallback_text = F.regexp_replace("content", "^<p>|</p>$", "")
    return read.select(
        "page_id",
        "url",
        F.when(failed, "failed").otherwise(F.col("status")).alias("status"),
        F.when(failed, title).otherwise(F.coalesce("_a.title", "title")).alias("title"),
        content.alias("content"),
        F.coalesce("_a.markdown", F.lit(None)).alias("_markdown"),
    ).select(
        "page_id", "url", "status", "title", "content", F.coalesce("_markdown", fallback_text).alias("markdown")
    )


def articles_to_markdown(articles: DataFrame, with_title: bool = True) -> DataFrame:
    """Replace ``markdown`` by the full text of the article, under its title."""
    empty = tx.strip(F.coalesce("content", F.lit(""))) == ""
    body = F.when(empty, "*No content available*\n").otherwise(F.col("markdown"))
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n")) if with_title else F.lit("")
    return articles.filter("status <> 'pdf'").withColumn("markdown", F.concat(head, body))


@F.pandas_udf(T.StringType())
def _joined_url(bases: pd.Series, links: pd.Series) -> pd.Series:
    return pd.Series([None if link is None else urljoin(base or "", link) for base, link in zip(bases, links)])


def absolute_url(base: Column, link: Column) -> Column:
    """Link resolved against the page it is on; only links that are not absolute go to Python."""
    relative = ~link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
    return F.when(relative, _joined_url(base, F.when(relative, link))).otherwise(link)


NO_BLOCKS = "No content available"


def split_blocks(articles: DataFrame) -> DataFrame:
    """``page_id, block_no, type, value``: text and image blocks of each markdown text, in order."""
    marked = F.regexp_replace("markdown", r"(?d)!\[.*?\]\((.*?)\)", "\u0000$1\u0000")
    parts = articles.select("page_id", "url", F.posexplode(F.split(marked, "\u0000")).alias("pos", "part"))
    image = F.col("pos") % 2 == 1
    trimmed = parts.withColumn("part", tx.strip(F.col("part"))).filter(image | (F.col("part") != ""))
    blocks = trimmed.select(
        "page_id",
        F.col("pos").alias("block_no"),
        F.when(image, "image_url").otherwise("text").alias("type"),
        F.when(image, absolute_url(F.col("url"), F.when(image, F.col("part")))).otherwise(F.col("part")).alias("value"),
    )
    empty = articles.filter(tx.strip(F.coalesce("markdown", F.lit(""))) == "").select(
        "page_id", F.lit(0).alias("block_no"), F.lit("text").alias("type"), F.lit(NO_BLOCKS).alias("value")
    )
    return blocks.unionByName(empty)


def clip_articles(articles: DataFrame, size: int = 1000) -> DataFrame:
    """``page_id, payload``: url and clipped text as JSON; PDFs give their error."""
    done = F.to_json(F.struct("url", tx.clip(F.col("markdown"), size).alias("crawled_content")))
    pdf = F.to_json(
        F.struct(
            "url", F.lit(K.PDF_ERROR).alias("error"), F.lit(None).cast("string").alias("crawled_content"),
            F.lit(True).alias("is_pdf"),
        ),
        {"ignoreNullFields": "false"},
    )
    return articles.select("page_id", F.when(F.col("status") == "pdf", pdf).otherwise(done).alias("payload"))

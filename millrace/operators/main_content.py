"""Main content of a page, and HTML as Markdown."""

from __future__ import annotations

import re
from collections.abc import Callable
from html import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.sources.html import VOID, Node, parse

# Where the main content is looked for, in this order.
SELECTORS = [
    "main", "article", ".content", ".post-content", ".entry-content", "#content", ".main-content",
    "div[role='main']", ".page-content",
]
DROPPED = ("script", "style", "nav", "header", "footer")
LEAST_SELECTED, LEAST_DIV, LEAST_SUMMARY = 50, 200, 50


def _matches(node: Node, selector: str) -> bool:
    if selector.startswith("."):
        return selector[1:] in node.classes()
    if selector.startswith("#"):
        return node.attrs.get("id") == selector[1:]
    tag, _, role = selector.partition("[role='")
    return node.tag == tag and (not role or node.attrs.get("role") == role[:-2])


def to_html(node: Node | str) -> str:
    if isinstance(node, str):
        return escape(node, quote=False)
    inner = "".join(map(to_html, node.children))
    if node.tag == "[document]":
        return inner
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}/>" if node.tag in VOID else f"<{node.tag}{attrs}>{inner}</{node.tag}>"


def main_node(root: Node) -> Node | None:
    """The first selector's first element, if it has over 50 characters; else the longest div of over 200; else the body."""
    root.drop(*DROPPED)
    everything = list(root.walk())
    for selector in SELECTORS:
        found = next((n for n in everything if _matches(n, selector)), None)
        if found is not None and len(found.text().strip()) > LEAST_SELECTED:
            return found
    longest = max(((len(n.text().strip()), -i) for i, n in enumerate(everything) if n.tag == "div"), default=(0, 0))
    if longest[0] > LEAST_DIV:
        return everything[-longest[1]]
    return root.first("body")


def main_content(html: str | None, summarize: Callable[[str], tuple[str, str] | None] | None = None) -> str:
    """Main content as HTML.

    ``summarize`` may give (title, HTML) of a page; what it gives of 50 characters
    or more is taken, under a heading with the title.
    """
    if not html:
        return ""
    if summarize is not None and (got := summarize(html)) is not None and len(got[1]) >= LEAST_SUMMARY:
        return f"<h1>{escape(got[0])}</h1>\n{got[1]}"
    found = main_node(parse(html))
    return html if found is None else to_html(found)


_BLOCKS = frozenset("p div section article main header footer aside ul ol table tr blockquote pre figure form dl dt dd address fieldset hr".split())


def markdown(node: Node | str, inside: str = "") -> str:
    """Markdown of a tree: headings, emphasis, links, images, lists, tables, code and quotes."""
    if isinstance(node, str):
        return node if inside == "pre" else re.sub(r"\s+", " ", node)
    tag = node.tag
    if tag in ("script", "style", "head", "template"):
        return ""
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n* * *\n\n"
    if tag == "img":
        title = f' "{node.attrs["title"]}"' if node.attrs.get("title") else ""
        return f"![{node.attrs.get('alt', '')}]({node.attrs.get('src', '')}{title})"
    if tag in ("ul", "ol"):
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        lines = [f"{f'{i}.' if tag == 'ol' else '*'} {markdown(c, inside).strip()}".replace("\n", "\n  ") for i, c in enumerate(items, 1)]
        return "\n\n" + "\n".join(lines) + "\n\n"
    if tag == "table":
        rows = [[re.sub(r"\s+", " ", markdown(c)).strip() for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in node.all("tr")]
        rows = [r for r in rows if r]
        if not rows:
            return ""
        lines = [" | ".join(r) for r in rows]
        return "\n\n" + "\n".join([lines[0], "|".join(["---"] * len(rows[0])), *lines[1:]]) + "\n\n"
    inner = "".join(markdown(c, "pre" if tag == "pre" else inside) for c in node.children)
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        return f"\n\n{'#' * int(tag[1])} {inner.strip()}\n\n" if inner.strip() else ""
    if tag == "a":
        return f"[{inner}]({node.attrs['href']})" if node.attrs.get("href") and inner.strip() else inner
    for tags, mark in ((("b", "strong"), "**"), (("i", "em", "u"), "_"), (("code", "tt"), "`"), (("del", "s", "strike"), "~~")):
        if tag in tags and inside != "pre":
            return f"{mark}{inner.strip()}{mark}" if inner.strip() else inner
    if tag == "pre":
        return "\n\n```\n" + inner.strip("\n") + "\n```\n\n"
    if tag == "blockquote":
        return "\n\n" + "\n".join(f"> {x}" for x in inner.strip().split("\n")) + "\n\n"
    return f"\n\n{inner.strip() if inside != 'pre' else inner}\n\n" if tag in _BLOCKS else inner


def html_to_markdown(html: str | None) -> str:
    return re.sub(r"\n{3,}", "\n\n", markdown(parse(html))).strip() + "\n" if html else ""


def extract(html: Column, summarize: Callable[[str], tuple[str, str] | None] | None = None) -> Column:
    """Main content of each page as HTML."""

    @F.pandas_udf(StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_content(p, summarize) for p in pages], dtype="object")

    return run(html)


@F.pandas_udf(StringType())
def as_markdown(html: pd.Series) -> pd.Series:
    return pd.Series([html_to_markdown(h) for h in html], dtype="object")

"""Leaf blocks of an HTML page: runs of text between block-level tags, with the tags above them."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""",
    re.S,
)
_MARKS = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that can be in a head; anything else ends it.
_IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: Elements whose content is text up to their end tag, or to the end of the page.
_TEXT_ONLY = frozenset("script style title textarea".split())
#: Elements whose content the parser doesn't look into for tags.
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video")}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


@dataclass(slots=True)
class Element:
    name: str
    features: frozenset[str]
    score: float | None = None


@dataclass(slots=True)
class Block:
    text: str
    above: Element
    linked: int  # characters inside links
    bold: bool = False
    features: list[str] = field(default_factory=list)


@lru_cache(4096)
def _marks(attrs: str) -> frozenset[str]:
    return frozenset(f"mark={w}" for m in _MARKS.finditer(attrs) for w in _WORD.findall((m[2] or m[3] or m[4] or "").lower()))


def blocks(html: str) -> list[Block]:
    """The blocks that hold text, in page order, with character references decoded and white space made single.

    Work follows the length of the page: counts of the names that are open say
    whether an end tag, or an element that ends others, finds anything at all.
    """
    root = Element("", frozenset())
    stack, out, text, linked, bold, at = [root], [], [], 0, False, 0
    tops = [root]  # the elements of the stack that aren't inline
    runs = [Counter()]  # for each of them, the inline elements directly above it in the stack
    open_: Counter[str] = Counter()
    unclosed: set[str] = set()  # names of elements without an end tag from here on
    in_head = False

    def pop() -> None:
        e = stack.pop()
        open_[e.name] -= 1
        if e.name in _INLINE:
            runs[-1][e.name] -= 1
        else:
            tops.pop()
            runs.pop()

    def flush() -> None:
        nonlocal linked, bold
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                out.append(Block(whole, tops[-1], linked, bold))
            text.clear()
        linked, bold = 0, False

    def add(raw: str) -> None:
        nonlocal linked, bold, in_head
        if in_head:
            if not raw or raw.isspace():
                return
            in_head = False  # text can't be in it
        if not raw:
            return
        piece = unescape(raw) if "&" in raw else raw
        text.append(piece)
        run = runs[-1]
        if run["a"] > 0:
            linked += len(piece.strip())
        if run["b"] > 0 or run["strong"] > 0:
            bold = True

    for_tag = _TAG.search
    while m := for_tag(html, at):
        add(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                add(m["cdata"])
            continue
        name = name.lower()
        if m["close"]:
            if name == "head":
                in_head = False
            if name in _INLINE:
                if runs[-1][name] > 0:
                    while stack[-1].name != name:
                        pop()
                    pop()
                continue
            flush()
            if open_[name] > 0:
                while stack[-1].name != name:
                    pop()
                pop()
            continue
        if in_head and name not in _IN_HEAD:
            in_head = False
        if name in _RAW:
            flush()
            if name not in _TEXT_ONLY and (m["attrs"].rstrip().endswith("/") or name in unclosed):
                continue
            end = _RAW[name].search(html, at)
            if end:
                at = end.end()
            elif name in _TEXT_ONLY:
                at = len(html)
            else:
                unclosed.add(name)  # an element that is never closed hides no more than its tag
            continue
        if name == "head":
            flush()
            in_head = True
            continue
        if name in _VOID:
            if name == "br":
                text.append(" ")
            elif name == "hr":
                flush()
            continue
        if name not in _INLINE:
            flush()
            while len(stack) > 1 and (stack[-1].name in _INLINE or stack[-1].name == "p"):
                pop()
            ends, stop = _CLOSES.get(name, (frozenset(), frozenset()))
            if any(open_[n] > 0 for n in ends):
                for i in range(len(tops) - 1, 0, -1):
                    if tops[i].name in stop:
                        break
                    if tops[i].name in ends:
                        while len(tops) > i:
                            pop()
                        break
            tops.append(Element(name, tops[-1].features | _marks(m["attrs"]) | {f"in={name}"}))
            stack.append(tops[-1])
            runs.append(Counter())
            open_[name] += 1
        elif not m["attrs"].endswith("/"):
            stack.append(Element(name, frozenset()))
            runs[-1][name] += 1
            open_[name] += 1
    add(html[at:])
    flush()
    return out

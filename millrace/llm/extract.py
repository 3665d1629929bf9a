"""Main text of HTML pages: a linear-chain conditional random field over leaf blocks.

A page is the sequence of its leaf blocks, each either content or boilerplate.
Weights belong to features of a block (tags and class words above it, its own
tag, length, links, punctuation, cue words) and to pairs of neighbouring
labels.  They are trained by the gradient of the exact log-likelihood, from the
forward and backward sums, on labelled pages that this module makes: layouts of
many kinds filled with invented words, so that no word of a corpus is learned.
Pages are decoded by Viterbi.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.dom import Block, blocks
from millrace.llm.shared import pick, small_batches

TRAINING_PAGES = 600
EPOCHS = 8
SEED = 5
_CUES = frozenset(
    "cookie cookies subscribe newsletter share tweet copyright reserved rights privacy terms login sign register advertisement sponsored comment comments reply menu search".split()
)
_TOKEN = re.compile(r"[a-z]+")


def features(block: Block) -> list[str]:
    """Features of a block by itself; those of the tags above it are kept with the element."""
    text = block.text
    n, words = len(text), text.count(" ") + 1
    share = min(1.0, block.linked / n)
    out = [
        f"tag={block.above.name}", f"words={min(6, words.bit_length())}", f"links={0 if share < 0.2 else 1 if share < 0.8 else 2}",
        f"stop={text[-1] in '.!?:;\"…。'}", f"commas={min(2, text.count(','))}",
    ]
    if block.bold:
        out.append("bold")
    if "©" in text or "·" in text:
        out.append("sign")
    if words <= 25:
        out += [f"cue={w}" for w in _TOKEN.findall(text.lower()) if w in _CUES]
    return out


class Crf:
    """Two labels, 0 boilerplate and 1 content; emission weights are those of content against boilerplate."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros(0)
        self.pair = np.zeros((2, 2))
        self.first = 0.0

    def fit(self, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-5) -> Crf:
        for rows, _ in pages:
            for row in rows:
                for f in row:
                    self.index.setdefault(f, len(self.index))
        self.w = np.zeros(len(self.index))
        seen, seen_pair, seen_first = np.full(len(self.w), 1e-2), np.full((2, 2), 1e-2), 1e-2
        coded = [([np.array([self.index[f] for f in row]) for row in rows], np.array(labels)) for rows, labels in pages if rows]
        order = random.Random(SEED)
        for _ in range(epochs):
            order.shuffle(coded)
            for rows, labels in coded:
                e = np.array([self.w[r].sum() for r in rows])
                e[0] += self.first
                p, pairs = self._marginals(e)
                error = labels - p
                for r, err in zip(rows, error, strict=True):
                    g = err - decay * self.w[r]
                    seen[r] += g * g
                    self.w[r] += rate * g / np.sqrt(seen[r])
                truth = np.zeros((2, 2))
                np.add.at(truth, (labels[:-1], labels[1:]), 1)
                g = truth - pairs
                seen_pair += g * g
                self.pair += rate * g / np.sqrt(seen_pair)
                seen_first += error[0] ** 2
                self.first += rate * error[0] / math.sqrt(seen_first)
        return self

    def _marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(label 1) of each block and the expected count of each label pair."""
        n = len(e)
        states = np.stack((np.zeros(n), e), axis=1)
        a, b = np.zeros((n, 2)), np.zeros((n, 2))
        a[0] = states[0]
        for t in range(1, n):
            s = a[t - 1][:, None] + self.pair
            a[t] = np.logaddexp(s[0], s[1]) + states[t]
        for t in range(n - 2, -1, -1):
            s = self.pair + states[t + 1] + b[t + 1]
            b[t] = np.logaddexp(s[:, 0], s[:, 1])
        z = np.logaddexp(a[-1, 0], a[-1, 1])
        pairs = np.exp(a[:-1, :, None] + self.pair[None] + (states[1:] + b[1:])[:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((2, 2))
        return np.exp(a[:, 1] + b[:, 1] - z), pairs

    def weights(self) -> dict:
        return {"w": {f: float(self.w[i]) for f, i in self.index.items()}, "pair": self.pair.tolist(), "first": float(self.first)}


def viterbi(scores: list[float], pair: list[list[float]]) -> list[int]:
    """The likeliest labels; of ties, content."""
    if not scores:
        return []
    (p00, p01), (p10, p11) = pair
    no, yes, back = 0.0, scores[0], []
    for s in scores[1:]:
        n0, n1, y0, y1 = no + p00, yes + p10, no + p01, yes + p11
        back.append((int(n1 >= n0), int(y1 >= y0)))
        no, yes = max(n0, n1), max(y0, y1) + s
    label, out = int(yes >= no), []
    for step in reversed(back):
        out.append(label)
        label = step[label]
    return [*out, label][::-1]


def main_text(html: str | None, model: dict) -> str:
    """The content blocks of a page, joined by newlines; empty for null, for no text and for nothing but boilerplate."""
    if not html:
        return ""
    w = model["w"]
    found, scores = blocks(html), []
    for block in found:
        above = block.above
        if above.score is None:
            above.score = sum(w.get(f, 0.0) for f in above.features)
        scores.append(above.score + sum(w.get(f, 0.0) for f in features(block)))
    if scores:
        scores[0] += model["first"]
    return "\n".join(b.text for b, label in zip(found, viterbi(scores, model["pair"]), strict=True) if label)


class _Maker:
    """Makes labelled pages: what ``body`` writes is content, all else boilerplate."""

    SYLLABLES = "ka lo mi ter va ne su do ri pa el on th ing es der ung tion ment ou".split()

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.labels: list[int] = []

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        out = ["".join(r.choices(self.SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        for i in range(len(out) - 1):
            if r.random() < 0.08:
                out[i] += r.choice([",", ".", ",", ";"])
        return " ".join(out).capitalize()

    def sentence(self) -> str:
        r = self.r
        lo, hi = r.choice([(1, 1), (1, 4), (3, 12), (8, 40), (20, 120)])
        text = self.words(lo, hi)
        if r.random() < 0.06:
            text = text.upper()
        if r.random() < 0.06:
            text = " ".join(w + r.choice(["###", "%%%", "***", "$$$", "&&&"]) for w in text.split())
        return text + r.choice([".", ".", ".", ".", "!", "?", "", " |"])

    def block(self, tag: str, text: str, label: int, attrs: str = "") -> str:
        self.labels.append(label)
        return f"<{tag}{attrs}>{escape(text, False)}</{tag}>"

    def links(self, tag: str = "li") -> str:
        out = ""
        for _ in range(self.r.randint(2, 8)):
            self.labels.append(0)
            out += f'<{tag}><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></{tag}>'
        return out

    def cls(self, *names: str) -> str:
        name = self.r.choice(names)
        return self.r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.words(1, 1)}"', f' class="{name}-{self.r.randint(1, 9)}"'])

    def note(self) -> str:
        r = self.r
        kind = r.randint(0, 7)
        text = self.words(2, 25) + r.choice([".", "!", ""])
        if kind == 0:
            return self.block("div", text, 0, self.cls("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo"))
        if kind == 1:
            return self.block("div", r.choice(["We use cookies. ", ""]) + text, 0, self.cls("cookie-notice", "notice", "alert", "consent", "cookie-banner", "gdpr", "popup"))
        if kind == 2:
            return f"<div{self.cls('share', 'social', 'toolbar', 'breadcrumb', 'breadcrumbs', 'pagination', 'tags', 'related', 'meta')}><ul>{self.links()}</ul></div>"
        if kind == 3:
            inner = self.block("label", self.words(1, 4), 0) + '<input name="q">' + self.block("button", r.choice(["Subscribe", "Search", "Sign up", self.words(1, 2)]), 0)
            return f'<form action="/x"{self.cls("newsletter", "search", "login", "signup", "subscribe")}>{self.block("p", text, 0) if r.random() < 0.5 else ""}{inner}</form>'
        if kind == 4:
            return f"<aside{r.choice(['', self.cls('sidebar', 'widget', 'related', 'rail')])}>{self.block(r.choice(['h2', 'h3', 'p']), self.words(1, 4), 0)}<ul>{self.links()}</ul>{self.block('p', text, 0)}</aside>"
        if kind == 5:
            return self.block("aside", text, 0)
        if kind == 6:
            return f'<script>var t="</p>{self.words(1, 3)}";</script><style>p{{margin:0}}</style><!-- {text} -->'
        return self.block("p", text, 0, self.cls("ad", "notice", "promo", "disclaimer", "sponsored"))

    def comments(self) -> str:
        tag, wrap = self.r.choice([("li", "ol"), ("div", "div"), ("article", "section"), ("p", "section")])
        out = ""
        for _ in range(self.r.randint(1, 5)):
            cls = self.cls("comment", "reply", "comment-body")
            out += f"<{tag}{cls}>{self.block('p', self.sentence(), 0)}</{tag}>" if tag != "p" else self.block("p", self.sentence(), 0, cls)
        return f"<{wrap}{self.cls('comments', 'comment-list', 'discussion', 'responses', 'disqus')}>{self.block('h3', self.words(1, 3), 0)}{out}</{wrap}>"

    def body(self, notes: bool = True) -> str:
        r, out = self.r, ""
        if r.random() < 0.85:
            title = self.block("h1", self.words(1, 12) + r.choice(["", "."]), 1)
            out += r.choice([title, title, f"<header>{title}</header>"])
        for _ in range(r.choice([1, 2, 3, 5, 8, 14, 25])):
            x = r.random()
            if x < 0.72:
                out += self.block("p", self.sentence(), 1)
            elif x < 0.78:
                self.labels.append(1)
                out += f"<p><b>{escape(self.sentence(), False)}<br>"
            elif x < 0.83:
                out += self.block(r.choice(["h2", "h3", "h4"]), self.words(1, 7), 1)
            elif x < 0.87:
                tag = r.choice(["ul", "ol"])
                out += f"<{tag}>" + "".join(self.block("li", self.sentence(), 1) for _ in range(r.randint(1, 5))) + f"</{tag}>"
            elif x < 0.90:
                out += self.block("blockquote", self.sentence(), 1)
            elif x < 0.92:
                out += self.block("pre", self.words(3, 20), 1)
            elif x < 0.94:
                out += "<table><tr>" + "".join(self.block("td", self.words(1, 4), 1) for _ in range(r.randint(2, 4))) + "</tr></table>"
            elif x < 0.95:
                out += f"<figure><img src='a.png'>{self.block('figcaption', self.words(2, 9), 1)}</figure>"
            elif notes:
                out += self.note()
        return out

    def page(self) -> tuple[str, list[int]]:
        self.labels = []
        r, out = self.r, ""
        kind = r.randint(0, 6)
        top = [lambda: f"<nav><ul>{self.links()}</ul></nav>", lambda: f"<header>{self.block(r.choice(['p', 'div', 'h2']), self.words(1, 6), 0)}<nav>{self.links('div')}</nav></header>", lambda: f"<div{self.cls('nav', 'navbar', 'menu', 'header', 'topbar')}><ul>{self.links()}</ul></div>", lambda: ""]
        foot = [
            lambda: self.block("footer", f"© {self.words(1, 3)} · {self.words(2, 14)}.", 0),
            lambda: f"<footer>{self.block('p', self.words(3, 14) + r.choice(['', ' All rights reserved.']), 0)}<ul>{self.links()}</ul></footer>",
            lambda: self.block("div", "Copyright " + self.words(2, 12), 0, self.cls("footer", "copyright", "bottom")), lambda: "",
        ]
        out += r.choice(top[:3] if kind < 6 else top)()
        for _ in range(r.randint(0, 3)):
            out += self.note()
        if kind <= 2:
            out += f"<article{r.choice(['', '', self.cls('post', 'article', 'story', 'entry')])}>{self.body()}{self.comments() if r.random() < 0.2 else ''}</article>"
        elif kind == 3:
            out += f"<main>{r.choice(['<article>', '<div>', '<section>'])}{self.body()}" + "</main>"
        elif kind == 4:
            out += f"<div{self.cls('content', 'post-body', 'entry-content', 'main', 'article-body', 'story', 'page-content')}>{self.body()}</div>"
        elif kind == 5:
            side = lambda: f"<td{self.cls('sidebar', 'left', 'nav')}><ul>{self.links()}</ul></td>"
            left = side() if r.random() < 0.5 else ""
            out += f"<table><tr>{left}<td{self.cls('content', 'main')}>{self.body()}</td></tr></table>"
        else:
            out += f"<div>{self.body(False)}</div>" if r.random() < 0.5 else self.body(False)
        for _ in range(r.randint(0, 2)):
            out += r.choice([self.note, self.comments, self.note])()
        out += r.choice(foot)()
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>'
        return head + out + r.choice(["</body></html>", "</body></html>", ""]), self.labels


def labelled_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> Iterator[tuple[list[Block], list[int]]]:
    maker = _Maker(seed)
    made = 0
    while made < n:
        html, labels = maker.page()
        found = blocks(html)
        if len(found) == len(labels):
            made += 1
            yield found, labels


@lru_cache(1)
def train(n: int = TRAINING_PAGES) -> dict:
    """Weights as plain values; the same in every process."""
    return Crf().fit([([[*b.above.features, *features(b)] for b in found], labels) for found, labels in labelled_pages(n)]).weights()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) for every row of ``pages`` (page_id, url, html).

    A null or empty html, and a page without content, gives an empty text.
    Pages are worked on whole, each by itself, however long; repeated rows give
    repeated results and an empty table an empty one.  Further columns of any
    name are left out.
    """
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(train())  # a few hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, sent.value) for x in batch.column(2).to_pylist()]
            counts = [pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *counts], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    rows = pick(pages, "page_id", "url", "html").select("page_id", F.col("url").cast("string"), "html")
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks int")

"""Main text of web pages by a tree-structured graphical model.

Elements are nodes with two states, content and boilerplate.  A node has a log-linear potential over its own features,
each parent-child edge a 2 x 2 potential; sum-product messages up and down the tree give exact marginals.  The same
messages give the gradient of the likelihood, so both potentials are trained together on labelled pages.  The given
tables hold no labelled pages; :func:`labelled_page` makes them from layouts in common use, with every text marked.

Reading decodes character references, skips scripts, styles and form controls, and treats inline tags as part of
their block.  Whole pages are read; a page is one task-local tree, so memory is bounded by a page.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.common import text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style noscript template head title select option textarea button svg math iframe object "
                    "canvas audio video".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes script style template".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                     "h5 h6 header hr main menu nav ol p pre section table ul li".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in class, id or role that speak for boilerplate or for content.
AWAY = re.compile(r"nav|menu|foot|head(?!line)|side|bar\b|ad\b|ads|advert|banner|promo|sponsor|cookie|consent|notice|popup|modal|"
                  r"comment|reply|share|social|related|recommend|subscribe|newsletter|breadcrumb|widget|login|search|legal|copyright|meta|byline|tags?\b", re.I)
TOWARD = re.compile(r"article|content|post|entry|main|story|body|text", re.I)
TAGS = ("article", "main", "section", "div", "p", "h", "ul", "li", "nav", "header", "footer", "aside", "form", "table", "blockquote", "pre", "figure")
N_FEATURES = len(TAGS) + 14


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "text", "linked", "blocks", "label")

    def __init__(self, tag: str, parent: int, attrs: str, label: int | None = None):
        self.tag, self.parent, self.attrs, self.label = tag, parent, attrs, label
        self.children: list[int] = []
        self.text = self.linked = 0
        self.blocks: list[int] = []


class Page(HTMLParser):
    """``nodes`` in page order and ``blocks`` of (node, text)."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, "")]
        self.stack = [0]
        self.skip: list[str] = []
        self.inner: list[str] = []  # open elements inside a skipped option
        self.links = 0
        self.blocks: list[tuple[int, str]] = []
        self.held: list[str] = []
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            node = self.nodes[self.stack[-1]]
            node.blocks.append(len(self.blocks))
            node.text += len(text)
            self.blocks.append((self.stack[-1], text))

    def pop(self, tags) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.nodes[self.stack[k]].tag in tags:
                self.flush()
                del self.stack[k:]
                return
            if self.nodes[self.stack[k]].tag in ("div", "article", "section", "table", "ul", "ol", "td", "main", "body") and "p" in tags:
                return

    def handle_starttag(self, tag, attrs):
        if self.skip:
            top = self.skip[-1]
            if (top == "head" and tag not in IN_HEAD) or (top == "option" and tag in ("option", "optgroup")):
                self.skip.pop()  # its end tag is left out
                self.inner.clear()
            else:
                if top == "option":
                    self.inner += [tag] * (tag not in VOID)
                elif top == "head":
                    self.skip += [tag] * (tag in SKIPPED and tag != "head")
                elif tag == top and tag not in VOID:
                    self.skip.append(tag)
                return
        if tag == "body" and len(self.stack) > 1:
            return
        if tag in SKIPPED:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag in INLINE:
            self.links += tag == "a"
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.flush()
            return
        if tag in CLOSES_P:
            self.pop({"p"})
        if tag in SAME and len(self.stack) > 1 and self.nodes[self.stack[-1]].tag in SAME[tag]:
            self.pop(SAME[tag])
        self.flush()
        kept = {k: v or "" for k, v in attrs}
        says = " ".join(kept.get(k, "") for k in ("class", "id", "role", "itemprop"))
        label = int(kept["data-truth"]) if "data-truth" in kept else None
        if tag != "html":
            self.nodes[self.stack[-1]].children.append(len(self.nodes))
            self.nodes.append(Node(tag, self.stack[-1], says, label))
            self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        if self.skip:
            top = self.skip[-1]
            if tag == top:
                self.skip.pop()
                self.inner.clear()
            elif tag == "head":  # an unclosed title
                self.skip.clear()
            elif top == "option" and tag in self.inner:
                while self.inner.pop() != tag:
                    pass
            elif top == "option" and tag not in INLINE:  # the parent's end
                self.skip.pop()
                self.inner.clear()
                self.handle_endtag(tag)
            return
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
        elif tag not in VOID and tag not in ("html", "body"):
            self.pop({tag})

    def handle_data(self, data):
        if self.skip == ["head"] and data.strip():
            self.skip.clear()
        if not self.skip:
            self.held.append(data)
            if self.links and len(self.stack):
                self.nodes[self.stack[-1]].linked += len(data.strip())


def features(page: Page) -> np.ndarray:
    """One row per node."""
    nodes = page.nodes
    x = np.zeros((len(nodes), N_FEATURES))
    under, linked = [n.text for n in nodes], [n.linked for n in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        under[nodes[i].parent] += under[i]
        linked[nodes[i].parent] += linked[i]
    flags = [(0, 0)] * len(nodes)
    base = len(TAGS)
    for i, n in enumerate(nodes):
        tag = "h" if re.fullmatch("h[1-6]", n.tag) else "ul" if n.tag in ("ol", "dl") else "li" if n.tag in ("dt", "dd") else n.tag
        row = x[i]
        if tag in TAGS:
            row[TAGS.index(tag)] = 1
        away, toward = bool(n.attrs and AWAY.search(n.attrs)), bool(n.attrs and TOWARD.search(n.attrs))
        up = flags[n.parent] if i else (0, 0)
        flags[i] = (int(up[0] or away or n.tag in ("nav", "header", "footer", "aside", "form")), int(up[1] or toward or n.tag in ("article", "main")))
        own, density = n.text, linked[i] / under[i] if under[i] else 0.0
        text = " ".join(page.blocks[b][1] for b in n.blocks[:3])[:400]  # a look at style only; extraction keeps all
        marks = sum(text.count(c) for c in ".,;!?")
        row[base:] = (1, away, toward and not away, up[0], up[1], up[0] * up[1], math.log1p(own) / 6, math.log1p(under[i]) / 8, density,
                      own > 0 and n.linked > 0.5 * own, min(1.0, marks / 8), own == 0, "©" in text or "&copy" in text, i / len(nodes))
    return x


def marginals(parents: list[int], unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals P(content) and edge marginals (row of node i: its parent's edge) by sum-product, in logarithms.

    ``unary``: (n, 2) log potentials; ``pair``: (2, 2), parent state by child state.  Parents precede children.
    """
    n = len(parents)
    (a00, a01), (a10, a11) = pair.tolist()
    u0, u1 = unary[:, 0].tolist(), unary[:, 1].tolist()

    def lse(a: float, b: float) -> float:
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    up0, up1 = [0.0] * n, [0.0] * n  # message from child to parent
    b0, b1 = u0[:], u1[:]
    for i in range(n - 1, 0, -1):
        up0[i], up1[i] = lse(a00 + b0[i], a01 + b1[i]), lse(a10 + b0[i], a11 + b1[i])
        b0[parents[i]] += up0[i]
        b1[parents[i]] += up1[i]
    full0, full1 = b0[:], b1[:]
    edge = np.zeros((n, 2, 2))
    for i in range(1, n):
        p = parents[i]
        r0, r1 = full0[p] - up0[i], full1[p] - up1[i]  # parent's belief without this child
        e = np.array([[r0 + a00 + b0[i], r0 + a01 + b1[i]], [r1 + a10 + b0[i], r1 + a11 + b1[i]]])
        e = np.exp(e - e.max())
        edge[i] = e / e.sum()
        full0[i], full1[i] = b0[i] + lse(r0 + a00, r1 + a10), b1[i] + lse(r0 + a01, r1 + a11)
    return 1 / (1 + np.exp(np.clip(np.array(full0) - np.array(full1), -500, 500))), edge


class TreeModel:
    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def content(self, page: Page) -> np.ndarray:
        score = features(page) @ self.weights
        p, _ = marginals([n.parent for n in page.nodes], np.stack([0 * score, score], axis=1), self.pair)
        return p

    def extract(self, html: str) -> str:
        page = Page(html)
        if not page.blocks:
            return ""
        p = self.content(page)
        return " ".join(t for node, t in page.blocks if p[node] > 0.5)


_WORDS = "stone river market house light paper winter garden letter bridge number morning story people water green under before where while".split()


def labelled_page(seed: int) -> str:
    """A page of a common layout; ``data-truth`` marks the article's elements (1) and others (0)."""
    r = random.Random(seed)

    def say(n: int, stop: str = ".") -> str:
        w = [r.choice(_WORDS) + r.choice(["", "", "s", "ing"]) + r.choice(["", "", "", ","]) for _ in range(n)]
        return " ".join(w).capitalize().rstrip(",") + stop

    def links(n: int) -> str:
        return "".join(f'<li data-truth="0"><a href="/{i}">{say(r.randint(1, 3), "")}</a></li>' for i in range(n))

    def el(tag: str, cls: str, inner: str, truth: int = 0) -> str:
        attr = f' {r.choice(["class", "id", "class"])}="{cls}"' if cls and r.random() < 0.9 else ""
        return f'<{tag}{attr} data-truth="{truth}">{inner}</{tag}>'

    def p0(n: int) -> str:
        return r.choice([say(n), el("p", "", say(n)), el("div", "", say(n))])

    top = [el("nav", r.choice(["", "menu"]), f'<ul data-truth="0">{links(r.randint(3, 9))}</ul>')] if r.random() < 0.6 else [
        el("div", r.choice(["nav", "menu", "navbar", "top-menu"]), f'<ul data-truth="0">{links(r.randint(3, 9))}</ul>')]
    if r.random() < 0.5:
        top.append(el(r.choice(["header", "div"]), r.choice(["header", "site-header", "banner"]), r.choice([el("h1", "", say(3, "")), ""]) + p0(r.randint(3, 9))))
    if r.random() < 0.4:
        top.append(el("div", r.choice(["cookie-notice", "consent", "notice", "popup"]), p0(r.randint(5, 20))))
    ad = lambda: el("div", r.choice(["ad", "ads", "advert", "promo", "sponsored"]), p0(r.randint(4, 25)))
    if r.random() < 0.6:
        top.append(ad())
    body = [el("h1", r.choice(["", "title", "headline"]), say(r.randint(2, 9), r.choice(["", "."])), 1)]
    for _ in range(r.randint(1, 14)):
        k = r.random()
        if k < 0.72:
            inner = say(r.choice([1, 2, 5, 12, 30, 60, 120]))
            if r.random() < 0.25:
                inner = f'<b>{inner}<br>' if r.random() < 0.4 else f'{inner} <a href="#">{say(2, "")}</a> {say(4)}'
            body.append(el("p", "", inner, 1))
        elif k < 0.8:
            body.append(el(r.choice(["h2", "h3"]), "", say(r.randint(1, 5), ""), 1))
        elif k < 0.88:
            body.append(f'<ul data-truth="1">' + "".join(el("li", "", say(r.randint(2, 20)), 1) for _ in range(r.randint(2, 6))) + "</ul>")
        elif k < 0.93:
            body.append(el("blockquote", "", el("p", "", say(20), 1), 1))
        elif k < 0.96:
            body.append(el("div", "", say(25), 1))
        else:
            body.append(ad())
    if r.random() < 0.2:
        body.append(el("div", r.choice(["share", "social", "tags"]), f'<ul data-truth="0">{links(3)}</ul>'))
    tag, cls = r.choice([("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post"), ("section", "story"), ("div", "entry-content")])
    main = [el(tag, cls, "".join(body), 1)]
    comment = lambda: el(r.choice(["div", "li", "article"]), "comment", el("p", "", say(r.randint(4, 40))))
    if r.random() < 0.4:
        main.append(el(r.choice(["section", "div"]), r.choice(["comments", "comment-list", "replies"]), el("h3", "", "Comments") + "".join(comment() for _ in range(r.randint(1, 6)))))
    if r.random() < 0.4:
        main.insert(r.choice([0, len(main)]), el(r.choice(["aside", "div"]), r.choice(["sidebar", "related", "widget"]), el("h3", "", say(2, "")) + p0(12) + f'<ul data-truth="0">{links(4)}</ul>'))
    if r.random() < 0.3:
        main.append(el("form", r.choice(["", "subscribe", "search"]), el("label", "", say(3)) + "<input>" + p0(6)))
    foot = el("footer", "", p0(r.randint(3, 14)) + r.choice(["&copy; 2020 ", ""])) if r.random() < 0.6 else el("div", r.choice(["footer", "site-footer", "legal"]), "&copy; 2021 " + p0(8))
    wrap = "".join(main) if r.random() < 0.6 else el("div", r.choice(["wrapper", "page", "container", ""]), "".join(main), 1)
    return f"<html><head><title>{say(4)}</title></head><body>{''.join(top)}{wrap}{foot}</body></html>"


def train(pages: int = 240, steps: int = 60, seed: int = 1) -> TreeModel:
    """Gradient ascent on the labelled pages' likelihood; root and unmarked nodes follow their children's majority."""
    data = []
    for k in range(pages):
        page = Page(labelled_page(seed * 100_000 + k))
        y = np.array([n.label if n.label is not None else 1 for n in page.nodes])
        data.append((features(page), [n.parent for n in page.nodes], y))
    w, pair = np.zeros(N_FEATURES), np.zeros((2, 2))
    mw, mp, total = np.zeros_like(w), np.zeros_like(pair), sum(len(d[2]) for d in data)
    for t in range(steps):
        gw, gp = np.zeros_like(w), np.zeros_like(pair)
        for x, parents, y in data:
            s = np.einsum("nf,f->n", x, w)  # no matrix routines beside Spark, see packing
            p, edge = marginals(parents, np.stack([0 * s, s], axis=1), pair)
            gw += np.einsum("nf,n->f", x, y - p)
            np.add.at(gp, (y[parents[1:]], y[1:]), 1)
            gp -= edge[1:].sum(axis=0)
        mw = 0.85 * mw + gw / total - 0.0005 * w
        mp = 0.85 * mp + gp / total - 0.0005 * pair
        w, pair = w + 1.5 * mw, pair + 1.5 * mp
    return TreeModel(w, pair)


def extract_pages(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, ``text``, ``n_chars``.

    Null and empty pages, and pages without content, give an empty text.  Repeated rows are read each for itself; null
    ids and urls pass through; other columns are not read; an empty table gives no rows.
    """
    model = model or train()
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.pair))
    d = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_u"), text_of(html_col).alias("_h"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = TreeModel(*shared.value)
        for b in batches:
            out = [m.extract(h.as_py()) for h in b.column("_h")]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_u"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                             names=["_id", "_u", "text", "n_chars"])

    a, u = (d.schema[c].dataType.simpleString() for c in ("_id", "_u"))
    out = d.mapInArrow(work, f"_id {a}, _u {u}, text string, n_chars long")
    return out.withColumnsRenamed({"_id": id_col, "_u": url_col})

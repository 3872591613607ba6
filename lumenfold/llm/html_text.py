"""Main-text extraction from HTML with gradient-boosted trees over DOM-node features and hierarchical decoding.

A tolerant reader builds the tree of block elements of a page (implied ends, unclosed elements and raw-text elements as
browsers take them; inline elements add to their block). Runs of text directly inside a block are leaves of their own.
The trees give each node the probability that its text belongs to the article. Decoding then chooses for every node
whether it is kept so that the whole page is most probable under one rule: what stands inside a dropped node is dropped.
The trees are fitted on PAGES pages that html_pages writes by rule (a fixed number, so nothing grows with the input).
"""

from __future__ import annotations

import functools
import importlib.resources
import json
import html
import math
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import operator
from .html_pages import Page

PAGES, TREES, DEPTH, RATE, BINS = 1500, 80, 4, 0.25, 32

# HTML element names by how a reader treats them, and attribute words by what they say.
BLOCKS = set("html body article section nav aside header footer main div p ul ol li dl dt dd h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset address details summary hgroup search center ins dialog menu".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
DROPPED = set("script style textarea title xmp noembed noframes iframe noscript template select option input audio video head".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACED = {"br", "hr", "img", "td", "th"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
WORDS = {
    "site": "nav navbar navigation menu menubar topnav sitenav header masthead branding topbar footer colophon copyright legal bottom breadcrumb breadcrumbs pagination pager toolbar skip".split(),
    "side": "sidebar aside side rail widget widgets column related recommended recommend trending popular stories also share social sharing follow tags".split(),
    "sold": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay disclaimer privacy".split(),
    "form": "form newsletter subscribe subscription signup login search contact register".split(),
    "said": "comment comments commentlist discussion discuss disqus responses replies reply respond reader readers".split(),
    "good": "article content post entry story body text main page hentry prose richtext".split(),
}
WORD_KIND = {w: i for i, (_, words) in enumerate(WORDS.items()) for w in words}
KINDS = {**dict.fromkeys(["nav", "menu"], 0), "header": 1, "footer": 2, "aside": 3, **dict.fromkeys(["article", "main"], 4), "section": 5, **dict.fromkeys(["div", "center", "ins"], 6), "p": 7, **dict.fromkeys("h1 h2 h3 h4 h5 h6 hgroup".split(), 8), **dict.fromkeys(["li", "dt", "dd"], 9), **dict.fromkeys(["ul", "ol", "dl"], 10), **dict.fromkeys(["form", "fieldset", "search", "dialog"], 11), **dict.fromkeys("table thead tbody tfoot tr td th caption".split(), 12), **dict.fromkeys(["blockquote", "pre", "figure", "figcaption"], 13), "#text": 14, **dict.fromkeys(["html", "body"], 15)}
FEATURES = 16 + 6 + 6 + 6 + 16

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "kids", "words", "text", "linked", "depth", "start", "size", "link_size", "tags", "paragraphs", "marks", "links")

    def __init__(self, tag: str, parent: Node | None, words: tuple[int, ...] = ()):
        self.tag, self.parent, self.kids, self.words = tag, parent, [], words
        self.text: list[str] = []
        self.linked = self.links = 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.kids.append(self)


@functools.lru_cache(20_000)
def attribute_words(attributes: str) -> tuple[int, ...]:
    """How often class, id and role say a word of each kind."""
    n = [0] * len(WORDS)
    for m in _ATTRIBUTE.finditer(attributes):
        for w in _CAMEL.findall(m[1] or m[2] or m[3] or ""):
            k = WORD_KIND.get(w.lower())
            if k is not None:
                n[k] += 1
    return tuple(n)


_NONE = (0,) * len(WORDS)


class Tags:
    """Reads a page's tags from left to right, in time that grows with its length: a quote that is never closed is looked for once."""

    def __init__(self, page: str):
        self.page, self.tag, self.last = page, _TAG, page.rfind(">")

    def after(self, at: int):
        """Begin and end of the next markup from at on, and (closing, name, attributes) if it is a tag; None if there is none."""
        page = self.page
        while (low := page.find("<", at)) >= 0:
            mark = page[low + 1 : low + 2]
            if page.startswith("<!--", low):
                end = page.find("-->", low + 4)
                return low, len(page) if end < 0 else end + 3, None
            if low > self.last:
                return None
            named = page[low + 1 + (mark == "/") : low + 2 + (mark == "/")]
            if mark in ("!", "?") or mark == "/" and not (named.isascii() and named.isalpha()):
                return low, page.find(">", low) + 1, None
            if named.isascii() and named.isalpha():
                m = self.tag.match(page, low)
                if not m and self.tag is _TAG:
                    self.tag = _LOOSE  # from here on a tag ends at the next >
                    m = self.tag.match(page, low)
                if m:
                    return low, m.end(), (bool(m[1]), m[2].lower(), m[3])
            at = low + 1
        return None


def read_page(page: str) -> Node:
    """The tree of block elements; text runs are #text leaves, their white space already single spaces."""
    root = here = Node("html", None, _NONE)
    run: list[str] = []
    linked = links = 0
    in_link = False
    dropped: list[str] = []

    def flush():
        nonlocal run, linked, links
        text = " ".join("".join(run).split())
        if text:
            leaf = Node("#text", here, _NONE)
            leaf.text, leaf.linked, leaf.links = [text], min(linked, len(text)), links
        run, linked, links = [], 0, 0

    at, n, tags = 0, len(page), Tags(page)
    while at < n:
        found = tags.after(at)
        cut = found[0] if found else n
        if cut > at and not dropped:
            piece = html.unescape(page[at:cut])
            run.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not found:
            break
        at = found[1]
        if found[2] is None:
            continue
        closing, tag, attributes = found[2]
        if tag in RAW and not closing:
            end = RAW_END[tag].search(page, at)
            if not end:
                break
            end = page.find(">", end.start())
            at = n if end < 0 else end + 1
            continue
        if tag in DROPPED:
            if tag in VOID:
                continue
            if closing:
                if tag in dropped:
                    del dropped[dropped.index(tag) :]
            else:
                dropped.append(tag)
            if tag == "head" and closing:
                dropped.clear()
            continue
        if dropped:
            if tag == "body" or dropped == ["head"] and tag in BLOCKS and tag != "html":
                dropped.clear()  # the end of the head may be left out
            elif closing and tag in BLOCKS and tag in ("form", "div", "body", "article", "section") and "head" not in dropped:
                dropped.clear()  # an element that is never closed ends with its block
            else:
                continue
        if tag not in BLOCKS:
            if tag == "a":
                in_link = not closing
                links += in_link
            if tag in SPACED:
                run.append(" ")
            continue
        if tag in ("html", "body"):
            flush()
            continue
        flush()
        in_link = False
        if closing:
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                here = up.parent
            continue
        ends, fence = CLOSES.get(tag, ()), FENCES.get(tag, ())
        up = here
        if tag not in ("td", "th", "tr") or ends:
            close = None
            while up is not root and up.tag not in fence:
                if up.tag in ends:
                    close = up
                elif up.tag == "p":
                    close = up
                    if not ends:
                        break
                elif not ends:
                    break
                elif close is None and up.tag in ("article", "section", "div", "nav", "aside", "main", "form") :
                    break
                up = up.parent
            if close is not None:
                here = close.parent
        here = Node(tag, here, attribute_words(attributes) if attributes else _NONE)
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes with text below them, parents first, with their subtree sums."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(reversed(x.kids))
    place = 0
    for x in order:
        x.start = place
        if x.text:
            place += len(x.text[0])
    for x in reversed(order):
        t = x.text[0] if x.text else ""
        x.size, x.link_size, x.tags, x.paragraphs, x.marks = len(t), x.linked, 1, int(x.tag == "p"), t.count(",") + t.count(".")
        for k in x.kids:
            x.size += k.size
            x.link_size += k.link_size
            x.links += k.links
            x.tags += k.tags
            x.paragraphs += k.paragraphs
            x.marks += k.marks
    return [x for x in order if x.size]


def features_of(nodes: list[Node]) -> np.ndarray:
    """One row a node: its element, attribute words of itself and of those around it, densities, depth, place, siblings."""
    total = max(1, nodes[0].size) if nodes else 1
    above: dict[int, tuple] = {}
    out = np.zeros((len(nodes), FEATURES), np.float32)
    log = math.log1p
    for i, x in enumerate(nodes):
        p = x.parent
        kind = KINDS.get(x.tag, 6)
        if p is None:
            words, kinds, index, siblings, mean, same, prev = _NONE, (0,) * 6, 0, 1, 0.0, 1.0, 15
        else:
            words, kinds, stats = above[id(p)]
            index, siblings, mean, same, prev = stats[id(x)]
        row = [0.0] * 16
        row[kind] = 1.0
        row += x.words
        row += words
        row += kinds
        row += [log(x.size), x.link_size / x.size, x.size / x.tags, log(x.tags), x.depth, x.start / total, (x.start + x.size) / total, x.size / total, x.marks / x.size, log(x.paragraphs), log(x.links), siblings, index / siblings, mean, same, prev]
        out[i] = row
        if x.kids:
            live = [k for k in x.kids if k.size]
            logs = [log(k.size) for k in live]
            count: dict[str, int] = {}
            for k in live:
                count[k.tag] = count.get(k.tag, 0) + 1
            sums, stats, last = sum(logs), {}, 15
            for j, k in enumerate(live):
                stats[id(k)] = (j, len(live), (sums - logs[j]) / max(1, len(live) - 1), count[k.tag] / len(live), last)
                last = KINDS.get(k.tag, 6)
            own = list(kinds)
            if kind in (0, 1, 2, 3, 4, 11):
                own[(0, 1, 2, 3, 4, 11).index(kind)] += 1
            above[id(x)] = (tuple(a + b for a, b in zip(words, x.words, strict=True)), tuple(own), stats)
    return out


class Boosted:
    """Gradient-boosted trees of fixed depth on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        b = self.bin(x)
        score = np.zeros(len(y))
        self.feature, self.cut, self.value = [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
            leaf = np.zeros(len(y), np.int64)
            features, cuts = [], []
            for level in range(DEPTH):
                n = 1 << level
                best, which, where = np.full(n, 1e-6), np.zeros(n, np.int64), np.full(n, BINS)
                for f in range(x.shape[1]):
                    if not len(self.edges[f]):
                        continue
                    key = leaf * BINS + b[:, f]
                    gs, hs = (np.bincount(key, z, n * BINS).reshape(n, BINS).cumsum(axis=1) for z in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    at = gain.argmax(axis=1)
                    gain = gain[np.arange(n), at]
                    better = gain > best
                    best, which, where = np.where(better, gain, best), np.where(better, f, which), np.where(better, at, where)
                leaf = 2 * leaf + (b[np.arange(len(y)), which[leaf]] > where[leaf])
                features.append(which)
                cuts.append(where)
            n = 1 << DEPTH
            value = -RATE * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + 1)
            score += value[leaf]
            self.feature.append(np.concatenate(features))
            self.cut.append(np.concatenate(cuts))
            self.value.append(value)

    def to_json(self) -> str:
        """The edges and trees; a double is written so that it is read as itself."""
        return json.dumps({"edges": [e.tolist() for e in self.edges], "feature": [f.tolist() for f in self.feature], "cut": [c.tolist() for c in self.cut], "value": [v.tolist() for v in self.value]})

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        model, found = cls.__new__(cls), json.loads(text)
        model.edges = [np.array(e, float) for e in found["edges"]]
        model.feature, model.cut = ([np.array(a, np.int64) for a in found[name]] for name in ("feature", "cut"))
        model.value = [np.array(v, float) for v in found["value"]]
        return model

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.bin(x), np.zeros(len(x)), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            leaf = np.zeros(len(x), np.int64)
            for level in range(DEPTH):
                at = leaf + (1 << level) - 1
                leaf = 2 * leaf + (b[rows, feature[at]] > cut[at])
            out += value[leaf]
        return out


@functools.lru_cache(1)
def trained(pages: int = PAGES, seed: int = 0) -> Boosted:
    """The model fitted on pages written by rule; a node's label is whether most of its text is the article's."""
    xs, ys, ws = [], [], []
    for i in range(pages):
        page = Page(seed * 1_000_003 + i)
        nodes = nodes_of(read_page(page.html))
        kept, good = iter(page.kept), {}
        want = next(kept, None)
        for x in nodes:
            if x.text:
                good[id(x)] = want is not None and x.text[0].startswith(want.strip())
                if good[id(x)]:
                    want = next(kept, None)
        share: dict[int, int] = {}
        for x in reversed(nodes):
            own = share.get(id(x), 0) + (x.size if x.text and good[id(x)] else 0)
            share[id(x)] = own
            if x.parent is not None:
                share[id(x.parent)] = share.get(id(x.parent), 0) + own
        xs.append(features_of(nodes))
        ys.append([share[id(x)] * 2 > x.size for x in nodes])
        ws.append([1.0 + math.log1p(x.size) / 4 for x in nodes])
    return Boosted(np.concatenate(xs).astype(np.float64), np.concatenate(ys).astype(float), np.concatenate(ws))


#: The model that trained() fits, written by ``python -m lumenfold.llm.html_text``; a test fits it again and compares.
FITTED = "html_trees.json"


@functools.lru_cache(1)
def fitted() -> Boosted:
    """The fitted trees that come with the library; nothing is fitted when a query is planned."""
    return Boosted.from_json(importlib.resources.files(__package__).joinpath(FITTED).read_text("utf-8"))


def decode(nodes: list[Node], logit: np.ndarray) -> list[str]:
    """Texts of the kept leaves under the most probable consistent choice.

    keep(x) = log p + the better choice of each child; drop(x) = the sum of log(1 - p) over all of x's subtree.
    """
    keep, drop = {}, {}
    yes, no = -np.logaddexp(0, -logit), -np.logaddexp(0, logit)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        own_keep, own_drop = yes[i], no[i]
        for k in x.kids:
            if k.size:
                own_keep += max(keep[id(k)], drop[id(k)])
                own_drop += drop[id(k)]
        keep[id(x)], drop[id(x)] = own_keep, own_drop
    out, state = [], {}
    for x in nodes:
        up = x.parent is None or state[id(x.parent)]
        state[id(x)] = up and (x.parent is None or keep[id(x)] > drop[id(x)])
        if x.text and state[id(x)]:
            out.append(x.text[0])
    return out


def extract(pages: list[str], model: Boosted) -> list[str]:
    """Main texts of pages: kept blocks in page order, joined by an empty line."""
    trees = [nodes_of(read_page(p)) for p in pages]
    full = [t for t in trees if t]
    if not full:
        return [""] * len(pages)
    logit = model.logit(np.concatenate([features_of(t) for t in full]))
    at = iter(np.cumsum([len(t) for t in full]).tolist())
    begin, out = 0, []
    for t in trees:
        if t:
            end = next(at)
            out.append("\n\n".join(decode(t, logit[begin:end])))
            begin = end
        else:
            out.append("")
    return out


@operator
def extract_text(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The id columns, text and n_chars (code points) of every row; whole pages, no shuffle.

    Defined cases: null or empty html, or a page without text, gives an empty text; repeated rows and null ids give a row
    each; other columns are not read; an empty table gives no rows.
    """
    model = df.sparkSession.sparkContext.broadcast(fitted())  # TREES trees of depth DEPTH, whatever the input
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = extract([h or "" for h in part.column(len(id_cols)).to_pylist()], model.value)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(id_cols))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*id_cols, "text", "n_chars"])

    return df.select(*(F.col(c) for c in id_cols), F.col(html_col)).mapInArrow(run, f"{types}, text string, n_chars long")


if __name__ == "__main__":
    Path(__file__).with_name(FITTED).write_text(trained().to_json() + "\n", "utf-8")

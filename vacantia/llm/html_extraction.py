"""HTML extraction (operator 11): main text by a tree-structured graphical model.

A page becomes a tree of its block elements (and of inline ones that carry a class or id). Every node
is content or not; weights of its features give the node's potential, and a table per kind of (parent,
child) gives the edge's. One sum-product pass from the leaves up and one from the root down yields
the exact marginal of every node; the text of nodes at 0.5 or more is the main text. All pages of a
batch are passed through at once, level by level.

The model is trained here, by maximum likelihood with the same two passes, on labelled pages: the
article, menus, footers and notices of a bounded sample of pages, whose own markup names them, put
together anew in varied layouts and under varied names (`relabelled`), so that no single tag or
class decides.

Defined cases: null or empty html, and a page without content, give '' and 0; a page cut off anywhere
is read as far as it goes; scripts, styles, comments and the like never count; white space is what
Unicode calls so, no-break spaces included; repeated rows give repeated results; an empty table gives
an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SAMPLE_PAGES = 300    # most pages (by least hash) that training pages are made of
TRAINED_ON = 1200     # training pages: each of the sample as it is, and in several layouts
STEPS = 150           # of gradient ascent
BATCH = 1 << 20       # characters of html passed through the model at once

RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math "
                "select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var".split())
# What a start tag of this name closes if it is open, and which elements it does not look beyond.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
KEEPS_P = INLINE | VOID - {"hr"} | {"button", "option", "tr", "td", "th", "tbody", "li", "dt", "dd"}
SCOPES = frozenset("html body table td th caption button object".split())

KINDS = ["html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6",
         "ul", "ol", "li", "dl", "dt", "dd", "table", "tbody", "thead", "tr", "td", "th", "blockquote",
         "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "fieldset",
         "button", "dialog", "details", "summary", "address", "menu", "center", "head", "hgroup"]
_KIND = {k: i for i, k in enumerate(KINDS)}
# Groups of names for the potentials of edges.
_EDGE = {**dict.fromkeys(["html", "body", "div", "section", "center", "table", "tbody", "tr",
                          "td"], 0),
         **dict.fromkeys(["p", "blockquote", "pre", "figure", "figcaption"], 1),
         **dict.fromkeys(["h1", "h2", "h3", "h4", "h5", "h6", "hgroup"], 2),
         **dict.fromkeys(["ul", "ol", "li", "dl", "dt", "dd", "menu"], 3),
         **dict.fromkeys(["nav", "header", "footer", "aside", "form", "fieldset", "dialog"], 4),
         **dict.fromkeys(["article", "main"], 5)}
GROUPS = 7  # six above and the rest

WORDS = ["ad ads advert adverts advertisement sponsor sponsored promo promotion banner doubleclick",
         "nav navbar navigation menu breadcrumb breadcrumbs tabs pager pagination toc",
         "footer foot copyright legal colophon bottom", "header head masthead topbar top logo brand",
         "side sidebar aside widget rail related recommended recommendations trending popular more",
         "comment comments reply replies discussion disqus respond responses thread",
         "cookie cookies consent notice notices alert popup modal overlay gdpr privacy disclaimer",
         "form search login signup subscribe newsletter register contact", "share social follow like",
         "article content post entry story main text body page column", "hidden invisible sr-only off"]
_WORD = {w: i for i, group in enumerate(WORDS) for w in group.split()}
# Names whose elements say something about all that is in them.
AROUND = ["article", "main", "nav", "header", "footer", "aside", "form", "dialog"]
_AROUND = {k: i for i, k in enumerate(AROUND, len(WORDS))}

HASHED = 512
N_KIND, N_WORD, N_ABOVE, N_SHAPE = len(KINDS) + 1, len(WORDS), len(WORDS) + len(AROUND), 48
OFFSETS = np.cumsum([0, N_KIND, N_WORD, N_ABOVE, HASHED, N_SHAPE, N_KIND])
FEATURES = int(OFFSETS[-1])

_SPLIT = re.compile(r"[^a-z]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""\s(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""",
                   re.I)


# Pages to trees ---------------------------------------------------------------------------------


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) from left to right: ("text", "", text), ("start", name, attributes) and
    ("end", name, ""). Content of RAW elements, comments and declarations are left out."""
    at, size = 0, len(page)
    unquoted = {'"': size, "'": size}  # from here on a quote is not closed any more
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        following = page[lt + 1:lt + 2]
        if following.isascii() and (following.isalpha() or following in ("!", "?", "/")) and following:
            if lt > at:
                yield "text", "", page[at:lt]
        else:  # a lone <
            yield "text", "", page[at:lt + 1]
            at = lt + 1
            continue
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = size if stop < 0 else stop + 3
            continue
        stop = page.find(">", lt)
        if stop < 0:
            return  # cut off inside a tag
        if following in "!?":
            at = stop + 1
            continue
        closing = following == "/"
        found = _NAME.match(page, lt + 1 + closing)
        if found is None:
            at = stop + 1
            continue
        # A > inside quotes does not end the tag, if the quotes are closed at all.
        k = found.end()
        while True:
            quotes = [(q, m) for m in '"\'' if 0 <= (q := page.find(m, k, stop))]
            if not quotes:
                break
            q, mark = min(quotes)
            if not re.search(r"=\s*$", page[max(k, q - 8):q]):
                k = q + 1
                continue
            close = page.find(mark, q + 1) if q < unquoted[mark] else -1
            if close < 0:
                unquoted[mark] = min(unquoted[mark], q)
                break
            k = close + 1
            if k > stop:
                stop = page.find(">", k)
                if stop < 0:
                    return
        name, rest = found.group().lower(), page[found.end():stop]
        at = stop + 1
        if closing:
            yield "end", name, ""
        elif name in RAW:
            end = _end_of(page, name, at)
            yield "raw", name, ""
            at = end
        else:
            yield "start", name, rest


def _end_of(page: str, name: str, at: int) -> int:
    found = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
    if found is None:
        return len(page)
    stop = page.find(">", found.end() - 1)
    return len(page) if stop < 0 else stop + 1


@dataclass
class Page:
    """Nodes in page order: parent (-1 for the root), name, attributes, whether it breaks the text,
    and the sizes of own text. `pieces` holds the text in order: (node, text), text None at a
    border between blocks."""

    parent: list[int]
    name: list[str]
    attributes: list[str]
    depth: list[int]
    pieces: list[tuple[int, str | None]]
    linked: list[int]  # characters of own text inside links


def parse(page: str) -> Page:
    out = Page([-1], ["#page"], [""], [0], [], [0])
    stack, open_names = [("#page", 0, True)], Counter()  # (name, node, is a block)
    links = 0

    def pop() -> None:
        nonlocal links
        name, _, block = stack.pop()
        open_names[name] -= 1
        links -= name == "a"
        if block:
            out.pieces.append((stack[-1][1], None))

    def close(names, borders) -> None:
        """Closes the innermost open element of these names, looking up to a border."""
        if not any(open_names[n] for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in borders:
                return

    for kind, name, rest in tokens(page):
        if kind == "text":
            node = stack[-1][1]
            out.pieces.append((node, rest))
            if links:
                out.linked[node] += len(rest)
        elif kind == "start":
            if name not in KEEPS_P:
                close({"p"}, SCOPES)
            if name in CLOSES:
                close(*CLOSES[name])
            if name in VOID:
                out.pieces.append((stack[-1][1], " " if name in ("br", "hr") else ""))
                continue
            block = name not in INLINE
            marked = " class" in rest or " id" in rest
            node = stack[-1][1]
            if block or marked:
                out.parent.append(node)
                out.name.append(name)
                out.attributes.append(rest)
                out.depth.append(out.depth[node] + 1)
                out.linked.append(0)
                node = len(out.parent) - 1
            if block:
                out.pieces.append((node, None))
            stack.append((name, node, block))
            open_names[name] += 1
            links += name == "a"
        elif kind == "end":
            close({name}, SCOPES - {name} if name in INLINE or name == "p" else ())
        else:
            out.pieces.append((stack[-1][1], ""))
    return out


# Features ------------------------------------------------------------------------------------------


def _names(attributes: str) -> tuple[list[str], bool]:
    """Words of class, id and role, and whether the element is hidden."""
    words, hidden = [], False
    for name, value in _ATTR.findall(" " + attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name in ("class", "id", "role"):
            words += [w for w in _SPLIT.split(value) if w]
    return words, hidden


def _bin(value: np.ndarray, edges: list[float]) -> np.ndarray:
    return np.searchsorted(np.array(edges), value, side="right")


@dataclass
class Forest:
    """Trees of many pages: node features as (node, feature) pairs, edges with their kind."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray  # of the edge to the parent
    node: np.ndarray
    feature: np.ndarray
    first: np.ndarray  # first node of each page


def forest(pages: list[Page]) -> Forest:
    first = np.cumsum([0, *[len(p.parent) for p in pages]])
    total = int(first[-1])
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f)
                             for p, f in zip(pages, first)])
    depth = np.concatenate([np.array(p.depth) for p in pages])
    own, marks, linked = np.zeros(total), np.zeros(total), np.zeros(total)
    node, feature = [], []
    group, names = np.full(total, GROUPS - 1), np.full(total, N_KIND - 1)
    mine = np.zeros((total, N_ABOVE), bool)
    for p, f in zip(pages, first):
        linked[f:f + len(p.parent)] = p.linked
        for n, text in p.pieces:
            if text:
                own[f + n] += len(text)
                marks[f + n] += text.count(". ") + text.count(", ") + text.endswith((".", ". "))
        for n, (name, attributes) in enumerate(zip(p.name, p.attributes)):
            names[f + n] = _KIND.get(name, N_KIND - 1)
            group[f + n] = _EDGE.get(name, GROUPS - 1)
            if name in _AROUND:
                mine[f + n, _AROUND[name]] = True
            if attributes:
                words, hidden = _names(attributes)
                known = {_WORD[w] for w in words if w in _WORD}
                if hidden:
                    known.add(N_WORD - 1)
                hashed = {zlib.crc32(w.encode()) % HASHED for w in words}
                added = [OFFSETS[1] + k for k in known] + [OFFSETS[3] + h for h in hashed]
                node += [f + n] * len(added)
                feature += added
    node, feature = np.array(node, np.int64), np.array(feature, np.int64)
    # Known words and names of the ancestors, one level after the other.
    above = np.zeros((total, N_ABOVE), bool)
    named = (feature >= OFFSETS[1]) & (feature < OFFSETS[2])
    mine[node[named], feature[named] - OFFSETS[1]] = True
    levels = _levels(depth)
    for level in levels[1:]:
        above[level] = above[parent[level]] | mine[parent[level]]
    # Text below each node, and its share of the page.
    text, links = own.copy(), linked.copy()
    for level in levels[:0:-1]:
        np.add.at(text, parent[level], text[level])
        np.add.at(links, parent[level], links[level])
    page = np.repeat(np.arange(len(pages)), np.diff(first))
    share = text / np.maximum(1, text[first[:-1]][page])
    size = np.maximum(1, np.diff(first))[page]
    place = (np.arange(total) - first[:-1][page]) / size
    density = links / np.maximum(1, text)
    shapes = [_bin(own, [1, 12, 40, 100, 300, 1000]), 8 + _bin(text, [1, 40, 200, 1000, 5000]),
              16 + _bin(density, [0.01, 0.2, 0.5, 0.9]), 24 + _bin(marks, [1, 2, 5]),
              32 + _bin(share, [0.02, 0.1, 0.4, 0.7]), 40 + _bin(place, [0.1, 0.3, 0.7, 0.9])]
    every = np.arange(total)
    nodes_above, words_above = np.nonzero(above)
    outer = np.where(parent >= 0, names[np.maximum(parent, 0)], N_KIND - 1)
    node = np.concatenate([node, nodes_above, *[every] * (len(shapes) + 2)])
    feature = np.concatenate([feature, OFFSETS[2] + words_above, OFFSETS[0] + names, OFFSETS[5] + outer,
                              *[OFFSETS[4] + s for s in shapes]])
    kind = np.where(parent >= 0, group[np.maximum(parent, 0)] * GROUPS + group, 0)
    return Forest(parent, depth, kind, node, feature, first)


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])


# The model -----------------------------------------------------------------------------------------


@dataclass
class Model:
    """`weights` of features for being content; `edges` (kind, parent's label, child's label)."""

    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, trees: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each node to be content, and of each (parent, child) pair of labels, by
        sum-product up and down."""
        total = len(trees.parent)
        own = np.zeros((total, 2))
        own[:, 1] = np.bincount(trees.node, self.weights[trees.feature], total)
        pair = self.edges[trees.kind]
        levels = _levels(trees.depth)
        up, belief = np.zeros((total, 2)), own.copy()  # belief: own and what the children say
        for level in levels[:0:-1]:
            sent = np.logaddexp(*np.moveaxis(pair[level] + belief[level][:, None, :], 2, 0))
            up[level] = sent
            np.add.at(belief, trees.parent[level], sent)
        joint = np.zeros((total, 2, 2))
        for level in levels[1:]:
            rest = belief[trees.parent[level]] - up[level]  # all the parent knows from elsewhere
            both = rest[:, :, None] + pair[level] + belief[level][:, None, :]
            joint[level] = both
            belief[level] += np.logaddexp(*np.moveaxis(rest[:, :, None] + pair[level], 1, 0))
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(belief[:, 0] - belief[:, 1])), joint


def fit(trees: Forest, labels: np.ndarray, steps: int = STEPS, rate: float = 0.1,
        decay: float = 2e-4) -> Model:
    """Maximum likelihood with a small quadratic penalty, by gradient ascent with adapted steps. The
    gradient is what the labels count minus what the marginals expect."""
    model = Model(np.zeros(FEATURES), np.zeros((GROUPS * GROUPS, 2, 2)))
    child = trees.parent >= 0
    seen = np.zeros((len(labels), 2, 2))
    seen[child, labels[trees.parent[child]], labels[child]] = 1
    moment = [np.zeros(FEATURES), np.zeros(FEATURES), np.zeros_like(model.edges),
              np.zeros_like(model.edges)]
    for step in range(1, steps + 1):
        content, joint = model.marginals(trees)
        joint[~child] = 0
        down = np.bincount(trees.feature, (labels - content)[trees.node], FEATURES) / len(labels)
        across = np.zeros_like(model.edges)
        np.add.at(across, trees.kind, seen - joint)
        across /= len(labels)
        for k, (value, slope) in enumerate([(model.weights, down), (model.edges, across)]):
            slope = slope - decay * value
            first, second = moment[2 * k], moment[2 * k + 1]
            first += 0.1 * (slope - first)
            second += 0.01 * (slope * slope - second)
            value += rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return model


def text_of(page: Page, content: np.ndarray) -> str:
    """Text of the content nodes: white space inside a block becomes one space, blocks are joined by
    one. References are decoded once."""
    blocks, run = [], []
    for node, text in page.pieces:
        if text is None:
            blocks.append("".join(run))
            run = []
        elif text and content[node]:
            run.append(html.unescape(text) if "&" in text else text)
    blocks.append("".join(run))
    return " ".join(" ".join(b.split()) for b in blocks if b and not b.isspace())


# Labelled pages ---------------------------------------------------------------------------------------

_PARTS = {"article": re.compile(r"<article[^>]*>(.*?)(?:</article>|$)", re.S | re.I),
          "nav": re.compile(r"<nav[^>]*>(.*?)</nav>", re.S | re.I),
          "footer": re.compile(r"<footer[^>]*>(.*?)(?:</footer>|$)", re.S | re.I),
          "aside": re.compile(r'<(?:aside|div class="(?:ad|ads|advert)")[^>]*>(.*?)</(?:aside|div)>',
                              re.S | re.I)}
_TAGS = re.compile(r"<[^>]*>")


def _own_parts(page: str) -> dict[str, str]:
    return {name: found.group(1) for name, pattern in _PARTS.items() if (found := pattern.search(page))}


def relabelled(page: str, pick: random.Random) -> str | None:
    """A page made of the parts that this page's own markup names, in another layout and under other
    names. Content carries data-main="1" on the wrapping element, junk inside it data-main="0"."""
    parts = _own_parts(page)
    if not parts.get("article"):
        return None
    words = _TAGS.sub(" ", parts["article"]).split()
    sentence = lambda a, b: " ".join(pick.choices(words, k=pick.randint(a, b))) if words else "x"
    aside = _TAGS.sub(" ", parts.get("aside") or sentence(4, 14))

    def named(tags, names, inner, main=None):
        tag = pick.choice(tags)
        mark = "" if main is None else f' data-main="{main}"'
        name = pick.choice(names)
        attribute = "" if not name else f' {pick.choice(["class", "class", "id"])}="{name}"'
        return f"<{tag}{attribute}{mark}>{inner}</{tag}>"

    def links(n):
        items = [f'<a href="/{k}">{sentence(1, 4)}</a>' for k in range(n)]
        if pick.random() < 0.6:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return " | ".join(items)

    def notice():
        return named(["div", "section", "aside", "dialog"],
                     ["cookie-notice", "consent", "notice", "alert", "gdpr-banner", "popup", "site-notice"],
                     f"<p>{sentence(5, 25)}.</p><button>{sentence(1, 2)}</button>")

    def advert():
        text = pick.choice([aside, sentence(4, 20) + "."])
        return named(["div", "aside", "section"], ["ad", "ads", "advert", "sponsored", "promo", "ad-slot",
                                                   "banner-ad"], pick.choice([text, f"<p>{text}</p>"]))

    def menu():
        return named(["nav", "nav", "div", "ul"], ["", "menu", "nav", "navbar", "main-navigation",
                                                   "breadcrumbs"], links(pick.randint(3, 9)))

    def header():
        inner = pick.choice([f"<h1>{sentence(1, 4)}</h1>", f'<a href="/">{sentence(1, 3)}</a>',
                             f"<p>{sentence(2, 9)}</p>"])
        if pick.random() < 0.5:
            return named(["header"], ["", "site-header", "masthead"], inner + menu())
        return named(["div"], ["header", "site-header", "masthead", "topbar"], inner + menu())

    def footer():
        inner = pick.choice([parts.get("footer", "&copy;"), f"<p>&copy; {sentence(3, 20)}</p>",
                             links(pick.randint(2, 6)), f"&copy; {sentence(3, 12)}. {sentence(3, 9)}."])
        if pick.random() < 0.6:
            return named(["footer"], ["", "site-footer"], inner)
        return named(["div"], ["footer", "site-footer", "copyright", "colophon"], inner)

    def side():
        inner = pick.choice([f"<h3>{sentence(1, 3)}</h3>" + links(pick.randint(3, 8)),
                             f"<p>{sentence(8, 40)}.</p>", f"<h4>{sentence(1, 3)}</h4><p>{sentence(6, 30)}.</p>"])
        if pick.random() < 0.6:
            return named(["aside"], ["", "sidebar", "related"], inner)
        return named(["div", "section"], ["sidebar", "side", "widget", "related", "recommended"], inner)

    def form():
        inner = (f"<label>{sentence(1, 3)}</label><input name=q>" + pick.choice(["", f"<p>{sentence(3, 15)}</p>"])
                 + f"<button>{sentence(1, 2)}</button>")
        return named(["form"], ["", "search", "newsletter", "subscribe", "login", "contact-form"], inner)

    def comments():
        one = lambda: named(["div", "li", "article", "p"], ["comment", "reply", "", "comment-body"], pick.choice([
            f"{sentence(5, 40)}.", f"<b>{sentence(1, 2)}</b> <p>{sentence(5, 60)}. {sentence(3, 20)}.</p>"]))
        inner = pick.choice(["", f"<h2>{sentence(1, 3)}</h2>", f"<h3>{sentence(1, 3)}</h3>"]) + "".join(
            one() for _ in range(pick.randint(1, 6))) + (form() if pick.random() < 0.3 else "")
        return named(["section", "div", "ol", "aside"], ["comments", "comments", "comment-list", "discussion",
                                                         "responses", "reader-comments"], inner)

    def share():
        return named(["div", "ul"], ["share", "social", "share-buttons", "follow"], links(pick.randint(2, 5)))

    body = parts["article"]
    if pick.random() < 0.2:  # without its heading
        body = re.sub(r"<h1>.*?</h1>", "", body, count=1, flags=re.S)
    if pick.random() < 0.2:  # a short text
        body = re.split(r"</p>", body)[0] + "</p>"
    if pick.random() < 0.3:
        body += pick.choice([f"<blockquote><p>{sentence(5, 40)}.</p></blockquote>",
                             f"<ul><li>{sentence(3, 20)}.</li><li>{sentence(3, 20)}.</li></ul>",
                             f"<h2>{sentence(2, 6)}</h2><p>{sentence(5, 60)}.</p>",
                             f"<ol><li>{sentence(2, 9)}</li><li>{sentence(2, 9)}</li></ol>",
                             f"<pre>{sentence(4, 20)}</pre>",
                             f"<table><tr><th>{sentence(1, 2)}</th><td>{sentence(1, 5)}</td></tr></table>",
                             f"<figure><img src=x><figcaption>{sentence(3, 12)}</figcaption></figure>"])
    if pick.random() < 0.2:
        body = f"<header><h1>{sentence(3, 9)}</h1><p>{sentence(2, 8)}</p></header>".replace(
            "<header", pick.choice(["<header", "<div", "<hgroup"])).replace("header>", "header>") + body
        body = re.sub(r"^<(div|hgroup)(.*?)</header>", r"<\1\2</\1>", body, count=1, flags=re.S)
    if pick.random() < 0.2:
        body = re.sub("<p>", "<div>", body).replace("</p>", "</div>")
    junk = [f() for f in (advert, share, comments, form, side, notice) if pick.random() < 0.12]
    for piece in junk:
        inside = f'<div data-main="0">{piece}</div>' if pick.random() < 0.3 else re.sub(
            r"^<(\w+)", r'<\1 data-main="0"', piece, count=1)
        places = [m.end() for m in re.finditer("</(?:p|div|h1)>", body)]
        at = pick.choice(places) if places and pick.random() < 0.5 else len(body)
        body = body[:at] + inside + body[at:]
    main = named(["article", "article", "article", "div", "main", "section"],
                 ["", "", "article", "content", "post", "entry-content", "post-body", "story", "main",
                  "article-body"], body, main=1)
    while pick.random() < 0.35:
        main = named(["div", "main", "section"], ["", "page", "container", "wrapper", "main", "content"], main)
    around = [(header, 0.5), (menu, 0.7), (advert, 0.4), (notice, 0.35), (form, 0.25), (side, 0.4)]
    before = [f() for f, p in around if pick.random() < p]
    after = [f() for f, p in [(comments, 0.4), (side, 0.35), (form, 0.25), (advert, 0.3), (share, 0.2),
                              (notice, 0.2), (menu, 0.15), (footer, 0.85)] if pick.random() < p]
    inner = "".join(before) + main + "".join(after)
    if pick.random() < 0.3:
        inner = named(["div"], ["", "page", "container", "wrapper"], inner)
    if pick.random() < 0.2:  # a fragment
        return pick.choice([main, inner, f"<body>{main}"])
    return f"<html><head><title>{sentence(1, 6)}</title></head><body>{inner}</body></html>"


def labels_of(page: Page) -> np.ndarray:
    """1 for nodes of the main text: by data-main of the nearest element that has it, else by the
    page's own article."""
    made = any("data-main" in a for a in page.attributes)
    out = np.zeros(len(page.parent), np.int64)
    for n in range(1, len(out)):
        out[n] = out[page.parent[n]]
        if made and "data-main=" in page.attributes[n]:
            out[n] = int('data-main="1"' in page.attributes[n])
        elif not made and page.name[n] == "article":
            out[n] = 1
    return out


def _without_marks(page: Page) -> Page:
    page.attributes = [re.sub(r' data-main="\d"', "", a) for a in page.attributes]
    return page


def trained(pages: DataFrame, sample: int = SAMPLE_PAGES, trained_on: int = TRAINED_ON) -> Model:
    """The model, from at most `sample` pages (least hash of page_id and html first)."""
    hashed = pages.where("html IS NOT NULL").select("html", F.xxhash64("page_id", "html").alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = hashed.where(F.col("h") <= F.lit(least)).groupBy("h").agg(F.first("html").alias("html")).orderBy(
        "h").collect() if least is not None else []
    pick, made = random.Random(7), []
    layouts = trained_on // max(1, len(rows)) - 1
    for row in rows:
        # The parts of one page are bounded, so that training is: a few dozen blocks say enough.
        text = row.html if len(row.html) < 20_000 else row.html[:20_000]
        if _own_parts(text).get("article"):
            made += [text, *[relabelled(text, pick) for _ in range(layouts)]]
    parsed = [parse(p) for p in made]
    if not parsed:
        return Model(np.zeros(FEATURES), np.zeros((GROUPS * GROUPS, 2, 2)))
    labels = np.concatenate([labels_of(p) for p in parsed])
    return fit(forest([_without_marks(p) for p in parsed]), labels)


# Extraction --------------------------------------------------------------------------------------------


def extract(model: Model, pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p or "") for p in pages]
    trees = forest(parsed)
    content = model.marginals(trees)[0] >= 0.5
    return [text_of(p, content[f:]) for p, f in zip(parsed, trees.first)]


def extracted(pages: DataFrame, model: Model, *keep: str) -> DataFrame:
    """_row (the `keep` columns), text and n_chars of each page."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"),
                        F.col("html").cast("string").alias("_html"))
    schema = T.StructType([rows.schema.fields[0], *T.StructType.fromDDL("text string, n_chars long").fields])
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            column = batch.column("_html").to_pylist()
            start, size = 0, 0
            for k in range(1, len(column) + 1):
                size += len(column[k - 1] or "")
                if size < BATCH and k < len(column):
                    continue
                texts = extract(shared.value, column[start:k])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").slice(start, k - start), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], names=schema.names)
                start, size = k, 0

    return rows.mapInArrow(step, schema)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, trained(pages), "page_id", "url").select(
        F.col("_row.page_id").alias("page_id"), F.col("_row.url").alias("url"), "text", "n_chars")


# Takes the article as its own tags name it.
OP11_SQL = r"""
WITH body AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*?)(</article>|$)', 1) AS inner_html
  FROM pages),
bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(inner_html, '</?(p|h[1-6]|br)[^>]*>', ' ', 'g'),
    '<[^>]*>', '', 'g') AS t FROM body),
decoded AS (
  SELECT page_id, url, replace(replace(replace(regexp_replace(t, '&amp;?', chr(1), 'g'),
    '&quot;', '"'), '&lt;', '<'), '&gt;', '>') AS t FROM bare)
SELECT page_id, url, trim(regexp_replace(replace(t, chr(1), '&'), '\s+', ' ', 'g')) AS text,
  CAST(length(trim(regexp_replace(replace(t, chr(1), '&'), '\s+', ' ', 'g'))) AS BIGINT) AS n_chars
FROM decoded
"""

"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree. Each node has potentials from its tag, names, text and links, and each parent-child
edge one from the kinds of its ends; sum-product messages up and down the tree give every node's exact marginal
probability of being content. The weights are those that maximise the likelihood of labelled pages, with the same
messages giving the gradient. The text of the blocks whose marginal is over one half is the page's main text.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick

#: A tag after its "<": slash, name, attributes. Possessive throughout, so a match or a failure reads each character once;
#: a quote belongs to a value only right after "=" and only where it is closed.
TAG = re.compile(r"""(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|[^\t\n\f\r />][^\t\n\f\r />=]*+(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"[^"]*+"|'[^']*+'|[^\t\n\f\r "'>][^\t\n\f\r >]*+)?+)?+)*+)>""")
COMMENT_END = re.compile(r"--!?>")
NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Element names of HTML by what they do to the tree.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head title template noscript textarea select option button svg iframe object canvas audio video datalist".split())
RAW = frozenset("script style textarea title".split())
HEAD = frozenset("html head base basefont bgsound link meta title script style noscript template noframes".split())
BLOCKS = ("html body main article section div nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot caption tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog hgroup center").split()
BLOCK = {name: i for i, name in enumerate(BLOCKS)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES_P = frozenset(BLOCKS) - {"html", "body"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "p": ("td", "th", "table", "li", "div", "section", "article", "body")}
KIND_OF = {**dict.fromkeys("nav header footer aside form fieldset dialog address".split(), 0), **dict.fromkeys("article main".split(), 1), **dict.fromkeys("html body div section center details figure hgroup".split(), 2), **dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption summary".split(), 3)}
KINDS = 5
#: Parts of class, id and role names, by what they tell.
HINTS = {
    "menu": "nav menu breadcrumb toolbar tabs pager pagination sitemap skip",
    "head": "header masthead banner topbar logo hero-nav",
    "foot": "footer copyright legal bottom imprint colophon",
    "side": "sidebar side aside rail related recommend widget trending popular promo-list",
    "ad": "ad ads advert advertisement sponsor sponsored promo commercial",
    "notice": "cookie consent notice alert gdpr newsletter subscribe popup modal overlay paywall signup",
    "comment": "comment comments disqus reply replies respond discussion",
    "form": "form search login signin register",
    "share": "share social follow tags meta byline author date toolbox",
    "content": "content article post entry story body text main maincontent articlebody prose",
}
_HINT_OF = {word: i for i, (_, words) in enumerate(HINTS.items()) for word in words.split()}
NUMERIC = 13
WIDTH = len(BLOCKS) + len(HINTS) + NUMERIC + 1
LABEL = "data-content"
#: Elements nested deeper become children of the last element at this depth, as in browsers; their text stays.
DEEPEST = 512


class Page:
    """The block tree of a page, in page order: per node parent, tag, hint numbers, and (node, text, text in links) runs."""

    __slots__ = ("depth", "hints", "label", "parent", "runs", "tag")

    def __init__(self) -> None:
        self.parent, self.depth, self.tag, self.hints, self.label = [-1], [0], [BLOCK["html"]], [()], [0]
        self.runs: list[list] = []


def _hints(attributes: str) -> tuple[int, ...]:
    found = set()
    for m in NAMES.finditer(attributes):
        for word in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()):
            k = _HINT_OF.get(word)
            if k is not None:
                found.add(k)
    return tuple(found)


def _letter(c: str) -> bool:
    return c.isascii() and c.isalpha()


def tags(html: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(text before, slash, name, attributes, place after) of every tag, and the rest as text without a name; in linear time.

    Comments, declarations and instructions go, as do a comment or a tag that the page's end cuts off. A "<" that opens
    nothing is text. send() a place to go on there instead.
    """
    at, seek, n = 0, 0, len(html)
    pieces: list[str] = []
    while True:
        lo = html.find("<", seek)
        c = html[lo + 1 : lo + 2] if lo >= 0 else ""
        if lo >= 0 and not (c in ("!", "?", "/") or _letter(c)):
            seek = lo + 1
            continue
        pieces.append(html[at : lo if lo >= 0 else n])
        if lo < 0:
            yield "".join(pieces), "", "", "", n
            return
        m = TAG.match(html, lo + 1) if c not in ("!", "?") else None
        if m is None:
            if html.startswith("<!--", lo):
                short = 5 if html.startswith(">", lo + 4) else 6 if html.startswith("->", lo + 4) else 0
                end = COMMENT_END.search(html, lo + 4) if not short else None
                at = lo + short if short else end.end() if end else n
            elif c in ("!", "?") or (c == "/" and not _letter(html[lo + 2 : lo + 3])):
                at = html.find(">", lo) + 1 or n
            else:  # a tag that never ends
                at = n
            seek = at
            continue
        at = seek = m.end()
        to = yield "".join(pieces), m[1], m[2].lower(), m[3], at
        pieces = []
        if to is not None:
            at = seek = to
            yield "", "", "", "", at  # what send() returns


class Open:
    """The open elements: (name, node), and where each name stands, so that the nearest one is known without a walk."""

    __slots__ = ("at", "items")

    def __init__(self) -> None:
        self.items: list[tuple[str, int]] = []
        self.at: dict[str, list[int]] = {}

    def push(self, name: str, node: int) -> None:
        self.at.setdefault(name, []).append(len(self.items))
        self.items.append((name, node))

    def pop(self) -> str:
        name = self.items.pop()[0]
        self.at[name].pop()
        return name

    def nearest(self, names: tuple) -> int:
        """Place of the innermost open element of names, -1 if there is none."""
        return max([w[-1] for x in names if (w := self.at.get(x))], default=-1)


def parse(html: str, labelled: bool = False) -> Page:
    """Block tree of any string; tags left open close by HTML's rules, stray ones are ignored. Time is linear in its length."""
    page = Page()
    page.label[0] = int(labelled and f"<!--{LABEL}-->" in html)
    stack, unseen = Open(), Open()
    stack.push("html", 0)
    links = 0
    run: list | None = None  # the open run: node, pieces, characters in links
    runs = page.runs

    def text(piece: str) -> None:
        nonlocal run
        if unseen.items and unseen.items[-1][0] == "head" and piece.strip(" \t\n\r\f"):  # text ends a head
            unseen.pop()
        if not piece or unseen.items:
            return
        if "&" in piece:
            piece = entities.unescape(piece)
        if run is None:
            run = [stack.items[-1][1], [], 0]
            runs.append(run)
        run[1].append(piece)
        if links:
            run[2] += len(piece.strip())

    def close(to: int) -> None:
        nonlocal links, run
        while len(stack.items) > to:
            name = stack.pop()
            if name == "a":
                links -= 1
            elif name in BLOCK:
                run = None

    def close_open(names: tuple, scope: tuple, every: bool) -> None:
        """Close the innermost open element of names (or all of them), unless an element of scope is nearer."""
        edge = stack.nearest(scope)
        while (k := stack.nearest(names)) > max(edge, 0):
            close(k)
            if not every:
                break

    def foreign(name: str) -> bool:
        return name == "math" or stack.nearest(("math",)) > 0

    scan = tags(html)
    for before, slash, name, attributes, after in scan:
        if before:
            text(before)
        if not name:
            continue
        if slash:
            if unseen.items:
                if unseen.at.get(name):
                    while unseen.pop() != name:
                        pass
                elif name in ("body", "html"):
                    while unseen.items:
                        unseen.pop()
                continue
            if name not in ("html", "body") and (k := stack.nearest((name,))) > 0:
                close(k)
            continue
        if unseen.items and unseen.items[-1][0] == "head":
            if name not in HEAD:  # so does what cannot stand in it
                unseen.pop()
            elif name == "noframes":
                unseen.push(name, 0)
                continue
            elif name == "head":
                continue
        if name in UNSEEN:
            if name in RAW:
                end = _raw_end(name).search(html, after)
                tail = TAG.match(html, end.start() + 1) if end else None
                scan.send(tail.end() if tail else len(html))
            elif not (name == "svg" and attributes.rstrip().endswith("/")):  # only foreign elements close themselves
                unseen.push(name, 0)
            continue
        if unseen.items:
            if name != "body":
                continue
            while unseen.items:  # a head that was never closed
                unseen.pop()
        if name in ("br", "hr", "wbr", "img"):
            if name != "wbr":
                text(" ")
            if name == "hr":
                run = None
            continue
        if name in VOID or name == "html":
            continue
        if name in BLOCK:
            if name == "body" and stack.at.get("body"):
                continue
            if name in CLOSES_P:
                close_open(("p",), SCOPE["p"], False)
            if name in SIBLINGS:
                close_open(SIBLINGS[name], SCOPE[name], True)
            top = stack.items[-1][0]
            if name in HEADINGS and top in HEADINGS and top != name:
                close(len(stack.items) - 1)
            run = None
            up = stack.items[-1][1]
            if page.depth[up] >= DEEPEST:
                up = page.parent[up]
            page.parent.append(up)
            page.depth.append(page.depth[up] + 1)
            page.tag.append(BLOCK[name])
            page.hints.append(_hints(attributes) if attributes else ())
            page.label.append(int(labelled and LABEL in attributes))
            stack.push(name, len(page.parent) - 1)
        elif not (foreign(name) and attributes.rstrip().endswith("/")):  # of HTML's own elements the slash says nothing
            if name == "a":
                links += 1
            stack.push(name, stack.items[-1][1])
    return page


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I)


class Forest:
    """The trees of many pages as arrays, with features, ready for messages."""

    def __init__(self, pages: list[Page]):
        counts = [len(p.parent) for p in pages]
        self.first = np.r_[0, np.cumsum(counts)]
        n = int(self.first[-1])
        base = np.repeat(self.first[:-1], counts)
        parent = np.fromiter((v for p in pages for v in p.parent), np.int64, n)
        self.parent = np.where(parent < 0, -1, parent + base)
        self.depth = np.fromiter((v for p in pages for v in p.depth), np.int64, n)
        tag = np.fromiter((v for p in pages for v in p.tag), np.int64, n)
        kind = np.array([KIND_OF.get(name, 4) for name in BLOCKS])[tag]
        self.label = np.fromiter((v for p in pages for v in p.label), np.int64, n)
        self.texts: list[list[tuple[int, str]]] = []
        own, link, stops, words = (np.zeros(n) for _ in range(4))
        for p, lo in zip(pages, self.first.tolist(), strict=False):
            rows = []
            for node, pieces, linked in p.runs:
                s = " ".join("".join(pieces).split())
                if s:
                    rows.append((lo + node, s))
                    own[lo + node] += len(s)
                    link[lo + node] += min(linked, len(s))
                    stops[lo + node] += s.count(".") + s.count(",") + s.count("。")
                    words[lo + node] += s.count(" ") + 1
            self.texts.append(rows)
        by_depth = np.argsort(self.depth, kind="stable")
        self.levels = np.split(by_depth, np.searchsorted(self.depth[by_depth], np.arange(1, int(self.depth.max(initial=0)) + 1)))
        below, below_link, below_stops = own.copy(), link.copy(), stops.copy()
        for level in reversed(self.levels[1:]):
            for a in (below, below_link, below_stops):
                np.add.at(a, self.parent[level], a[level])
        total = np.maximum(below[self.first[:-1]], 1)[np.repeat(np.arange(len(pages)), counts)] if n else np.zeros(0)
        place = (np.arange(n) - base) / np.maximum(1, np.repeat(counts, counts) - 1)
        x = np.zeros((n, WIDTH), dtype=np.float32)
        x[np.arange(n), tag] = 1
        at = len(BLOCKS)
        for p, lo in zip(pages, self.first.tolist(), strict=False):
            for i, hints in enumerate(p.hints):
                for k in hints:
                    x[lo + i, at + k] = 1
        at += len(HINTS)
        density = below_link / np.maximum(1, below)
        numeric = (np.log1p(own) / 6, np.log1p(below) / 8, density, density > 0.6, density < 0.1, below_stops / np.maximum(1, below) * 20, np.log1p(words) / 5, below / total, place < 0.15, place > 0.85, (own > 0) & (own < 40), own > 200, below == 0)
        for k, v in enumerate(numeric):
            x[:, at + k] = v
        x[:, -1] = 1
        self.x = x
        self.edge = np.where(self.parent >= 0, kind[self.parent] * KINDS + kind, 0)


def messages(forest: Forest, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product, in logs: node marginals (n, 2), edge marginals (n, parent state, child state), sum of log Z."""
    n = len(unary)
    up = unary.copy()
    to_parent = np.zeros((n, 2))
    for level in reversed(forest.levels[1:]):
        t = pair[forest.edge[level]] + up[level][:, None, :]
        to_parent[level] = np.logaddexp(t[:, :, 0], t[:, :, 1])
        np.add.at(up, forest.parent[level], to_parent[level])
    belief = up.copy()  # what the whole tree says of a node
    joint = np.zeros((n, 2, 2))
    roots = forest.levels[0]
    log_z = np.logaddexp(up[roots, 0], up[roots, 1])
    for level in forest.levels[1:]:
        rest = belief[forest.parent[level]] - to_parent[level]
        t = rest[:, :, None] + pair[forest.edge[level]] + up[level][:, None, :]
        belief[level] = np.logaddexp(t[:, 0], t[:, 1])
        top = t.max(axis=(1, 2), keepdims=True)
        e = np.exp(t - top)
        joint[level] = e / e.sum(axis=(1, 2), keepdims=True)
    z = np.logaddexp(belief[:, 0], belief[:, 1])
    return np.exp(belief - z[:, None]), joint, float(log_z.sum())


class ContentModel:
    def __init__(self) -> None:
        self.w = np.zeros(WIDTH)
        self.pair = np.zeros((KINDS * KINDS, 2, 2))

    def unary(self, forest: Forest) -> np.ndarray:
        s = forest.x @ self.w
        return np.stack([-s / 2, s / 2], axis=1)

    def fit(self, forest: Forest, steps: int = 250, rate: float = 0.08, ridge: float = 2e-3) -> ContentModel:
        """Maximum likelihood with Adam: the gradient is what the labels show less what the marginals expect."""
        y = forest.label
        n = len(forest.first) - 1
        child = np.flatnonzero(forest.parent >= 0)
        seen = np.zeros_like(self.pair)
        np.add.at(seen, (forest.edge[child], y[forest.parent[child]], y[child]), 1)
        state = [[np.zeros_like(v), np.zeros_like(v)] for v in (self.w, self.pair)]
        for t in range(1, steps + 1):
            p, joint, _ = messages(forest, self.unary(forest), self.pair)
            g_w = forest.x.T @ (y - p[:, 1]) / n - ridge * self.w
            g_pair = seen.copy()
            np.subtract.at(g_pair, forest.edge[child], joint[child])
            g_pair = g_pair / n - ridge * self.pair
            for v, g, (m, s) in zip((self.w, self.pair), (g_w, g_pair), state, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.999
                s += 0.001 * g * g
                v += rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        return self

    def marginals(self, forest: Forest) -> np.ndarray:
        return messages(forest, self.unary(forest), self.pair)[0][:, 1]

    def blocks(self, htmls: list[str]) -> list[list[tuple[str, float]]]:
        """Each page's blocks with text, in page order, with their probability of being content."""
        if not htmls:
            return []
        forest = Forest([parse(h) for h in htmls])
        p = self.marginals(forest)
        return [[(s, float(p[node])) for node, s in rows] for rows in forest.texts]

    def main_texts(self, htmls: list[str]) -> list[str]:
        return ["\n\n".join([s for s, p in rows if p > 0.5]) for rows in self.blocks(htmls)]


# ---------------------------------------------------------------------------------------------- labelled pages


def labelled_pages(n: int = 420, seed: int = 5) -> list[str]:
    """Generated pages whose content elements carry the label attribute: many layouts, names and lengths."""
    rng = random.Random(seed)
    syllables = "an be con der es fi gan hel in jo ka li mor nu ost pra qui ra sen to un vi wer xa yo zu èn ß ció".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda a=4, b=18: words(a, b).capitalize() + rng.choice(".....!?")
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    items = lambda k: "".join(f"<li>{link()}</li>" for _ in range(k))
    named = lambda tag, names, body: f'<{tag} {rng.choice(("class", "id"))}="{rng.choice(names.split())}">{body}</{tag}>'
    copy = lambda: f"&copy; {word()}.example &middot; {prose(1, 2)}"
    keep = f" {LABEL}"

    def nav() -> str:
        body = rng.choice(("<ul>{}</ul>", "{}")).format(items(rng.randint(2, 9)))
        return f"<nav>{body}</nav>" if rng.random() < 0.6 else named("div", "nav menu main-menu navbar breadcrumb top-menu", body)

    def advert() -> str:
        return named(rng.choice(("div", "div", "section", "aside")), "ad ads advert ad-slot sponsored promo ad-box", rng.choice((prose(1, 2), f"<p>{prose(1, 2)}</p>", link() + " " + words(2, 6))))

    def notice() -> str:
        return named(rng.choice(("div", "section", "dialog")), "cookie-notice cookie consent gdpr newsletter-signup notice alert", f"<p>{prose(1, 2)}</p>" + (f"<p>{link()}</p>" if rng.random() < 0.5 else ""))

    def head() -> str:
        body = rng.choice((f"<h2>{words(1, 4)}</h2>", f"<div>{link()}</div>", f"<p>{words(2, 6)}</p>", f"<p>{prose(1, 2)}</p>"))
        return f"<header>{body}{nav() if rng.random() < 0.4 else ''}</header>" if rng.random() < 0.6 else named("div", "header masthead site-header topbar", body)

    def foot() -> str:
        body = rng.choice((copy(), f"<p>{copy()}</p>", f"<ul>{items(3)}</ul><p>{copy()}</p>", f"<div>{prose(1, 3)}</div>"))
        return f"<footer>{body}</footer>" if rng.random() < 0.7 else named("div", "footer site-footer bottom copyright", body)

    def side() -> str:
        body = rng.choice((f"<h3>{words(1, 3)}</h3><ul>{items(4)}</ul>", f"<p>{prose(1, 2)}</p>", f"<h3>{words(1, 3)}</h3><p>{prose(1, 2)}</p>"))
        return f"<aside>{body}</aside>" if rng.random() < 0.5 else named("div", "sidebar side-bar related widget recommended", body)

    def form() -> str:
        return f"<form>{rng.choice(('<p>' + words(2, 5) + '</p>', '<div>' + words(1, 3) + '</div>', words(1, 4)))}<input><button>{word()}</button></form>"

    def comments() -> str:
        one = lambda: rng.choice((f"<li><p>{prose(1, 3)}</p></li>", f"<p>{prose(1, 3)}</p>", f"<div class=\"comment\"><p>{prose(1, 3)}</p></div>"))
        return named(rng.choice(("section", "div")), "comments comment-list discussion responses-comments", f"<h3>{words(1, 2)}</h3>" + "".join(one() for _ in range(rng.randint(1, 5))))

    def part() -> str:
        r = rng.random()
        short = prose(1, 1) if rng.random() < 0.3 else prose(1, 8)
        if r < 0.62:
            return rng.choice((f"<p{keep}>{short}</p>", f"<p{keep}><b>{short}<br>", f"<p{keep}>{short} {link()} {prose(1, 2)}</p>", f"<p{keep}>{words(1, 3)}</p>", f"<p{keep}>{short}"))
        if r < 0.74:
            return f"<h{rng.randint(2, 4)}{keep}>{words(1, 6)}</h{rng.randint(2, 2)}>" if rng.random() < 0.1 else f"<h2{keep}>{words(1, 6)}</h2>"
        if r < 0.84:
            return f"<ul{keep}>" + "".join(f"<li{keep}>{prose(1, 2) if rng.random() < 0.6 else words(1, 5)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>"
        if r < 0.9:
            return f"<blockquote{keep}>{rng.choice((f'<p{keep}>{prose()}</p>', prose()))}</blockquote>"
        if r < 0.95:
            return f"<table{keep}>" + "".join(f"<tr{keep}>" + "".join(f"<td{keep}>{words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        return f"<div{keep}>{prose()}</div>"

    def article() -> str:
        body = (f"<h1{keep}>{words(2, 10)}</h1>" if rng.random() < 0.85 else "") + "".join(part() for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))))
        inner = [advert, comments, notice, lambda: named("div", "share social byline tags", rng.choice((link() + link(), words(2, 5))))]
        if rng.random() < 0.3:
            body += rng.choice(inner)()
        r = rng.random()
        if r < 0.5:
            return f"<article{keep}>{body}</article>"
        if r < 0.65:
            return f"<main{keep}>{body}</main>"
        if r < 0.75:
            return f'<main{keep}><div class="{rng.choice(("content", "wrap", "container"))}"{keep}>{body}</div></main>'
        if r < 0.93:
            return f'<div {rng.choice(("class", "id"))}="{rng.choice(("content", "post", "entry-content", "article-body", "story", "main-content"))}"{keep}>{body}</div>'
        return f"<div{keep}>{body}</div>"

    pages = []
    for _ in range(n // 12):  # bare texts, with and without paragraphs
        pages.append(f"<!--{LABEL}-->" + prose(1, 9))
        pages.append(f"<p{keep}>{words(1, 3)}" + "".join(f"<p{keep}>{prose(1, 3)}" for _ in range(rng.randint(0, 3))))
        pages.append("<html><body>" + (nav() if rng.random() < 0.5 else "") + (f"<h1{keep}>{words(1, 6)}</h1>" if rng.random() < 0.5 else "") + "".join(part() for _ in range(rng.randint(1, 4))) + (foot() if rng.random() < 0.5 else "") + "</body></html>")
    for _ in range(n):
        before = [f() for f in (nav, head, advert, notice, form, side) if rng.random() < 0.45]
        after = [f() for f in (comments, side, advert, form, notice) if rng.random() < 0.35]
        rng.shuffle(before)
        body = "".join(before) + article() + "".join(after) + (foot() if rng.random() < 0.85 else "")
        if rng.random() < 0.25:
            body = f'<div class="{rng.choice(("wrapper", "page", "container", "site"))}">{body}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{}}</style></head><body>{body}</body></html>")
    return pages


@cache
def fit() -> ContentModel:
    return ContentModel().fit(Forest([parse(p, labelled=True) for p in labelled_pages()]))


def main_text(df: DataFrame, model: ContentModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: page_id, url, text, n_chars (code points).

    Null and empty html, and pages without content, give an empty text. Whole pages are read whatever their length or
    depth, in time linear in the length whatever the markup (a page of 1 MB takes seconds). As in browsers, a comment, tag,
    script or style that the page's end cuts off goes with what it holds. Rows are independent, so repeated rows and null
    ids come back as they are.
    """
    kind = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = model.main_texts([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(df, id_col, url_col, html_col).mapInArrow(run, f"page_id {kind[id_col]}, url {kind[url_col]}, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), fit())

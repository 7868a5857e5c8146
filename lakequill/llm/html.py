"""Main text of HTML pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of elements. Each element gets features: its tag, tokens of class, id and role, depth,
place among its siblings, and how dense its subtree is in text, links, marks and paragraphs. Boosted trees give each
element the odds of being main text or around it. Decoding is hierarchical: the labels of a page's elements together
are the likeliest ones in which no kept element is below a dropped one.

The trees are trained on pages that this module writes, with known labels, on the driver; a model has some thousand
numbers.

Results for odd input: a null or empty page has empty text; text outside any element of the body counts as main text;
unclosed and stray tags are mended as browsers do in simple cases; a head that isn't closed ends at the first element or
text of a body; an element that is kept and dropped with equal odds is kept; rows repeat as they come, equal pages with
equal texts; an empty table gives an empty result; other columns are ignored, whatever their names. Nothing is cut off,
and pages of any length, broken as they may be, take time in proportion.
"""

from __future__ import annotations

import bisect
import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches

TREES, DEPTH, RATE, BINS, LEAST_ROWS = 40, 4, 0.3, 32, 10
PORTION_PAGES = 250

_TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_UNQUOTED = re.compile(r"[^\"'>]*")
#: A tag that the end of the page cuts off.
_CUT = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")

# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "iframe", "textarea", "title"}
#: Elements whose text isn't text of the page.
SKIPPED = {"template", "svg", "math", "object", "select"}
HEAD = {"title", "meta", "link", "base", "script", "style", "noscript", "template", "html"}
#: Start tags that end an unclosed drawing, formula or selection.
BREAKOUT = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "blockquote", "pre", "article", "section", "main", "nav", "header", "footer", "aside", "form"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img", "button"}
PHRASE = INLINE - {"button", "label"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main", "aside", "nav", "footer", "header", "td", "th"}

_TAGS = {name: k for k, name in enumerate("article main section div p h1 h2 h3 h4 ul ol li a nav header footer aside form table tr td blockquote pre figure figcaption button span dl details".split(), 1)}
_GOOD = {"article", "content", "post", "entry", "main", "story", "text", "body", "prose", "chapter", "page"}
_BAD = {
    "nav": 0, "menu": 0, "navbar": 0, "breadcrumb": 0, "breadcrumbs": 0, "pagination": 0, "pager": 0, "toolbar": 0, "navigation": 0,
    "ad": 1, "ads": 1, "advert": 1, "advertisement": 1, "banner": 1, "sponsor": 1, "sponsored": 1, "promo": 1, "promotion": 1, "adsbox": 1,
    "footer": 2, "copyright": 2, "legal": 2, "contentinfo": 2, "foot": 2,
    "header": 3, "masthead": 3, "topbar": 3, "logo": 3, "hero": 3,
    "sidebar": 4, "aside": 4, "related": 4, "widget": 4, "rail": 4, "complementary": 4, "recommended": 4, "popular": 4, "trending": 4,
    "cookie": 5, "cookies": 5, "consent": 5, "notice": 5, "gdpr": 5, "alert": 5, "popup": 5, "modal": 5, "overlay": 5, "dialog": 5,
    "form": 6, "login": 6, "search": 6, "subscribe": 6, "newsletter": 6, "signup": 6, "register": 6,
    "comment": 7, "comments": 7, "reply": 7, "replies": 7, "respond": 7, "discussion": 7, "disqus": 7, "commentlist": 7,
    "share": 8, "social": 8, "tags": 8, "byline": 8, "meta": 8, "follow": 8, "author": 8,
}
_KINDS = 9


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "children", "items", "chars", "linked", "marks", "paragraphs", "below", "nth", "hidden", "at")

    def __init__(self, tag: str, parent: int, depth: int, attributes: str, nth: int, at: int):
        self.tag, self.parent, self.depth, self.nth, self.at = tag, parent, depth, nth, at
        self.children: list[int] = []
        self.items: list = []  # texts, and numbers of child elements
        self.chars = self.linked = self.marks = self.paragraphs = self.below = 0
        self.tokens: list[str] = []
        self.hidden = False
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
                if name in ("class", "id", "role"):
                    self.tokens += _TOKEN.findall(value)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.hidden = True


class Tags:
    """The tags of a page, in time in proportion to it however they are broken."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = True  # until one isn't closed before the page ends
        self.closes: dict[str, tuple[list[int], list[int]]] = {}
        self.unbalanced: set[str] = set()

    def _end(self, at: int) -> int:
        """Place of the > that closes the tag whose attributes start here, or -1; quotes open after = alone."""
        page, k = self.page, at
        while self.quotes:
            k = _UNQUOTED.match(page, k).end()
            if k == len(page):
                self.quotes = False
            elif page[k] == ">":
                return k
            else:
                before = k - 1
                while before >= at and page[before].isspace():
                    before -= 1
                if before < at or page[before] != "=":
                    k += 1
                elif (k := page.find(page[k], k + 1) + 1) == 0:
                    self.quotes = False
        return page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Start and end, slash, name and attributes of the next tag; the name is empty for comments and declarations."""
        page = self.page
        m = _TAG.search(page, at)
        if m is None:
            return None
        if m[2] is not None:
            end = self._end(m.end())
            return None if end < 0 else (m.start(), end + 1, m[1], m[2].lower(), page[m.end() : end])
        mark = "-->" if m[0] == "<!--" else ">"
        end = page.find(mark, m.end())
        if end < 0 and mark == ">":
            return None
        return m.start(), len(page) if end < 0 else end + len(mark), "", "", ""

    def close(self, name: str, at: int) -> int:
        """The end of the next end tag of a name, or -1."""
        if name not in self.closes:
            found = [m.span() for m in re.finditer(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", self.page, re.I)]
            self.closes[name] = [x for x, _ in found], [x for _, x in found]
        starts, ends = self.closes[name]
        k = bisect.bisect_left(starts, at)
        return ends[k] if k < len(ends) else -1

    def after(self, name: str, at: int) -> int:
        """The end of an element whose start tag ends here and whose content is no text of the page.

        An element that is never closed ends at once, but for scripts and styles, which take the rest as browsers do.
        Elements that are closed too seldom end at the next close, drawings and the like at the next block before it.
        """
        end = self.close(name, at)
        if end < 0:
            return len(self.page) if name in ("script", "style") else at
        if name in SKIPPED and name not in self.unbalanced:
            depth = 1
            for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*>", re.I).finditer(self.page, at):
                depth += -1 if m[1] else not m[0].endswith("/>")
                if not depth:
                    return m.end()
            self.unbalanced.add(name)
        if name in SKIPPED - {"template", "object"}:
            block = re.compile(rf"<(?:{'|'.join(sorted(BREAKOUT))})(?=[\s/>])", re.I).search(self.page, at, end)
            end = block.start() if block else end
        return end


def parse(page: str) -> list[Node]:
    """Elements in page order; the first is the root. Text is decoded; markup that holds no text is gone."""
    nodes = [Node("#root", -1, 0, "", 0, 0)]
    stack, in_head, tags = [0], False, Tags(page)
    places: defaultdict[str, list[int]] = defaultdict(list)  # of each tag on the stack; "" is for all that aren't inline

    def text(piece: str) -> None:
        nonlocal in_head
        if in_head and piece.strip():  # an open head ends at the first text
            in_head = False
        if piece and not in_head:
            nodes[stack[-1]].items.append(html.unescape(piece) if "&" in piece else piece)

    def place(names) -> int:
        return max((places[x][-1] for x in names if places[x]), default=0)

    def close_to(names, scope) -> None:
        """Closes the innermost element of these names, unless one of the scope is within it."""
        k = place(names)
        if k and k > place(scope):
            for x in stack[k:]:
                tag = nodes[x].tag
                places[tag].pop()
                if tag not in INLINE:
                    places[""].pop()
            del stack[k:]

    at = 0
    while (found := tags.next(at)) is not None:
        start, end, slash, name, attributes = found
        text(page[at:start])
        at = end
        if not name:
            continue
        if slash:
            if name == "head":
                in_head = False
            elif name in INLINE:
                close_to((name,), ("",))
            elif name not in VOID and name not in ("html", "body"):
                close_to((name,), {"td", "th"} - {name} if name not in ("table", "tr", "tbody", "thead") else ())
            continue
        if name == "head":
            in_head = len(nodes) == 1
            continue
        in_head = in_head and name in HEAD
        if name in ("html", "body", "meta", "link", "base"):
            if name == "body":
                nodes[0].tokens += Node("", 0, 0, attributes, 0, 0).tokens if attributes else []
            continue
        if name in RAW or name in SKIPPED:
            if not attributes.rstrip().endswith("/") or name in RAW - {"iframe"}:
                at = tags.after(name, at)
            continue
        if name in VOID:
            text(" ")
            continue
        if name in CLOSES_P:
            close_to(("p",), SCOPE)
        if name in SAME:
            close_to(SAME[name], {"ul", "ol", "dl", "table"})
        parent = stack[-1]
        k = len(nodes)
        nodes.append(Node(name, parent, len(stack), attributes, len(nodes[parent].children), k))
        nodes[parent].children.append(k)
        nodes[parent].items.append(k)
        places[name].append(len(stack))
        if name not in INLINE:
            places[""].append(len(stack))
        stack.append(k)
    text(_CUT.sub("", page[at:]))
    return nodes


def _category(tokens: list[str]) -> tuple[int, int]:
    """Number of good tokens, and a bit for each kind of bad ones."""
    good = bad = 0
    for t in tokens:
        if t in _GOOD:
            good += 1
        elif t in _BAD:
            bad |= 1 << _BAD[t]
    return good, bad


FEATURES = ["tag", "good", "good_above", "hidden", "depth", "siblings", "nth", "alike", "chars", "linked", "marks", "paragraphs", "below", "mean", "share", "place", "after", "boiler_tag", "boiler_above", "text_tag_above", "parent_tag", *(f"bad{k}" for k in range(_KINDS)), *(f"above{k}" for k in range(_KINDS))]
_BOILER = {"nav", "header", "footer", "aside", "form", "button"}


def features(nodes: list[Node]) -> np.ndarray:
    """A row for each element but the root."""
    for n in nodes:
        n.chars = n.marks = n.linked = n.paragraphs = n.below = 0
    for n in reversed(nodes):
        for x in n.items:
            if isinstance(x, str):
                n.chars += len(x) - x.count(" ")
                n.marks += x.count(".") + x.count(",")
        if n.tag == "a":
            n.linked = n.chars
        if n.tag == "p":
            n.paragraphs += 1
        if n.parent >= 0:
            up = nodes[n.parent]
            up.chars += n.chars
            up.marks += n.marks
            up.linked += n.linked
            up.paragraphs += n.paragraphs
            up.below += n.below + 1
    total, count = max(1, nodes[0].chars), len(nodes)
    # of each element: good tokens, bad kinds, boilerplate tags and article tags at or above it
    state = [(*_category(nodes[0].tokens), 0, 0)]
    kinds = [Counter(nodes[c].tag for c in n.children) for n in nodes]
    out = np.zeros((count - 1, len(FEATURES)), np.float32)
    for k in range(1, count):
        n = nodes[k]
        up_good, up_bad, up_boiler, up_text = state[n.parent]
        good, bad = _category(n.tokens)
        boiler = int(n.tag in _BOILER)
        siblings = nodes[n.parent].children
        alike = kinds[n.parent][n.tag]
        row = [
            _TAGS.get(n.tag, 0), good, up_good, n.hidden, n.depth, len(siblings), n.nth, alike, math.log1p(n.chars), n.linked / max(1, n.chars), n.marks / max(1, n.chars) * 100,
            math.log1p(n.paragraphs), math.log1p(n.below), math.log1p(n.chars / (n.below + 1)), n.chars / total, k / count, n.nth / len(siblings), boiler, up_boiler, up_text + (n.tag in ("article", "main")), _TAGS.get(nodes[n.parent].tag, 0),
        ]
        out[k - 1, : len(row)] = row
        if bad or up_bad:
            for b in range(_KINDS):
                out[k - 1, len(row) + b] = bad >> b & 1
                out[k - 1, len(row) + _KINDS + b] = up_bad >> b & 1
        state.append((up_good + good, up_bad | bad, up_boiler + boiler, up_text + (n.tag in ("article", "main"))))
    return out


class Trees:
    """Boosted regression trees of logistic loss; tests are feature > threshold, nodes in heap order."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Fits trees level by level on histograms, by Newton steps."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)  # bin > b means x > edges[b]
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = math.log(p0 / (1 - p0))
    score, inner = np.full(len(y), base), 2**DEPTH - 1
    feature, threshold, value = (np.zeros((TREES, k), t) for k, t in ((inner, np.int64), (inner, np.float32), (2**DEPTH, np.float64)))
    threshold[:] = np.inf
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            pick = {}
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                code, n = local * (BINS + 1) + binned[:, j], width * (BINS + 1)
                sums = [np.bincount(code, w, n).reshape(width, BINS + 1) for w in (g, h, None)]
                (gl, hl, cl), (gt, ht, ct) = [s.cumsum(1) for s in sums], [s.sum(1, keepdims=True) for s in sums]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(cl < LEAST_ROWS) | (ct - cl < LEAST_ROWS)] = 0
                b = gain[:, : len(e)].argmax(1)
                top = gain[np.arange(width), b]
                for k in np.flatnonzero(top > best):
                    best[k], pick[k] = top[k], (j, b[k])
            for k, (j, b) in pick.items():
                feature[tree, first + k], threshold[tree, first + k] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[tree, at]] > threshold[tree, at])
        leaf = at - inner
        value[tree] = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        score += value[tree, leaf]
    return Trees(base, feature, threshold, value)


# the labelled pages


def training_page(r: random.Random) -> str:
    """A page whose words tell their label: those of main text start with k, all others with x."""

    def words(n: int, mark: str) -> str:
        out = []
        while len(out) < n:
            s = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(1, 9))) for _ in range(min(n - len(out), r.randint(4, 14)))]
            s[-1] += "."
            if len(s) > 6 and r.random() < 0.5:
                s[3] += ","
            out += s
        return " ".join(mark + w for w in out)

    def links(mark: str = "x") -> str:
        item = lambda: f'<a href="/{r.randint(1, 99)}">{words(r.randint(1, 3), mark)}</a>'
        n = r.randint(3, 9)
        return "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + "</ul>" if r.random() < 0.7 else " | ".join(item() for _ in range(n))

    def wrap(tag: str, names: list[str], inner: str) -> str:
        attribute = r.choice(["class", "class", "id", "role"])
        name = r.choice(names)
        return f'<{tag} {attribute}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def prose(n: int, mark: str) -> str:
        return "".join(f"<p>{words(r.randint(2, n), mark)}" + ("</p>" if r.random() < 0.9 else "") for _ in range(r.randint(1, 3)))

    def boiler(kind: int) -> str:
        if kind == 0:
            return wrap(r.choice(["nav", "nav", "div"]), ["", "menu", "main-nav", "navbar", "breadcrumbs"], links()) if r.random() < 0.8 else f"<nav>{links()}</nav>"
        if kind == 1:
            return wrap(r.choice(["div", "div", "aside", "section", "p"]), ["ad", "ads", "advert", "ad-banner", "sponsored", "promo"], r.choice([words(r.randint(3, 60), "x"), links()]))
        if kind == 2:
            return wrap(r.choice(["footer", "footer", "div"]), ["footer", "site-footer", "legal", "copyright"], "&copy; " + r.choice([words(r.randint(3, 60), "x"), links(), prose(30, "x")])) if r.random() < 0.5 else f"<footer>&copy; {words(r.randint(3, 80), 'x')}</footer>"
        if kind == 3:
            return wrap(r.choice(["header", "header", "div"]), ["header", "masthead", "site-header", "topbar"], f"<h1>{words(3, 'x')}</h1>" * r.randint(0, 1) + r.choice([links(), words(8, "x")]))
        if kind == 4:
            return wrap(r.choice(["aside", "aside", "div", "section"]), ["sidebar", "related", "widget", "rail", "popular"], f"<h3>{words(2, 'x')}</h3>" + r.choice([links(), prose(30, "x")]))
        if kind == 5:
            return wrap(r.choice(["div", "section", "p"]), ["cookie-notice", "consent", "notice", "alert", "cookie-banner", "popup"], words(r.randint(5, 40), "x") + f"<button>{words(1, 'x')}</button>" * r.randint(0, 1))
        if kind == 6:
            return f"<form>{words(r.randint(2, 20), 'x')}<label>{words(2, 'x')}</label><input><button>{words(1, 'x')}</button></form>" if r.random() < 0.6 else wrap("div", ["newsletter", "subscribe", "login", "search"], f"<p>{words(10, 'x')}</p>")
        if kind == 7:
            one = lambda: wrap(r.choice(["div", "li", "article"]), ["comment", "comment", "reply"], prose(40, "x"))
            return wrap(r.choice(["section", "div", "ol"]), ["comments", "comment-list", "respond", "discussion"], f"<h3>{words(2, 'x')}</h3>" * r.randint(0, 1) + "".join(one() for _ in range(r.randint(1, 4))))
        return wrap(r.choice(["div", "p", "ul"]), ["share", "social", "tags", "byline", "meta"], links())

    def main() -> str:
        parts = [f"<h1>{words(r.randint(1, 12), 'k')}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                n = r.choice([1, 2, 3, 6, 20, 60, 120])
                p = words(r.randint(1, n), "k")
                if r.random() < 0.2:
                    p = f"<b>{p}" + r.choice(["</b>", "", "<br>"])
                if r.random() < 0.15:
                    p += f' <a href="/y">{words(2, "k")}</a> ' + words(5, "k")
                parts.append(f"<p>{p}" + ("</p>" if r.random() < 0.85 else ""))
            elif kind < 0.8:
                parts.append(f"<h{r.randint(2, 4)}>{words(r.randint(1, 6), 'k')}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{words(r.randint(2, 20), 'k')}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{words(20, 'k')}</blockquote>")
            elif kind < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{words(2, 'k')}</td><td>{words(2, 'k')}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.96:
                parts.append(f'<div class="{r.choice(["", "text", "section"])}"><p>{words(30, "k")}</p></div>')
            else:
                parts.append(boiler(r.choice([1, 1, 4, 6, 8])))
        inner = "".join(parts)
        shape = r.random()
        if shape < 0.5:
            return f"<article>{inner}</article>" if r.random() < 0.7 else wrap("article", ["post", "entry", "story"], inner)
        if shape < 0.65:
            return f"<main>{inner}</main>" if r.random() < 0.5 else f"<main><article>{inner}</article></main>"
        if shape < 0.9:
            return wrap(r.choice(["div", "div", "section"]), ["content", "article", "post", "main", "story-body", "entry-content"], inner)
        return f"<div>{inner}</div>" if shape < 0.95 else inner

    top = [boiler(k) for k in r.sample([0, 1, 3, 5, 6], r.randint(0, 4))]
    end = [boiler(k) for k in r.sample([1, 2, 4, 6, 7, 8, 2], r.randint(0, 4))]
    middle = main()
    if r.random() < 0.25:
        middle = f'<div class="{r.choice(["wrap", "container", "layout", ""])}">{middle}{boiler(r.choice([4, 4, 7, 1]))}</div>'
    return "<html><head><title>x</title></head><body>" + "".join(top) + middle + "".join(end) + "</body></html>"


def labels(nodes: list[Node]) -> np.ndarray:
    """1 for elements of a training page that have main text at or below them; empty ones are left as they come."""
    keep = [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        n = nodes[k]
        if any(w[0] == "k" for x in n.items if isinstance(x, str) for w in x.split()):
            keep[k] = 1
        if keep[k] and n.parent >= 0:
            keep[n.parent] = 1
    return np.array(keep[1:], np.float64)


@cache
def model(pages: int = 500, seed: int = 11) -> Trees:
    r = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        nodes = parse(training_page(r))
        if len(nodes) > 1:
            x.append(features(nodes))
            y.append(labels(nodes))
    return boost(np.concatenate(x), np.concatenate(y))


def decode(nodes: list[Node], odds: np.ndarray) -> list[bool]:
    """The likeliest labels in which no kept element has a dropped one above it; odds are log odds to keep.

    Phrases go with the element they stand in, so no word is cut from a sentence.
    """
    kept, dropped = [0.0] * len(nodes), [0.0] * len(nodes)
    log_keep = -np.logaddexp(0, -odds)
    log_drop = -np.logaddexp(0, odds)
    for k in range(len(nodes) - 1, 0, -1):
        up, part = nodes[k].parent, nodes[k].tag in PHRASE
        if not part:
            kept[k] += log_keep[k - 1]
            dropped[k] += log_drop[k - 1]
        kept[up] += kept[k] if part else max(kept[k], dropped[k])
        dropped[up] += dropped[k]
    out = [True] * len(nodes)
    for k in range(1, len(nodes)):
        out[k] = out[nodes[k].parent] and (nodes[k].tag in PHRASE or kept[k] >= dropped[k])
    return out


def blocks(nodes: list[Node], keep: list[bool]) -> str:
    """Text of kept elements; each block element starts a new block, white space within a block is one space."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = " ".join("".join(part).split())
        if text:
            out.append(text)
        part.clear()

    stack = [(0, 0)]
    while stack:
        k, i = stack.pop()
        n = nodes[k]
        if i == 0 and n.tag not in INLINE:
            flush()
        while i < len(n.items):
            x = n.items[i]
            i += 1
            if isinstance(x, str):
                part.append(x)
            elif keep[x]:
                stack.append((k, i))
                stack.append((x, 0))
                break
            elif nodes[x].tag not in INLINE:
                flush()
        else:
            if n.tag not in INLINE:
                flush()
    return "\n\n".join(out)


def main_text(pages: list[str | None], trees: Trees) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    rows = [features(n) for n in parsed]
    odds = trees.log_odds(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for nodes, x in zip(parsed, rows):
        out.append(blocks(nodes, decode(nodes, odds[at : at + len(x)])))
        at += len(x)
    return out


_OUT, _SCHEMA = arrow_schema("page_id long, url string, text string, n_chars long")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points of each row."""
    trees = model()
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column("html")
            for i in range(0, len(batch), PORTION_PAGES):
                got = main_text(source.slice(i, PORTION_PAGES).to_pylist(), trees)
                yield arrow_batch(_SCHEMA, batch.column("page_id").slice(i, len(got)), batch.column("url").slice(i, len(got)), got, [len(t) for t in got])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, _OUT)

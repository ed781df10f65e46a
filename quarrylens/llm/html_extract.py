"""HTML extraction: a tree-structured graphical model over the DOM.

Nodes are block elements and the runs of inline text between their bounds. Each has two
states: it holds main text, or none. A node's own measures (tag, words in class, id and role, length,
links, marks) give its unary potential, a logistic model; each edge has a potential that tells how states of
parents and children go together, by what both elements are called. Both are fitted on labelled pages. Sum-product messages go up from the
leaves and down from the root, which on a tree gives exact marginals, and a run is kept when main
text is the likelier state. Scripts, styles, heads and other parts that are never shown are not nodes.

The labelled pages come from ``labelled_pages``: layouts drawn from common habits of mark-up (fixed lists
below), in which the generator knows which runs are main text. The seed is fixed, so the model is
reproducible; it is fitted on the driver in a second or two from ``TRAIN_PAGES`` pages and broadcast.

Defined results: null and empty html give empty text; mark-up that does not balance is read as browsers do (an
element ends with its parent, a stray end tag is dropped; a tag whose quote is never closed ends at the next >, one that never ends takes the rest of the page); character
references are decoded in each stretch between tags; white space inside a block becomes one space, blocks are
joined by a line feed; repeated rows are read each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 400

#: Elements that bound blocks, that have no end, whose content is raw text, and that are not shown.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html iframe label legend li main menu nav object ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
HIDDEN = frozenset("head script style textarea title noscript template svg math iframe object canvas audio video select datalist noframes xmp".split())
#: What a head may hold; any other start tag ends it, as its end tag and the start of the body may be left out.
IN_HEAD = frozenset("head title base link meta style script noscript template noframes basefont bgsound".split())
#: A start tag of the key ends an open element of the value, up to the nearest of the stops.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
ENDS_P = BLOCK - {"button", "label", "legend", "option", "optgroup", "caption", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
#: Words of class, id and role that tell something.
HINTS = ("ad ads advert advertisement sponsor sponsored promo banner cookie consent gdpr notice alert popup modal overlay newsletter subscribe signup login search nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc header masthead topbar footer copyright legal sidebar aside rail widget related recommended trending popular share social tags comment comments reply replies respond disqus discussion form feedback author byline meta "
         "article content main post entry story body text page document prose blog news title headline lead paragraph").split()  # fmt: skip
#: Elements that speak against main text; the words up to "meta" do too.
AGAINST = frozenset("nav aside footer form button fieldset label legend dialog menu".split())
_AGAINST_HINTS = frozenset(HINTS[: HINTS.index("meta") + 1])
TAGS = "article aside blockquote body button dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html label legend li main nav ol p pre section summary table td th tr ul details dialog".split()

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_HINTED = re.compile(r"(?:^|\s)(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

N_NUMBERS = 9
N_FEATURES = 2 + len(TAGS) + len(HINTS) + N_NUMBERS
_TAG_AT = {t: 2 + i for i, t in enumerate(TAGS)}
_HINT_AT = {h: 2 + len(TAGS) + i for i, h in enumerate(HINTS)}
_NUMBERS_AT = 2 + len(TAGS) + len(HINTS)


class Node:
    __slots__ = ("parent", "tag", "hints", "text", "chars", "links", "marks", "runs")

    def __init__(self, parent: int, tag: str, hints: tuple = ()):
        self.parent, self.tag, self.hints = parent, tag, hints
        self.text: str | None = None
        self.chars = self.links = self.marks = self.runs = 0


class Tags:
    """The tags of a page, one after the other, each character being looked at a bounded number of times.

    A quote opens a value only behind an equals sign, as in browsers; where it is never closed the tag ends at the next >.
    """

    def __init__(self, page: str):
        self.page = page
        self.none: set[str] = set()  # what the rest of the page does not have

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def closed(self, at: int) -> int:
        """The place behind the tag whose name ends at at; the end of the page if it never ends."""
        page = self.page
        while m := _STOP.search(page, at):
            if m[0] == ">":
                return m.end()
            at = m.end()
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=":
                end = self.find(m[0], at)
                if end < 0:
                    end = self.find(">", at)
                    return end + 1 if end >= 0 else len(page)
                at = end + 1
        return len(page)

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """(start, end, name, whether it closes, attributes) of the first tag from at on; the name is '' for what is no element, '!' for character data.

        Past the last tag start and end are those of the page.
        """
        page = self.page
        while True:
            at = self.find("<", at)
            if at < 0:
                return len(page), len(page), "", False, ""
            second = page[at + 1 : at + 2]
            if second == "!" or second == "?":
                if page.startswith("<!--", at):
                    end = self.find("-->", at + 2)
                    return at, end + 3 if end >= 0 else len(page), "", False, ""
                if page.startswith("<![CDATA[", at) and (end := self.find("]]>", at)) >= 0:
                    return at, end + 3, "!", False, page[at + 9 : end]
                end = self.find(">", at)
                return at, end + 1 if end >= 0 else len(page), "", False, ""
            closes = second == "/"
            name = _NAME.match(page, at + 1 + closes)
            if name:
                end = self.closed(name.end())
                return at, end, name[0].lower(), closes, page[name.end() : end - (page[end - 1] == ">")]
            if closes and (end := self.find(">", at)) >= 0:
                return at, end + 1, "", False, ""
            at += 1  # a plain less-than sign


def parse(page: str) -> list[Node]:
    """Nodes in page order, parents first; runs have tag '' and a text."""
    tags = Tags(page)
    nodes = [Node(-1, "html")]
    stack = [0]
    where: dict[str, list[int]] = defaultdict(list)  # the places in the stack of open elements, by tag
    parts: list[str] = []
    linked = anchor = 0
    hidden = ""
    depth = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                run = Node(stack[-1], "")
                run.text, run.chars, run.links, run.runs = text, len(text), min(linked, len(text)), 1
                run.marks = sum(map(text.count, ".,;!?"))
                nodes.append(run)
            parts.clear()
        linked = 0

    def last(tag: str) -> int:
        """The place of the innermost open element of this tag, 0 if there is none."""
        return where[tag][-1] if where.get(tag) else 0

    def close_to(k: int) -> None:
        flush()
        while len(stack) > k:
            where[nodes[stack.pop()].tag].pop()

    def raw_end(tag: str, at: int) -> int:
        """The place behind the end tag of raw text, or the end of the page."""
        end = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
        return (tags.find(">", end.end()) + 1 or len(page)) if end else len(page)

    ends: dict[str, int] = {}

    def last_end(tag: str) -> int:
        """Where the last end tag of that name is, -1 if there is none."""
        if tag not in ends:
            ends[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>]|$)", page, re.I)), default=-1)
        return ends[tag]

    at = 0
    size = len(page)
    while at < size:
        if hidden and hidden in RAW:
            at, hidden = raw_end(hidden, at), ""
            continue
        start, end, tag, closing, attributes = tags.next(at)
        if start > at and not hidden:
            piece = page[at:start]
            parts.append(entities.unescape(piece) if "&" in piece else piece)
            if anchor:
                linked += len(piece)
        at = end
        if not tag or tag == "!":
            if tag and not hidden:
                parts.append(attributes)
            continue
        if hidden:
            if tag == hidden and not attributes.endswith("/"):
                depth += -1 if closing else 1
                if not depth:
                    hidden = ""
            elif hidden == "head" and tag not in IN_HEAD and not closing:
                hidden = ""
            elif tag in RAW and not closing:
                at = raw_end(tag, at)
            if hidden or closing or tag == "head":
                continue
        if closing:
            if tag == "a":
                anchor = 0
            elif tag in BLOCK:
                if k := last(tag):
                    close_to(k)
                else:
                    flush()
            continue
        if tag in HIDDEN:
            if tag in BLOCK:
                flush()
            # What is never closed hides nothing, but for raw text and the head.
            if not attributes.endswith("/") and (tag in RAW or tag == "head" or last_end(tag) >= at):
                hidden, depth = tag, 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag == "a":
            anchor = 1
            continue
        if tag not in BLOCK:
            continue
        flush()
        if tag in ENDS_P and (k := last("p")):
            # Only labels and buttons may lie between.
            if sum(len(where[x]) - bisect_right(where[x], k) for x in ("label", "button") if x in where) == len(stack) - 1 - k:
                close_to(k)
        if tag in ENDS:
            ended, stops = ENDS[tag]
            stop = max(map(last, stops))
            while (k := max(map(last, ended))) > stop:
                close_to(k)
                if tag != "tr":
                    break
        words = []
        if attributes:
            for x in _HINTED.finditer(attributes):
                words += [w for w in _WORD.findall(_CAMEL.sub(" ", x[1] or x[2] or x[3] or "").lower()) if w in _HINT_AT]
        if tag in ("html", "body") and len(stack) > 1 and (tag == "html" or last(tag)):
            continue
        where[tag].append(len(stack))
        nodes.append(Node(stack[-1], tag, tuple(dict.fromkeys(words))))
        stack.append(len(nodes) - 1)
        anchor = 0
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], nodes[nodes[i].parent]
        p.chars += n.chars
        p.links += n.links
        p.marks += n.marks
        p.runs += n.runs
    return nodes


def active(nodes: list[Node]) -> tuple[list[list[int]], np.ndarray]:
    """Each node's features that are on, and its numbers."""
    total = max(1, nodes[0].chars)
    on, numbers, before = [], np.zeros((len(nodes), N_NUMBERS)), 0
    for i, n in enumerate(nodes):
        run = n.text is not None
        if run and nodes[n.parent].runs == 1:  # all that could be said is said by its element
            on.append([])
            before += n.chars
            continue
        f = [0 if run else 1]
        owner = nodes[n.parent] if run else n
        if owner.tag in _TAG_AT:
            f.append(_TAG_AT[owner.tag])
        f += [_HINT_AT[h] for h in owner.hints]
        on.append(f)
        size = max(1, n.chars)
        each = n.chars / max(1, n.runs)
        numbers[i] = (np.log1p(n.chars) / 5, n.links / size, min(1, 20 * n.marks / size), n.chars / total, before / total, np.log1p(each) / 5, np.log1p(n.runs) / 3, min(each, 300) / 300 * (1 - n.links / size), float(n.chars < 25))
        if run:
            before += n.chars
    return on, numbers


def kind(n: Node) -> int:
    """0: a run, or an element that says nothing; 1: its tag or words speak for main text; 2: against; 3: a header, of a page or an article; 4: the page."""
    if n.text is not None:
        return 0
    if n.tag in ("header", "html", "body"):
        return 3 if n.tag == "header" else 4
    if n.tag in AGAINST or any(h in _AGAINST_HINTS for h in n.hints):
        return 2
    return int(n.tag in ("article", "main") or bool(n.hints))


def edge_types(nodes: list[Node]) -> list[int]:
    kinds = [kind(n) for n in nodes]
    return [5 * kinds[n.parent] + k + 25 * (n.text is not None) if i else 0 for i, (n, k) in enumerate(zip(nodes, kinds, strict=True))]


def marginals(parents: list[int], unary: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Probability of state 1 of each node; parents precede children.

    unary: log odds of each node; edges[node, parent state, own state]: log potentials of the edge above it.
    """
    n = len(parents)
    es = edges.reshape(-1, 4).tolist()
    up0, up1 = [0.0] * n, unary.tolist()
    m0, m1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):  # from the leaves
        e00, e01, e10, e11 = es[i]
        a, b = up0[i], up1[i]
        x, y = e00 + a, e01 + b
        s = max(x, y)
        m0[i] = s + log(exp(x - s) + exp(y - s))
        x, y = e10 + a, e11 + b
        s = max(x, y)
        m1[i] = s + log(exp(x - s) + exp(y - s))
        p = parents[i]
        up0[p] += m0[i]
        up1[p] += m1[i]
    belief = np.zeros(n)
    all0, all1 = up0[:], up1[:]
    for i in range(n):  # from the root
        if i:
            e00, e01, e10, e11 = es[i]
            p = parents[i]
            a, b = all0[p] - m0[i], all1[p] - m1[i]
            x, y = a + e00, b + e10
            s = max(x, y)
            d0 = s + log(exp(x - s) + exp(y - s))
            x, y = a + e01, b + e11
            s = max(x, y)
            d1 = s + log(exp(x - s) + exp(y - s))
            s = max(d0, d1)
            all0[i] += d0 - s
            all1[i] += d1 - s
        belief[i] = 1 / (1 + np.exp(np.clip(all0[i] - all1[i], -500, 500)))
    return belief


def potentials(nodes: list[Node], model: dict) -> np.ndarray:
    on, numbers = active(nodes)
    w = model["w"]
    return numbers @ w[_NUMBERS_AT:] + np.array([sum(w[j] for j in f) for f in on])


def extract(page: str | None, model: dict) -> str:
    if not page:
        return ""
    nodes = parse(page)
    belief = marginals([n.parent for n in nodes], potentials(nodes, model), model["edge"][edge_types(nodes)])
    return "\n".join(n.text for n, b in zip(nodes, belief, strict=True) if n.text is not None and b >= 0.5)


#: Habits of mark-up that the labelled pages are drawn from.
_MAIN = ["<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post-content entry">', '<div class="article-body">', '<section class="story">', '<div class="blog post">', '<main role="main">', "<article class=\"post\">", "<div>", "<section>", '<td class="content">']
_NOISE = {
    "nav": ["<nav>", '<div class="menu">', '<ul class="navigation">', '<div id="navbar">', '<div class="breadcrumb">', '<ol class="breadcrumbs">', '<div class="pagination">', '<div role="navigation">'],
    "head": ["<header>", '<div class="header">', '<div id="masthead">', '<div class="topbar">'],
    "foot": ["<footer>", '<div class="footer">', '<div id="footer" class="legal">', '<p class="copyright">'],
    "side": ["<aside>", '<div class="sidebar">', '<div class="widget">', '<div class="related">', '<section class="recommended">', '<div class="trending popular">', '<div class="rail">'],
    "ad": ['<div class="ad">', '<div class="ads banner">', '<div class="advert">', '<p class="sponsored">', '<div id="promo">', '<section class="advertisement">', '<div class="sponsor">'],
    "notice": ['<div class="cookie-notice">', '<div class="cookie">', '<div id="gdpr" class="consent">', '<div class="notice">', '<p class="notice">', '<div class="alert">', '<div class="popup">', '<dialog class="modal">', '<div class="newsletter">', '<section class="subscribe">', '<div role="alert">'],
    "form": ["<form>", '<form class="search">', '<div class="login">', '<form id="signup">', '<fieldset class="feedback">'],
    "share": ['<div class="share">', '<ul class="social">', '<div class="tags">'],
    "comments": ['<div class="comments">', '<section id="comments">', '<div id="disqus" class="discussion">', '<ol class="comment-list comments">', '<div class="replies">', '<div id="respond" class="reply">'],
}
_SYLLABLES = "ka lo mi ten ra su vel dor ne pa tis um gre fo li an".split()


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """(html, the texts of its main blocks in order)."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def sentences(a: int, b: int) -> str:
        return " ".join(words(1, 14).capitalize() + rng.choice(["", ",", "."]) * (i < b) + "." for i in range(rng.randint(a, b)))

    def close(opening: str) -> str:
        return f"</{opening[1:].split()[0].rstrip('>')}>" if opening else ""

    def noise(kind: str) -> str:
        opening = rng.choice(_NOISE[kind])
        inner = {
            "nav": lambda: "<ul>" * (k := rng.random() < 0.7) + "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' if k else f'<a href="/{i}">{words(1, 2)}</a> ' for i in range(rng.randint(2, 12))) + "</ul>" * k,
            "head": lambda: rng.choice([f"<h1>{words(1, 5)}</h1>", f"<p>{words(2, 8)}</p>", f"<a href='/'>{words(1, 3)}</a>", f"<div>{sentences(1, 2)}</div>"]),
            "foot": lambda: rng.choice(["&copy; ", ""]) + rng.choice([words(2, 20), sentences(1, 3), f"<p>{sentences(1, 4)}</p>", f"<a href='/t'>{words(1, 3)}</a> {words(1, 4)}"]),
            "side": lambda: f"<h3>{words(1, 4)}</h3>" + rng.choice(["<ul>" + "".join(f"<li><a href='/{i}'>{words(2, 9)}</a></li>" for i in range(rng.randint(2, 8))) + "</ul>", f"<p>{sentences(1, 4)}</p>"]),
            "ad": lambda: rng.choice([sentences(1, 3), f"<p>{sentences(1, 3)}</p>", f"<a href='/b'>{words(2, 10)}</a>", words(1, 20)]),
            "notice": lambda: rng.choice([sentences(1, 5), f"<p>{sentences(1, 4)}</p><button>{words(1, 2)}</button>"]),
            "form": lambda: f"<label>{words(1, 4)}</label><input name=x><button>{words(1, 3)}</button>" + rng.choice(["", f"<p>{sentences(1, 3)}</p>"]),
            "share": lambda: "".join(f"<a href='/s{i}'>{words(1, 2)}</a> " for i in range(rng.randint(2, 6))),
            "comments": lambda: f"<h3>{words(1, 3)}</h3>" + "".join(rng.choice(["<div class='comment'>{}</div>", "<p>{}</p>", "<li class='comment'><p>{}</p></li>", "<div><b>x</b><p>{}</p></div>"]).format(sentences(1, 8)) for _ in range(rng.randint(1, 7))),
        }[kind]()
        if opening.startswith("<p"):  # a paragraph holds no other
            inner = inner.replace("<p>", "<span>").replace("</p>", "</span>")
        return opening + inner + close(opening)

    for _ in range(n):
        main = rng.choice(_MAIN)
        texts, body = [], []

        def block(tag: str, text: str, texts=texts, body=body) -> None:
            texts.append(text)
            inner = text if rng.random() < 0.7 else f"<b>{text}" + rng.choice(["</b>", "<br>", ""])
            body.append(f"<{tag}>{inner}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.8 else ""))

        if rng.random() < 0.85:
            title = words(2, 12)
            texts.append(title)
            body.append(rng.choice(["<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", "<h1 class='title'>{}</h1>"]).format(title))
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            if kind < 0.75:
                block("p", sentences(1, 9) if rng.random() < 0.8 else words(1, 4))
            elif kind < 0.83:
                block("h2", words(1, 7))
            elif kind < 0.9:
                items = [words(1, 15) for _ in range(rng.randint(1, 5))]
                texts += items
                body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            elif kind < 0.95:
                block("blockquote", sentences(1, 3))
            else:
                rows = [words(1, 4) for _ in range(rng.randint(2, 6))]
                texts += rows
                body.append("<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in rows) + "</table>")
            if rng.random() < 0.06:
                body.append(noise(rng.choice(["ad", "notice", "side", "share"])))
        if rng.random() < 0.25:
            body.append(noise(rng.choice(["share", "form", "comments"])))
        article = main + "".join(body) + close(main)
        if main.startswith("<td"):
            article = f"<table><tr>{noise('side').join(['<td>', '</td>']) if rng.random() < 0.5 else ''}{article}</tr></table>"
        for _ in range(rng.randint(0, 2)):
            article = rng.choice(['<div id="page">', '<div class="wrapper">', "<div>"]) + (noise("side") if rng.random() < 0.2 else "") + article + "</div>"
        top = [noise(k) for k in ("head", "nav", "notice", "ad", "form") if rng.random() < 0.5]
        bottom = [noise(k) for k in ("share", "comments", "side", "ad", "notice", "foot", "form") if rng.random() < 0.4]
        rng.shuffle(top)
        yield f"<!DOCTYPE html><html><head><title>{words(1, 4)}</title><script>var t='</p>';</script></head><body>{''.join(top)}{article}{''.join(bottom)}</body></html>", texts


def states(nodes: list[Node], texts: list[str]) -> np.ndarray:
    """1 for the runs that are the main texts, matched in order, and for all above them."""
    y = np.zeros(len(nodes))
    at = 0
    for i, n in enumerate(nodes):
        if n.text is not None and at < len(texts) and n.text == texts[at]:
            y[i] = 1
            at += 1
    for i in range(len(nodes) - 1, 0, -1):
        if y[i]:
            y[nodes[i].parent] = 1
    return y


def train(pages: int = TRAIN_PAGES, seed: int = 7) -> dict:
    """Unary weights by logistic regression, edge potentials by smoothed counts over the child's own rate."""
    xs, ys, joint = [], [], np.full((50, 2, 2), 0.5)
    for page, texts in labelled_pages(pages, seed):
        nodes = parse(page)
        y = states(nodes, texts)
        on, numbers = active(nodes)
        x = np.zeros((len(nodes), N_FEATURES))
        for i, f in enumerate(on):
            x[i, f] = 1
        x[:, _NUMBERS_AT:] = numbers
        xs.append(x)
        ys.append(y)
        types = edge_types(nodes)
        for i, n in enumerate(nodes[1:], 1):
            joint[types[i], int(y[n.parent]), int(y[i])] += 1
    x, y = np.vstack(xs), np.concatenate(ys)
    w = np.zeros(N_FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.eye(N_FEATURES), x.T @ (y - p) - 0.5 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    joint[:, 0, 1] = 0.05  # a node without main text has no child with it
    given = joint / joint.sum(2, keepdims=True)
    return {"w": w, "edge": np.log(given) - np.log(joint.sum((0, 1)) / joint.sum())[None, None, :]}


def extracted(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), shared.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

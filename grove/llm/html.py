"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

Each block node of a page gets features of its own (tag, attribute tokens,
depth), of its subtree (text and link density) and of its siblings. Gradient-
boosted trees, fitted with Spark ML on seeded made-up layouts whose main text
is known, give the odds that a node holds main text. A dynamic program over
the tree then picks the best labels in which nothing below a dropped node is
kept.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows

#: A comment, a declaration, or a tag: slash, name, attributes. Quotes count only after an equals sign, as in HTML.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?+|'([^']*+)'?+|([^\s\"'>][^\s>]*+)))?+")
TOKEN = re.compile(r"[a-z]+")
NAME = re.compile(r"\S+")
SPACE = re.compile(r"\s+")
OPEN, CLOSE = "\ue000", "\ue001"
MARKS = re.compile(f"([{OPEN}{CLOSE}])")
UNMARK = re.compile(r' (?:class|id)="[^"]*"')

#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes")
GONE = frozenset("head script style noscript template iframe textarea title input".split())
CONTROLS = frozenset("button select datalist".split())
FIELDS = CONTROLS | {"input", "textarea"}
BLOCK = frozenset("html body div p ul ol li dl dt dd table thead tbody tfoot tr td th caption section article aside main nav header footer h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hr center form fieldset dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = ("ul", "ol", "dl", "table", "div", "section", "article", "body", "select")
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
SCOPE = frozenset("td th caption table object button".split())
ROWS = frozenset("tr td th tbody thead tfoot caption".split())
FOREIGN = ("svg", "math")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.IGNORECASE) for t in RAW}

#: Words in class, id and role that tell what a node is for.
GOOD_WORDS = frozenset("article content main post entry story body text page blog news".split())
BAD_WORDS = frozenset(
    "nav navbar navigation menu menubar header masthead topbar foot footer bottom colophon copyright sidebar side aside widget rail ad ads adv advert advertisement banner promo promotion sponsor sponsored dfp "
    "cookie cookies consent gdpr notice notices alert popup modal overlay toolbar breadcrumb breadcrumbs crumbs pagination pager share sharing social related recommended more tags taglist meta byline login signup subscribe newsletter search form "
    "comment comments respond reply replies disqus discussion feedback skip hidden contentinfo complementary".split()
)
WHOLE_BAD = frozenset(f"={w}" for w in BAD_WORDS)
COMMENT_WORDS = frozenset("comment comments respond reply replies disqus discussion feedback".split())
AD_WORDS = frozenset("ad ads adv advert advertisement banner promo sponsor sponsored cookie consent gdpr notice popup modal overlay alert".split())


class Node:
    """An element or a text; gone marks what never holds main text."""

    __slots__ = ("children", "depth", "gone", "keep", "parent", "tag", "text", "words")

    def __init__(self, tag: str, words: frozenset[str], parent: Node | None):
        self.tag, self.words, self.parent, self.children, self.text = tag, words, parent, [], ""
        self.depth, self.keep, self.gone = parent.depth + 1 if parent else 0, True, tag in GONE


def attribute_words(attributes: str) -> frozenset[str]:
    """Words of an element's attributes; "=" stands before one that is, with digits at most, a whole name."""
    found = []
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            for part in NAME.findall("".join(values).lower()):
                words = TOKEN.findall(part)
                found += [f"={words[0]}", *words] if len(words) == 1 else words
        elif name.lower() == "hidden":
            found += ["=hidden", "hidden"]
    return frozenset(found)


class OpenElements:
    """The elements that are open, from the root down, with the places of each tag, of blocks and of what bounds a scope, so that no tag has to walk up."""

    def __init__(self):
        self.root = Node("#root", frozenset(), None)
        self.stack, self.places, self.blocks, self.scopes = [self.root], {}, [0], [0]

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at this place and all below it."""
        while len(self.stack) > max(at, 1):
            self.places[self.stack.pop().tag].pop()
        for places in (self.blocks, self.scopes):
            while places[-1] >= len(self.stack):
                places.pop()

    def before(self, tag: str) -> None:
        """Closes what the start of such an element ends without an end tag."""
        if (head := self.last("head")) and tag not in IN_HEAD:
            self.cut(head)
        if tag in BLOCK and (option := self.last("option")):
            self.cut(option)
        if tag in CLOSES_P and (p := self.last("p")) > self.scopes[-1]:
            self.cut(p)
        if tag in HEADINGS and self.top.tag in HEADINGS:
            self.cut(len(self.stack) - 1)
        if tag in SAME:
            fence = self.last("table") if tag == "tr" else self.last("table", "tr") if tag in ("td", "th") else self.last(*FENCE)
            if open_ones := [at for t in SAME[tag] if (at := self.last(t)) > fence]:
                self.cut(min(open_ones))

    def end(self, tag: str) -> None:
        """Closes the innermost such element that an end tag can reach: rows within their table, blocks within their cell, others within their block."""
        at = self.last(tag)
        if tag in ROWS:
            reach = self.last("table")
        elif tag in BLOCK:
            reach = 0 if tag in ("table", "html", "body") else self.last("td", "th", "caption")
        else:
            reach = 0 if tag in CONTROLS or tag == "head" else self.blocks[-1]
        if at > reach:
            self.stack[at].gone |= tag in CONTROLS
            self.cut(at)


def parse(source: str) -> Node:
    """The tree of the page's elements; a text is a child of tag "#". Open ends close as browsers close them, in time linear in the page."""
    elements = OpenElements()
    at = 0

    def text(a: int, b: int) -> None:
        if b > a:
            found = html.unescape(source[a:b])
            if (head := elements.last("head")) and found.strip():
                elements.cut(head)
            child = Node("#", frozenset(), elements.top)
            child.text = found
            elements.top.children.append(child)

    while m := TAG.search(source, at):
        text(at, m.start())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            elements.end(tag)
            continue
        elements.before(tag)
        child = Node(tag, attribute_words(m[3]) if m[3] and tag not in ("html", "body") else frozenset(), elements.top)
        child.gone |= tag == "option" and elements.last(*CONTROLS) > 0
        elements.top.children.append(child)
        if tag in RAW_END:
            end = RAW_END[tag].search(source, at)
            at = end.start() if end else len(source)
            if end:
                close = source.find(">", at)
                at = close + 1 if close >= 0 else len(source)
        elif tag not in VOID and not (m[3].endswith("/") and (tag in FOREIGN or elements.last(*FOREIGN))):
            elements.push(child)
    text(at, len(source))
    return elements.root


def describe(root: Node) -> tuple[list[Node], list[list[float]]]:
    """The block nodes in page order with their features.

    Words of the attributes of html and body tell nothing of what is below, and
    neither do those that speak against a node which has half of the page's text
    or more; it is then its parts that have to tell.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    chars, links, tags, ends, commas, blocks, fields = ({} for _ in range(7))
    for node in reversed(order):
        own = [0, 0, 1, 0, 0, 1]
        if node.tag == "#":
            own = [len(node.text.strip()), 0, 0, sum(map(node.text.count, ".!?")), node.text.count(","), 0]
        elif node.gone:
            own = [0, 0, 1, 0, 0, 0]
        else:
            own[5] = node.tag in BLOCK
            for c in node.children:
                for i, x in enumerate((chars[id(c)], links[id(c)], tags[id(c)], ends[id(c)], commas[id(c)], blocks[id(c)])):
                    own[i] += x
            if node.tag == "a":
                own[1] = own[0]
            fields[id(node)] = sum(fields.get(id(c), 0) + (c.tag in FIELDS) for c in node.children)
        for d, x in zip((chars, links, tags, ends, commas, blocks), own):
            d[id(node)] = x
    total = max(1, chars[id(root)])
    nodes, rows, around, inside = [], [], {}, {id(root): (0, 0, 0, 0, 0.0)}
    said = {id(root): frozenset()}
    for node in order[1:]:
        if node.tag == "#" or node.gone or id(node.parent) not in inside:
            continue
        good, bad, whole, article, form = inside[id(node.parent)]
        words = node.words if 2 * chars[id(node)] < total else node.words & GOOD_WORDS
        said[id(node)] = words
        good, bad = good + bool(words & GOOD_WORDS), bad + bool(words & BAD_WORDS or node.tag in ("nav", "aside", "footer"))
        whole = whole + bool(words & WHOLE_BAD or node.tag in ("nav", "aside", "footer"))
        form = max(chars[id(node)], 1) / total if node.tag == "form" else form
        inside[id(node)] = (good, bad, whole, article + (node.tag in ("article", "main")), form)
        if node.tag not in BLOCK:
            continue
        if id(node.parent) not in around:
            siblings = [s for s in node.parent.children if s.tag != "#"]
            around[id(node.parent)] = len(siblings), {id(s): i for i, s in enumerate(siblings)}, sum(chars[id(s)] for s in siblings), Counter(s.tag for s in siblings), [*(chars[id(s)] / total for s in siblings[1:]), 0.0]
        n, spots, beside, kinds, behind = around[id(node.parent)]
        spot, c = spots[id(node)], chars[id(node)]
        articles = kinds["article"] + kinds["main"] - (node.tag in ("article", "main"))
        nodes.append(node)
        rows.append([
            float(node.depth), math.log1p(c), math.log1p(tags[id(node)]), c / tags[id(node)] / 100, links[id(node)] / max(1, c), c / total,
            ends[id(node)] / max(1, c) * 100, commas[id(node)] / max(1, c) * 100, math.log1p(blocks[id(node)]),
            math.log1p(n), spot / n, c / max(1, beside), kinds[node.tag] / n,
            float(bool(words & GOOD_WORDS)), float(bool(words & BAD_WORDS)), float(bool(words & AD_WORDS)), float(bool(words & COMMENT_WORDS)), float(bool(words & WHOLE_BAD)),
            float(min(good, 3)), float(min(bad, 3)), float(min(whole, 3)), float(article > 0),
            float(node.tag in ("article", "main")), float(node.tag in ("nav", "aside", "footer")), float(node.tag == "header"), float(node.tag in ("p", "blockquote", "pre")), float(node.tag[1] if node.tag in HEADINGS else 0), float(bool(said[id(node.parent)] & BAD_WORDS)), behind[spot],
            float(node.tag in ("ul", "ol", "li", "dl", "dt", "dd")), float(articles > 0),
            float(form > 0), form, math.log1p(fields[id(node)]), fields[id(node)] / max(1, c) * 100,
        ])
    return nodes, rows


def decode(root: Node, nodes: list[Node], odds: list[float]) -> None:
    """Sets keep on every block node: the labels of the highest total log odds in which no node below a dropped one is kept."""
    own = {id(n): x for n, x in zip(nodes, odds)}
    best, dropped, order, stack = {}, {}, [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.children)
    for node in reversed(order):
        x = own.get(id(node), 0.0)
        dropped[id(node)] = -x + sum(dropped[id(c)] for c in node.children)
        kept = x + sum(max(best[id(c)], dropped[id(c)]) for c in node.children)
        best[id(node)] = kept if id(node) in own else max(kept, dropped[id(node)]) if node.tag != "#" else 0.0
    for node in order:
        above = node.parent.keep if node.parent else True
        node.keep = above and not node.gone and (id(node) not in own or best[id(node)] >= dropped[id(node)])


def main_text(root: Node) -> str:
    """The kept blocks' texts in page order."""
    blocks, now = [], []

    def flush() -> None:
        if line := SPACE.sub(" ", "".join(now)).strip():
            blocks.append(line)
        now.clear()

    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, leaving = stack.pop()
        if leaving:
            flush()
        elif node.tag == "#":
            now.append(node.text)
        elif node.keep:
            if node.tag in BLOCK:
                flush()
                stack.append((node, True))
            elif node.tag == "br":
                now.append(" ")
            stack.extend((c, False) for c in reversed(node.children))
        elif node.tag in BLOCK:
            flush()
    flush()
    return "\n".join(blocks)


ANY_WORDS = sorted(GOOD_WORDS | BAD_WORDS)


class Layouts:
    """Seeded made-up pages whose block nodes are known to hold main text or not; a share of them, bare, has no class or id at all."""

    def __init__(self, seed: int = 11, bare: float = 0.1):
        self.draw, self.bare = random.Random(seed), bare
        self.syllables = ["".join(self.draw.choice(x) for x in ("bcdfglmnprstv", "aeiou", "nrstl ")).strip() for _ in range(80)]

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.draw.choices(self.syllables, k=self.draw.randint(1, 3))) for _ in range(self.draw.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(f"{self.words(1, 18).capitalize()}{', ' + self.words(2, 9) if self.draw.random() < 0.4 else ''}." for _ in range(self.draw.randint(low, high)))

    def marked(self, *names: str) -> str:
        return "" if self.draw.random() < 0.25 else f' {self.draw.choice(("class", "id"))}="{self.draw.choice(names)}{self.draw.choice(("", "-box", " wide", "-1"))}"'

    def links(self, low: int = 3, high: int = 12) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.draw.randint(low, high))) + "</ul>"

    def theme(self, named: str = "") -> str:
        """Attributes as themes put them on containers of anything, main text included: names of all kinds, alone and in compounds."""
        d = self.draw
        if d.random() < 0.4 and not named:
            return ""
        some = lambda: d.choice(("x", "col", "has", "with", "is", "site", "single", "type", "layout", "category", "tag", "js", "no", "open", "fixed", "grid", self.words(1, 1)))
        kinds = (lambda: some(), lambda: f"{some()}-{d.choice(ANY_WORDS)}", lambda: f"{d.choice(ANY_WORDS)}-{some()}", lambda: f"{some()}-{d.randint(1, 900)}", lambda: f"{some()}-{some()}-{d.choice(ANY_WORDS)}")
        names = [*([named] if named else []), *(d.choice(kinds)() for _ in range(d.randint(1, 5)))]
        d.shuffle(names)
        return f' {"class" if d.random() < 0.8 else "id"}="{" ".join(names)}"'

    def boilerplate(self, where: str) -> str:
        d = self.draw
        top = [
            lambda: f"<nav{self.marked('nav', 'menu')}>{self.links()}</nav>",
            lambda: f"<div{self.marked('nav', 'topbar', 'menu') or ' class="menu"'}>{self.links()}</div>",
            lambda: f"<header{self.marked('header', 'masthead')}><h1>{self.words(1, 4)}</h1>{self.links(2, 6)}</header>",
            lambda: f'<div class="{d.choice(("cookie-notice", "consent", "alert notice"))}"><p>{self.sentences(1, 3)}</p></div>',
            lambda: f'<div class="{d.choice(("ad", "advert", "banner", "promo"))}">{self.sentences(1, 3)}</div>',
            lambda: f'<div class="{d.choice(("breadcrumbs", "crumbs"))}"><a href="/">{self.words(1, 2)}</a> / {self.words(1, 3)}</div>',
        ]
        below = [
            lambda: f"<footer>{d.choice(('&copy; ', ''))}{self.words(1, 5)}{d.choice((' &middot; ', ' | '))}{self.sentences(1, 2)}</footer>",
            lambda: f"<footer{self.marked('footer')}><p>{self.sentences(1, 2)}</p>{self.links(2, 6)}</footer>",
            lambda: f"<aside{self.marked('sidebar', 'related', 'widget')}><h3>{self.words(1, 3)}</h3>{self.links()}</aside>",
            lambda: f"<div class=\"{d.choice(('sidebar', 'related', 'widget'))}\"><h3>{self.words(1, 3)}</h3><p>{self.sentences(1, 2)}</p>{self.links(2, 5)}</div>",
            lambda: f'<{(t := d.choice(("section", "div")))} id="{d.choice(("comments", "respond", "disqus_thread"))}"><h3>{self.words(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{self.sentences(1, 4)}</p></div>' for _ in range(d.randint(1, 5))) + f"</{t}>",
            lambda: f'<div class="{d.choice(("share", "social", "newsletter"))}"><p>{self.words(2, 6)}</p></div>',
            lambda: f'<div class="{d.choice(("ad", "sponsor", "banner"))}">{self.sentences(1, 3)}</div>',
        ]
        either = [
            lambda: f'<form{self.marked("search", "signup", "subscribe")}><label>{self.words(1, 3)}</label> <input type="text" name="q"><button>{self.words(1, 2)}</button></form>',
            lambda: f'<form action="/{self.words(1, 1)}" method="post">{d.choice(("<p>", "<div>", "<h3>"))}{d.choice((self.words(2, 6), self.sentences(1, 3)))}<input type="email"><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button type="submit">{self.words(1, 2)}</button></form>',
            lambda: f"<form>{d.choice(('<p>', '<div>', ''))}{self.words(2, 9)}</form>",
        ]
        return d.choice(either if d.random() < (0.65 if where == "inside" else 0.17) else top if where == "top" else below)()

    def article(self, headed: bool = True) -> str:
        d, parts = self.draw, []
        if headed and d.random() < 0.8:
            parts.append(f"<h1>{self.words(2, 10)}</h1>")
        for _ in range(d.randint(1, 14)):
            kind = d.random()
            parts.append(
                f"<p>{self.sentences(1, d.choice((1, 3, 9)))}</p>" if kind < 0.58 else f"<p><{(t := d.choice(('em', 'span', 'math', 'code')))}><i>{self.words(1, 3)}</i></{t}> {self.sentences(1, 3)}</p>" if kind < 0.65 else f"<p>{d.choice((self.words(8, 200), ' '.join([self.words(1, 1)] * d.randint(8, 200))))}</p>" if kind < 0.75 else f"<h2>{self.words(1, 6)}</h2>" if kind < 0.82 else f"<p><b>{self.words(2, 8)}.<br><p>{self.sentences(1, 4)}</p>" if kind < 0.88
                else "<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(d.randint(2, 6))) + "</ul>" if kind < 0.93 else f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>" if kind < 0.96
                else f"<p>{self.words(3, 9)} <a href='/x'>{self.words(1, 3)}</a> {self.words(3, 9)}.</p>" if kind < 0.98
                else "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}" for _ in range(3)) for _ in range(d.randint(1, 6))) + "</table>" if kind < 0.99 else f"<pre>{self.words(5, 60)}</pre>"
            )
            if d.random() < 0.06:
                parts.append(f"{CLOSE}{self.boilerplate('inside')}{OPEN}")
        return "".join(parts)

    def page(self) -> str:
        """Main text stands between the marks OPEN and CLOSE."""
        d = self.draw
        tops = "".join(self.boilerplate("top") for _ in range(d.randint(0, 4)))
        below = "".join(self.boilerplate("below") for _ in range(d.randint(0, 4)))
        opened, closed = d.choice((("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main"><article>', "</article></div>"), ("<div>", "</div>"), ('<section class="post-body">', "</section>"), ("", "")))
        if opened and d.random() < 0.35:
            tag = d.choice(("article", "main", "div", "section"))
            opened, closed = f"<{tag}{self.theme(d.choice(('', '', 'post', 'entry', 'hentry')))}>", f"</{tag}>"
        headline = ""
        if d.random() < 0.2:
            title = f"{OPEN}<h1>{self.words(2, 10)}</h1>{CLOSE}"
            headline = d.choice((title, f'<div class="{d.choice(("title", "headline", "entry-title", "page-title"))}">{title}</div>', f"<div>{title}</div>"))
        article = f"{headline}{opened}{OPEN}{self.article(not headline)}{CLOSE}{closed}"
        form = f'<form method="post" id="{d.choice(("form1", "aspnetForm", "main"))}">' + "".join(f'<input type="hidden" name="{i}">' for i in range(d.randint(0, 4)))
        around = d.random()
        article = f"{form}{article}</form>" if around < 0.06 else article
        for _ in range(d.choice((0, 0, 0, 1, 2))):
            tag = d.choice(("div", "div", "section", "main"))
            beside = self.boilerplate("below") if d.random() < 0.4 else ""
            article = f"<{tag}{self.theme()}>{article}{beside}</{tag}>"
        body = f"{form}{tops}{article}{below}</form>" if 0.06 < around < 0.15 else f"{tops}{article}{below}"
        for _ in range(d.choice((0, 0, 1))):
            body = f"<div{self.theme()}>{body}</div>"
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><style>p{{}}</style></head><body{self.theme()}>{body}</body></html>"
        return UNMARK.sub("", page) if d.random() < self.bare else page

    def rows(self, pages: int) -> Iterator[tuple[list[float], float]]:
        """(features, label) of the block nodes: a node is main text if some of its text is."""
        for _ in range(pages):
            root = parse(self.page())
            main = self.truth(root)
            for node, row in zip(*describe(root)):
                yield row, float(main[id(node)])

    @staticmethod
    def truth(root: Node) -> dict[int, bool]:
        """Whether each node has text between the marks, which are then taken out."""
        main, on, stack = {}, False, [(root, False)]
        while stack:
            node, leaving = stack.pop()
            if leaving:
                main[id(node)] = any(main[id(c)] for c in node.children)
            elif node.tag == "#":
                some, pieces = False, MARKS.split(node.text)
                for piece in pieces:
                    if MARKS.fullmatch(piece):
                        on = piece == OPEN
                    elif piece.strip():
                        some |= on
                main[id(node)], node.text = some, "".join(p for p in pieces if not MARKS.fullmatch(p))
            else:
                stack.append((node, True))
                if not node.gone:
                    stack.extend((c, False) for c in reversed(node.children))
                else:
                    main.update((id(c), False) for c in node.children)
        return main


class Trees:
    """The boosted trees as arrays: feature, threshold, left, right and value of each node."""

    def __init__(self, model):
        self.start, self.weights, rows = [], list(model.treeWeights), []

        def add(node) -> int:
            at = len(rows)
            rows.append(None)
            if node.subtreeDepth() == 0:
                rows[at] = (-1, 0.0, 0, 0, node.prediction())
            else:
                split = node.split()
                rows[at] = (split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()), 0.0)
            return at

        for tree in model.trees:
            self.start.append(add(tree._java_obj.rootNode()))
        self.feature, self.threshold, self.left, self.right, self.value = (np.array(c) for c in zip(*rows))
        leaf = self.feature < 0
        self.left[leaf] = self.right[leaf] = np.flatnonzero(leaf)
        self.feature[leaf] = 0
        self.depth = max(t.depth for t in model.trees)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row; all trees step down together, and leaves stay where they are."""
        at, every = np.tile(self.start, (len(x), 1)), np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[every, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 2 * self.value[at] @ np.array(self.weights)


#: Tasks that fit the trees.
TASKS = 4

#: Fitted trees by application, so that a session fits once.
_fitted: dict[str, Trees] = {}


def session_trees(spark: SparkSession) -> Trees:
    app = spark.sparkContext.applicationId
    if app not in _fitted:
        _fitted[app] = train_trees(spark)
    return _fitted[app]


def train_trees(spark: SparkSession, pages: int = 900, rounds: int = 40, depth: int = 4, seed: int = 11) -> Trees:
    """Fitted on `pages` made-up pages, a bounded sample that doesn't depend on the table."""
    rows = [(y, Vectors.dense(x)) for x, y in Layouts(seed).rows(pages)]
    frame = spark.createDataFrame(rows, ["label", "features"]).coalesce(TASKS)
    return Trees(GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(frame))


def extract(source: str | None, trees: Trees) -> str:
    if not source:
        return ""
    root = parse(source)
    nodes, rows = describe(root)
    if nodes:
        decode(root, nodes, trees.odds(np.array(rows)).tolist())
    else:
        decode(root, [], [])
    return main_text(root)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), trees: Trees | None = None) -> DataFrame:
    """The columns in keep, text and n_chars (code points).

    One row per row, in one pass without a shuffle. A null or empty page, or
    one without main text, has an empty text; a page without elements is all
    main text; repeated rows are read one by one; an empty table gives no rows.
    """
    trees = trees or session_trees(pages.sparkSession)

    def setup() -> Callable[[str | None], tuple]:
        def row(source):
            text = extract(source, trees)
            return text, len(text)

        return row

    return map_rows(pages, [html_col], keep, "text string, n_chars long", setup)
